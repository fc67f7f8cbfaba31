"""Named queries over the Parquet tables, and their SQL."""
