"""The place of every row in its file, whatever splits the files are read in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, path: str = "path", ord: str = "ord") -> DataFrame:
    """Adds the file and the row's place in it (from 0) to rows read from text, CSV or JSON files.

    A split is read in its order by one task, so a row's place in it is how many rows
    the task gave after the split's first; splits then follow by where they begin.  One
    row a split is shuffled for that, and no file is sorted.  Has to stand right on the
    reader: a filter in front would be counted.
    """
    read = rows.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias("start_"), F.monotonically_increasing_id().alias("given_"))
    blocks = read.groupBy(path, "start_").agg(F.min("given_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(path).orderBy("start_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.select(path, "start_", (before - F.col("first_")).alias("shift_"))
    return read.join(shift, [path, "start_"]).withColumn(ord, F.col("given_") + F.col("shift_")).drop("start_", "given_", "shift_")


def _digest(ord: Column | str, *columns: str) -> list[Column]:
    cells = [F.col(ord) if isinstance(ord, str) else ord, *[F.to_json(F.struct(F.col(c))) for c in columns]]
    return [F.xxhash64(*cells, F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2)]


def ordered_fingerprint(rows: DataFrame, columns: list[str], *keys: str, ord: str = "ord") -> DataFrame:
    """(keys, rows, a, b): number of rows and two sums that tell contents and order of rows.

    Each row's hash holds its place, so sums of hashes add up over tasks and still
    differ if two rows change places.
    """
    one, two = _digest(ord, *columns)
    hashed = rows.select(*keys, one.alias("one_"), two.alias("two_"))
    return hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("one_").alias("a"), F.sum("two_").alias("b"))


def order_differences(published: DataFrame, computed: DataFrame, columns: list[str], *keys: str, ord: str = "ord") -> DataFrame:
    """(keys, ord, code): places where two ordered tables differ: missing, added, or of other contents."""
    cells = F.to_json(F.struct(*columns))
    a, b = (t.select(*keys, ord, cells.alias(name)) for t, name in ((published, "a_"), (computed, "b_")))
    both = a.join(b, [*keys, ord], "full")
    code = F.when(F.col("b_").isNull(), "missing").when(F.col("a_").isNull(), "added").when(F.col("a_") != F.col("b_"), "other_row")
    return both.select(*keys, ord, code.alias("code")).filter("code is not null")
