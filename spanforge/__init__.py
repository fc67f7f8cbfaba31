"""A PySpark-native engine for labelled-text corpora."""
