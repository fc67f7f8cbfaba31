"""Evaluation reports: proposed records against gold records, case by case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Categories that a full evaluation covers.
CATEGORIES = ["structured_annotations", "flattened_highlights", "colored_fonts", "mixed_conventions", "decorations", "malformed_pdf", "unsupported_scan"]


def record_ratios(gold: DataFrame, observed: DataFrame, key: str = "case_id") -> DataFrame:
    """(case, gold, observed, matched, precision, recall) on whole records; null where nothing is counted.

    Both sides: key and record (canonical JSON); records are compared as sets.
    """
    a, b = gold.select(key, "record").distinct(), observed.select(key, "record").distinct()
    sides = a.withColumn("g", F.lit(1)).withColumn("o", F.lit(0)).unionByName(b.withColumn("g", F.lit(0)).withColumn("o", F.lit(1)))
    each = sides.groupBy(key, "record").agg(F.max("g").alias("g"), F.max("o").alias("o"))
    out = each.groupBy(key).agg(F.sum("g").alias("gold"), F.sum("o").alias("observed"), F.sum(F.col("g") * F.col("o")).alias("matched"))
    return out.withColumns({"precision": F.round(F.try_divide("matched", "observed"), 9), "recall": F.round(F.try_divide("matched", "gold"), 9)})


SPAN = ["sentence_id", "page", "s", "e", "text"]


def span_ratios(gold: DataFrame, observed: DataFrame, key: str = "case_id") -> DataFrame:
    """(case, gold, observed, matched, precision, recall, label_matches, label_accuracy) on spans.

    Both sides: key, the span's five columns, label and ord.  If a side repeats a
    span, its last label counts.
    """
    last = lambda df, name: df.groupBy(key, *SPAN).agg(F.max_by("label", "ord").alias(name))
    joined = last(gold, "g").join(last(observed, "o"), [key, *SPAN], "full_outer")
    both = F.col("g").isNotNull() & F.col("o").isNotNull()
    out = joined.groupBy(key).agg(F.count("g").alias("gold"), F.count("o").alias("observed"), F.count_if(both).alias("matched"), F.count_if(both & (F.col("g") == F.col("o"))).alias("label_matches"))
    divide = lambda a, b: F.round(F.try_divide(a, b), 9)
    return out.withColumns({"precision": divide("matched", "observed"), "recall": divide("matched", "gold"), "label_accuracy": divide("label_matches", "matched")})


def failures_by_label(gold: DataFrame, observed: DataFrame, key: str = "case_id") -> DataFrame:
    """(label, missed, wrong): gold spans that were not found, or found with another label."""
    last = lambda df, name: df.groupBy(key, *SPAN).agg(F.max_by("label", "ord").alias(name))
    joined = last(gold, "label").join(last(observed, "o"), [key, *SPAN], "left")
    return joined.groupBy("label").agg(F.count_if(F.col("o").isNull()).alias("missed"), F.count_if(F.col("o") != F.col("label")).alias("wrong")).filter("missed + wrong > 0")


def rates(proposals: DataFrame, *keys: str) -> DataFrame:
    """Corrected proposals over those made, abstentions over all; null where nothing is counted.

    proposals: label (null: abstained), corrected.
    """
    made = F.count("label")
    return proposals.groupBy(*keys).agg(
        made.alias("proposals"),
        F.round(F.try_divide(F.count_if(F.col("corrected") & F.col("label").isNotNull()), made), 9).alias("correction_rate"),
        F.round(F.try_divide(F.count_if(F.col("label").isNull()), F.count(F.lit(1))), 9).alias("abstention_rate"),
    )


def coverage(cases: DataFrame, *keys: str) -> DataFrame:
    """Required categories that no case has."""
    required = F.array(*[F.lit(c) for c in CATEGORIES])
    return cases.groupBy(*keys).agg(F.array_sort(F.array_except(required, F.collect_set("category"))).alias("missing"))
