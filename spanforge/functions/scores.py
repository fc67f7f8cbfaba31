"""Score expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where nothing is counted."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1_of(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return f1_of(precision(tp, fp), recall(tp, fn))


def with_scores(counts: DataFrame, digits: int | None = DIGITS) -> DataFrame:
    """Adds precision, recall, f1 and support to tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = counts.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn), "support": (tp + fn).cast("long")})
    return scored if digits is None else scored.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})


def summary(counts: DataFrame, *keys: str) -> DataFrame:
    """Micro and macro scores from rows (keys..., value, tp, fp, fn), in one aggregation.

    The macro average leaves out labels without gold support; their false
    positives still count in the micro scores.  absent lists those labels.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = precision(tp, fp), recall(tp, fn)
    there = tp + fn > 0
    mean = lambda c: F.coalesce(F.avg(F.when(there, c)), F.lit(0.0))
    totals = counts.groupBy(*keys).agg(
        F.sum(tp).alias("tp"),
        F.sum(fp).alias("fp"),
        F.sum(fn).alias("fn"),
        mean(p).alias("macro_precision"),
        mean(r).alias("macro_recall"),
        mean(f1_of(p, r)).alias("macro_f1"),
        F.array_join(F.array_sort(F.collect_set(F.when(~there, F.col("value")))), ",").alias("absent"),
    )
    t, f, n = F.col("tp"), F.col("fp"), F.col("fn")
    return totals.select(
        *keys,
        *(F.round(c, DIGITS).alias(name) for name, c in (("micro_precision", precision(t, f)), ("micro_recall", recall(t, n)), ("micro_f1", f1(t, f, n)))),
        *(F.round(c, DIGITS).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")),
        "absent",
    )
