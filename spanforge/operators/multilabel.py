"""Scores of multi-label texts: counts, averages, losses, weights, summaries.

Every operator takes a DataFrame with 0/1 vectors `gold` and `pred` in vocabulary
order.  Counts are sums, so Spark combines them in the map tasks and shuffles at
most labels x groups rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.scores import DIGITS, summary, with_scores
from spanforge.functions.vocabulary import VALUES, vocab


def per_label(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each text and label: keys, value, g, p."""
    each = F.posexplode(F.arrays_zip("gold", "pred"))
    exploded = rows.select(*keys, each.alias("k", "gp"))
    return exploded.select(*keys, F.get(vocab(), F.col("k")).alias("value"), F.col("gp.gold").alias("g"), F.col("gp.pred").alias("p"))


def label_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn for each label (and keys).

    Sums over the vectors' places in one aggregation without exploding, then one
    small row per label.
    """
    at = lambda name, k: F.coalesce(F.get(F.col(name), k), F.lit(0))
    sums = []
    for k in range(len(VALUES)):
        g, p = at("gold", F.lit(k)), at("pred", F.lit(k))
        sums += [F.sum(g * p).alias(f"tp{k}"), F.sum((1 - g) * p).alias(f"fp{k}"), F.sum(g * (1 - p)).alias(f"fn{k}")]
    totals = rows.groupBy(*keys).agg(*sums)
    each = F.array(*[F.struct(F.lit(v).alias("value"), *[F.coalesce(F.col(f"{c}{k}"), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]) for k, v in enumerate(VALUES)])
    return totals.select(*keys, F.inline(each))


def scores_per_label(rows: DataFrame, *keys: str) -> DataFrame:
    return with_scores(label_counts(rows, *keys))


def micro_macro(rows: DataFrame, *keys: str) -> DataFrame:
    return summary(label_counts(rows, *keys), *keys)


def wrong_decisions(gold: Column, pred: Column) -> Column:
    return F.aggregate(F.zip_with(gold, pred, lambda g, p: F.abs(g - p)), F.lit(0), lambda a, x: a + x)


def jaccard(gold: Column, pred: Column) -> Column:
    """Shared over all labels of a text; 1 if both sides have none."""
    add = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    both = add(F.zip_with(gold, pred, lambda g, p: g * p))
    any_ = add(F.zip_with(gold, pred, lambda g, p: F.greatest(g, p)))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both.cast("double") / any_.cast("double"))


def losses(rows: DataFrame, *keys: str) -> DataFrame:
    """Hamming loss and mean Jaccard similarity, 0 without rows."""
    n, wrong = F.count(F.lit(1)), F.sum(wrong_decisions(F.col("gold"), F.col("pred")))
    return rows.groupBy(*keys).agg(
        n.alias("examples"),
        F.round(F.coalesce(wrong.cast("double") / (n * len(VALUES)).cast("double"), F.lit(0.0)), DIGITS).alias("hamming_loss"),
        F.round(F.coalesce(F.avg(jaccard(F.col("gold"), F.col("pred"))), F.lit(0.0)), DIGITS).alias("jaccard_samples"),
    )


def pooled_and_grouped(rows: DataFrame, key: str) -> DataFrame:
    """Micro and macro scores of all rows (key null) and of each group, from one grouped count."""
    counts = label_counts(rows, key)
    sets = counts.groupingSets([["value", key], ["value"]], "value", key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping(key).alias("pooled"))
    return summary(sets, "pooled", key).withColumn("pooled", F.col("pooled").cast("int"))


def positive_weights(rows: DataFrame) -> DataFrame:
    """Negatives over positives for each label; 1 for a label that never occurs."""
    counts = label_counts(rows.withColumn("pred", F.col("gold")))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    pos = F.col("tp")
    weight = F.when(pos == 0, F.lit(1.0)).otherwise((F.col("n") - pos).cast("double") / pos.cast("double"))
    return counts.crossJoin(F.broadcast(n)).select("value", pos.alias("positives"), F.round(weight, DIGITS).alias("weight"))


def apply_thresholds(prob: Column, thresholds: Column) -> Column:
    return F.zip_with(prob, thresholds, lambda p, t: (p >= t).cast("int"))


def predicted_at(probabilities: Column, threshold: float = 0.5) -> Column:
    """Labels of a name-to-probability map that reach a threshold, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(probabilities, lambda _, p: p >= threshold)))


def split_summary(rows: DataFrame) -> DataFrame:
    """For each part: examples, those without labels, and counts by collection and by label.

    rows: part, collection, gold.  Columns: part, kind, name, n; label counts have
    a rank by falling count, then name.
    """
    from pyspark.sql import Window

    named = rows.select("part", "collection", F.aggregate("gold", F.lit(0), lambda a, x: a + x).alias("labels"))
    examples = named.groupBy("part").agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("labels") == 0).alias("without_values"))
    sizes = examples.select("part", F.inline(F.array(F.struct(F.lit("examples").alias("kind"), F.lit("").alias("name"), F.col("examples").alias("n")), F.struct(F.lit("without_values").alias("kind"), F.lit("").alias("name"), F.col("without_values").alias("n")))))
    by_collection = named.groupBy("part", "collection").agg(F.count(F.lit(1)).alias("n")).select("part", F.lit("collection").alias("kind"), F.col("collection").alias("name"), "n")
    by_value = label_counts(rows.withColumn("pred", F.col("gold")), "part").filter("tp > 0").select("part", F.lit("value").alias("kind"), F.col("value").alias("name"), F.col("tp").cast("long").alias("n"))
    out = sizes.unionByName(by_collection).unionByName(by_value)
    order = Window.partitionBy("part", "kind").orderBy(F.desc("n"), "name")
    return out.withColumn("rank", F.when(F.col("kind") == "value", F.row_number().over(order)))
