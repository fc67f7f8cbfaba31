"""Resampling statistics: bootstrap intervals, paired tests, Holm's correction.

Metrics are functions of counts that add up over rows, so a resample is a weight
for each row and a weighted sum.  Rows meet their weights in the map tasks, where
sums per resample are combined; labels x resamples rows are shuffled per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.scores import f1
from spanforge.functions.vocabulary import VALUES
from spanforge.operators.draws import resampled_sums

#: Upper edges, in 2^-32, of the numbers of draws 0, 1, 2, ... of a row in a resample of equal size: cumulative Poisson(1) chances.
POISSON_32 = [round(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) * 2**32) for i in range(11)]
DEFAULT_RESAMPLES = 1000


def digest(row: Column, group: Column) -> Column:
    """32 hexadecimal digits, eight for each of four resamples."""
    return F.md5(F.concat_ws(":", row.cast("string"), group.cast("string")).cast("binary"))


def drawn(digits: Column) -> Column:
    """A Poisson number from eight hexadecimal digits; digits of one length compare as their numbers do."""
    return sum((digits >= F.lit(f"{edge:08x}")).cast("int") for edge in POISSON_32)


def digest_weight(row: Column, resample: Column) -> Column:
    """How often a row is drawn in a resample (from 1): a Poisson number, independent for each pair."""
    at = (resample - 1).cast("long")
    return drawn(F.substring(digest(row, F.floor(at / 4)), F.pmod(at, F.lit(4)).cast("int") * 8 + 1, F.lit(8)))


def count_columns(gold: Column, pred: Column) -> list[Column]:
    """tp, fp, fn of each label, wrong decisions and rows, as columns of a row."""
    out = []
    for k in range(len(VALUES)):
        g, p = F.get(gold, F.lit(k)), F.get(pred, F.lit(k))
        out += [(g * p).alias(f"tp{k}"), ((1 - g) * p).alias(f"fp{k}"), (g * (1 - p)).alias(f"fn{k}")]
    return out


def metric_columns() -> list[Column]:
    """(metric, value) pairs from summed count columns and n."""
    t = lambda c: sum(F.col(f"{c}{k}") for k in range(len(VALUES)))
    micro = f1(t("tp"), t("fp"), t("fn"))
    each = [f1(F.col(f"tp{k}"), F.col(f"fp{k}"), F.col(f"fn{k}")) for k in range(len(VALUES))]
    there = [(F.col(f"tp{k}") + F.col(f"fn{k}") > 0).cast("int") for k in range(len(VALUES))]
    classes = sum(there)
    macro = F.when(classes == 0, F.lit(0.0)).otherwise(sum(F.when(w == 1, e).otherwise(F.lit(0.0)) for w, e in zip(there, each, strict=True)) / classes)
    wrong = (t("fp") + t("fn")).cast("double") / (F.col("n") * len(VALUES)).cast("double")
    named = [("micro_f1", micro), ("macro_f1", macro), ("hamming_loss", F.when(F.col("n") == 0, 0.0).otherwise(wrong)), *((f"f1/{v}", e) for v, e in zip(VALUES, each, strict=True))]
    return [F.struct(F.lit(name).alias("metric"), c.alias("value")) for name, c in named]


def resampled(rows: DataFrame, rules: dict[str, str], resamples: int = DEFAULT_RESAMPLES, row: str = "doc_id", weights: DataFrame | None = None) -> DataFrame:
    """(rule, resample, metric, value); resample 0 is the rows as they are.  All rules share the weights."""
    of_rule = F.array(*[F.struct(F.lit(r).alias("rule"), *count_columns(F.col("gold"), F.col(c))) for r, c in rules.items()])
    counts = rows.select(F.col(row).alias("row"), of_rule.alias("rules"))
    names = [f"{c}{k}" for k in range(len(VALUES)) for c in ("tp", "fp", "fn")]
    whole = counts.select("rules", F.lit(0).alias("resample"), F.lit(1).alias("w"))
    if weights is None:
        # step by step, so that a digest is made once for four resamples and weights once for all rules
        groups = counts.select("row", "rules", F.explode(F.sequence(F.lit(0), F.lit((resamples + 3) // 4 - 1))).alias("g"))
        digests = groups.select("rules", "g", digest(F.col("row"), F.col("g")).alias("digest"))
        parts = digests.select("rules", "g", F.posexplode(F.array(*[F.substring("digest", 8 * j + 1, 8) for j in range(4)])).alias("j", "digits"))
        some = parts.select("rules", (F.col("g") * 4 + F.col("j") + 1).alias("resample"), drawn(F.col("digits")).alias("w")).filter(F.col("resample") <= resamples)
    else:
        some = counts.join(weights.withColumn("resample", F.col("resample") + 1), "row").select("rules", "resample", "w")
    # rows that are not drawn add nothing
    each = whole.unionByName(some.filter("w > 0")).select("resample", "w", F.explode("rules").alias("x")).select("resample", "w", "x.*")
    sums = each.groupBy("rule", "resample").agg(F.sum("w").alias("n"), *[F.sum(F.col(c) * F.col("w")).alias(c) for c in names])
    return sums.select("rule", "resample", F.inline(F.array(*metric_columns())))


def exactly_resampled(rows: DataFrame, rules: dict[str, str], resamples: int = DEFAULT_RESAMPLES, row: str = "doc_id", seed: int = 13) -> DataFrame:
    """(rule, resample, metric, value, draws) as resampled(), but with exactly as many draws as rows in each resample."""
    names = [f"{c}{k}" for k in range(len(VALUES)) for c in ("tp", "fp", "fn")]
    flat = rows.select(row, *[x.alias(f"{i}_{n}") for i, c in enumerate(rules.values()) for x, n in zip(count_columns(F.col("gold"), F.col(c)), names, strict=True)])
    sums = resampled_sums(flat, row, flat.columns[1:], resamples, seed)
    each = F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), *[F.col(f"{i}_{n}").alias(n) for n in names]) for i, r in enumerate(rules)]))
    return sums.select("resample", "n", each).select("rule", "resample", F.inline(F.array(*metric_columns())), F.col("n").alias("draws"))


def intervals(samples: DataFrame, digits: int = 9) -> DataFrame:
    """(rule, metric, value, lo, hi): observed value and the 2.5 and 97.5 percentiles, by linear interpolation."""
    drawn = F.when(F.col("resample") > 0, F.col("value"))
    out = samples.groupBy("rule", "metric").agg(F.max(F.when(F.col("resample") == 0, F.col("value"))).alias("value"), F.percentile(drawn, 0.025).alias("lo"), F.percentile(drawn, 0.975).alias("hi"))
    return out.select("rule", "metric", *[F.round(c, digits).alias(c) for c in ("value", "lo", "hi")])


def paired(samples: DataFrame, first: str, second: str) -> DataFrame:
    """(metric, difference, p_value): share of resamples as far from the observed difference as that is from 0, plus one."""
    side = lambda r: F.max(F.when(F.col("rule") == r, F.col("value")))
    deltas = samples.groupBy("metric", "resample").agg((side(first) - side(second)).alias("d"))
    observed = F.max(F.when(F.col("resample") == 0, F.col("d"))).over(Window.partitionBy("metric"))
    marked = deltas.withColumn("o", observed).filter("resample > 0")
    extreme = F.count_if(F.abs(F.col("d") - F.col("o")) >= F.abs("o"))
    return marked.groupBy("metric").agg(F.max("o").alias("difference"), ((extreme + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def holm(tests: DataFrame, *family: str) -> DataFrame:
    """Adds p_holm: p-values times the number of those not below, running maximum, at most 1; ties by metric."""
    by = Window.partitionBy(*family).orderBy("p_value", "metric")
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(by) + 1) * F.col("p_value"))
    return tests.withColumn("_s", scaled).withColumn("p_holm", F.max("_s").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")
