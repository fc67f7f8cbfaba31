"""First-wins merging of equal texts and of equal token sequences.

"First" always means a column that the caller gives, for Spark has no order of its
own.  Groups are reduced by aggregation: a text copied millions of times becomes
one row per distinct label set before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import normalise_space
from spanforge.functions.vocabulary import VALUES
from spanforge.operators.spans import let, spans


def mask_of(values: Column) -> Column:
    """Label names as bits in vocabulary order."""
    bits = [F.when(F.array_contains(values, v), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(VALUES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def names_of(mask: Column) -> Column:
    """Sorted label names of a bit mask."""
    return F.array_sort(F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(v)) for i, v in enumerate(VALUES)])))


def merge_texts(rows: DataFrame, text: str, values: Column, order: str, *keep: str) -> DataFrame:
    """One row for each distinct text after white-space normalisation.

    Columns: key, the first row's `keep` columns and text, values (sorted union),
    merged (further copies) and conflicting (copies whose labels differ from the
    union of all before them).

    The union before a row changes at most once per distinct label set, so the
    rows that agree with it lie, for each label set, in one interval of the
    order; those are counted after joining the interval back by key and set.
    """
    base = rows.select(normalise_space(F.col(text)).alias("key"), mask_of(values).alias("_mask"), F.col(order).alias("_ord"), F.struct(F.col(text).alias("text"), *keep).alias("_kept"))
    sets = base.groupBy("key", "_mask").agg(F.min("_ord").alias("first"))
    grown = Window.partitionBy("key").orderBy("first")
    union = sets.select("key", F.bit_or("_mask").over(grown.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_mask"), F.col("first").alias("lo"), F.lead("first").over(grown).alias("hi"))
    agrees = union.groupBy("key", "_mask").agg(F.min("lo").alias("lo"), F.max(F.struct(F.col("hi").isNull().alias("open"), F.col("hi").alias("hi"))).alias("h"))
    joined = base.join(agrees, ["key", "_mask"], "left")
    same = F.coalesce((F.col("_ord") > F.col("lo")) & (F.col("h.open") | (F.col("_ord") <= F.col("h.hi"))), F.lit(False))
    merged = joined.groupBy("key").agg(F.min_by("_kept", "_ord").alias("kept"), F.bit_or("_mask").alias("mask"), (F.count(F.lit(1)) - 1).alias("merged"), F.count_if(same).alias("same"))
    return merged.select("key", "kept.*", names_of(F.col("mask")).alias("values"), "merged", (F.col("merged") - F.col("same")).alias("conflicting"))


def fold_copies(classes: Column) -> Column:
    """Folds the distinct taggings of a token sequence, in order, into one.

    A span is added where all its words are free; one that meets other tags than
    its own exact pattern is a conflict.  Tags never go back, so a tagging that
    comes again has the same verdict as right after its first time, and copies of
    it only need to be counted.
    """

    def pattern(s: Column) -> Column:
        inner = F.array_repeat(F.concat(F.lit("I-"), s.getField("value")), s.getField("e") - s.getField("s") - 1)
        return F.concat(F.array(F.concat(F.lit("B-"), s.getField("value"))), inner)

    def covered(tags: Column, s: Column) -> Column:
        return F.slice(tags, s.getField("s") + 1, s.getField("e") - s.getField("s"))

    def clashes(tags: Column, found: Column) -> Column:
        return F.exists(found, lambda s: F.exists(covered(tags, s), lambda t: t != "O") & (covered(tags, s) != pattern(s)))

    def add(tags: Column, s: Column) -> Column:
        free = F.forall(covered(tags, s), lambda t: t == "O")
        after = F.slice(tags, s.getField("e") + 1, F.size(tags))
        return F.when(free, F.concat(F.slice(tags, 1, s.getField("s")), pattern(s), after)).otherwise(tags)

    def step(state: Column, c: Column) -> Column:
        before = state.getField("tags")
        first = F.size(before) == 0
        tags = F.when(first, c.getField("tags")).otherwise(F.aggregate(c.getField("spans"), before, add))

        def next_(t: Column) -> Column:
            now = F.when(first, F.lit(0)).otherwise(clashes(before, c.getField("spans")).cast("int"))
            later = clashes(t, c.getField("spans")).cast("int") * (c.getField("n") - 1)
            return F.struct(t.alias("tags"), (state.getField("conflicts") + now + later).cast("long").alias("conflicts"))

        return let(tags, next_)

    none = F.struct(F.array().cast("array<string>").alias("tags"), F.lit(0).cast("long").alias("conflicts"))
    return F.aggregate(classes, none, step)


def merge_sequences(rows: DataFrame, order: str, *keep: str) -> DataFrame:
    """One row for each distinct token sequence of rows (tokens, tags): tokens, tags, merged, conflicting and the first row's `keep`.

    Copies with equal tags are counted first, so a sequence gathers its distinct
    taggings only.
    """
    classes = rows.groupBy("tokens", "tags").agg(F.min(order).alias("ord"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.lit(1).alias("_"), *keep), F.col(order)).alias("kept"))
    with_spans = classes.withColumn("spans", spans(F.col("tags")))
    groups = with_spans.groupBy("tokens").agg(
        F.array_sort(F.collect_list(F.struct("ord", "n", "tags", "spans"))).alias("classes"), F.sum("n").alias("n"), F.min_by("kept", "ord").alias("kept")
    )
    out = groups.withColumn("out", fold_copies(F.col("classes")))
    return out.select("tokens", "out.tags", (F.col("n") - 1).alias("merged"), F.col("out.conflicts").alias("conflicting"), *[F.col(f"kept.{c}").alias(c) for c in keep])
