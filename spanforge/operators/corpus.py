"""Loading a corpus from several sources in one call: order of sources, merging, counters; what models are told about cut texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.dedup import merge_texts

#: What every source has to give; ord is a row's place in its path.
COLUMNS = ["example_id", "text", "values", "document", "collection", "path", "ord", "problem", "unknown"]


def union_in_order(*sources: DataFrame) -> DataFrame:
    """All rows of the sources; order sorts by source as given, path and place, so of equal texts the first source's stays."""
    out = None
    for n, source in enumerate(sources):
        rows = source.select(*COLUMNS, F.struct(F.lit(n).alias("source"), "path", "ord").alias("order"))
        out = rows if out is None else out.unionByName(rows)
    return out


def merged_examples(rows: DataFrame) -> DataFrame:
    """One example for each distinct text of rows without a problem, with merge_texts' counters."""
    return merge_texts(rows.filter("problem is null"), "text", F.col("values"), "order", "example_id", "document", "collection")


def load_report(rows: DataFrame, examples: DataFrame) -> DataFrame:
    """(counter, name, n): files read, rows skipped by reason, merged and conflicting copies, codes that are no label, examples kept.

    Codes of skipped rows are not counted.
    """
    n = F.count(F.lit(1)).alias("n")
    named = lambda df, counter, name: df.groupBy(F.lit(counter).alias("counter"), F.col(name).alias("name")).agg(n)
    used = rows.filter("problem is null")
    parts = [
        named(rows.select("path").distinct(), "files", "path"),
        named(rows.filter("problem is not null"), "skipped", "problem"),
        named(used.select(F.explode("unknown").alias("code")), "unknown_value_codes", "code"),
    ]
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = examples.agg(zero("merged"), zero("conflicting"), n)
    counters = [("merged_duplicates", "merged"), ("conflicting_duplicates", "conflicting"), ("examples", "n")]
    parts.append(sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("counter"), F.lit(None).cast("string").alias("name"), F.col(c).alias("n")) for k, c in counters]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def truncated(rows: DataFrame, n_tokens: Column, limit: int, part: str = "part") -> DataFrame:
    """(part, truncated): texts of each part that a model of so many tokens would not read whole."""
    return rows.groupBy(part).agg(F.count_if(n_tokens > limit).alias("truncated"))


def first_subtokens(words: DataFrame, subtokens: DataFrame, *keys: str) -> DataFrame:
    """Words with the position of their first subtoken; null if it was cut off.  words and subtokens: keys, word; subtokens also position."""
    first = subtokens.groupBy(*keys, "word").agg(F.min("position").alias("position"))
    return words.join(first, [*keys, "word"], "left")
