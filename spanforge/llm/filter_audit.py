"""What filters take from each other: counts for every order of application.

One scan measures each text: a bit for each filter that looks at a text alone, its
length, and hashes of blocks that grow sixteenfold.  Equal texts, the fifth filter,
are found by refining a partition: texts of one length, of these the ones with an
equal first block, and so on; whatever is alone in its part is dropped before the
next step.  Of what is left whole texts are compared, so a hash that collides costs
a comparison and changes nothing.  Every document then is a mask of five bits, and
all orders follow from the number of documents of each mask.

No step gathers a group: copies are counted in the map tasks, and members of large
parts are looked up in tables with one row a part.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import Scratch
from spanforge.llm.quality import SPACE, let

#: Filters in order of their bits; the last one compares documents with each other.
LETTERS = "ABCDE"
COPY = 1 << (len(LETTERS) - 1)
#: Code points where blocks begin: the first has 256, each other sixteen times the one before it.
BLOCKS = [(0, 256)]
while BLOCKS[-1][0] + BLOCKS[-1][1] < 1 << 31:
    BLOCKS.append((sum(BLOCKS[-1]), min(BLOCKS[-1][1] * 16, (1 << 31) - 1)))
#: So many parts are broadcast when texts are looked up in them; more are joined by a shuffle.
BROADCAST = 500_000


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at a text alone: few words, repeated words, capitals, symbols."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 200, 1).otherwise(0) + F.when(F.size(F.array_distinct(words)) * F.lit(100) < n * 50, 2).otherwise(0)

    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return (
        let(F.array_remove(F.split(text, SPACE), ""), of_words)
        + F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * 3, 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    )


def block_hash(text: Column, block: int) -> Column:
    """The hash of a block; null where the text ends before it."""
    start, size = BLOCKS[block]
    return F.when(F.length(text) > start, F.xxhash64(F.substring(text, start + 1, size)))


def refined(part: Column, block: Column) -> Column:
    """The part of a text after one more block; a text that has ended stays where it is."""
    return F.when(block.isNull(), part).otherwise(F.xxhash64(part, block))


def part_of(text: Column) -> Column:
    """The part of a text after its last block."""
    part = F.xxhash64(F.length(text))
    for k in range(len(BLOCKS)):
        part = refined(part, block_hash(text, k))
    return part


def repeated_parts(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The rows whose part has other rows, after all refinements: columns of rows, and part.

    rows: n_chars and the block hashes b0, b1, ...  A step counts the rows of each part
    in the map tasks first and keeps the parts with two or more.
    """
    longest = rows.agg(F.max("n_chars")).collect()[0][0] or 0
    rows = rows.withColumn("part", F.xxhash64(F.col("n_chars").cast("int")))
    steps = [None, *(k for k, (start, _) in enumerate(BLOCKS) if start < longest)]
    for step in steps:
        if step is not None:
            rows = rows.withColumn("part", refined(F.col("part"), F.col(f"b{step}")))
        several = scratch.keep(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("part"), "parts")
        former, rows = rows, scratch.keep(rows.join(several, "part", "left_semi"), "rows")
        scratch.discard(several, *([former] if step is not None else []))
    return rows.drop(*[f"b{k}" for k in range(len(BLOCKS))])


def looked_up(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """The texts of some parts; a broadcast up to a number of parts, a shuffle of the texts beyond."""
    return texts.join(F.broadcast(parts) if parts.count() <= BROADCAST else parts, "part", "left_semi")


def copies(scratch: Scratch, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (doc_id, mask and what else they hold) whose text a smaller doc_id has too.

    docs: doc_id and text; rows: what repeated_parts() left of them.
    """
    parts = scratch.keep(rows.select("part").distinct(), "found")
    texts = looked_up(docs.select("doc_id", "text", part_of(F.col("text")).alias("part")), parts)
    whole = texts.groupBy("part", "text").agg(F.min("doc_id").alias("least"))
    firsts = scratch.keep(whole.groupBy("part").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n_texts")), "firsts")
    found = rows.join(firsts.filter("n_texts = 1"), "part").filter(F.col("doc_id") > F.col("least")).drop("least", "n_texts", "part")
    mixed = scratch.keep(firsts.filter("n_texts > 1").select("part"), "mixed")
    if mixed.isEmpty():
        return found
    # different texts with equal hashes: their rows are looked up by the whole text
    odd = looked_up(docs.withColumn("part", part_of(F.col("text"))), mixed)
    least = scratch.keep(odd.groupBy("part", "text").agg(F.min("doc_id").alias("least")), "texts")
    late = odd.join(least, ["part", "text"]).filter(F.col("doc_id") > F.col("least"))
    return found.unionByName(late.select(*found.columns))


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents that fail exactly the filters of a mask, and the labelled ones of them."""
    scratch = Scratch(docs.sparkSession, "filter-audit")
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = scratch.keep(labels.groupBy("doc_id").agg(flag("quality"), flag("toxic")), "labels")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("lang"), text.alias("text"))
    text = F.col("text")
    blocks = [block_hash(text, k).alias(f"b{k}") for k in range(len(BLOCKS))]
    measured = scratch.keep(plain.select("doc_id", "lang", own_failures(text).alias("mask"), F.length(text).alias("n_chars"), *blocks), "measured")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias({"quality": "good"}.get(c, c))
    own = measured.join(known, "doc_id", "left").select("lang", "mask", zero("quality"), zero("toxic"))
    kinds = ["lang", "mask", "good", "toxic"]
    every = own.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))
    # copies: their number moves from a mask without the last bit to the one with it
    with_mask = plain.select("doc_id", "lang", own_failures(text).alias("mask"), "text")
    late = copies(scratch, with_mask, repeated_parts(scratch, measured).select("doc_id", "lang", "mask", "part"))
    moved = late.join(known, "doc_id", "left").select("lang", "mask", zero("quality"), zero("toxic")).groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))
    moves = F.explode(F.array(F.struct(F.col("mask"), (-F.col("n")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), F.col("n"))))
    counts = every.unionByName(moved.withColumn("m", moves).select("lang", "m.mask", "good", "toxic", "m.n"))
    added = lambda c: F.sum(F.col("n") * F.col(c)).alias(c)
    return counts.groupBy("lang", "mask").agg(F.sum("n").alias("_n"), added("good"), added("toxic")).withColumnRenamed("_n", "n").withColumnRenamed("lang", "part")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    docs: doc_id, text and the column that splits them into parts; labels: doc_id,
    quality, toxic.  Null texts are empty, and so copies of each other; a null part is
    the empty string; texts of any length are read and compared whole; repeated rows
    count each, and one of equal ids is no copy of the other; a null doc_id is neither
    smaller nor greater than another, so its row is no copy and makes none.  A document
    with several labels has each that one of them says; labels without a document and
    null labels count nothing.  An empty table gives no rows.  Other columns are not
    read, whatever their names.
    """
    each = masks(docs, labels, part)
    rows = each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 masks at most
    orders = F.explode(F.split(F.lit(",".join(map("".join, itertools.permutations(LETTERS)))), ","))
    steps = rows.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    steps = steps.withColumn("letters", F.split("filter_order", "")).withColumn("bit", bit_of(F.get("letters", F.col("step") - 1)))
    before = F.aggregate(F.filter("letters", lambda _, i: i < F.col("step") - 1), F.lit(0), lambda a, x: a + bit_of(x))
    steps = steps.withColumn("before", before)
    fails = lambda m, mask: m["mask"].bitwiseAND(mask) != 0
    mine, former = F.col("bit"), F.col("before")

    def total(when, value=lambda m: m["n"]) -> Column:
        return F.aggregate(F.filter("masks", when), F.lit(0).cast("long"), lambda a, m: a + value(m))

    removed = lambda m: fails(m, mine) & ~fails(m, former)
    firsts = sum(1 for _ in itertools.permutations(LETTERS))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~fails(m, mine) & ~fails(m, former)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m, mine) & fails(m, former)).alias("redundant"),
        total(lambda m: m["mask"] == mine).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in an equal share of the orders
        total(lambda m: fails(m, mine), lambda m: m["n"] * (F.lit(firsts) / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def bit_of(letter: Column) -> Column:
    return F.get(F.array(*[F.lit(1 << i) for i in range(len(LETTERS))]), F.instr(F.lit(LETTERS), letter) - 1)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, coalesce(sum(q), 0) AS good, coalesce(sum(x), 0) AS tox FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
s(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.x || q.x || r.x || u.x || v.x AS filter_order, [p.b, q.b, r.b, u.b, v.b] AS bits FROM s p, s q, s r, s u, s v
      WHERE p.b + q.b + r.b + u.b + v.b = 31 AND (p.b | q.b | r.b | u.b | v.b) = 31),
k AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::BIGINT AS earlier FROM o, (SELECT unnest(range(1, 6)) AS i)),
a AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (m & bit = 0 AND m & earlier = 0), 0) AS kept,
             coalesce(sum(n) FILTER (m & bit <> 0 AND m & earlier = 0), 0) AS removed,
             coalesce(sum(n) FILTER (m & bit <> 0 AND m & earlier <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (m = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (m & bit <> 0 AND m & earlier = 0), 0) AS good_lost,
             coalesce(sum(tox) FILTER (m & bit <> 0 AND m & earlier = 0), 0) AS toxic_lost FROM c, k GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM a
"""
