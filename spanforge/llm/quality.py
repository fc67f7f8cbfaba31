"""Quality rules in a bitmask ledger, in DataFrame expressions only.

``ledger`` measures every text once and stores each rule's failure as one bit,
with the measurements beside it.  A policy is a version name for a mask of
bits; applying one, comparing several and ablating rules read the ledger and
never the texts again.

All measurements of a row are made inside the row, so nothing is shuffled and a
source with a third of all rows costs no more than its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]"
SPACE = r"[\x20\x09-\x0D]+"

#: Rules in order of their bits.  The first two are the base rules.
RULES = ["few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "exclamations"]
#: When each fails, over a mapping of measurement names to columns.
FAILS = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50,
    "symbols": lambda m: m["n_symbols"] * 10 > m["n_words"],
    "duplicate_lines": lambda m: (m["n_lines"] > 3) & (m["n_dup_lines"] * 10 > m["n_lines"] * 3),
    "word_length": lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 15),
    "exclamations": lambda m: m["n_exclamations"] * 4 > m["n_words"],
}
BASE = 0b000011
#: Policies by version: the bits that reject a document.
POLICIES: dict[str, int] = {"base": BASE, "v1": 0b000111, "v2": 0b111111}
CURRENT = "v2"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over a one-element array, which the optimiser can't inline."""
    return F.transform(F.array(value), body).getItem(0)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def covered_by_repeats(words: Column, k: int = 3) -> Column:
    """How many words lie in windows of k words that occur twice or more in the text."""

    def count(windows: Column) -> Column:
        def sorted_count(pairs: Column) -> Column:
            def again(e: Column, i: Column) -> Column:
                near = lambda j: F.coalesce(F.get(pairs, j).getField("w") == e.getField("w"), F.lit(False))
                return F.when(near(i - 1) | near(i + 1), e.getField("i")).otherwise(F.lit(-1))

            starts = F.sort_array(F.filter(F.transform(pairs, again), lambda i: i >= 0))
            return let(starts, lambda p: total(F.transform(p, lambda s, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - s, F.lit(k))).cast("long"))))

        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        # most texts repeat nothing: a hash set tells, and the sort is left out
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(pairs, sorted_count))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(let(windows, count))


def measurements(text: Column) -> Column:
    """A struct of all measurements of a text; null is empty."""
    text = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            covered_by_repeats(words).alias("n_repeat_words"),
        )

    left = lambda keep: F.length(F.regexp_replace(text, keep, "")).cast("long")
    return F.struct(
        let(F.array_remove(F.split(text, SPACE), ""), of_words).alias("words"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), of_lines).alias("lines"),
        left("[^#*$%&|<>]+").alias("n_symbols"),
        left("[^!]+").alias("n_exclamations"),
    )


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, the measurements and fail_bits (bit i: rule i failed) for every row of docs.

    Null and empty texts have no words and so fail the first rule; equal rows get
    equal entries; no rows give no rows; columns of docs other than `keep` and
    text are not read, whatever their names.
    """
    m = docs.select(*keep, measurements(F.col("text")).alias("_m"))
    flat = m.select(
        *keep,
        "_m.words.n_words",
        "_m.words.word_chars",
        "_m.n_symbols",
        "_m.lines.n_dup_lines",
        "_m.words.n_repeat_words",
        "_m.lines.n_lines",
        "_m.n_exclamations",
    )
    return flat.withColumn("fail_bits", bits_of({c: F.col(c) for c in flat.columns}))


def bits_of(measured: dict[str, Column]) -> Column:
    """Bit i: whether rule i fails, over named measurements."""
    mask = F.lit(0)
    for i, rule in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(FAILS[rule](measured), F.lit(1 << i)).otherwise(F.lit(0)))
    return mask.cast("long")


def rejected(mask: int, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask)) != 0


def verdicts(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed, kept and the policy's version to ledger entries."""
    return entries.withColumns({"base_failed": rejected(BASE), "kept": ~rejected(POLICIES[policy] | BASE), "policy": F.lit(policy)})


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it rejects, and rows kept with and without it.

    Rows are first counted by their bits, of which there are two to the number of
    rules at most; the rest is bitwise arithmetic on those counts.
    """
    mask = POLICIES[policy] | BASE
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(RULES) if mask >> i & 1]))
    each = patterns.withColumn("_r", rules).select("bits", "n", "_r.rule", "_r.bit")
    added = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    bits, bit = F.col("bits"), F.col("bit")
    return each.groupBy("rule").agg(
        added(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        added(bits == bit).alias("n_only"),
        added(bits == 0).alias("n_kept"),
        added(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )


def keep_clean(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs, all columns as they are, that a policy keeps: the ledger's bits under the policy's mask.

    Null and empty texts have no words and go; equal rows stay or go alike; texts of
    any length are measured whole; no rows give no rows; columns may have any names.
    The bits are one expression around the measurements, so a filter that the
    optimiser moves or splits still measures each text once.
    """
    mask = POLICIES[policy] | BASE

    def verdict(m: Column) -> Column:
        words, lines = m.getField("words"), m.getField("lines")
        parts = ((words, ["n_words", "word_chars", "n_repeat_words"]), (lines, ["n_lines", "n_dup_lines"]), (m, ["n_symbols", "n_exclamations"]))
        measured = {name: part.getField(name) for part, names in parts for name in names}
        return bits_of(measured).bitwiseAND(F.lit(mask)) == 0

    return docs.filter(let(measurements(F.col("text")), verdict))


def stored(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The ledger, written to a folder once and read again: what policies and ablations work on."""
    ledger(docs, *keep).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
             + (CASE WHEN n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)
             + (CASE WHEN 4 * n_exclamations > n_words THEN 32 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines,
       n_exclamations::BIGINT AS n_exclamations, fail_bits::BIGINT AS fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, 'v2' AS policy
FROM b
"""

#: What a rule of the current policy rejects, alone and with others, from the ledger in SQL.
ABLATION_ORACLE = f"""
WITH entries AS ({ORACLE}), rules(rule, bit) AS (VALUES {', '.join(f"('{name}', {1 << i})" for i, name in enumerate(RULES) if (POLICIES[CURRENT] | BASE) >> i & 1)})
SELECT rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (fail_bits & {POLICIES[CURRENT] | BASE} = bit)::BIGINT AS n_only,
count(*) FILTER (kept)::BIGINT AS n_kept, count(*) FILTER (fail_bits & {POLICIES[CURRENT] | BASE} & ~bit = 0)::BIGINT AS n_kept_without FROM entries, rules GROUP BY rule
"""
