"""Named queries over the Parquet tables, each with SQL for DuckDB where SQL can express it.

Column names, types and rounding are the same on both sides: counts are BIGINT,
ratios DOUBLE rounded to nine digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions.vocabulary import TAGS, VALUES, decode
from spanforge.operators import colors, contract, dedup, evaluation, layout, multilabel, registry, split, statistics, thresholds
from spanforge.operators import spans as S
from spanforge.plans import views as V
from spanforge.session import dealt, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRF = """round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END, 9) AS precision,
round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END, 9) AS recall,
round(f1(tp, fp, fn), 9) AS f1, (tp + fn)::BIGINT AS support"""
RAW = """CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS r"""


def expand(sql: str) -> str:
    """Writes f1(tp, fp, fn) out: 2pr / (p + r) with zeros where nothing is counted."""
    import re

    def f1(m) -> str:
        tp, fp, fn = (x.strip() for x in m[1].split(","))
        p = f"(CASE WHEN {tp} + {fp} = 0 THEN 0.0::DOUBLE ELSE ({tp})::DOUBLE / ({tp} + {fp})::DOUBLE END)"
        r = f"(CASE WHEN {tp} + {fn} = 0 THEN 0.0::DOUBLE ELSE ({tp})::DOUBLE / ({tp} + {fn})::DOUBLE END)"
        return f"(CASE WHEN {p} + {r} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {p} * {r} / ({p} + {r}) END)"

    return re.sub(r"\bf1\(([^()]*)\)", f1, sql)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return add


COUNTS = "sum(g * p)::BIGINT AS tp, sum((1 - g) * p)::BIGINT AS fp, sum(g * (1 - p))::BIGINT AS fn"


def summary_sql(keys: str, source: str) -> str:
    """Micro and macro scores from rows (keys, value, tp, fp, fn)."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    mean = lambda x: f"round(coalesce(avg(CASE WHEN tp + fn > 0 THEN {x} END), 0.0), 9)"
    return f"""SELECT {k}
round(CASE WHEN sum(tp) + sum(fp) = 0 THEN 0.0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fp))::DOUBLE END, 9) AS micro_precision,
round(CASE WHEN sum(tp) + sum(fn) = 0 THEN 0.0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fn))::DOUBLE END, 9) AS micro_recall,
round(CASE WHEN sum(tp) = 0 THEN 0.0 ELSE 2.0::DOUBLE * (sum(tp)::DOUBLE / (sum(tp) + sum(fp))) * (sum(tp)::DOUBLE / (sum(tp) + sum(fn)))
      / (sum(tp)::DOUBLE / (sum(tp) + sum(fp)) + sum(tp)::DOUBLE / (sum(tp) + sum(fn))) END, 9) AS micro_f1,
{mean("p")} AS macro_precision, {mean("r")} AS macro_recall, {mean("f1(tp, fp, fn)")} AS macro_f1,
coalesce(string_agg(CASE WHEN tp + fn = 0 THEN value END, ',' ORDER BY value), '') AS absent
FROM (SELECT *, {RAW} FROM {source}) {g}"""


# --- multi-label texts -------------------------------------------------------------------


@query("t1_scores_per_value", f"WITH {V.UNITS} SELECT value, tp, fp, fn, {PRF} FROM (SELECT value, {COUNTS} FROM units GROUP BY value)")
def t1_scores_per_value(spark: SparkSession, d: str) -> DataFrame:
    return multilabel.scores_per_label(V.units(spark, d))


@query("t1_micro_macro", f"WITH {V.UNITS}, c AS (SELECT value, {COUNTS} FROM units GROUP BY value) {summary_sql('', 'c')}")
def t1_micro_macro(spark, d):
    return multilabel.micro_macro(V.units(spark, d))


LOSS = """, per AS (SELECT doc_id, collection, sum(abs(g - p)) AS wrong, CASE WHEN sum(greatest(g, p)) = 0 THEN 1.0::DOUBLE ELSE sum(g * p)::DOUBLE / sum(greatest(g, p))::DOUBLE END AS j
FROM units GROUP BY doc_id, collection)
SELECT collection, count(*)::BIGINT AS examples, round(sum(wrong)::DOUBLE / (count(*) * 8)::DOUBLE, 9) AS hamming_loss, round(avg(j), 9) AS jaccard_samples FROM per GROUP BY collection"""


@query("t1_hamming_jaccard", f"WITH {V.UNITS}{LOSS}")
def t1_hamming_jaccard(spark, d):
    return multilabel.losses(V.units(spark, d), "collection")


@query(
    "t1_scores_by_collection",
    f"WITH {V.UNITS}, c AS (SELECT grouping(collection)::INTEGER AS pooled, collection, value, {COUNTS} FROM units GROUP BY GROUPING SETS ((value, collection), (value))) {summary_sql('pooled, collection', 'c')}",
)
def t1_scores_by_collection(spark, d):
    return multilabel.pooled_and_grouped(V.units(spark, d), "collection")


@query("t1_positive_weights", f"WITH {V.UNITS} SELECT value, sum(g)::BIGINT AS positives, round(CASE WHEN sum(g) = 0 THEN 1.0 ELSE (count(*) - sum(g))::DOUBLE / sum(g)::DOUBLE END, 9) AS weight FROM units GROUP BY value")
def t1_positive_weights(spark, d):
    return multilabel.positive_weights(V.units(spark, d))


GRID = ", ".join(f"({t}::DOUBLE)" for t in thresholds.GRID)


@query(
    "t1_tune_thresholds",
    f"""WITH {V.UNITS}, grid(t) AS (VALUES {GRID}),
c AS (SELECT value, t, count(*) FILTER (g = 1 AND prob >= t) AS tp, count(*) FILTER (g = 0 AND prob >= t) AS fp, count(*) FILTER (g = 1 AND prob < t) AS fn FROM units, grid GROUP BY value, t),
s AS (SELECT value, t, tp + fn AS pos, f1(tp, fp, fn) AS f FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY f DESC, abs(t - 0.5::DOUBLE), t) AS rn FROM s)
SELECT value, CASE WHEN pos = 0 THEN 0.5::DOUBLE ELSE t END AS threshold, round(CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE f END, 9) AS f1 FROM b WHERE rn = 1""",
)
def t1_tune_thresholds(spark, d):
    return thresholds.tune(V.units(spark, d))


@query("t1_threshold_decode", f"WITH {V.UNITS} SELECT doc_id, coalesce(string_agg(CASE WHEN prob >= 0.5::DOUBLE THEN value END, ',' ORDER BY value), '') AS predicted FROM units GROUP BY doc_id")
def t1_threshold_decode(spark, d):
    names = F.array(*[F.lit(v) for v in VALUES])
    probabilities = F.map_from_arrays(names, F.col("prob"))
    return V.units(spark, d).select("doc_id", F.array_join(multilabel.predicted_at(probabilities), ",").alias("predicted"))


PART = "CASE WHEN (doc_id * 7919 + 13) % 10 < 7 THEN 'train' WHEN (doc_id * 7919 + 13) % 10 = 7 THEN 'validation' ELSE 'test' END"


@query(
    "t1_split_summary",
    f"""WITH {V.UNITS}, u AS (SELECT *, {PART} AS part FROM units), per AS (SELECT part, doc_id, collection, sum(g) AS n FROM u GROUP BY ALL),
rows AS (SELECT part, 'examples' AS kind, '' AS name, count(*) AS n FROM per GROUP BY part
UNION ALL SELECT part, 'without_values', '', count(*) FILTER (n = 0) FROM per GROUP BY part
UNION ALL SELECT part, 'collection', collection, count(*) FROM per GROUP BY part, collection
UNION ALL SELECT part, 'value', value, sum(g) FROM u GROUP BY part, value HAVING sum(g) > 0)
SELECT part, kind, name, n::BIGINT AS n, CASE WHEN kind = 'value' THEN row_number() OVER (PARTITION BY part, kind ORDER BY n DESC, name) END::INTEGER AS rank FROM rows""",
)
def t1_split_summary(spark, d):
    return multilabel.split_summary(V.units(spark, d).withColumn("part", F.expr(PART)))


SPACE = r"[ \t\n\r\f\v]+"


@query("normalize_text", rf"SELECT doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS text, 'unit:' || sha1(trim(regexp_replace(text, '{SPACE}', ' ', 'g')))[1:12] AS example_id FROM documents")
def normalize_text(spark, d):
    text = T.normalise_space(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("text"), T.stable_id("unit", text).alias("example_id"))


@query(
    "dedup_texts",
    f"""WITH {V.UNITS}, per AS (SELECT doc_id, sum(g << k)::INTEGER AS mask FROM units GROUP BY doc_id),
r AS (SELECT per.doc_id, mask, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS key FROM per JOIN documents USING (doc_id)),
o AS (SELECT *, bit_or(mask) OVER (PARTITION BY key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
a AS (SELECT key, min(doc_id) AS doc_id, bit_or(mask) AS mask, (count(*) - 1)::BIGINT AS merged, count(*) FILTER (before <> mask)::BIGINT AS conflicting FROM o GROUP BY key)
SELECT key, doc_id, merged, conflicting, coalesce((SELECT string_agg(value, ',' ORDER BY value) FROM vocab WHERE (a.mask >> vocab.k) & 1 = 1), '') AS labels FROM a""",
)
def dedup_texts(spark, d):
    rows = V.units(spark, d)
    merged = dedup.merge_texts(rows, "text", decode(F.col("gold")), "doc_id", "doc_id")
    return merged.select("key", "doc_id", "merged", "conflicting", F.array_join("values", ",").alias("labels"))


@query("dedup_sequences")
def dedup_sequences(spark, d):
    rows = V.sequences(spark, d).withColumnRenamed("gold", "tags")
    return dedup.merge_sequences(rows, "doc_id", "doc_id").select("doc_id", "tags", "merged", "conflicting")


@query("stratified_split")
def stratified_split(spark, d):
    rows = V.units(spark, d).select("collection", F.col("doc_id").cast("string").alias("example_id"), decode(F.col("gold")).alias("values"))
    return split.iterative_split(rows)


@query(
    "proportional_split",
    f"""WITH {V.UNITS}, l AS (SELECT collection, doc_id::VARCHAR AS example_id, coalesce(string_agg(CASE WHEN g = 1 THEN value END, '|' ORDER BY value), '') AS labels FROM units GROUP BY ALL),
u AS (SELECT *, ('0x' || md5(concat_ws('|', '13', collection, labels, example_id))[1:8])::BIGINT AS drawn FROM l)
SELECT collection, example_id, CASE WHEN drawn < {round(0.7 * (1 << 32))} THEN 'train' WHEN drawn < {round(0.8 * (1 << 32))} THEN 'validation' ELSE 'test' END AS part FROM u""",
)
def proportional_split(spark, d):
    rows = V.units(spark, d).select("collection", F.col("doc_id").cast("string").alias("example_id"), decode(F.col("gold")).alias("values"))
    return split.proportional_split(rows)


# --- token sequences -----------------------------------------------------------------------


def span_sql(side: str) -> str:
    """Spans of a tag column: islands of starts."""
    return f"""{side}_l AS (SELECT doc_id, collection, pos, {side} AS tag, CASE WHEN {side} <> 'O' THEN {side}[3:] END AS v,
    lag({side}) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tags),
{side}_s AS (SELECT *, sum(CASE WHEN tag <> 'O' AND (tag[1] = 'B' OR before IS NULL OR before = 'O' OR before[3:] <> v) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM {side}_l),
{side}_spans AS (SELECT doc_id, any_value(collection) AS collection, v AS value, min(pos)::INTEGER AS s, (max(pos) + 1)::INTEGER AS e FROM {side}_s WHERE tag <> 'O' GROUP BY doc_id, n, v)"""


BOTH = f"{V.TAGS}, {span_sql('gold')}, {span_sql('pred')}"
EXACT = """exact_counts AS (SELECT value, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND g IS NULL) AS fp, count(*) FILTER (g AND p IS NULL) AS fn
FROM (SELECT coalesce(a.value, b.value) AS value, a.g, b.p FROM (SELECT doc_id, s, e, value, true AS g FROM gold_spans) a
FULL JOIN (SELECT doc_id, s, e, value, true AS p FROM pred_spans) b ON a.doc_id = b.doc_id AND a.s = b.s AND a.e = b.e AND a.value = b.value) GROUP BY value)"""
TOKEN = """token_counts AS (SELECT value, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
SELECT gold[3:] AS value, 1 AS tp, 0 AS fp, 0 AS fn FROM tags WHERE gold <> 'O' AND pred <> 'O' AND gold[3:] = pred[3:]
UNION ALL SELECT pred[3:], 0, 1, 0 FROM tags WHERE pred <> 'O' AND (gold = 'O' OR gold[3:] <> pred[3:])
UNION ALL SELECT gold[3:], 0, 0, 1 FROM tags WHERE gold <> 'O' AND (pred = 'O' OR gold[3:] <> pred[3:])) GROUP BY value)"""


@query("bio_spans", f"WITH {V.TAGS}, {span_sql('gold')} SELECT doc_id, s, e, value FROM gold_spans")
def bio_spans(spark, d):
    return S.span_rows(V.sequences(spark, d), "gold", "doc_id")


@query("exact_span_scores", f"WITH {BOTH}, {EXACT} SELECT value, tp, fp, fn, {PRF} FROM exact_counts")
def exact_span_scores(spark, d):
    return S.exact_scores(V.sequences(spark, d))


@query("token_scores", f"WITH {V.TAGS}, {TOKEN} SELECT value, tp, fp, fn, {PRF} FROM token_counts")
def token_scores(spark, d):
    return S.token_scores(V.sequences(spark, d))


# pairs of spans of a label that overlap, folded from the largest overlap on; each pair is taken if both its spans are free
OVERLAP = """pairs AS (SELECT g.doc_id, g.value, least(g.e, p.e) - greatest(g.s, p.s) AS n, g.s AS gs, p.s AS ps FROM gold_spans g JOIN pred_spans p ON g.doc_id = p.doc_id AND g.value = p.value AND g.s < p.e AND p.s < g.e),
listed AS (SELECT doc_id, value, list({'gs': [gs], 'ps': [ps]} ORDER BY n DESC, gs, ps) AS l FROM pairs GROUP BY ALL),
taken AS (SELECT value, sum(len(list_reduce(l, lambda a, b: CASE WHEN list_contains(a.gs, b.gs[1]) OR list_contains(a.ps, b.ps[1]) THEN a ELSE {'gs': a.gs || b.gs, 'ps': a.ps || b.ps} END).gs)) AS tp FROM listed GROUP BY value),
overlap_counts AS (SELECT g.value, coalesce(tp, 0)::BIGINT AS tp, (n_pred - coalesce(tp, 0))::BIGINT AS fp, (n_gold - coalesce(tp, 0))::BIGINT AS fn FROM (SELECT value, count(*) AS n_gold FROM gold_spans GROUP BY value) g JOIN (SELECT value, count(*) AS n_pred FROM pred_spans GROUP BY value) p USING (value) LEFT JOIN taken USING (value))"""


@query("overlap_span_scores", f"WITH {BOTH}, {OVERLAP} SELECT value, tp, fp, fn, {PRF} FROM overlap_counts")
def overlap_span_scores(spark, d):
    return S.overlap_scores(V.sequences(spark, d))


@query("t2_all_scores", f"WITH {BOTH}, {EXACT}, {TOKEN}, {OVERLAP} " + " UNION ALL ".join(f"SELECT *, '{kind}' AS kind FROM ({summary_sql('', source)})" for kind, source in (("exact_span", "exact_counts"), ("overlap_span", "overlap_counts"), ("token", "token_counts"))))
def t2_all_scores(spark, d):
    return S.all_scores(V.sequences(spark, d))


@query(
    "t2_exact_by_collection",
    f"""WITH {BOTH}, c AS (SELECT collection, value, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND g IS NULL) AS fp, count(*) FILTER (g AND p IS NULL) AS fn
FROM (SELECT coalesce(a.collection, b.collection) AS collection, coalesce(a.value, b.value) AS value, a.g, b.p FROM (SELECT *, true AS g FROM gold_spans) a
FULL JOIN (SELECT *, true AS p FROM pred_spans) b ON a.doc_id = b.doc_id AND a.s = b.s AND a.e = b.e AND a.value = b.value) GROUP BY ALL),
names AS (SELECT unnest(['social','economic','political','historic','aesthetical','scientific','age','ecological']) AS value),
full_counts AS (SELECT k.collection, names.value, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn
FROM (SELECT DISTINCT source AS collection FROM documents) k CROSS JOIN names LEFT JOIN c ON c.collection = k.collection AND c.value = names.value)
SELECT collection, value, tp, fp, fn, {PRF} FROM full_counts""",
)
def t2_exact_by_collection(spark, d):
    return S.exact_scores(V.sequences(spark, d), "collection")


TAG_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TAGS))


@query(
    "tag_weights",
    f"""WITH {V.TAGS}, known(position, tag) AS (VALUES {TAG_ROWS}), n AS (SELECT gold AS tag, count(*) AS n FROM tags GROUP BY gold),
j AS (SELECT position, known.tag, coalesce(n, 0)::BIGINT AS n FROM known LEFT JOIN n USING (tag))
SELECT position, tag, n, round(CASE WHEN n = 0 THEN 0.0 ELSE (SELECT sum(n) FROM j)::DOUBLE / ((SELECT count(*) FROM j WHERE n > 0) * n)::DOUBLE END, 9) AS weight FROM j""",
)
def tag_weights(spark, d):
    return S.tag_weights(V.sequences(spark, d))


def best_tags(sequences: DataFrame) -> DataFrame:
    """Each word's likeliest label tag: the predicted one, or for O one by place; with a probability."""
    n = F.lit(len(VALUES))
    values = F.array(*[F.lit(v) for v in VALUES])

    def best(tag, pos):
        other = F.concat(F.lit("B-"), F.get(values, ((F.col("doc_id") + pos) % n).cast("int")))
        p = ((F.col("doc_id") * 37 + pos * 101) % 1000).cast("double") / 1000.0
        return F.struct(F.when(tag == "O", other).otherwise(tag).alias("tag"), p.alias("p"))

    return sequences.withColumn("best", F.transform("pred", best))


@query(
    "tune_span_thresholds",
    f"""WITH {V.TAGS}, {span_sql('gold')}, grid(t) AS (VALUES {GRID}),
b AS (SELECT doc_id, pos, CASE WHEN pred = 'O' THEN 'B-' || (['social','economic','political','historic','aesthetical','scientific','age','ecological'])[(doc_id + pos) % 8 + 1] ELSE pred END AS tag, ((doc_id * 37 + pos * 101) % 1000)::DOUBLE / 1000.0::DOUBLE AS p FROM tags),
r AS (SELECT doc_id, pos, tag, tag[3:] AS value, t FROM b, grid WHERE p >= t),
st AS (SELECT *, CASE WHEN tag[1] = 'B' OR lag(pos) OVER (PARTITION BY doc_id, value, t ORDER BY pos) IS DISTINCT FROM pos - 1 THEN 1 ELSE 0 END AS starts FROM r),
rn AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, value, t ORDER BY pos) AS run FROM st),
ps AS (SELECT doc_id, value, t, min(pos) AS s, max(pos) + 1 AS e FROM rn GROUP BY doc_id, value, t, run),
np AS (SELECT value, t, count(*) AS n, count(*) FILTER (g.s IS NOT NULL) AS tp FROM ps LEFT JOIN (SELECT doc_id, value, s, e FROM gold_spans) g USING (doc_id, value, s, e) GROUP BY value, t),
gp AS (SELECT value, count(*) AS n FROM gold_spans GROUP BY value),
f AS (SELECT v.value, grid.t, coalesce(gp.n, 0) AS pos, coalesce(np.tp, 0) AS tp, coalesce(np.n, 0) - coalesce(np.tp, 0) AS fp, coalesce(gp.n, 0) - coalesce(np.tp, 0) AS fn FROM (SELECT unnest(['social','economic','political','historic','aesthetical','scientific','age','ecological']) AS value) v CROSS JOIN grid LEFT JOIN np ON np.value = v.value AND np.t = grid.t LEFT JOIN gp ON gp.value = v.value),
k AS (SELECT value, t, pos, f1(tp, fp, fn) AS f FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY f DESC, abs(t - 0.5::DOUBLE), t) AS rk FROM k)
SELECT value, CASE WHEN pos = 0 THEN 0.5::DOUBLE ELSE t END AS threshold, round(CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE f END, 9) AS f1 FROM q WHERE rk = 1""",
)
def tune_span_thresholds(spark, d):
    return thresholds.tune_spans(best_tags(V.sequences(spark, d)))


@query(
    "threshold_tags",
    f"""WITH {V.TAGS}, b AS (SELECT doc_id, pos, CASE WHEN pred = 'O' THEN 'B-' || (['social','economic','political','historic','aesthetical','scientific','age','ecological'])[(doc_id + pos) % 8 + 1] ELSE pred END AS tag,
((doc_id * 37 + pos * 101) % 1000)::DOUBLE / 1000.0::DOUBLE AS p FROM tags)
SELECT doc_id, count(*) FILTER (p >= 0.5::DOUBLE)::BIGINT AS tagged, md5(string_agg(CASE WHEN p >= 0.5::DOUBLE THEN tag ELSE 'O' END, ' ' ORDER BY pos)) AS digest FROM b GROUP BY doc_id""",
)
def threshold_tags(spark, d):
    decoded = F.transform("best", lambda b: S.threshold_tag(b, {}))
    rows = best_tags(V.sequences(spark, d)).select("doc_id", decoded.alias("t"))
    return rows.select("doc_id", F.size(F.filter("t", lambda x: x != "O")).cast("long").alias("tagged"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


# --- records, reviews, registry ----------------------------------------------------------------


def records(spark: SparkSession, d: str) -> DataFrame:
    """Sentence records with one entity each; every 23rd kind of record breaks one rule."""
    s = V.sentences(spark, d).withColumn("kind", (F.col("doc_id") + F.col("sentence_id")) % 23)
    kind = lambda n: F.col("kind") == n
    s = s.withColumn("tokens", F.split("sentence", " +"))
    s = s.withColumn("label", F.get(F.array(*[F.lit(v) for v in VALUES]), ((F.col("doc_id") + F.col("sentence_id")) % 8).cast("int")))
    first = F.get("tokens", F.lit(0))
    end = F.when(kind(2), F.length("sentence") + 1).otherwise(F.length(first))
    entity = F.struct(F.lit(0).alias("start"), end.cast("int").alias("end"), F.when(kind(3), F.concat(first, F.lit("~"))).otherwise(first).alias("text"), F.when(kind(1), "beauty").otherwise(F.col("label")).alias("label"), F.when(kind(4), "red").otherwise("#00FF00").alias("color"))
    tag = F.when(kind(5), F.concat(F.lit("X-"), "label")).when(kind(6), F.concat(F.lit("I-"), "label")).otherwise(F.concat(F.lit("B-"), "label"))
    tags = F.transform("tokens", lambda t, i: F.when(i == 0, tag).otherwise("O"))
    return s.select(
        "doc_id",
        "collection",
        F.col("sentence_id").cast("int").alias("sentence_id"),
        F.when(kind(7), 0).otherwise(F.col("page")).cast("int").alias("page"),
        "sentence",
        F.when(kind(8), " ").alias("curated_sentence"),
        "tokens",
        F.when(kind(9), F.array(F.lit("age"), F.lit("social"))).otherwise(F.array("label")).alias("values"),
        F.array(entity).alias("entities"),
        F.when(kind(10), F.concat(tags, F.array(F.lit("O")))).otherwise(tags).alias("ner_tags"),
        F.when(kind(11), "2.0").otherwise("1.0").alias("schema_version"),
        F.when(kind(12), F.struct(F.lit("manual").alias("method"), F.lit("draft").alias("status"), F.lit(None).cast("string").alias("config_id"))).alias("mapping_provenance"),
    )


RECORD_KINDS = f"""{V.SENTENCES}, kinds AS (SELECT *, (doc_id + sentence_id) % 23 AS kind, string_split_regex(sentence, ' +')[1] AS first,
(['social','economic','political','historic','aesthetical','scientific','age','ecological'])[(doc_id + sentence_id) % 8 + 1] AS label FROM sentences)"""


@query(
    "contract_issues",
    f"""WITH {RECORD_KINDS}, codes(kind, position, code, path) AS (VALUES (1, 1, 'unknown_label', '$.entities[0].label'), (1, 9, 'value_entity_mismatch', '$.values'),
(2, 1, 'invalid_entity_offset', '$.entities[0]'), (3, 1, 'entity_text_mismatch', '$.entities[0]'), (4, 1, 'invalid_color', '$.entities[0].color'),
(5, 1, 'invalid_bio_tag', '$.ner_tags[0]'), (5, 9, 'bio_value_mismatch', '$.ner_tags'), (6, 1, 'invalid_bio_transition', '$.ner_tags[0]'), (7, 1, 'invalid_type', '$.page'),
(8, 0, 'invalid_curated_sentence', '$.curated_sentence'), (8, 1, 'invalid_entity_offset', '$.entities[0]'), (9, 8, 'value_entity_mismatch', '$.values'), (9, 9, 'bio_value_mismatch', '$.ner_tags'),
(10, 1, 'token_tag_length_mismatch', '$.ner_tags'), (11, 1, 'unsupported_schema_version', '$.schema_version'), (12, 1, 'invalid_mapping_status', '$.mapping_provenance.status')),
found AS (SELECT doc_id, sentence_id, position, code, path FROM kinds JOIN codes USING (kind)
WHERE NOT (kind = 8 AND code = 'invalid_entity_offset' AND length(first) <= 1)
UNION ALL SELECT doc_id, sentence_id, 1, 'entity_text_mismatch', '$.entities[0]' FROM kinds WHERE kind = 8 AND length(first) <= 1 AND first <> ' ')
SELECT doc_id, sentence_id::INTEGER AS sentence_id, count(*)::BIGINT AS n, string_agg(code || '@' || path, ';' ORDER BY position) AS issues FROM found GROUP BY ALL""",
)
def contract_issues(spark, d):
    found = contract.with_issues(records(spark, d))
    text = F.array_join(F.transform("issues", lambda i: F.concat(i.getField("code"), F.lit("@"), i.getField("path"))), ";")
    return found.select("doc_id", "sentence_id", F.size("issues").cast("long").alias("n"), text.alias("issues"))


@query(
    "bio_transition_issues",
    f"""WITH {V.TAGS}, l AS (SELECT doc_id, pos, pred AS tag, lag(pred) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tags)
SELECT doc_id, count(*)::BIGINT AS n, min(pos)::BIGINT AS first FROM l WHERE tag[1] = 'I' AND (before IS NULL OR before = 'O' OR before[3:] <> tag[3:]) GROUP BY doc_id""",
)
def bio_transition_issues(spark, d):
    found = V.sequences(spark, d).select("doc_id", contract.bio_issues(F.col("pred")).alias("i")).filter(F.size("i") > 0)
    first = F.regexp_extract(F.get("i", F.lit(0)).getField("path"), r"\[(\d+)\]", 1).cast("long")
    return found.select("doc_id", F.size("i").cast("long").alias("n"), first.alias("first"))


@query(
    "quality_flags",
    f"""WITH {V.SENTENCES}, t AS (SELECT collection, sentence, string_split_regex(sentence, ' +') AS ts FROM sentences),
f AS (SELECT collection, unnest([CASE WHEN length(sentence) < 15 THEN 'unusually_short_sentence' END, CASE WHEN length(sentence) > 500 THEN 'unusually_long_sentence' END,
CASE WHEN right(sentence, 1) NOT IN ('.', '!', '?', ';', ':') THEN 'likely_sentence_boundary_error' END,
CASE WHEN len(list_filter(ts, lambda x: regexp_full_match(x, '[\\p{{L}}\\p{{N}}]+'))) <= 1 THEN 'single_word_sentence' END, CASE WHEN len(ts) > 100 THEN 'too_many_tokens' END]) AS code FROM t)
SELECT collection, code, count(*)::BIGINT AS n FROM f WHERE code IS NOT NULL GROUP BY ALL""",
)
def quality_flags(spark, d):
    clean = records(spark, d).withColumn("curated_sentence", F.lit(None).cast("string"))
    flags = clean.select("collection", F.explode(contract.quality_flags()).alias("f")).filter("f.severity = 'warning'")
    return flags.groupBy("collection", F.col("f.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "language_vote",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS w FROM documents),
n AS (SELECT doc_id, count(*) FILTER (w IN ('the','of','and','to','is','in','that','it','was','for')) AS en,
count(*) FILTER (w IN ('de','het','en','van','ik','je','we','ze','op','in')) AS nl FROM w GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(nl, 0) > coalesce(en, 0) THEN 'nl' ELSE 'en' END AS language FROM documents d LEFT JOIN n USING (doc_id)""",
)
def language_vote(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


SYNC = """j AS (SELECT coalesce(a.source_path, b.source_path) AS source_path, a.checksum, b.checksum AS observed_checksum,
CASE WHEN a.checksum IS NULL THEN 'new' WHEN b.checksum IS NULL THEN 'missing' WHEN a.checksum = b.checksum THEN 'current' ELSE 'changed' END AS source_state
FROM registry a FULL JOIN discovered b ON a.source_path = b.source_path)"""


@query("registry_sync", f"WITH {V.REGISTRY}, {SYNC} SELECT source_path, checksum, observed_checksum, source_state FROM j")
def registry_sync(spark, d):
    return registry.synchronise(V.registry(spark, d), V.discovered(spark, d))


@query(
    "registry_summary",
    f"""WITH {V.REGISTRY}, {SYNC} SELECT count(*)::BIGINT AS total, count(*) FILTER (source_state = 'new') AS new, count(*) FILTER (source_state = 'current') AS current,
count(*) FILTER (source_state = 'changed') AS changed, count(*) FILTER (source_state = 'missing') AS missing, count(checksum) AS registered, bool_and(source_state = 'current') AS up_to_date FROM j""",
)
def registry_summary(spark, d):
    return registry.registry_summary(registry.synchronise(V.registry(spark, d), V.discovered(spark, d)))


@query("document_ids", "WITH p AS (SELECT 'sources/' || doc_id || '.pdf' AS source_path FROM documents) SELECT source_path, 'doc-' || sha256(source_path)[1:12] AS document_id FROM p")
def document_ids(spark, d):
    paths = table(spark, d, "documents").select(V.path_of(F.lit("sources/")).alias("source_path"))
    return registry.document_ids(paths)


@query(
    "stale_reviews",
    f"""WITH {V.SENTENCES}, {V.REVIEWS} SELECT r.doc_id, r.sentence_id, r.status, 'stale_sentence_review' AS code
FROM reviews r JOIN sentences s ON r.doc_id = s.doc_id AND r.sentence_id = s.sentence_id WHERE sha256(s.sentence) <> r.record_sha256""",
)
def stale_reviews(spark, d):
    s = V.sentences(spark, d)
    return registry.stale_reviews(s, V.reviews(s))


@query(
    "refreshed_reviews",
    f"""WITH {V.SENTENCES}, {V.REVIEWS}, j AS (SELECT s.doc_id, s.sentence_id, sha256(s.sentence) AS now, r.* EXCLUDE (doc_id, sentence_id) FROM sentences s LEFT JOIN reviews r ON r.doc_id = s.doc_id AND r.sentence_id = s.sentence_id)
SELECT doc_id, sentence_id, CASE WHEN now = record_sha256 THEN status ELSE 'pending' END AS status, now AS record_sha256, CASE WHEN now = record_sha256 THEN decided_at END AS decided_at,
CASE WHEN now = record_sha256 THEN 'kept' WHEN record_sha256 IS NULL THEN 'created' ELSE 'reset' END AS event FROM j""",
)
def refreshed_reviews(spark, d):
    s = V.sentences(spark, d)
    return registry.refreshed_reviews(s, V.reviews(s))


@query(
    "review_counts",
    f"""WITH {V.SENTENCES}, {V.REVIEWS} SELECT doc_id, count(*)::BIGINT AS sentences, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved,
count(*) FILTER (status = 'needs_correction') AS needs_correction, count(*) FILTER (status = 'excluded') AS excluded,
round_even(100 * count(*) FILTER (status IN ('approved', 'excluded'))::DOUBLE / count(*), 0)::INTEGER AS percent, bool_and(status IN ('approved', 'excluded')) AS complete,
max(decided_at) FILTER (status IN ('approved', 'excluded')) AS reviewed_at FROM reviews GROUP BY doc_id""",
)
def review_counts(spark, d):
    return registry.review_counts(V.reviews(V.sentences(spark, d)), "doc_id")


@query(
    "release_rows",
    f"""WITH {V.SENTENCES}, {V.REVIEWS}, k AS (SELECT s.* FROM sentences s JOIN reviews r ON r.doc_id = s.doc_id AND r.sentence_id = s.sentence_id AND r.status = 'approved' AND r.record_sha256 = sha256(s.sentence))
SELECT doc_id, sentence_id, page, sha256(sentence) AS record_sha256, row_number() OVER (PARTITION BY doc_id ORDER BY page, sentence_id)::INTEGER AS position FROM k""",
)
def release_rows(spark, d):
    s = V.sentences(spark, d)
    return registry.release_rows(s, V.reviews(s)).select("doc_id", "sentence_id", "page", "record_sha256", "position")


@query("unmapped_colors", f"WITH {RECORD_KINDS}, c AS (SELECT DISTINCT collection, CASE WHEN kind = 4 THEN 'RED' ELSE '#00FF00' END AS hex FROM kinds) SELECT collection, hex FROM c WHERE hex NOT IN ('#00FF00')")
def unmapped_colors(spark, d):
    palette = spark.createDataFrame([("#00FF00", "social", "approved")], "hex string, label string, status string")
    return colors.unmapped(colors.observed(records(spark, d), "collection"), palette).select("collection", "hex")


@query(
    "color_evidence",
    f"""WITH {RECORD_KINDS}, p AS (SELECT DISTINCT CASE WHEN kind = 4 THEN 'RED' ELSE '#00FF00' END AS hex, collection, sentence FROM kinds),
r AS (SELECT *, row_number() OVER (PARTITION BY collection, hex ORDER BY sentence COLLATE "C") AS n FROM p)
SELECT collection, hex, count(*)::BIGINT AS n, md5(string_agg(sentence, chr(10) ORDER BY sentence COLLATE "C")) AS digest FROM r WHERE n <= 25 GROUP BY ALL""",
)
def color_evidence(spark, d):
    found = colors.evidence(records(spark, d), 25, "collection")
    return found.select("collection", "hex", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "\n").cast("binary")).alias("digest"))


# --- statistics --------------------------------------------------------------------------------

RESAMPLES = statistics.DEFAULT_RESAMPLES
SAMPLES = f"""WITH {V.UNITS}, rules AS (SELECT doc_id, k, value, 'tuned' AS rule, g, p FROM units UNION ALL SELECT doc_id, k, value, 'default', g, CASE WHEN prob >= 0.5::DOUBLE THEN 1 ELSE 0 END FROM units),
b AS (SELECT unnest(range(0, {RESAMPLES + 1})) AS b),
u AS (SELECT doc_id, b, substr(md5(doc_id || ':' || ((b - 1) // 4)), (b - 1) % 4 * 8 + 1, 8) AS u FROM (SELECT doc_id FROM documents), b),
w AS (SELECT doc_id, b, CASE WHEN b = 0 THEN 1 ELSE {' + '.join(f"(u >= '{edge:08x}')::INT" for edge in statistics.POISSON_32)} END AS w FROM u),
c AS (SELECT rule, b, k, value, sum(g * p * w) AS tp, sum((1 - g) * p * w) AS fp, sum(g * (1 - p) * w) AS fn, sum(w) AS n FROM rules JOIN w USING (doc_id) GROUP BY ALL),
m AS (SELECT rule, b, 'micro_f1' AS metric, f1(tp, fp, fn) AS value FROM (SELECT rule, b, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY ALL)
UNION ALL SELECT rule, b, 'hamming_loss', (sum(fp) + sum(fn))::DOUBLE / (max(n) * 8)::DOUBLE FROM c GROUP BY ALL
UNION ALL SELECT rule, b, 'f1/' || value, f1(tp, fp, fn) FROM c)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(V.units(spark, d)).withColumn("default", F.transform("prob", lambda p: (p >= 0.5).cast("int")))
    return statistics.resampled(rows, {"tuned": "pred", "default": "default"}, RESAMPLES, "doc_id").filter("metric <> 'macro_f1'")


@query(
    "bootstrap_ci",
    SAMPLES
    + """SELECT rule, metric, round(max(value) FILTER (b = 0), 9) AS value, round(quantile_cont(value, 0.025) FILTER (b > 0), 9) AS lo, round(quantile_cont(value, 0.975) FILTER (b > 0), 9) AS hi FROM m GROUP BY ALL""",
)
def bootstrap_ci(spark, d):
    return statistics.intervals(samples(spark, d))


@query(
    "paired_holm",
    SAMPLES
    + """, dd AS (SELECT metric, b, max(value) FILTER (rule = 'tuned') - max(value) FILTER (rule = 'default') AS d FROM m GROUP BY ALL),
o AS (SELECT metric, d AS o FROM dd WHERE b = 0),
t AS (SELECT metric, max(o) AS difference, (count(*) FILTER (abs(d - o) >= abs(o)) + 1)::DOUBLE / (count(*) + 1) AS p_value FROM dd JOIN o USING (metric) WHERE b > 0 GROUP BY metric),
f AS (SELECT *, metric LIKE 'f1/%' AS per_value FROM t),
r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY per_value) - row_number() OVER (PARTITION BY per_value ORDER BY p_value, metric) + 1) * p_value) AS s FROM f)
SELECT metric, per_value, round(difference, 9) AS difference, round(p_value, 9) AS p_value, round(max(s) OVER (PARTITION BY per_value ORDER BY p_value, metric), 9) AS p_holm FROM r""",
)
def paired_holm(spark, d):
    tests = statistics.paired(samples(spark, d), "tuned", "default").withColumn("per_value", F.col("metric").startswith("f1/"))
    out = statistics.holm(tests, "per_value")
    return out.select("metric", "per_value", *[F.round(c, 9).alias(c) for c in ("difference", "p_value", "p_holm")])


@query(
    "exact_bootstrap",
    f"""WITH {V.UNITS}, rules AS (SELECT doc_id, k, value, 'tuned' AS rule, g, p FROM units UNION ALL SELECT doc_id, k, value, 'default', g, CASE WHEN prob >= 0.5::DOUBLE THEN 1 ELSE 0 END FROM units),
c AS (SELECT rule, value, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM rules GROUP BY ALL),
m AS (SELECT rule, 'micro_f1' AS metric, f1(tp, fp, fn) AS value FROM (SELECT rule, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY ALL) UNION ALL SELECT rule, 'f1/' || value, f1(tp, fp, fn) FROM c),
n AS (SELECT count(*) AS n FROM documents)
SELECT rule, metric, round(value, 9) AS value, n::BIGINT AS fewest, n::BIGINT AS most, {RESAMPLES}::BIGINT AS resamples FROM m, n""",
)
def exact_bootstrap(spark, d):
    """Observed values, and that every resample has as many draws as there are rows; the tests look at the draws themselves."""
    rows = dealt(V.units(spark, d)).withColumn("default", F.transform("prob", lambda p: (p >= 0.5).cast("int")))
    s = statistics.exactly_resampled(rows, {"tuned": "pred", "default": "default"}, RESAMPLES).filter("metric not in ('macro_f1', 'hamming_loss')")
    drawn = F.when(F.col("resample") > 0, F.col("draws"))
    return s.groupBy("rule", "metric").agg(F.round(F.max(F.when(F.col("resample") == 0, F.col("value"))), 9).alias("value"), F.min(drawn).alias("fewest"), F.max(drawn).alias("most"), F.count_if(F.col("resample") > 0).alias("resamples"))


# --- evaluation --------------------------------------------------------------------------------


def gold_and_observed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First words of sentences as spans by collection; some are observed shifted, with other labels, or not at all."""
    s = V.sentences(spark, d)
    label = F.get(F.array(*[F.lit(v) for v in VALUES]), ((F.col("doc_id") + F.col("sentence_id")) % 8).cast("int"))
    k = (F.col("doc_id") * 3 + F.col("sentence_id")) % 10
    base = s.select(F.col("collection").alias("case_id"), (F.col("doc_id") * 100_000 + F.col("sentence_id")).alias("sentence_id"), "page", F.length(F.substring_index("sentence", " ", 1)).cast("long").alias("e"), F.substring_index("sentence", " ", 1).alias("text"), label.alias("label"), k.alias("k"))
    gold = base.select("case_id", "sentence_id", "page", F.lit(0).cast("long").alias("s"), "e", "text", "label", F.lit(0).alias("ord"), "k")
    seen = gold.withColumn("s", F.when(F.col("k") == 1, 1).otherwise(0).cast("long")).withColumn("label", F.when(F.col("k") == 2, "social").otherwise(F.col("label")))
    seen = seen.withColumn("text", F.when(F.col("k") == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return gold, seen


@query(
    "eval_span_ratios",
    f"""WITH {V.SENTENCES}, base AS (SELECT collection AS case_id, doc_id * 100000 + sentence_id AS sid, split_part(sentence, ' ', 1) AS text,
(['social','economic','political','historic','aesthetical','scientific','age','ecological'])[(doc_id + sentence_id) % 8 + 1] AS label, (doc_id * 3 + sentence_id) % 10 AS k FROM sentences)
SELECT case_id, count(*)::BIGINT AS gold, count(*)::BIGINT AS observed, count(*) FILTER (k > 1)::BIGINT AS matched, count(*) FILTER (k > 1 AND (k <> 2 OR label = 'social'))::BIGINT AS label_matches,
round(count(*) FILTER (k > 1)::DOUBLE / count(*), 9) AS precision, round(count(*) FILTER (k > 1)::DOUBLE / count(*), 9) AS recall,
round(CASE WHEN count(*) FILTER (k > 1) = 0 THEN NULL ELSE count(*) FILTER (k > 1 AND (k <> 2 OR label = 'social'))::DOUBLE / count(*) FILTER (k > 1) END, 9) AS label_accuracy FROM base GROUP BY case_id""",
)
def eval_span_ratios(spark, d):
    return evaluation.span_ratios(*gold_and_observed(spark, d))


@query(
    "eval_coverage",
    """WITH c AS (SELECT source, (['structured_annotations','flattened_highlights','colored_fonts','mixed_conventions','decorations'])[doc_id % 5 + 1] AS category, lang FROM documents),
need AS (SELECT unnest(['structured_annotations','flattened_highlights','colored_fonts','mixed_conventions','decorations','malformed_pdf','unsupported_scan']) AS category)
SELECT k.source, string_agg(need.category, ',' ORDER BY need.category) AS missing FROM (SELECT DISTINCT source FROM documents) k CROSS JOIN need
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source = k.source AND c.category = need.category) GROUP BY k.source""",
)
def eval_coverage(spark, d):
    cases = table(spark, d, "documents").select("source", F.get(F.array(*[F.lit(c) for c in evaluation.CATEGORIES[:5]]), (F.col("doc_id") % 5).cast("int")).alias("category"))
    return evaluation.coverage(cases, "source").select("source", F.array_join("missing", ",").alias("missing"))


# --- layout --------------------------------------------------------------------------------------


def page_words(spark: SparkSession, d: str) -> DataFrame:
    """Tokens set in lines of ten."""
    w = V.sequences(spark, d, by_document=True).select("doc_id", F.posexplode("tokens").alias("word", "text"))
    line = F.floor(F.col("word") / 10)
    return w.select("doc_id", "word", "text", (F.col("word") % 10 * 50).alias("x0"), (line * 15).alias("y0"), (F.col("word") % 10 * 50 + 40).alias("x1"), (line * 15 + 12).alias("y1"))


def page_drawings(words: DataFrame) -> DataFrame:
    """A coloured bar near every seventh word, moved right and down by document."""
    right, down = F.col("doc_id") % 30, F.col("doc_id") % 11
    color = F.get(F.array(*[F.lit(c) for c in ("#FF0000", "#00FF00", "#0000FF")]), ((F.col("doc_id") + F.col("word")) % 3).cast("int"))
    bar = words.filter("word % 7 = 0")
    return bar.select("doc_id", F.col("word").alias("drawing"), color.alias("color"), (F.col("x0") + right).alias("x0"), (F.col("y0") + down).alias("y0"), (F.col("x0") + right + 60).alias("x1"), (F.col("y0") + down + 12).alias("y1"))


WORDS = f"""{V.TAGS}, words AS (SELECT doc_id, pos AS word, token AS text, pos % 10 * 50 AS x0, pos // 10 * 15 AS y0, pos % 10 * 50 + 40 AS x1, pos // 10 * 15 + 12 AS y1 FROM tok),
drawings AS (SELECT doc_id, word AS drawing, (['#FF0000', '#00FF00', '#0000FF'])[(doc_id + word) % 3 + 1] AS color, x0 + doc_id % 30 AS dx0, y0 + doc_id % 11 AS dy0, x0 + doc_id % 30 + 60 AS dx1, y0 + doc_id % 11 + 12 AS dy1 FROM words WHERE word % 7 = 0),
hit AS (SELECT w.doc_id, w.word, d.drawing, d.color, (least(x1, dx1) - greatest(x0, dx0)) * (least(y1, dy1) - greatest(y0, dy0)) AS shared FROM words w JOIN drawings d
ON w.doc_id = d.doc_id AND dx0 < x1 AND dx1 > x0 AND dy0 < y1 AND dy1 > y0 AND dy0 // 15 BETWEEN y0 // 15 - 1 AND y0 // 15 + 1),
best AS (SELECT doc_id, word, arg_max(color, shared * 1000000 - drawing) AS color FROM hit WHERE shared * 10 >= 480 GROUP BY ALL)"""


@query("highlight_words", f"WITH {WORDS} SELECT doc_id, word::INTEGER AS word, color FROM best")
def highlight_words(spark, d):
    words = page_words(spark, d)
    return layout.highlight_words(words, page_drawings(words), 0.1, "doc_id")


@query(
    "entity_islands",
    f"""WITH {WORDS}, c AS (SELECT w.doc_id, w.word, w.text, b.color, lag(b.color) OVER o AS before, row_number() OVER o AS rn FROM words w LEFT JOIN best b ON w.doc_id = b.doc_id AND w.word = b.word WINDOW o AS (PARTITION BY w.doc_id ORDER BY w.word)),
i AS (SELECT *, sum(CASE WHEN rn = 1 OR before IS DISTINCT FROM color THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY word) AS island FROM c)
SELECT doc_id, color, min(word)::INTEGER AS first, max(word)::INTEGER AS last, trim(rtrim(string_agg(text, ' ' ORDER BY word), ' ,.:;')) AS text FROM i WHERE color IS NOT NULL GROUP BY doc_id, island, color""",
)
def entity_islands(spark, d):
    words = page_words(spark, d)
    colored = words.join(layout.highlight_words(words, page_drawings(words), 0.1, "doc_id"), ["doc_id", "word"], "left")
    return layout.islands(colored, "doc_id")


PLACES = """places AS (SELECT doc_id, pos, token, (sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(token) - 1)::BIGINT AS ts FROM tok)"""


def token_places(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with their characters in the text of tokens joined by spaces."""
    from pyspark.sql import Window

    t = V.sequences(spark, d, by_document=True).select("doc_id", F.posexplode("tokens").alias("token", "text"))
    end = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("token"))
    return t.withColumn("ts", end - F.length("text") - 1).withColumn("te", end - 1)


@query(
    "run_dominance",
    f"""WITH {V.TAGS}, {PLACES}, ends AS (SELECT doc_id, max(ts + length(token)) AS n FROM places GROUP BY doc_id),
runs AS (SELECT doc_id, i, i * 9 AS rs, least(i * 9 + 9, n) AS re, (['red', NULL, 'blue', 'red'])[(i + doc_id) % 4 + 1] AS color FROM (SELECT doc_id, n, unnest(range(0, (n + 8) // 9)) AS i FROM ends)),
o AS (SELECT p.doc_id, p.pos, r.color, sum(least(ts + length(token), re) - greatest(ts, rs)) AS n FROM places p JOIN runs r ON p.doc_id = r.doc_id AND r.i BETWEEN ts // 9 AND (ts + length(token) - 1) // 9 AND length(token) > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, color IS NOT NULL, color) AS rn FROM o)
SELECT doc_id, pos::INTEGER AS token, color FROM k WHERE rn = 1""",
)
def run_dominance(spark, d):
    t = token_places(spark, d)
    ends = t.groupBy("doc_id").agg(F.max("te").alias("n"))
    i = ends.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + 8) / 9) - 1)).alias("i")).filter("n > 0")
    color = F.get(F.array(F.lit("red"), F.lit(None), F.lit("blue"), F.lit("red")), ((F.col("i") + F.col("doc_id")) % 4).cast("int"))
    runs = i.select("doc_id", color.alias("color"), (F.col("i") * 9).alias("rs"), F.least(F.col("i") * 9 + 9, F.col("n")).alias("re"))
    return layout.dominant_color(t, runs, "doc_id")


@query(
    "bio_projection",
    f"""WITH {V.TAGS}, {PLACES}, ents AS (SELECT doc_id, pos AS entity, (['social','age'])[pos % 2 + 1] AS label, ts AS es, ts + 25 AS ee FROM places WHERE pos % 6 = 0),
h AS (SELECT p.doc_id, p.pos, e.entity, e.label, min(p.pos) OVER (PARTITION BY p.doc_id, e.entity) AS first FROM (SELECT *, (pos // 6 - j) * 6 AS near FROM places, range(0, 6) r(j)) p JOIN ents e ON p.doc_id = e.doc_id AND e.entity = p.near AND p.ts >= es AND p.ts + length(p.token) <= ee),
w AS (SELECT doc_id, pos, arg_max((CASE WHEN pos = first THEN 'B-' ELSE 'I-' END) || label, entity) AS tag FROM h GROUP BY ALL)
SELECT p.doc_id, p.pos::INTEGER AS token, coalesce(w.tag, 'O') AS tag FROM places p LEFT JOIN w ON p.doc_id = w.doc_id AND p.pos = w.pos""",
)
def bio_projection(spark, d):
    t = token_places(spark, d)
    label = F.when(F.col("token") % 2 == 0, "social").otherwise("age")
    entities = t.filter("token % 6 = 0").select("doc_id", F.col("token").alias("entity"), label.alias("label"), F.col("ts").alias("es"), (F.col("ts") + 25).alias("ee"))
    return layout.project_bio(t, entities, "doc_id")


# --- audit events ----------------------------------------------------------------------------------


@query("audit_window_counts", "SELECT event_type AS event, date_trunc('day', ts) AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def audit_window_counts(spark, d):
    from spanforge.streaming.audit import window_counts

    return window_counts(table(spark, d, "events"), "1 day").select("event", F.col("start").alias("day"), "n")


@query("latest_decision", "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS event, max(ts) AS occurred_at FROM events GROUP BY user_id")
def latest_decision(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("event"), F.col("ts").alias("occurred_at"), "event_id")
    return registry.latest_decisions(e, "user_id", "occurred_at", "event_id").select("user_id", "event", "occurred_at")


# the rest of the queries register themselves
from spanforge.plans import assembly, expressions, registries, reviews, rules, structures, texts, workflows  # noqa: E402, F401
