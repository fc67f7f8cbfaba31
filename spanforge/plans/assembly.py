"""Queries for loading corpora, review queues, releases and recognised pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions.vocabulary import VALUES
from spanforge.operators import corpus, layout, registry, review_queue
from spanforge.plans import views as V
from spanforge.plans.columns import BARS, recognised_rows
from spanforge.plans.expressions import documents, pick, row_id, sql_pick
from spanforge.plans.queries import WORDS, page_words, query

# --- corpora ------------------------------------------------------------------------------------


def three_sources(spark, d):
    """Documents dealt to three sources, with few different texts; some rows are skipped, some have unknown codes."""
    i = row_id()
    rows = documents(spark, d).select(
        i.cast("string").alias("example_id"),
        F.concat(F.lit("Text  "), F.col("n_chars") % 200).alias("text"),
        F.array(pick(VALUES, i)).alias("values"),
        F.col("lang").alias("document"),
        F.col("source").alias("collection"),
        F.concat(F.lit("file"), i % 4).alias("path"),
        i.alias("ord"),
        F.when(i % 10 == 0, "empty_quotation").alias("problem"),
        F.when(i % 7 == 0, F.array(F.concat(F.lit("code"), i % 2))).alias("unknown"),
        (i % 3).alias("source"),
    )
    return corpus.union_in_order(*[rows.filter(F.col("source") == n) for n in range(3)])


@query(
    "corpus_load",
    """WITH a AS (SELECT doc_id % 3 AS src, 'file' || (doc_id % 4) AS path, doc_id, n_chars % 200 AS key, doc_id % 8 AS l, doc_id % 10 = 0 AS bad, CASE WHEN doc_id % 7 = 0 THEN 'code' || (doc_id % 2) END AS code FROM documents),
r AS (SELECT key, l, row_number() OVER w AS n, min(l) OVER before AS lo, max(l) OVER before AS hi FROM a WHERE NOT bad WINDOW w AS (PARTITION BY key ORDER BY src, path, doc_id), before AS (PARTITION BY key ORDER BY src, path, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 'files' AS counter, path AS name, 1::BIGINT AS n FROM (SELECT DISTINCT path FROM a) UNION ALL SELECT 'skipped', 'empty_quotation', count(*) FROM a WHERE bad HAVING count(*) > 0
UNION ALL SELECT 'unknown_value_codes', code, count(*) FROM a WHERE NOT bad AND code IS NOT NULL GROUP BY code
UNION ALL SELECT 'merged_duplicates', NULL, count(*) FILTER (n > 1) FROM r UNION ALL SELECT 'conflicting_duplicates', NULL, count(*) FILTER (n > 1 AND (lo <> l OR hi <> l)) FROM r
UNION ALL SELECT 'examples', NULL, count(*) FILTER (n = 1) FROM r""",
)
def corpus_load(spark, d):
    rows = three_sources(spark, d)
    return corpus.load_report(rows, corpus.merged_examples(rows))


@query("truncated_texts", "SELECT source AS part, count(*) FILTER (n_chars // 4 + 2 > 128) AS truncated FROM documents GROUP BY source")
def truncated_texts(spark, d):
    return corpus.truncated(documents(spark, d).withColumnRenamed("source", "part"), F.floor(F.col("n_chars") / 4) + 2, 128)


@query(
    "first_subtokens",
    f"""WITH {V.TAGS}, p AS (SELECT doc_id, pos, greatest(1, (length(token) + 3) // 4) AS k FROM tok),
s AS (SELECT doc_id, pos, 1 + sum(k) OVER (PARTITION BY doc_id ORDER BY pos) - k AS position FROM p)
SELECT doc_id, pos::INTEGER AS word, CASE WHEN position < 256 THEN position::BIGINT END AS position FROM s""",
)
def first_subtokens(spark, d):
    """Words cut into pieces of four characters, of which the first 255 are read."""
    words = V.sequences(spark, d).select("doc_id", F.posexplode("tokens").alias("word", "token"))
    k = F.greatest(F.lit(1), F.floor((F.length("token") + 3) / 4))
    start = F.sum(k).over(Window.partitionBy("doc_id").orderBy("word")) - k + 1
    pieces = words.withColumn("at", start).select("doc_id", "word", F.explode(F.sequence("at", F.col("at") + k - 1)).alias("position"))
    return corpus.first_subtokens(words.select("doc_id", "word"), pieces.filter("position < 256"), "doc_id")


# --- review queue ---------------------------------------------------------------------------------


@query(
    "review_queue",
    f"""WITH {V.SENTENCES}, {V.REVIEWS}, f AS (SELECT doc_id, sentence_id, (length(sentence) > 80 AND sentence_id % 3 <> 0) OR regexp_matches(sentence, '[0-9]') AS flagged FROM sentences),
c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'needs_correction') AS needs_correction,
count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (flagged) AS flagged FROM reviews JOIN f USING (doc_id, sentence_id) GROUP BY doc_id),
k AS (SELECT d.doc_id, d.doc_id % 5 <> 0 AND total IS NOT NULL AS shown, coalesce(c.total, 0) AS total, coalesce(pending, 0) AS pending, coalesce(approved, 0) AS approved, coalesce(needs_correction, 0) AS needs_correction, coalesce(excluded, 0) AS excluded, coalesce(flagged, 0) AS flagged FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN shown THEN round_even(100 * (approved + excluded)::DOUBLE / total, 0)::INTEGER ELSE 0 END AS completion_percent, shown AND approved + excluded = total AS annotation_complete,
{", ".join(f"CASE WHEN shown THEN {c} ELSE 0 END::BIGINT AS {c}" for c in ("total", "pending", "approved", "needs_correction", "excluded", "flagged"))} FROM k""",
)
def queue(spark, d):
    """All gates are open but the review's; every fifth document has no review."""
    s = V.sentences(spark, d)
    codes = F.array_compact(F.array(F.when(F.length("sentence") > 80, "long"), F.when(F.col("sentence").rlike("[0-9]"), "digit")))
    flags = s.select("doc_id", "sentence_id", codes.alias("codes"))
    accepted = s.filter("sentence_id % 3 = 0").select("doc_id", "sentence_id", F.array(F.lit("long")).alias("accepted"))
    counts = registry.review_counts(V.reviews(s), "doc_id").withColumnRenamed("sentences", "n_reviewed").withColumn("n_decided", F.col("approved") + F.col("excluded"))
    one = F.array(F.lit("a"))
    docs = documents(spark, d).select("doc_id").join(counts, "doc_id", "left").join(review_queue.flagged_counts(flags, accepted, "doc_id", "sentence_id"), "doc_id", "left")
    docs = docs.withColumns({"n_records": F.col("n_reviewed"), "resource_count": F.col("n_reviewed"), "review_available": (row_id() % 5 != 0) & F.col("n_reviewed").isNotNull()})
    docs = docs.withColumns({"active_curator": F.lit(True), "original_annotators": one, "human_confirmed": F.lit(True), "title": F.lit("t"), "creators": one, "citation_text": F.lit("x"), "reference": F.lit("r"), "not_findable_reason": F.lit(None).cast("string"), "colors_confirmed": F.lit(True), "color_statuses": F.array(F.lit("approved"))})
    out = review_queue.queue(review_queue.gates(docs))
    return out.select("doc_id", "completion_percent", "annotation_complete", *[F.col(c).cast("long").alias(c) for c in ("total", *review_queue.COUNTS)])


# --- sources and releases ---------------------------------------------------------------------------


@query(
    "collection_documents",
    f"""WITH {V.SENTENCES}, s AS (SELECT doc_id, count(*) AS n, md5(string_agg(sentence, chr(10) ORDER BY page, sentence_id)) AS digest FROM sentences GROUP BY doc_id)
SELECT 'doc' || doc_id AS document_id, 'sources/' || doc_id || '.pdf' AS source_path, coalesce(n, 0)::INTEGER AS record_count, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN s USING (doc_id) WHERE doc_id % 4 = 0""",
)
def collection_documents(spark, d):
    """Every fourth document is done; issues of others do not count."""
    name = F.concat(F.lit("doc"), row_id())
    docs = documents(spark, d).select(name.alias("document_id"), V.path_of(F.lit("sources/")).alias("source_path"), F.col("lang").alias("checksum"), F.when(row_id() % 4 == 0, "done").otherwise("open").alias("status"))
    records = V.sentences(spark, d).select(name.alias("document_id"), "page", "sentence_id", "sentence")
    issues = docs.filter("status = 'open'").select("document_id", F.lit("unknown_label").alias("code"))
    out = registry.collection(docs, records, issues)
    return out.select("document_id", "source_path", "record_count", F.md5(F.array_join(F.transform("records", lambda r: r.getField("sentence")), "\n").cast("binary")).alias("digest"))


PATHS = ["a.json", "x/a.json", "/etc/a", "../a", "x/../a", "x/../../a", "a..b/c", "./a", "x/./y/../..", ".."]


@query("inner_paths", f"SELECT doc_id, doc_id % 10 NOT IN (2, 3, 4, 5, 8, 9) AS inside, doc_id % 10 NOT IN (2, 3, 5, 9) AS below, {sql_pick(PATHS, 'doc_id')} AS path FROM documents")
def inner_paths(spark, d):
    path = pick(PATHS, row_id())
    return documents(spark, d).select("doc_id", T.stays_inside(path).alias("inside"), T.stays_below(path).alias("below"), path.alias("path"))


# --- recognised pages ---------------------------------------------------------------------------------


@query("block_words", f"WITH {V.TAGS} SELECT doc_id, (pos // 40)::BIGINT AS block, string_agg(token, '|' ORDER BY pos) AS words FROM tok GROUP BY ALL")
def block_words(spark, d):
    words = page_words(spark, d).withColumn("block", F.floor(F.col("word") / 40))
    return layout.block_words(words, "doc_id").select("doc_id", "block", F.array_join("words", "|").alias("words"))


RECOGNISED = f"""WITH {WORDS}, h AS (SELECT doc_id, word, arg_max(color, struct_pack(s := shared, c := color)) AS color FROM hit WHERE shared * 100 >= 35 * 480 GROUP BY ALL),
cw AS (SELECT w.*, w.word // 10 AS line, h.color, CASE WHEN w.word % 100 < 5 THEN 'c' || (w.word // 100) ELSE 'p' || (w.word // 20) END AS g FROM words w LEFT JOIN h ON h.doc_id = w.doc_id AND h.word = w.word),
pc AS (SELECT *, CASE WHEN row_number() OVER o = 1 THEN '' WHEN lag(line) OVER o <> line THEN chr(10) ELSE ' ' END || text AS piece, row_number() OVER o AS n, lag(color) OVER o AS was FROM cw WINDOW o AS (PARTITION BY doc_id, g ORDER BY line, word)),
e AS (SELECT *, sum(length(piece)) OVER s AS e, sum(CASE WHEN n > 1 AND color IS NOT DISTINCT FROM was THEN 0 ELSE 1 END) OVER s AS island FROM pc WINDOW s AS (PARTITION BY doc_id, g ORDER BY n)),
ent AS (SELECT doc_id, g, island, color, min(e - length(text)) AS s, max(e) AS e FROM e WHERE color IS NOT NULL GROUP BY ALL),
es AS (SELECT doc_id, g, string_agg(s || '-' || e || '=' || color, ',' ORDER BY s) AS entities FROM ent GROUP BY ALL),
grp AS (SELECT doc_id, g, string_agg(piece, '' ORDER BY n) AS sentence, min(y0) AS y0, min(x0) AS x0, min(word) AS first FROM e GROUP BY ALL)"""


def recognised(spark, d):
    """Lines of ten words, paragraphs of two lines; the first words of every hundred stand in a table cell.  A document stays one row up to its sentences."""
    texts = V.texts(spark, d, by_document=True).select("doc_id", "text").sortWithinPartitions("doc_id")
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(recognised_rows, f"doc_id {kind}, sentence_id int, sentence string, runs array<struct<start:int,end:int,color:int>>, tokens array<string>, ner_tags array<string>")
    return layout.run_entities(found, F.array(*[F.lit(c) for c in BARS])).select("doc_id", "sentence_id", "sentence", "tokens", "values", "entities", "ner_tags")


@query("recognised_records", RECOGNISED + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, first)::INTEGER AS sentence_id, sentence, entities FROM grp JOIN es USING (doc_id, g)""")
def recognised_records(spark, d):
    shown = F.transform("entities", lambda e: F.concat(e.getField("start"), F.lit("-"), e.getField("end"), F.lit("="), e.getField("label")))
    return recognised(spark, d).select("doc_id", "sentence_id", "sentence", F.array_join(shown, ",").alias("entities"))


WORD = r"[\p{L}\p{N}_]"


@query(
    "recognised_tags",
    RECOGNISED
    + rf""", s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, first)::INTEGER AS sentence_id, g, sentence FROM grp JOIN es USING (doc_id, g)),
t AS (SELECT doc_id, sentence_id, g, sentence, i, toks[i] AS tok, gaps[i] AS gap, toks FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM (
  SELECT *, regexp_extract_all(sentence, '{WORD}+(?:[''’\-]{WORD}+)*|[^\p{{L}}\p{{N}}_\p{{Z}}\s]') AS toks, string_split_regex(sentence, '{WORD}+(?:[''’\-]{WORD}+)*|[^\p{{L}}\p{{N}}_\p{{Z}}\s]') AS gaps FROM s))),
p AS (SELECT *, sum(length(tok) + length(gap)) OVER (PARTITION BY doc_id, sentence_id ORDER BY i) AS fin FROM t),
m AS (SELECT p.*, ent.s AS es, ent.color FROM p LEFT JOIN ent ON p.doc_id = ent.doc_id AND p.g = ent.g AND p.fin - length(tok) >= ent.s AND p.fin <= ent.e),
b AS (SELECT *, CASE WHEN color IS NULL THEN 'O' WHEN es IS NOT DISTINCT FROM lag(es) OVER (PARTITION BY doc_id, sentence_id ORDER BY i) THEN 'I-' || color ELSE 'B-' || color END AS tag FROM m)
SELECT doc_id, sentence_id, count(*)::BIGINT AS tokens, string_agg(tag, ' ' ORDER BY i) AS tags, md5(string_agg(tok, ' ' ORDER BY i)) AS digest, coalesce(array_to_string(list_sort(list(DISTINCT color) FILTER (color IS NOT NULL)), ','), '') AS labels FROM b GROUP BY doc_id, sentence_id""",
)
def recognised_tags(spark, d):
    """Tokens of recognised records with their tags and labels."""
    out = recognised(spark, d)
    digest = F.md5(F.array_join("tokens", " ").cast("binary"))
    return out.select("doc_id", "sentence_id", F.size("tokens").cast("long").alias("tokens"), F.array_join("ner_tags", " ").alias("tags"), digest.alias("digest"), F.array_join("values", ",").alias("labels"))
