"""Queries for joins and reports over records, sources, colours, people, reviews and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import colors, contract, evaluation, people, registry
from spanforge.plans import views as V
from spanforge.plans.expressions import documents, pick, row_id, sql_pick
from spanforge.plans.queries import RECORD_KINDS, query, records
from spanforge.sources import documents as D
from spanforge.sources import sinks

LABELS = "(['social','economic','political','historic','aesthetical','scientific','age','ecological'])"

# --- sources and checkpoints ------------------------------------------------------------------


WANTED = "wanted AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'incoming/' WHEN doc_id % 3 = 0 THEN 'nowhere/' ELSE 'sources/' END || doc_id || '.pdf' AS source_path FROM documents WHERE doc_id % 2 = 0)"


def wanted(spark, d):
    place = F.when(row_id() % 7 == 0, "incoming/").when(row_id() % 3 == 0, "nowhere/").otherwise("sources/")
    return documents(spark, d).filter(row_id() % 2 == 0).select(V.path_of(place).alias("source_path"))


@query("registered_sources", f"WITH {V.REGISTRY}, {WANTED} SELECT source_path, checksum FROM discovered SEMI JOIN wanted USING (source_path) ANTI JOIN registry USING (source_path)")
def registered_sources(spark, d):
    return registry.register(V.registry(spark, d), V.discovered(spark, d), wanted(spark, d))


@query("unknown_requests", f"WITH {V.REGISTRY}, {WANTED} SELECT source_path FROM wanted ANTI JOIN discovered USING (source_path)")
def unknown_requests(spark, d):
    return registry.unknown(wanted(spark, d), V.discovered(spark, d))


@query(
    "scan_report",
    f"""WITH {V.REGISTRY}, j AS (SELECT coalesce(a.source_path, b.source_path) AS source_path, CASE WHEN a.checksum IS NULL THEN 'new' WHEN b.checksum IS NULL THEN 'missing' WHEN a.checksum = b.checksum THEN 'current' ELSE 'changed' END AS source_state
FROM registry a FULL JOIN discovered b ON a.source_path = b.source_path)
SELECT source_state, source_path, row_number() OVER (PARTITION BY source_state ORDER BY source_path COLLATE "C")::INTEGER AS position FROM j WHERE source_state <> 'current'""",
)
def scan_report(spark, d):
    return registry.scan_report(registry.synchronise(V.registry(spark, d), V.discovered(spark, d)))


@query("batch_report", "SELECT source, count(*) FILTER (doc_id % 4 = 0) AS completed, count(*) FILTER (doc_id % 4 IN (1, 2)) AS reused, count(*) FILTER (doc_id % 4 = 3) AS failed, count(*) FILTER (doc_id % 4 = 3) = 0 AS successful FROM (SELECT *, 'all' AS source FROM (SELECT doc_id FROM documents)) GROUP BY source")
def batch_report(spark, d):
    results = documents(spark, d).select(pick(["completed", "reused", "reused", "failed"], row_id()).alias("status"))
    return registry.batch_report(results).withColumn("source", F.lit("all"))


# --- citations and people ---------------------------------------------------------------------


CITED = "CASE doc_id % 4 WHEN 0 THEN 'sources/' || doc_id || '.pdf' WHEN 1 THEN doc_id || '.pdf' WHEN 2 THEN 'lost' || doc_id ELSE 'same.pdf' END"


@query(
    "matched_citations",
    f"""WITH s AS (SELECT CASE WHEN doc_id % 4 = 3 THEN lang || doc_id || '/same.pdf' ELSE 'sources/' || doc_id || '.pdf' END AS source_path FROM documents),
c AS (SELECT {CITED} AS source_filename, 't' || doc_id AS title FROM documents),
k AS (SELECT source_path, source_path AS source_filename FROM s UNION SELECT source_path, regexp_extract(source_path, '[^/]*$') FROM s),
n AS (SELECT source_filename, count(*) AS n, min(source_path) AS source_path FROM k GROUP BY source_filename)
SELECT c.source_filename, title, CASE WHEN n = 1 THEN source_path END AS source_path, CASE WHEN n IS NULL THEN 'no_source' WHEN n > 1 THEN 'ambiguous_source' END AS code FROM c LEFT JOIN n USING (source_filename)""",
)
def matched_citations(spark, d):
    docs = documents(spark, d)
    sources = docs.select(F.when(row_id() % 4 == 3, F.concat("lang", row_id(), F.lit("/same.pdf"))).otherwise(V.path_of(F.lit("sources/"))).alias("source_path"))
    name = F.when(row_id() % 4 == 0, V.path_of(F.lit("sources/"))).when(row_id() % 4 == 1, V.path_of(F.lit(""))).when(row_id() % 4 == 2, F.concat(F.lit("lost"), row_id())).otherwise("same.pdf")
    cited = docs.select(name.alias("source_filename"), F.concat(F.lit("t"), row_id()).alias("title"))
    return people.unique_match(cited, sources).select("source_filename", "title", "source_path", "code")


@query(
    "proposed_citations",
    """SELECT 'sources/my_doc_' || doc_id || '.v1.pdf' AS source_path, CASE doc_id % 3 WHEN 0 THEN 'Given' WHEN 1 THEN 'Embedded' ELSE 'my doc ' || doc_id || '.v1' END AS title,
CASE doc_id % 4 WHEN 0 THEN 'Anna' WHEN 1 THEN 'Ben' END AS creator, CASE doc_id % 5 WHEN 0 THEN '1999' WHEN 1 THEN '2004' ELSE '' END AS year FROM documents""",
)
def proposed_citations(spark, d):
    when = lambda k, r, v: F.when(row_id() % k == r, v)
    rows = documents(spark, d).select(
        F.concat(F.lit("sources/my_doc_"), row_id(), F.lit(".v1.pdf")).alias("source_path"),
        when(3, 0, " Given ").otherwise(" ").alias("title"),
        when(3, 1, "Embedded").alias("embedded_title"),
        when(4, 0, "Anna").alias("creator"),
        when(4, 1, " Ben").alias("embedded_author"),
        when(5, 0, "1999").alias("year"),
        when(5, 1, "D:20040102").alias("embedded_date"),
    )
    return people.proposed_citation(rows)


PEOPLE = "p AS (SELECT 'PERSON-' || c_custkey AS person_id, c_name AS name, c_custkey % 3 AS k FROM customer WHERE c_custkey % 4 <> 0)"


@query(
    "assigned_people",
    f"""WITH {PEOPLE}, a AS (SELECT doc_id AS document_id, 'PERSON-' || (doc_id % 97 + 1) AS person_id FROM documents)
SELECT document_id, a.person_id, CASE WHEN name IS NOT NULL AND k <> 0 THEN name END AS name, CASE WHEN name IS NULL THEN 'unknown_person' WHEN k = 0 THEN 'missing_role' END AS code FROM a LEFT JOIN p USING (person_id)""",
)
def assigned_people(spark, d):
    from spanforge.session import table

    key = F.col("c_custkey")
    roles = F.when(key % 3 == 0, F.array(F.lit("annotator"))).otherwise(F.array(F.lit("curator"), F.lit("annotator")))
    known = table(spark, d, "customer").filter(key % 4 != 0).select(F.concat(F.lit("PERSON-"), key).alias("person_id"), F.col("c_name").alias("name"), roles.alias("roles"), F.lit("home").alias("affiliation"), F.lit(None).cast("string").alias("orcid"))
    asked = documents(spark, d).select(row_id().alias("document_id"), F.concat(F.lit("PERSON-"), row_id() % 97 + 1).alias("person_id"))
    return people.assign(asked, known, "curator").select("document_id", "person_id", F.col("snapshot.name").alias("name"), "code")


@query("documents_of_people", "SELECT 'PERSON-' || (doc_id % 97 + 1) AS person_id, count(DISTINCT doc_id)::BIGINT AS n, string_agg(DISTINCT lpad(doc_id::VARCHAR, 12, '0'), ',' ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS documents FROM documents GROUP BY 1")
def documents_of_people(spark, d):
    asked = documents(spark, d).select(F.lpad(row_id().cast("string"), 12, "0").alias("document_id"), F.concat(F.lit("PERSON-"), row_id() % 97 + 1).alias("person_id"))
    return people.documents_of(asked).select("person_id", F.size("documents").cast("long").alias("n"), F.array_join("documents", ",").alias("documents"))


@query("current_decisions", "SELECT source AS document_id, max(doc_id) AS candidate_id, CASE WHEN max(doc_id) % 3 = 0 THEN NULL WHEN max(doc_id) % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS decision FROM documents GROUP BY source")
def current_decisions(spark, d):
    """Each source's latest document is its candidate; two decisions on a candidate, the last counts; a third has none."""
    candidates = documents(spark, d).select(F.col("source").alias("document_id"), row_id().alias("candidate_id"), row_id().alias("ord"))
    decided = documents(spark, d).filter(row_id() % 3 != 0)
    last = decided.select(row_id().alias("candidate_id"), F.when(row_id() % 2 == 0, "accepted").otherwise("rejected").alias("decision"), F.lit("b").alias("actor"), F.lit(2).alias("ord"))
    first = decided.select(row_id().alias("candidate_id"), F.lit("deferred").alias("decision"), F.lit("a").alias("actor"), F.lit(1).alias("ord"))
    return people.current_decisions(candidates, last.union(first)).select("document_id", "candidate_id", "decision")


# --- colours ------------------------------------------------------------------------------------


@query("colour_occurrences", f"WITH {RECORD_KINDS} SELECT CASE WHEN kind = 4 THEN 'RED' ELSE '#00FF00' END AS hex, doc_id, sentence_id::INTEGER AS sentence_id, 0 AS begins, (CASE WHEN kind = 2 THEN length(sentence) + 1 ELSE length(first) END)::INTEGER AS ends FROM kinds")
def colour_occurrences(spark, d):
    return colors.occurrences(records(spark, d), "doc_id", "sentence_id").withColumnsRenamed({"start": "begins", "end": "ends"})


PALETTE_HEX = ["#FF0000", "#00FF00", "#0000FF", "#FFFF00"]


def palette(spark, d):
    """Two colours of four for each source, some confirmed."""
    docs = documents(spark, d).select("source").distinct()
    number = F.length("source") + F.ascii(F.substring("source", -1, 1))
    each = docs.select(F.col("source").alias("document_id"), number.alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    return each.select("document_id", "n", pick(PALETTE_HEX, F.col("n") + F.col("j")).alias("hex"), pick(["social", "age", "historic"], F.col("n") + F.col("j")).alias("label"), F.lit("approved").alias("status"), (F.col("n") % 2 == 0).alias("confirmed"))


PALETTE = f"""palette AS (SELECT source AS document_id, n, {sql_pick(PALETTE_HEX, 'n + j')} AS hex, {sql_pick(['social', 'age', 'historic'], 'n + j')} AS label, n % 2 = 0 AS confirmed
FROM (SELECT DISTINCT source, length(source) + ascii(right(source, 1)) AS n FROM documents), range(0, 2) r(j))"""


@query(
    "new_colours",
    f"""WITH {PALETTE}, seen AS (SELECT DISTINCT source AS document_id, {sql_pick(PALETTE_HEX, 'doc_id')} AS hex FROM documents),
a AS (SELECT document_id, hex, label, 'approved' AS status FROM palette UNION ALL SELECT document_id, hex, NULL, 'pending' FROM seen ANTI JOIN palette USING (document_id, hex))
SELECT *, document_id NOT IN (SELECT document_id FROM a WHERE status = 'pending') AS confirmed FROM a""",
)
def new_colours(spark, d):
    seen = documents(spark, d).select(F.col("source").alias("document_id"), pick(PALETTE_HEX, row_id()).alias("hex")).distinct()
    return colors.with_new_colors(palette(spark, d), seen, "document_id")


@query("palette_conflicts", f"WITH {PALETTE} SELECT hex, count(DISTINCT label)::BIGINT AS labels FROM palette GROUP BY hex HAVING count(DISTINCT label) > 1")
def palette_conflicts(spark, d):
    return colors.palette_conflicts(palette(spark, d))


@query("batch_palette_issues", f"WITH {PALETTE}, e AS (SELECT string_agg(hex || '=' || label, ',' ORDER BY hex) AS p, bool_and(confirmed) AS c FROM palette GROUP BY document_id), o AS (SELECT count(DISTINCT p) <= 1 AS same, bool_and(c) AS confirmed FROM e) SELECT 'batch_palette_mismatch' AS code FROM o WHERE NOT same UNION ALL SELECT 'shared_mapping_unconfirmed' FROM o WHERE NOT confirmed")
def batch_palette_issues(spark, d):
    return colors.batch_issues(palette(spark, d), "document_id")


@query(
    "mapping_precedence",
    f"""WITH c AS (SELECT DISTINCT printf('#%06X', doc_id) AS hex, doc_id FROM documents)
SELECT hex, CASE WHEN doc_id % 2 = 0 THEN 'social' WHEN doc_id % 3 = 0 THEN 'age' END AS label, CASE WHEN doc_id % 2 = 0 THEN 'document' WHEN doc_id % 3 = 0 THEN 'profile' ELSE 'manual' END AS method FROM c""",
)
def mapping_precedence(spark, d):
    seen = documents(spark, d).select(F.format_string("#%06X", row_id()).alias("hex"), row_id()).distinct()
    own = seen.filter(row_id() % 2 == 0).select(F.lower("hex").alias("hex"), F.lit("social").alias("label"))
    profile = seen.filter(row_id() % 3 == 0).select("hex", F.lit("age").alias("label"))
    return colors.resolve(seen.select("hex"), ("document", own), ("profile", profile))


@query(
    "chosen_labels",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '#00FF00=age' WHEN doc_id % 3 = 1 THEN '#00FF00=social,#FF0000=historic' END AS labels FROM documents",
)
def chosen_labels(spark, d):
    rows = spark.createDataFrame([(1, "#00ff00", "age", "social", "approved"), (1, "#FF0000", None, "historic", "pending"), (1, "#0000FF", "age", None, "ignored")], "one int, hex string, label string, suggestion string, status string")
    found = rows.groupBy("one").agg(F.array_sort(F.collect_list(F.struct("hex", "label", "suggestion", "status"))).alias("colors"))
    chosen = colors.chosen_labels(F.col("colors"), row_id() % 3 == 0, row_id() % 3 < 2)
    out = documents(spark, d).select("doc_id").crossJoin(F.broadcast(found)).select("doc_id", F.array_sort(F.map_entries(chosen)).alias("m"))  # one row
    return out.select("doc_id", F.array_join(F.transform("m", lambda x: F.concat_ws("=", x.getField("key"), x.getField("value"))), ",").alias("labels"))


@query(
    "compiled_drafts",
    f"""WITH {RECORD_KINDS} SELECT doc_id, sentence_id::INTEGER AS sentence_id, CASE WHEN kind = 4 THEN '' ELSE 'age' END AS labels, CASE WHEN kind = 4 THEN 'RED' ELSE '' END AS unresolved FROM kinds WHERE kind <> 12""",
)
def compiled_drafts(spark, d):
    """Green becomes a label, red is unknown, the colour of every twelfth kind is ignored."""
    rows = records(spark, d).withColumn("kind", (F.col("doc_id") + F.col("sentence_id")) % 23)
    labels = F.when(F.col("kind") == 12, F.create_map(F.lit("#FFFFFF"), F.lit("social"))).otherwise(F.create_map(F.lit("#00FF00"), F.lit("age")))
    ignored = F.when(F.col("kind") == 12, F.array(F.lit("#00FF00"))).otherwise(F.array().cast("array<string>"))
    out = colors.compile_draft(rows, labels, ignored)
    return out.select("doc_id", "sentence_id", F.array_join("values", ",").alias("labels"), F.array_join("unresolved", ",").alias("unresolved"))


VERSIONS = "versions AS (SELECT source AS configuration_id, (doc_id % 3 + 1)::INTEGER AS version, printf('#%06X', doc_id) AS hex, 'age' AS label FROM documents)"


def versions(spark, d):
    return documents(spark, d).select(F.col("source").alias("configuration_id"), (row_id() % 3 + 1).cast("int").alias("version"), F.format_string("#%06X", row_id()).alias("hex"), F.lit("age").alias("label"))


@query("selected_palettes", f"WITH {VERSIONS} SELECT * FROM versions WHERE version = length(configuration_id) % 3 + 1")
def selected_palettes(spark, d):
    v = versions(spark, d)
    pointers = v.select("configuration_id", (F.length("configuration_id") % 3 + 1).alias("version")).distinct()
    return colors.selected_version(v, pointers)


@query("appended_palette", f"WITH {VERSIONS} SELECT configuration_id, max(version)::INTEGER AS version, count(*)::BIGINT AS n FROM (SELECT * FROM versions UNION ALL SELECT 'new', 1, '#010101', 'social') GROUP BY configuration_id")
def appended_palette(spark, d):
    more = spark.createDataFrame([("#010101", "social")], "hex string, label string")
    out = colors.append_version(versions(spark, d), more, "new")
    return out.groupBy("configuration_id").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("n"))


# --- reviews, packages, evaluation --------------------------------------------------------------


@query(
    "review_decisions",
    f"""WITH {V.SENTENCES}, {V.REVIEWS}, n AS (SELECT doc_id, sentence_id, CASE WHEN sentence_id % 2 = 0 THEN 'excluded' ELSE 'approved' END AS status, 2 AS at FROM sentences WHERE (doc_id + sentence_id) % 3 = 0)
SELECT r.doc_id, r.sentence_id, coalesce(n.status, r.status) AS status, coalesce(n.at, r.decided_at)::BIGINT AS decided_at FROM reviews r LEFT JOIN n ON r.doc_id = n.doc_id AND r.sentence_id = n.sentence_id""",
)
def review_decisions(spark, d):
    """Every third sentence is decided twice; the second time counts."""
    s = V.sentences(spark, d)
    some = s.filter((F.col("doc_id") + F.col("sentence_id")) % 3 == 0)
    made = lambda status, at: some.select("doc_id", "sentence_id", status.alias("status"), F.lit("anna").alias("actor"), F.lit(at).cast("long").alias("at"))
    final = F.when(F.col("sentence_id") % 2 == 0, "excluded").otherwise("approved")
    out, _ = registry.decide(V.reviews(s), made(F.lit("pending"), 1).union(made(final, 2)))
    return out.select("doc_id", "sentence_id", "status", "decided_at")


@query(
    "record_ratios",
    """WITH s AS (SELECT source AS case_id, doc_id % 50 AS r, doc_id % 4 <> 0 AS gold, doc_id % 3 <> 0 AS seen FROM documents),
r AS (SELECT case_id, r, bool_or(gold) AS g, bool_or(seen) AS o FROM s GROUP BY ALL HAVING bool_or(gold) OR bool_or(seen))
SELECT case_id, count(*) FILTER (g)::BIGINT AS gold, count(*) FILTER (o)::BIGINT AS observed, count(*) FILTER (g AND o)::BIGINT AS matched,
round(count(*) FILTER (g AND o) / nullif(count(*) FILTER (o), 0)::DOUBLE, 9) AS precision, round(count(*) FILTER (g AND o) / nullif(count(*) FILTER (g), 0)::DOUBLE, 9) AS recall FROM r GROUP BY case_id""",
)
def record_ratios(spark, d):
    each = documents(spark, d).select(row_id(), F.col("source").alias("case_id"), F.to_json(F.struct((row_id() % 50).alias("r"))).alias("record"))
    out = evaluation.record_ratios(each.filter(row_id() % 4 != 0), each.filter(row_id() % 3 != 0))
    return out.select("case_id", *[F.col(c).cast("long").alias(c) for c in ("gold", "observed", "matched")], "precision", "recall")


@query(
    "proposal_rates",
    """SELECT source, count(*) FILTER (doc_id % 5 <> 0)::BIGINT AS proposals, round(count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 3 = 0) / nullif(count(*) FILTER (doc_id % 5 <> 0), 0)::DOUBLE, 9) AS correction_rate,
round(count(*) FILTER (doc_id % 5 = 0) / count(*)::DOUBLE, 9) AS abstention_rate FROM documents GROUP BY source""",
)
def proposal_rates(spark, d):
    return evaluation.rates(documents(spark, d).select("source", F.when(row_id() % 5 != 0, "age").alias("label"), (row_id() % 3 == 0).alias("corrected")), "source")


@query("split_differences", "SELECT 'missing' AS side, doc_id AS id FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'added', -doc_id - 1 FROM documents WHERE doc_id % 9 = 0")
def split_differences(spark, d):
    """Rows of a published split that a computed one lacks, and the other way round; ids of every ninth row differ."""
    published = documents(spark, d).select(row_id().alias("id"), "lang")
    computed = documents(spark, d).select(F.when(row_id() % 9 == 0, -row_id() - 1).otherwise(row_id()).alias("id"), "lang")
    assert not registry.same_split(published, computed)
    return published.exceptAll(computed).select(F.lit("missing").alias("side"), "id").union(computed.exceptAll(published).select(F.lit("added"), "id"))


@query("failed_labels", f"""WITH {V.SENTENCES}, base AS (SELECT {LABELS}[(doc_id + sentence_id) % 8 + 1] AS label, (doc_id * 3 + sentence_id) % 10 AS k FROM sentences)
SELECT label, count(*) FILTER (k < 2)::BIGINT AS missed, count(*) FILTER (k = 2 AND label <> 'social')::BIGINT AS wrong FROM base GROUP BY label HAVING count(*) FILTER (k < 2) + count(*) FILTER (k = 2 AND label <> 'social') > 0""")
def failed_labels(spark, d):
    from spanforge.plans.queries import gold_and_observed

    return evaluation.failures_by_label(*gold_and_observed(spark, d))


@query(
    "record_quality_report",
    f"""WITH {V.SENTENCES}, t AS (SELECT collection, sentence, string_split_regex(sentence, ' +') AS ts FROM sentences),
x AS (SELECT collection, [CASE WHEN length(sentence) < 15 THEN 'unusually_short_sentence' END, CASE WHEN length(sentence) > 500 THEN 'unusually_long_sentence' END,
CASE WHEN right(sentence, 1) NOT IN ('.', '!', '?', ';', ':') THEN 'likely_sentence_boundary_error' END, CASE WHEN len(list_filter(ts, lambda x: regexp_full_match(x, '[\\p{{L}}\\p{{N}}]+'))) <= 1 THEN 'single_word_sentence' END, CASE WHEN len(ts) > 100 THEN 'too_many_tokens' END] AS codes FROM t),
f AS (SELECT collection, unnest(codes) AS code FROM x), n AS (SELECT collection, count(*) AS records, count(*) FILTER (len(list_filter(codes, lambda c: c IS NOT NULL)) > 0) AS flagged FROM x GROUP BY collection)
SELECT collection, code, 'warning' AS severity, count(*)::BIGINT AS n, any_value(records)::BIGINT AS records, any_value(flagged)::BIGINT AS flagged FROM f JOIN n USING (collection) WHERE code IS NOT NULL GROUP BY ALL""",
)
def record_quality_report(spark, d):
    """Flags of records without contract issues: entities and tags are left out."""
    rows = records(spark, d)
    empty = {"entities": F.filter("entities", lambda e: F.lit(False)), "values": F.array().cast("array<string>"), "ner_tags": F.transform("tokens", lambda t: F.lit("O")), "curated_sentence": F.lit(None).cast("string")}
    good = {"page": F.lit(1), "schema_version": F.lit("1.0"), "mapping_provenance": F.lit(None).cast("struct<method:string,status:string,config_id:string>")}
    return contract.quality_report(rows.withColumns(empty | good), "collection")


@query(
    "canonical_records",
    f"""WITH {RECORD_KINDS} SELECT doc_id, sentence_id::INTEGER AS sentence_id, md5('{{' || CASE WHEN kind = 8 THEN '"curated_sentence":" ",' ELSE '' END || '"page":' || CASE WHEN kind = 7 THEN 0 ELSE page END || ',"schema_version":"' || CASE WHEN kind = 11 THEN '2.0' ELSE '1.0' END || '","sentence_id":' || sentence_id || '}}') AS digest FROM kinds""",
)
def canonical_records(spark, d):
    text = contract.canonical_json("page", "sentence_id", "schema_version", "curated_sentence")
    return records(spark, d).select("doc_id", "sentence_id", F.md5(text.cast("binary")).alias("digest"))


@query("flat_records", f"WITH {RECORD_KINDS} SELECT doc_id, sentence_id::INTEGER AS sentence_id, '[\"' || CASE WHEN kind = 9 THEN 'age\",\"social' ELSE label END || '\"]' AS labels, md5(sentence) AS digest FROM kinds")
def flat_records(spark, d):
    """Records as rows of a CSV file, lists as JSON."""
    rows = records(spark, d).withColumnRenamed("doc_id", "document_id")
    return sinks.flat(rows).select(F.col("document_id").alias("doc_id"), "sentence_id", F.col("values").alias("labels"), F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query(
    "ocr_confidence",
    f"""WITH {V.TAGS} SELECT doc_id, count(*)::BIGINT AS words, round(avg((length(token) * 7 + pos) % 90 + 10), 2) AS confidence FROM tok WHERE pos % 9 <> 0 AND length(token) > 0 GROUP BY doc_id""",
)
def ocr_confidence(spark, d):
    """Recognised words of a page table: rows of other levels and without confidence are left out."""
    t = V.sequences(spark, d, by_document=True).select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    conf = F.when(F.col("pos") % 9 == 0, -1).otherwise((F.length("token") * 7 + F.col("pos")) % 90 + 10)
    level = lambda n, c, text: F.concat_ws("\t", *[F.lit(x) for x in (n, 1, 1, 1, 1)], F.col("pos"), *[F.lit(x) for x in (10, 20, 30, 40)], c, text)
    lines = t.select("doc_id", F.explode(F.array(level(4, F.lit(-1), F.lit("")), level(5, conf, F.col("token")))).alias("value"))
    words = D.ocr_words(lines)
    return D.mean_confidence(words, "doc_id").select("doc_id", "words", F.round("confidence", 2).alias("confidence"))
