"""Queries for review events, guarded edits and approvals; the SQL replays the same rules on the same events."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import registry, review_events
from spanforge.plans import views as V
from spanforge.plans.expressions import pick, sql_list, sql_pick
from spanforge.plans.queries import query
from spanforge.session import kept

ACTORS = ["anna", "ben ", "  ", "carl", None]
STATUSES = ["approved", "excluded", "approved", "needs_correction", "pending", "maybe", None]
CODES = ["unusually_short_sentence", "likely_sentence_boundary_error", "many_digits"]


def review_tables(spark, d):
    """(events, records, warnings) of the first thirty sentences of each document.

    What happens to a sentence follows from its length and its numbers; warnings follow
    from its text, so every version of it has its own.
    """
    s = V.sentences(spark, d, by_document=True).filter("sentence_id <= 30").select("doc_id", F.col("sentence_id").cast("int").alias("sentence_id"), "sentence", F.length("sentence").alias("n"))
    i, k, n = F.col("doc_id"), F.col("sentence_id"), F.col("n")
    sha = lambda text: F.md5(text.cast("binary"))
    records = s.select("doc_id", "sentence_id", sha(F.col("sentence")).alias("record_sha256"))
    later = F.concat("sentence", F.lit(" 1234."))
    texts = s.select("doc_id", "sentence_id", F.explode(F.array("sentence", later)).alias("t"))
    flags = F.array_compact(
        F.array(
            F.when(F.length("t") < 40, F.struct(F.lit(CODES[0]).alias("code"), F.lit("warning").alias("severity"))),
            F.when(~F.right("t", F.lit(1)).isin(*".!?"), F.struct(F.lit(CODES[1]).alias("code"), F.lit("warning").alias("severity"))),
            F.when(F.length(F.regexp_replace("t", "[^0-9]", "")) > 3, F.struct(F.lit(CODES[2]).alias("code"), F.lit("error").alias("severity"))),
        )
    )
    warnings = texts.select("doc_id", "sentence_id", sha(F.col("t")).alias("record_sha256"), F.explode(flags).alias("f")).select("doc_id", "sentence_id", "record_sha256", "f.*")
    actor = lambda x: pick(ACTORS, x)

    def event(kind, place, when, who, **what):
        more = {c: what.get(c, F.lit(None).cast("string")) for c in ("status", "code", "record_sha256")}
        ids = what.get("ids", F.array(k))
        one = F.struct((k * 100 + place).cast("long").alias("seq"), F.lit(kind).alias("kind"), who.alias("actor"), ids.alias("sentence_ids"), *[c.alias(x) for x, c in more.items()], (k * 1000 + place).cast("long").alias("at"))
        return F.when(when, one)

    none = F.lit(None).cast("array<int>")
    events = [
        event("decide", 10, F.lit(True), actor(n), status=pick(STATUSES, n + k), ids=F.when(k % 5 == 0, F.array(k, k - 1, k - 1)).when(n % 19 == 0, F.array(k, F.lit(99))).when(n % 23 == 0, F.array().cast("array<int>")).otherwise(F.array(k))),
        event("accept_warning", 20, n % 2 == 0, actor(n + i), code=pick(CODES, n + k)),
        event("edit", 30, n % 7 == 0, actor(n + k), record_sha256=F.when(n % 21 != 0, sha(later))),
        event("accept_all", 40, k % 9 == 0, actor(k + i), ids=none),
        event("source_changed", 50, n % 11 == 0, F.lit(None).cast("string"), record_sha256=F.when(n % 2 == 0, sha(F.col("sentence"))).otherwise(sha(later))),
        event("accept_warning", 60, n % 3 == 0, F.lit("dora"), code=pick(CODES, n)),
        event("decide", 70, (n + i) % 4 != 0, F.lit("eva"), status=F.lit("approved")),
        event("submit", 80, k % 6 == 0, actor(i), ids=none),
        event("vanish", 90, n % 40 == 0, F.lit("eva"), ids=none),
    ]
    out = s.select("doc_id", F.explode(F.array_compact(F.array(*events))).alias("e")).select("doc_id", "e.*")
    return out, records, warnings


EVENTS_SQL = f"""{V.SENTENCES},
s AS (SELECT doc_id, sentence_id::INTEGER AS k, sentence, length(sentence) AS n, md5(sentence) AS sha0, md5(sentence || ' 1234.') AS sha1 FROM sentences WHERE sentence_id <= 30),
txt AS (SELECT doc_id, k, sha0 AS sha, sentence AS t FROM s UNION ALL SELECT doc_id, k, sha1, sentence || ' 1234.' FROM s),
warn AS (SELECT doc_id, k, sha, '{CODES[0]}' AS code, 'warning' AS sev FROM txt WHERE length(t) < 40 UNION ALL SELECT doc_id, k, sha, '{CODES[1]}', 'warning' FROM txt WHERE right(t, 1) NOT IN ('.', '!', '?')
  UNION ALL SELECT doc_id, k, sha, '{CODES[2]}', 'error' FROM txt WHERE length(regexp_replace(t, '[^0-9]', '', 'g')) > 3),
ev(doc_id, seq, kind, actor, ids, status, code, sha, tm) AS (
  SELECT doc_id, k * 100 + 10, 'decide', {sql_pick(ACTORS, "n")}, CASE WHEN k % 5 = 0 THEN [k, k - 1] WHEN n % 19 = 0 THEN [k, 99] WHEN n % 23 = 0 THEN [] ELSE [k] END, {sql_pick(STATUSES, "n + k")}, NULL, NULL, k * 1000 + 10 FROM s
  UNION ALL SELECT doc_id, k * 100 + 20, 'accept_warning', {sql_pick(ACTORS, "n + doc_id")}, [k], NULL, {sql_pick(CODES, "n + k")}, NULL, k * 1000 + 20 FROM s WHERE n % 2 = 0
  UNION ALL SELECT doc_id, k * 100 + 30, 'edit', {sql_pick(ACTORS, "n + k")}, [k], NULL, NULL, CASE WHEN n % 21 <> 0 THEN sha1 END, k * 1000 + 30 FROM s WHERE n % 7 = 0
  UNION ALL SELECT doc_id, k * 100 + 40, 'accept_all', {sql_pick(ACTORS, "k + doc_id")}, NULL, NULL, NULL, NULL, k * 1000 + 40 FROM s WHERE k % 9 = 0
  UNION ALL SELECT doc_id, k * 100 + 50, 'source_changed', NULL, [k], NULL, NULL, CASE WHEN n % 2 = 0 THEN sha0 ELSE sha1 END, k * 1000 + 50 FROM s WHERE n % 11 = 0
  UNION ALL SELECT doc_id, k * 100 + 60, 'accept_warning', 'dora', [k], NULL, {sql_pick(CODES, "n")}, NULL, k * 1000 + 60 FROM s WHERE n % 3 = 0
  UNION ALL SELECT doc_id, k * 100 + 70, 'decide', 'eva', [k], 'approved', NULL, NULL, k * 1000 + 70 FROM s WHERE (n + doc_id) % 4 <> 0
  UNION ALL SELECT doc_id, k * 100 + 80, 'submit', {sql_pick(ACTORS, "doc_id")}, NULL, NULL, NULL, NULL, k * 1000 + 80 FROM s WHERE k % 6 = 0
  UNION ALL SELECT doc_id, k * 100 + 90, 'vanish', 'eva', NULL, NULL, NULL, NULL, k * 1000 + 90 FROM s WHERE n % 40 = 0),
top AS (SELECT doc_id, max(k) AS most FROM s GROUP BY doc_id),
adm AS (SELECT ev.*, CASE WHEN kind = 'vanish' THEN 'unknown_event' WHEN trim(coalesce(actor, '')) = '' AND kind <> 'source_changed' THEN 'actor_required'
  WHEN kind = 'decide' AND status = 'pending' THEN 'pending_is_no_decision' WHEN kind = 'decide' AND (status IS NULL OR status = 'maybe') THEN 'unknown_status'
  WHEN kind NOT IN ('accept_all', 'submit') AND len(ids) = 0 THEN 'sentence_required' WHEN len(list_filter(ids, lambda x: x > most OR x < 1)) > 0 THEN 'unknown_sentence'
  WHEN kind IN ('edit', 'source_changed') AND sha IS NULL THEN 'record_required' END AS refused FROM ev JOIN top USING (doc_id)),
hit AS (SELECT doc_id, seq, kind, actor, status, code, sha, tm, unnest(list_distinct(ids)) AS k FROM adm WHERE refused IS NULL AND ids IS NOT NULL
  UNION ALL SELECT a.doc_id, seq, kind, actor, status, code, a.sha, tm, s.k FROM adm a JOIN s USING (doc_id) WHERE refused IS NULL AND kind = 'accept_all'),
ver AS (SELECT hit.*, coalesce((SELECT arg_max(h.sha, h.seq) FROM hit h WHERE h.doc_id = hit.doc_id AND h.k = hit.k AND h.seq < hit.seq AND h.kind IN ('edit', 'source_changed')), s.sha0) AS before FROM hit JOIN s USING (doc_id, k)),
vn AS (SELECT *, CASE WHEN kind IN ('edit', 'source_changed') THEN sha ELSE before END AS after, sum(CASE WHEN kind IN ('edit', 'source_changed') AND sha <> before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, k ORDER BY seq) AS version FROM ver),
acc AS (SELECT *, CASE WHEN sev IS NULL THEN 'warning_not_active' WHEN sev = 'error' THEN 'error_not_acceptable' WHEN row_number() OVER (PARTITION BY doc_id, k, version, code, sev ORDER BY seq) > 1 THEN 'already_accepted' ELSE 'applied' END AS outcome FROM (
  SELECT v.doc_id, v.k, seq, kind, actor, tm, version, v.code, w.sev FROM vn v LEFT JOIN warn w ON v.doc_id = w.doc_id AND v.k = w.k AND v.before = w.sha AND v.code = w.code WHERE kind = 'accept_warning'
  UNION ALL SELECT v.doc_id, v.k, seq, kind, actor, tm, version, w.code, w.sev FROM vn v JOIN warn w ON v.doc_id = w.doc_id AND v.k = w.k AND v.before = w.sha AND w.sev = 'warning' WHERE kind = 'accept_all')),
chg AS (SELECT doc_id, k, seq, kind, actor, tm, CASE WHEN kind = 'decide' THEN status WHEN kind = 'edit' THEN 'needs_correction' ELSE 'pending' END AS st FROM vn WHERE kind IN ('decide', 'edit') OR (kind = 'source_changed' AND after <> before))"""


@query(
    "review_states",
    f"""WITH {EVENTS_SQL}
SELECT s.doc_id, s.k AS sentence_id, coalesce((SELECT arg_max(after, seq) FROM vn WHERE vn.doc_id = s.doc_id AND vn.k = s.k), sha0) AS record_sha256,
coalesce(c.c.st, 'pending') AS status, CASE WHEN c.c.kind = 'decide' THEN trim(c.c.actor) END AS reviewer, CASE WHEN c.c.kind = 'decide' THEN c.c.tm END::BIGINT AS decided_at,
coalesce((SELECT string_agg(DISTINCT acc.code, ',' ORDER BY acc.code) FROM acc WHERE acc.doc_id = s.doc_id AND acc.k = s.k AND outcome = 'applied' AND version = (SELECT max(version) FROM vn WHERE vn.doc_id = s.doc_id AND vn.k = s.k)), '') AS accepted
FROM s LEFT JOIN (SELECT doc_id, k, arg_max(chg, seq) AS c FROM chg GROUP BY doc_id, k) c USING (doc_id, k)""",
)
def review_states(spark, d):
    """The state of every sentence after all events."""
    return review_events.states(*review_tables(spark, d), kept(spark)).withColumn("accepted", F.array_join("accepted", ","))


@query(
    "review_outcomes",
    f"""WITH {EVENTS_SQL},
cur AS (SELECT a.doc_id, a.seq, s.k, (SELECT arg_max(st, c.seq) FROM chg c WHERE c.doc_id = a.doc_id AND c.k = s.k AND c.seq <= a.seq) AS st FROM adm a JOIN s USING (doc_id) WHERE a.kind = 'submit' AND a.refused IS NULL),
sub AS (SELECT doc_id, seq, count(*) FILTER (st IS NULL OR st NOT IN ('approved', 'excluded')) AS n FROM cur GROUP BY doc_id, seq),
w AS (SELECT doc_id, seq, count(*) FILTER (outcome = 'applied') AS good, any_value(outcome) AS outcome FROM acc GROUP BY doc_id, seq),
sc AS (SELECT doc_id, seq, bool_or(after <> before) AS moved FROM vn WHERE kind = 'source_changed' GROUP BY doc_id, seq)
SELECT doc_id, seq::BIGINT AS seq, kind, CASE WHEN refused IS NOT NULL THEN refused WHEN kind = 'submit' THEN CASE WHEN n > 0 THEN 'unresolved_sentences' ELSE 'applied' END
WHEN kind = 'source_changed' THEN CASE WHEN moved THEN 'applied' ELSE 'nothing_to_do' END WHEN kind = 'accept_all' THEN CASE WHEN coalesce(good, 0) > 0 THEN 'applied' ELSE 'nothing_to_do' END
WHEN kind = 'accept_warning' THEN CASE WHEN outcome = 'already_accepted' THEN 'nothing_to_do' ELSE outcome END ELSE 'applied' END AS outcome
FROM adm LEFT JOIN sub USING (doc_id, seq) LEFT JOIN w USING (doc_id, seq) LEFT JOIN sc USING (doc_id, seq)""",
)
def review_outcomes(spark, d):
    """What became of every event."""
    return review_events.outcomes(*review_tables(spark, d), kept(spark))


@query(
    "review_audit",
    f"""WITH {EVENTS_SQL}, ch AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY doc_id, k ORDER BY seq), 'pending') AS was FROM chg)
SELECT doc_id, k AS sentence_id, seq::BIGINT AS seq, 'decision' AS event, trim(actor) AS actor, was || '>' || st AS detail FROM ch WHERE kind = 'decide'
UNION ALL SELECT doc_id, k, seq, 'edit', trim(actor), before || '>' || after FROM vn WHERE kind = 'edit'
UNION ALL SELECT doc_id, k, seq, 'source_record_changed', 'system', before FROM vn WHERE kind IN ('edit', 'source_changed') AND after <> before
UNION ALL SELECT doc_id, k, seq, 'warning_accepted', trim(actor), code FROM acc WHERE outcome = 'applied'""",
)
def review_audit(spark, d):
    """Audit events of all sentences, their details written out."""
    found = review_events.audit(*review_tables(spark, d), kept(spark))
    part = lambda k: F.get_json_object("details", f"$.{k}")
    detail = F.when(F.col("event") == "decision", F.concat_ws(">", part("from"), part("to"))).when(F.col("event") == "edit", F.concat_ws(">", part("before"), part("after"))).otherwise(F.coalesce(part("previous"), part("code")))
    return found.select("doc_id", "sentence_id", "seq", "event", "actor", detail.alias("detail"))


# --- guarded edits ------------------------------------------------------------------------------

COLORS = ["#FF0000", "#00FF00", None]
LABELS = ["age", "social", "age", "economic"]


def edited_records(spark, d):
    """(before, after): what an edit changes follows from the length of the sentence; some name a record that is not there."""
    s = V.sentences(spark, d, by_document=True).select("doc_id", F.col("sentence_id").cast("int").alias("sentence_id"), "page", "sentence", F.length("sentence").alias("n"))
    n, k = F.col("n"), F.col("sentence_id")
    entity = lambda j: F.struct(pick(LABELS, n + j).alias("label"), pick(COLORS, n + k + j).alias("color"))
    entities = F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")), entity)
    some = lambda m, c, other: F.when(n % m == 0, c).otherwise(other)
    before = s.select("*", F.lit("1.0").alias("schema_version"), F.when(n % 10 == 0, F.struct(F.lit("m").alias("method"), F.lit("approved").alias("status"))).alias("mapping_provenance"), some(15, F.lit("old"), F.lit(None).cast("string")).alias("curated_sentence"), F.split("sentence", " ").alias("tokens"), entities.alias("entities"))
    dropped = F.when(n % 4 == 0, F.slice("entities", 2, 10)).otherwise(F.col("entities"))
    coloured = F.when(n % 6 == 0, F.transform("entities", lambda e, j: F.when(j == 0, e.withField("label", F.lit("ecological"))).otherwise(e))).when(n % 9 == 0, F.concat("entities", F.slice("entities", 1, 1)))
    excluded = F.when(n % 17 == 0, F.array(F.lit(7))).when((n % 4 == 0) & (n % 8 != 0), F.array(F.lit(0), F.lit(0))).when(n % 31 == 0, F.lit(None).cast("array<int>")).otherwise(F.array().cast("array<int>"))
    after = before.select(
        "doc_id",
        some(29, k + 100000, k).alias("place"),
        some(14, k + 1, k).alias("sentence_id"),
        (F.col("page") + some(11, F.lit(1), F.lit(0))).alias("page"),
        some(13, F.concat("sentence", F.lit("!")), F.col("sentence")).alias("sentence"),
        some(22, F.lit("0.1"), F.col("schema_version")).alias("schema_version"),
        F.when(n % 20 != 0, F.col("mapping_provenance")).alias("mapping_provenance"),
        some(5, F.lit("new"), F.col("curated_sentence")).alias("curated_sentence"),
        some(7, F.array_append("tokens", F.lit("x")), F.col("tokens")).alias("tokens"),
        F.coalesce(coloured, dropped).alias("entities"),
        excluded.alias("excluded"),
    )
    return before.drop("n"), after


@query(
    "guarded_edits",
    f"""WITH {V.SENTENCES}, s AS (SELECT doc_id, sentence_id::INTEGER AS k, page, sentence, length(sentence) AS n FROM sentences),
b AS (SELECT *, list_transform(range(1, n % 3 + 2), lambda j: {sql_list(LABELS)}[(n + j) % 4 + 1] || '|' || coalesce({sql_list(COLORS)}[(n + k + j) % 3 + 1], '-')) AS e FROM s),
a AS (SELECT *, CASE WHEN n % 6 = 0 THEN list_concat(['ecological|' || split_part(e[1], '|', 2)], e[2:]) WHEN n % 9 = 0 THEN list_concat(e, e[1:1]) WHEN n % 4 = 0 THEN e[2:] ELSE e END AS e1,
      CASE WHEN n % 17 = 0 THEN [7] WHEN n % 4 = 0 AND n % 8 <> 0 THEN [0] ELSE [] END AS gone FROM b WHERE n % 29 <> 0),
c AS (SELECT *, len(list_filter(gone, lambda i: i >= len(e))) > 0 AS outside, list_filter(list_transform(range(1, len(e) + 1), lambda i: CASE WHEN NOT list_contains(gone, i - 1) THEN e[i] END), lambda x: x IS NOT NULL) AS kept FROM a)
SELECT doc_id, k AS sentence_id, 'not_exactly_one_record' AS code, NULL AS field FROM (SELECT doc_id, k + 100000 AS k FROM b WHERE n % 29 = 0)
UNION ALL SELECT doc_id, k, 'immutable_field_changed', 'sentence_id' FROM c WHERE n % 14 = 0
UNION ALL SELECT doc_id, k, 'immutable_field_changed', 'page' FROM c WHERE n % 11 = 0
UNION ALL SELECT doc_id, k, 'immutable_field_changed', 'sentence' FROM c WHERE n % 13 = 0
UNION ALL SELECT doc_id, k, 'immutable_field_changed', 'schema_version' FROM c WHERE n % 22 = 0
UNION ALL SELECT doc_id, k, 'immutable_field_changed', 'mapping_provenance' FROM c WHERE n % 10 = 0 AND n % 20 = 0
UNION ALL SELECT doc_id, k, 'tokens_changed', 'tokens' FROM c WHERE n % 7 = 0 AND NOT n % 5 = 0
UNION ALL SELECT doc_id, k, 'excluded_out_of_range', 'excluded' FROM c WHERE outside
UNION ALL SELECT doc_id, k, 'entity_added', 'entities' FROM c WHERE NOT outside AND len(e1) > len(e)
UNION ALL SELECT doc_id, k, 'removal_not_named', 'entities' FROM c WHERE NOT outside AND len(e1) <= len(e) AND len(e1) <> len(e) - len(gone)
UNION ALL SELECT doc_id, k, 'labels_or_colors_changed', 'entities' FROM c WHERE NOT outside AND len(e1) = len(e) - len(gone) AND len(list_filter(e1, lambda x: len(list_filter(e1, lambda y: y = x)) > len(list_filter(kept, lambda y: y = x)))) > 0""",
)
def guarded_edits(spark, d):
    """What edits may not do, by record and field."""
    return registry.edit_issues(*edited_records(spark, d))


# --- approvals ----------------------------------------------------------------------------------

KINDS = ["candidate", "curate", "approve", "evidence", "approve", "curate", "candidate", "curate", "approve", "approve"]
OWNERS = ["p0", "p1", "p2", None]


@query(
    "data_owner_approvals",
    f"""WITH e AS (SELECT user_id AS doc_id, event_id AS seq, {sql_pick(KINDS, "event_id // 3")} AS kind, {sql_pick(OWNERS, "event_id // 7")} AS actor, 'c' || (event_id // 4000) AS candidate_id,
  CASE WHEN event_id % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS decision, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'CC-BY' END AS license, CASE WHEN event_id % 8 <> 0 THEN 'fine' END AS statement FROM events),
a AS (SELECT e.*, (SELECT arg_max(m.candidate_id, m.seq) FROM e m WHERE m.doc_id = e.doc_id AND m.seq < e.seq AND m.kind = 'candidate') AS made, (SELECT max(m.seq) FROM e m WHERE m.doc_id = e.doc_id AND m.seq < e.seq AND m.kind = 'candidate') AS made_at,
  (SELECT max(m.seq) FROM e m WHERE m.doc_id = e.doc_id AND m.seq < e.seq AND m.kind = 'evidence') AS touched, (SELECT arg_max(m.candidate_id || m.decision, m.seq) FROM e m WHERE m.doc_id = e.doc_id AND m.seq < e.seq AND m.kind = 'curate') AS curated FROM e WHERE kind = 'approve'),
j AS (SELECT *, CASE WHEN actor IS NULL THEN 'unknown_person' WHEN actor = 'p1' THEN 'not_a_data_owner' WHEN made IS NULL THEN 'no_candidate' WHEN touched > made_at THEN 'candidate_stale' WHEN candidate_id <> made THEN 'other_candidate'
  WHEN coalesce(curated, '') <> made || 'accepted' THEN 'candidate_not_accepted' WHEN trim(license) = '' THEN 'license_required' WHEN statement IS NULL THEN 'statement_required' ELSE 'applied' END AS outcome FROM a)
SELECT doc_id, seq, candidate_id, outcome, outcome = 'applied' AND NOT EXISTS (SELECT 1 FROM e m WHERE m.doc_id = j.doc_id AND m.seq > j.seq AND m.kind IN ('candidate', 'evidence')) AND NOT EXISTS (SELECT 1 FROM j m WHERE m.doc_id = j.doc_id AND m.seq > j.seq AND m.outcome = 'applied') AS current FROM j""",
)
def data_owner_approvals(spark, d):
    """Approvals of candidates, judged when they were given and now."""
    e = F.col("event_id")
    rows = V.table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"),
        e.alias("seq"),
        pick(KINDS, F.floor(e / 3)).alias("kind"),
        pick(OWNERS, F.floor(e / 7)).alias("actor"),
        F.concat(F.lit("c"), F.floor(e / 4000)).alias("candidate_id"),
        F.when(e % 4 == 0, "rejected").otherwise("accepted").alias("decision"),
        F.when(e % 9 == 0, " ").otherwise("CC-BY").alias("license"),
        F.when(e % 8 != 0, "fine").alias("statement"),
    )
    people = spark.createDataFrame([("p0", ["data_owner"]), ("p1", ["curator"]), ("p2", ["curator", "data_owner"])], "person_id string, roles array<string>")
    return review_events.approvals(rows, people)
