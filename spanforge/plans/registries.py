"""Queries for registries with history, published versions and the order of released rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanforge.operators import dimensions
from spanforge.plans.expressions import documents, pick, sql_pick
from spanforge.plans.queries import query
from spanforge.session import shared_folder, table
from spanforge.sources.ordinals import order_differences, ordered_fingerprint
from spanforge.sources.versions import VersionedTable

# Events of customers, taken as people of the registry of their nation: o_orderkey gives the order, the order's text what happens.
OPS = ["add", "add", "update", "activate", "confirm", "remove", "update", "confirm", "merge"]


def registry_events(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    name = F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("c_name")))
    fields = F.struct(name.alias("name"), pick(["AIR ", "BUILDING", "  ", None], F.floor(k / 3)).alias("segment"))
    return o.select(F.col("c_nationkey").alias("registry"), k.cast("long").alias("seq"), pick(OPS, F.floor(k / 5)).alias("op"), F.when(k % 101 != 0, F.concat(F.lit("p"), F.col("c_custkey") % 60)).alias("key"), fields.alias("fields"))


EVENTS = f"""e AS (SELECT c_nationkey AS registry, o_orderkey::BIGINT AS seq, {sql_pick(OPS, "o_orderkey // 5")} AS op, CASE WHEN o_orderkey % 101 <> 0 THEN 'p' || (c_custkey % 60) END AS key,
  CASE WHEN o_orderkey % 17 <> 0 THEN trim(c_name) END AS name, nullif(trim({sql_pick(["AIR ", "BUILDING", "  ", None], "o_orderkey // 3")}), '') AS segment FROM orders JOIN customer ON o_custkey = c_custkey),
j AS (SELECT *, CASE WHEN op = 'merge' THEN 'unknown_operation' WHEN key IS NULL THEN 'key_required' WHEN op IN ('add', 'update') AND name IS NULL THEN 'name_required' WHEN op = 'add' AND there THEN 'exists' WHEN op <> 'add' AND NOT there THEN 'does_not_exist' ELSE 'applied' END AS outcome
  FROM (SELECT *, coalesce((SELECT arg_max(p.op, p.seq) FROM e p WHERE p.registry = e.registry AND p.key = e.key AND p.seq < e.seq AND ((p.op = 'add' AND p.name IS NOT NULL) OR p.op = 'remove')), 'remove') = 'add' AS there FROM e)),
g AS (SELECT *, CASE WHEN op IN ('add', 'update') THEN coalesce(name, '') || '|' || coalesce(segment, '') END AS f FROM j WHERE outcome = 'applied'),
h AS (SELECT *, op = 'add' OR op = 'remove' OR (op = 'update' AND f IS DISTINCT FROM (SELECT arg_max(p.f, p.seq) FROM g p WHERE p.registry = g.registry AND p.key = g.key AND p.seq < g.seq AND p.f IS NOT NULL)) AS changes FROM g),
v AS (SELECT *, (SELECT min(n.seq) FROM h n WHERE n.registry = h.registry AND n.key = h.key AND n.seq > h.seq AND n.changes) AS valid_to FROM h WHERE changes AND op <> 'remove'),
hist AS (SELECT registry, key, row_number() OVER (PARTITION BY registry, key ORDER BY seq) AS version, seq AS valid_from, valid_to, name, segment,
  (SELECT max(c.seq) FROM h c WHERE c.registry = v.registry AND c.key = v.key AND c.op = 'confirm' AND c.seq > v.seq AND (v.valid_to IS NULL OR c.seq < v.valid_to)) AS confirmed_at FROM v)"""


@query("registry_outcomes", f"WITH {EVENTS} SELECT registry, seq, op, outcome FROM j")
def registry_outcomes(spark, d):
    """What became of every event of the registries."""
    return dimensions.judged(registry_events(spark, d)).select("registry", "seq", "op", "outcome")


@query("registry_history", f"WITH {EVENTS} SELECT registry, key, version::INTEGER AS version, valid_from, valid_to, name, segment, confirmed_at FROM hist")
def registry_history(spark, d):
    """Every version of every person with the interval in which it held."""
    found = dimensions.history(dimensions.judged(registry_events(spark, d)))
    return found.select("registry", "key", "version", "valid_from", "valid_to", "fields.name", "fields.segment", "confirmed_at")


@query(
    "registry_current",
    f"""WITH RECURSIVE {EVENTS}, now AS (SELECT * FROM hist WHERE valid_to IS NULL),
born AS (SELECT registry, key, max(seq) AS born FROM g WHERE op = 'add' GROUP BY ALL),
gone AS (SELECT registry, key, seq FROM g WHERE op = 'remove'),
a0 AS (SELECT registry, max(seq) AS t, arg_max(key, seq) AS k FROM g WHERE op IN ('add', 'activate') GROUP BY registry),
step AS (SELECT registry, t, k, 0 AS depth FROM a0
  UNION ALL SELECT s.registry, r.seq, (SELECT arg_min(b.key, b.born) FROM born b WHERE b.registry = s.registry AND NOT EXISTS (SELECT 1 FROM gone x WHERE x.registry = b.registry AND x.key = b.key AND x.seq > b.born AND x.seq <= r.seq)), s.depth + 1
  FROM step s JOIN gone r ON r.registry = s.registry AND r.key = s.k AND r.seq > s.t AND r.seq = (SELECT min(q.seq) FROM gone q WHERE q.registry = s.registry AND q.key = s.k AND q.seq > s.t)),
act AS (SELECT registry, arg_max(coalesce(k, ''), depth) AS k FROM step GROUP BY registry)
SELECT now.registry, key, name, segment, confirmed_at IS NOT NULL AS confirmed, key = act.k AS active FROM now JOIN act USING (registry)""",
)
def registry_current(spark, d):
    """Who is there after all events, confirmed or not, and who is active; the SQL follows every removal of an active one."""
    found = dimensions.current(dimensions.judged(registry_events(spark, d)))
    return found.select("registry", "key", "fields.name", "fields.segment", "confirmed", "active")


# --- versions -----------------------------------------------------------------------------------


@query(
    "published_versions",
    """WITH v(version, action) AS (VALUES (1, 'write'), (2, 'write'), (3, 'restore'), (4, 'write'))
SELECT v.version::INTEGER AS version, action, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents, v
WHERE v.version IN (1, 3) OR (v.version = 2 AND n_chars > 500) OR (v.version = 4 AND lang = 'en') GROUP BY ALL""",
)
def published_versions(spark, d):
    """A table written, filtered, refused (its rows don't pass), restored and written again: every version as it can be read."""
    docs = documents(spark, d).select("doc_id", "lang", "source", "n_chars")
    t = VersionedTable(spark, f"{shared_folder(spark)}/published-{uuid.uuid4().hex[:12]}")
    no_empty = lambda rows: rows.filter("n_chars <= 500")
    t.write(docs)
    t.write(docs.filter("n_chars > 500"), no_empty)
    try:
        t.write(docs, no_empty)
    except ValueError:
        pass
    t.restore(1)
    t.write(docs.filter("lang = 'en'"))
    parts = [t.read(e["version"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).select(F.lit(e["version"]).alias("version"), F.lit(e["action"]).alias("action"), "source", "n", "chars") for e in t.log()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- order --------------------------------------------------------------------------------------


def released(spark, d):
    """(published, computed): rows of each source in order; some have changed places, some have other texts, a few are gone."""
    rows = documents(spark, d).select("source", F.col("doc_id").alias("ord"), F.md5(F.col("text").cast("binary")).alias("line"))
    pair = F.floor(F.col("ord") / 2)
    swapped = F.when(pair % 50 == 7, F.when(F.col("ord") % 2 == 0, F.col("ord") + 1).otherwise(F.col("ord") - 1)).otherwise(F.col("ord"))
    other = rows.filter("ord % 97 <> 5").select("source", swapped.alias("ord"), F.when(F.col("ord") % 89 == 3, F.concat("line", F.lit("x"))).otherwise(F.col("line")).alias("line"))
    return rows, other


ORDER_SQL = """p AS (SELECT source, doc_id AS ord, md5(text) AS line FROM documents),
c AS (SELECT source, CASE WHEN ord // 2 % 50 = 7 THEN ord + 1 - ord % 2 * 2 ELSE ord END AS ord, CASE WHEN ord % 89 = 3 THEN line || 'x' ELSE line END AS line FROM p WHERE ord % 97 <> 5)"""


@query(
    "order_differences",
    f"""WITH {ORDER_SQL} SELECT coalesce(p.source, c.source) AS source, coalesce(p.ord, c.ord) AS ord, CASE WHEN c.ord IS NULL THEN 'missing' WHEN p.ord IS NULL THEN 'added' ELSE 'other_row' END AS code
FROM p FULL JOIN c ON p.source = c.source AND p.ord = c.ord WHERE p.line IS DISTINCT FROM c.line""",
)
def order_differences_of_release(spark, d):
    """Where a published table and the rows at hand differ, place by place."""
    return order_differences(*released(spark, d), ["line"], "source")


@query(
    "ordered_fingerprints",
    f"WITH {ORDER_SQL}, x AS (SELECT source, md5(string_agg(ord || line, ',' ORDER BY ord)) AS h, count(*) AS n FROM p GROUP BY source), y AS (SELECT source, md5(string_agg(ord || line, ',' ORDER BY ord)) AS h, count(*) AS n FROM c GROUP BY source) SELECT source, x.n::BIGINT AS rows, y.n::BIGINT AS other_rows, x.h = y.h AS same FROM x JOIN y USING (source)",
)
def ordered_fingerprints(spark, d):
    """Whether each source has the same rows in the same order, from sums of hashes."""
    a, b = (ordered_fingerprint(t, ["line"], "source") for t in released(spark, d))
    both = a.join(b.withColumnsRenamed({"rows": "other_rows", "a": "a2", "b": "b2"}), "source")
    return both.select("source", "rows", "other_rows", ((F.col("rows") == F.col("other_rows")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).alias("same"))
