"""Queries for rules on rows: people, citations, readiness, scopes, colours, bindings, checkpoints.

The rows are made from the texts and their hashes by expressions that both engines
read alike, so what is right or wrong about a row is not known beforehand: the SQL
applies each rule to the columns, as the query does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators import colors, contract, people, registry, review_queue
from spanforge.plans.expressions import documents
from spanforge.plans.queries import query
from spanforge.session import table

#: Of each document: words of its text, hexadecimal and decimal digits of its hash.
BASE = {
    "w1": "lower(coalesce(regexp_extract(text, '([A-Za-z]+)', 1), ''))",
    "w2": "coalesce(regexp_extract(text, '[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1), '')",
    "h": "md5(coalesce(text, ''))",
    "d": "translate(md5(coalesce(text, '')), 'abcdef', '012345')",
}


def one_of(at: str, *values: str) -> str:
    """A CASE in both engines' SQL: one of some expressions by a number."""
    return f"(CASE ({at}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END)"


def made(spark, d, spec: dict[str, str]) -> DataFrame:
    base = documents(spark, d).select("doc_id", "n_chars", "lang", "source", *[F.expr(e).alias(c) for c, e in BASE.items()])
    return base.select("doc_id", *[F.expr(e).alias(c) for c, e in spec.items()])


def made_sql(name: str, spec: dict[str, str]) -> str:
    base = ", ".join(f"{e} AS {c}" for c, e in BASE.items())
    columns = ", ".join(f'{e} AS "{c}"' for c, e in spec.items())
    return f"{name} AS (SELECT doc_id, {columns} FROM (SELECT doc_id, n_chars, lang, source, {base} FROM documents))"


def parts(c: str, by: str = ",") -> Column:
    """The pieces of a text; none of an empty one, null of null."""
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, by))


def parts_sql(c: str, by: str = ",") -> str:
    return f"(CASE WHEN {c} = '' THEN [] ELSE string_split({c}, '{by}') END)"


def coded(rows: DataFrame, issues: Column) -> DataFrame:
    return rows.select("doc_id", F.explode(issues).alias("x")).select("doc_id", "x.code", "x.path")


def rules_sql(name: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{code}' AS code, '{path}' AS path FROM {name} WHERE {when}" for when, code, path in rules)


PERSON = {
    "person_id": one_of("n_chars", "'PERSON-' || upper(substr(h, 1, 4))", "'PERSON-' || substr(h, 1, 4)", "'person-A1'", "'PERSON-'", "'PERSON-' || upper(w1)", "' PERSON-A1'"),
    "name": one_of("n_chars + doc_id", "w1", "' '", "''", "w1 || ' ' || w2", "' ' || w2"),
    "email": one_of("doc_id", "w1 || '@' || w2 || '.org'", "w1 || '@' || w2", "w1 || ' ' || w2 || '@x.org'", "''", "'@x.org'", "w1 || '@@x.org'", "w1 || '@x.'"),
    "orcid": one_of("n_chars", "substr(d, 1, 4) || '-' || substr(d, 5, 4) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4)", "''", "substr(h, 1, 4) || '-' || substr(d, 5, 4) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4)", "substr(d, 1, 4) || '-' || substr(d, 5, 4) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 3) || 'X'", "substr(d, 1, 16)"),
    "roles": one_of("n_chars + 2 * doc_id", "'annotator'", "'curator,data_owner'", "''", "'king'", "'curator,' || w1", "'data_owner'", "'curator'"),
    "active_curator": "substr(h, 1, 1) < '8'",
}


@query(
    "person_rules",
    f"""WITH {made_sql("p", PERSON)}, r AS (SELECT *, {parts_sql("roles")} AS rs FROM p) """
    + rules_sql(
        "r",
        [
            ("NOT regexp_full_match(person_id, 'PERSON-[A-Z0-9]+')", "invalid_person_id", "$.person_id"),
            ("trim(name) = ''", "missing_name", "$.name"),
            ("email <> '' AND NOT regexp_full_match(email, '[^@ ]+@[^@ ]+\\.[^@ ]+')", "invalid_email", "$.email"),
            ("orcid <> '' AND NOT regexp_full_match(orcid, '[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9X]{4}')", "invalid_orcid", "$.orcid"),
            ("len(rs) = 0 OR len(list_filter(rs, lambda x: x NOT IN ('annotator', 'curator', 'data_owner'))) > 0", "invalid_role", "$.roles"),
            ("active_curator AND NOT list_contains(rs, 'curator')", "curator_role_missing", "$.active_curator"),
        ],
    ),
)
def person_rules(spark, d):
    rows = made(spark, d, PERSON).withColumn("roles", parts("roles"))
    return coded(rows, contract.person_issues())


CITATION = {
    "title": one_of("n_chars", "w1 || ' ' || w2", "' '", "''", "NULL", "w2"),
    "creators": one_of("doc_id + n_chars", "w1", "''", "w1 || ',' || w2"),
    "item_type": one_of("n_chars", "'book'", "'poster'", "'article'", "w1", "'chapter'", "'Book'", "NULL"),
    "issued_year": one_of("doc_id", "1000 + doc_id", "n_chars", "NULL", "n_chars * 7", "1999"),
    "undated": one_of("n_chars", "true", "false", "NULL", "false"),
    "citation": one_of("n_chars + 3 * doc_id", "w1", "''", "NULL", "' '", "w2"),
    "reference": one_of("n_chars + doc_id", "'https://' || w1", "''", "NULL"),
    "not_findable_reason": one_of("n_chars", "'lost'", "''", "NULL", "w1"),
}
BLANK = lambda c: f"trim(coalesce({c}, '')) = ''"


@query(
    "citation_rules",
    f"""WITH {made_sql("p", CITATION)} """
    + rules_sql(
        "p",
        [
            (BLANK("title"), "missing_source_title", "$.title"),
            ("creators = ''", "missing_source_creator", "$.creators"),
            ("item_type NOT IN ('article', 'book', 'chapter', 'paper-conference', 'report', 'webpage')", "invalid_item_type", "$.item_type"),
            ("(issued_year IS NOT NULL) = coalesce(undated, false)", "year_or_undated", "$.issued_year"),
            ("issued_year NOT BETWEEN 1000 AND 9999", "invalid_year", "$.issued_year"),
            (BLANK("citation"), "missing_citation", "$.citation"),
            ("coalesce(reference, '') = '' AND coalesce(not_findable_reason, '') = ''", "missing_findability", "$.reference"),
        ],
    ),
)
def citation_rules(spark, d):
    rows = made(spark, d, CITATION).withColumn("creators", parts("creators"))
    return coded(rows, contract.citation_issues())


VALID = {"confirmed_by": one_of("n_chars", "w1", "''", "NULL"), "program_status": one_of("doc_id + n_chars", "'valid'", "'invalid'", "NULL", "w1", "'VALID'")}


@query("citation_validity", f"WITH {made_sql('p', VALID)} SELECT doc_id, length(confirmed_by) > 0 IS TRUE OR program_status IS NOT DISTINCT FROM 'valid' AS valid FROM p")
def citation_validity(spark, d):
    return made(spark, d, VALID).select("doc_id", people.citation_valid().alias("valid"))


SCOPE = {"whole": "substr(h, 1, 1) < '8'", "pages": one_of("n_chars", "''", "NULL", "substr(d, 1, 1)", "substr(d, 1, 1) || ',' || substr(d, 2, 1)", "substr(d, 1, 1) || ',' || substr(d, 2, 2) || ',' || substr(d, 3, 3)", "'1,4'", "'-2,3'")}


@query(
    "extraction_scopes",
    f"""WITH {made_sql("p", SCOPE)}, r AS (SELECT doc_id, whole, CASE WHEN pages = '' THEN [] ELSE list_transform(string_split(pages, ','), lambda x: x::INTEGER) END AS ps FROM p)
SELECT doc_id, CASE WHEN whole THEN coalesce(len(ps), 0) = 0 ELSE coalesce(len(ps) > 0 AND len(list_filter(ps, lambda x: x < 1)) = 0 AND len(list_filter(range(2, len(ps) + 1), lambda i: ps[i] <= ps[i - 1])) = 0, false) END AS valid FROM r""",
)
def extraction_scopes(spark, d):
    rows = made(spark, d, SCOPE)
    return rows.select("doc_id", contract.scope_is_valid(F.col("whole"), parts("pages").cast("array<int>")).alias("valid"))


DAY = lambda at: one_of(at, "'2020-01-01'", "NULL", "'2021-03-04'")
READY = {
    "title": one_of("n_chars", "w1", "''", "NULL", "w2", "w1"),
    "creators": one_of("doc_id", "w1", "''", "w1 || ',' || w2", "NULL"),
    "citation": one_of("n_chars + doc_id", "w1", "' '", "NULL", "w2"),
    "reference": one_of("n_chars", "w1", "''", "NULL"),
    "not_findable_reason": one_of("doc_id", "'lost'", "NULL", "' '"),
    "citation_validated": one_of("n_chars", "true", "false", "NULL", "true"),
    "annotators": one_of("n_chars + 2 * doc_id", "w1", "''", "NULL", "w2"),
    "method": one_of("doc_id", "w1", "NULL", "w2", "' '", "w1"),
    "extractor": one_of("n_chars", "w1", "w2", "NULL", "''", "w1"),
    "extractor_version": one_of("n_chars + doc_id", "substr(d, 1, 2)", "''", "NULL"),
    "extracted_at": DAY("n_chars"),
    "sentence_approval_required": one_of("doc_id + n_chars", "true", "true", "false", "NULL"),
    "review_complete": "substr(h, 1, 1) < 'a'",
    "reviewed_at": DAY("doc_id + n_chars"),
    "colors": one_of("n_chars", "''", "'#FF0000|age|approved|'", "'#FF0000||approved|;#00FF00||pending|'", "'#' || upper(substr(h, 1, 6)) || '||ignored|' || substr(w1, 1, 1)", "'#00FF00||ignored|;#0000FF|' || w1 || '|approved|;#000000||pending|'", "NULL"),
    "colors_confirmed": one_of("doc_id", "true", "false", "NULL", "true", "true"),
    "confirmed_by": one_of("n_chars + doc_id", "w1", "''", "NULL", "w2"),
    "confirmed_at": DAY("n_chars + 2 * doc_id"),
    "resources": one_of("n_chars", "'a.json'", "''", "NULL", "'a.json,b.json'"),
}
NO = lambda c: f"NOT coalesce({c}, false)"
NONE = lambda c: f"coalesce({c}, '') = ''"
READY_RULES = [
    (BLANK("title"), "missing_source_title"),
    (NONE("creators"), "missing_source_creator"),
    (BLANK("citation"), "missing_citation"),
    (f"{BLANK('reference')} AND {BLANK('not_findable_reason')}", "missing_findability"),
    (f"{BLANK('reference')} AND NOT {BLANK('not_findable_reason')}", "source_not_findable"),
    (NO("citation_validated"), "citation_not_validated"),
    (NONE("annotators"), "missing_original_annotator"),
    (BLANK("method"), "missing_extraction_method"),
    (BLANK("extractor"), "missing_extractor"),
    (BLANK("extractor_version"), "missing_extractor_version"),
    ("extracted_at IS NULL", "missing_extraction_date"),
    (NO("sentence_approval_required"), "sentence_approval_not_required"),
    (NO("review_complete"), "annotation_review_incomplete"),
    ("reviewed_at IS NULL", "missing_review_date"),
    (NONE("colors"), "missing_color_mapping"),
    (f"NOT {NONE('colors')} AND {NO('colors_confirmed')}", "color_mapping_unconfirmed"),
    (f"coalesce(colors_confirmed, false) AND {BLANK('confirmed_by')}", "missing_color_confirmation_person"),
    ("coalesce(colors_confirmed, false) AND confirmed_at IS NULL", "missing_color_confirmation_date"),
    (NONE("resources"), "missing_annotations_resource"),
]
NOT_BLOCKING = ", ".join(f"'{c}'" for c in ["source_not_findable", *contract.CITATION_CODES])


@query(
    "readiness_rules",
    f"""WITH {made_sql("p", READY)}, c AS (SELECT doc_id, i, string_split(cs[i + 1], '|') AS x FROM (SELECT doc_id, cs, unnest(range(0, len(cs))) AS i FROM (SELECT doc_id, {parts_sql("colors", ";")} AS cs FROM p))),
f AS ({rules_sql("p", [(when, code, "$") for when, code in READY_RULES])}
UNION ALL SELECT doc_id, 'color_pending_review', '$.colors[' || i || ']' FROM c WHERE x[3] = 'pending'
UNION ALL SELECT doc_id, 'approved_color_missing_label', '$.colors[' || i || ']' FROM c WHERE x[3] = 'approved' AND x[2] = ''
UNION ALL SELECT doc_id, 'ignored_color_missing_reason', '$.colors[' || i || ']' FROM c WHERE x[3] = 'ignored' AND x[4] = '')
SELECT doc_id, code, path, code NOT IN ({NOT_BLOCKING}) AS blocking FROM f""",
)
def readiness_rules(spark, d):
    """All codes of a document's readiness, and whether each blocks curation."""
    piece = lambda x, k: F.when(F.get(F.split(x, r"\|"), k) != "", F.get(F.split(x, r"\|"), k))
    color = lambda x: F.struct(*[piece(x, k).alias(n) for k, n in enumerate(("hex", "label", "status", "reason"))])
    rows = made(spark, d, READY).withColumns({"colors": F.transform(parts("colors", ";"), color), **{c: parts(c) for c in ("creators", "annotators", "resources")}})
    found = coded(rows, contract.readiness_issues())
    stop = contract.blocking(found).select("doc_id", "code", "path", F.lit(True).alias("blocking")).distinct()
    return found.join(stop, ["doc_id", "code", "path"], "left").select("doc_id", "code", "path", F.coalesce("blocking", F.lit(False)).alias("blocking"))


GATES = {
    "active_curator": one_of("n_chars", "true", "false", "NULL", "true", "true"),
    "original_annotators": one_of("doc_id", "w1", "''", "NULL", "w2"),
    "human_confirmed": "substr(h, 1, 1) < 'c'",
    "title": one_of("n_chars", "w1", "' '", "w2", "w1"),
    "creators": one_of("n_chars + doc_id", "w1", "w2", "''", "w1"),
    "citation_text": one_of("n_chars", "w1", "w2", "NULL"),
    "reference": one_of("doc_id", "w1", "''", "NULL"),
    "not_findable_reason": one_of("n_chars + doc_id", "NULL", "'lost'"),
    "colors_confirmed": one_of("n_chars", "true", "true", "false", "NULL"),
    "color_statuses": one_of("doc_id + 2 * n_chars", "'approved'", "'approved,ignored'", "''", "'approved,pending'", "NULL", "'ignored'"),
    "resource_count": "n_chars % 5",
    "n_records": one_of("doc_id", "n_chars % 5", "NULL", "n_chars % 5", "n_chars % 5 + 1"),
    "n_reviewed": one_of("n_chars + doc_id", "n_chars % 5", "n_chars % 5", "NULL"),
    "n_decided": one_of("n_chars", "n_chars % 5", "n_chars % 5", "0"),
}
FILLED = lambda c: f"coalesce({c}, '') <> ''"


@query(
    "readiness_gates",
    f"""WITH {made_sql("p", GATES)}, g AS (SELECT doc_id, coalesce(active_curator, false) AS curator, coalesce(original_annotators, '') <> '' AS original_annotator,
coalesce(human_confirmed, false) AND {FILLED("title")} AND coalesce(creators, '') <> '' AND {FILLED("citation_text")} AND ({FILLED("reference")} OR {FILLED("not_findable_reason")}) AS citation,
coalesce(colors_confirmed, false) AND coalesce(color_statuses, '') <> '' AND coalesce(len(list_filter(string_split(color_statuses, ','), lambda x: x NOT IN ('approved', 'ignored'))) = 0, false) AS color_configuration,
coalesce(n_records, 0) > 0 AND coalesce(resource_count = n_records, false) AS extraction, coalesce(n_records, 0) > 0 AND coalesce(n_reviewed = n_records AND n_decided = n_records, false) AS sentence_review FROM p)
SELECT *, concat_ws('|', {", ".join(f"CASE WHEN NOT {g} THEN '{text}' END" for g, text in review_queue.REASONS.items() if text)}) AS reasons FROM g""",
)
def readiness_gates(spark, d):
    rows = made(spark, d, GATES).withColumns({c: parts(c) for c in ("original_annotators", "creators", "color_statuses")})
    return review_queue.gates(rows).select("doc_id", *review_queue.REASONS, F.array_join("reasons", "|").alias("reasons"))


PALETTE = {"seen": "'#' || substr(h, 1, 2)", "decided": one_of("n_chars", "'#' || upper(substr(h, 1, 2))", "'#' || substr(h, 3, 3)", "'#' || substr(h, 1, 2)"), "label": one_of("doc_id", "'age'", "NULL"), "reason": one_of("n_chars + 2 * doc_id", "NULL", "'odd'", "NULL"), "made": "substr(h, 4, 1) < '2'"}


@query(
    "colour_decisions",
    f"""WITH {made_sql("p", PALETTE)}, s AS (SELECT DISTINCT upper(seen) AS hex FROM p), m AS (SELECT upper(decided) AS hex, count(*) AS n, count(*) FILTER ((label IS NULL) = (reason IS NULL)) AS odd FROM p WHERE made GROUP BY 1)
SELECT hex, 'missing_decision' AS code FROM s ANTI JOIN m USING (hex) UNION ALL SELECT hex, 'unknown_color' FROM m ANTI JOIN s USING (hex)
UNION ALL SELECT hex, 'duplicate_decision' FROM m WHERE n > 1 UNION ALL SELECT hex, 'label_xor_reason' FROM m WHERE odd > 0""",
)
def colour_decisions(spark, d):
    rows = made(spark, d, PALETTE)
    return colors.decision_issues(rows.select(F.col("seen").alias("hex")), rows.filter("made").select(F.col("decided").alias("hex"), "label", "reason"))


BOUND = {
    "source_path": "source || '/' || substr(h, 1, 3)",
    "binding": one_of("n_chars", "'project'", "'external'", "'project'"),
    "checksum": "substr(h, 4, 1)",
    "outside": "lang || '/' || substr(h, 5, 3)",
    "is_bound": "substr(h, 8, 1) < '8'",
    "is_there": "substr(h, 9, 1) < 'b'",
    "observed": "CASE WHEN substr(h, 10, 1) < 'c' THEN substr(h, 4, 1) ELSE substr(h, 11, 1) END",
}


@query(
    "bound_sources",
    f"""WITH {made_sql("p", BOUND)}, e AS (SELECT doc_id, checksum, CASE WHEN binding = 'project' THEN source_path WHEN is_bound THEN outside END AS path FROM p),
f AS (SELECT CASE WHEN binding = 'project' THEN source_path ELSE outside END AS path, min(observed) AS observed FROM p WHERE is_there GROUP BY 1)
SELECT doc_id AS document_id, e.path, CASE WHEN e.path IS NULL THEN 'unbound' WHEN observed IS NULL THEN 'missing' WHEN observed <> checksum THEN 'changed' END AS problem FROM e LEFT JOIN f ON e.path = f.path""",
)
def bound_sources(spark, d):
    rows = made(spark, d, BOUND)
    entries = rows.select(F.col("doc_id").alias("document_id"), "source_path", "binding", "checksum")
    bindings = rows.filter("is_bound").select(F.col("doc_id").alias("document_id"), F.col("outside").alias("path"))
    place = F.when(F.col("binding") == "project", F.col("source_path")).otherwise(F.col("outside"))
    found = rows.filter("is_there").groupBy(place.alias("path")).agg(F.min("observed").alias("observed_checksum"))
    return registry.bound_sources(entries, bindings, found).select("document_id", "path", "problem")


KEPT = {
    "source_sha256": "h",
    "mapping_sha256": "lang",
    "records": "n_chars",
    "old_source": "CASE WHEN substr(h, 1, 1) < 'c' THEN h ELSE lang END",
    "old_mapping": one_of("n_chars", "lang", "lang", "source", "lang", "upper(lang)"),
    "old_records": "n_chars + CASE WHEN substr(h, 2, 1) < 'd' THEN 0 ELSE 1 END",
    "was_there": "substr(h, 3, 1) < 'd'",
}


@query("reusable_checkpoints", f"WITH {made_sql('p', KEPT)} SELECT doc_id::VARCHAR AS document_id, was_there AND old_source = source_sha256 AND old_mapping = mapping_sha256 AND old_records = records AS reuse FROM p")
def reusable_checkpoints(spark, d):
    rows = made(spark, d, KEPT).withColumn("document_id", F.col("doc_id").cast("string"))
    old = rows.filter("was_there").select("document_id", F.col("old_source").alias("source_sha256"), F.col("old_mapping").alias("mapping_sha256"), F.col("old_records").alias("records"))
    return registry.reusable(old, rows.select("document_id", "source_sha256", "mapping_sha256", "records")).select("document_id", "reuse")


@query("complete_join", "SELECT c_custkey AS example_id, n, c_name FROM customer JOIN (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def complete_join(spark, d):
    """Numbers of orders and the customers that have some: neither side has a key that the other lacks."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("example_id")).agg(F.count(F.lit(1)).alias("n"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("example_id"), "c_name")
    return registry.complete_join(orders, customers.join(orders, "example_id", "left_semi"))


# --- packages ------------------------------------------------------------------------------------


def by_digit(at: int, *cases: tuple[str, str], other: str) -> str:
    """A CASE on a hexadecimal digit of the hash: the value of the first case whose bound lies above it."""
    return f"(CASE {' '.join(f"WHEN substr(h, {at}, 1) < '{bound}' THEN {value}" for bound, value in cases)} ELSE {other} END)"


STATE = lambda at: by_digit(at, ("1", "'unreadable'"), ("2", "'invalid_json'"), ("4", "'invalid'"), ("5", "'missing'"), other="'ok'")
PACKAGE = {
    "h": "h",
    "record_count": one_of("n_chars", "2", "2", "3", "1", "0"),
    "source_state": by_digit(1, ("2", "'missing'"), ("4", "'changed'"), other="'current'"),
    "ids": one_of("n_chars", "'1,2'", "'1,2'", "'1,2,2'", "'1'", "''", "'2,1'", "'1,3'"),
    "reviewed": one_of("n_chars + doc_id", "'1,2'", "'1,2'", "'1'", "'1,2,3'", "''"),
    **{f: STATE(2 + k) for k, f in enumerate(registry.PACKAGE_FILES)},
    "named": by_digit(6, ("3", "'other'"), other="'same'"),
    "resource": by_digit(7, ("3", "'a.json'"), other="'annotations.json'"),
    "absent": by_digit(8, ("2", "true"), other="false"),
}


def packages(spark, d):
    """(metadata, records, reviews, files) of a package for each document; what is wrong follows from the hash of its text."""
    rows = made(spark, d, PACKAGE).withColumn("document_id", F.col("doc_id").cast("string"))
    sentence = lambda c: rows.select("document_id", "h", F.explode(parts(c)).alias("sentence_id"))
    at = lambda n, width=1: F.substr("h", F.col("sentence_id").cast("int") * 2 + n, F.lit(width))
    records = sentence("ids").select("document_id", "sentence_id", at(8, 2).alias("record_sha256"))
    status = F.when(at(16) < "2", "pending").when(at(16) < "3", "odd").when(at(16) < "4", "needs_correction").when(at(16) < "9", "excluded").otherwise("approved")
    reviews = sentence("reviewed").select("document_id", "sentence_id", F.when(at(17) < "2", "old").otherwise(at(8, 2)).alias("record_sha256"), status.alias("status"))
    named = F.when(F.col("named") == "same", F.col("document_id")).otherwise(F.col("named"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("file"), F.col(f).alias("state")) for f in registry.PACKAGE_FILES])).alias("f")
    files = rows.select("document_id", "absent", named.alias("named_document"), F.col("resource").alias("resource_path"), each).filter("not (absent and f.file = 'annotations')")
    return rows.select("document_id", F.col("record_count").cast("long").alias("record_count"), "source_state"), records, reviews, files.select("document_id", "f.file", "f.state", "named_document", "resource_path")


PACKAGE_SQL = f"""{made_sql("p", PACKAGE)}, m AS (SELECT doc_id::VARCHAR AS document_id, * FROM p),
rec AS (SELECT document_id, id, substr(h, id::INT * 2 + 8, 2) AS sha FROM (SELECT document_id, h, unnest({parts_sql("ids")}) AS id FROM m)),
rev AS (SELECT document_id, id, CASE WHEN substr(h, id::INT * 2 + 17, 1) < '2' THEN 'old' ELSE substr(h, id::INT * 2 + 8, 2) END AS sha,
  CASE WHEN c < '2' THEN 'pending' WHEN c < '3' THEN 'odd' WHEN c < '4' THEN 'needs_correction' WHEN c < '9' THEN 'excluded' ELSE 'approved' END AS status FROM (SELECT *, substr(h, id::INT * 2 + 16, 1) AS c FROM (SELECT document_id, h, unnest({parts_sql("reviewed")}) AS id FROM m))),
fl AS (SELECT document_id, file, CASE WHEN absent AND file = 'annotations' THEN 'missing' ELSE state END AS state, CASE WHEN named = 'same' THEN document_id ELSE named END AS named, resource FROM (
  {" UNION ALL ".join(f"SELECT document_id, absent, named, resource, '{f}' AS file, {f} AS state FROM m" for f in registry.PACKAGE_FILES)})),
issues AS (SELECT document_id, CASE state WHEN 'missing' THEN 'missing_package_file' WHEN 'unreadable' THEN 'unreadable_package_file' ELSE 'invalid_json' END AS code FROM fl WHERE state IN ('missing', 'unreadable', 'invalid_json')
UNION SELECT document_id, CASE file WHEN 'package_metadata' THEN 'invalid_package_metadata' WHEN 'annotations' THEN 'invalid_annotations_document' ELSE 'invalid_review_state' END FROM fl WHERE state = 'invalid'
UNION SELECT document_id, CASE file WHEN 'package_metadata' THEN 'metadata_document_mismatch' ELSE 'review_document_mismatch' END FROM fl WHERE state = 'ok' AND named <> document_id AND file <> 'annotations'
UNION SELECT document_id, 'annotation_resource_mismatch' FROM fl WHERE file = 'package_metadata' AND state = 'ok' AND resource <> 'annotations.json'
UNION SELECT document_id, CASE source_state WHEN 'missing' THEN 'source_missing' ELSE 'source_not_current' END FROM m WHERE source_state <> 'current'
UNION SELECT m.document_id, 'annotation_count_mismatch' FROM m WHERE record_count <> (SELECT count(*) FROM rec WHERE rec.document_id = m.document_id)
  AND EXISTS (SELECT 1 FROM fl WHERE fl.document_id = m.document_id AND file = 'package_metadata' AND state = 'ok') AND EXISTS (SELECT 1 FROM fl WHERE fl.document_id = m.document_id AND file = 'annotations' AND state IN ('ok', 'invalid'))
UNION SELECT document_id, 'duplicate_sentence_id' FROM rec GROUP BY document_id, id HAVING count(*) > 1
UNION SELECT x.document_id, 'review_annotation_mismatch' FROM (SELECT coalesce(rec.document_id, rev.document_id) AS document_id FROM rec FULL JOIN rev ON rec.document_id = rev.document_id AND rec.id = rev.id WHERE rec.id IS NULL OR rev.id IS NULL) x
  WHERE EXISTS (SELECT 1 FROM fl WHERE fl.document_id = x.document_id AND file = 'review_state' AND state = 'ok')
UNION SELECT rec.document_id, 'stale_sentence_review' FROM rec JOIN rev ON rec.document_id = rev.document_id AND rec.id = rev.id WHERE rec.sha <> rev.sha
UNION SELECT document_id, 'sentence_review_incomplete' FROM rev WHERE status IN ('pending', 'needs_correction')
UNION SELECT document_id, 'invalid_review_state' FROM rev WHERE status = 'odd')"""


@query("package_issues", f"WITH {PACKAGE_SQL} SELECT document_id, code FROM issues")
def package_issues(spark, d):
    return registry.package_issues(*packages(spark, d))


@query(
    "project_summary",
    f"WITH {PACKAGE_SQL}, n AS (SELECT document_id, count(*) AS n FROM issues GROUP BY document_id) SELECT count(*)::BIGINT AS documents, count(*) FILTER (n IS NULL)::BIGINT AS valid, coalesce(sum(n), 0)::BIGINT AS issues, bool_and(n IS NULL) AS all_valid, bool_and(n IS NULL) AS release_ready FROM m LEFT JOIN n USING (document_id)",
)
def project_summary(spark, d):
    meta, *rest = packages(spark, d)
    return registry.project_summary(meta, registry.package_issues(meta, *rest))
