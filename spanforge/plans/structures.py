"""Queries for records in JSON: their shape, the contract's rules, and states of whole files."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions.vocabulary import VALUES
from spanforge.operators import contract
from spanforge.plans.expressions import documents, pick, sql_pick
from spanforge.plans.queries import query
from spanforge.sources import packages

# A record of each document: its first characters as the sentence, and fields that vary each by itself, right and wrong.
# @S stands for the sentence, @W for its first word, @L for the word's length.
PARTS = [
    ('{"sentence_id":@N', "doc_id", ["@N", "@N", "@N", "0", '"1"', "1.5", "null"]),
    (',"page":', "n_chars // 7", ["1", "2", "3", "-4", "true"]),
    (',"sentence":', "n_chars // 3", ['"@S"', '"@S"', '"@S"', '"@S"', "7"]),
    ("", "n_chars", ["", ',"curated_sentence":null', ',"curated_sentence":" "', ',"curated_sentence":"@S!"', ',"curated_sentence":"@S"', ""]),
    (',"tokens":', "n_chars // 5", ['["a","b"]', '["a","b"]', '["a"]', '["a",null]', "[1,\"b\"]", '["a","b"]']),
    (',"values":', "n_chars // 2", ['["age"]', "[]", '["age","social"]', '["beauty"]', '["age","age"]', '["age",7]', '"age"']),
    (
        ',"entities":',
        "n_chars // 11",
        [
            '[{"start":0,"end":@L,"text":"@W","label":"age"}]',
            "[]",
            '[{"start":0,"end":@L,"text":"@W","label":"social","color":"#12aBff"},{"start":1,"end":99,"text":"@W","label":"age","color":null}]',
            '[{"start":0,"end":1,"text":"@W","label":"age","color":"red"}]',
            '[{"start":2,"end":2,"text":"","label":"nonsense"}]',
            "[{}]",
            "[null]",
            '[{"start":0.5,"end":@L,"text":"@W","label":"age","more":1}]',
            '{"start":0}',
        ],
    ),
    (',"ner_tags":', "n_chars // 13", ['["B-age","I-age"]', '["O","O"]', '["I-age","O"]', '["B-age","I-social"]', '["B-zzz","I-zzz"]', '["O"]', '["age","X-age"]', '["O",null]']),
    ("", "n_chars // 17", ["", ',"schema_version":"1.0"', ',"schema_version":"9"', ',"schema_version":null', "", ',"zzz":[]']),
    (
        "",
        "n_chars // 19",
        ["", ',"mapping_provenance":null', ',"mapping_provenance":{"method":"","status":"approved"}', ',"mapping_provenance":{"method":"m","status":"x","config_id":null}', ',"mapping_provenance":{"zzz":1,"method":"m","config_id":2}', "", ""],
    ),
]
SENTENCE = r"""[^\p{L}\p{N} .,;:!?'-]"""


def record_json(d):
    """(doc_id, json): a record in JSON for each document."""
    sentence = F.regexp_replace(F.substring("text", 1, 60), SENTENCE, "")
    word = F.regexp_extract(F.col("sentence"), "^[^ ]*", 0)
    text = F.concat(*[F.concat(F.lit(head.replace("@N", "")), pick(values, F.expr(at.replace("//", "div")))) for head, at, values in PARTS], F.lit("}"))
    filled = text
    for mark, value in (("@N", F.col("doc_id").cast("string")), ("@S", F.col("sentence")), ("@L", F.length(word).cast("string")), ("@W", word)):
        filled = F.replace(filled, F.lit(mark), value)
    return d.withColumn("sentence", sentence).select("doc_id", filled.alias("json"))


def record_json_sql() -> str:
    text = " || ".join(f"'{head.replace('@N', '')}' || {sql_pick(values, at)}" for head, at, values in PARTS) + " || '}'"
    for mark, value in (("@N", "doc_id::VARCHAR"), ("@S", "sentence"), ("@L", "length(regexp_extract(sentence, '^[^ ]*'))::VARCHAR"), ("@W", "regexp_extract(sentence, '^[^ ]*')")):
        text = f"replace({text}, '{mark}', {value})"
    clean = SENTENCE.replace("'", "''")
    return f"j AS (SELECT doc_id, ({text})::JSON AS j FROM (SELECT doc_id, n_chars, regexp_replace(text[1:60], '{clean}', '', 'g') AS sentence FROM documents))"


def _type(path: str, kinds: str) -> str:
    """A path, given as SQL, where the JSON there has none of some types."""
    types = {"int": "('BIGINT', 'UBIGINT')", "text": "('VARCHAR')", "text?": "('VARCHAR', 'NULL')", "list": "('ARRAY')", "object": "('OBJECT')", "object?": "('OBJECT', 'NULL')"}[kinds]
    return f"CASE WHEN json_type(j, {path}) IS NULL OR json_type(j, {path}) NOT IN {types} THEN {path} END"


def _maybe(path: str, kinds: str) -> str:
    return f"CASE WHEN json_exists(j, {path}) THEN {_type(path, kinds)} END"


TOP = {"sentence_id": "int", "page": "int", "sentence": "text", "tokens": "list", "values": "list", "entities": "list", "ner_tags": "list"}
MAY = {"curated_sentence": "text?", "schema_version": "text", "mapping_provenance": "object?"}
NAMED = {"start": "int", "end": "int", "text": "text", "label": "text"}
E = "'$.entities[' || i || ']"
SHAPE_SQL = f"""
e AS (SELECT doc_id, j, i FROM (SELECT doc_id, j, unnest(range(0, json_array_length(j, '$.entities')::BIGINT)) AS i FROM j WHERE json_type(j, '$.entities') = 'ARRAY')),
eo AS (SELECT * FROM e WHERE json_type(j, {E}') = 'OBJECT'),
l AS (SELECT doc_id, j, '$.' || k || '[' || unnest(range(0, json_array_length(j, '$.' || k)::BIGINT)) || ']' AS path FROM j, (VALUES ('tokens'), ('values'), ('ner_tags')) AS x(k) WHERE json_type(j, '$.' || k) = 'ARRAY'),
m AS (SELECT doc_id, j FROM j WHERE json_type(j, '$.mapping_provenance') = 'OBJECT'),
shape AS (SELECT doc_id, 'invalid_type' AS code, path FROM (
SELECT doc_id, unnest([{", ".join([_type(f"'$.{k}'", t) for k, t in TOP.items()] + [_maybe(f"'$.{k}'", t) for k, t in MAY.items()])}]) AS path FROM j
UNION ALL SELECT doc_id, '$.' || k FROM (SELECT doc_id, unnest(json_keys(j)) AS k FROM j) WHERE k NOT IN ({", ".join(f"'{k}'" for k in [*TOP, *MAY])})
UNION ALL SELECT doc_id, {_type("path", "text")} FROM l
UNION ALL SELECT doc_id, {_type(E + "'", "object")} FROM e
UNION ALL SELECT doc_id, unnest([{", ".join([_type(f"{E}.{k}'", t) for k, t in NAMED.items()] + [_maybe(f"{E}.color'", "text?")])}]) FROM eo
UNION ALL SELECT doc_id, {E}.' || k FROM (SELECT doc_id, i, unnest(json_keys(j, {E}')) AS k FROM eo) WHERE k NOT IN ('start', 'end', 'text', 'label', 'color')
UNION ALL SELECT doc_id, unnest([{_type("'$.mapping_provenance.method'", "text")}, {_type("'$.mapping_provenance.status'", "text")}, {_maybe("'$.mapping_provenance.config_id'", "text?")}]) FROM m
UNION ALL SELECT doc_id, '$.mapping_provenance.' || k FROM (SELECT doc_id, unnest(json_keys(j, '$.mapping_provenance')) AS k FROM m) WHERE k NOT IN ('method', 'status', 'config_id')
) WHERE path IS NOT NULL)"""


@query("structural_issues", f"WITH {record_json_sql()}, {SHAPE_SQL} SELECT doc_id, path FROM shape")
def structural_issues(spark, d):
    """Paths of all nodes of records in JSON that have another type than the record's shape."""
    rows = record_json(documents(spark, d))
    return rows.select("doc_id", F.explode(contract.structural(F.col("json"))).alias("x")).select("doc_id", F.col("x.path").alias("path"))


LABELS = "(" + ", ".join(f"'{v}'" for v in VALUES) + ")"
TEXTS = lambda k: f"from_json(json_extract(j, '$.{k}'), '[\"VARCHAR\"]')"
RULES_SQL = f"""
good AS (SELECT doc_id, j, (j ->> '$.sentence_id')::BIGINT AS sid, (j ->> '$.page')::BIGINT AS page, j ->> '$.sentence' AS s, j ->> '$.curated_sentence' AS c, {TEXTS("tokens")} AS tokens, {TEXTS("values")} AS vals, {TEXTS("ner_tags")} AS tags,
         from_json(json_extract(j, '$.entities'), '[{{"start":"BIGINT","end":"BIGINT","text":"VARCHAR","label":"VARCHAR","color":"VARCHAR"}}]') AS ents FROM j ANTI JOIN shape USING (doc_id)),
g AS (SELECT *, CASE WHEN c IS NOT NULL AND c <> s AND c <> '' THEN c ELSE s END AS eff, list_distinct(list_transform(ents, lambda x: x.label)) AS elabels FROM good),
ent AS (SELECT doc_id, eff, i, ents[i + 1] AS x FROM (SELECT doc_id, eff, ents, unnest(range(0, len(ents))) AS i FROM g)),
t AS (SELECT doc_id, tags, i, tags[i + 1] AS tag, tags[i] AS before FROM (SELECT doc_id, tags, unnest(range(0, len(tags))) AS i FROM g)),
tp AS (SELECT *, tag[1:instr(tag, '-') - 1] AS prefix, CASE WHEN instr(tag, '-') > 0 THEN tag[instr(tag, '-') + 1:] END AS label,
       before IS NOT NULL AND instr(before, '-') > 0 AND before[1:instr(before, '-') - 1] IN ('B', 'I') AND before[instr(before, '-') + 1:] = tag[instr(tag, '-') + 1:] AS follows FROM t WHERE tag <> 'O'),
tagged AS (SELECT doc_id, list(DISTINCT label) AS labels FROM tp WHERE prefix IN ('B', 'I') AND label IN {LABELS} GROUP BY doc_id),
rules AS (
SELECT doc_id, 'invalid_curated_sentence' AS code, '$.curated_sentence' AS path FROM g WHERE c <> s AND trim(c) = ''
UNION ALL SELECT doc_id, 'unknown_label', {E}.label' FROM ent WHERE x.label NOT IN {LABELS}
UNION ALL SELECT doc_id, 'invalid_color', {E}.color' FROM ent WHERE NOT regexp_full_match(x.color, '#[0-9A-Fa-f]{{6}}')
UNION ALL SELECT doc_id, CASE WHEN x.start < 0 OR x."end" <= x.start OR x."end" > length(eff) THEN 'invalid_entity_offset' ELSE 'entity_text_mismatch' END, {E}' FROM ent
          WHERE x.start < 0 OR x."end" <= x.start OR x."end" > length(eff) OR eff[x.start + 1:x."end"] <> x.text
UNION ALL SELECT doc_id, 'invalid_type', '$.sentence_id' FROM g WHERE sid < 1
UNION ALL SELECT doc_id, 'invalid_type', '$.page' FROM g WHERE page < 1
UNION ALL SELECT doc_id, 'unsupported_schema_version', '$.schema_version' FROM g WHERE coalesce(j ->> '$.schema_version', '0.1') NOT IN ('0.1', '1.0')
UNION ALL SELECT doc_id, 'invalid_type', '$.mapping_provenance.method' FROM g WHERE j ->> '$.mapping_provenance.method' = ''
UNION ALL SELECT doc_id, 'invalid_mapping_status', '$.mapping_provenance.status' FROM g WHERE j ->> '$.mapping_provenance.status' NOT IN ('pending_review', 'approved')
UNION ALL SELECT doc_id, 'unknown_label', '$.values[' || i || ']' FROM (SELECT doc_id, vals, unnest(range(0, len(vals))) AS i FROM g) WHERE vals[i + 1] NOT IN {LABELS}
UNION ALL SELECT doc_id, 'token_tag_length_mismatch', '$.ner_tags' FROM g WHERE len(tokens) <> len(tags)
UNION ALL SELECT doc_id, 'invalid_bio_tag', '$.ner_tags[' || i || ']' FROM tp WHERE NOT (prefix IN ('B', 'I') AND coalesce(label IN {LABELS}, false))
UNION ALL SELECT doc_id, 'invalid_bio_transition', '$.ner_tags[' || i || ']' FROM tp WHERE prefix = 'I' AND label IN {LABELS} AND NOT follows
UNION ALL SELECT doc_id, 'value_entity_mismatch', '$.values' FROM g WHERE list_sort(list_distinct(vals)) <> list_sort(elabels)
UNION ALL SELECT doc_id, 'bio_value_mismatch', '$.ner_tags' FROM g LEFT JOIN tagged USING (doc_id) WHERE list_sort(list_distinct(vals)) <> list_sort(coalesce(labels, [])))"""


def record_files(spark, d):
    """(doc_id, utf8, value): a file for each document, most a list of its record; some are cut short or spoilt somewhere, some are no list."""
    rows = record_json(documents(spark, d).select("doc_id", "text", "n_chars"))
    i = F.col("doc_id")
    whole = F.concat(F.lit("[\n "), "json", F.when(i % 3 == 0, F.lit(",\n 5")).otherwise(F.lit("")), F.lit("]"))
    spoilt = F.when(i % 7 == 3, F.substr(whole, F.lit(1), (i % 150 + 1).cast("int"))).when(i % 11 == 4, F.replace(whole, F.lit('"tokens"'), F.lit('tokens"'))).when(i % 13 == 5, F.concat(whole, F.lit("\n]"))).when(i % 17 == 6, F.col("json")).otherwise(whole)
    return rows.select("doc_id", F.lit(True).alias("utf8"), spoilt.alias("value"))


FILES_SQL = f"""{record_json_sql()}, {SHAPE_SQL}, {RULES_SQL},
found AS (SELECT * FROM shape UNION ALL SELECT * FROM rules),
f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN w[1:doc_id % 150 + 1] WHEN doc_id % 11 = 4 THEN replace(w, '"tokens"', 'tokens"') WHEN doc_id % 13 = 5 THEN w || chr(10) || ']' WHEN doc_id % 17 = 6 THEN j::VARCHAR ELSE w END AS value
      FROM (SELECT doc_id, j, '[' || chr(10) || ' ' || j::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN ',' || chr(10) || ' 5' ELSE '' END || ']' AS w FROM j))"""


@query(
    "record_findings",
    f"""WITH {FILES_SQL}, k AS (SELECT doc_id, json_valid(value) AS ok, CASE WHEN json_valid(value) THEN json_type(value) END AS kind FROM f),
lists AS (SELECT doc_id FROM k WHERE ok AND kind = 'ARRAY')
SELECT doc_id, 0::INTEGER AS record, code, path FROM found SEMI JOIN lists USING (doc_id)
UNION ALL SELECT doc_id, 1, 'invalid_type', '$' FROM lists WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, -1, 'invalid_document', '$' FROM k WHERE ok AND kind <> 'ARRAY'
UNION ALL SELECT doc_id, -1, 'invalid_json', '$' FROM k WHERE NOT ok""",
)
def record_findings(spark, d):
    """Every issue of files of records: of the file, of a record's shape, or of the contract."""
    found = packages.findings(packages.parsed_records(record_files(spark, d)))
    return found.select("doc_id", F.coalesce("i", F.lit(-1)).alias("record"), "code", F.col("place").alias("path"))


@query(
    "validated_files",
    f"""WITH {FILES_SQL}, k AS (SELECT doc_id, json_valid(value) AS ok, CASE WHEN json_valid(value) THEN json_type(value) END AS kind FROM f),
n AS (SELECT doc_id, ok, kind, CASE WHEN NOT ok THEN 0 WHEN kind <> 'ARRAY' THEN 1 ELSE coalesce(c.n, 0) + (doc_id % 3 = 0)::INT END AS issues FROM k LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) c USING (doc_id))
SELECT doc_id, CASE WHEN NOT ok THEN 'parse_error' WHEN issues > 0 THEN 'invalid' ELSE 'valid' END AS state, CASE WHEN ok AND kind = 'ARRAY' THEN 1 + (doc_id % 3 = 0)::INT ELSE 0 END::BIGINT AS records, issues::BIGINT AS issues FROM n""",
)
def validated_files(spark, d):
    """State, records and issues of each file."""
    return packages.validated(packages.parsed_records(record_files(spark, d)), "doc_id").select("doc_id", "state", "records", "issues")


@query("json_faults")
def json_faults(spark, d):
    """Line and column where a file stops being JSON; the tests hold them against a decoder's."""
    rows = packages.validated(packages.parsed_records(record_files(spark, d)), "doc_id")
    return rows.filter("state = 'parse_error'").select("doc_id", "line", "column")
