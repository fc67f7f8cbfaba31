"""Queries for expressions on single rows: labels, tags, texts, colours, places on pages, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions import vocabulary as L
from spanforge.operators import contract, layout, multilabel
from spanforge.operators import spans as S
from spanforge.plans import views as V
from spanforge.plans.queries import page_drawings, page_words, query, token_places
from spanforge.session import table

def row_id() -> Column:
    return F.col("doc_id")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def pick(values: list, at: Column) -> Column:
    """One of some values by a row's number; the same as (values)[n % len + 1] in SQL."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(at, F.lit(len(values))).cast("int"))


def sql_list(values: list) -> str:
    quoted = ["NULL" if v is None else "E'" + v.replace("\\", "\\\\").replace("'", "''").replace("\t", "\\t").replace("\n", "\\n") + "'" if isinstance(v, str) else str(v) for v in values]
    return f"([{', '.join(quoted)}])"


def sql_pick(values: list, at: str) -> str:
    return f"{sql_list(values)}[({at}) % {len(values)} + 1]"


NAMES = ["Aesthetic", " history ", "ECONOMICAL", "politics", "Science", "ecologic", "age", "Social\t", "beauty", "", "historic ", "Aesthetics", None]
SPELLINGS = "m(key, label) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in {**L.ALIASES, **{v: v for v in L.VALUES}}.items()) + ")"


@query("label_spellings", f"WITH {SPELLINGS}, n AS (SELECT doc_id, {sql_pick(NAMES, 'doc_id')} AS name FROM documents) SELECT doc_id, label FROM n LEFT JOIN m ON lower(trim(name, E' \\t')) = key")
def label_spellings(spark, d):
    return documents(spark, d).select("doc_id", L.normalise_value(pick(NAMES, row_id())).alias("label"))


@query("label_vectors", f"WITH {V.UNITS} SELECT doc_id, string_agg(g::VARCHAR, '' ORDER BY k) AS bits FROM units GROUP BY doc_id")
def label_vectors(spark, d):
    return V.units(spark, d).select("doc_id", F.array_join(L.one_hot(L.decode(F.col("gold"))).cast("array<string>"), "").alias("bits"))


ODD_TAGS = ["O", "B-Aesthetic", "I-history", "B-social", "X-age", "B-beauty", "I-Economical", "B-age", "O", "O", "I-ecology"]


@query(
    "canonical_tags",
    f"""WITH {SPELLINGS}, t AS (SELECT doc_id, j, {sql_pick(ODD_TAGS, 'doc_id + j * j')} AS tag FROM documents, range(0, 4) r(j)),
c AS (SELECT doc_id, j, CASE WHEN tag = 'O' THEN 'O' WHEN tag[1] IN ('B', 'I') THEN tag[1] || '-' || label END AS tag FROM t LEFT JOIN m ON lower(tag[3:]) = key)
SELECT doc_id, CASE WHEN count(*) = count(tag) THEN string_agg(tag, ' ' ORDER BY j) END AS tags FROM c GROUP BY doc_id""",
)
def canonical_tags(spark, d):
    found = F.array(*[pick(ODD_TAGS, row_id() + j * j) for j in range(4)])
    return documents(spark, d).select("doc_id", F.array_join(L.canonical_tags(found), " ").alias("tags"))


@query("effective_texts", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 1 THEN 'new ' || doc_id ELSE trim(coalesce(text, ''), E' \\t\\n\\r\\f\\v') END) AS digest FROM documents")
def effective_texts(spark, d):
    curated = F.when(row_id() % 3 == 0, "").when(row_id() % 3 == 1, F.concat(F.lit(" new "), row_id(), F.lit("\n")))
    return documents(spark, d).select("doc_id", F.md5(T.effective_text(curated, F.col("text")).cast("binary")).alias("digest"))


@query("threshold_vectors", f"WITH {V.UNITS} SELECT doc_id, string_agg(CASE WHEN prob >= (k + 1)::DOUBLE / 10.0::DOUBLE THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM units GROUP BY doc_id")
def threshold_vectors(spark, d):
    edges = F.array(*[F.lit((k + 1) / 10.0) for k in range(len(L.VALUES))])
    return V.units(spark, d).select("doc_id", F.array_join(multilabel.apply_thresholds(F.col("prob"), edges).cast("array<string>"), "").alias("bits"))


TAG_NAMES = sql_list(L.TAGS)
CHANCES = f"p AS (SELECT doc_id, k, {TAG_NAMES}[k + 1] AS tag, ((doc_id * 31 + k * k * 17) % 101)::DOUBLE / 100.0::DOUBLE AS p FROM documents, range(0, 17) r(k))"


def chances() -> Column:
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(16).cast("long")), lambda k: F.pmod(row_id() * 31 + k * k * 17, F.lit(101)).cast("double") / 100.0)


@query("argmax_tags", f"WITH {CHANCES} SELECT doc_id, arg_max(tag, p * 1000 - k) AS tag FROM p GROUP BY doc_id")
def argmax_tags(spark, d):
    return documents(spark, d).select("doc_id", S.argmax_tag(chances()).alias("tag"))


@query("best_value_tags", f"WITH {CHANCES} SELECT doc_id, arg_max(tag, p * 1000 - k) AS tag, round(max(p), 9) AS p FROM p WHERE k > 0 GROUP BY doc_id")
def best_value_tags(spark, d):
    return documents(spark, d).select("doc_id", S.best_value_tag(chances()).alias("b")).select("doc_id", "b.tag", F.round("b.p", 9).alias("p"))


@query(
    "page_ranges",
    """WITH s AS (SELECT doc_id, doc_id % 9 + 1 AS a, doc_id % 5 + doc_id % 7 + 1 AS b, doc_id % 13 + 1 AS c, doc_id % 11 = 0 AS odd FROM documents)
SELECT doc_id, CASE WHEN NOT odd AND b >= a THEN array_to_string(list_sort(list_distinct(list_concat(range(a, b + 1), [c]))), ',') END AS pages FROM s""",
)
def page_ranges(spark, d):
    spec = F.concat_ws("", row_id() % 9 + 1, F.lit(" - "), row_id() % 5 + row_id() % 7 + 1, F.lit(", "), row_id() % 13 + 1, F.when(row_id() % 11 == 0, ",x"))
    return documents(spark, d).select("doc_id", F.array_join(T.page_numbers(spec).cast("array<string>"), ",").alias("pages"))


MARGINS = ["EN1", "SO3/EN1", " AUT ", "N.v.t.", "Hello EN1", "so3", "EN12", "INT", "EN1/", "(EN1)", ""]


@query("margin_codes", f"WITH m AS (SELECT doc_id, trim({sql_pick(MARGINS, 'doc_id')}) AS t FROM documents) SELECT doc_id, t IN ('AUT', 'INT', 'N.v.t.') OR regexp_full_match(t, '[A-Z]{{2}}\\d(/[A-Z]{{2}}\\d)*') AS code FROM m")
def margin_codes(spark, d):
    return documents(spark, d).select("doc_id", T.is_margin_code(pick(MARGINS, row_id())).alias("code"))


NAMED = ", ".join(f"({i}, '{h}', '{n}', {int(h[1:3], 16)}, {int(h[3:5], 16)}, {int(h[5:7], 16)})" for i, (h, n) in enumerate(T.COLOR_NAMES.items()))


@query(
    "colour_values",
    f"""WITH named(i, hex, name, r, g, b) AS (VALUES {NAMED}), c AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 255 ELSE doc_id * 7 % 256 END AS r, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE doc_id * 13 % 256 END AS g, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE doc_id * 29 % 256 END AS b FROM documents),
n AS (SELECT doc_id, arg_min(name, ((c.r - n.r) ** 2 + (c.g - n.g) ** 2 + (c.b - n.b) ** 2) * 100 + i) AS name, min((c.r - n.r) ** 2 + (c.g - n.g) ** 2 + (c.b - n.b) ** 2) = 0 AS exact FROM c, named n GROUP BY doc_id)
SELECT doc_id, printf('#%02X%02X%02X', r, g, b) AS hex, greatest(r, g, b) - least(r, g, b) > 30 AS colourful, CASE WHEN r * 299 + g * 587 + b * 114 >= 150000 THEN '#000000' ELSE '#FFFFFF' END AS ink,
CASE WHEN exact THEN name ELSE 'Near ' || lower(name) END AS name FROM c JOIN n USING (doc_id)""",
)
def colour_values(spark, d):
    part = lambda k, pure: F.when(row_id() % 6 == 0, pure).otherwise(row_id() * k % 256)
    c = documents(spark, d).select("doc_id", T.hex_color(part(7, 255), part(13, 0), part(29, 0)).alias("hex"))
    return c.select("doc_id", "hex", T.is_colourful(F.col("hex")).alias("colourful"), T.contrast(F.col("hex")).alias("ink"), T.color_name(F.col("hex")).alias("name"))


HIGHLIGHT_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in T.HIGHLIGHTS.items())
HIGHLIGHT_NAMES = [*T.HIGHLIGHTS, "MAUVE"]


@query("highlight_colours", f"WITH h(name, hex) AS (VALUES {HIGHLIGHT_ROWS}), n AS (SELECT doc_id, {sql_pick(HIGHLIGHT_NAMES, 'doc_id')} AS name FROM documents) SELECT doc_id, hex FROM n LEFT JOIN h USING (name)")
def highlight_colours(spark, d):
    return documents(spark, d).select("doc_id", T.highlight_hex(pick(HIGHLIGHT_NAMES, row_id())).alias("hex"))


NUMBERS = ["12", "- 7 -", "page 3", "1234", "12345", "–9–"]


@query(
    "page_margins",
    f"""WITH b AS (SELECT doc_id, doc_id * 37 % 540 + 30.0 AS cx, doc_id * 53 % 836 + 6.0 AS cy, (doc_id % 4) * 90 AS a, {sql_pick(NUMBERS, 'doc_id // 4')} AS t FROM documents)
SELECT doc_id, CASE WHEN a IN (90, 270) THEN cx < 70 OR cx > 595 - 70 ELSE cy < 70 OR cy > 842 - 70 END AS margin,
CASE WHEN a IN (90, 270) THEN cx < 595 * 0.15 OR cx > 595 * 0.85 ELSE cy < 842 * 0.15 OR cy > 842 * 0.85 END AND regexp_full_match(trim(t), '([-–—]\\s*)?\\d{{1,4}}(\\s*[-–—])?') AS number FROM b""",
)
def page_margins(spark, d):
    x, y, a = row_id() * 37 % 540, row_id() * 53 % 836, (row_id() % 4) * 90
    box = (x, y, x + 60, y + 12, F.lit(595), F.lit(842), a)
    return documents(spark, d).select("doc_id", layout.is_margin(*box).alias("margin"), layout.is_page_number(pick(NUMBERS, F.floor(row_id() / 4)), *box).alias("number"))


@query(
    "readable_texts",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[a-z]', '7', 'g') END AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '[\\s\\x0B\\p{Z}]', '', 'g')) >= 200 AND length(regexp_replace(t, '[^\\p{L}]', '', 'g')) < 0.15 * length(regexp_replace(t, '[\\s\\x0B\\p{Z}]', '', 'g')) AS unreadable FROM t""",
)
def readable_texts(spark, d):
    t = F.when(row_id() % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "[a-z]", "7"))
    return documents(spark, d).select("doc_id", T.unreadable(t).alias("unreadable"))


SPEAKERS = ["Anna: ", "Dr de Vries : ", "", "a b c d: ", "Ben:"]


@query(
    "speaker_names",
    f"""WITH t AS (SELECT doc_id, {sql_pick(SPEAKERS, 'doc_id')} || 'said. ' || text AS t FROM documents),
h AS (SELECT doc_id, t, regexp_extract(t, '^([\\p{{L}}\\p{{N}}_]+(?:\\s+[\\p{{L}}\\p{{N}}_]+){{0,2}})\\s*:\\s*') AS head FROM t)
SELECT doc_id, length(head)::INTEGER AS shift, md5(t[length(head) + 1:]) AS digest FROM h""",
)
def speaker_names(spark, d):
    found = T.strip_speaker(F.concat(pick(SPEAKERS, row_id()), F.lit("said. "), F.col("text")))
    return documents(spark, d).select("doc_id", found.alias("s")).select("doc_id", "s.shift", F.md5(F.col("s.text").cast("binary")).alias("digest"))


@query("ligatures", "SELECT doc_id, md5(text) AS digest FROM documents")
def ligatures(spark, d):
    """Texts whose letter pairs were written as ligatures read as before."""
    t = F.replace(F.replace("text", F.lit("ffi"), F.lit("\ufb03")), F.lit("fi"), F.lit("\ufb01"))
    return documents(spark, d).select("doc_id", F.md5(T.expand_ligatures(F.replace(t, F.lit("fl"), F.lit("\ufb02"))).cast("binary")).alias("digest"))


@query(
    "paragraphs",
    f"""WITH {V.TAGS}, l AS (SELECT doc_id, line, t || CASE WHEN line % 3 = 0 THEN ' cut-' ELSE '' END AS t FROM (SELECT doc_id, pos // 8 AS line, string_agg(token, ' ' ORDER BY pos) AS t FROM tok GROUP BY ALL)),
n AS (SELECT *, lag(t) OVER o AS before, lead(t) OVER o AS after FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
j AS (SELECT doc_id, line, t, line % 5 = 0 AS gap, line % 5 = 4 AS gap_after, regexp_matches(before, '\\p{{L}}-$') AND regexp_matches(t, '^\\p{{Ll}}') AS glue, regexp_matches(t, '\\p{{L}}-$') AND regexp_matches(after, '^\\p{{Ll}}') AS glued, before IS NULL AS first FROM n)
SELECT doc_id, md5(string_agg(CASE WHEN first THEN '' WHEN gap THEN chr(10) || chr(10) WHEN glue THEN '' ELSE ' ' END || CASE WHEN glued AND NOT gap_after THEN t[:-2] ELSE t END, '' ORDER BY line)) AS digest FROM j GROUP BY doc_id""",
)
def paragraphs(spark, d):
    """Lines of eight tokens; every third ends in a cut word, every fifth stands apart."""
    t = V.sequences(spark, d, by_document=True).select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    line = F.floor(F.col("pos") / 8)
    lines = t.groupBy("doc_id", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x.getField("token")), " ").alias("t"))
    text = F.concat("t", F.when(F.col("line") % 3 == 0, " cut-").otherwise(""))
    y0 = F.col("line") * 12 + F.floor(F.col("line") / 5) * 10
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", text.alias("text"), y0.cast("double").alias("y0"), (y0 + 12).cast("double").alias("y1")))).alias("lines"))
    return rows.select("doc_id", F.md5(layout.joined_lines(F.col("lines")).cast("binary")).alias("digest"))


# --- places on pages ----------------------------------------------------------------------


@query(
    "points_in_rectangles",
    f"""WITH {V.TAGS}, w AS (SELECT doc_id, pos AS word, pos % 10 * 50 + 20 AS x, pos // 10 AS line, pos // 10 * 15 + 6 AS y FROM tok),
r AS (SELECT doc_id, pos AS rect, CASE WHEN pos % 3 = 0 THEN NULL ELSE (['#FF0000', '#00FF00', '#0000FF'])[(doc_id + pos) % 3 + 1] END AS color, pos % 10 * 50 + doc_id % 30 AS x0, pos // 10 * 15 + doc_id % 11 AS y0, pos // 10 AS line FROM tok WHERE pos % 7 = 0),
h AS (SELECT w.doc_id, w.word, r.rect, r.color FROM w JOIN (SELECT r.*, line + j AS near FROM r, range(0, 2) t(j)) r ON w.doc_id = r.doc_id AND w.line = r.near AND x BETWEEN x0 AND x0 + 60 AND y BETWEEN y0 AND y0 + 12),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY rect) AS n FROM h)
SELECT doc_id, word::INTEGER AS point, color, rect::INTEGER AS rect FROM b WHERE n = 1""",
)
def points_in_rectangles(spark, d):
    words = page_words(spark, d)
    points = words.select("doc_id", F.col("word").alias("point"), (F.col("x0") + 20).alias("x"), (F.col("y0") + 6).alias("y"))
    rects = page_drawings(words).withColumnRenamed("drawing", "rect").withColumn("color", F.when(F.col("rect") % 3 != 0, F.col("color")))
    return layout.first_containing(points, rects, "doc_id")


@query(
    "words_in_sentences",
    f"""WITH {V.TAGS}, places AS (SELECT doc_id, pos, length(token) AS n, sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(token) - 1 AS ts FROM tok)
SELECT doc_id, (ts // 90)::BIGINT AS sentence, pos::INTEGER AS word FROM places WHERE ts + n <= ts // 90 * 90 + 90""",
)
def words_in_sentences(spark, d):
    """Sentences are stretches of 90 characters; words that lie across two are in none."""
    t = token_places(spark, d)
    ends = t.groupBy("doc_id").agg(F.max("te").alias("n"))
    k = ends.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 90))).alias("sentence"))
    sentences = k.select("doc_id", "sentence", (F.col("sentence") * 90).alias("ss"), (F.col("sentence") * 90 + 90).alias("se"))
    words = t.select("doc_id", F.col("token").alias("word"), F.col("ts").alias("ws"), F.col("te").alias("we"))
    return layout.words_in_sentences(words, sentences, "doc_id")


# --- rules ------------------------------------------------------------------------------------


CODES = ["missing_package_file", "annotation_resource_mismatch", "source_missing", "invalid_bio_tag", "source_not_current"]
PATHS = ["$", "$.citation.title", "$.registry[0]", "$.ner_tags[0]"]


@query(
    "guide_pages",
    f"""WITH i AS (SELECT doc_id, {sql_pick(CODES, 'doc_id')} AS code, {sql_pick(PATHS, 'doc_id // 5')} AS path FROM documents)
SELECT doc_id, CASE WHEN contains(code, 'package') OR contains(code, 'resource') OR contains(path, 'citation') THEN 'DATA_PACKAGE' WHEN starts_with(code, 'source_') OR contains(path, 'registry') THEN 'TUTORIAL' ELSE 'VALIDATION' END AS page FROM i""",
)
def guide_pages(spark, d):
    from spanforge.operators.registry import guide

    return documents(spark, d).select("doc_id", guide(pick(CODES, row_id()), pick(PATHS, F.floor(row_id() / 5))).alias("page"))


MOVES = [("backlog", "start", "in_progress"), ("in_progress", "submit", "in_review"), ("in_review", "approve", "done"), ("in_review", "reject", "in_progress")]
STATES, EVENTS = ["backlog", "in_progress", "in_review", "done"], ["start", "submit", "approve", "reject", "wait"]


@query(
    "workflow_moves",
    f"""WITH m(status, event, after) AS (VALUES {', '.join(str(m) for m in MOVES)}), s AS (SELECT doc_id, {sql_pick(STATES, 'doc_id')} AS status, {sql_pick(EVENTS, 'doc_id // 4')} AS event FROM documents)
SELECT doc_id, coalesce(after, status) AS status FROM s LEFT JOIN m USING (status, event)""",
)
def workflow_moves(spark, d):
    from spanforge.operators.registry import next_status

    return documents(spark, d).select("doc_id", next_status(pick(STATES, row_id()), pick(EVENTS, F.floor(row_id() / 4))).alias("status"))


@query(
    "raw_drafts",
    f"""WITH {V.SENTENCES}, k AS (SELECT doc_id, sentence_id, (doc_id + sentence_id) % 6 AS k FROM sentences)
SELECT doc_id, sentence_id, k <> 2 AS valid, k NOT IN (1, 2, 3, 5) AS coherent_before, k NOT IN (1, 2, 3) AS coherent FROM k""",
)
def raw_drafts(spark, d):
    """Drafts of first words: outside the sentence, without a colour, with an odd tag, lower-case colours; then normalised."""
    s = V.sentences(spark, d)
    k = (F.col("doc_id") + F.col("sentence_id")) % 6
    word = F.substring_index("sentence", " ", 1)
    color = F.when(k == 2, F.lit(None).cast("string")).when(k == 5, "#ff00aa").otherwise("#FF00AA")
    entity = F.struct(F.lit(0).alias("start"), F.when(k == 1, F.length("sentence") + 9).otherwise(F.length(word)).cast("int").alias("end"), word.alias("text"), F.lit(None).cast("string").alias("label"), color.alias("color"))
    tag = F.when(k == 3, "X").when(k == 5, "B-#ff00aa").otherwise("B-#FF00AA")
    rows = s.select("doc_id", "sentence_id", "sentence", F.array(word).alias("tokens"), F.array(entity).alias("entities"), F.array(tag).alias("ner_tags"))
    coherent = F.coalesce(contract.draft_is_coherent(), F.lit(False))
    out = contract.normalise_draft(rows.withColumn("coherent_before", coherent))
    return out.select("doc_id", "sentence_id", "valid", "coherent_before", coherent.alias("coherent"))
