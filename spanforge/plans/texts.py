"""Queries for documents put together from words of pages: places, sentences, coloured records."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions.sentences import ABBREVIATIONS, sentence_parts
from spanforge.operators import assembly, layout, pages, ruling
from spanforge.plans import views as V
from spanforge.plans.columns import COLORS, PALETTE, ROTATIONS, placed_rows
from spanforge.plans.expressions import documents, pick, sql_pick
from spanforge.plans.queries import query
from spanforge.session import PARTS, beside, kept

def placed(spark, d):
    """Words stay with their document, so they are made again where they are read again, and neither shuffled nor written."""
    return assembly.placed_words(*page_layout(spark, d), "doc_id")


def page_layout(spark, d):
    """(words, blocks): reading order puts the second column's block first; a block without words stands between."""
    w = V.sequences(spark, d, by_document=True).select("doc_id", F.posexplode("tokens").alias("pos", "token")).filter("token <> ''")
    pos, i = F.col("pos"), F.col("doc_id")
    block = F.floor(pos % 200 / 40).cast("int")
    single = block == 4
    hyphen = ((pos % 10 == 9) & ((i + pos) % 3 == 0)) | (single & ((pos + i) % 7 < 4))
    y0 = F.floor(pos % 200 / 10) * 14 + F.when(F.floor(pos / 10) % 3 == 2, 5).otherwise(0)
    words = w.select(
        "doc_id",
        (F.floor(pos / 200) + 1).cast("int").alias("page"),
        block.alias("block"),
        pos.alias("word"),
        F.when(single, pos).otherwise(F.floor(pos / 10)).alias("line"),
        F.concat("token", F.when(hyphen, "-").otherwise("")).alias("text"),
        pick(COLORS, i + F.floor(pos / 3)).alias("color"),
        y0.alias("y0"),
        (y0 + 10).alias("y1"),
    )
    found = words.select("doc_id", "page", "block").distinct()
    rows = found.select("doc_id", "page", F.explode(F.array("block", F.lit(9))).alias("block")).distinct()
    b = F.col("block")
    top = b * 40 + i % 5
    place = F.element_at(F.create_map(*[F.lit(x) for pair in ((0, 0), (2, 1), (1, 2), (9, 3), (3, 4), (4, 5)) for x in pair]), b)
    blocks = rows.select("doc_id", "page", "block", place.alias("position"), F.floor(b / 2).alias("band"), (b % 2).alias("col"), (b * 30).alias("x0"), top.alias("y0"), (b * 30 + 25).alias("x1"), (top + 35).alias("y1"), pick(ROTATIONS, i).alias("rotation"))
    return words, blocks.filter(~((b == 3) & ((F.col("page") + i) % 6 == 0)))


def coloured_sentences(spark, d):
    """(doc_id, sentence_id, page, sentence, runs): texts are dealt out by document once, put together, cut into sentences and met with their words."""
    texts = V.texts(spark, d, by_document=True).select("doc_id", "text").sortWithinPartitions("doc_id")
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(placed_rows, f"doc_id {kind}, text string, words array<struct<start:int,end:int,color:int,page:int>>")
    rows = rows.select("doc_id", "words", assembly.named_sentences(F.col("text")).alias("sentences"))
    return pages.found_sentences(rows, f"doc_id {kind}, sentence_id int, page int, sentence string, runs array<struct<start:int,end:int,color:int>>")


LAYOUT_SQL = f"""{V.TAGS},
pw AS (SELECT doc_id, pos, (pos // 200 + 1)::INTEGER AS page, (pos % 200 // 40)::INTEGER AS block, CASE WHEN pos % 200 // 40 = 4 THEN pos ELSE pos // 10 END AS line,
       token || CASE WHEN (pos % 10 = 9 AND (doc_id + pos) % 3 = 0) OR (pos % 200 // 40 = 4 AND (pos + doc_id) % 7 < 4) THEN '-' ELSE '' END AS text,
       {sql_pick(COLORS, "doc_id + pos // 3")} AS color, pos % 200 // 10 * 14 + CASE WHEN pos // 10 % 3 = 2 THEN 5 ELSE 0 END AS y0 FROM tok WHERE token <> ''),
bl AS (SELECT *, b * 40 + doc_id % 5 AS y0, {sql_pick(ROTATIONS, "doc_id")} AS rotation, list_position([0, 2, 1, 9, 3, 4], b) AS position
       FROM (SELECT DISTINCT doc_id, page, unnest([block, 9]) AS b FROM pw) WHERE NOT (b = 3 AND (page + doc_id) % 6 = 0)),
o AS (SELECT pw.*, lead(line) OVER q AS nline, lead(text) OVER q AS ntext, lead(color) OVER q AS ncolor, y0 - lag(y0 + 10) OVER q > 6 AND lag(line) OVER q <> line AS feed, row_number() OVER q AS rn
      FROM pw SEMI JOIN bl ON pw.doc_id = bl.doc_id AND pw.page = bl.page AND pw.block = bl.b WINDOW q AS (PARTITION BY doc_id, page, block ORDER BY pos)),
op AS (SELECT *, right(text, 1) = '-' AND coalesce(nline <> line, false) AS open FROM o),
isl AS (SELECT *, coalesce(max(CASE WHEN NOT open THEN rn END) OVER (PARTITION BY doc_id, page, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM op),
hd AS (SELECT *, open AND (rn - closed) % 2 = 1 AS head FROM isl),
pc AS (SELECT doc_id, page, block, pos, CASE WHEN head THEN text[:-2] || ntext ELSE text END AS piece, CASE WHEN head THEN coalesce(color, ncolor) ELSE color END AS color, feed, rn
       FROM (SELECT *, coalesce(lag(head) OVER (PARTITION BY doc_id, page, block ORDER BY pos), false) AS gone FROM hd) WHERE NOT gone),
lw AS (SELECT doc_id, page, block AS b, arg_max(text, pos) AS last FROM o GROUP BY ALL),
bs AS (SELECT bl.*, lw.last, CASE WHEN lw.last IS NOT NULL THEN coalesce(lead(b // 2) OVER q <> b // 2 OR lead(b % 2) OVER q <> b % 2 OR
         CASE WHEN rotation NOT IN (90, 270) THEN round_even((lead(y0) OVER q) / 3.0, 0) <> round_even(y0 / 3.0, 0)
              WHEN regexp_matches(trim(lw.last), '[:.?]$') THEN true
              WHEN rotation = 90 THEN lead(b * 30) OVER q - (b * 30 + 25) > 18 ELSE lead(y0) OVER q - (y0 + 35) > 18 END, false) END AS behind
       FROM bl LEFT JOIN lw USING (doc_id, page, b) WINDOW q AS (PARTITION BY doc_id, page ORDER BY position)),
bf AS (SELECT doc_id, page, b AS block, position, coalesce(last_value(behind IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS bfeed, last FROM bs),
pl AS (SELECT doc_id, page, block, pos, piece, color, CASE WHEN rn = 1 THEN bfeed ELSE feed END AS f,
       (sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY page, position, pos) - length(piece) - 1)::BIGINT AS s FROM pc JOIN bf USING (doc_id, page, block)),
placed AS (SELECT doc_id, page, block, pos, piece, color, s, s + length(piece) AS e, CASE WHEN s = 0 THEN '' WHEN f THEN chr(10) ELSE ' ' END AS glue FROM pl),
texts AS (SELECT doc_id, string_agg(glue || piece, '' ORDER BY s) AS text FROM placed GROUP BY doc_id)"""


@query("document_words", f'WITH {LAYOUT_SQL} SELECT doc_id, page, pos::INTEGER AS word, piece AS text, color, s AS first_char, e AS end_char, glue FROM placed')
def document_words(spark, d):
    """Pieces of words with their characters in the whole document."""
    return placed(spark, d).drop("block").withColumnsRenamed({"start": "first_char", "end": "end_char"})


@query("document_texts", f"WITH {LAYOUT_SQL} SELECT doc_id, length(text)::BIGINT AS chars, sha256(text) AS digest FROM texts")
def document_texts(spark, d):
    """The text of each document, put together from its pages."""
    texts = assembly.document_texts(placed(spark, d), "doc_id")
    return texts.select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


def sentences_sql(texts: str) -> str:
    """SQL for sents(doc_id, n, ss, se, s) of texts(doc_id, text): words and the gaps between them, each gap judged by itself."""
    blank = r" \t\n\r\f\x0B"
    behind = rf"([{blank}]|[^.].*[{blank}])"
    short = ", ".join(f"'{a}'" for a in ABBREVIATIONS if "." not in a)
    pairs = ", ".join(f"'{a}'" for a in ABBREVIATIONS if "." in a)
    return rf"""
gaps AS (SELECT doc_id, k, ws[k] AS w, gs[k] AS g, ws[k - 1] AS p, CASE WHEN gs[k - 1] = '.' OR gs[k - 1][-1:] = '.' THEN ws[k - 2] || '.' || ws[k - 1] END AS pp FROM (
  SELECT doc_id, ws, gs, unnest(range(1, len(gs) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^{blank}\p{{P}}]+') AS ws, string_split_regex(text, '[^{blank}\p{{P}}]+') AS gs FROM {texts} WHERE text IS NOT NULL))),
ends AS (SELECT *, g <> '' AND w IS NOT NULL AND g[-1:] <> '(' AND (regexp_matches(g, '(?s)[!?].*[{blank}]') OR regexp_matches(g, '(?s)[^.]\.{behind}') OR
   (regexp_matches(g, '(?s)^\.{behind}') AND (p IS NULL OR ((regexp_matches(p, '[\p{{Ll}}\p{{N}}]$') OR regexp_matches(p, '\p{{Lu}}\p{{Lu}}$')) AND p NOT IN ({short}) AND coalesce(pp, '') NOT IN ({pairs}))))) AS after_end,
   g = '.' AND regexp_matches(p, '\p{{Ll}}$') AND regexp_matches(w, '^\p{{Lu}}') AND p NOT IN ({short}) AND coalesce(pp, '') NOT IN ({pairs}) AS glued FROM gaps),
marks AS (SELECT doc_id, string_agg(regexp_replace(g, '(\n[{blank}]*)([^{blank}(])', '\1' || chr(64976) || '\2', 'g')
   || CASE WHEN w IS NOT NULL AND (coalesce(after_end, false) OR coalesce(glued, false) OR regexp_matches(g, '\n[{blank}]*$')) THEN chr(64976) ELSE '' END || coalesce(w, ''), '' ORDER BY k) AS m FROM ends GROUP BY doc_id),
parts AS (SELECT doc_id, k, ps[k] AS part FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT doc_id, string_split(m, chr(64976)) AS ps FROM marks))),
cut AS (SELECT doc_id, k, part, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) - length(part) AS place, regexp_replace(part, '^[{blank}]+', '') AS lefted FROM parts),
spans AS (SELECT doc_id, k, place + length(part) - length(lefted) AS ss, regexp_replace(lefted, '[{blank}]+$', '') AS s FROM cut),
sents AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS n, ss::INTEGER AS ss, (ss + length(s))::INTEGER AS se, s FROM spans WHERE s <> '')"""


@query("document_sentences", f'WITH {sentences_sql("documents")} SELECT doc_id, n AS sentence, ss AS first_char, se AS end_char, md5(s) AS digest FROM sents')
def document_sentences(spark, d):
    """Sentences of all texts with their characters."""
    each = documents(spark, d).select("doc_id", F.posexplode(sentence_parts(F.col("text"))).alias("sentence", "s"))
    return each.select("doc_id", "sentence", F.col("s.start").alias("first_char"), F.col("s.end").alias("end_char"), F.md5(F.col("s.text").cast("binary")).alias("digest"))


RECORDS_SQL = f"""{LAYOUT_SQL}, {sentences_sql("texts")},
named AS (SELECT doc_id, n, ss + length(regexp_extract(s, '^([\\p{{L}}\\p{{N}}\\p{{M}}_]+([ \\t\\n\\r\\f\\x0B]+[\\p{{L}}\\p{{N}}\\p{{M}}_]+){{0,2}})[ \\t\\n\\r\\f\\x0B]*:[ \\t\\n\\r\\f\\x0B]*')) AS ss, se, s FROM sents),
sn AS (SELECT doc_id, n, ss, se, right(s, (se - ss)::BIGINT) AS s FROM named),
inside AS (SELECT p.doc_id, sn.n, p.s, p.e, sn.ss, p.color, p.page FROM placed p JOIN sn ON p.doc_id = sn.doc_id AND p.s >= sn.ss AND p.e <= sn.se),
run AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id, n ORDER BY s) AS r, first_value(page) OVER (PARTITION BY doc_id, n ORDER BY s) AS fp FROM (
  SELECT *, CASE WHEN lag(s) OVER q IS NOT NULL AND lag(color) OVER q IS NOT DISTINCT FROM color THEN 0 ELSE 1 END AS ch FROM inside WINDOW q AS (PARTITION BY doc_id, n ORDER BY s))),
ents AS (SELECT doc_id, n, r, color, min(s - ss) AS a, max(e - ss) AS z, min(fp) AS page FROM run WHERE color IS NOT NULL GROUP BY doc_id, n, r, color),
clean AS (SELECT ents.*, rtrim(sn.s[a + 1:z], ' ,.:;') AS text, sn.s FROM ents JOIN sn USING (doc_id, n)),
recs AS (SELECT doc_id, n, min(page) AS page, any_value(s) AS s, string_agg(a || '-' || (a + length(text)) || ':' || CASE WHEN color = '#FFFF00' THEN 'social' ELSE color END, ' ' ORDER BY r) AS entities,
         array_to_string(list_sort(list(DISTINCT CASE WHEN color = '#FFFF00' THEN 'social' ELSE color END)), ',') AS vals FROM clean GROUP BY doc_id, n)"""


@query("highlight_records", f'WITH {RECORDS_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n))::INTEGER AS sentence_id, page, md5(s) AS digest, vals AS labels, entities FROM recs')
def highlight_records(spark, d):
    """Records of sentences with coloured entities, from pages to characters; each document stays one row from its text to its sentences."""
    labels = F.create_map(F.lit("#FFFF00"), F.lit("social"))
    found = assembly.sentence_records(coloured_sentences(spark, d), F.array(*[F.lit(c) for c in PALETTE]), labels)
    each = F.transform("entities", lambda e: F.concat(e.getField("start"), F.lit("-"), e.getField("end"), F.lit(":"), e.getField("label")))
    return found.select("doc_id", "sentence_id", "page", F.md5(F.col("sentence").cast("binary")).alias("digest"), F.array_join("values", ",").alias("labels"), F.array_join(each, " ").alias("entities"))


# --- ruled cells ---------------------------------------------------------------------------------


def drawn_lines(spark, d):
    """Lines of a table on the page of each document, in pieces and a little askew, some of them missing."""
    i = F.col("doc_id")
    rows, columns = (i % 5 + 1).cast("int"), (F.col("n_chars") % 4 + 1).cast("int")
    base = documents(spark, d).select("doc_id", "n_chars", rows.alias("r"), columns.alias("c"))
    cells = base.select("*", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("a")).select("*", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("b"))
    a, b, n = F.col("a"), F.col("b"), F.col("n_chars")
    askew = (F.col("doc_id") + a * 3 + b) % 3
    x, y = b * 60 + 30, a * 25 + 40
    level = cells.filter((b < F.col("c")) & ((n + a * 7 + b * 5) % 9 != 0)).select("doc_id", (x - 1).alias("x0"), (y + askew).alias("y0"), (x + 60 + askew).alias("x1"), (y + askew).alias("y1"))
    upright = cells.filter((a < F.col("r")) & ((n + a * 5 + b * 11) % 8 != 0)).select("doc_id", (x + askew - 1).alias("x0"), (y + 25).alias("y0"), (x + askew - 1).alias("x1"), (y - 1).alias("y1"))
    other = base.filter(i % 3 == 0).select("doc_id", F.lit(300).alias("x0"), F.lit(300).alias("y0"), F.lit(400).alias("x1"), F.lit(390).alias("y1"))
    second = base.filter(i % 4 == 1).select("doc_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), box, strict=True)]) for box in GRID])).alias("l")).select("doc_id", "l.*")
    return level.unionByName(upright).unionByName(other).unionByName(second)


#: A second table of two rows and two columns, whose upper cells are one.
GRID = [(500, 40, 600, 40), (500, 70, 600, 70), (500, 100, 600, 100), (500, 130, 600, 130), (500, 40, 500, 130), (550, 70, 550, 130), (600, 40, 600, 130)]

CELLS_SQL = f"""
base AS (SELECT doc_id, n_chars AS n, doc_id % 5 + 1 AS r, n_chars % 4 + 1 AS c FROM documents),
grid AS (SELECT *, (doc_id + a * 3 + b) % 3 AS k, b * 60 + 30 AS x, a * 25 + 40 AS y FROM (SELECT *, unnest(range(0, c + 1)) AS b FROM (SELECT *, unnest(range(0, r + 1)) AS a FROM base))),
lines AS (SELECT doc_id, x - 1 AS x0, y + k AS y0, x + 60 + k AS x1, y + k AS y1 FROM grid WHERE b < c AND (n + a * 7 + b * 5) % 9 <> 0
UNION ALL SELECT doc_id, x + k - 1, y - 1, x + k - 1, y + 25 FROM grid WHERE a < r AND (n + a * 5 + b * 11) % 8 <> 0
UNION ALL SELECT doc_id, g[1], g[2], g[3], g[4] FROM base, (SELECT unnest({[list(g) for g in GRID]}) AS g) WHERE doc_id % 4 = 1),
s AS (SELECT DISTINCT doc_id, y1 - y0 <= 3 AS level, (CASE WHEN y1 - y0 <= 3 THEN y0 ELSE x0 END)::DOUBLE AS p, (CASE WHEN y1 - y0 <= 3 THEN x0 ELSE y0 END)::DOUBLE AS lo, (CASE WHEN y1 - y0 <= 3 THEN x1 ELSE y1 END)::DOUBLE AS hi FROM lines),
pc AS (SELECT doc_id, level, p, sum(far) OVER (PARTITION BY doc_id, level ORDER BY p) AS cl FROM (SELECT DISTINCT doc_id, level, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, level ORDER BY p) <= 3 THEN 0 ELSE 1 END AS far FROM (SELECT DISTINCT doc_id, level, p FROM s))),
sn AS (SELECT s.doc_id, s.level, cl, min(s.p) OVER (PARTITION BY s.doc_id, s.level, cl) AS p, lo, hi FROM s JOIN pc USING (doc_id, level, p)),
mg AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, level, cl ORDER BY lo, hi) AS piece FROM (SELECT *, CASE WHEN lo <= 3 + max(hi) OVER (PARTITION BY doc_id, level, cl ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS gap FROM sn)),
st AS (SELECT doc_id, level, p, min(lo) AS lo, max(hi) AS hi, row_number() OVER (ORDER BY doc_id, level, p, min(lo)) AS id FROM mg GROUP BY doc_id, level, cl, p, piece),
pt AS (SELECT h.doc_id, h.id AS h, v.id AS v, v.p AS x, h.p AS y, h.hi > v.p + 3 AS rt, v.hi > h.p + 3 AS dn FROM st h JOIN st v ON h.doc_id = v.doc_id AND h.level AND NOT v.level AND v.p BETWEEN h.lo - 3 AND h.hi + 3 AND h.p BETWEEN v.lo - 3 AND v.hi + 3),
rr AS (SELECT a.doc_id, a.h, a.v, min(b.x) AS x1 FROM pt a JOIN pt b ON a.doc_id = b.doc_id AND a.h = b.h AND b.x > a.x AND b.dn GROUP BY ALL),
bb AS (SELECT a.doc_id, a.h, a.v, min(b.y) AS y1 FROM pt a JOIN pt b ON a.doc_id = b.doc_id AND a.v = b.v AND b.y > a.y AND b.rt GROUP BY ALL),
ce AS (SELECT DISTINCT pt.doc_id, pt.h, pt.x, pt.y, rr.x1, bb.y1 FROM pt JOIN rr USING (doc_id, h, v) JOIN bb USING (doc_id, h, v) WHERE pt.rt AND pt.dn AND EXISTS (
  SELECT 1 FROM pt c JOIN pt ra ON ra.doc_id = c.doc_id AND ra.v = c.v JOIN pt ba ON ba.doc_id = c.doc_id AND ba.h = c.h WHERE c.doc_id = pt.doc_id AND ra.h = pt.h AND ra.x = rr.x1 AND ba.v = pt.v AND ba.y = bb.y1)),
links AS (SELECT DISTINCT a.doc_id, a.h AS s, b.h AS t FROM pt a JOIN pt b ON a.doc_id = b.doc_id AND a.v = b.v)"""


@query(
    "ruled_cells",
    f"""WITH RECURSIVE {CELLS_SQL},
walk AS (SELECT DISTINCT doc_id, s, s AS t FROM links UNION SELECT walk.doc_id, walk.s, links.t FROM walk JOIN links ON walk.doc_id = links.doc_id AND walk.t = links.s),
tb AS (SELECT doc_id, s AS h, min(t) AS tab FROM walk GROUP BY doc_id, s),
cc AS (SELECT ce.*, tab FROM ce JOIN tb USING (doc_id, h)),
ok AS (SELECT doc_id, tab FROM cc GROUP BY doc_id, tab HAVING count(DISTINCT y) > 1 AND count(DISTINCT x) > 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY y, x) - 1)::INTEGER AS cell, x AS x0, y AS y0, x1, y1 FROM cc SEMI JOIN ok USING (doc_id, tab)""",
)
def ruled_cells(spark, d):
    """Cells of tables from their drawn lines."""
    return ruling.ruled_cells(drawn_lines(spark, d), "doc_id", keep=kept(spark)).drop("table")


# --- reading order -------------------------------------------------------------------------------


def page_blocks(spark, d):
    """Blocks of a page for each document, by the digits of its hash: over the whole page, left or right, some askew; some pages are turned."""
    h = F.md5(F.col("text").cast("binary"))
    base = documents(spark, d).select("doc_id", h.alias("h"), F.explode(F.sequence(F.lit(0), (F.col("n_chars") % 9 + 3).cast("int"))).alias("block"))
    digit = lambda shift: F.conv(F.substr("h", F.col("block") * 2 + shift, F.lit(1)), 16, 10).cast("int")
    k, j, b = digit(1), digit(2), F.col("block")
    x0 = F.when(k < 4, 20).when(k < 11, 20 + j).otherwise(320 + j)
    x1 = F.when(k < 4, 580).when(k < 11, 270 + j).otherwise(560 + j)
    y0 = F.floor(b / 2) * 40 + F.when(k < 4, 0).otherwise(j % 5) + 3
    return base.select("doc_id", "block", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 20).alias("y1"), F.lit(600).alias("width"), F.lit(900).alias("height"), pick([0, 0, 90, 0, 180, 0, 270], F.col("doc_id")).alias("rotation"))


@query(
    "reading_order",
    f"""WITH h AS (SELECT doc_id, md5(text) AS h, unnest(range(0, n_chars % 9 + 4)) AS b FROM documents),
k AS (SELECT doc_id, b, ('0x' || h[b * 2 + 1])::INT AS k, ('0x' || h[b * 2 + 2])::INT AS j FROM h),
bl AS (SELECT doc_id, b, k < 4 AS wide, CASE WHEN k < 4 THEN 20 WHEN k < 11 THEN 20 + j ELSE 320 + j END AS x0, b // 2 * 40 + CASE WHEN k < 4 THEN 0 ELSE j % 5 END + 3 AS y0, k < 11 AS leftish, {sql_pick([0, 0, 90, 0, 180, 0, 270], "doc_id")} AS rotation FROM k),
ed AS (SELECT doc_id, 0 AS e FROM bl UNION SELECT doc_id, 900 FROM bl UNION SELECT doc_id, y0 FROM bl WHERE wide UNION SELECT doc_id, y0 + 20 FROM bl WHERE wide),
bands AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS band, e AS lo, lead(e) OVER (PARTITION BY doc_id ORDER BY e) AS hi FROM ed),
inb AS (SELECT bl.*, (SELECT min(band) FROM bands WHERE bands.doc_id = bl.doc_id AND hi IS NOT NULL AND y0 + 10 BETWEEN lo AND hi) AS band FROM bl),
held AS (SELECT inb.doc_id, bands.band, bool_or(leftish) AS has_left FROM inb JOIN bands ON bands.doc_id = inb.doc_id AND hi IS NOT NULL AND y0 + 10 BETWEEN lo AND hi WHERE NOT wide GROUP BY ALL),
pl AS (SELECT inb.*, CASE WHEN wide OR leftish OR NOT has_left THEN 0 ELSE 1 END AS col FROM inb LEFT JOIN held USING (doc_id, band)),
o AS (SELECT *, CASE rotation WHEN 90 THEN [-round_even((y0 + 20) / 5.0, 0) * 5, x0, 0, 0] WHEN 180 THEN [-y0, -x0, 0, 0] WHEN 270 THEN [round_even(y0 / 5.0, 0) * 5, -x0, 0, 0] ELSE [band, col, round_even(y0 / 3.0, 0) * 3, x0] END AS key FROM pl)
SELECT doc_id, b::INTEGER AS block, CASE WHEN rotation = 0 THEN band ELSE 0 END::INTEGER AS band, CASE WHEN rotation = 0 THEN col ELSE 0 END::INTEGER AS col, (row_number() OVER (PARTITION BY doc_id ORDER BY key[1], key[2], key[3], key[4], b))::INTEGER AS position FROM o""",
)
def reading_order(spark, d):
    """Bands between blocks over the whole page, columns within them, and the order in which blocks are read."""
    return layout.reading_order(page_blocks(spark, d), "doc_id").select("doc_id", "block", "band", "col", "position")
