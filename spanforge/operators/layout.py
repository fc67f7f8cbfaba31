"""Words, colours and spans on pages: geometry joins, reading order, islands.

Rectangles are put into horizontal strips and joined on page and strip, so the
join is one on equality and each pair is compared in the strip of its lower edge
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.sentences import running
from spanforge.operators.spans import let

STRIP = 50


def strips(y0: str, y1: str, height: int = STRIP) -> Column:
    return F.explode(F.sequence(F.floor(F.col(y0) / height).cast("long"), F.floor(F.col(y1) / height).cast("long")))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0)) * F.greatest(y1 - y0, F.lit(0))


def covering(words: DataFrame, drawings: DataFrame, share: float, *keys: str) -> DataFrame:
    """Words with each drawing that covers at least a share of their area, and the area shared."""
    w = words.select(*keys, "word", "x0", "y0", "x1", "y1", strips("y0", "y1").alias("strip"))
    d = drawings.select(*keys, "drawing", "color", *[F.col(c).alias("d" + c) for c in ("x0", "y0", "x1", "y1")]).withColumn("strip", strips("dy0", "dy1"))
    both = w.join(d, [*keys, "strip"]).filter(F.col("strip") == F.floor(F.greatest("y0", "dy0") / STRIP))
    shared = area(F.greatest("x0", "dx0"), F.greatest("y0", "dy0"), F.least("x1", "dx1"), F.least("y1", "dy1"))
    return both.withColumn("shared", shared).filter((F.col("shared") > 0) & (F.col("shared") >= share * area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))))


def highlight_words(words: DataFrame, drawings: DataFrame, share: float = 0.1, *keys: str) -> DataFrame:
    """(keys, word, color): the drawing that covers most of each word, if at least a share of its area; the first of equal ones.

    words: keys, word, x0, y0, x1, y1; drawings: keys, drawing, color and the same.
    """
    hit = covering(words, drawings, share, *keys)
    return hit.groupBy(*keys, "word").agg(F.max_by("color", F.struct("shared", -F.col("drawing"))).alias("color"))


def recognised_colors(words: DataFrame, spans: DataFrame, share: float = 0.35, *keys: str) -> DataFrame:
    """(keys, word, color) of recognised words on coloured spans: as highlight_words, but the greater colour of equal ones."""
    return covering(words, spans, share, *keys).groupBy(*keys, "word").agg(F.max(F.struct("shared", "color")).getField("color").alias("color"))


def block_words(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, words): words of each block in their order.  words: keys, block, word, text."""
    each = F.array_sort(F.collect_list(F.struct("word", "text")))
    return words.groupBy(*keys, "block").agg(F.transform(each, lambda w: w.getField("text")).alias("words"))


def recognised_records(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, sentence_id, sentence, tokens, values, entities, ner_tags): coloured paragraphs and table cells of recognised words, in order of place.

    words: keys, block, paragraph, line, word, text, x0, y0, color (or null) and cell
    (or null), which goes before block and paragraph.  Lines of a group are joined by
    a line feed, words by a space; neighbours of one colour are one entity.  Groups
    without colour are left out before sentences are numbered by upper, then left edge, then first word.
    """
    part = [*keys, "group"]
    kind = F.when(F.col("cell").isNotNull(), F.struct(F.lit(1).alias("k"), F.col("cell").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct(F.lit(0).alias("k"), F.col("block").cast("long").alias("a"), F.col("paragraph").cast("long").alias("b")))
    in_order = Window.partitionBy(*part).orderBy("line", "word", "x0")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("line").over(in_order)
    rows = words.withColumn("group", kind)
    glue = F.when(F.row_number().over(in_order) == 1, "").when(before != F.col("line"), "\n").otherwise(" ")
    rows = rows.withColumns({"piece": F.concat(glue, F.col("text")), "n": F.row_number().over(in_order), "was": F.lag("color").over(in_order)})
    rows = rows.withColumn("end", F.sum(F.length("piece")).over(so_far).cast("int"))
    rows = rows.withColumn("island", F.sum(F.when(F.col("color").eqNullSafe(F.col("was")) & (F.col("n") > 1), 0).otherwise(1)).over(so_far))
    runs = rows.groupBy(*part, "island", "color").agg(F.min(F.col("end") - F.length("text")).alias("s"), F.max("end").alias("e"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda p: p.getField("piece")), "").alias("piece"), F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.min("word").alias("first"))
    whole = runs.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("island", "s", "e", "color", "piece"))).alias("runs"), F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.min("first").alias("first"))
    whole = whole.withColumn("sentence", F.array_join(F.transform("runs", lambda r: r.getField("piece")), ""))
    entity = lambda r: F.struct(r.getField("s").alias("start"), r.getField("e").alias("end"), F.substring(F.col("sentence"), r.getField("s") + 1, r.getField("e") - r.getField("s")).alias("text"), r.getField("color").alias("label"), r.getField("color").alias("color"))
    found = whole.withColumn("entities", F.transform(F.filter("runs", lambda r: r.getField("color").isNotNull()), entity)).filter(F.size("entities") > 0)
    place = Window.partitionBy(*keys).orderBy("y0", "x0", "first")
    numbered = found.withColumn("sentence_id", F.row_number().over(place)).withColumn("at", token_spans(F.col("sentence")))
    tokens = F.transform("at", lambda t: F.substring(F.col("sentence"), t.getField("start") + 1, t.getField("end") - t.getField("start")))
    values = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e.getField("label"))))
    return numbered.select(*keys, "sentence_id", "sentence", tokens.alias("tokens"), values.alias("values"), "entities", span_tags(F.col("at"), F.col("entities")).alias("ner_tags"))


def run_entities(found: DataFrame, palette: Column) -> DataFrame:
    """Sentences with values and with their runs (start, end, color) as entities; color is a place in the palette, from 1, and the label too."""

    def entity(r: Column) -> Column:
        color = F.get(palette, r.getField("color") - 1)
        text = F.substring(F.col("sentence"), r.getField("start") + 1, r.getField("end") - r.getField("start"))
        return F.struct(r.getField("start").alias("start"), r.getField("end").alias("end"), text.alias("text"), color.alias("label"), color.alias("color"))

    values = F.array_sort(F.array_distinct(F.transform("runs", lambda r: F.get(palette, r.getField("color") - 1))))
    return found.withColumns({"entities": F.transform("runs", entity), "values": values}).drop("runs")


# A token of a recognised text is a word, with apostrophes and hyphens inside, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\p{Z}\s]"


def token_spans(text: Column) -> Column:
    """array<struct<start,end>> of a text's tokens, in code points."""
    lengths = lambda parts: F.transform(parts, lambda p: F.length(p))
    cut = F.struct(lengths(F.regexp_extract_all(text, F.lit(TOKEN), 0)).alias("sizes"), lengths(F.split(text, TOKEN)).alias("gaps"))

    def of(x: Column) -> Column:
        """x: sizes and gaps, which are looked up for each token and so have to be values by then."""
        sizes, gaps = x.getField("sizes"), x.getField("gaps")
        start = lambda before, i: F.get(before, i) + F.get(gaps, i)
        return let(running(F.transform(sizes, lambda n, i: n + F.get(gaps, i))), lambda before: F.transform(sizes, lambda n, i: F.struct(start(before, i).alias("start"), (start(before, i) + n).alias("end"))))

    return let(cut, of)


def span_tags(spans: Column, entities: Column) -> Column:
    """BIO tags of tokens that lie wholly in an entity, by its label; entities are apart and in order."""
    inside = lambda t, e: (t.getField("start") >= e.getField("start")) & (t.getField("end") <= e.getField("end"))

    def tags(found: Column) -> Column:
        """found: for each token the entity's number from 1, 0 for none."""
        prefix = lambda k, i: F.when(k == F.coalesce(F.get(found, i - 1), F.lit(0)), "I-").otherwise("B-")
        return F.transform(found, lambda k, i: F.when(k == 0, F.lit("O")).otherwise(F.concat(prefix(k, i), F.get(entities, k - 1).getField("label"))))

    return let(F.transform(spans, lambda t: F.coalesce(F.array_position(F.transform(entities, lambda e: inside(t, e)), True), F.lit(0)).cast("int")), tags)


def first_containing(points: DataFrame, rects: DataFrame, *keys: str) -> DataFrame:
    """(keys, point, color): colour of the first rectangle that holds a point, even if that is null."""
    p = points.select(*keys, "point", "x", "y", F.floor(F.col("y") / STRIP).cast("long").alias("strip"))
    r = rects.select(*keys, "rect", "color", "x0", "y0", "x1", "y1").withColumn("strip", strips("y0", "y1"))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return p.join(r, [*keys, "strip"]).filter(inside).groupBy(*keys, "point").agg(F.min_by("color", "rect").alias("color"), F.min("rect").alias("rect"))


def dominant_color(tokens: DataFrame, runs: DataFrame, *keys: str, width: int = 32) -> DataFrame:
    """(keys, token, color): the colour that covers most characters of each token; the smaller colour of equal ones, null if uncoloured text leads."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width).cast("long"), F.floor((F.col(e) - 1) / width).cast("long")))
    t = tokens.select(*keys, "token", "ts", "te").filter("te > ts").withColumn("bin", bins("ts", "te"))
    r = runs.select(*keys, "color", "rs", "re").filter("re > rs").withColumn("bin", bins("rs", "re"))
    both = t.join(r, [*keys, "bin"]).withColumn("n", F.least("te", "re") - F.greatest("ts", "rs"))
    hit = both.filter((F.col("n") > 0) & (F.col("bin") == F.floor(F.greatest("ts", "rs") / width)))
    sums = hit.groupBy(*keys, "token", "color").agg(F.sum("n").alias("n"))
    return sums.groupBy(*keys, "token").agg(F.min_by("color", F.struct((-F.col("n")).alias("n"), F.col("color").isNotNull().alias("c"), F.col("color").alias("name"))).alias("color"))


def words_in_sentences(words: DataFrame, sentences: DataFrame, *keys: str, width: int = 256, more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, sentence, word, more): words that lie wholly in a sentence's characters; more names columns of either table to hand on."""
    w = words.select(*keys, "word", "ws", "we", *[c for c in more if c in words.columns and c not in ("ws", "we")]).withColumn("bin", F.floor(F.col("ws") / width).cast("long"))
    s = sentences.select(*keys, "sentence", "ss", "se").withColumn("bin", F.explode(F.sequence(F.floor(F.col("ss") / width).cast("long"), F.floor(F.col("se") / width).cast("long"))))
    return w.join(s, [*keys, "bin"]).filter("ws >= ss and we <= se").select(*keys, "sentence", "word", *more)


def islands(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, color, first, last, text): neighbouring words of one colour as one entity, without punctuation at the end."""
    order = Window.partitionBy(*keys).orderBy("word")
    changed = (~F.lag("color").over(order).eqNullSafe(F.col("color"))).cast("int")
    numbered = words.withColumn("_c", changed).withColumn("island", F.sum("_c").over(order))
    runs = numbered.filter("color is not null").groupBy(*keys, "island", "color").agg(F.min("word").alias("first"), F.max("word").alias("last"), F.array_sort(F.collect_list(F.struct("word", "text"))).alias("w"))
    text = F.rtrim(F.array_join(F.transform("w", lambda x: x.getField("text")), " "), F.lit(" ,.:;"))
    return runs.select(*keys, "color", "first", "last", F.trim(text).alias("text"))


def project_bio(tokens: DataFrame, entities: DataFrame, *keys: str, width: int = 64) -> DataFrame:
    """(keys, token, tag): BIO tags from entities on the tokens they contain; a later entity wins, its first token is B.

    tokens: keys, token, ts, te; entities: keys, entity, label, es, ee.
    """
    t = tokens.select(*keys, "token", "ts", "te")
    e = entities.select(*keys, "entity", "label", "es", "ee").filter("ee > es").withColumn("bin", F.explode(F.sequence(F.floor(F.col("es") / width).cast("long"), F.floor((F.col("ee") - 1) / width).cast("long"))))
    inside = t.withColumn("bin", F.floor(F.col("ts") / width).cast("long")).join(e, [*keys, "bin"]).filter("ts >= es and te <= ee")
    first = inside.groupBy(*keys, "entity").agg(F.min("token").alias("first"))
    tagged = inside.join(first, [*keys, "entity"]).withColumn("tag", F.concat(F.when(F.col("token") == F.col("first"), "B-").otherwise("I-"), "label"))
    won = tagged.groupBy(*keys, "token").agg(F.max_by("tag", "entity").alias("tag"))
    return t.join(won, [*keys, "token"], "left").select(*keys, "token", F.coalesce("tag", F.lit("O")).alias("tag"))


def middle(low: Column, high: Column) -> Column:
    return (low + high) / 2


def is_margin(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotation: Column, margin: int = 70) -> Column:
    """Headers and footers: blocks whose middle lies in the margin above or below, as the page is turned."""
    beside = (middle(x0, x1) < margin) | (middle(x0, x1) > width - margin)
    return F.when(rotation.isin(90, 270), beside).otherwise((middle(y0, y1) < margin) | (middle(y0, y1) > height - margin))


def is_page_number(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotation: Column, band: float = 0.15) -> Column:
    """A bare number, with or without dashes, near the upper or lower edge, as the page is turned."""
    across, down = middle(x0, x1), middle(y0, y1)
    near = F.when(rotation.isin(90, 270), (across < width * band) | (across > width * (1 - band))).otherwise((down < height * band) | (down > height * (1 - band)))
    return near & F.trim(text).rlike(r"^([-–—]\s*)?\d{1,4}(\s*[-–—])?$")


# Shares of the page's width that make a block full width, the overlap that joins a column, and its slack.
FULL_LEFT, FULL_RIGHT, FULL_WIDTH, JOINED, SLACK = 0.45, 0.55, 0.6, 0.3, 5


def reading_order(blocks: DataFrame, *keys: str) -> DataFrame:
    """Adds band, col and position: full-width blocks cut an upright page into bands, columns follow in each band.

    blocks: keys, block, x0, y0, x1, y1, width and height of the page, rotation.  Both
    edges of full-width blocks bound bands, and a block lies in the first band that
    holds its middle.  From left to right a block joins the first column that it
    overlaps by more than JOINED of the narrower one, or that holds it within SLACK.
    Within a column blocks go by height, rounded to threes.  Turned pages go by
    their turned lines.  A page is one row while it is ordered.
    """
    box = ["block", "x0", "y0", "x1", "y1"]
    double = [F.col(c).cast("double").alias(c) if c != "block" else F.col(c) for c in box]
    pages = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*double))).alias("b"), *[F.first(c).cast("double").alias(c) for c in ("width", "height", "rotation")])
    get = lambda x, c: x.getField(c)
    wide = lambda x: (get(x, "x0") < FULL_LEFT * F.col("width")) & (get(x, "x1") > FULL_RIGHT * F.col("width")) & (get(x, "x1") - get(x, "x0") > FULL_WIDTH * F.col("width"))
    centre = lambda x: (get(x, "y0") + get(x, "y1")) / 2
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("height")), F.flatten(F.transform(F.filter("b", wide), lambda x: F.array(get(x, "y0"), get(x, "y1")))))))
    pages = pages.withColumn("edges", edges)

    def held(x: Column, i: Column) -> Column:
        return centre(x).between(F.get("edges", i), F.get("edges", i + 1))

    def fits(x: Column, c: Column) -> Column:
        common = F.least(get(x, "x1"), get(c, "x1")) - F.greatest(get(x, "x0"), get(c, "x0"))
        narrow = F.least(get(x, "x1") - get(x, "x0"), get(c, "x1") - get(c, "x0"))
        inside = (common > 0) & (get(x, "x0") >= get(c, "x0") - SLACK) & (get(x, "x1") <= get(c, "x1") + SLACK)
        return (common > JOINED * narrow) | inside

    def column(state: Column, x: Column) -> Column:
        columns = get(state, "columns")
        k = F.coalesce(F.array_position(F.transform(columns, lambda c: fits(x, c)), True), F.lit(0)).cast("int")
        grown = F.transform(columns, lambda c, i: F.when(i == k - 1, F.struct(F.least(get(c, "x0"), get(x, "x0")).alias("x0"), F.greatest(get(c, "x1"), get(x, "x1")).alias("x1"))).otherwise(c))
        more = F.array_append(columns, F.struct(get(x, "x0").alias("x0"), get(x, "x1").alias("x1")))
        of = F.struct(get(x, "block").alias("block"), F.when(k > 0, k - 1).otherwise(F.size(columns)).alias("col"))
        return F.struct(F.when(k > 0, grown).otherwise(more).alias("columns"), F.array_append(get(state, "of"), of).alias("of"))

    block = blocks.schema["block"].dataType.simpleString()
    start = F.struct(F.array().cast("array<struct<x0:double,x1:double>>").alias("columns"), F.array().cast(f"array<struct<block:{block},col:int>>").alias("of"))

    def of_band(i: Column) -> Column:
        mine = F.filter("b", lambda x: ~wide(x) & held(x, i))
        across = F.array_sort(F.transform(mine, lambda x, j: F.struct(get(x, "x0").alias("from"), j.alias("j"), *[get(x, c).alias(c) for c in box])))
        return F.struct(i.alias("band"), F.aggregate(across, start, column, lambda s: get(s, "of")).alias("of"))

    bands = F.sequence(F.lit(0), F.size("edges") - 2)
    pages = pages.withColumn("bands", F.transform(bands, of_band))

    def placed(x: Column) -> Column:
        band = F.coalesce(F.get(F.filter(bands, lambda i: held(x, i)), F.lit(0)), F.lit(0))
        mine = F.filter(get(F.get("bands", band), "of"), lambda o: get(o, "block") == get(x, "block"))
        col = F.when(wide(x), F.lit(0)).otherwise(F.coalesce(get(F.get(mine, F.lit(0)), "col"), F.lit(0)))
        line = F.bround(get(x, "y0") / 5) * 5
        turned = [(90, [-F.bround(get(x, "y1") / 5) * 5, get(x, "x0")]), (180, [-get(x, "y0"), -get(x, "x0")]), (270, [line, -get(x, "x0")])]
        upright = F.array(band.cast("double"), col.cast("double"), F.bround(get(x, "y0") / 3) * 3, get(x, "x0"))
        order = upright
        for angle, by in turned:
            order = F.when(F.col("rotation") == angle, F.array(*by)).otherwise(order)
        flat = F.coalesce(F.col("rotation").isin(90, 180, 270), F.lit(False))
        return F.struct(order.alias("order"), get(x, "block").alias("block"), F.when(flat, F.lit(0)).otherwise(band).alias("band"), F.when(flat, F.lit(0)).otherwise(col).alias("col"))

    ordered = pages.select(*keys, F.posexplode(F.array_sort(F.transform("b", placed))).alias("position", "x"))
    found = ordered.select(*keys, F.col("x.block").alias("block"), F.col("x.band").alias("band"), F.col("x.col").alias("col"), (F.col("position") + 1).alias("position"))
    return blocks.join(found, [*keys, "block"])


def joined_lines(lines: Column) -> Column:
    """Lines (text, y0, y1) of a block as text: hyphens at line ends are closed, a gap over 6 makes a paragraph.

    Order is as given.
    """

    def step(state: Column, x: Column) -> Column:
        text, last = state.getField("t"), state.getField("y")
        first = F.length(text) == 0
        hyphen = text.rlike(r"\p{L}-$") & x.getField("text").rlike(r"^\p{Ll}")
        gap = x.getField("y0") - last > 6
        more = F.when(first, x.getField("text")).when(gap, F.concat(text, F.lit("\n\n"), x.getField("text"))).when(hyphen, F.concat(F.regexp_replace(text, "-$", ""), x.getField("text"))).otherwise(F.concat(text, F.lit(" "), x.getField("text")))
        return F.struct(more.alias("t"), x.getField("y1").cast("double").alias("y"))

    return F.aggregate(lines, F.struct(F.lit("").alias("t"), F.lit(0.0).alias("y")), step, lambda s: s.getField("t"))


def table_cells(words: DataFrame, cells: DataFrame, *keys: str) -> DataFrame:
    """Words grouped by the first table cell that holds their middle; words in no cell keep null."""
    middle = words.select(*keys, F.col("word").alias("point"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    hit = first_containing(middle, cells.withColumn("color", F.lit(None).cast("string")).withColumnRenamed("cell", "rect"), *keys)
    return words.join(hit.select(*keys, F.col("point").alias("word"), F.col("rect").alias("cell")), [*keys, "word"], "left")
