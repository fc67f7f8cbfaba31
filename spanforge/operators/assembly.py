"""Text of documents from the words of their pages, with the place of every word.

Words become pieces: a word that ends in a hyphen at a line's end is closed with the
next line's first one.  Every piece is followed by one character, a space or a line
feed, so a piece's place is a sum of the lengths before it: within its block, and of
the blocks before it.  Sums are made on these two levels, and no window orders all
words of a document.  Sentences and coloured entities
then are intervals over the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.sentences import sentence_parts
from spanforge.functions.text import strip_speaker
from spanforge.operators.layout import words_in_sentences
from spanforge.operators.spans import let

#: Gaps that break a paragraph: between lines of a block, and between blocks of a turned page (fixed values).
LINE_GAP, BLOCK_GAP = 6.0, 18.0


def block_pieces(words: DataFrame, *keys: str) -> DataFrame:
    """Pieces of each block: (keys, page, block, word, text, color, feed, at, last).

    words: keys, page, block, word, line, text, color, y0, y1.  A piece has the number
    of its first word and the colour of the first word that has one; of several
    hyphens in a row every second one closes.  feed: whether the line before lies more
    than LINE_GAP higher; at: the piece's place in its block; last: the block's last word.
    """
    part = [*keys, "page", "block"]
    order = Window.partitionBy(*part).orderBy("word")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = F.lead("line").over(order)
    open_ = F.col("text").endswith("-") & F.coalesce(behind != F.col("line"), F.lit(False))
    feed = F.coalesce((F.lag("line").over(order) != F.col("line")) & (F.col("y0") - F.lag("y1").over(order) > LINE_GAP), F.lit(False))
    rows = words.select(*part, "word", "text", "color", "line", "y0", "y1")
    rows = rows.select("*", F.row_number().over(order).alias("n"), open_.alias("open"), feed.alias("feed"), F.lead("text").over(order).alias("next"), F.lead("color").over(order).alias("next_color"))
    closed = F.coalesce(F.max(F.when(~F.col("open"), F.col("n"))).over(before), F.lit(0))
    rows = rows.withColumn("head", F.col("open") & ((F.col("n") - closed) % 2 == 1))
    rows = rows.withColumn("gone", F.coalesce(F.lag("head").over(order), F.lit(False)))
    rows = rows.withColumn("last", F.last("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).filter(~F.col("gone"))
    text = F.when(F.col("head"), F.concat(F.expr("left(text, length(text) - 1)"), F.col("next"))).otherwise(F.col("text"))
    color = F.when(F.col("head"), F.coalesce("color", "next_color")).otherwise(F.col("color"))
    pieces = rows.select(*part, "word", text.alias("text"), color.alias("color"), "feed", "last")
    at = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return pieces.withColumn("at", at)


def block_places(blocks: DataFrame, pieces: DataFrame, *keys: str) -> DataFrame:
    """(keys, page, block, at, feed): where each block with words starts in its document, and whether a line feed stands before it.

    blocks: keys, page, block, position (reading order), band, col, x0, y0, x1, y1,
    rotation.  A block is parted from the next one, with words or without, by a line
    feed if it stands in another band or column or on another line, rounded to threes;
    on turned pages if its last word ends a sentence or the next lies further than
    BLOCK_GAP.  Pages follow each other with a space.
    """
    part = [*keys, "page"]
    sizes = pieces.groupBy(*part, "block").agg(F.sum(F.length("text") + 1).alias("size"), F.max("last").alias("last"))
    rows = blocks.select(*part, "block", "position", "band", "col", "x0", "y0", "x1", "y1", "rotation").join(sizes, [*part, "block"], "left")
    order = Window.partitionBy(*part).orderBy("position")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.lead(c).over(order)
    line = lambda y: F.bround(y / 3) * 3
    turned = F.col("rotation").isin(90, 270)
    ends = F.trim("last").rlike("[:.?]$")
    gap = F.when(F.col("rotation") == 90, ahead("x0") - F.col("x1")).otherwise(ahead("y0") - F.col("y1"))
    other = (ahead("band") != F.col("band")) | (ahead("col") != F.col("col"))
    feed = other | F.when(turned, ends | (gap > BLOCK_GAP)).otherwise(line(ahead("y0")) != line(F.col("y0")))
    rows = rows.withColumn("behind", F.when(F.col("size").isNotNull(), F.coalesce(feed, F.lit(False))))
    rows = rows.withColumn("feed", F.coalesce(F.last("behind", ignorenulls=True).over(before), F.lit(False))).filter("size is not null")
    earlier = Window.partitionBy(*keys).orderBy("page", "position").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*part, "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("at"), "feed")


def placed_words(words: DataFrame, blocks: DataFrame, *keys: str, keep=lambda df: df) -> DataFrame:
    """(keys, page, block, word, text, color, start, end, glue): pieces with their characters in the document.

    glue is what stands before a piece: nothing before the first one of a document.
    Words whose block is not among the blocks go, as headers and page numbers do.
    keep writes a table and reads it again: pieces are read for their sizes, then for
    themselves, and are made once that way.
    """
    pieces = keep(block_pieces(words.join(blocks.select(*keys, "page", "block"), [*keys, "page", "block"], "left_semi"), *keys))
    places = block_places(blocks, pieces, *keys)
    found = pieces.withColumnsRenamed({"at": "inner", "feed": "inner_feed"}).join(places, [*keys, "page", "block"])
    start = F.col("at") + F.col("inner")
    feed = F.when(F.col("inner") == 0, F.col("feed")).otherwise(F.col("inner_feed"))
    glue = F.when(start == 0, "").when(feed, "\n").otherwise(" ")
    return found.select(*keys, "page", "block", "word", "text", "color", start.alias("start"), (start + F.length("text")).alias("end"), glue.alias("glue"))


def document_texts(placed: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): the text of each document, built by pages."""
    joined = lambda parts: F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p.getField("t")), "")
    pages = placed.groupBy(*keys, "page").agg(joined(F.struct("start", F.concat("glue", "text").alias("t"))).alias("t"))
    return pages.groupBy(*keys).agg(joined(F.struct("page", "t")).alias("text"))


def sentences_of(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, sentence, ss, se, text): sentences of each text with their characters; a leading "name:" goes and moves the start."""
    each = texts.select(*keys, F.posexplode(sentence_parts(F.col("text"))).alias("sentence", "s"))
    cut = each.select(*keys, "sentence", F.col("s.start").alias("ss"), F.col("s.end").alias("se"), F.col("s.text").alias("whole"))
    named = cut.withColumn("cut", strip_speaker(F.col("whole")))
    return named.select(*keys, "sentence", (F.col("ss") + F.col("cut.shift")).alias("ss"), "se", F.trim("cut.text").alias("text"))


def named_sentences(text: Column) -> Column:
    """sentences_of for one text inside the row: array of structs (ss, se, text)."""

    def cut(s: Column) -> Column:
        return let(strip_speaker(s.getField("text")), lambda c: F.struct((s.getField("start") + c.getField("shift")).alias("ss"), s.getField("end").alias("se"), F.trim(c.getField("text")).alias("text")))

    return F.transform(sentence_parts(text), cut)


def coloured_entities(placed: DataFrame, sentences: DataFrame, *keys: str) -> DataFrame:
    """(keys, sentence, entity, color, start, end, text, page): runs of one colour among a sentence's words, by the sentence's characters.

    Words that leave the sentence don't count; spaces in front and spaces and any of
    , . : ; at the end are no part of an entity; page is that of the sentence's first word.
    """
    part = [*keys, "sentence"]
    words = placed.withColumn("word", F.col("start")).withColumnsRenamed({"start": "ws", "end": "we"})
    rows = words_in_sentences(words, sentences, *keys, more=("color", "page", "ws", "we", "ss"))
    order = Window.partitionBy(*part).orderBy("ws")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = F.when(F.lag("color").over(order).eqNullSafe(F.col("color")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    rows = rows.withColumn("change", changed).withColumn("page", F.first("page").over(order)).withColumn("run", F.sum("change").over(so_far))
    runs = rows.filter("color is not null").groupBy(*part, "run", "color").agg(F.min(F.col("ws") - F.col("ss")).alias("start"), F.max(F.col("we") - F.col("ss")).alias("end"), F.min("page").alias("page"))
    number = F.row_number().over(Window.partitionBy(*part).orderBy("run"))
    with_text = runs.join(sentences.select(*part, F.col("text").alias("whole")), part)
    clean = F.rtrim(F.expr("substring(whole, cast(start as int) + 1, cast(end - start as int))"), F.lit(" ,.:;"))
    return with_text.select(*part, number.alias("entity"), "color", "start", (F.col("start") + F.length(clean)).alias("end"), clean.alias("text"), "page")


def highlight_records(entities: DataFrame, sentences: DataFrame, *keys: str, labels: Column | None = None) -> DataFrame:
    """(keys, sentence_id, page, sentence, values, entities): a record for each sentence with a coloured entity.

    labels: a map from colours to labels; a colour without one is its own label.
    Numbers follow the sentences: those of a page by a window, pages by sums.
    """
    label = F.coalesce(F.element_at(labels, F.col("color")), F.col("color")) if labels is not None else F.col("color")
    part = [*keys, "sentence"]
    each = F.struct("entity", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text", label.alias("label"), "color")
    rows = entities.groupBy(*part).agg(F.array_sort(F.collect_list(each)).alias("e"), F.min("page").alias("page"))
    rows = rows.join(sentences.select(*part, F.col("text").alias("sentence_text")), part)
    pages = rows.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(pages.select(*keys, "page", earlier.alias("earlier")), [*keys, "page"])
    number = F.col("earlier") + F.row_number().over(Window.partitionBy(*keys, "page").orderBy("sentence"))
    found = F.transform("e", lambda x: F.struct(*[x.getField(c).alias(c) for c in ("start", "end", "text", "label", "color")]))
    values = F.array_sort(F.array_distinct(F.transform("e", lambda x: x.getField("label"))))
    return numbered.select(*keys, number.cast("int").alias("sentence_id"), "page", F.col("sentence_text").alias("sentence"), values.alias("values"), found.alias("entities"))


def sentence_records(found: DataFrame, palette: Column, labels: Column | None = None) -> DataFrame:
    """Adds values and entities as in highlight_records to sentences with runs (start, end, color); color is a place in the palette, from 1."""

    def entity(r: Column) -> Column:
        clean = F.rtrim(F.substring(F.col("sentence"), r.getField("start") + 1, r.getField("end") - r.getField("start")), F.lit(" ,.:;"))
        color = F.get(palette, r.getField("color") - 1)
        label = color if labels is None else F.coalesce(F.element_at(labels, color), color)
        return let(clean, lambda t: F.struct(r.getField("start").alias("start"), (r.getField("start") + F.length(t)).alias("end"), t.alias("text"), label.alias("label"), color.alias("color")))

    rows = found.withColumn("entities", F.transform("runs", entity)).drop("runs")
    return rows.withColumn("values", F.array_sort(F.array_distinct(F.transform("entities", lambda x: x.getField("label")))))
