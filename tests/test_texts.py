"""Documents from words of pages: hyphens, places, sentences, coloured records."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions.sentences import running, sentence_spans
from spanforge.operators import assembly

WORDS = "doc int, page int, block int, word int, line int, text string, color string, y0 double, y1 double"
BLOCKS = "doc int, page int, block int, position int, band int, col int, x0 double, y0 double, x1 double, y1 double, rotation int"


def word_rows(page, block, lines, first=0, gap=2.0, colors=None):
    """Lines of words, ten high, some gap between them."""
    out, n = [], first
    for k, line in enumerate(lines):
        for text in line.split(" "):
            out.append((1, page, block, n, k, text, (colors or {}).get(text), k * (10 + gap), k * (10 + gap) + 10))
            n += 1
    return out


def block_row(page, block, position, band=0, col=0, y0=0.0, rotation=0, x0=0.0):
    return (1, page, block, position, band, col, x0, y0, x0 + 50.0, y0 + 20.0, rotation)


def placed(spark, words, blocks):
    return assembly.placed_words(spark.createDataFrame(words, WORDS).repartition(3), spark.createDataFrame(blocks, BLOCKS), "doc")


def text_of(spark, words, blocks):
    return assembly.document_texts(placed(spark, words, blocks), "doc").first().text


def test_hyphens_close_in_pairs(spark):
    words = word_rows(1, 1, ["the set-", "tle- ment", "a-", "b-", "c-", "d end- of"])
    assert text_of(spark, words, [block_row(1, 1, 0)]) == "the settle- ment ab- cd end- of"
    got = {r.word: (r.start, r.end) for r in placed(spark, words, [block_row(1, 1, 0)]).collect()}
    assert got == {0: (0, 3), 1: (4, 11), 3: (12, 16), 4: (17, 20), 6: (21, 23), 8: (24, 28), 9: (29, 31)}


def test_breaks(spark):
    words = word_rows(1, 1, ["one two", "three"], gap=7.0) + word_rows(1, 2, ["four"], 10) + word_rows(1, 3, ["five"], 20) + word_rows(2, 1, ["six"]) + word_rows(4, 1, ["seven"])
    blocks = [block_row(1, 1, 0), block_row(1, 2, 1, y0=1.0), block_row(1, 3, 2, col=1), block_row(2, 1, 0), block_row(3, 1, 0), block_row(4, 1, 0)]
    assert text_of(spark, words, blocks) == "one two\nthree four\nfive six seven"  # a line rounds to the same height; another column doesn't
    far = [block_row(1, 1, 0), block_row(1, 2, 1, y0=30.0)]
    assert text_of(spark, words, far) == "one two\nthree\nfour"
    # a block without words stands between: what follows the first is parted as from that one
    between = [block_row(1, 1, 0), block_row(1, 9, 1, y0=0.0), block_row(1, 2, 2, y0=90.0)]
    assert text_of(spark, words, between) == "one two\nthree four"


@pytest.mark.parametrize(("last", "x0", "glue"), [("end.", 0.0, "\n"), ("end", 60.0, " "), ("end", 80.0, "\n"), ("end:", 60.0, "\n"), ("end?", 60.0, "\n")])
def test_breaks_of_turned_pages(spark, last, x0, glue):
    words = word_rows(1, 1, [f"the {last}"]) + word_rows(1, 2, ["next"], 10)
    blocks = [block_row(1, 1, 0, rotation=90), block_row(1, 2, 1, rotation=90, x0=x0, y0=200.0)]
    assert text_of(spark, words, blocks) == f"the {last}{glue}next"


def test_sentences_go_on_over_pages(spark):
    colors = {"fort": "#FFFF00", "structure,": "#FFFF00", "bastions,": "#00B0F0"}
    words = word_rows(1, 1, ["Old note. The fort structure, provided with five"], colors=colors) + word_rows(1, 2, ["3"], 50) + word_rows(2, 1, ["bastions, was laid out."], colors=colors)
    blocks = [block_row(1, 1, 0), block_row(2, 1, 0)]  # the page number's block is left out
    at = placed(spark, words, blocks)
    sentences = assembly.sentences_of(assembly.document_texts(at, "doc"), "doc")
    found = assembly.highlight_records(assembly.coloured_entities(at, sentences, "doc"), sentences, "doc", labels=F.create_map(F.lit("#FFFF00"), F.lit("social"))).collect()
    assert [(r.sentence_id, r.page, r.sentence, r["values"]) for r in found] == [(1, 1, "The fort structure, provided with five bastions, was laid out.", ["#00B0F0", "social"])]
    assert [tuple(e) for e in found[0].entities] == [(4, 18, "fort structure", "social", "#FFFF00"), (39, 47, "bastions", "#00B0F0", "#00B0F0")]
    assert all(found[0].sentence[e.start : e.end] == e.text for e in found[0].entities)


def test_a_name_in_front_moves_the_places(spark):
    words = word_rows(1, 1, ["Label: First sentence. Second one."], colors={"First": "#FFFF00", "Label:": "#FFFF00", "Second": "#FFFF00"})
    at = placed(spark, words, [block_row(1, 1, 0)])
    sentences = assembly.sentences_of(assembly.document_texts(at, "doc"), "doc")
    got = {r.sentence: (r.text, r.start, r.end) for r in assembly.coloured_entities(at, sentences, "doc").collect()}
    assert got == {0: ("First", 0, 5), 1: ("Second", 0, 6)}
    assert [r.text for r in sentences.orderBy("sentence").collect()] == ["First sentence.", "Second one."]


def test_no_words(spark):
    none = placed(spark, word_rows(1, 1, ["a"]), [block_row(1, 7, 0)])
    assert none.count() == 0 and assembly.document_texts(none, "doc").count() == 0


@pytest.mark.parametrize(
    ("text", "sentences"),
    [
        ('The fort. It was old! Was it? (Yes. No.) "End." Next one', ["The fort.", "It was old!", "Was it? (Yes.", 'No.) "', 'End."', "Next one"]),
        ("line one\nline two\n(not this) x.\n\n  Last", ["line one", "line two\n(not this) x.", "Last"]),
        ("e.g. this by Dr. Who. A. Smith came at 3.5 km in 1990. UNESCO. Then... more. end.Next www.a.org", ["e.g. this by Dr. Who.", "A. Smith came at 3.5 km in 1990.", "UNESCO.", "Then... more.", "end.", "Next www.a.org"]),
        ("ends. St.Paul", ["ends.", "St.Paul"]),
        (". Abc . def", [".", "Abc .", "def"]),
        ("\n- item\n- more", ["- item", "- more"]),
        ("  ", []),
        ("", []),
        (None, []),
    ],
)
def test_sentences(spark, text, sentences):
    spans = spark.createDataFrame([(text,)], "t string").select(sentence_spans(F.col("t")).alias("s")).first().s
    assert [text[a:b] for a, b in spans] == sentences


def test_long_texts_are_cut_in_time(spark):
    df = spark.createDataFrame([("Abc def. " * 50_000,)], "t string")
    assert df.select(F.size(sentence_spans(F.col("t"))).alias("n")).first().n == 50_000


def test_running_sums(spark):
    for n in (0, 1, 2, 5, 17, 100):
        x = [(i * 7) % 5 for i in range(n)]
        got = spark.createDataFrame([(x,)], "x array<int>").select(running(F.col("x")).alias("r")).first().r
        assert got == [sum(x[:i]) for i in range(n)]
