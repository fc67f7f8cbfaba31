"""Text, colour and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.operators.spans import let

from spanforge.functions.vocabulary import BLANK, strip


def normalise_space(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def stable_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(c.cast("binary")), 1, 12))


def effective_text(curated: Column, sentence: Column) -> Column:
    return strip(F.coalesce(F.when(curated != "", curated), sentence, F.lit("")))


# Ligatures, and the letter that some PDF fonts use for the hyphen, with their replacements.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st", "\u0372": "-"}


def expand_ligatures(c: Column, table: dict[str, str] | None = None) -> Column:
    for a, b in (table or LIGATURES).items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# Stop words that tell English from Dutch.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "is", "in", "that", "it", "was", "for"],
    "nl": ["de", "het", "en", "van", "ik", "je", "we", "ze", "op", "in"],
}


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)


def language(c: Column, stop: dict[str, list[str]] | None = None) -> Column:
    """nl if it has strictly more stop words than en, else en."""
    stop = stop or STOP_WORDS

    def among(names: list[str]):
        return lambda w: w.isin(*names)

    count = {k: F.size(F.filter(words(c), among(s))) for k, s in stop.items()}
    return F.when(count["nl"] > count["en"], "nl").otherwise("en")


SPEAKER = r"(?U)^(\w+(?:\s+\w+){0,2})\s*:\s*"


def strip_speaker(c: Column) -> Column:
    """A struct of the text without a leading "name:" and how many characters went."""
    cut = F.when(~F.contains(c, F.lit(":")), 0).otherwise(F.length(F.regexp_extract(c, SPEAKER, 0)))
    return let(cut, lambda n: F.struct(F.substring(c, n + 1, F.length(c)).alias("text"), n.alias("shift")))


def unreadable(c: Column, least: int = 200, share: float = 0.15) -> Column:
    """At least so many visible characters, but few letters among them."""
    visible = F.regexp_count(c, F.lit(r"(?U)\S"))
    return (visible >= least) & (F.regexp_count(c, F.lit(r"\p{L}")) < share * visible)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def rgb(hex_: Column) -> list[Column]:
    return [F.conv(F.substring(hex_, at, 2), 16, 10).cast("int") for at in (2, 4, 6)]


def is_colourful(hex_: Column, least: int = 30) -> Column:
    return F.greatest(*rgb(hex_)) - F.least(*rgb(hex_)) > least


def contrast(hex_: Column) -> Column:
    """Black text on light colours, white on dark ones, by luminance."""
    r, g, b = rgb(hex_)
    return F.when(r * 299 + g * 587 + b * 114 >= 150_000, "#000000").otherwise("#FFFFFF")


# Highlight names of word processors, and names of common colours.
HIGHLIGHTS = {
    "YELLOW": "#FFFF00",
    "BRIGHT_GREEN": "#00FF00",
    "TURQUOISE": "#00FFFF",
    "PINK": "#FF00FF",
    "BLUE": "#0000FF",
    "RED": "#FF0000",
    "DARK_BLUE": "#000080",
    "TEAL": "#008080",
    "GREEN": "#008000",
    "VIOLET": "#800080",
    "DARK_RED": "#800000",
    "DARK_YELLOW": "#808000",
    "GRAY_50": "#808080",
    "GRAY_25": "#C0C0C0",
    "BLACK": "#000000",
}
COLOR_NAMES = {
    "#000000": "Black",
    "#000080": "Navy",
    "#0000FF": "Blue",
    "#008000": "Green",
    "#00FF00": "Bright green",
    "#00FFFF": "Turquoise",
    "#800000": "Dark red",
    "#800080": "Violet",
    "#FF0000": "Red",
    "#FF00FF": "Magenta",
    "#FFFF00": "Yellow",
    "#FFFFFF": "White",
}
#: The same highlights as document files spell them.
DOCX_HIGHLIGHTS = {
    "yellow": "#FFFF00",
    "green": "#00FF00",
    "cyan": "#00FFFF",
    "magenta": "#FF00FF",
    "blue": "#0000FF",
    "red": "#FF0000",
    "darkBlue": "#000080",
    "darkCyan": "#008080",
    "darkGreen": "#008000",
    "darkMagenta": "#800080",
    "darkRed": "#800000",
    "darkYellow": "#808000",
    "darkGray": "#808080",
    "lightGray": "#C0C0C0",
    "black": "#000000",
}


def color_name(hex_: Column) -> Column:
    """The name of a common colour, or "Near" and that of the nearest one."""
    exact = F.element_at(F.create_map(*[F.lit(x) for kv in COLOR_NAMES.items() for x in kv]), hex_)
    near = nearest_color(hex_, {name: code for code, name in COLOR_NAMES.items()})
    return F.coalesce(exact, F.concat(F.lit("Near "), F.lower(near)))


def stays_inside(path: Column) -> Column:
    """Whether a path is relative and has no part that goes up."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def stays_below(path: Column) -> Column:
    """Whether a path is relative and, with its parts that go up, never leaves the folder it starts in."""

    def step(at: Column, part: Column) -> Column:
        to = at + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.when((at < 0) | (to < 0), -1).otherwise(to)

    return ~path.startswith("/") & (F.aggregate(F.split(path, "/"), F.lit(0), step) >= 0)


def is_margin_code(c: Column) -> Column:
    """Whether a block is only a code from the margin, such as EN1 or SO3/EN1."""
    return F.trim(c).isin("AUT", "INT", "N.v.t.") | F.trim(c).rlike(r"^[A-Z]{2}\d(/[A-Z]{2}\d)*$")


def highlight_hex(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in HIGHLIGHTS.items() for x in kv]), name)


def nearest_color(hex_: Column, names: dict[str, str]) -> Column:
    """The name of the nearest of some colours; the first of equally near ones."""
    r, g, b = rgb(hex_)
    far = []
    for i, (name, other) in enumerate(names.items()):
        d = sum((c - int(other[at : at + 2], 16)) ** 2 for c, at in ((r, 1), (g, 3), (b, 5)))
        far.append(F.struct(d.cast("int").alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    return F.least(*far).getField("name")


def page_numbers(spec: Column) -> Column:
    """Sorted distinct pages of a range list like 1-3,7; null if a part is no range or runs backwards."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    good = F.forall(parts, lambda p: p.rlike(r"^[1-9]\d*(\s*-\s*[1-9]\d*)?$"))
    ends = lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int"))
    forward = F.forall(parts, lambda p: F.element_at(ends(p), 1) <= F.element_at(ends(p), -1))
    pages = F.flatten(F.transform(parts, lambda p: F.sequence(F.element_at(ends(p), 1), F.element_at(ends(p), -1))))
    return F.when(good, F.when(forward & (F.size(parts) > 0), F.array_sort(F.array_distinct(pages))))
