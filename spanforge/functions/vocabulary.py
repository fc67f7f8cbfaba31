"""The label vocabulary and its tags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight labels in the order of label vectors, and other spellings of them.
VALUES = ["social", "economic", "political", "historic", "aesthetical", "scientific", "age", "ecological"]
ALIASES = {
    "aesthetic": "aesthetical",
    "aesthetics": "aesthetical",
    "history": "historic",
    "historical": "historic",
    "economical": "economic",
    "politic": "political",
    "politics": "political",
    "science": "scientific",
    "ecology": "ecological",
    "ecologic": "ecological",
}
TAGS = ["O", *(f"{p}-{v}" for v in VALUES for p in "BI")]

#: White space as Unicode has it, with the separators U+001C..U+001F.
BLANK = r"(?U)[\s\x1c-\x1f]"


def vocab() -> Column:
    return F.array(*[F.lit(v) for v in VALUES])


def tags() -> Column:
    return F.array(*[F.lit(t) for t in TAGS])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def normalise_value(name: Column) -> Column:
    """The label for a name in any spelling, or null."""
    key = F.lower(strip(name))
    alias = F.create_map(*[F.lit(x) for kv in {**ALIASES, **{v: v for v in VALUES}}.items() for x in kv])
    return F.element_at(alias, key)


def one_hot(values: Column) -> Column:
    return F.transform(vocab(), lambda v: F.coalesce(F.array_contains(values, v), F.lit(False)).cast("int"))


def decode(bits: Column) -> Column:
    """Labels of a 0/1 vector, in vocabulary order."""
    return F.filter(F.transform(vocab(), lambda v, i: F.when(F.get(bits, i) == 1, v)), lambda v: v.isNotNull())


def tag_value(tag: Column) -> Column:
    """The label of a tag, null for O."""
    return F.when(tag != "O", F.substring(tag, 3, 1000))


def canonical_tag(tag: Column) -> Column:
    """A tag with its label in canonical spelling; null if it is no tag of the set."""
    prefix, value = F.substring_index(tag, "-", 1), normalise_value(F.regexp_extract(tag, r"(?s)^[^-]*-(.*)$", 1))
    good = prefix.isin("B", "I") & F.contains(tag, F.lit("-"))
    return F.when(tag == "O", tag).when(good & value.isNotNull(), F.concat(prefix, F.lit("-"), value))


def canonical_tags(found: Column) -> Column:
    """All tags canonical, or null if one of them is unknown."""
    out = F.transform(found, canonical_tag)
    return F.when(~F.exists(out, lambda t: t.isNull()), out)
