"""Sentences of a text, as character offsets, in expressions.

A sentence starts at the first character that is no punctuation behind

* a terminator, whatever punctuation and white space lie between, with white space
  among it; punctuation that opens the next sentence so stays with the one before;
* a line feed, unless it is an opening parenthesis;

and never right behind an opening parenthesis.  Terminators are ! and ?, and a
period behind a lower-case letter, a digit, punctuation or two capitals, so an
initial ends nothing; a period between a lower-case letter and a capital
ends a sentence without white space.  Several periods in a row and periods of
abbreviations end nothing.  Abbreviations are a parameter: tokenizers with long lists of
exceptions, clitics and addresses cut some texts elsewhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.operators.spans import let

SPACES = r" \t\n\r\f\x0B"
BLANKS = " \t\n\r\f\x0b"
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "vs", "e.g", "i.e", "bijv", "dhr", "mevr", "nr", "blz"]
#: A character that no text holds; it marks where sentences start.
MARK = "\uFDD0"


def marked(text: Column, abbreviations: list[str] | None = None) -> Column:
    """The text with a mark where each sentence but the first starts."""
    words = "|".join(re.escape(a) for a in (ABBREVIATIONS if abbreviations is None else abbreviations))
    known = rf"(?<!(?:^|[{SPACES}\p{{P}}{MARK}])(?:{words}))" if words else ""
    period = rf"(?:(?<=[\p{{Ll}}\p{{N}}\p{{P}}{SPACES}])|^|(?<=\p{{Lu}}\p{{Lu}})){known}(?<!\.)\.(?!\.)"
    # a look ahead for the terminator comes first: what stands behind is only looked at there
    behind = rf"((?=[.!?])(?:{period}|[!?])\p{{P}}*+[{SPACES}][{SPACES}\p{{P}}]*)(?<!\()(?=[^{SPACES}\p{{P}}])"
    inside = rf"((?=\.)(?<=\p{{Ll}}){known}\.)(?=\p{{Lu}})"
    lines = rf"(\n[{SPACES}]*)(?=[^{SPACES}(])"
    for pattern in (behind, inside, lines):
        text = F.regexp_replace(text, pattern, "$1" + MARK)
    return text


def running(numbers: Column) -> Column:
    """The sum of the numbers before each one, for an array of whole numbers.

    Sums run within blocks of about the root of the array's size, and over the blocks,
    so growing arrays stay short and long ones cost little more than their length.
    """

    def sums(x: Column) -> Column:
        return F.slice(F.aggregate(x, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n)), 1, F.size(x))

    def in_blocks(x: Column, size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / size).cast("int") - 1, F.lit(0))), lambda b: F.slice(x, b * size + 1, size))
        whole = let(blocks, lambda bs: let(sums(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))), lambda starts: F.flatten(F.transform(bs, lambda b, i: F.transform(sums(b), lambda n: n + F.get(starts, i))))))
        return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(whole)

    return let(numbers, lambda x: let(F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int"), lambda size: in_blocks(x, size)))


def sentence_parts(text: Column, abbreviations: list[str] | None = None) -> Column:
    """array<struct<start,end,text>> of the sentences of a text, in code points, white space at their ends left out; none for null.

    The text is cut once, so a sentence is not looked for from the text's beginning.
    """
    blank = F.lit(BLANKS)

    def spans(parts: Column) -> Column:
        return let(running(F.transform(parts, lambda p: F.length(p))), lambda at: F.transform(parts, lambda p, i: trimmed(p, F.get(at, i))))

    def trimmed(part: Column, at: Column) -> Column:
        placed = let(F.ltrim(part, blank), lambda t: F.struct((at + F.length(part) - F.length(t)).alias("start"), F.rtrim(t, blank).alias("text")))
        return let(placed, lambda x: F.struct(x.getField("start").alias("start"), (x.getField("start") + F.length(x.getField("text"))).alias("end"), x.getField("text").alias("text")))

    found = let(F.split(marked(text, abbreviations), MARK), spans)
    return F.coalesce(F.filter(found, lambda s: s.getField("text") != ""), F.array().cast("array<struct<start:int,end:int,text:string>>"))


def sentence_spans(text: Column, abbreviations: list[str] | None = None) -> Column:
    """array<struct<start,end>>: the places alone."""
    return F.transform(sentence_parts(text, abbreviations), lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end")))
