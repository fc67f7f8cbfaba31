"""Spans of tagged token sequences, and their scores.

Sequences are rows with token arrays and tag arrays.  Spans are found inside the
row, so a sequence costs no shuffle; scores add counts over rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.scores import summary, with_scores
from spanforge.functions.vocabulary import TAGS, VALUES, tag_value, vocab
from spanforge.functions.vocabulary import tags as all_tags


def starts_span(tags: Column, tag: Column, i: Column) -> Column:
    """Whether a tag begins a span: any B, and an I that does not continue the label before it."""
    before = tag_value(F.get(tags, i - 1))
    return (tag != "O") & (F.startswith(tag, F.lit("B")) | ~F.coalesce(before == tag_value(tag), F.lit(False)))


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(tags: Column) -> Column:
    """Array of (s, e, value), e exclusive.  Starts are found by their left neighbour, ends by the right one."""

    def of(t: Column) -> Column:
        n = F.size(t)

        def ends(tag: Column, i: Column) -> Column:
            after = F.get(t, i + 1)
            return (tag != "O") & ((i == n - 1) | (after == "O") | starts_span(t, after, i + 1))

        first = F.filter(F.transform(t, lambda x, i: F.when(starts_span(t, x, i), F.struct(i.alias("s"), tag_value(x).alias("value")))), lambda x: x.isNotNull())
        last = F.filter(F.transform(t, lambda x, i: F.when(ends(x, i), i + 1)), lambda x: x.isNotNull())
        return F.zip_with(first, last, lambda a, e: F.struct(a.getField("s").alias("s"), e.alias("e"), a.getField("value").alias("value")))

    return let(tags, of)


def span_rows(sequences: DataFrame, tags: str, *keys: str) -> DataFrame:
    return sequences.select(*keys, F.inline(spans(F.col(tags))))


def coded(found: Column) -> Column:
    """Tags as numbers: 1 for O, twice a label's number for its B and one more for its I, 0 for a tag of no label."""
    return F.transform(found, lambda t: F.coalesce(F.array_position(all_tags(), t), F.lit(0)).cast("int"))


LABEL_BITS, END_BITS = 4, 30


def span_numbers(codes: Column) -> Column:
    """Spans as numbers (start, end, label), in order; set operations on numbers hash, and compare no structs."""

    def of(t: Column) -> Column:
        label = lambda c: F.shiftright(c, 1)
        inside = lambda c: c.bitwiseAND(F.lit(1)) == 1
        at = lambda i: F.coalesce(F.get(t, i), F.lit(0))
        begins = lambda c, i: (c > 1) & (~inside(c) | (label(at(i - 1)) != label(c)))
        ends = lambda c, i: (c > 1) & ~(inside(at(i + 1)) & (label(at(i + 1)) == label(c)))
        number = lambda c, i: F.shiftleft(i.cast("long"), LABEL_BITS + END_BITS) + label(c)
        first = F.filter(F.transform(t, lambda c, i: F.when(begins(c, i), number(c, i))), lambda x: x.isNotNull())
        last = F.filter(F.transform(t, lambda c, i: F.when(ends(c, i), F.shiftleft((i + 1).cast("long"), LABEL_BITS))), lambda x: x.isNotNull())
        return F.zip_with(first, last, lambda x, y: x + y)

    return let(codes, of)


def start_of(x: Column) -> Column:
    return F.shiftright(x, LABEL_BITS + END_BITS)


def end_of(x: Column) -> Column:
    return F.shiftright(x, LABEL_BITS).bitwiseAND(F.lit((1 << END_BITS) - 1))


def label_of(x: Column) -> Column:
    return F.get(vocab(), (x.bitwiseAND(F.lit((1 << LABEL_BITS) - 1)) - 1).cast("int"))


def marked(value: Column, column: str | None) -> Column:
    """(value, tp, fp, fn) with one in the given count."""
    return F.struct(value.alias("value"), *[F.lit(int(c == column)).cast("long").alias(c) for c in ("tp", "fp", "fn")])


#: What a span or token counts as; a count's number is three times its label's number and one of these.
COUNTS = {"tp": 0, "fp": 1, "fn": 2}


def counted(sequences: DataFrame, counts: Column, *keys: str) -> DataFrame:
    """Adds up arrays of counts' numbers over sequences; every label has a row for each group, null groups too.

    Numbers are counted first; labels, and zeros for every label of a group that has a
    sequence, come to the few sums.
    """
    zeros = F.transform(vocab(), lambda v: marked(v, None))
    each = sequences.select(*keys, F.explode(F.concat(counts.cast("array<int>"), F.array(F.lit(0)))).alias("c"))
    c = F.col("c")
    row = F.struct(F.get(vocab(), F.floor(c / 3).cast("int") - 1).alias("value"), *[F.when(c % 3 == k, F.col("n")).otherwise(0).alias(x) for x, k in COUNTS.items()])
    few = each.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("n")).select(*keys, F.inline(F.when(c < 3, zeros).otherwise(F.array(row))))
    if not keys:  # the labels are there even without a sequence
        few = few.unionByName(sequences.sparkSession.range(1).select(F.inline(zeros)))
    return few.filter("value is not null").groupBy(*keys, "value").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def by_value(found: Column, column: str) -> Column:
    return F.transform(found, lambda x: x.bitwiseAND(F.lit((1 << LABEL_BITS) - 1)) * 3 + COUNTS[column])


def span_counts(gold: Column, pred: Column, right: Callable[[Column, Column], Column]) -> Column:
    """Counts from coded tags by span numbers; right gives a struct of the gold (a) and the predicted spans (b) that count as right."""

    def of(pair: Column) -> Column:
        g, p = pair.getField("g"), pair.getField("p")

        def rest(found: Column) -> Column:
            a, b = found.getField("a"), found.getField("b")
            return F.concat(by_value(a, "tp"), by_value(F.array_except(p, b), "fp"), by_value(F.array_except(g, a), "fn"))

        return let(right(g, p), rest)

    return let(F.struct(span_numbers(gold).alias("g"), span_numbers(pred).alias("p")), of)


def exact_counts(gold: Column, pred: Column) -> Column:
    """Spans count as right if start, end and label agree."""
    return span_counts(gold, pred, lambda g, p: let(F.array_intersect(g, p), lambda both: F.struct(both.alias("a"), both.alias("b"))))


def token_counts(gold: Column, pred: Column) -> Column:
    """Tokens count as right if both sides give the same label, whatever the prefix; O on both sides does not count."""

    label = lambda c: F.shiftright(F.coalesce(c, F.lit(0)), 1)
    # a number below 3 is of no label
    seen = F.zip_with(gold, pred, lambda g, p: label(p) * 3 + F.when(label(g) == label(p), COUNTS["tp"]).otherwise(COUNTS["fp"]))
    missed = F.zip_with(gold, pred, lambda g, p: F.when(label(g) == label(p), 0).otherwise(label(g) * 3 + COUNTS["fn"]))
    return F.filter(F.concat(seen, missed), lambda x: x >= 3)


def spread(found: Column) -> Column:
    """For each token up to the last span's end, the number of the span that holds it, or 0."""

    def one(x: Column, i: Column) -> Column:
        gap = start_of(x) - F.coalesce(end_of(F.get(found, i - 1)), F.lit(0))
        return F.concat(F.array_repeat(F.lit(0).cast("long"), gap.cast("int")), F.array_repeat(x, (end_of(x) - start_of(x)).cast("int")))

    return F.flatten(F.transform(found, one))


def overlapping(g: Column, p: Column) -> Column:
    """Groups of pairs (less, g, p) of spans of one label that share tokens, the largest overlap first, then by place; read off the tokens.

    Pairs of different groups have no span in common: along the text, a group ends
    where the next pair shares neither span with the one before.
    """

    def pairs(both: Column) -> Column:
        new = lambda x, i: (x.getField("g") > 0) & (x.getField("p") > 0) & (label_bits(x.getField("g")) == label_bits(x.getField("p"))) & ~F.coalesce(F.get(both, i - 1) == x, F.lit(False))
        return F.filter(both, new)

    label_bits = lambda x: x.bitwiseAND(F.lit((1 << LABEL_BITS) - 1))
    zero = F.lit(0).cast("long")
    both = F.zip_with(spread(g), spread(p), lambda x, y: F.struct(F.coalesce(x, zero).alias("g"), F.coalesce(y, zero).alias("p")))
    sized = lambda x: F.struct((F.greatest(start_of(x.getField("g")), start_of(x.getField("p"))) - F.least(end_of(x.getField("g")), end_of(x.getField("p")))).alias("less"), x.getField("g").alias("g"), x.getField("p").alias("p"))

    def grouped(found: Column) -> Column:
        apart = lambda x, i: (i == 0) | ((F.get(found, i - 1).getField("g") != x.getField("g")) & (F.get(found, i - 1).getField("p") != x.getField("p")))
        first = F.filter(F.transform(found, lambda x, i: F.when(apart(x, i), i)), lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda i, k: F.array_sort(F.transform(F.slice(found, i + 1, F.coalesce(F.get(at, k + 1), F.size(found)) - i), sized))))

    return let(let(both, pairs), grouped)


def overlap_counts(gold: Column, pred: Column) -> Column:
    """A predicted span is right if it overlaps a gold span of its label; pairs are one to one, the largest overlap first.

    All inside the row: spans of a side never overlap, so the tokens name all
    pairs, and one fold over the sorted pairs of each group takes each span once;
    groups are short, however long the sequence is.
    """

    def take(state: Column, x: Column) -> Column:
        free = ~F.array_contains(state.getField("a"), x.getField("g")) & ~F.array_contains(state.getField("b"), x.getField("p"))
        more = F.struct(F.array_append(state.getField("a"), x.getField("g")).alias("a"), F.array_append(state.getField("b"), x.getField("p")).alias("b"))
        return F.when(free, more).otherwise(state)

    def right(g: Column, p: Column) -> Column:
        none = F.array().cast("array<bigint>")
        of_group = lambda pairs: F.aggregate(pairs, F.struct(none.alias("a"), none.alias("b")), take)
        both = lambda taken: F.struct(*[F.flatten(F.transform(taken, lambda x: x.getField(c))).alias(c) for c in ("a", "b")])
        return let(F.transform(overlapping(g, p), of_group), both)

    return span_counts(gold, pred, right)


def of_codes(counts: Callable[[Column, Column], Column]) -> Column:
    """Counts of the columns gold and pred, whose tags become numbers once."""
    return let(F.struct(coded(F.col("gold")).alias("g"), coded(F.col("pred")).alias("p")), lambda x: counts(x.getField("g"), x.getField("p")))


def exact_scores(sequences: DataFrame, *keys: str) -> DataFrame:
    return with_scores(counted(sequences, of_codes(exact_counts), *keys))


def token_scores(sequences: DataFrame, *keys: str) -> DataFrame:
    return with_scores(counted(sequences, of_codes(token_counts), *keys))


def overlap_scores(sequences: DataFrame, *keys: str) -> DataFrame:
    return with_scores(counted(sequences, of_codes(overlap_counts), *keys))


def all_scores(sequences: DataFrame, *keys: str) -> DataFrame:
    """Micro and macro scores of the three ways side by side; sequences are read once for all of them."""
    ways = {"exact_span": exact_counts, "overlap_span": overlap_counts, "token": token_counts}
    each = of_codes(lambda g, p: F.array(*[F.struct(F.lit(kind).alias("kind"), counts(g, p).cast("array<int>").alias("counts")) for kind, counts in ways.items()]))
    rows = sequences.select(*keys, F.inline(each))
    if not keys:  # a way has its row even without a sequence
        rows = rows.unionByName(sequences.sparkSession.createDataFrame([(kind, []) for kind in ways], rows.schema))
    found = summary(counted(rows, F.col("counts"), *keys, "kind"), *keys, "kind")
    return found.select(*[c for c in found.columns if c != "kind"], "kind")


def tag_weights(sequences: DataFrame, tags: str = "gold") -> DataFrame:
    """total / (tags present * count) for each tag of the set; 0 for a tag that never occurs."""
    counts = sequences.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    known = sequences.sparkSession.createDataFrame([(t, i) for i, t in enumerate(TAGS)], "tag string, position int")
    joined = F.broadcast(known).join(counts, "tag", "left").fillna(0, ["n"])  # 17 rows
    everything = Window.partitionBy()
    total, present = F.sum("n").over(everything), F.sum((F.col("n") > 0).cast("int")).over(everything)
    weight = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(total.cast("double") / (present * F.col("n")).cast("double"))
    return joined.select("position", "tag", "n", F.round(weight, 9).alias("weight"))


def argmax_tag(p: Column) -> Column:
    """The tag of the largest probability, the first of equal ones; O without probabilities."""
    at = F.array_position(p, F.array_max(p)).cast("int")
    return F.coalesce(F.get(all_tags(), at - 1), F.lit("O"))


def best_value_tag(p: Column) -> Column:
    """The likeliest tag other than O and its probability; null without probabilities."""
    others = F.slice(p, 2, len(TAGS) - 1)
    at = F.array_position(others, F.array_max(others)).cast("int")
    return F.when(p.isNotNull(), F.struct(F.get(F.array(*[F.lit(t) for t in TAGS[1:]]), at - 1).alias("tag"), F.array_max(others).alias("p")))


def threshold_tag(best: Column, thresholds: dict[str, float]) -> Column:
    """The best tag if its probability reaches its label's threshold, else O."""
    known = F.create_map(*[F.lit(x) for kv in {v: thresholds.get(v, 0.5) for v in VALUES}.items() for x in kv])
    reached = best.getField("p") >= F.element_at(known, tag_value(best.getField("tag")))
    return F.when(F.coalesce(reached, F.lit(False)), best.getField("tag")).otherwise("O")
