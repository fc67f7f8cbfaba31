"""Thresholds that maximise F1 on a grid, per label.

The grid's counts come from one pass: a probability is counted once in the cell
of the last grid point it reaches, and a running sum over 19 cells per label gives
the counts at every threshold.  No row is multiplied by the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.scores import f1
from spanforge.functions.vocabulary import VALUES, vocab
from spanforge.operators import spans as S

GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def cell_of(p: Column) -> Column:
    """How many grid points a probability reaches, 0..19; null for a null one.  Halved ranges, five comparisons."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(p >= F.lit(GRID[middle - 1]), within(middle, high)).otherwise(within(low, middle - 1))

    return F.when(p.isNotNull(), within(0, len(GRID)))


def pick(at_grid: DataFrame, default: float) -> DataFrame:
    """The best threshold for each value: highest F1, then nearest to the default, then lowest."""
    order = Window.partitionBy("value").orderBy(F.desc("f1"), F.abs(F.col("threshold") - F.lit(default)), "threshold")
    best = at_grid.withColumn("rank", F.row_number().over(order)).filter("rank = 1")
    return best.select("value", F.when(F.col("positives") == 0, F.lit(default)).otherwise(F.col("threshold")).alias("threshold"), F.round(F.when(F.col("positives") == 0, 0.0).otherwise(F.col("f1")), 9).alias("f1"))


def tune(rows: DataFrame, default: float = 0.5) -> DataFrame:
    """(value, threshold, f1) from rows with gold and prob vectors; a label without positives keeps the default."""
    each = rows.select(F.posexplode(F.arrays_zip("gold", "prob")).alias("k", "x"))
    cells = each.groupBy(F.get(vocab(), F.col("k")).alias("value"), cell_of(F.col("x.prob")).alias("cell")).agg(F.sum("x.gold").alias("pos"), F.sum(1 - F.col("x.gold")).alias("neg"))
    grid = rows.sparkSession.createDataFrame([(v, i, t) for v in VALUES for i, t in enumerate([None, *GRID])], "value string, cell int, threshold double")
    full = F.broadcast(grid).join(cells, ["value", "cell"], "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy("value").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    positives = F.sum("pos").over(Window.partitionBy("value"))
    counted = full.select("value", "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), positives.alias("positives")).filter("threshold is not null")
    return pick(counted.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("positives") - F.col("tp"))), default)


def tag_code(tag: Column) -> Column:
    """Twice a label's number, and one more unless its tag begins a span; 0 or 1 for a tag of no label."""
    label = F.array_position(vocab(), F.substring(tag, 3, 1000)).cast("int")
    return F.coalesce(label * 2 + F.when(F.startswith(tag, F.lit("B")), 0).otherwise(1), F.lit(0))


CELL_BITS, WORD_BITS, CELLS = 5, 10, len(GRID) + 1


def label(x: Column) -> Column:
    """A word's label number; words are tag codes, shifted, with the cell in the low bits."""
    return F.shiftright(x, CELL_BITS + 1)


def cell(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << CELL_BITS) - 1))


def joined(x: Column, before: Column) -> Column:
    """The cell up to which a word continues the word before it, which is of its label; 0 if it never does."""
    code = lambda y: F.shiftright(y, CELL_BITS)
    return F.when(code(x) == code(before).bitwiseOR(F.lit(1)), F.least(cell(x), cell(before))).otherwise(0)


def found_between(pair: Column) -> Column:
    """A number (label, from, to) for each gold span of g: it is a predicted one at cells in (from, to].

    pair: g, the gold tags' codes; w, the words of the best tags.  A span that never
    is a predicted one has an empty interval.
    """
    w = pair.getField("w")
    at = lambda i: F.coalesce(F.get(w, i), F.lit(0))

    def one(span: Column) -> Column:
        s, e = S.start_of(span).cast("int"), S.end_of(span).cast("int")
        k = span.bitwiseAND(F.lit((1 << S.LABEL_BITS) - 1)).cast("int")

        def of(y: Column) -> Column:
            first, rest, last = y.getField("first"), y.getField("rest"), at(e - 1)
            least, most = F.array_min(rest), F.array_max(rest)
            # all words after the first continue the label
            whole = (e - s == 1) | ((F.shiftright(least, CELL_BITS) == k * 2 + 1) & (F.shiftright(most, CELL_BITS) == k * 2 + 1))
            low, high = F.greatest(joined(first, at(s - 1)), joined(at(e), last)), F.least(cell(first), cell(least))
            return k * CELLS * CELLS + F.when((label(first) == k) & whole & (high > low), low * CELLS + high).otherwise(0)

        return S.let(F.struct(at(s).alias("first"), F.slice(w, s + 2, e - s - 1).alias("rest")), of)

    return F.transform(S.span_numbers(pair.getField("g")), one)


def tune_spans(sequences: DataFrame, default: float = 0.5) -> DataFrame:
    """(value, threshold, f1) by exact span F1 from rows with gold tags and best (array of (tag, p)).

    A label's threshold changes only words whose best tag is of that label, so
    labels are tuned apart: for a label and threshold, words of other labels are O.
    A word begins a span, and a gold span is found, from one grid point to another;
    each sequence names these intervals once, and only counts of equal ones are shuffled.
    """
    word = lambda b: F.coalesce(F.shiftleft(tag_code(b.getField("tag")), CELL_BITS) + cell_of(b.getField("p")), F.lit(0))
    none = F.array().cast("array<int>")
    pair = F.struct(F.coalesce(F.transform("gold", tag_code), none).alias("g"), F.coalesce(F.transform("best", word), none).alias("w"))

    def numbers(pair: Column) -> Column:
        """Words with the word before them in higher bits, and gold spans as negative numbers."""
        w = pair.getField("w")
        words = F.transform(w, lambda x, i: F.shiftleft(F.coalesce(F.get(w, i - 1), F.lit(0)), WORD_BITS).bitwiseOR(x))
        return F.concat(words, F.transform(found_between(pair), lambda x: -x))

    c = F.col("c")
    x, before = c.bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.shiftright(c, WORD_BITS)
    low = joined(x, before)
    begun = F.when((label(x) > 0) & (cell(x) > low), (label(x) * CELLS + low) * CELLS + cell(x))
    each = sequences.select(F.explode(S.let(pair, numbers)).alias("c")).select((c < 0).alias("gold"), F.when(c < 0, -c).otherwise(begun).alias("c"))
    place = lambda n: F.floor(c / n).cast("int")
    # a bounded number of rows: labels and intervals
    few = each.filter("c is not null").groupBy("gold", "c").agg(F.count(F.lit(1)).alias("n"))
    few = few.select("gold", "n", F.get(vocab(), place(CELLS * CELLS) - 1).alias("value"), (place(CELLS) % CELLS).alias("low"), (c % CELLS).alias("high"))
    full = sequences.sparkSession.createDataFrame([(v, i, t) for v in VALUES for i, t in enumerate(GRID, 1)], "value string, cell int, threshold double")
    inside = (F.col("low") < F.col("cell")) & (F.col("cell") <= F.col("high"))
    sums = {"tp": inside & F.col("gold"), "n_pred": inside & ~F.col("gold"), "positives": F.col("gold")}
    counts = full.join(F.broadcast(few), "value", "left").groupBy("value", "threshold").agg(*[F.sum(F.when(which, F.col("n")).otherwise(0)).alias(name) for name, which in sums.items()])
    return pick(counts.withColumn("f1", f1(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("positives") - F.col("tp"))), default)
