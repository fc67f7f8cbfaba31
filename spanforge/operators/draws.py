"""Exact resamples: as many draws with replacement as there are rows, in every resample.

Rows go into blocks by a hash of their number.  The draws of a resample are split
down a binary tree over the blocks: the left half of a node gets a binomial number,
given what the node got, with the share of rows that it holds.  Every task walks from
the root to its own block, and as a node's numbers follow from the seed and the node
alone, all tasks see the same splits.  Within a block draws fall on rows evenly.  So
draws add up to the number of rows, resample by resample, without a task that sees
them all, and sums of the drawn rows are a matrix product in each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a block should have, and the most blocks there are: their sizes are all that every task gets.
BLOCK_ROWS, MOST_BLOCKS = 4_096, 1 << 16
#: Weights of a block that are held at once.
HELD = 4_000_000


def block_of(row: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row.cast("string")), F.lit(blocks)).cast("int")


def share_of(sizes: np.ndarray, block: int, resamples: int, seed: int) -> np.ndarray:
    """How many draws of each resample fall into a block."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    draws = np.full(resamples, before[-1], np.int64)
    low, high, node = 0, len(sizes), 1
    while high - low > 1:
        middle = (low + high) // 2
        rows, left = before[high] - before[low], before[middle] - before[low]
        chance = np.random.Generator(np.random.Philox(key=[seed, node]))
        to_left = chance.binomial(draws, left / rows) if rows else draws * 0
        if block < middle:
            draws, high, node = to_left, middle, 2 * node
        else:
            draws, low, node = draws - to_left, middle, 2 * node + 1
    return draws


def weights_of(size: int, draws: np.ndarray, block: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """How often each row of a block is drawn, for some resamples after others: (first resample, resamples x rows)."""
    chance = np.random.Generator(np.random.Philox(key=[seed, (1 << 40) + block]))
    step = max(1, HELD // size)
    for at in range(0, len(draws), step):
        some = draws[at : at + step]
        row = chance.integers(0, size, int(some.sum()))
        resample = np.repeat(np.arange(len(some)), some)
        yield at, np.bincount(resample * size + row, minlength=len(some) * size).reshape(len(some), size)


def prepared(rows: DataFrame, row: str) -> tuple[DataFrame, np.ndarray]:
    """The rows with their block, and the blocks' sizes."""
    n = rows.count()
    blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK_ROWS)))
    with_block = rows.withColumn("block_", block_of(F.col(row), blocks))
    sizes = np.zeros(blocks, np.int64)
    for r in with_block.groupBy("block_").count().collect():  # one row a block
        sizes[r[0]] = r[1]
    return with_block, sizes


def drawn_weights(rows: DataFrame, row: str, resamples: int, seed: int = 13) -> DataFrame:
    """(resample from 0, row, w) of all rows that are drawn: w adds up to the number of rows in each resample.

    row tells rows apart; rows of one number are ordered as they come, and share what
    they draw evenly.  The same rows give the same draws, however they are dealt out.
    """
    with_block, sizes = prepared(rows.select(F.col(row).alias("row")), "row")
    kind = rows.schema[row].dataType.simpleString()

    def of_block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        names = part["row"].sort_values(key=lambda s: s.astype(str)).to_numpy()
        out = []
        for at, w in weights_of(len(names), share_of(sizes, block, resamples, seed), block, seed):
            b, i = np.nonzero(w)
            out.append(pd.DataFrame({"resample": (at + b).astype(np.int32), "row": names[i], "w": w[b, i].astype(np.int32)}))
        return pd.concat(out)

    return with_block.groupBy("block_").applyInPandas(of_block, f"resample int, row {kind}, w int")


def resampled_sums(rows: DataFrame, row: str, columns: list[str], resamples: int, seed: int = 13) -> DataFrame:
    """(resample, n, columns): sums of whole-number columns over the rows drawn; resample 0 is the rows as they are.

    n is how many draws there were.  A block's rows meet their weights in one matrix
    product, and only sums are shuffled.  No rows: resample 0 with nothing is left out too.
    """
    with_block, sizes = prepared(rows.select(F.col(row).alias("row_"), *columns), "row_")

    def of_block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        part = part.sort_values("row_", key=lambda s: s.astype(str), kind="stable")
        counts = np.column_stack([np.ones(len(part)), part[columns].to_numpy(np.float64)])
        sums = [counts.sum(axis=0, keepdims=True)]
        sums += [w.astype(np.float64) @ counts for _, w in weights_of(len(part), share_of(sizes, block, resamples, seed), block, seed)]
        out = pd.DataFrame(np.rint(np.concatenate(sums)).astype(np.int64), columns=["n", *columns])
        out.insert(0, "resample", np.arange(resamples + 1, dtype=np.int32))
        return out

    kinds = ", ".join(f"`{c}` long" for c in ["n", *columns])
    each = with_block.groupBy("block_").applyInPandas(of_block, f"resample int, {kinds}")
    return each.groupBy("resample").agg(*[F.sum(c).alias(c) for c in ["n", *columns]])
