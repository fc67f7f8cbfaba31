"""Embedding whitening from an exact scatter matrix in residue numbers.

Entries become integers.  Each task multiplies its rows modulo several primes: the
products of a block stay below 2^53, so a floating-point matrix product gives them
exactly and fast.  Residues are small integers that add up over tasks in any order;
Chinese remaindering of the sums gives the scatter matrix as whole numbers, so the
result does not depend on how rows are dealt out.  Its eigenvectors are found once,
in double precision, and every row is projected on them.

Only sums whose number is the square of the dimension reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import Scratch

SCALE, OFFSET = 1024, 100_000
#: Primes are below 2^21 and blocks have 2^11 rows: sums of products stay below 2^53.
PRIME_BITS, BLOCK = 21, 1 << 11
LONG = 1 << 63


def primes(product: int) -> list[int]:
    """The largest primes below 2^21, as many as it takes for their product to exceed a number."""
    out, p = [], 1 << PRIME_BITS
    while math.prod(out) <= product:
        p -= 1
        if p % 2 and all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
    return out


def reconstruct(residues: list[int], moduli: list[int]) -> int:
    """The number of least absolute value with these residues."""
    whole = math.prod(moduli)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % whole
    return x - whole if 2 * x > whole else x


def integers(vec: Column) -> Column:
    """floor(1024 c) + 100000 of every entry, in double precision."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long"))


def usable(vec: Column) -> Column:
    """Whether no entry is null, not finite or too large for a long."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(1 << 52))), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def scatter(rows: DataFrame, dims: int, moduli: list[int]) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums of dimensions and sums of products of dimensions, exact."""
    wide = dims + 1  # a last column of ones: its products are the sums and the number
    upper = np.triu_indices(wide)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), wide, wide), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for at in range(0, len(x), BLOCK):
                block = np.ones((min(BLOCK, len(x) - at), wide), np.int64)
                block[:, :dims] = x[at : at + BLOCK]
                for k, p in enumerate(moduli):
                    part = (block % p).astype(np.float64)
                    total[k] = (total[k] + (part.T @ part).astype(np.int64)) % p
        if total.any():
            for k in range(len(moduli)):
                values = total[k][upper]
                at = np.arange(len(values), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(at), pa.array(values)], names=["k", "at", "r"])

    sums = rows.select("x").mapInArrow(residues, "k int, at int, r long").groupBy("at", "k").agg(F.sum("r").alias("r"))
    table = np.zeros((len(moduli), len(upper[0])), np.int64)
    for r in sums.collect():
        table[r.k, r.at] = r.r % moduli[r.k]
    exact = [[0] * wide for _ in range(wide)]
    for n, (i, j) in enumerate(zip(*map(np.ndarray.tolist, upper), strict=True)):
        exact[i][j] = exact[j][i] = reconstruct(table[:, n].tolist(), moduli)
    return exact[dims][dims], exact[dims][:dims], [row[:dims] for row in exact[:dims]]


def components(n: int, sums: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, eigenvectors (columns) and trace of the covariance; components without variance are left out."""
    dims = len(sums)
    # whole numbers until the last division, which is rounded once
    cov = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)], np.float64)
    trace = float(Fraction(sum(n * products[i][i] - sums[i] ** 2 for i in range(dims)), n * n)) if n else 0.0
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    good = min(most, int((values > values[0] * dims * np.finfo(np.float64).eps).sum()) if trace > 0 else 0)
    vectors = vectors[:, :good]
    top = np.abs(vectors).argmax(axis=0)
    return values[:good], vectors * np.sign(vectors[top, np.arange(good)]), trace


def whiten(vectors: DataFrame, most: int = 8, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is null, empty, holds null or non-finite entries or entries of
    2^52 or more go, and so do vectors of another length than the most frequent one
    (of equally frequent lengths the greater).  Equal rows count and come out each,
    null keys too.  Components without variance have no unit variance and are left
    out: one row, or equal rows alone, give no rows, as an empty table does.  A
    deviation beyond a long is null.  Equal eigenvalues: any basis, the same for all
    rows; the greatest entry of a component is positive.  identity_error is measured
    on the whitened values themselves.  Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    clean = vectors.select(F.col(key).alias("key"), F.col(vec).alias("v")).filter(usable(F.col("v")) & (F.size("v") > 0)).select("key", integers(F.col("v")).alias("x"))
    lengths = clean.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"))
    found = lengths.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not found:
        return spark.createDataFrame([], schema)
    dims, rows_seen, low, high = found[0]
    clean = clean.filter(F.size("x") == dims)
    n, sums, products = scatter(clean, dims, primes(2 * rows_seen * max(-low, high, 1) ** 2))
    values, axes, trace = components(n, sums, products, most)
    count = len(values)
    if not count:
        return spark.createDataFrame([], schema)
    scaled = axes / np.sqrt(values)
    small = n * (high - low) < LONG  # differences from the mean, times n, then are 64-bit numbers
    base = np.array([s - n * low for s in sums], np.int64 if small else object)

    def squares(centred: np.ndarray) -> pa.Array:
        """Exact sums of squares in a row; null beyond a long."""
        near = (centred.astype(np.float64) ** 2).sum(axis=1)
        if small and (near < 0.999 * LONG).all():
            return pa.array((centred * centred).sum(axis=1))
        exact = (sum(v * v for v in row) if about < 1.001 * LONG else LONG for about, row in zip(near.tolist(), centred.tolist(), strict=True))
        return pa.array([d if d < LONG else None for d in exact], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            centred = (x if small else x.astype(object)) - low
            centred = n * centred - base
            deviation = squares(centred)
            z = (centred / n).astype(np.float64) @ scaled
            yield pa.RecordBatch.from_arrays([batch.column("key"), deviation, *map(pa.array, np.ascontiguousarray(z.T))], names=["key", "deviation", *(f"z{i}" for i in range(count))])

    names = [f"z{i}" for i in range(count)]
    columns = ", ".join(f"{c} double" for c in names)
    scratch = Scratch(spark, "whitening")
    wide = scratch.keep(clean.mapInArrow(project, f"key {kind}, deviation long, {columns}"), "projected")
    error = identity_error(wide, names, n)
    each = F.posexplode(F.array(*names)).alias("component", "whitened")
    explained = F.array(*[F.lit(float(e / trace)) for e in values])
    return wide.select("key", "deviation", each).select(
        F.col("key").alias(key),
        (F.col("component") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def identity_error(wide: DataFrame, names: list[str], n: int) -> float:
    """The largest absolute entry of the covariance of the columns, centred, minus the identity."""
    means = wide.agg(*[F.avg(c).alias(c) for c in names]).collect()[0]
    centred = {c: F.col(c) - F.lit(means[c]) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = wide.agg(*[F.sum(centred[a] * centred[b]).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]).collect()[0]
    return max(abs(s / n - (a == b)) for s, (a, b) in zip(sums, pairs, strict=True))
