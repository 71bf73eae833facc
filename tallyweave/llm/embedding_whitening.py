"""Whitening of embeddings with an exact scatter matrix from residue arithmetic.

An entry c becomes the whole number x = floor(SCALE * c) + SHIFT. The fit list holds every distinct x
vector once. With n vectors and the sums S, y = n * x - S is a vector centred in whole numbers; each
partition of the fit list multiplies the residues of y by several primes as plain double matrices
(balanced residues below 2^21, at most 2,048 rows at a time, so every sum stays below 2^53), the residues
are summed by cell in Spark, and Chinese remaindering gives back the exact sum of y y'. Divided by n^3 it
is the covariance, correctly rounded; its eigenvectors come from one double ``eigh`` on the driver, which
holds matrices of the dimension only, never rows.

Rows whose vector is null, holds a null or non-finite entry or one too large for a 64-bit x, or has not
the usual length (the most frequent one among the others, the longest if tied) are dropped. Repeated rows
count once in the fit and come back as often as they were there; a null id passes through. Components
without variance (a constant dimension, fewer distinct vectors than dimensions) have a null ``whitened``
and 0 explained. An empty table, or one without any vector left, gives no rows. Columns besides id and
vector are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpointed

SCALE, SHIFT = 64.0, 1_000_000
#: Larger entries have no 64-bit x.
LARGEST = 2.0**56
#: Balanced residues r of primes below 2^22 have r * r < 2^42; 2^11 of them add up below 2^53.
PRIME_BELOW, BLOCK_ROWS = 1 << 22, 1 << 11
#: Eigenvalues below this share of the largest, times the dimension, are noise of a zero.
NOISE = 4 * np.finfo(float).eps


class Whitener(NamedTuple):
    """What ``fit`` learns: sizes of the dimension only."""

    n: int
    sums: list[int]
    reach: int
    axes: np.ndarray  # one column a component, divided by the root of its eigenvalue; nan without variance
    explained: np.ndarray


def usable(vector: Column) -> Column:
    """Not null, not empty, and every entry a number whose x fits in 64 bits."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def dimension_of(vectors: DataFrame, vector: str) -> int:
    sizes = vectors.filter(usable(F.col(vector))).groupBy(F.size(vector).alias("size")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else 0


def _whole(column: pa.Array, dimension: int) -> np.ndarray:
    """The x of usable vectors, one row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, of two bytes an entry where all fit, else of eight: equal rows, equal bytes."""
    near = x - SHIFT
    short = (np.abs(near) < 1 << 15).all(axis=1)
    return [row.astype("<i2" if s else "<i8").tobytes() for row, s in zip(near, short, strict=True)]


def _unpacked(packed: list[bytes], dimension: int) -> np.ndarray:
    rows = [np.frombuffer(b, "<i2" if len(b) == 2 * dimension else "<i8") for b in packed]
    return np.array(rows, np.int64).reshape(-1, dimension) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    for batch in batches:
        packed = batch.column(0).to_pylist()
        for start in range(0, len(packed), BLOCK_ROWS):
            yield _unpacked(packed[start : start + BLOCK_ROWS], dimension)


def fit_list(vectors: DataFrame, vector: str, dimension: int) -> DataFrame:
    """``x``: every distinct vector of whole numbers, packed; repeats are dropped before and after the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_packed(_whole(batch.column(0), dimension)), pa.binary())], ["x"])

    return vectors.select(vector).mapInArrow(pack, "x binary").distinct()


def _sum(x: np.ndarray) -> list[int]:
    """Column sums that cannot overflow."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]


def dimension_sums(fitted: DataFrame, dimension: int) -> list[tuple[int, int, int, int]]:
    """Of each dimension: how many vectors, the sum of x, the least and the largest x."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, [0] * dimension, [], []
        for x in _blocks(batches, dimension):
            n, sums = n + len(x), [a + b for a, b in zip(sums, _sum(x), strict=True)]
            low, high = np.min([*low, x.min(axis=0)], axis=0)[None], np.max([*high, x.max(axis=0)], axis=0)[None]
        if n:
            columns = [pa.array(range(dimension), pa.int32()), pa.array([n] * dimension, pa.int64()), pa.array(map(str, sums)), pa.array(low[0]), pa.array(high[0])]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "n", "total", "low", "high"])

    parts = fitted.mapInArrow(part, "dim int, n long, total string, low long, high long")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), total, F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return [(r["n"], int(r["total"]), r["low"], r["high"]) for r in sorted(rows, key=lambda r: r["dim"])]


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIME_BELOW, one at least, whose product holds every number from -bound to bound."""
    found, product = [], 1
    candidates = (p for p in count(PRIME_BELOW - 1, -2) if all(p % q for q in range(3, int(p**0.5) + 1, 2)))
    while not found or product <= 2 * bound:
        found.append(next(candidates))
        product *= found[-1]
    return found


def modular_scatter(x: np.ndarray, n: int, sums: list[int], prime: int) -> np.ndarray:
    """The sum of y y' over the rows of ``x`` modulo a prime, by one exact double product."""
    y = (n % prime * (x % prime) - np.array([s % prime for s in sums])) % prime
    y = (y - prime * (y > prime // 2)).astype(np.float64)
    return np.rint(y.T @ y).astype(np.int64) % prime


def remaindered(residues: list[int], primes: list[int]) -> int:
    """The number nearest to 0 with these residues."""
    product = 1
    for p in primes:
        product *= p
    value = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, primes, strict=True)) % product
    return value - product if value > product // 2 else value


def exact_scatter(fitted: DataFrame, n: int, sums: list[int], bound: int) -> dict[int, int]:
    """The exact sum of y y' by cell i * dimension + j, i at most j."""
    dimension, primes = len(sums), primes_for(bound)
    upper = np.flatnonzero(np.triu(np.ones((dimension, dimension), bool)))
    names = [f"r{i}" for i in range(len(primes))]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(primes), dimension, dimension), np.int64)
        for x in _blocks(batches, dimension):
            for total, prime in zip(totals, primes, strict=True):
                total += modular_scatter(x, n, sums, prime)
                total %= prime
        if totals.any():
            yield pa.RecordBatch.from_arrays([pa.array(upper, pa.int64()), *(pa.array(t.ravel()[upper]) for t in totals)], ["cell", *names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            exact = [str(remaindered([r % p for r, p in zip(row, primes, strict=True)], primes)) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.string())], ["cell", "scatter"])

    parts = fitted.mapInArrow(part, ", ".join(["cell long", *(f"{r} long" for r in names)]))
    cells = parts.groupBy("cell").agg(*(F.sum(r).alias(r) for r in names)).mapInArrow(whole, "cell long, scatter string")
    return {r["cell"]: int(r["scatter"]) for r in cells.collect()}


def fit(fitted: DataFrame, dimension: int, components: int) -> Whitener | None:
    """The whitener of a fit list; None where it is empty."""
    facts = dimension_sums(fitted, dimension)
    if not facts:
        return None
    n, sums = facts[0][0], [f[1] for f in facts]
    reach = max(max(n * high - s, s - n * low) for _, s, low, high in facts)
    cells = exact_scatter(fitted, n, sums, n * reach * reach)
    covariance = np.zeros((dimension, dimension))
    for cell, value in cells.items():
        i, j = divmod(cell, dimension)
        covariance[i, j] = covariance[j, i] = value / n**3
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    real = values > dimension * NOISE * max(trace, 0.0)
    axes = np.divide(vectors, np.sqrt(np.where(real, values, 1.0)))
    axes[:, ~real] = np.nan
    return Whitener(n, sums, reach, axes, np.where(real, values / (trace or 1.0), 0.0))


def _centred(x: np.ndarray, model: Whitener) -> np.ndarray:
    """y = n * x - S, as longs where they fit."""
    if model.reach < 1 << 62 and model.n * int(np.abs(x).max(initial=1)) < 1 << 62 and max(map(abs, model.sums)) < 1 << 62:
        return model.n * x - np.array(model.sums, np.int64)
    return model.n * x.astype(object) - np.array(model.sums, object)


def _whitened(y: np.ndarray, model: Whitener) -> np.ndarray:
    return (y / model.n).astype(np.float64) @ model.axes


def _deviations(y: np.ndarray, model: Whitener) -> list[int | None]:
    if y.dtype != object and model.reach**2 * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in y)
    return [d if d < 1 << 63 else None for d in exact]


def identity_error(fitted: DataFrame, model: Whitener) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, over components with variance."""
    dimension, axes = model.axes.shape[0], model.axes
    real = np.flatnonzero(~np.isnan(axes[0]))
    if not len(real):
        return None
    k = len(real)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((k + 1, k + 1))
        for x in _blocks(batches, dimension):
            w = np.column_stack([_whitened(_centred(x, model), model)[:, real], np.ones(len(x))])
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) ** 2), pa.int32()), pa.array(products.ravel())], ["cell", "product"])

    sums = {r["cell"]: r["product"] for r in fitted.mapInArrow(part, "cell int, product double").groupBy("cell").agg(F.sum("product").alias("product")).collect()}
    products = np.array([sums[c] for c in range((k + 1) ** 2)]).reshape(k + 1, k + 1) / model.n
    mean = products[k, :k]  # rounding only: the rows were centred before
    return float(np.abs(products[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` is null where the exact number does not fit in a long.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    dimension = dimension_of(rows, "vector")
    rows = rows.filter(usable(F.col("vector")) & (F.size("vector") == dimension))
    fitted = checkpointed(fit_list(rows, "vector", max(dimension, 1)))
    model = fit(fitted, dimension, components) if dimension else None
    error = identity_error(fitted, model) if model else None
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_projected(model, error), schema).withColumnRenamed("id", vec_id)


def _projected(model: Whitener | None, error: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                continue
            y, (dimension, k) = _centred(_whole(batch.column(1), model.axes.shape[0]), model), model.axes.shape
            rows, per_row = len(y), np.repeat(np.arange(len(y)), k)
            white = _whitened(y, model).ravel()
            columns = [
                batch.column(0).take(pa.array(per_row)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)),
                pa.array(_deviations(y, model), pa.int64()).take(pa.array(per_row)),
                pa.array(white, mask=np.isnan(white)),
                pa.array(np.tile(model.explained, rows)),
                pa.array([error] * (rows * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return project
