"""Whitening of integer-scaled embeddings with moments merged by Chan's formula.

The first pass takes the moments of every vector: a partition computes the count, local
mean and centred scatter of each of its batches and merges them pairwise, and treeReduce
merges the partitions' states the same way, so only one state per vector length reaches
the driver, where eigh takes the covariance apart. The second pass projects every vector,
and the moments of what it wrote, merged alike, show how far their covariance is from the
identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, stage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: States that meet in one task of treeReduce, about.
FAN_IN = 32

#: Count, mean, centred scatter and, where asked for, exact sums as Python integers.
Moments = tuple[int, np.ndarray, np.ndarray, list[int]]


def moments(x: np.ndarray) -> Moments:
    """Of a block of rows: centred at the local mean before multiplying."""
    mean = x.mean(axis=0)
    d = x - mean
    sums = [int(v) for v in x.sum(axis=0)] if x.dtype.kind == "i" else []
    return len(x), mean, d.T @ d, sums


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise formula."""
    n = a[0] + b[0]
    # Where sums are exact, so is the distance of the means but for one rounding.
    delta = np.array([(q * a[0] - p * b[0]) / (a[0] * b[0]) for p, q in zip(a[3], b[3])]) if a[3] else b[1] - a[1]
    scatter = a[2] + b[2] + np.outer(delta, delta) * (a[0] * b[0] / n)
    return n, a[1] + delta * (b[0] / n), scatter, [p + q for p, q in zip(a[3], b[3])]


def _united(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return a | {d: merged(a[d], m) if d in a else m for d, m in b.items()}


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, block) of the rows of a batch that have the same length; empty ones are left out."""
    lists = batch.column(column)
    values, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
    sizes = np.diff(ends, prepend=0)
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, values[(ends[at] - d)[:, None] + np.arange(d)]


def all_moments(rows: DataFrame, column: str) -> dict[int, Moments]:
    """The moments of the arrays in ``column``, none null or holding nulls, by their length."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, Moments] = {}
        for b in batches:
            for _, x in _blocks(b, column):
                state = _united(state, {x.shape[1]: moments(x)})
        columns = [pa.array([m[0] for m in state.values()], pa.int64()), *(pa.array([m[k].tobytes() for m in state.values()], pa.binary()) for k in (1, 2))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([[str(s) for s in m[3]] for m in state.values()], pa.list_(pa.string()))], ["n", "mean", "scatter", "sums"])
        give_back()

    def state(r) -> dict[int, Moments]:
        mean = np.frombuffer(r["mean"])
        return {len(mean): (r["n"], mean, np.frombuffer(r["scatter"]).reshape(len(mean), -1), [int(s) for s in r["sums"]])}

    parts = rows.select(column).mapInArrow(local, "n long, mean binary, scatter binary, sums array<string>").rdd.map(state)
    # Partitions without rows have no state, so each starts from an empty one.
    states = parts.mapPartitions(lambda found: [{} if (first := next(found, None)) is None else _fold(first, found)])
    depth = max(2, math.ceil(math.log(max(2, states.getNumPartitions()), FAN_IN)))
    return states.treeReduce(_united, depth) if states.getNumPartitions() else {}


def _fold(first: dict, rest: Iterator[dict]) -> dict:
    for x in rest:
        first = _united(first, x)
    return first


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S in whole numbers: 64 bits where they do, Python's own elsewhere."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 2**63:
        return x * n - np.array(sums)
    return x.astype(object) * n - np.array(sums, object)


_LIMB = 26


def _deviation(y: np.ndarray) -> pa.Array:
    """Exact sums of squares of the rows of whole numbers, as decimals."""
    most, d = int(np.abs(y).max(initial=0)), y.shape[1]
    if d * most**2 < 2**63:
        return pc.cast(pa.array((y * y).sum(axis=1)), pa.decimal128(38))
    if most < 2 ** (2 * _LIMB) and d <= 1024:
        # In two halves, whose squares and product add up in 64 bits; a row's three sums are put together once.
        high, low = np.abs(y) >> _LIMB, np.abs(y) & (2**_LIMB - 1)
        parts = [z.sum(axis=1).tolist() for z in (high * high, high * low, low * low)]
        found = [(p << 2 * _LIMB) + (q << _LIMB + 1) + r for p, q, r in zip(*parts)]
    else:
        found = [sum(int(v) ** 2 for v in r) for r in y]
    whole = Context(prec=60)
    return pa.array([whole.create_decimal(v) for v in found], pa.decimal128(38))


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Each vector on the leading eigenvectors of the covariance, scaled to unit variance.

    Entries c become x = floor(scale * c) + shift. One row per vector and component: id,
    component (from 1 by falling eigenvalue), n, deviation (the exact sum of (n x - S)**2
    over the dimensions, a decimal), whitened, explained (the eigenvalue's share of the
    trace) and identity_error (largest entry of the covariance of ``whitened`` less the
    identity, one value for all rows of a length).

    Null vectors and those with null or non-finite entries are left out; null keys and
    repeated rows are kept. Vectors of different lengths have no covariance in common, so
    each length is a fit list of its own, and an empty vector has no components. A component
    whose eigenvalue is zero but for rounding has null for ``whitened``, as there is nothing
    to scale to one. An empty table gives no rows. An entry whose x has 52 bits or more is an
    error.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    small = F.forall(v, lambda c: F.abs(c) * scale < 2.0**52)
    x = F.when(small, F.transform(v, lambda c: F.floor(c * scale) + shift)).otherwise(F.raise_error(F.lit("an entry is too large")))
    rows = vectors.where(F.col(vector).isNotNull() & whole).select(F.col(key).cast("long").alias("id"), x.alias("x"))
    state = all_moments(rows, "x")
    fits = {}
    for d, (n, _, scatter, sums) in state.items():
        values, bases = np.linalg.eigh(scatter / n)
        values, bases = values[::-1][:components], bases[:, ::-1][:, :components]
        fits[d] = (n, sums, values, bases, float(np.trace(scatter)) / n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _blocks(b, "x"):
                d = x.shape[1]
                n, sums, values, bases, trace = fits[d]
                y = _centred(x, n, sums)
                live = values > trace * d * np.finfo(float).eps
                # The whole numbers n x - S are divided once, so x - S / n is not a difference of rounded figures.
                w = (y / n).astype(float) @ bases[:, live] / np.sqrt(values[live])
                width = int(live.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at)), pa.array(np.full(len(at), d), pa.int32()), _deviation(y), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(w.ravel()))],
                    ["id", "dim", "deviation", "w"],
                )
        give_back()

    done = stage(rows.mapInArrow(project, "id long, dim int, deviation decimal(38,0), w array<double>"), "whitened")
    errors = {}
    for d in fits:
        seen = all_moments(done.where(F.col("dim") == d), "w")
        errors[d] = max((float(np.abs(m[2] / m[0] - np.eye(k)).max()) for k, m in seen.items()), default=None)
    about = [(d, k + 1, n, float(e / trace) if trace > 0 else None, errors[d]) for d, (n, _, values, _, trace) in fits.items() for k, e in enumerate(values)]
    known = spark.createDataFrame(about, "dim int, component int, n long, explained double, identity_error double")
    out = done.join(F.broadcast(known), "dim")
    return out.select("id", "component", "n", "deviation", F.get("w", F.col("component") - 1).alias("whitened"), "explained", "identity_error")
