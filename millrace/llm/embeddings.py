"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale of their own, and the length of
what rounding lost is kept. With v = s q + e for both vectors of a pair, the exact
cosine differs from s s' q.q' by at most |e| + |e'| + |e||e'|. Tile products of the
integers are exact in single precision, as |q.q'| stays below 2**24 in chunks of
``CHUNK`` components.

Tiles of a label meet as int8 rows with their scales and errors, and a pair of tiles
returns which of its vectors have a partner whose bound reaches the threshold. Only
these vectors' doubles are then sent to that pair of tiles, which computes the pairs
within the bound in double precision and returns link counts and links that span
what it found, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.cells import blocked, run_cells
from millrace.llm.common import beside, connected_components, global_rank, stage
from millrace.llm.neardup import spanning_links

THRESHOLD = 0.93
TILE = 2048
CHUNK = 1024
#: Covers the rounding of the double-precision steps that make the bounds.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales and error lengths of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - scale[:, None] * q) ** 2).sum(axis=1)) + SLACK
    return q.astype(np.int8), scale, error


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], CHUNK):
        out += a[:, k : k + CHUNK].astype(np.float32) @ b[:, k : k + CHUNK].astype(np.float32).T
    return out


def within_bound(a: tuple, b: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sets of quantised rows whose cosine may reach ``threshold``, some rows of a at a time."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    for at in range(0, len(qa), 512):
        part = slice(at, at + 512)
        upper = int8_product(qa[part], qb) * sa[part, None] * sb[None, :]
        upper += (ea[part, None] + eb[None, :]) + ea[part, None] * eb[None, :]
        i, j = np.nonzero(upper >= threshold - SLACK)
        yield i + at, j


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b whose cosine is at least ``threshold``."""
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in within_bound(quantised(a / norm_a[:, None]), quantised(b / norm_b[:, None]), threshold):
        for k in range(0, len(i), 65536):
            x, y = i[k : k + 65536], j[k : k + 65536]
            hit = (a[x] * b[y]).sum(axis=1) / (norm_a[x] * norm_b[y]) >= threshold
            lefts.append(x[hit])
            rights.append(y[hit])
    return np.concatenate(lefts), np.concatenate(rights)


def _cleaned(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """rid, vec_id, label, dim, cls, the scaled components as doubles, and int8 row, scale and error; null where nothing links."""

    def cleaned(v: list | None, lab: str | None) -> np.ndarray | None:
        if not v or lab is None or any(c is None for c in v):
            return None
        x = np.array(v, np.float64)
        top = np.abs(x).max()
        return x / top + 0.0 if np.isfinite(top) and top > 0 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cleaned(v, lab) for v, lab in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            small: list[tuple] = [(None, None, None)] * len(found)
            for dim in {len(x) for x in found if x is not None}:
                at = [k for k, x in enumerate(found) if x is not None and len(x) == dim]
                unit = np.stack([found[k] for k in at])
                for k, q, scale, error in zip(at, *quantised(unit / np.sqrt((unit * unit).sum(axis=1))[:, None])):
                    small[k] = (q.tobytes(), float(scale), float(error))
            values = [None if x is None else x.tobytes() for x in found]
            columns = [
                *(b.column(k) for k in (0, 1, 3)),
                pa.array([None if x is None else len(x) for x in found], pa.int64()),
                pa.array([None if v is None else xxhash.xxh3_128_digest(v) for v in values], pa.binary()),
                pa.array(values, pa.binary()),
                *(pa.array([x[k] for x in small], kind) for k, kind in enumerate((pa.binary(), pa.float64(), pa.float64()))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "vec_id", "label", "dim", "cls", "vec", "q", "scale", "error"])

    rows = vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label")
    )
    return rows.mapInArrow(run, "rid long, vec_id long, label string, dim long, cls binary, vec binary, q binary, scale double, error double")


def _sides(rows: list[dict]) -> tuple[list[dict], list[dict], bool]:
    """The rows of a cell's two blocks, and whether they are one."""
    left = [r for r in rows if r["block"] == r["low"]]
    one = rows[0]["low"] == rows[0]["high"]
    return left, left if one else [r for r in rows if r["block"] != r["low"]], one


def _survivors(threshold: float, rows: list[dict]) -> list[tuple]:
    """(node, low, high, block) of the rows of a cell with a partner within the bound."""
    left, right, one = _sides(rows)
    if not left or not right:
        return []
    sets = [(np.stack([np.frombuffer(r["q"], np.int8) for r in part]), np.array([r["scale"] for r in part]), np.array([r["error"] for r in part])) for part in (left, right)]
    hit = [np.zeros(len(left), bool), np.zeros(len(right), bool)]
    for i, j in within_bound(*sets, threshold):
        if one:
            i, j = i[i != j], j[i != j]
        hit[0][i] = True
        hit[1][j] = True
    sides = [(left, hit[0] | hit[1])] if one else [(left, hit[0]), (right, hit[1])]
    return [(part[k]["node"], part[k]["low"], part[k]["high"], part[k]["block"]) for part, h in sides for k in np.flatnonzero(h)]


def _compare(threshold: float, rows: list[dict]) -> list[tuple]:
    """(a, null, links of a's class) and spanning links (a, b, null) of a cell."""
    left, right, one = _sides(rows)
    if not left or not right:
        return []
    i, j = near_pairs(*[np.stack([np.frombuffer(r["vec"]) for r in part]) for part in (left, right)], threshold)
    if one:
        i, j = i[i != j], j[i != j]
    n_left, n_right = (np.array([r["n"] for r in part]) for part in (left, right))
    counts = np.bincount(i, n_right[j], len(left))
    out = [(left[k]["node"], None, int(counts[k])) for k in np.flatnonzero(counts)]
    if not one:
        counts = np.bincount(j, n_left[i], len(right))
        out += [(right[k]["node"], None, int(counts[k])) for k in np.flatnonzero(counts)]
    nodes = [r["node"] for r in (left if one else left + right)]
    adjacent = np.zeros((len(nodes), len(nodes)), bool)
    at = j if one else j + len(left)
    adjacent[i, at] = adjacent[at, i] = True
    return out + [(nodes[x], nodes[y], None) for x, y in spanning_links(adjacent)]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null and their cosine is at
    least ``threshold``. Null, empty, zero or non-finite vectors and vectors with
    null components link with nothing; vectors of different lengths never link.
    Rows that point the same way exactly are one class and are compared once;
    ``n_links`` counts every other row. Repeated rows count as other rows.
    ``component_id`` is the smallest id reachable. An empty table gives no rows.
    Only the three columns named are read; the table must re-read alike.

    A label's classes are cut into tiles, and every pair of tiles meets in one task,
    whatever the label's share of the rows; the rows of a hot label, class or
    component are split (``beside``).
    """
    seen = stage(_cleaned(vectors, key, vector, label), "vectors")
    by = ["label", "dim", "cls"]
    classes = stage(seen.where("cls is not null").groupBy(by).agg(F.min("rid").alias("node"), F.count("*").alias("n"), F.min("vec_id").alias("least")), "classes")
    group = ["label", "dim"]
    placed = global_rank(classes.select(*group, "node"), [*group, "node"], "pos")
    spans = stage(placed.groupBy(*group).agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.count("*").alias("many")), "spans")
    block = F.floor((F.col("pos") - F.col("first")) / TILE).cast("int").alias("block")
    tiles = stage(beside(placed, spans, group).select(*group, "node", block, F.ceil(F.col("many") / TILE).cast("int").alias("blocks")), "tiles")
    cell = [*group, "low", "high"]
    small = seen.select(F.col("rid").alias("node"), "q", "scale", "error")
    bounded = run_cells(blocked(tiles.join(small, "node")), cell, partial(_survivors, threshold), "node long, low int, high int, block int")
    # A node names its label, so the doubles of the survivors find their cells again.
    bounded = stage(bounded.join(tiles.select(*group, "node"), "node"), "survivors")
    vecs = seen.select(F.col("rid").alias("node"), "vec").join(classes.select("node", "n"), "node")
    exact = bounded.join(vecs, "node")
    found = stage(run_cells(exact, cell, partial(_compare, threshold), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    comps = stage(connected_components(found.where("b is not null").select("a", "b")), "components")
    linked = classes.join(comps, "node", "left").join(counts, "node", "left")
    n_links = (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    linked = stage(linked.select(*by, F.coalesce("component", "node").alias("comp"), "least", n_links, F.col("n").alias("rows")), "linked")
    least = stage(linked.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    linked = stage(beside(linked, least, ["comp"]).select(*by, "n_links", "component_id", F.col("rows").alias("n")), "named")
    out = beside(seen.select("vec_id", *by), linked, by, "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
