"""Exact top-k search by term-at-a-time accumulation.

A sparse row is an id with parallel arrays of terms and integer weights. Queries meet
candidates in cells, a block of queries and a block of candidates each. A cell holds its
queries by term and streams its candidates in chunks: a chunk is turned into postings,
and each query row scatters its weights times the postings of its terms into a dense
array of scores, an entry per candidate. Partition selection takes the best of each
array; chunks, and then cells, are merged. All candidates are scored, nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import give_back, partitions, stage, unstage

K = 10
SCALE = 1024
#: Rows and entries of a cell's queries, and rows of its candidates, which pass in chunks.
QUERIES, ENTRIES, CANDIDATES = 16384, 1 << 22, 1 << 18
#: Queries and candidates whose dense scores fit a core's cache.
ROWS, CHUNK = 128, 2048


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Sparse rows (id, terms, weights): a term per component, weighing floor(scale * component) where that is not 0.

    Vectors that are null or hold null or non-finite components are left out; an empty
    vector is a row without terms. A weight of 62 bits or more is an error.
    """
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    small = F.forall(x, lambda c: F.abs(c) * scale < 2.0**62)
    x = F.when(small, F.transform(x, lambda c: F.floor(c * scale))).otherwise(F.raise_error(F.lit("a component is too large for 64-bit weights")))
    rows = vectors.where(F.col(vector).isNotNull() & whole).select(F.col(key).cast("long").alias("id"), x.alias("x"))
    used = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.get("x", i) != 0)
    terms = F.when(F.size("x") > 0, used).otherwise(F.array().cast("array<int>")).cast("array<long>")
    return rows.select("id", terms.alias("terms"), F.filter("x", lambda c: c != 0).alias("weights"))


class _Queries:
    """Up to ``ROWS`` queries by term, and the best candidates found for each."""

    def __init__(self, rid: np.ndarray, key: pa.Array, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int):
        self.rid, self.key, self.k = rid, key, k
        row = np.repeat(np.arange(len(rid)), sizes)
        by = np.argsort(terms, kind="stable")
        self.terms, first = np.unique(terms[by], return_index=True)
        self.rows, self.weights = np.split(row[by], first[1:]), np.split(weights[by], first[1:])
        # A sum of absolute weights, in doubles: what bounds every partial score.
        self.reach = float(np.bincount(row, np.abs(weights).astype(float), len(rid)).max(initial=0))
        self.least = np.full(len(rid), -np.inf)
        empty = np.empty(0, np.int64)
        self.best = {"row": empty, "score": empty, "null": np.empty(0, bool), "id": empty, "rid": empty}

    def scores(self, postings: _Postings) -> np.ndarray:
        """Dense scores of all candidates of a chunk, exact whatever the type."""
        bound = self.reach * postings.most
        if bound >= 2.0**62:
            raise ArithmeticError("scores may not fit 64 bits")
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        out = np.zeros((len(self.rid), postings.n), kind)
        room = np.empty_like(out)
        _, mine, theirs = np.intersect1d(self.terms, postings.terms, assume_unique=True, return_indices=True)
        for q, p in zip(mine.tolist(), theirs.tolist()):
            rows, at, weights = self.rows[q], postings.at[p], postings.weights[p].astype(kind)
            scale = self.weights[q].astype(kind)[:, None]
            if at is None and len(rows) == len(out):
                np.multiply(scale, weights, out=room)
                out += room
            elif at is None:
                out[rows] += scale * weights
            else:
                out[np.ix_(rows, at)] += scale * weights
        return out

    def take(self, postings: _Postings) -> None:
        """Score a chunk and keep each query's k best so far, ties to the smaller id."""
        scores = self.scores(postings)
        good = scores >= self.least[:, None]
        many = np.flatnonzero(np.count_nonzero(good, axis=1) > self.k)
        if len(many):
            good[many] = _selected(scores[many], self.k)
        row, at = np.nonzero(good)
        new = {"row": row, "score": scores[row, at].astype(np.int64), "null": postings.null[at], "id": postings.id[at], "rid": postings.rid[at]}
        both = {c: np.concatenate([self.best[c], new[c]]) for c in new}
        order = np.lexsort((both["rid"], both["id"], both["null"], -both["score"], both["row"]))
        row = both["row"][order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.best = {c: v[order][place < self.k] for c, v in both.items()}
        full = self.best["row"][np.flatnonzero(place[place < self.k] == self.k - 1)]
        self.least[full] = self.best["score"][place[place < self.k] == self.k - 1]

    def found(self) -> pa.RecordBatch:
        own = self.best["rid"] == self.rid[self.best["row"]]
        b = {c: v[~own] for c, v in self.best.items()}
        columns = [pa.array(self.rid[b["row"]]), self.key.take(pa.array(b["row"])), pa.array(b["id"], mask=b["null"]), pa.array(b["score"]), pa.array(b["rid"])]
        return pa.RecordBatch.from_arrays(columns, ["q", "query_id", "id", "score", "rid"])


def _selected(scores: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k largest entries of each row, ties to the left."""
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    above, level = scores > kth, scores == kth
    room = k - np.count_nonzero(above, axis=1)
    return above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= room[:, None]))


class _Postings:
    """A chunk of candidates in the order of their ids, as postings by term; a term that most hold is laid out in full."""

    def __init__(self, rid: np.ndarray, key: pa.Array, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        null, ids = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy()
        order = np.lexsort((rid, ids, null))
        self.n, self.rid, self.id, self.null = len(rid), rid[order], ids[order], null[order]
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        self.most = float(np.abs(weights).max(initial=0))
        at = np.repeat(place, sizes)
        by = np.argsort(terms, kind="stable")
        self.terms, first = np.unique(terms[by], return_index=True)
        self.at, self.weights = np.split(at[by], first[1:]), np.split(weights[by], first[1:])
        for k, (a, w) in enumerate(zip(self.at, self.weights)):
            if 2 * len(a) > self.n and len(np.unique(a)) == len(a):
                laid = np.zeros(self.n, np.int64)
                laid[a] = w
                self.at[k], self.weights[k] = None, laid


def _parts(batch: pa.RecordBatch) -> tuple:
    """rid, id, sizes, terms and weights of a batch of sparse rows."""
    terms, weights = batch.column("terms"), batch.column("weights")
    return batch.column("rid").to_numpy(), batch.column("id"), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), weights.flatten().to_numpy()


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k + 1 best candidates of each cell's queries less the query itself, for rows in the order of cell and side."""
    cell, held, queries = None, [], []

    def ended() -> Iterator[pa.RecordBatch]:
        for q in queries:
            yield q.found()

    for b in batches:
        keys = [b.column(c).to_numpy() for c in ("qblock", "cblock", "side")]
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in keys], axis=0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
            if low == high:
                continue
            at, side = (keys[0][low], keys[1][low]), keys[2][low]
            if at != cell:
                yield from ended()
                cell, held, queries = at, [], []
            if side == 0:
                held.append(b.slice(low, high - low))
                continue
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                queries = [_Queries(*_parts(whole.slice(x, ROWS)), k + 1) for x in range(0, len(whole), ROWS)]
                held = []
            for x in range(low, high, CHUNK):
                postings = _Postings(*_parts(b.slice(x, min(CHUNK, high - x))))
                for q in queries:
                    q.take(postings)
    yield from ended()
    give_back()


def top_k(rows: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """The k rows with the greatest inner product with each query: query_id, rank, id, score.

    ``rows`` are sparse rows (id long, terms array of long, weights array of long), a term
    at most once in a row; those for which ``is_query`` holds are queries, and every row
    but the query's own is a candidate, be it an equal one. Terms that only one of two rows
    has add nothing; a row without terms scores 0. Ties go to the smaller id, null ids come
    last. Repeated query rows are answered one by one. Scores that may not fit 64 bits are
    an error. An empty table gives no rows.

    Rows are dealt into blocks by a hash of their number, whatever their ids and values, so
    that copies are spread. Every block of queries meets every block of candidates once; a
    task holds one block of queries and a chunk of candidates. The merge takes k rows of a
    query from each cell.
    """
    rows = stage(rows.select("id", "terms", "weights", F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("rid", F.monotonically_increasing_id()), "sparse")
    n, asking, entries = rows.agg(F.count("*"), F.count_if("asks"), F.sum(F.when(F.col("asks"), F.size("terms")))).first()
    tasks = partitions(rows)
    cblocks = max(-(-n // CANDIDATES), min(tasks, -(-n // CHUNK)), 1)
    qblocks = max(-(-asking // QUERIES), -(-(entries or 0) // ENTRIES), 1)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(m)).cast("int")
    row = ["rid", "id", "terms", "weights"]
    queries = rows.where("asks").select(*row, dealt(qblocks, 1).alias("qblock"), every(cblocks).alias("cblock"), F.lit(0).alias("side"))
    candidates = rows.select(*row, every(qblocks).alias("qblock"), dealt(cblocks, 2).alias("cblock"), F.lit(1).alias("side"))
    cells = queries.union(candidates).repartition(max(tasks, min(qblocks * cblocks, 16 * tasks)), "qblock", "cblock").sortWithinPartitions("qblock", "cblock", "side")
    found = stage(cells.mapInArrow(lambda batches: _search(k, batches), "q long, query_id long, id long, score long, rid long"), "best")
    unstage(rows)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
