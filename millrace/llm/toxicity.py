"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each category's model also sees the
log-odds of the categories before it. While training, those are out-of-fold
predictions, so later models learn from what earlier ones say about documents they
haven't seen. Features are the presence of words and of their beginnings.

The chain is: low quality, as labelled; the themes of toxic documents, which are
learnt from the sample, in whatever languages it has, by grouping toxic documents
whose telling features go together; toxic, as labelled. No vocabulary is built in.

The models are fitted on at most ``SAMPLE`` labelled documents, those with the
smallest hashes, and on at most ``FEATURES`` features, those whose presence differs
most between toxic and other documents. Every document is scored on its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, stage, without

#: Labelled documents that the models are fitted on, at most.
SAMPLE = 12_000
#: Features per chain, at most.
FEATURES = 4_096
FOLDS = 5
#: Documents that a feature must be in to be considered.
LEAST = 3
CACHE_CHUNKS = 100_000

#: Groups of toxic documents that the chain predicts on the way.
THEMES = 2
#: Telling features that the groups are made from, at most.
THEME_FEATURES = 512

CATEGORIES = ("low_quality", *(f"theme_{k + 1}" for k in range(THEMES)), "toxic")

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def word_features(chunk: str) -> list[str]:
    """A white-space-free chunk's words, and marked beginnings of longer ones."""
    out = []
    for w in _WORD.findall(chunk.lower()):
        out.append(w)
        out += [w[:n] + "*" for n in PREFIXES if len(w) > n]
    return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Sparse binary rows with a few dense columns beside them."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.n, self.width = len(sets), width
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.item = np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)

    def only(self, keep: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        number = np.cumsum(keep) - 1
        held = keep[self.owner]
        out.n, out.width, out.owner, out.item = int(keep.sum()), self.width, number[self.owner[held]], self.item[held]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.item], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.item, r[self.owner], self.width)


@dataclass
class Linear:
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def odds(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        return rows.dot(self.weights) + dense @ self.dense + self.bias


def train(rows: Rows, dense: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 150) -> Linear:
    """Logistic regression by accelerated full-batch gradient steps with per-weight scales."""
    n = max(1, len(y))
    rate = (y.sum() + 0.5) / (n + 1)
    model = Linear(np.zeros(rows.width), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return model
    theta = np.concatenate([model.weights, model.dense, [model.bias]])
    w, d = rows.width, dense.shape[1]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        r = (sigmoid(rows.dot(theta[:w]) + dense @ theta[w : w + d] + theta[-1]) - y) / n
        g = np.concatenate([rows.back(r), dense.T @ r, [r.sum()]])
        g[:-1] += l2 / 10 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.3 / (1 + 0.02 * t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Linear(theta[:w], theta[w : w + d], float(theta[-1]))


@dataclass
class Chain:
    features: dict[str, int]
    models: list[Linear]
    threshold: float

    def probabilities(self, rows: Rows) -> np.ndarray:
        dense = np.zeros((rows.n, 0))
        for model in self.models:
            dense = np.column_stack([dense, np.clip(model.odds(rows, dense), -14, 14)])
        return sigmoid(dense)


def fit_chain(rows: Rows, targets: np.ndarray, folds: np.ndarray, features: dict[str, int]) -> Chain:
    """Fit the models in order; the threshold makes the best F1 of out-of-fold predictions."""
    dense, models, out = np.zeros((rows.n, 0)), [], np.zeros(rows.n)
    for k in range(targets.shape[1]):
        out = np.zeros(rows.n)
        for f in range(FOLDS):
            held = folds == f
            if held.any():
                part = train(rows.only(~held), dense[~held], targets[~held, k])
                out[held] = part.odds(rows.only(held), dense[held])
        models.append(train(rows, dense, targets[:, k]))
        dense = np.column_stack([dense, np.clip(out, -14, 14)])
    return Chain(features, models, best_threshold(out, targets[:, -1]))


def best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Of the probabilities that give the best F1 the one nearest to a half."""
    if not y.any():
        return 0.5
    order = np.argsort(-odds, kind="stable")
    sorted_ = odds[order]
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + y.sum())
    cut = np.append(sorted_[1:] < sorted_[:-1], True)  # equal odds fall on one side
    best = np.flatnonzero(cut & (f1 >= f1[cut].max() - 1e-12))
    high = sigmoid(sorted_[best])
    low = np.append(sigmoid(sorted_), 0.0)[best + 1]
    # Rejected from ``t`` on, with low < t <= high.
    nearest = np.where((low < 0.5) & (high >= 0.5), 0.5, (low + high) / 2)
    return float(nearest[np.argmin(np.abs(nearest - 0.5))])


def themes(rows: Rows, y: np.ndarray, count: int = THEMES) -> np.ndarray:
    """A 0/1 column per theme: which toxic rows belong to it.

    Features that toxic rows have more often are weighted by their log-odds; rows are
    grouped by the direction of what they have of them, from seeds as far apart as
    they come. A toxic row without such features has no theme.
    """
    out = np.zeros((rows.n, count))
    toxic = y > 0
    inside = rows.only(toxic)
    p = (np.bincount(inside.item, minlength=rows.width) + 0.5) / (inside.n + 1)
    q = (np.bincount(rows.only(~toxic).item, minlength=rows.width) + 0.5) / (rows.n - inside.n + 1)
    weight = np.log(p / q)
    # Features come in the order of how much they tell.
    telling = np.flatnonzero(weight > 1)[:THEME_FEATURES]
    if not inside.n or not len(telling):
        return out
    column = np.full(rows.width, -1)
    column[telling] = np.arange(len(telling))
    held = column[inside.item] >= 0
    x = np.zeros((inside.n, len(telling)), np.float32)
    x[inside.owner[held], column[inside.item[held]]] = weight[inside.item[held]]
    length = np.sqrt((x * x).sum(axis=1))
    has = length > 0
    if not has.any():
        return out
    x = x[has] / length[has, None]
    center = [x[int(np.argmax(x @ x.mean(axis=0)))]]
    while len(center) < count:
        center.append(x[int(np.argmin(np.max([x @ c for c in center], axis=0)))])
    group = np.zeros(len(x), int)
    for step in range(20):
        new = np.argmax(x @ np.stack(center).T, axis=1)
        if step and (new == group).all():
            break
        group = new
        sums = [x[group == k].sum(axis=0) if (group == k).any() else center[k] for k in range(count)]
        center = [c / max(float(np.sqrt(c @ c)), 1e-12) for c in sums]
    out[np.flatnonzero(toxic)[has], group] = 1
    return out


def _features(rows: DataFrame, keep: dict[str, int] | None) -> DataFrame:
    """Replace text by its distinct features: names, or numbers of those to keep."""
    kind = "array<string>" if keep is None else "array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                found = []
                for text in part.column(len(names)).to_pylist():
                    have = set()
                    for c in set((text or "").split()):
                        have.update(word_features(c))
                    found.append(sorted(have) if keep is None else sorted({keep[x] for x in have if x in keep}))
                cols = [part.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.list_(pa.string() if keep is None else pa.int32()))], [*names, "found"])

    names = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "text").mapInArrow(run, f"{kinds}, found {kind}")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Chain:
    """Fit a chain on the labelled documents with the smallest hashes, ``sample`` at most.

    Only the sample's features reach the driver: ``features`` names with counts, and
    the numbers of those that each sampled document has.
    """
    known = labels.select("doc_id", "toxic", "quality").where("doc_id is not null and toxic is not null")
    low = F.coalesce(F.max(1 - F.col("quality")), F.lit(0)).cast("int").alias("low")
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"), low).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Of texts that share an id the least one, so that reruns agree.
    texts = docs.select("doc_id", "text").join(F.broadcast(stage(chosen, "sample")), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("y").alias("y"), F.first("low").alias("low")
    )
    texts = stage(texts, "training")
    n, positive = texts.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    negative = n - positive
    if not positive or not negative:
        return Chain({}, [Linear(np.zeros(0), np.zeros(k), -14.0) for k in range(len(CATEGORIES))], 0.5)
    counts = _features(texts, None).select("y", F.explode("found").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    p, q = F.col("p") / F.lit(float(positive)), (F.col("c") - F.col("p")) / F.lit(float(negative))
    rate = F.col("c") / F.lit(float(n))
    spread = F.abs(p - q) / F.sqrt(rate * (1.001 - rate))
    top = counts.where(F.col("c") >= LEAST).orderBy(F.desc(F.round(spread, 9)), "f").limit(features).select("f").collect()
    names = {r.f: k for k, r in enumerate(top)}
    rows = _features(texts, names).orderBy("doc_id").collect()
    y, bad = (np.array([r[c] for r in rows], float) for c in ("y", "low"))
    sets = Rows([np.array(r.found, np.int64) for r in rows], len(names))
    folds = np.array([(r.doc_id * 2654435761 >> 8) % FOLDS for r in rows])
    return fit_chain(sets, np.column_stack([bad, themes(sets, y), y]), folds, names)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``rid`` and ``doc_id`` of each row with its category probabilities and the decision ``rejected``."""
    names = [f"p_{c}" for c in CATEGORIES]
    kept = {w: k for w, k in chain.features.items() if any(m.weights[k] for m in chain.models)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}

        def look(chunk: str) -> tuple[int, ...]:
            found = tuple(kept[x] for x in word_features(chunk) if x in kept)
            if len(chunk) <= 64:
                if len(cache) >= CACHE_CHUNKS:
                    cache.clear()
                cache[chunk] = found
            return found

        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                sets = []
                for text in part.column(2).to_pylist():
                    have: set[int] = set()
                    for c in set((text or "").split()):
                        f = cache.get(c)
                        if f is None:
                            f = look(c)
                        if f:
                            have.update(f)
                    sets.append(np.array(sorted(have), np.int64))
                prob = np.round(chain.probabilities(Rows(sets, len(chain.features))), 6)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(prob[:, k]) for k in range(len(names))), pa.array(prob[:, -1] >= chain.threshold)],
                    ["rid", "doc_id", *names, "rejected"],
                )
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return rows.mapInArrow(run, "rid long, doc_id long, " + ", ".join(f"{c} double" for c in names) + ", rejected boolean")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_low_quality, p_theme_1, p_theme_2, p_toxic, rejected.

    A null or empty text has no features and gets the base rates. Labels without
    ``toxic``, or of documents that aren't there, are passed over; of several labels the
    largest holds, and the least quality; no quality is not a low one. Without labels of
    both kinds nothing is rejected. Repeated rows
    are scored each; an empty table gives no rows. Only doc_id and text are read.
    """
    return score(docs, learn(docs, labels, sample)).drop("rid")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns kept.

    Null and empty texts stay unless the base rate alone rejects; repeated rows go or stay
    together; an empty table stays empty. Columns of any names ride along as they are.
    """
    return without(docs, score(docs, learn(docs, labels, sample)).where("rejected").select("rid"))

