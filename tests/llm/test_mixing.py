import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import mixing


@pytest.mark.parametrize("seed", range(40))
def test_subset_sum_is_optimal(seed):
    rng = random.Random(seed)
    sizes = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 5))))
    counts = np.array([rng.randint(1, 4) for _ in sizes])
    budget = rng.randint(0, 80)
    sums = {0}
    for s, c in zip(sizes.tolist(), counts.tolist()):
        sums = {x + s * k for x in sums for k in range(c + 1)}
    take = mixing.subset_sum(sizes, counts, budget)
    assert (take <= counts).all() and (take * sizes).sum() == max(x for x in sums if x <= budget)


@pytest.mark.parametrize("seed", range(20))
def test_fit_keeps_counts_and_budget(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(0, 500, 60))
    counts = rng.integers(1, 50, len(sizes))
    budget = int(rng.uniform(0, 1) * (sizes * counts).sum())
    take = mixing.fit(sizes, counts, budget)
    assert (take >= 0).all() and (take <= counts).all() and 0 <= budget - (take * sizes).sum() <= 2


def brute_targets(sizes):
    keys = sorted((k for k in sizes if k is not None), key=lambda k: [ord(c) for c in k]) + ([None] if None in sizes else [])
    w = {k: (1, 2, 3)[i % 3] for i, k in enumerate(keys)}
    goal, open_, rest = {}, set(keys), sum(sizes.values())
    while True:
        total = sum(w[k] for k in open_)
        over = {k for k in open_ if total and rest * w[k] / total >= 3 * sizes[k]}
        if not over:
            return goal | {k: rest * w[k] / total for k in open_}
        for k in over:
            goal[k] = 3.0 * sizes[k]
            rest -= 3 * sizes[k]
        open_ -= over
        if not open_:
            return goal


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        src = rng.choice(["hot"] * 6 + ["a", "b", "é", "Z", None, "tiny"] if i > 3 else ["tiny"])
        n = rng.choice([0, 1, 2, 5, 9, 40, 41, 300])
        rows.append((i, None if rng.random() < 0.02 else " \t".join(["w"] * n), src))
    return rows + [(5000, "x", "a"), (5000, "x", "a"), (None, "y z", "b"), (6000, "", "void")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, size int, key string").repartition(4).cache()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, src = defaultdict(int), {}
    for i, t, s in rows:
        size[s] += len((t or "").split())
        src[i] = s
    goal = brute_targets(dict(size))
    taken = defaultdict(int)
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 1, s
    again = mixing.mix(docs).collect()
    plain = lambda rs: sorted(str(r.asDict() | {"rid": 0}) for r in rs)
    assert plain(got) == plain(again)
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len((r.text or "").split())
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}


def test_tied_sources_are_told_apart(spark):
    """Four sources of as many words, two of them with the same target as well: each one comes near its own."""
    rows = [(100 * k + i, "w " * n, s) for k, s in enumerate("abcd") for i, n in enumerate([*range(1, 40), 130])]
    got = mixing.sources_near(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))).collect()
    assert len(got) == len(rows) and len({r.source_size for r in got}) == 1 and len({r.target for r in got}) == 3
    assert all(r.near for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == [] and mixing.mixed(docs).collect() == []


def test_a_document_of_ten_million_words():
    import tracemalloc

    sizes = np.array([3, 50, 400, 10_000_000, 90_000_000])
    counts = np.array([400, 900, 3000, 2, 1])
    tracemalloc.start()
    for budget in (500, 700_000, 10_500_007, 60_000_000, 111_000_000):
        take = mixing.fit(sizes, counts, budget)
        left = budget - int((sizes * take).sum())
        untaken = sizes[(sizes > mixing.LONG) & (take < counts)]
        assert (take <= counts).all() and 0 <= left < (3 if budget < 20_000_000 else untaken.min())
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
