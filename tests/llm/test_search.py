import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import search as S


def brute(rows, every, k):
    """rows of (id, vector); the integer product over all pairs, in Python's own integers."""
    ok = [(i, [math.floor(Fraction(float(c)) * 1024) for c in v]) for i, v in rows if v is not None and None not in v and all(math.isfinite(c) for c in v)]
    out = []
    for q, (i, x) in enumerate(ok):
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), j is None, j or 0) for c, (j, y) in enumerate(ok) if c != q)
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def answer(df, every, k):
    return sorted((tuple(r) for r in S.top_k(S.quantised(df), F.col("id") % every == 0, k).collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, score int, rid int"


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in {"QUERIES": 5, "CANDIDATES": 40, "ROWS": 3, "CHUNK": 7}.items():
            monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(120, 12)) * (rng.random((120, 12)) < 0.5)
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    rows += [(500 + i, rows[7][1]) for i in range(90)]  # a third of the rows are copies
    rows += [(10, rows[10][1]), (10, rows[10][1]), (None, rows[7][1]), (700, None), (710, [1.0, None]), (720, [float("nan")] * 12), (730, [float("inf")] * 12)]
    rows += [(740, []), (750, [0.0] * 12), (760, [2.0]), (770, [1e5] * 12), (780, [-1e-9] * 12)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    assert answer(df, 10, 6) == brute(rows, 10, 6)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert answer(df, 2, 10) == brute(rows, 2, 10)
    assert answer(df.where("vec_id = 0"), 2, 10) == []
    assert answer(df.limit(0), 2, 10) == []


@pytest.mark.parametrize("size", [0.1, 100.0, 1e5])
def test_exact_in_every_number_type(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=9) * size).astype(np.float32).tolist()) for i in range(40)]
    assert answer(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA), 4, 5) == brute(rows, 4, 5)


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e12] * 4, 1, 2, 3), (1, [1e12] * 4, 1, 2, 3)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        answer(df, 1, 5)


def test_long_sparse_rows(spark):
    """Text-like rows: many terms, few in common, unequal lengths."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        terms = rng.choice(5000, int(rng.integers(0, 300)), replace=False)
        rows.append((i, [int(t) for t in terms], [int(w) for w in rng.integers(-9, 9, len(terms))]))
    got = sorted(tuple(r) for r in S.top_k(spark.createDataFrame(rows, "id long, terms array<long>, weights array<long>"), F.col("id") < 20, 7).collect())
    held = [dict(zip(t, w)) for _, t, w in rows]
    want = []
    for q in range(20):
        found = sorted((-sum(w * held[c].get(t, 0) for t, w in held[q].items()), c) for c in range(60) if c != q)
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found[:7])]
    assert got == sorted(want)
