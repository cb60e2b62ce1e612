import numpy as np
import pytest

from millrace.llm import embeddings as E


def brute(rows):
    ok = [None if lab is None or not v or None in v or not np.isfinite(v).all() or not np.any(v) else np.array(v, float) for _, v, lab in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = ok[i], ok[j]
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    comp = np.arange(n)
    for _ in range(n):
        new = comp.copy()
        for i in range(n):
            if link[i].any():
                new[i] = min(new[i], new[link[i]].min())
        if (new == comp).all():
            break
        comp = new
    ids = {}
    for i in range(n):
        ids[comp[i]] = min(ids.get(comp[i], rows[i][0]), rows[i][0])
    return sorted((rows[i][0], int(link[i].sum()), ids[comp[i]], rows[i][0] == ids[comp[i]]) for i in range(n))


@pytest.mark.parametrize("tile", [2048, 7])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(150):
        v = base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.25, 0.4])
        rows.append((int(1000 - i), (v * rng.choice([1.0, 3.0])).astype(np.float32).tolist(), int(rng.integers(3)) if i % 20 else None))
    rows += [(1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] + [1.0] * 15, 0), (4, [1.0, None], 0), (5, [], 0), (6, [1.0, 1.0], 0), (7, [2.0, 2.0], 0), (8, [float("inf")] * 16, 0)]
    rows += [(9, rows[0][1], 1), (9, rows[0][1], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n int").repartition(4).cache()
    assert sorted(tuple(r) for r in E.near_vectors(df).collect()) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(200, 33)) ** 3
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    q, s, e = E.quantised(u)
    approx = E.int8_product(q, q) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - approx) <= e[:, None] + e[None, :] + e[:, None] * e[None, :]).all()


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
