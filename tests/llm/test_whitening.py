import math
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, x int, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(5)


def by_row(df, **more):
    out = {}
    for r in W.whitened(df, **more).collect():
        out.setdefault(r["id"], []).append(r)
    return {i: sorted(rs, key=lambda r: r["component"]) for i, rs in out.items()}


def test_moments_merge_like_one_block():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 50, (500, 6)) + 10**6
    parts = [W.moments(p) for p in np.split(x, [1, 3, 200, 450])]
    n, mean, scatter, sums = W.merged(W.merged(parts[4], parts[0]), W.merged(W.merged(parts[1], parts[2]), parts[3]))
    d = x - x.mean(axis=0)
    assert n == 500 and sums == x.sum(axis=0).tolist()
    np.testing.assert_allclose(mean, x.mean(axis=0), rtol=1e-14)
    np.testing.assert_allclose(scatter, d.T @ d, rtol=1e-11)


def test_against_plain_matrices(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 11)) * np.linspace(3, 0.2, 11)
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 9), (902, [float("nan")] * 11), (903, [float("-inf")] * 11)]
    got = by_row(frame(spark, rows + bad))
    x = [[math.floor(Fraction(float(c)) * 1024) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    values, bases = np.linalg.eigh(cov)
    values, bases = values[::-1], bases[:, ::-1]
    want = centred @ bases / np.sqrt(values)
    assert set(got) == set(range(300))
    for i, rs in got.items():
        assert [r["component"] for r in rs] == list(range(1, 9)) and {r["n"] for r in rs} == {n}
        assert {int(r["deviation"]) for r in rs} == {sum((n * c - s) ** 2 for c, s in zip(x[i], sums))}
    w = np.array([[r["whitened"] for r in got[i]] for i in range(300)])
    np.testing.assert_allclose(np.abs(w), np.abs(want[:, :8]), rtol=1e-9, atol=1e-10)
    np.testing.assert_allclose(w.T @ w / n, np.eye(8), atol=1e-10)
    np.testing.assert_allclose([r["explained"] for r in got[0]], (values / np.trace(cov))[:8], rtol=1e-10)
    assert {r["identity_error"] for rs in got.values() for r in rs}.pop() < 1e-9


def test_repeats_null_ids_few_dimensions_and_lengths(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -2.0]), (None, [3.0, 1.0]), (5, []), (6, [1.0]), (7, [3.0])]
    got = by_row(frame(spark, rows))
    assert {i: len(rs) for i, rs in got.items()} == {1: 4, 2: 2, None: 2, 6: 1, 7: 1}
    assert {r["n"] for r in got[1]} == {4} and {r["n"] for r in got[6]} == {2}
    assert [abs(r["whitened"]) for i in (6, 7) for r in got[i]] == pytest.approx([1.0, 1.0])


def test_directions_without_spread_have_no_scale(spark):
    got = by_row(frame(spark, [(1, [1.0, 7.0]), (2, [2.0, 7.0])]))
    assert [r["whitened"] is None for r in got[1]] == [False, True] and got[1][0]["explained"] == pytest.approx(1.0)
    alone = by_row(frame(spark, [(1, [1.0, 7.0])]))
    assert [(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in alone[1]] == [(None, None, None, 0)] * 2


@pytest.mark.parametrize("size", [10**3, 10**9, 2**31, 2**40, 2**51, 2**52, 2**60])
def test_deviations_in_every_number_type(size):
    y = np.random.default_rng(size % 97).integers(-size, size + 1, (50, 64))
    assert [int(v) for v in W._deviation(y).to_pylist()] == [sum(int(c) ** 2 for c in r) for r in y]


def test_exact_beyond_64_bits(spark):
    rows = [(1, [2.0**38, 0.0]), (2, [-(2.0**38), 1.0]), (3, [5.0, 5.0])]
    got = by_row(frame(spark, rows))
    x = [[int(c * 1024) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert int(got[1][0]["deviation"]) == sum((3 * c - s) ** 2 for c, s in zip(x[0], sums)) > 2**63
    with pytest.raises(Exception, match="too large"):
        by_row(frame(spark, [(1, [1e30])]))


def test_empty(spark):
    assert by_row(frame(spark, [(1, [1.0])]).limit(0)) == {}
    assert by_row(spark.createDataFrame([], SCHEMA)) == {}
