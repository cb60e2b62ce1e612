"""Order statistics and ranks against pandas, one key with most of the rows included."""

import numpy as np
import pandas as pd
import pytest

from millrace.operators import order

KINDS = "k string, v double, x long"


def frame(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.9, "hot", rng.choice(["b", "c", None], n))
    v = np.where(rng.random(n) < 0.5, np.round(rng.normal(size=n), 1), rng.normal(size=n))  # ties and others
    v[rng.random(n) < 0.3] = 7.0  # a hot value
    v[rng.random(n) < 0.05] = np.nan
    rows = [(a if a is not None and a != "None" else None, None if b != b else float(b), i) for i, (a, b) in enumerate(zip(k, v))]
    rows += [("none", None, n), ("one", 5.0, n + 1)]
    return pd.DataFrame(rows, columns=["k", "v", "x"]), spark.createDataFrame(rows, KINDS).repartition(6)


def test_quantiles(spark):
    pdf, df = frame(spark)
    qs = (0.0, 0.05, 1 / 3, 0.5, 0.9, 1.0)
    got = {r.k: (r.n, r.quantiles) for r in order.quantiles(df, ["k"], "v", qs).collect()}
    assert set(got) == {"hot", "b", "c", None, "none", "one"} and got["none"] == (0, [None] * 6) and got["one"] == (1, [5.0] * 6)
    for k, part in pdf.groupby(pdf["k"].fillna("null")):
        key = None if k == "null" else k
        known = part["v"].dropna()
        if len(known):
            assert got[key][0] == len(known) and got[key][1] == pytest.approx(np.quantile(known, qs).tolist(), abs=1e-12)


def test_average_ranks(spark):
    pdf, df = frame(spark, seed=3)
    got = {r.x: r.rank for r in order.with_average_ranks(df, ["k"], "v", "rank").collect()}
    want = pdf.groupby(pdf["k"].fillna("null"))["v"].rank()
    assert len(got) == len(pdf)
    np.testing.assert_allclose([np.nan if got[x] is None else got[x] for x in pdf["x"]], want)


def test_a_hot_key_is_spread(spark):
    """Where all rows are of one key, many tasks hold its values."""
    df = spark.range(40_000).selectExpr("'a' as k", "cast(id * 7919 % 40009 as double) as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tally = order.tallied(df, ["k"], "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    path = tally.inputFiles()[0].rsplit("/", 1)[0]
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert order.quantiles(df, ["k"], "v", (0.5,)).first().quantiles == [pytest.approx(float(np.median(np.arange(40_000) * 7919 % 40009)))]


def test_empty(spark):
    none = spark.createDataFrame([], KINDS)
    assert order.quantiles(none, ["k"], "v", (0.5,)).collect() == [] and order.with_average_ranks(none, ["k"], "v", "rank").collect() == []
