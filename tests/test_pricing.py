import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import pricing as P
from millrace.functions import quotes as Q


def price(spark, rows):
    df = spark.createDataFrame([tuple(float(x) for x in r[:6]) + (r[6] == "C",) for r in rows], "s double, k double, t double, v double, r double, q double, c boolean")
    c = F.col
    args = c("s"), c("k"), c("t"), c("v"), c("r"), c("q"), c("c")
    return df.select(P.bs_price(*args).alias("p"), P.bs_greeks(*args).alias("g"), P.no_arb_bounds(c("s"), c("k"), c("t"), c("r"), c("q"), c("c")).alias("b"),
                     P.black76_price(P.forward_price(c("s"), c("t"), c("r"), c("q")), c("k"), c("t"), c("v"), F.exp(-c("r") * c("t")), c("c")).alias("f")).collect()


def test_known_value_and_parity(spark):
    got = price(spark, [(100, 100, 1, 0.2, 0.05, 0, "C"), (400, 410, 30 / 365, 0.18, 0.045, 0.015, "C"), (400, 410, 30 / 365, 0.18, 0.045, 0.015, "P")])
    assert got[0].p == pytest.approx(10.450584, abs=1e-4)
    t = 30 / 365
    assert got[1].p - got[2].p == pytest.approx(400 * math.exp(-0.015 * t) - 410 * math.exp(-0.045 * t), abs=1e-10)
    assert all(abs(r.p - r.f) < 1e-12 for r in got)


def test_degenerate_limits(spark):
    got = price(spark, [(110, 100, 0, 0.2, 0.05, 0, "C"), (90, 100, 0, 0.2, 0.05, 0, "C"), (110, 100, 0.5, 0, 0.05, 0.01, "C")])
    assert [got[0].p, got[1].p] == [10.0, 0.0]
    f = 110 * math.exp(0.04 * 0.5)
    assert got[2].p == pytest.approx(math.exp(-0.025) * (f - 100), abs=1e-10)
    assert got[0].g.delta == 1.0 and got[1].g.delta == 0.0 and got[0].g.vega == 0.0


@pytest.mark.parametrize("kind", ["C", "P"])
def test_greeks_against_differences(spark, kind):
    base = dict(s=400.0, k=420.0, t=30 / 365, v=0.18, r=0.045, q=0.015)
    h = {"s": 0.01, "v": 1e-4, "t": 1e-5, "r": 1e-5}
    rows = [tuple(base.values())]
    for x, d in h.items():
        for sign in (1, -1):
            rows.append(tuple((base | {x: base[x] + sign * d}).values()))
    got = price(spark, [(*r, kind) for r in rows])
    p, g = [r.p for r in got], got[0].g
    diff = {x: (p[1 + 2 * i] - p[2 + 2 * i]) / (2 * d) for i, (x, d) in enumerate(h.items())}
    assert g.delta == pytest.approx(diff["s"], abs=1e-6)
    assert g.gamma == pytest.approx((p[1] - 2 * p[0] + p[2]) / h["s"] ** 2, rel=1e-4)
    assert g.vega == pytest.approx(diff["v"], rel=1e-6)
    assert g.theta == pytest.approx(-diff["t"], rel=1e-4)
    assert g.rho == pytest.approx(diff["r"], rel=1e-4)
    assert (0 < g.delta < 1) if kind == "C" else (-1 < g.delta < 0)


def test_implied_vol_round_trip_and_refusals(spark):
    t, r, q = 30 / 365, 0.045, 0.015
    grid = [(400, k, t, v, r, q, c) for v in (0.08, 0.15, 0.23, 0.6, 1.5) for k in (360, 400, 440) for c in "CP"]
    rows = [(x.p, *map(float, g[:6]), g[6] == "C") for g, x in zip(grid, price(spark, grid)) if x.p >= 1e-8]
    none = [(5.0, 400.0, 350.0, t, 0.0, r, q, True), (500.0, 400.0, 410.0, t, 0.0, r, q, True), (5.0, 400.0, 410.0, 0.0, 0.0, r, q, True), (0.0, 400.0, 410.0, t, 0.0, r, q, True)]
    none = [(p, s, k, tt, v, rr, qq, c) for p, s, k, tt, v, rr, qq, c in none]
    df = spark.createDataFrame(rows + none, "p double, s double, k double, t double, v double, r double, q double, c boolean")
    c = F.col
    args = [c(k) for k in ("p", "s", "k", "t", "r", "q", "c")]
    solved = P.with_implied_vol(df, "iv", *args)
    assert solved.columns == [*df.columns, "iv"] and "Python" not in solved._jdf.queryExecution().executedPlan().toString()
    for got in ([x.iv for x in solved.collect()], [x.iv for x in df.select(P.bisected_vol(*args).alias("iv")).collect()][: len(rows)]):
        for row, iv in zip(rows, got):
            ill = abs(row[0] - max(0, (1 if row[7] else -1) * (row[1] * math.exp(-q * t) - row[2] * math.exp(-r * t)))) < 1e-6
            assert ill or iv == pytest.approx(row[4], abs=1e-8)
        assert got[len(rows) :] in ([], [None] * 4)


def test_solver_over_all_strikes_and_volatilities(spark):
    """Far from the money and near it, short and long, quiet and wild: as exact as the price allows."""
    rng = np.random.default_rng(11)
    n = 4000
    t = 10 ** rng.uniform(-2.5, 0.5, n)
    v = 10 ** rng.uniform(-1.7, 0.6, n)
    k = 100 * np.exp(np.where(rng.random(n) < 0.2, 0.0, rng.normal(size=n)) * v * np.sqrt(t) * 2)
    grid = [(100.0, float(a), float(b), float(x), 0.03, 0.013, "CP"[i % 2]) for i, (a, b, x) in enumerate(zip(k, t, v))]
    rows = [(x.p, *map(float, g[:6]), g[6] == "C", x.g.vega) for g, x in zip(grid, price(spark, grid))]
    df = spark.createDataFrame(rows, "p double, s double, k double, t double, v double, r double, q double, c boolean, vega double")
    args = [F.col(x) for x in ("p", "s", "k", "t", "r", "q", "c")]
    got = P.with_implied_vol(df, "iv", *args).collect()
    # Where the price's last digits move the volatility by more, no solver can do better.
    known = [x for x in got if x.p / max(x.vega, 1e-300) < 1e6]
    assert len(known) > 0.9 * n and all(abs(x.iv - x.v) < 1e-8 + 1e-15 * x.p / x.vega for x in known)
    assert all(x.iv is None or 1e-4 * (1 - 1e-9) <= x.iv <= 5.0 * (1 + 1e-9) for x in got)


def test_year_fraction_and_normal(spark):
    df = spark.sql("select date'2024-01-31' e, date'2024-01-01' d")
    assert df.select(P.year_fraction(F.col("e"), F.col("d"))).first()[0] == 30 / 365
    assert df.select(P.year_fraction(F.col("d"), F.col("e"))).first()[0] == 0.0
    xs = np.linspace(-8, 8, 201)
    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select(P.norm_cdf(F.col("x")).alias("n")).collect()
    assert max(abs(r.n - 0.5 * math.erfc(-x / math.sqrt(2))) for r, x in zip(got, xs)) < 1e-15


def test_fills_and_quotes(spark):
    want = {"optimistic": (2.10, 2.10), "base": (2.15, 2.05), "conservative": (2.21, 1.99), "stress": (2.23, 1.97)}
    df = spark.createDataFrame([(s,) for s in (*want, "unknown")], "scenario string")
    b, a = F.lit(2.0), F.lit(2.2)
    for r in df.select("scenario", Q.fill_price("buy", b, a, F.col("scenario")).alias("x"), Q.fill_price("sell", b, a, F.col("scenario")).alias("y")).collect():
        if r.scenario == "unknown":
            assert r.x is None and r.y is None
        else:
            assert (r.x, r.y) == pytest.approx(want[r.scenario])
            assert (Q.fill("buy", 2.0, 2.2, r.scenario), Q.fill("sell", 2.0, 2.2, r.scenario)) == pytest.approx(want[r.scenario])
    with pytest.raises(ValueError):
        Q.fill("buy", 2.2, 2.0, "base")
    ok = spark.range(1).select(
        Q.quote_ok(F.lit(2.2), F.lit(2.0), False).alias("a"), Q.quote_ok(F.lit(0.0), F.lit(0.05), True).alias("b"), Q.quote_ok(F.lit(0.0), F.lit(0.05), False).alias("c"),
        Q.quote_ok(F.lit(1.0), F.lit(1.1), True, F.lit(0)).alias("d"),
    ).first()
    assert tuple(ok) == (False, False, True, False)
