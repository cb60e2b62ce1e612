import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import bootstrap, metrics, study
from millrace.plans import documents


def weeks(n):
    return [dt.date(2020, 1, 3) + dt.timedelta(7 * k) for k in range(n)]


def test_rank_correlation_with_ties():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, 50).astype(float), rng.integers(0, 9, 50).astype(float)
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert bootstrap.rank_correlation(x, y) == pytest.approx(want)
    many = bootstrap.rank_correlation(np.stack([x, y]), np.stack([y, y]))
    assert many == pytest.approx([want, 1.0])


def test_block_indices_follow_the_generator():
    ix = bootstrap.block_indices(23, 8, 5, 11)
    starts = np.random.default_rng(11).integers(0, 16, size=(5, 3))
    assert ix.shape == (5, 23) and (ix[:, 0] == starts[:, 0]).all() and (ix[:, 22] == starts[:, 2] + 6).all()
    low, high = bootstrap.statistic_interval(np.arange(30.0))
    assert low < 14.5 < high and np.isnan(bootstrap.statistic_interval(np.arange(4.0))[0])


def test_intervals_per_cell(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=80)
    t = s + rng.normal(size=80)
    rows = [("A", w, float(a), float(b), bool(a > 0)) for w, a, b in zip(weeks(80), s, t)] + [("B", weeks(1)[0], 1.0, 2.0, True)]
    df = spark.createDataFrame(rows, "symbol string, week date, s double, t double, on boolean").repartition(4)
    (ic,) = bootstrap.ic_interval(df, ["symbol"], draws=200).collect()
    ix = bootstrap.block_indices(80, 8, 200, 11)
    want = np.quantile([pd.Series(s[i]).rank().corr(pd.Series(t[i]).rank()) for i in ix], [0.05, 0.95])
    assert (ic.low, ic.high) == pytest.approx(tuple(want)) and ic.n == 80
    got = {r.symbol: r for r in bootstrap.mean_interval(df, ["symbol"]).collect()}
    means = t[bootstrap.block_indices(80, 8, 1000, 11)].mean(axis=1)
    assert (got["A"].low, got["A"].high) == pytest.approx(tuple(np.quantile(means, [0.05, 0.95]))) and got["B"].mean is None
    diff = {r.symbol: r for r in bootstrap.difference_interval(df, ["symbol"]).collect()}
    assert diff["A"].diff == pytest.approx(t[s > 0].mean() - t[s <= 0].mean()) and diff["A"].low < diff["A"].diff < diff["A"].high and diff["B"].diff is None


def test_intervals_of_any_statistic(spark):
    x = np.random.default_rng(6).normal(size=40)
    rows = [("A", w, float(v)) for w, v in zip(weeks(40), x)] + [("B", w, 1.0) for w in weeks(4)]
    df = spark.createDataFrame(rows, "symbol string, week date, t double").repartition(3)
    got = {r.symbol: r for r in bootstrap.statistic_intervals(df, ["symbol"], np.median, draws=300).collect()}
    starts = np.random.default_rng(7).integers(0, 31, size=(300, 4))
    drawn = [np.median(np.concatenate([x[s : s + 10] for s in row])[:40]) for row in starts]
    assert (got["A"].low, got["A"].high) == pytest.approx(tuple(np.quantile(drawn, [0.025, 0.975]))) and (got["B"].n, got["B"].low) == (4, None)


def test_documents_nest_by_name(spark):
    rows = [("SPY", "beta_60", 10, 0.5), ("SPY", "rsi14", 20, None), ("QQQ", "rsi14", 10, 1.25)]
    df = spark.createDataFrame(rows, "symbol string, signal string, q int, x double").repartition(3)
    df = df.withColumn("signal", documents.published("signal"))
    (r,) = documents.nested(df, ["symbol", "signal", "q"], F.struct("x")).select(F.to_json("v").alias("j")).collect()
    assert json.loads(r.j) == {"QQQ": {"rsi14": {"10": {"x": 1.25}}}, "SPY": {"beta_spy_60": {"10": {"x": 0.5}}, "rsi14": {"20": {}}}}


def test_conditions_follow_their_table(spark):
    names = [n for n, *_ in study.CONDITIONS]
    assert len(names) == len(set(names)) == 13 and {x for *_, x in study.CONDITIONS if isinstance(x, str)} == {n for n, *_ in study.CUTOFFS}
    rows = [("A", w, float(k), k / 60, (k - 30) / 100, (k - 20) / 50, -k / 200, float(k)) for k, w in enumerate(weeks(60))]
    df = spark.createDataFrame(rows, "symbol string, week date, rsi14 double, sector_corr_60 double, trend_84d double, px_vs_ma200 double, deep_dd_60 double, vol_own double")
    on = {n: 0 for n in names}
    for r in study.conditions(df).collect():
        on[r.condition] += r.on
    assert on["rsi14_lt_40"] == 40 and on["sector_corr_lt_0.45"] == 27 and on["trend_84d_lt_0"] == 30 and on["px_below_ma200"] == 20 and on["deep_dd_60_lt_-0.12"] == 36
    assert on["vol_top_tercile"] == on["vol_hi_tercile"] == 20 and on["vol_lo_tercile"] == on["rsi14_lo_tercile"] == 20 and on["trend_84d_top_decile"] == 6


def test_a_callers_own_conditions(spark):
    rows = [("A", w, float(k)) for k, w in enumerate(weeks(40))] + [("B", w, 10.0 * k) for k, w in enumerate(weeks(40))]
    df = spark.createDataFrame(rows, "symbol string, week date, x double")
    got = study.conditions(df, (("low", "x", "<", 5.0), ("top", "x", ">=", "x_hi")), (("x_hi", "x", 0.75, 1),)).where("on").groupBy("symbol", "condition").count().collect()
    assert {(r.symbol, r.condition): r["count"] for r in got} == {("A", "low"): 5, ("B", "low"): 1, ("A", "top"): 10, ("B", "top"): 10}
    alone = study.conditions(df, (("low", "x", "<", 5.0),), ())
    assert alone.where("on").count() == 6 and alone.columns == ["symbol", "week", "condition", "on"]


def test_null_signals_fall_in_the_bottom_bucket(spark):
    rows = [("A", w, None if k % 2 else 1.0, float(k)) for k, w in enumerate(weeks(60))]
    df = spark.createDataFrame(rows, "symbol string, week date, sig double, breach_10 double")
    cells = study.sweep(df.drop("breach_10"), df.drop("sig"), ["sig"], ["breach_10"]).where("q = 0.5").collect()
    assert (cells[0].n_top, cells[0].n_bottom) == (30, 30) and cells[0].diff == pytest.approx(-100.0)


def test_metrics(spark):
    days = [d.date() for d in pd.bdate_range("2022-11-01", periods=120)]
    rng = np.random.default_rng(3)
    eq = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120))), index=pd.to_datetime(days))
    df = spark.createDataFrame([("r", d, float(v)) for d, v in zip(days, eq)], "run string, session date, equity double").repartition(3)
    (m,) = metrics.equity_metrics(df, ["run"]).collect()
    r = eq.pct_change().dropna()
    assert m.sharpe == pytest.approx(r.mean() / r.std() * np.sqrt(252)) and m.sortino == pytest.approx(r.mean() / r[r < 0].std() * np.sqrt(252))
    assert m.max_drawdown == pytest.approx((eq / eq.cummax() - 1).min())
    assert m.worst_week == pytest.approx(eq.resample("W").last().pct_change().min()) and m.worst_month == pytest.approx(eq.resample("ME").last().pct_change().min())
    run = best = 0
    for under in eq < eq.cummax():
        run = run + 1 if under else 0
        best = max(best, run)
    assert m.longest_dd_sessions == best
    years = {x.year: x.ret for x in metrics.yearly_returns(df, ["run"]).collect()}
    ends = eq.resample("YE").last()
    assert years == pytest.approx({2022: ends.iloc[0] / eq.iloc[0] - 1, 2023: ends.iloc[1] / ends.iloc[0] - 1})
    trades = spark.createDataFrame([("r", 5.0, days[0], days[3]), ("r", -2.0, days[0], days[1]), ("r", None, days[0], None)], "run string, pnl double, open_session date, close_session date")
    (t,) = metrics.trade_metrics(trades, ["run"]).collect()
    assert (t.n_trades, t.win_rate, t.profit_factor, t.median_holding_days) == (2, 0.5, 2.5, 2.0)
    (t,) = metrics.trade_metrics(trades.where("pnl > 0"), ["run"]).collect()
    assert t.profit_factor is None and t.avg_loss == 0
