"""The null rules of windows, against pandas on series with gaps, ties and constants."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import frames
from millrace.functions.windows import change, ordered, rolling
from millrace.operators import features, targets
from millrace.operators.calendar import as_of, day_gaps, next_event, on_calendar, resample_last


def series(seed=0, n=420):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2019-01-01", periods=n)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    x[50:70] = x[50]  # no moves: no losses
    return pd.DataFrame({"symbol": "A", "date": [d.date() for d in days], "close": x})


def back(df, column):
    return pd.Series([r[column] for r in df.orderBy("date").collect()], dtype=float)


def same(got, want, tol=1e-9):
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(float), atol=tol, equal_nan=True)


@pytest.fixture(scope="module")
def px(spark):
    pdf = series()
    return pdf, spark.createDataFrame(pdf).repartition(3).cache()


def test_windows(px):
    pdf, df = px
    c = pdf["close"]
    r = c.pct_change()
    same(back(features.returns(df, (21,)), "ret21"), c.pct_change(21))
    move = c.diff()
    up, down = move.clip(lower=0).rolling(14).mean(), (-move.clip(upper=0)).rolling(14).mean()
    same(back(features.with_rsi(df), "rsi14"), 100 - 100 / (1 + up / down.replace(0, np.nan)))
    same(back(features.with_averages(df), "ma200"), c.rolling(200).mean())
    same(back(features.with_volatility(df), "rv20"), r.rolling(20).std() * np.sqrt(252))
    dd = c / c.rolling(252, min_periods=60).max() - 1
    same(back(features.with_drawdown(df), "deep_dd_60"), dd.rolling(60).min())
    k = c.pct_change(21)
    same(back(features.with_return_percentile(df, 21, 100, 40), "ret21_pctile"), k.rolling(100, min_periods=40).rank(pct=True))


def test_gaps_in_rolling_and_changes(spark):
    x = [1.0, None, 3.0, 4.0, None, None, 8.0, 8.0]
    days = [dt.date(2024, 1, 1 + i) for i in range(8)]
    df = spark.createDataFrame([("A", d, v) for d, v in zip(days, x)], "symbol string, date date, close double")
    s = pd.Series(x, dtype=float)
    w = ordered()
    out = df.withColumn("m", rolling(F.avg, F.col("close"), w, 3, 2)).withColumn("f", rolling(F.avg, F.col("close"), w, 2)).withColumn("r", change(F.col("close"), w, 1))
    same(back(out, "m"), s.rolling(3, min_periods=2).mean())
    same(back(out, "f"), s.rolling(2).mean())
    same(back(out, "r"), s.ffill().pct_change(fill_method=None))


def test_share_below_counts_null_rows(spark):
    x = [3.0, 1.0, None, 2.0, 5.0, 5.0]
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1 + i), v) for i, v in enumerate(x)], "symbol string, date date, v double")
    got = back(features.with_share_below(df, "v", "s", 4, 2), "s")
    want = pd.Series(x, dtype=float).rolling(4, min_periods=2).apply(lambda a: (a < a[-1]).sum() / len(a), raw=True)
    assert got[4] == 0.5 and got[3] == 0.25 and np.isnan(got[0])
    same(got[3:], want[3:])


def test_sorted_frame_counts_like_a_list():
    rng = np.random.default_rng(5)
    frame, held = frames.SortedFrame(), []
    for x in rng.integers(0, 900, 6000).astype(float):
        frame.add(x)
        held.append(x)
        if len(held) > 2500:
            frame.remove(held.pop(0))
        assert (frame.below(x), frame.upto(x), frame.size) == (sum(v < x for v in held), sum(v <= x for v in held), len(held))
    assert (frame.below(-1.0), frame.upto(1e9)) == (0, 2500)


def test_ranks_of_wide_frames(spark):
    """A frame of 25,000 rows, gaps and ties included; nothing collects a frame."""
    rng = np.random.default_rng(6)
    x = pd.Series(np.round(rng.normal(size=40_000), 2))
    x[rng.random(40_000) < 0.1] = np.nan
    day = pd.date_range("1900-01-01", periods=40_000).date
    rows = spark.createDataFrame([("A", d, None if v != v else float(v)) for d, v in zip(day, x)] + [("B", day[0], 1.0)], "symbol string, date date, v double")
    ranked = frames.with_frame_ranks(rows.repartition(4), "v", 25_000)
    assert "collect_list" not in ranked._jdf.queryExecution().toString()
    got = ranked.where("symbol = 'A'").orderBy("date").toPandas()
    want = x.rolling(25_000, min_periods=1).rank(method="min") - 1
    np.testing.assert_allclose(got["_below"], want)
    np.testing.assert_allclose((got["_below"] + (got["_same"] + 1) / 2), x.rolling(25_000, min_periods=1).rank())
    assert got["_known"].tolist() == x.notna().rolling(25_000, min_periods=1).sum().astype(int).tolist() and got["_rows"].max() == 25_000


def test_correlation_and_beta(spark):
    rng = np.random.default_rng(1)
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=120)]
    wide = pd.DataFrame({s: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120))) for s in "abc"}, index=days)
    wide.iloc[30, 1] = np.nan
    long = wide.reset_index(names="date").melt("date", var_name="sector", value_name="close").dropna()
    got = back(features.pairwise_correlation(spark.createDataFrame(long)), "corr")
    r = wide.ffill().pct_change()
    want = pd.concat([r[x].rolling(60).corr(r[y]) for x, y in ("ab", "ac", "bc")], axis=1).mean(axis=1)
    same(got, want.reset_index(drop=True))
    beta = features.rolling_beta(spark.createDataFrame(long.rename(columns={"sector": "symbol"})), "a")
    rc, ra = wide["c"].pct_change(), wide["a"].pct_change()
    same(back(beta.where("symbol = 'c'"), "beta_60"), (rc.rolling(60).cov(ra) / ra.rolling(60).var()).reset_index(drop=True))
    assert set(back(beta.where("symbol = 'a'"), "beta_60")) == {1.0}


def test_carried_over_partition_edges(spark):
    """Times without a key: many partitions, some without any known value, the same answer as one merge."""
    rng = np.random.default_rng(8)
    stamp = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(k))
    left = pd.DataFrame({"date": [stamp(k) for k in rng.integers(0, 50_000, 9000)]})
    right = pd.DataFrame({"date": [stamp(k) for k in [*rng.integers(100, 4000, 300), *rng.integers(48_000, 49_000, 20)]], "value": rng.normal(size=320)}).drop_duplicates("date")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(x.to_pydatetime(), float(v)) for x, v in zip(right["date"], right["value"])]
        a = spark.createDataFrame([(x.to_pydatetime(),) for x in left["date"]] + [(None,)], "date timestamp").repartition(5)
        b = spark.createDataFrame([*rows, (stamp(60_000), None), (stamp(7), None)], "date timestamp, value double").repartition(5)
        got = as_of(a, b, "value").toPandas().sort_values("date").reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = pd.merge_asof(left.sort_values("date"), right.sort_values("date"), on="date")
    assert len(got) == 9001 and got["date"].isna().sum() == 1 and np.isnan(got["value"][9000])
    np.testing.assert_allclose(got["value"][:9000], want["value"], equal_nan=True)


def test_targets_truncate_at_the_end(px, spark):
    pdf, df = px
    c = pdf["close"]
    want = pd.concat([c.shift(-k) for k in range(1, 22)], axis=1).max(axis=1) / c - 1
    same(back(targets.forward_max(df), "upside_tail"), want)
    same(back(targets.forward_return(df), "fwd_ret"), c.shift(-21) / c - 1)
    vol = spark.createDataFrame(pdf[["date"]].iloc[::3].assign(value=20.0))
    rows = targets.target_panel(df, vol, "A")
    assert rows.where("breach_10 is null or breach_15 is null").count() == 0 and back(rows, "fwd_ret_rel").dropna().eq(0).all()


def test_lag_never_looks_ahead(px):
    pdf, df = px
    got = back(features.lagged(features.returns(df, (1,))), "ret1")
    same(got, pdf["close"].pct_change().shift(1))


def test_calendar_operators(spark):
    d = lambda k: dt.date(2024, 1, k)
    days = spark.createDataFrame([("A", d(k)) for k in (1, 3, 5, 8, 20)], "symbol string, date date")
    vol = spark.createDataFrame([(d(1), 1.0), (d(2), 2.0), (d(5), None), (d(8), 8.0)], "date date, value double")
    assert list(back(on_calendar(days, vol, "value"), "value")) == [1.0, 1.0, 1.0, 8.0, 8.0]
    assert list(back(as_of(days, vol, "value"), "value")) == [1.0, 2.0, 2.0, 8.0, 8.0]
    late = spark.createDataFrame([("A", dt.date(2026, 5, 1)), ("A", dt.date(2023, 5, 1))], "symbol string, date date")
    assert [r.value for r in as_of(late, vol, "value").orderBy("date").collect()] == [None, 8.0]
    keyed = vol.withColumn("symbol", F.lit("A"))
    assert list(back(as_of(days, keyed, "value", keys=("symbol",)), "value")) == [1.0, 2.0, 2.0, 8.0, 8.0]
    ex = spark.createDataFrame([("A", d(3), 0.5), ("A", d(3), 0.25), ("A", d(8), 1.0)], "symbol string, ex_date date, amount double")
    got = next_event(days, ex, "date", "ex_date", "amount").orderBy("date").collect()
    assert [(r.next_day, r.next_amount) for r in got] == [(d(3), 0.75), (d(8), 1.0), (d(8), 1.0), (None, None), (None, None)]
    gaps = day_gaps(days.withColumnRenamed("date", "session")).orderBy("day").collect()
    assert [g.day for g in gaps] == [d(k) for k in range(1, 21)]
    rows = spark.createDataFrame([("A", d(4), 1.0, None), ("A", d(5), None, 2.0), ("A", d(6), 9.0, None), ("A", d(20), 5.0, 5.0)], "symbol string, date date, x double, y double")
    got = resample_last(rows, ["x", "y"], "week_friday").orderBy("label").collect()
    assert [(r.label, r.x, r.y) for r in got] == [(d(5), 1.0, 2.0), (d(12), 9.0, None), (d(19), None, None), (d(26), 5.0, 5.0)]
