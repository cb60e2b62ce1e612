import datetime as dt
import json

import pytest

from millrace.operators import selection
from millrace.sources import market, sinks
from millrace.streaming import online
from pyspark.sql import functions as F


def test_readers(spark, tmp_path):
    root = str(tmp_path)
    w = lambda rows, kinds, path: spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{root}/{path}")
    ts = dt.datetime(2024, 1, 2, 20, 30)
    chain = "ts timestamp, expiration date, strike double, option_type string, bid double, ask double, open_interest double, underlying_price double"
    for ym, t in (("2024-01", ts), ("2024-02", ts + dt.timedelta(31))):
        w([(t, dt.date(2024, 3, 1), 100.0, "C", 1.0, 1.2, None, 99.0), (t, dt.date(2024, 3, 1), 90.0, "C", 0.0, 0.0, 5.0, 99.0)], chain, f"options/spy/chain_{ym}.parquet")
    rows = market.option_chain(spark, root, "SPY")
    got = rows.orderBy("session", "strike").collect()
    assert [(r.ym, r.session, r.dte) for r in got][0] == ("2024-01", dt.date(2024, 1, 2), 59)
    assert got[0].rel_spread == float("inf") and got[1].mid == pytest.approx(1.1)
    assert market.session_chain(rows, "2024-02-02").count() == 2 and market.session_calendar(rows).count() == 2
    assert {r.spot for r in market.session_spot(rows).collect()} == {99.0}
    with pytest.raises(FileNotFoundError):
        market.option_chain(spark, root, "QQQ")
    assert market.dividends(spark, root, "SPY").collect() == []
    w([(dt.date(2024, 1, 1), 0.05)], "date date, rate double", "rates/tbill_4w.parquet")
    assert market.treasury_rates(spark, root).count() == 1
    with pytest.raises(ValueError):
        market.checked_rates(spark.createDataFrame([(5.2,)], "rate double"))
    w([(dt.date(2024, 1, 1), 20.0)], "date date, close double", "prices_long/VXN.parquet")
    w([(dt.date(2024, 1, 1), 21.0, 9.0)], "date date, vix double, close double", "prices_long/VIX.parquet")
    assert [market.vol_series(spark, root, s).count() and market.vol_series(spark, root, s).first().value for s in ("QQQ", "SPY", "XYZ")] == [20.0, 21.0, 0]
    for k, s in enumerate(market.SECTORS):
        w([(dt.date(2024, 1, 1), 1.0 + k)], "date date, adjClose double", f"prices_long/{'sectors/' if k % 2 else ''}{s}.parquet")
    assert market.sector_series(spark, root).count() == 9


def files_read(df):
    """Files that the scans of an executed frame opened."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = plan.collectLeaves()
    scans = [x for x in (leaves.apply(k) for k in range(leaves.size())) if "Scan" in x.getClass().getSimpleName()]
    return sum(x.metrics().apply("numFiles").value() for x in scans)


def test_one_session_opens_one_file_of_each_symbol(spark, tmp_path):
    root = str(tmp_path)
    day = lambda m, d: dt.datetime(2024, m, d, 20, 30)
    chain = "ts timestamp, expiration date, strike double, option_type string, bid double, ask double, open_interest double, underlying_price double"
    for sym in ("spy", "a b"):
        for m in (1, 2, 3):
            rows = [(day(m, d), dt.date(2024, 6, 1), 100.0 + d, "C", 1.0, 1.2, 1.0, 99.0) for d in (2, 3, 31 if m == 1 else 5)]
            spark.createDataFrame(rows, chain).coalesce(1).write.parquet(f"{root}/options/{sym}/chain_2024-{m:02d}.parquet")
    chains = market.option_chains(spark, root)
    assert {(r.symbol, r.ym) for r in chains.select("symbol", "ym").distinct().collect()} == {(s, f"2024-0{m}") for s in ("SPY", "A B") for m in (1, 2, 3)}
    assert (files_read(chains.select("strike")), files_read(chains.where("symbol = 'A B'").select("strike"))) == (6, 3)
    one = market.session_chain(chains, "2024-02-03")
    assert files_read(one.select("symbol", "strike")) == 2 and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in one._jdf.queryExecution().toString()
    assert sorted((r.symbol, r.strike) for r in one.collect()) == [("A B", 103.0), ("SPY", 103.0)]
    # Other months' files are never opened: they may as well be broken.
    for f in (tmp_path / "options" / "spy" / "chain_2024-03.parquet").glob("part-*"):
        f.write_bytes(b"not a Parquet file at all")
    assert market.session_chain(market.option_chains(spark, root, ["SPY"]), "2024-02-03").count() == 1
    # The last evening of a month belongs to that month's file.
    assert market.session_chain(chains, "2024-01-31").count() == 2
    with pytest.raises(FileNotFoundError):
        market.option_chains(spark, root, ["SPY", "QQQ"])


def test_selection_takes_the_liquid_expiry(spark):
    day = dt.date(2024, 1, 2)
    rows = []
    from tests.test_pricing import price

    grid = [(100.0, float(k), d / 365, 0.2, 0.045, 0.013, "C") for d in (10, 45) for k in range(80, 121, 5)]
    for g, p in zip(grid, price(spark, grid)):
        dte = round(g[2] * 365)
        rows.append(("A", day, day + dt.timedelta(dte), dte, g[1], "C", p.p * 0.98, p.p * 1.02, 1000.0, 100.0))
    rows.append(("A", day, day + dt.timedelta(45), 45, 102.0, "C", 2.0, 2.05, 5.0, 100.0))
    chain = spark.createDataFrame(rows, "symbol string, session date, expiration date, dte int, strike double, option_type string, bid double, ask double, open_interest double, spot double")
    (r,) = selection.pick_by_delta(chain, F.lit(0.045), target=0.5, dte_target=45, dte_lo=20, dte_hi=70).collect()
    assert (r.expiration, r.strike) == (day + dt.timedelta(45), 100.0) and abs(r.delta - 0.5) < 0.12


def test_sinks(spark, tmp_path):
    curve = spark.createDataFrame([("A", "s", dt.date(2024, 1, 1 + k), float(k)) for k in range(12)], "symbol string, strategy string, session date, equity double")
    assert [r.equity for r in sinks.strided(curve, ["symbol", "strategy"], "session").orderBy("session").collect()] == [0.0, 5.0, 10.0]
    summary = spark.createDataFrame([("A", "s", None)], "symbol string, strategy string, sortino double")
    sinks.write_json(sinks.bundle(summary, curve, ["symbol", "strategy"]), str(tmp_path / "j"))
    (doc,) = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "j")).collect()]
    assert doc["sortino"] is None and doc["curve"][1] == {"d": "2024-01-06", "v": 5.0}
    sinks.write_summary_csv(summary, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["symbol", "strategy", "sortino"]
    sinks.write_logs(curve.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    sinks.write_logs(curve, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 12
    cells = sinks.nested(spark.createDataFrame([("A", 0.1, 1.0), ("A", 0.2, None)], "symbol string, q double, v double"), ["symbol"], "q", ["v"]).first()
    assert {k: v.v for k, v in cells.cells.items()} == {"0.1": 1.0, "0.2": None}


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(dt.datetime(2024, 1, 1, k % 30 // 10, k % 60), "a" if k % 3 else "b", float(k)) for k in range(200)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double")
    events.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = online.event_buckets(stream).writeStream.format("memory").queryName("buckets").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("buckets").collect())) == sorted(map(tuple, online.event_buckets(events).collect()))
