import json

import pytest
from pyspark.sql import functions as F

from millrace.plans import backtest
from millrace.sources import market
from millrace.sources import synthetic as S

SF = "/root/testdata/sf0.001"


def test_command_line_end_to_end(spark, tmp_path):
    import os

    if not os.path.isdir(SF):
        pytest.skip("the benchmark tables are not here")
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    one = "1-URGENT"
    write = lambda df, path: df.coalesce(1).write.parquet(f"{root}/{path}")
    chain = S.chain(spark, SF).where(F.col("symbol") == one).cache()
    ts = F.to_utc_timestamp((F.col("session").cast("timestamp") + F.expr("interval 15 hours 30 minutes")), market.ZONE)
    rows = chain.select(ts.alias("ts"), "expiration", "strike", "option_type", "bid", "ask", "open_interest", F.col("spot").alias("underlying_price"), F.date_format("session", "yyyy-MM").alias("ym"))
    for ym in [r.ym for r in rows.select("ym").distinct().collect()]:
        write(rows.where(F.col("ym") == ym).drop("ym"), f"options/spy/chain_{ym}.parquet")
    px = S.prices(spark, SF).where(F.col("symbol") == one)
    write(px.select("date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close", "adjClose")]), "prices_long/SPY.parquet")
    write(S.dividends(spark, SF).where(F.col("symbol") == one).select("ex_date", "amount"), "prices_long/SPY_dividends.parquet")
    write(S.rates(spark, SF), "rates/tbill_4w.parquet")
    write(S.vol_index(spark, SF).select("date", F.col("value").alias("vix")), "prices_long/VIX.parquet")
    write(S.eigen(spark, SF), "prices_long/eigen_features_long.parquet")
    sectors = S.sectors(spark, SF).cache()
    names = [r.sector for r in sectors.select("sector").distinct().collect()]
    for k, s in enumerate(market.SECTORS):
        write(sectors.where(F.col("sector") == names[k % len(names)]).select("date", F.col("close").alias("adjClose")), f"prices_long/sectors/{s}.parquet")
    log = backtest.run_backtests(spark, root, ("SPY",)).cache()
    days = sorted(r.session for r in chain.select("session").distinct().collect())
    assert log.where("log = 'equity'").count() == 3 * len(days) and log.where("event = 'dividend'").count() > 0 and log.where("tag = 'cc_write'").count() > 0
    part = backtest.run_backtests(spark, root, ("SPY",), strategies=("buyhold",), start=days[10], end=days[40])
    rows = part.where("log = 'equity'").orderBy("session").collect()
    assert [r.session for r in rows] == days[10:41] and rows[0].shares == 200
    backtest.main([root, out, "--symbols", "SPY", "--scenario", "base"])
    docs = [json.loads(x.value) for x in spark.read.text(out + "/bundle").collect()]
    assert {d["strategy"] for d in docs} == set(backtest.STRATEGIES) and all(len(d["curve"]) == -(-len(days) // 5) for d in docs)
    assert spark.read.option("header", True).csv(out + "/summary").count() == 3
