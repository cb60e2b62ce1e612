"""The ledger queries over whole tables."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.plans.registry import QUERIES, SQL
from millrace.sources import synthetic as S
from tools.compare import connect

SF = "/root/testdata/sf0.001"


def test_ledgers_run_over_all_sessions(spark):
    if not os.path.isdir(SF):
        pytest.skip("the benchmark tables are not here")
    days = {(r.symbol, r.date) for r in S.prices(spark, SF).select("symbol", "date").collect()}
    equity = QUERIES["ledger_equity"](spark, SF).cache()
    runs = equity.select("symbol", "strategy", "scenario").distinct().count()
    assert equity.count() == runs * len(days) // 5
    plain = equity.where("strategy = 'buyhold_drip' and scenario = 'base'").select("symbol", "session", F.round("equity", 2).alias("equity")).collect()
    assert {(r.symbol, r.session) for r in plain} == days
    whole = SQL["drip_fold"]
    want = {(x, y): z for x, y, z in connect(SF).sql(f"SELECT symbol, session, equity FROM ({whole})").fetchall()}
    assert set(want) == days and all(abs(want[r.symbol, r.session] - r.equity) < 0.011 for r in plain)
    late = {s: sorted(d for x, d in days if x == s)[120] for s in {x for x, _ in days}}
    trades = QUERIES["ledger_trades"](spark, SF).collect()
    assert any(r.open_session >= late[r.symbol] for r in trades)
