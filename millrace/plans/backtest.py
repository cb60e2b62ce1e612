"""Command line: backtests and the signal study over a folder of market tables.

    python -m millrace.plans.backtest ROOT OUT [--scenario base] [--delta 0.25] [--symbols SPY QQQ IWM] [--start DATE] [--end DATE]
    python -m millrace.plans.backtest ROOT OUT --study
"""

from __future__ import annotations

import argparse
import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.quotes import FEES
from millrace.operators import features, gates, ledger, metrics, selection, study, tape, targets
from millrace.operators.calendar import as_of
from millrace.plans import documents
from millrace.session import session, staged
from millrace.sources import market, sinks

SYMBOLS = ("SPY", "QQQ", "IWM")
STRATEGIES = ("buyhold_drip", "naive_cc_reinvest", "sweep_gated_cc_reinvest")
SINCE = "2005-01-01"


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _series(spark: SparkSession, root: str, symbols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Adjusted closes, and each symbol's own volatility index."""
    px = _all([market.adjusted_series(spark, root, s) for s in symbols])
    vol = _all([market.vol_series(spark, root, s).withColumn("symbol", F.lit(s)) for s in symbols])
    return px, vol


def run_backtests(
    spark: SparkSession, root: str, symbols: tuple[str, ...] = SYMBOLS, scenario: str = "base", delta: float = 0.25, strategies: tuple[str, ...] = STRATEGIES,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """The tagged log of every symbol's and strategy's run, over the sessions from ``start`` to ``end``."""
    chain = market.option_chains(spark, root, symbols).withColumnRenamed("underlying_price", "spot")
    rates = market.treasury_rates(spark, root)
    px, vol = _series(spark, root, symbols)
    panel = features.signal_panel(px, market.sector_series(spark, root), vol, market.eigen_features(spark, root))
    vetoes = gates.gated(panel, gates.fund_gates(spark))
    # Rates are looked up for the sessions, not for every quote.
    rated = chain.join(as_of(chain.select("session").distinct(), rates, "rate", "session", "date"), "session").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    picks = selection.pick_by_delta(rated, F.col("rate"), target=delta)
    closes = _all([market.daily_prices(spark, root, s).select("symbol", "date", "close") for s in symbols])
    paid = _all([market.dividends(spark, root, s) for s in symbols])
    days = tape.session_tape(chain, closes, rates, paid, picks, vetoes)
    runs = spark.createDataFrame([(s, g, scenario) for s in symbols for g in strategies], "symbol string, strategy string, scenario string")
    return ledger.run_ledgers(days, runs, start=start, end=end)


def run_study(spark: SparkSession, root: str, symbols: tuple[str, ...] = SYMBOLS) -> dict[str, DataFrame]:
    """Rank correlations, breach rates, the forest and the sweep, each a row per cell, and the two documents made of them."""
    px, vol = _series(spark, root, symbols)
    panel = features.research_panel(px, market.sector_series(spark, root), vol, market.eigen_features(spark, root), symbols[0])
    goals = staged(study.weekly(targets.target_panel(px, vol, symbols[0]), SINCE), "goals")
    signals = staged(study.weekly(panel, SINCE), "signals")
    parts = documents.study_parts(signals, goals, symbols[0])
    return parts | {"research": documents.research(parts, SINCE), "threshold_sweep": documents.threshold_sweep(parts)}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--scenario", default="base", choices=sorted(FEES))
    p.add_argument("--delta", type=float, default=0.25)
    p.add_argument("--symbols", nargs="+", default=list(SYMBOLS))
    p.add_argument("--start", type=dt.date.fromisoformat)
    p.add_argument("--end", type=dt.date.fromisoformat)
    p.add_argument("--study", action="store_true")
    a = p.parse_args(argv)
    spark = session("backtest")
    if a.study:
        for name, rows in run_study(spark, a.root, tuple(a.symbols)).items():
            sinks.write_json(rows, f"{a.out}/{name}")
        return
    keys = list(ledger.RUN)
    log = staged(run_backtests(spark, a.root, tuple(a.symbols), a.scenario, a.delta, start=a.start, end=a.end), "log")
    for name, rows in (("equity", ledger.equity_log(log)), ("trades", ledger.trade_log(log)), ("events", ledger.event_log(log))):
        sinks.write_logs(rows, f"{a.out}/{name}")
    equity = ledger.equity_log(log)
    summary = metrics.equity_metrics(equity, keys, market.treasury_rates(spark, a.root)).join(ledger.run_counters(log), keys)
    sinks.write_summary_csv(summary, f"{a.out}/summary")
    trades = metrics.trade_metrics(ledger.trade_log(log), keys)
    yearly = sinks.nested(metrics.yearly_returns(equity, keys), keys, "year", ["ret"]).withColumnRenamed("cells", "yearly")
    sinks.write_json(sinks.bundle(summary.join(trades, keys, "left").join(yearly, keys), equity, keys), f"{a.out}/bundle")


if __name__ == "__main__":
    main()
