"""Metrics of equity curves and trade logs, per run.

Inputs carry their run in ``keys`` columns; every metric of every run is one pass of
window and grouped aggregates. Figures are unrounded; sinks round for display.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.windows import sunday
from millrace.operators.calendar import as_of

Keys = list[str]
YEAR_DAYS, TRADING = 365.25, 252.0


def daily_returns(equity: DataFrame, keys: Keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("session")
    return equity.withColumn("ret", F.col("equity") / F.lag("equity").over(w) - 1.0)


def drawdowns(equity: DataFrame, keys: Keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("peak", F.max("equity").over(w)).withColumn("dd", F.col("equity") / F.col("peak") - 1.0)


def longest_drawdown(equity: DataFrame, keys: Keys) -> DataFrame:
    """Longest run of sessions below the running peak: islands between the peaks."""
    rows = drawdowns(equity, keys)
    w = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    under = F.col("equity") < F.col("peak")
    rows = rows.withColumn("under", under).withColumn("island", F.sum(F.when(under, 0).otherwise(1)).over(w))
    runs = rows.groupBy(*keys, "island").agg(F.count_if("under").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest_dd_sessions"))


def worst_period(equity: DataFrame, keys: Keys, label: str) -> DataFrame:
    """Worst change between the last marks of successive weeks (to Sunday) or months; null for one period."""
    bin = {"week": sunday, "month": F.last_day}[label](F.col("session"))
    ends = equity.groupBy(*keys, bin.alias("bin")).agg(F.max_by("equity", "session").alias("v"))
    w = Window.partitionBy(*keys).orderBy("bin")
    # A week without sessions repeats the mark before it, which changes no minimum below zero.
    return ends.withColumn("r", F.col("v") / F.lag("v").over(w) - 1.0).groupBy(*keys).agg(F.min("r").alias(f"worst_{label}"))


def equity_metrics(equity: DataFrame, keys: Keys, rates: DataFrame | None = None) -> DataFrame:
    rets = daily_returns(equity, keys)
    if rates is not None:
        rets = as_of(rets, rates, "rate", "session", "date")
    else:
        rets = rets.withColumn("rate", F.lit(0.0))
    base = rets.groupBy(*keys).agg(
        F.min("session").alias("start"), F.max("session").alias("end"), F.count("*").alias("sessions"), F.max_by("equity", "session").alias("final_equity"),
        F.min_by("equity", "session").alias("_first"), F.stddev_samp("ret").alias("_sd"), F.avg("ret").alias("_mean"),
        F.coalesce(F.avg(F.when(F.col("ret").isNotNull(), F.col("rate"))), F.lit(0.0)).alias("_rf"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("_down"),
        F.min("ret").alias("worst_day"),
    )
    out = base.join(drawdowns(equity, keys).groupBy(*keys).agg(F.min("dd").alias("max_drawdown")), keys)
    for part in (longest_drawdown(equity, keys), worst_period(equity, keys, "week"), worst_period(equity, keys, "month")):
        out = out.join(part, keys)
    c = F.col
    years = F.greatest(F.datediff("end", "start") / YEAR_DAYS, F.lit(1e-9))
    cagr = F.pow(c("final_equity") / c("_first"), F.lit(1.0) / years) - 1.0
    excess = (c("_mean") - c("_rf") / TRADING) * F.sqrt(F.lit(TRADING))
    out = out.withColumn("cagr", cagr)
    return out.select(
        *keys, "start", "end", "sessions", "final_equity", (c("final_equity") / c("_first") - 1.0).alias("total_return"), "cagr",
        (c("_sd") * F.sqrt(F.lit(TRADING))).alias("ann_vol"), F.when(c("_sd") > 0, excess / c("_sd")).otherwise(0.0).alias("sharpe"),
        F.when(c("_down") > 0, excess / c("_down")).alias("sortino"), "max_drawdown", F.when(c("max_drawdown") < 0, c("cagr") / F.abs("max_drawdown")).alias("calmar"),
        "longest_dd_sessions", F.coalesce("worst_day", F.lit(0.0)).alias("worst_day"), F.coalesce("worst_week", F.lit(0.0)).alias("worst_week"),
        F.coalesce("worst_month", F.lit(0.0)).alias("worst_month"),
    )


def yearly_returns(equity: DataFrame, keys: Keys) -> DataFrame:
    """Change between years' last marks; the first year against the first mark."""
    ends = equity.groupBy(*keys, F.year("session").alias("year")).agg(F.max_by("equity", "session").alias("v"), F.min_by("equity", "session").alias("f"))
    prev = F.lag("v").over(Window.partitionBy(*keys).orderBy("year"))
    return ends.select(*keys, "year", (F.col("v") / F.coalesce(prev, F.col("f")) - 1.0).alias("ret"))


def trade_metrics(trades: DataFrame, keys: Keys) -> DataFrame:
    """Statistics of closed trades; the profit factor is null where no trade lost."""
    c, win = F.col, F.col("pnl") > 0
    days = F.datediff("close_session", "open_session")
    out = trades.where("pnl is not null").groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.avg(F.when(win, 1.0).otherwise(0.0)).alias("win_rate"), F.coalesce(F.avg(F.when(win, c("pnl"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(~win, c("pnl"))), F.lit(0.0)).alias("avg_loss"), F.sum(F.when(win, c("pnl")).otherwise(0.0)).alias("_w"),
        F.sum(F.when(~win, c("pnl")).otherwise(0.0)).alias("_l"), F.avg("pnl").alias("ev_per_trade"), F.sum("pnl").alias("total_pnl"), F.min("pnl").alias("worst_trade"),
        F.max("pnl").alias("best_trade"), F.median(days).alias("median_holding_days"),
    )
    return out.withColumn("profit_factor", F.try_divide("_w", F.nullif(F.abs("_l"), F.lit(0.0)))).drop("_w", "_l")


def capital_utilization(equity: DataFrame, keys: Keys) -> DataFrame:
    used = (F.col("equity") - (F.col("cash") - F.col("reserved"))) / F.col("equity")
    return equity.groupBy(*keys).agg(F.avg(used).alias("utilization"))


def drawdown_brake(equity: DataFrame, keys: Keys, n: int = 252) -> DataFrame:
    """1, 0.5 or 0 by how far yesterday's mark lay under the highest of the n marks before today."""
    w = Window.partitionBy(*keys).orderBy("session")
    high, last = F.max("equity").over(w.rowsBetween(-n, -1)), F.lag("equity").over(w)
    return equity.withColumn("brake", F.when(last < high * 0.75, 0.0).when(last < high * 0.85, 0.5).otherwise(1.0))


