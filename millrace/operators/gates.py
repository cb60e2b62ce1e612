"""Veto gates: any leg that holds vetoes writing a call; a null signal holds no leg."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.windows import flag

GATE_SCHEMA = "symbol string, rsi double, trend84 double, use_ma200 boolean, ma200_pct double, sector_corr double, absorption double"

# The gates of the three funds; a missing threshold disables its leg.
FUND_GATES = (
    ("SPY", None, 0.0158, False, None, None, 0.0083),
    ("QQQ", None, None, False, 0.0347, None, 0.0100),
    ("IWM", 45.7818, -0.0071, False, None, None, None),
)


def fund_gates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FUND_GATES, GATE_SCHEMA)


def plain_veto(correlated: float | None = None) -> Column:
    """Oversold, falling, under its long average, or, if asked for, sectors too correlated."""
    c = F.col
    legs = [c("rsi14") < 40.0, c("ret84") < 0.0, c("px") < c("ma200")]
    if correlated is not None:
        legs.append(c("sector_corr_60") > correlated)
    return reduce(lambda a, b: a | b, map(flag, legs))


def gated(panel: DataFrame, gates: DataFrame) -> DataFrame:
    """(symbol, date, vetoed) under each symbol's gate; a symbol without one is never vetoed."""
    c = F.col
    rows = panel.join(gates, "symbol", "left")  # a row per symbol: broadcast where its size says so
    legs = [
        c("rsi14") < c("rsi"), c("ret84") < c("trend84"), c("use_ma200") & (c("px") < c("ma200")), F.try_divide("px", "ma200") - 1.0 < c("ma200_pct"),
        c("sector_corr_60") < c("sector_corr"), c("absorption_shift") > c("absorption"),
    ]
    return rows.select("symbol", "date", reduce(lambda a, b: a | b, map(flag, legs)).alias("vetoed"))
