"""Labels: what happened in the month after each day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.windows import ordered
from millrace.operators.calendar import on_calendar

HORIZON = 21
MULTIPLES = (1.0, 1.2, 1.5)


def breach(m: float) -> str:
    return f"breach_{int(m * 10)}"


def forward_return(px: DataFrame, n: int = HORIZON) -> DataFrame:
    return px.select("symbol", "date", (F.lead("close", n).over(ordered()) / F.col("close") - 1.0).alias("fwd_ret"))


def forward_max(px: DataFrame, n: int = HORIZON) -> DataFrame:
    """Best close of the next n rows against today's; near the end, of the rows there are."""
    return px.select("symbol", "date", (F.max("close").over(ordered().rowsBetween(1, n)) / F.col("close") - 1.0).alias("upside_tail"))


def target_panel(px: DataFrame, vol: DataFrame, market: str, n: int = HORIZON) -> DataFrame:
    """Forward return (also against the market's), upside, return in sigmas, and breaches.

    A breach is 0 where there's no volatility or nothing ahead, never null.
    """
    c = F.col("close")
    rows = on_calendar(px, vol, "value")
    rows = rows.select(
        "symbol",
        "date",
        (F.lead(c, n).over(ordered()) / c - 1.0).alias("fwd_ret"),
        (F.max(c).over(ordered().rowsBetween(1, n)) / c - 1.0).alias("upside_tail"),
        (F.col("value") / 100.0 * F.sqrt(F.lit(n / 252.0))).alias("sigma"),
    )
    base = rows.where(F.col("symbol") == market).select("date", F.col("fwd_ret").alias("_m"))
    rows = rows.join(base, "date", "left")
    return rows.select(
        "symbol",
        "date",
        "fwd_ret",
        (F.col("fwd_ret") - F.col("_m")).alias("fwd_ret_rel"),
        "upside_tail",
        F.try_divide("fwd_ret", "sigma").alias("vol_norm_ret"),
        *[F.when(F.col("upside_tail") > F.col("sigma") * m, 1.0).otherwise(0.0).alias(breach(m)) for m in MULTIPLES],
    )
