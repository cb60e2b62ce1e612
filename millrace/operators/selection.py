"""Choosing contracts from option chains, for all sessions at once.

Cheap predicates and the choice of one expiry come first, so that volatilities are
solved for a small part of the quotes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.pricing import bs_greeks, with_implied_vol
from millrace.functions.quotes import eligible
from millrace.functions.windows import computed

CARRY = 0.013
STRIKES = (0.75, 1.18)
LEAST_MID = 0.05
VOL_BOUNDS = (0.005, 5.0)
DELTA_TOLERANCE = 0.12

SESSION = ("symbol", "session")


def nearest_expiry(quotes: DataFrame, target: int) -> DataFrame:
    """Each session's quotes of the expiry nearest to ``target`` days; of two as near, the earlier."""
    w = Window.partitionBy(*SESSION).orderBy(F.abs(F.col("dte") - target), "expiration")
    return quotes.withColumn("_k", F.dense_rank().over(w)).where("_k = 1").drop("_k")


def in_strike_window(quotes: DataFrame) -> DataFrame:
    mid = (F.col("bid") + F.col("ask")) / 2.0
    return quotes.where(F.col("strike").between(F.col("spot") * STRIKES[0], F.col("spot") * STRIKES[1]) & (mid >= LEAST_MID))


def with_delta(quotes: DataFrame, rate: Column) -> DataFrame:
    """Add mid, iv and delta; rows without a usable volatility go."""
    t, q, call = F.col("dte") / F.lit(365.0), F.lit(CARRY), F.col("option_type") == "C"
    rows = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2.0)
    rows = with_implied_vol(rows, "iv", F.col("mid"), F.col("spot"), F.col("strike"), t, rate, q, call)
    rows = rows.where((F.col("iv") > VOL_BOUNDS[0]) & (F.col("iv") < VOL_BOUNDS[1]))
    return computed(rows, delta=bs_greeks(F.col("spot"), F.col("strike"), t, F.col("iv"), rate, q, call)["delta"])


def _first(rows: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy(*SESSION).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def pick_by_delta(
    chain: DataFrame, rate: Column, option_type: str = "C", target: float = 0.25, dte_target: int = 35, dte_lo: int = 25, dte_hi: int = 45, sell: bool = True
) -> DataFrame:
    """The contract of each session whose delta is nearest to the target, if near enough."""
    pool = nearest_expiry(chain.where(eligible(option_type, dte_lo, dte_hi, sell)), dte_target)
    rows = with_delta(in_strike_window(pool), rate)
    off = F.abs(F.abs("delta") - abs(target))
    return _first(rows.withColumn("delta_error", off), F.col("delta_error"), F.col("strike")).where(F.col("delta_error") <= DELTA_TOLERANCE)


def pick_affordable_call(
    chain: DataFrame, rate: Column, budget: float, fee: float, delta_lo: float, delta_hi: float, dte_target: int, dte_lo: int, dte_hi: int
) -> DataFrame:
    """The highest-delta call within a range of deltas that the budget buys."""
    pool = nearest_expiry(chain.where(eligible("C", dte_lo, dte_hi, False)), dte_target)
    rows = with_delta(in_strike_window(pool), rate)
    rows = rows.where(F.col("delta").between(delta_lo - 1e-9, delta_hi + 1e-9) & (F.col("ask") * 100.0 + fee <= budget))
    return _first(rows, F.desc("delta"), F.col("strike"))


def lookup(wanted: DataFrame, chain: DataFrame) -> DataFrame:
    """Each wanted (symbol, session, expiration, strike, option_type)'s quote, null without one."""
    on = ["symbol", "session", "expiration", "strike", "option_type"]
    w = Window.partitionBy(*on).orderBy("bid", "ask", "open_interest")
    one = chain.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return wanted.join(one.select(*on, "bid", "ask", ((F.col("bid") + F.col("ask")) / 2.0).alias("mid"), "dte", "open_interest"), on, "left")


def held_quotes(held: DataFrame, chain: DataFrame) -> DataFrame:
    """Quotes of held contracts (symbol, opened, expiration, strike, option_type) over the sessions of their lives.

    A contract's openings and quotes are one stream in the order of time, an opening
    before the quotes of its session, and every quote meets the positions that are open
    by then: the rows that come out are all that is made.
    """
    on = ["symbol", "expiration", "strike", "option_type"]
    opens = held.select(*on, F.col("opened").alias("session"), F.lit(0).alias("_side"), "opened", F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"))
    # Quotes of contracts that are never held need not be sorted; a large table of them is dealt out by contract here already.
    chain = chain.where("session <= expiration").join(held.select(*on).distinct(), on, "left_semi")
    quotes = chain.select(*on, "session", F.lit(1).alias("_side"), F.lit(None).cast(held.schema["opened"].dataType).alias("opened"), "bid", "ask")
    w = Window.partitionBy(*on).orderBy("session", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = opens.unionByName(quotes).withColumn("_open", F.collect_list("opened").over(w)).where("_side = 1")
    return rows.select(*on, F.explode("_open").alias("opened"), "session", "bid", "ask")
