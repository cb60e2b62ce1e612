"""Quotes: validity, fills by scenario, fees, liquidity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fee per contract and side, by scenario.
FEES = {"optimistic": 0.70, "base": 0.70, "conservative": 1.00, "stress": 2.00}
# How much of the half spread a fill gives up, and what it pays beyond the quote.
HALF_SPREADS = {"optimistic": 0.0, "base": 0.5}
BEYOND = {"conservative": 0.01, "stress": 0.03}
LEAST_FILL = 0.01

MAX_REL_SPREAD = 0.10
MIN_OPEN_INTEREST = 100


def quote_ok(bid: Column, ask: Column, sell: bool, bid_size: Column | None = None, ask_size: Column | None = None) -> Column:
    """A usable quote: not crossed, an ask, and something on the side that is hit."""
    ok = (ask > 0) & (bid <= ask)
    size = bid_size if sell else ask_size
    if sell:
        ok &= bid > 0
    return F.coalesce(ok if size is None else ok & (size > 0), F.lit(False))


def fill_price(side: str, bid: Column, ask: Column, scenario: Column) -> Column:
    """The price of a fill; null for a crossed quote, one without an ask, or an unknown scenario."""
    toward = 1.0 if side == "buy" else -1.0
    mid, half = (bid + ask) / 2.0, (ask - bid) / 2.0
    price = F.lit(None).cast("double")
    for name, share in HALF_SPREADS.items():
        price = F.when(scenario == name, mid + toward * share * half).otherwise(price)
    for name, more in BEYOND.items():
        price = F.when(scenario == name, (ask if side == "buy" else bid) + toward * more).otherwise(price)
    floor = F.lit(LEAST_FILL if side == "buy" else 0.0)
    return F.when((ask > 0) & (bid <= ask) & price.isNotNull(), F.greatest(price, floor))


def fee(scenario: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FEES.items() for x in kv]), scenario)


def execute(side: str, bid: Column, ask: Column, contracts: Column, scenario: Column) -> Column:
    return F.struct(fill_price(side, bid, ask, scenario).alias("price"), (fee(scenario) * contracts).alias("fee"))


def per_contract_cost(price: Column) -> Column:
    return price * 100.0


def rel_spread(bid: Column, ask: Column) -> Column:
    mid = (bid + ask) / 2.0
    return F.when(mid > 0, (ask - bid) / mid).otherwise(F.lit(float("inf")))


def eligible(option_type: str, dte_lo: int, dte_hi: int, sell: bool) -> Column:
    """Liquid quotes of a type within a range of days to expiry."""
    c = F.col
    ok = (c("option_type") == option_type) & c("dte").between(dte_lo, dte_hi) & (c("ask") > 0) & (c("bid") <= c("ask"))
    ok &= (rel_spread(c("bid"), c("ask")) <= MAX_REL_SPREAD) & (F.coalesce("open_interest", F.lit(0.0)) >= MIN_OPEN_INTEREST)
    return ok & (c("bid") > 0) if sell else ok


def fill(side: str, bid: float, ask: float, scenario: str) -> float:
    """``fill_price`` for one quote in plain Python, as the ledger needs it; errors where that is null."""
    if side not in ("buy", "sell") or scenario not in FEES:
        raise ValueError((side, scenario))
    if bid > ask or ask <= 0:
        raise ValueError(f"unusable quote {bid} / {ask}")
    toward = 1 if side == "buy" else -1
    if scenario in HALF_SPREADS:
        price = (bid + ask) / 2 + toward * HALF_SPREADS[scenario] * (ask - bid) / 2
    else:
        price = (ask if side == "buy" else bid) + toward * BEYOND[scenario]
    return max(price, LEAST_FILL if side == "buy" else 0.0)


def usable(bid: float, ask: float, sell: bool) -> bool:
    return ask > 0 and bid <= ask and (not sell or bid > 0)
