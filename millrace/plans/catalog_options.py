"""Registered queries of option pricing, quotes, selection, ledgers and metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import pricing, quotes
from millrace.operators import gates, ledger, metrics, selection, tape
from millrace.plans.catalog import LAGGED, PANEL_TABLES, query, r, rounded, traded
from millrace.plans.oracle_base import ncdf, with_tables
from millrace.sources import market, sinks, synthetic as S
from millrace.sources.synthetic import CARRY, RATE
from millrace.session import staged
from millrace.streaming import online

ID = "symbol, session, dte, strike, option_type"
IDS = ["symbol", "session", "dte", "strike", "option_type"]
MID = "(bid + ask) / 2e0"
REL = f"CASE WHEN {MID} > 0 THEN (ask - bid) / ({MID}) END"


@query("chain_derive", with_tables("chain") + f"SELECT {ID}, expiration, {r(MID, 'mid')}, {r(REL, 'rel_spread')} FROM chain")
def chain_derive(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots late in the exchange's evening, the next day in universal time, and what the reader derives from them."""
    late = F.to_utc_timestamp(F.col("session").cast("timestamp") + F.expr("interval 21 hours 30 minutes"), market.ZONE)
    rows = market.derive_chain(S.chain(spark, d).withColumn("ts", late).drop("session", "dte"))
    return rounded(rows.select(*IDS, "expiration", "mid", F.when(F.col("mid") > 0, F.col("rel_spread")).alias("rel_spread")))


ELIGIBLE = f"option_type = 'C' AND dte BETWEEN 25 AND 45 AND ask > 0 AND bid <= ask AND ({REL}) <= 1e-1 AND coalesce(open_interest, 0) >= 100 AND bid > 0"


@query("eligible_quotes", with_tables("chain") + f"SELECT {ID}, {r('bid', 'bid')}, {r('ask', 'ask')}, CAST(open_interest AS BIGINT) AS open_interest FROM chain WHERE {ELIGIBLE}")
def eligible_quotes(spark: SparkSession, d: str) -> DataFrame:
    rows = S.chain(spark, d).where(quotes.eligible("C", 25, 45, True))
    return rounded(rows.select(*IDS, "bid", "ask", F.col("open_interest").cast("long").alias("open_interest")))


@query("quote_validity", with_tables("chain") + f"SELECT {ID}, (ask > 0 AND bid <= ask AND bid > 0) AS can_sell, (ask > 0 AND bid <= ask) AS can_buy FROM chain")
def quote_validity(spark: SparkSession, d: str) -> DataFrame:
    ok = lambda sell: quotes.quote_ok(F.col("bid"), F.col("ask"), sell)
    return rounded(S.chain(spark, d).select(*IDS, ok(True).alias("can_sell"), ok(False).alias("can_buy")))


# What each scenario's fill does to a buyer and to a seller, of two contracts.
FILLS = {
    "optimistic": (MID, MID, "1.4e0"),
    "base": (f"{MID} + (ask - bid) / 4e0", f"{MID} - (ask - bid) / 4e0", "1.4e0"),
    "conservative": ("ask + 1e-2", "bid - 1e-2", "2e0"),
    "stress": ("ask + 3e-2", "bid - 3e-2", "4e0"),
}


@query("fill_price_scenarios", with_tables("chain") + f"SELECT {ID}, " + ", ".join(
    f"{r(f'greatest({b}, 1e-2)', f'buy_{k}', 4)}, {r(f'greatest({s}, 0e0)', f'sell_{k}', 4)}, {r(f, f'fee_{k}', 4)}" for k, (b, s, f) in FILLS.items()
) + " FROM chain WHERE ask > 0 AND bid <= ask")
def fill_price_scenarios(spark: SparkSession, d: str) -> DataFrame:
    two = lambda side, k: quotes.execute(side, F.col("bid"), F.col("ask"), F.lit(2), F.lit(k))
    columns = [x for k in quotes.FEES for x in (two("buy", k)["price"].alias(f"buy_{k}"), two("sell", k)["price"].alias(f"sell_{k}"), two("buy", k)["fee"].alias(f"fee_{k}"))]
    return rounded(S.chain(spark, d).where("ask > 0 and bid <= ask").select(*IDS, *columns), 4)


POOL = {"el": f"SELECT * FROM chain WHERE {ELIGIBLE}", "pool": "SELECT * EXCLUDE (k) FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol, session ORDER BY abs(dte - 35), expiration) AS k FROM el) WHERE k = 1"}


@query("nearest_expiry_pool", with_tables("chain", extra=POOL) + "SELECT symbol, session, min(expiration) AS expiration, count(*) AS n FROM pool GROUP BY 1, 2")
def nearest_expiry_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = selection.nearest_expiry(S.chain(spark, d).where(quotes.eligible("C", 25, 45, True)), 35)
    return pool.groupBy("symbol", "session").agg(F.min("expiration").alias("expiration"), F.count("*").alias("n"))


def _args(rows: DataFrame) -> tuple:
    return F.col("spot"), F.col("strike"), F.col("dte") / F.lit(365.0), F.lit(0.2), F.lit(RATE), F.lit(CARRY), F.col("option_type") == "C"


BS = {
    "b0": "SELECT *, dte / 3.65e2 AS t, CASE WHEN option_type = 'C' THEN 1e0 ELSE -1e0 END AS sg FROM chain",
    "b1": "SELECT *, (ln(spot * exp((3e-2 - 1.3e-2) * t) / strike) + 2e-1 * 2e-1 * t / 2e0) / (2e-1 * sqrt(t)) AS d1 FROM b0",
    "b2": "SELECT *, sg * d1 AS x1, sg * (d1 - 2e-1 * sqrt(t)) AS x2, exp(-d1 * d1 / 2e0) / 2.5066282746310002e0 AS pdf FROM b1",
    "b3": f"SELECT *, {ncdf('x1')} AS n1, {ncdf('x2')} AS n2 FROM b2",
}


@query("black_scholes_price", with_tables("chain", extra=BS) + f"SELECT {ID}, {r('exp(-3e-2 * t) * sg * (spot * exp((3e-2 - 1.3e-2) * t) * n1 - strike * n2)', 'price', 4)} FROM b3")
def black_scholes_price(spark: SparkSession, d: str) -> DataFrame:
    rows = S.chain(spark, d)
    return rounded(rows.select(*IDS, pricing.bs_price(*_args(rows)).alias("price")), 4)


@query("bs_greeks", with_tables("chain", extra=BS) + f"""SELECT {ID}, {r('sg * exp(-1.3e-2 * t) * n1', 'delta')}, {r('exp(-1.3e-2 * t) * pdf / (spot * 2e-1 * sqrt(t))', 'gamma')}, {r('spot * exp(-1.3e-2 * t) * pdf * sqrt(t)', 'vega')},
{r('-spot * exp(-1.3e-2 * t) * pdf * 2e-1 / (2e0 * sqrt(t)) - sg * 3e-2 * strike * exp(-3e-2 * t) * n2 + sg * 1.3e-2 * spot * exp(-1.3e-2 * t) * n1', 'theta')}, {r('sg * strike * t * exp(-3e-2 * t) * n2', 'rho')} FROM b3""")
def bs_greeks(spark: SparkSession, d: str) -> DataFrame:
    rows = S.chain(spark, d)
    return rounded(rows.select(*IDS, pricing.bs_greeks(*_args(rows)).alias("g")).select(*IDS, "g.*"))


COST = {"sized": f"""SELECT *, ask * 1e2 AS cost, (-spot * exp(-1.3e-2 * t) * pdf * 2e-1 / (2e0 * sqrt(t)) - sg * 3e-2 * strike * exp(-3e-2 * t) * n2 + sg * 1.3e-2 * spot * exp(-1.3e-2 * t) * n1) / 3.65e2 AS theta FROM b3"""}


@query("contract_cost", with_tables("chain", extra=BS | COST) + f"""SELECT {ID}, {r('cost', 'cost', 4)}, {r('theta', 'theta_per_day')},
coalesce(ask > 0 AND bid <= ask AND bid > 0 AND open_interest > 0, false) AS sellable, coalesce(ask > 0 AND bid <= ask AND open_interest > 0, false) AS buyable FROM sized""")
def contract_cost(spark: SparkSession, d: str) -> DataFrame:
    """What a contract costs, what it loses a day, and whether its quote stands with the open interest as its sizes."""
    size = F.col("open_interest")
    ok = [quotes.quote_ok(F.col("bid"), F.col("ask"), sell, size, size).alias(k) for k, sell in (("sellable", True), ("buyable", False))]
    rows = S.chain(spark, d)
    theta = pricing.per_day_theta(pricing.bs_greeks(*_args(rows))["theta"])
    return rounded(rows.select(*IDS, F.round(quotes.per_contract_cost(F.col("ask")), 4).alias("cost"), theta.alias("theta_per_day"), *ok))


BOUNDS = {"bd": "SELECT *, exp(-3e-2 * dte / 3.65e2) AS df, spot * exp((3e-2 - 1.3e-2) * dte / 3.65e2) AS fwd FROM chain"}


@query("no_arb_bounds", with_tables("chain", extra=BOUNDS) + f"""SELECT {ID}, {r("greatest(CASE WHEN option_type = 'C' THEN df * (fwd - strike) ELSE df * (strike - fwd) END, 0e0)", 'low')},
{r("CASE WHEN option_type = 'C' THEN df * fwd ELSE df * strike END", 'high')} FROM bd""")
def no_arb_bounds(spark: SparkSession, d: str) -> DataFrame:
    spot, strike, t, _, rate, q, call = _args(None)
    return rounded(S.chain(spark, d).select(*IDS, pricing.no_arb_bounds(spot, strike, t, rate, q, call).alias("b")).select(*IDS, "b.*"))


def bisected() -> str:
    """The solver's fifty halvings as nested queries: the volatility in [1e-4, 5] whose price is the quotes' mid."""
    keep = f"{ID}, price, strike AS k, t, sg, fwd, df"
    rows = f"SELECT {ID}, {MID} AS price, dte / 3.65e2 AS t, CASE WHEN option_type = 'C' THEN 1e0 ELSE -1e0 END AS sg, spot * exp((3e-2 - 1.3e-2) * dte / 3.65e2) AS fwd, exp(-3e-2 * dte / 3.65e2) AS df FROM chain"
    rows = f"SELECT {keep}, 1e-4 AS a, 5e0 AS b FROM ({rows})"
    held = f"{ID}, price, k, t, sg, fwd, df"
    for _ in range(50):
        tried = f"SELECT *, (ln(fwd / k) + m * m * t / 2e0) / (m * sqrt(t)) AS d1 FROM (SELECT *, (a + b) / 2e0 AS m FROM ({rows}))"
        valued = f"SELECT *, df * sg * (fwd * ({ncdf('x1')}) - k * ({ncdf('x2')})) > price AS over FROM (SELECT *, sg * d1 AS x1, sg * (d1 - m * sqrt(t)) AS x2 FROM ({tried}))"
        rows = f"SELECT {held}, CASE WHEN over THEN a ELSE m END AS a, CASE WHEN over THEN m ELSE b END AS b FROM ({valued})"
    return rows


@query("implied_vol", with_tables("chain") + f"SELECT {ID}, round((a + b) / 2e0, 4) + 0e0 AS iv FROM ({bisected()})")
def implied_vol(spark: SparkSession, d: str) -> DataFrame:
    spot, strike, t, _, rate, q, call = _args(None)
    mid = (F.col("bid") + F.col("ask")) / 2.0
    return rounded(pricing.with_implied_vol(S.chain(spark, d), "iv", mid, spot, strike, t, rate, q, call).select(*IDS, "iv"), 4)


def picks(spark: SparkSession, d: str) -> DataFrame:
    return selection.pick_by_delta(S.chain(spark, d), F.lit(RATE))


PICK = {
    "cand": f"SELECT c3.*, c.expiration, c.bid, c.ask FROM chain3 c3 JOIN pool c ON c.symbol = c3.symbol AND c.session = c3.session AND c.dte = c3.dte AND c.strike = c3.strike AND c.option_type = c3.option_type WHERE c.strike BETWEEN 7.5e-1 * c.spot AND 1.18e0 * c.spot AND {MID.replace('bid', 'c.bid').replace('ask', 'c.ask')} >= 5e-2",
    "dl": f"SELECT *, exp(-1.3e-2 * t) * sg * ({ncdf('x1')}) AS delta FROM cand",
    "pk": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY round(abs(abs(delta) - 2.5e-1), 9), strike) AS k FROM dl) WHERE k = 1 AND abs(abs(delta) - 2.5e-1) <= 1.2e-1",
}


@query("pick_by_delta", with_tables("chain", extra=POOL | PICK) + f"SELECT symbol, session, expiration, strike, {r('delta', 'delta', 4)}, {r('iv0', 'iv', 4)} FROM pk")
def pick_by_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(picks(spark, d).select("symbol", "session", "expiration", "strike", "delta", "iv"), 4)


AFFORD = PICK | {
    "el": f"SELECT * FROM chain WHERE {ELIGIBLE.removesuffix(' AND bid > 0')}",
    "pk2": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY round(delta, 9) DESC, strike) AS k FROM dl WHERE delta BETWEEN 2e-1 - 1e-9 AND 6e-1 + 1e-9 AND ask * 1e2 + 7e-1 <= 4e2) WHERE k = 1",
}


@query("affordable_call", with_tables("chain", extra={"el": AFFORD["el"], "pool": POOL["pool"], "cand": PICK["cand"], "dl": PICK["dl"], "pk2": AFFORD["pk2"]}) + f"SELECT symbol, session, expiration, strike, {r('delta', 'delta', 4)} FROM pk2")
def affordable_call(spark: SparkSession, d: str) -> DataFrame:
    rows = selection.pick_affordable_call(S.chain(spark, d), F.lit(RATE), 400.0, 0.70, 0.20, 0.60, 35, 25, 45)
    return rounded(rows.select("symbol", "session", "expiration", "strike", "delta"), 4)


def wanted(spark: SparkSession, d: str) -> DataFrame:
    """A request per session: its second-lowest strike's call, one week and a day out, and one nobody quotes."""
    rows = S.chain(spark, d).where("option_type = 'C' and dte = 9").groupBy("symbol", "session", "expiration").agg(F.min("strike").alias("strike"))
    offset = F.explode(F.array(F.lit(0.0), F.lit(0.25))).alias("o")
    return rows.select("symbol", "session", "expiration", "strike", offset).select("symbol", "session", "expiration", (F.col("strike") + F.col("o")).alias("strike"), F.lit("C").alias("option_type"))


@query("contract_lookup", with_tables("chain", extra={
    "wq": "SELECT symbol, session, expiration, min(strike) AS s0 FROM chain WHERE option_type = 'C' AND dte = 9 GROUP BY 1, 2, 3", "wn": "SELECT symbol, session, expiration, s0 + o AS strike FROM wq CROSS JOIN (SELECT unnest([0e0, 2.5e-1]) AS o)",
    "one": "SELECT symbol, session, expiration, strike, option_type, min(bid) AS bid, min(ask) AS ask FROM chain GROUP BY ALL"})
    + f"SELECT w.symbol, w.session, w.expiration, w.strike, {r('(o.bid + o.ask) / 2e0', 'mid')} FROM wn w LEFT JOIN one o ON o.symbol = w.symbol AND o.session = w.session AND o.expiration = w.expiration AND o.strike = w.strike AND o.option_type = 'C'")
def contract_lookup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.lookup(wanted(spark, d), S.chain(spark, d)).select("symbol", "session", "expiration", "strike", "mid"))


HELD = "min(bid) AS bid, min(ask) AS ask"


@query("position_mark_interval_join", with_tables("chain", extra=POOL | PICK | {"qs": f"SELECT symbol, session, expiration, strike, option_type, {HELD} FROM chain GROUP BY ALL"})
       + f"""SELECT pk.symbol, pk.session AS opened, pk.expiration, pk.strike, q.session, {r('(q.bid + q.ask) / 2e0', 'mid')} FROM pk JOIN qs q ON q.symbol = pk.symbol AND q.expiration = pk.expiration AND q.strike = pk.strike AND q.option_type = 'C'
WHERE q.session BETWEEN pk.session AND pk.expiration""")
def position_mark_interval_join(spark: SparkSession, d: str) -> DataFrame:
    held = staged(picks(spark, d).select("symbol", F.col("session").alias("opened"), "expiration", "strike", "option_type"), "held")
    rows = selection.held_quotes(held, S.chain(spark, d))
    rows = rows.groupBy("symbol", "opened", "expiration", "strike", "session").agg(((F.min("bid") + F.min("ask")) / 2.0).alias("mid"))
    return rounded(rows)


@query("veto_gate", with_tables(*PANEL_TABLES, extra=LAGGED) + """SELECT symbol, date, (coalesce(rsi14 < 40, false) OR coalesce(ret84 < 0, false) OR coalesce(px < ma200, false)) AS plain,
coalesce(CASE symbol WHEN '1-URGENT' THEN coalesce(ret84 < 1.58e-2, false) OR coalesce(absorption_shift > 8.3e-3, false) WHEN '2-HIGH' THEN coalesce(absorption_shift > 1e-2, false) OR coalesce(px / ma200 - 1e0 < 3.47e-2, false)
WHEN '3-MEDIUM' THEN coalesce(rsi14 < 4.57818e1, false) OR coalesce(ret84 < -7.1e-3, false) END, false) AS fund FROM panel""")
def veto_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = traded(spark, d)
    plain = rows.select("symbol", "date", gates.plain_veto().alias("plain"))
    return plain.join(gates.gated(rows, driver_gates(spark)).withColumnRenamed("vetoed", "fund"), ["symbol", "date"])


def driver_gates(spark: SparkSession) -> DataFrame:
    """The three funds' gates under the names of the first three price series."""
    names = dict(zip(("SPY", "QQQ", "IWM"), ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    return spark.createDataFrame([(names[g[0]], *g[1:]) for g in gates.FUND_GATES], gates.GATE_SCHEMA)


ACCRUE = {
    "s": "SELECT px.symbol, px.date, rates.rate, lead(px.date) OVER (PARTITION BY px.symbol ORDER BY px.date) AS nxt FROM px ASOF LEFT JOIN rates ON px.date >= rates.date",
}


@query("interest_accrual", with_tables("px", "rates", extra=ACCRUE) + f"SELECT symbol, {r('1e4 * exp(sum(ln(1e0 + coalesce(rate, 0e0) * (nxt - date) / 3.65e2)))', 'cash', 4)} FROM s WHERE nxt IS NOT NULL GROUP BY 1")
def interest_accrual(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.calendar import as_of

    rows = as_of(S.prices(spark, d).select("symbol", "date"), S.rates(spark, d), "rate")
    gap = F.datediff(F.lead("date").over(Window.partitionBy("symbol").orderBy("date")), F.col("date"))
    rows = rows.select("symbol", F.coalesce("rate", F.lit(0.0)).alias("rate"), gap.alias("days")).where("days is not null")
    grown = F.exp(F.sum(F.log(F.lit(1.0) + F.col("rate") * F.col("days") / 365.0))) * 10000.0
    return rounded(rows.groupBy("symbol").agg(grown.alias("cash")), 4)


def tapes(spark: SparkSession, d: str) -> DataFrame:
    vetoes = gates.gated(traded(spark, d), driver_gates(spark))
    chain = staged(S.chain(spark, d), "chain")  # the tape reads it four times
    return tape.session_tape(chain, S.prices(spark, d), S.rates(spark, d), S.dividends(spark, d), selection.pick_by_delta(chain, F.lit(RATE)), vetoes)


def all_runs(spark: SparkSession, d: str) -> DataFrame:
    symbols = S.prices(spark, d).select("symbol").distinct()
    grid = [(s, c) for s in ledger.STRATEGIES for c in quotes.FEES]
    return symbols.crossJoin(F.broadcast(spark.createDataFrame(grid, "strategy string, scenario string")))  # a fixed grid of runs


def ledgers(spark: SparkSession, d: str) -> DataFrame:
    return ledger.run_ledgers(tapes(spark, d), all_runs(spark, d))


KEYS = list(ledger.RUN)
# The reinvested holding, session by session: interest, dividends in the gap, then whole shares.
DRIP = {
    "ses": "SELECT symbol, session, max(spot) AS spot, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n FROM chain GROUP BY symbol, session",
    "sr": "SELECT ses.*, coalesce(rates.rate, 0e0) AS rate FROM ses ASOF LEFT JOIN rates ON ses.session >= rates.date",
    "st": """SELECT a.symbol, a.session, a.spot, a.n, coalesce(p.rate, 0e0) * coalesce(a.session - p.session, 0) / 3.65e2 AS grow,
      coalesce((SELECT sum(d.amount) FROM divs d WHERE d.symbol = a.symbol AND d.ex_date <= a.session AND d.ex_date > coalesce(p.session, a.session - 1)), 0e0) AS paid
      FROM sr a LEFT JOIN sr p ON p.symbol = a.symbol AND p.n = a.n - 1""",
}
DRIP_FOLD = """, fold AS (
SELECT symbol, n, session, spot, CAST(floor(round(spot * 2e2 * 1.01e0, 2) / spot) AS BIGINT) AS shares, round(spot * 2e2 * 1.01e0, 2) - spot * floor(round(spot * 2e2 * 1.01e0, 2) / spot) AS cash FROM st WHERE n = 1
UNION ALL
SELECT s.symbol, s.n, s.session, s.spot, f.shares + CAST(floor((f.cash * (1e0 + s.grow) + s.paid * f.shares) / s.spot) AS BIGINT),
 (f.cash * (1e0 + s.grow) + s.paid * f.shares) - s.spot * floor((f.cash * (1e0 + s.grow) + s.paid * f.shares) / s.spot)
FROM fold f JOIN st s ON s.symbol = f.symbol AND s.n = f.n + 1)
"""


def drip_sql(select: str, extra: str = "") -> str:
    return with_tables("chain", "rates", "divs", extra=DRIP).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + DRIP_FOLD + extra + select


@query("drip_fold", drip_sql(f"SELECT symbol, session, shares, {r('cash', 'cash', 2)}, {r('cash + shares * spot', 'equity', 2)} FROM fold"))
def drip_fold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(drip_equity(spark, d).select("symbol", "session", "shares", "cash", "equity"), 2)


def drip_equity(spark: SparkSession, d: str) -> DataFrame:
    runs = S.prices(spark, d).select("symbol").distinct().select("symbol", F.lit("buyhold_drip").alias("strategy"), F.lit("base").alias("scenario"))
    plain = tape.session_tape(S.chain(spark, d).where("dte = 9"), S.prices(spark, d), S.rates(spark, d), S.dividends(spark, d), picks(spark, d).limit(0), None)
    return ledger.equity_log(ledger.run_ledgers(plain, runs))


# The ledger in SQL: what does not depend on the account, session by session, and one row per run and session carried on.
VETO = """SELECT symbol, date, coalesce(CASE symbol WHEN '1-URGENT' THEN coalesce(ret84 < 1.58e-2, false) OR coalesce(absorption_shift > 8.3e-3, false)
WHEN '2-HIGH' THEN coalesce(absorption_shift > 1e-2, false) OR coalesce(px / ma200 - 1e0 < 3.47e-2, false)
WHEN '3-MEDIUM' THEN coalesce(rsi14 < 4.57818e1, false) OR coalesce(ret84 < -7.1e-3, false) END, false) AS vetoed FROM panel"""
TAPE = LAGGED | POOL | PICK | {
    "veto": VETO,
    "ses": "SELECT symbol, session, max(spot) AS spot, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n FROM chain GROUP BY symbol, session",
    "sr": "SELECT ses.*, coalesce(rates.rate, 0e0) AS rate FROM ses ASOF LEFT JOIN rates ON ses.session >= rates.date",
    "dd1": "SELECT symbol, ex_date, sum(amount) AS amount FROM divs GROUP BY symbol, ex_date",
    "paid": "SELECT sr.symbol, sr.n, min(d.ex_date) AS d_day, sum(d.amount) AS d_amt FROM sr LEFT JOIN sr p ON p.symbol = sr.symbol AND p.n = sr.n - 1 JOIN dd1 d ON d.symbol = sr.symbol AND d.ex_date <= sr.session AND d.ex_date > coalesce(p.session, sr.session - 1) GROUP BY ALL",
    "ahead": "SELECT sr.symbol, sr.n, d.ex_date AS x_day, d.amount AS x_amt FROM sr ASOF JOIN dd1 d ON d.symbol = sr.symbol AND d.ex_date > sr.session",
    # The candidate with the close its expiry will settle at.
    "kc": "SELECT pk.symbol, pk.session, pk.expiration, pk.strike, pk.delta, pk.iv0, pk.dte, px.close AS settle FROM pk ASOF LEFT JOIN px ON px.symbol = pk.symbol AND pk.expiration >= px.date",
    "qs": "SELECT c.symbol, c.session, c.expiration, c.strike, max(c.bid) AS bid, max(c.ask) AS ask FROM chain c JOIN (SELECT DISTINCT symbol, expiration, strike FROM pk) k ON k.symbol = c.symbol AND k.expiration = c.expiration AND k.strike = c.strike WHERE c.option_type = 'C' GROUP BY ALL",
    "tp": """SELECT sr.symbol, sr.n, sr.session, p.session AS prev, sr.spot, coalesce(p.rate, 0e0) * coalesce(sr.session - p.session, 0) / 3.65e2 AS grow, paid.d_day, paid.d_amt, ahead.x_day, ahead.x_amt,
      coalesce(veto.vetoed, false) AS vetoed, kc.expiration AS k_exp, kc.strike AS k_strike, kc.delta AS k_delta, kc.iv0 AS k_iv, kc.dte AS k_dte, kc.settle AS k_settle, qs.bid AS k_bid, qs.ask AS k_ask
      FROM sr LEFT JOIN sr p ON p.symbol = sr.symbol AND p.n = sr.n - 1 LEFT JOIN paid ON paid.symbol = sr.symbol AND paid.n = sr.n LEFT JOIN ahead ON ahead.symbol = sr.symbol AND ahead.n = sr.n
      LEFT JOIN veto ON veto.symbol = sr.symbol AND veto.date = sr.session LEFT JOIN kc ON kc.symbol = sr.symbol AND kc.session = sr.session
      LEFT JOIN qs ON qs.symbol = sr.symbol AND qs.session = sr.session AND qs.expiration = kc.expiration AND qs.strike = kc.strike""",
    "run": "SELECT symbol, strategy, scenario, fee FROM (SELECT DISTINCT symbol FROM ses) CROSS JOIN (SELECT unnest([" + ", ".join(f"'{x}'" for x in ledger.STRATEGIES) + "]) AS strategy) CROSS JOIN (VALUES ('optimistic', 7e-1), ('base', 7e-1), ('conservative', 1e0), ('stress', 2e0)) AS v(scenario, fee)",
}
LEDGER_FOLD = """, fold AS (
SELECT symbol, strategy, scenario, fee, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS session, CAST(0 AS DOUBLE) AS spot, round(ses.spot * 2e2 * 1.01e0, 2) AS cash, CAST(0 AS BIGINT) AS shares, CAST(0 AS BIGINT) AS last_id,
  CAST(NULL AS DATE) AS c_exp, CAST(NULL AS DOUBLE) AS c_strike, CAST(0 AS BIGINT) AS c_n, CAST(NULL AS DATE) AS c_open, CAST(NULL AS DOUBLE) AS c_price, CAST(NULL AS DOUBLE) AS c_fee, CAST(NULL AS DOUBLE) AS c_delta,
  CAST(NULL AS DOUBLE) AS c_iv, CAST(NULL AS BIGINT) AS c_dte, CAST(NULL AS DOUBLE) AS c_settle, CAST(0 AS DOUBLE) AS q_bid, CAST(0 AS DOUBLE) AS q_ask,
  CAST(NULL AS VARCHAR) AS how, CAST(NULL AS DATE) AS d_day, CAST(NULL AS DOUBLE) AS d_amt, CAST(0 AS BIGINT) AS d_sh, CAST(0 AS BIGINT) AS bought, CAST(NULL AS VARCHAR) AS tag
FROM run JOIN ses USING (symbol) WHERE ses.n = 1
UNION ALL
SELECT symbol, strategy, scenario, fee, n, session, spot, cash4 + CASE WHEN wrote THEN w_price * 1e2 * w_n - fee * w_n ELSE 0e0 END, shares4, last_id + CAST(wrote AS BIGINT),
  CASE WHEN wrote THEN k_exp WHEN open3 THEN c_exp END, CASE WHEN wrote THEN k_strike WHEN open3 THEN c_strike END, CASE WHEN wrote THEN w_n WHEN open3 THEN c_n ELSE 0 END, CASE WHEN wrote THEN session WHEN open3 THEN c_open END,
  CASE WHEN wrote THEN w_price WHEN open3 THEN c_price END, CASE WHEN wrote THEN fee * w_n WHEN open3 THEN c_fee END, CASE WHEN wrote THEN k_delta WHEN open3 THEN c_delta END, CASE WHEN wrote THEN k_iv WHEN open3 THEN c_iv END,
  CASE WHEN wrote THEN CAST(k_dte AS BIGINT) WHEN open3 THEN c_dte END, CASE WHEN wrote THEN k_settle WHEN open3 THEN c_settle END, CASE WHEN wrote THEN k_bid WHEN open3 THEN coalesce(q_bid, 0e0) ELSE 0e0 END,
  CASE WHEN wrote THEN k_ask WHEN open3 THEN coalesce(q_ask, 0e0) ELSE 0e0 END, how, d_day, d_amt, d_sh, bought, tag
FROM (
 SELECT *, w_n > 0 AND k_bid > 0 AND k_ask > 0 AND k_bid <= k_ask AS wrote,
  greatest(CASE scenario WHEN 'optimistic' THEN (k_bid + k_ask) / 2e0 WHEN 'base' THEN (k_bid + k_ask) / 2e0 - (k_ask - k_bid) / 4e0 WHEN 'conservative' THEN k_bid - 1e-2 ELSE k_bid - 3e-2 END, 0e0) AS w_price
 FROM (
  SELECT *, cash3 - spot * bought AS cash4, shares3 + bought AS shares4,
   CASE WHEN k_exp IS NULL OR open3 OR strategy IN ('buyhold', 'buyhold_drip') OR (vetoed AND strategy <> 'naive_cc_reinvest') THEN 0
    WHEN strategy = 'covered_call' THEN CASE WHEN shares3 >= 200 THEN shares3 // 100 ELSE 0 END WHEN shares3 >= 100 THEN 1 ELSE 0 END AS w_n
  FROM (
   SELECT *, CASE WHEN want > 0 THEN CASE WHEN shares3 > 0 AND strategy <> 'buyhold' THEN 'reinvest' ELSE 'init_buy' END END AS tag, CASE WHEN want > 0 AND spot * want <= cash3 THEN want ELSE 0 END AS bought
   FROM (
    SELECT *, CASE strategy WHEN 'buyhold' THEN 200 - shares3 WHEN 'covered_call' THEN CASE WHEN shares3 < 200 THEN least(200 - shares3, CAST(floor(cash3 / spot) AS BIGINT)) ELSE 0 END ELSE CAST(floor(cash3 / spot) AS BIGINT) END AS want
    FROM (
     SELECT *, cash2 + CASE WHEN gone THEN c_strike * 1e2 * c_n ELSE 0e0 END AS cash3, shares2 - CASE WHEN gone THEN 100 * c_n ELSE 0 END AS shares3, open2 AND NOT gone AS open3,
      CASE WHEN gone THEN 'called_away_exdiv' WHEN called THEN 'called_away' WHEN due THEN 'expired' END AS how
     FROM (
      SELECT *, cash1 + CASE WHEN d_amt > 0 AND d_sh > 0 THEN d_amt * d_sh ELSE 0e0 END + CASE WHEN called THEN c_strike * 1e2 * c_n ELSE 0e0 END AS cash2, shares - CASE WHEN called THEN 100 * c_n ELSE 0 END AS shares2, NOT due AND c_exp IS NOT NULL AS open2,
       coalesce(NOT due AND x_day - session <= 1 AND spot > c_strike AND c_exp > session AND (q_bid + q_ask) / 2e0 - (spot - c_strike) < x_amt, false) AS gone
      FROM (
       SELECT *, shares - CASE WHEN called AND d_day > c_exp AND c_exp > prev THEN 100 * c_n ELSE 0 END AS d_sh
       FROM (
        SELECT f.* EXCLUDE (n, session, spot, q_bid, q_ask, how, d_day, d_amt, d_sh, bought, tag), s.* EXCLUDE (symbol), q.bid AS q_bid, q.ask AS q_ask, f.cash * (1e0 + s.grow) AS cash1, coalesce(f.c_exp < s.session, false) AS due,
         coalesce(f.c_exp < s.session AND coalesce(f.c_settle, 0e0) - f.c_strike >= 1e-2, false) AS called
        FROM fold f JOIN tp s ON s.symbol = f.symbol AND s.n = f.n + 1 LEFT JOIN qs q ON q.symbol = s.symbol AND q.session = s.session AND q.expiration = f.c_exp AND q.strike = f.c_strike)))))))))
"""
RUN_KEYS = "symbol, strategy, scenario"
# Rows of the logs, from each step and the one before it.
LEDGER_LOGS = f""", step AS MATERIALIZED (SELECT * FROM fold WHERE n > 0), eqs AS MATERIALIZED (
SELECT {RUN_KEYS}, session, round(cash + shares * spot - 1e2 * c_n * (q_bid + q_ask) / 2e0, 2) AS equity, round(cash + shares * spot - 1e2 * c_n * q_ask, 2) AS equity_liq, round(cash, 2) AS cash, 0e0 AS reserved, shares,
  CAST(0 AS BIGINT) AS n_long, CAST(c_exp IS NOT NULL AS BIGINT) AS n_short FROM step),
closed AS MATERIALIZED (SELECT b.symbol, b.strategy, b.scenario, b.session AS done, b.how, a.c_exp, a.c_strike, a.c_n, a.c_open, a.c_price, a.c_fee, a.c_delta, a.c_iv, a.c_dte, a.last_id, b.d_day, b.d_amt, b.d_sh, b.n
  FROM step b JOIN fold a ON a.symbol = b.symbol AND a.strategy = b.strategy AND a.scenario = b.scenario AND a.n = b.n - 1 WHERE b.how IS NOT NULL),
tr0 AS (
SELECT {RUN_KEYS}, n, 0 AS o, last_id AS pos_id, 'short' AS kind, c_open AS open_session, c_exp AS expiration, c_strike AS strike, 'C' AS option_type, c_n AS contracts, c_price AS open_price, c_fee AS open_fee, 'cc_write' AS tag, c_delta AS open_delta,
  c_iv AS open_iv, c_dte AS open_dte, CASE WHEN how = 'called_away_exdiv' THEN done ELSE c_exp END AS close_session, 0e0 AS close_price, 0e0 AS close_fee, how AS close_how, round(c_price * 1e2 * c_n - c_fee, 2) AS pnl FROM closed
UNION ALL
SELECT {RUN_KEYS}, n, 1, NULL, 'stock', session, NULL, NULL, NULL, bought, spot, NULL, tag, NULL, NULL, NULL, NULL, NULL, NULL, tag, NULL FROM step WHERE bought > 0),
trs AS MATERIALIZED (SELECT * EXCLUDE (n, o), row_number() OVER (PARTITION BY {RUN_KEYS} ORDER BY n, o) - 1 AS seq FROM tr0),
ev0 AS (
SELECT {RUN_KEYS}, n, CASE WHEN d_sh < shares_before THEN 2 ELSE 0 END AS o, d_day AS session, 'dividend' AS event, d_amt AS amount, d_sh AS shares, CAST(NULL AS DOUBLE) AS strike, CAST(NULL AS BIGINT) AS contracts
 FROM (SELECT step.*, coalesce(a.shares, 0) AS shares_before FROM step JOIN fold a USING (symbol, strategy, scenario) WHERE a.n = step.n - 1) WHERE d_amt > 0 AND d_sh > 0
UNION ALL
SELECT {RUN_KEYS}, n, 1, CASE WHEN how = 'called_away' THEN c_exp ELSE done END, CASE WHEN how = 'called_away' THEN 'call_assignment' ELSE 'exdiv_call_assignment' END, NULL, NULL, c_strike, CASE WHEN how = 'called_away' THEN c_n END FROM closed WHERE how <> 'expired'),
evs AS MATERIALIZED (SELECT * EXCLUDE (n, o), row_number() OVER (PARTITION BY {RUN_KEYS} ORDER BY n, o) - 1 AS seq FROM ev0)
"""


def ledger_sql(select: str, sessions: str = "true", **extra: str) -> str:
    tape = TAPE | {"ses": TAPE["ses"].replace("FROM chain", f"FROM chain WHERE {sessions}")}
    tables = with_tables(*PANEL_TABLES, "chain", "chain3", "rates", "divs", extra=tape)
    more = "".join(f", {k} AS MATERIALIZED ({v.strip()})" for k, v in extra.items())
    return tables.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + LEDGER_FOLD + LEDGER_LOGS + more + "\n" + select


@query("ledger_equity", ledger_sql(f"SELECT {RUN_KEYS}, session, {', '.join(r(c, c, 2) for c in ('equity', 'equity_liq', 'cash', 'reserved'))}, shares, n_long, n_short FROM eqs"))
def ledger_equity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.equity_log(ledgers(spark, d)), 2)


#: A run from one day to another, both within the tables' years.
SPAN = (dt.date(1996, 3, 1), dt.date(1998, 9, 30))


@query("ledger_between", ledger_sql(f"SELECT {RUN_KEYS}, session, {', '.join(r(c, c, 2) for c in ('equity', 'equity_liq', 'cash'))}, shares, n_short FROM eqs", "session BETWEEN DATE '{}' AND DATE '{}'".format(*SPAN)))
def ledger_between(spark: SparkSession, d: str) -> DataFrame:
    equity = ledger.equity_log(ledger.run_ledgers(tapes(spark, d), all_runs(spark, d), start=SPAN[0], end=SPAN[1]))
    return rounded(equity.select(*KEYS, "session", "equity", "equity_liq", "cash", "shares", "n_short"), 2)


DIGITS = ("strike", "open_price", "open_fee", "open_delta", "open_iv", "close_price", "close_fee", "pnl")


@query("ledger_trades", ledger_sql(f"SELECT {RUN_KEYS}, seq, CAST(pos_id AS BIGINT) AS pos_id, kind, open_session, expiration, option_type, CAST(contracts AS BIGINT) AS contracts, tag, CAST(open_dte AS BIGINT) AS open_dte, close_session, close_how, {', '.join(r(c, c, 4) for c in DIGITS)} FROM trs"))
def ledger_trades(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.trade_log(ledgers(spark, d)), 4)


@query("ledger_events", ledger_sql(f"SELECT {RUN_KEYS}, seq, session, event, {r('amount', 'amount')}, CAST(shares AS BIGINT) AS shares, {r('strike', 'strike')}, CAST(contracts AS BIGINT) AS contracts FROM evs"))
def ledger_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.event_log(ledgers(spark, d)))


# Metrics on curves that SQL can also make: each price series as an equity curve.
def curves(spark: SparkSession, d: str) -> DataFrame:
    return S.prices(spark, d).select("symbol", F.col("date").alias("session"), F.col("close").alias("equity"))


def equity_sql(source: str, keys: str) -> tuple[dict[str, str], str]:
    """Tables and the select of all metrics of the curves (keys, date, equity) of ``source``."""
    eq = {
        "eq": f"SELECT {keys}, date, equity, equity / lag(equity) OVER w - 1e0 AS ret, equity / max(equity) OVER (w ROWS UNBOUNDED PRECEDING) - 1e0 AS dd FROM ({source}) WINDOW w AS (PARTITION BY {keys} ORDER BY date)",
        "er": "SELECT eq.*, rates.rate FROM eq ASOF LEFT JOIN rates ON eq.date >= rates.date",
        "isl": f"SELECT {keys}, dd, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) AS i FROM eq",
        "lng": f"SELECT {keys}, max(k) AS longest FROM (SELECT {keys}, i, count(*) FILTER (WHERE dd < 0) AS k FROM isl GROUP BY ALL) GROUP BY ALL",
        "ag": f"""SELECT {keys}, min(date) AS a, max(date) AS b, count(*) AS n, max_by(equity, date) AS l, min_by(equity, date) AS f, stddev_samp(ret) AS sd, avg(ret) AS mean, coalesce(avg(rate) FILTER (WHERE ret IS NOT NULL), 0e0) AS rf,
          stddev_samp(ret) FILTER (WHERE ret < 0) AS dn, min(ret) AS wd, min(dd) AS mdd FROM er GROUP BY ALL""",
    }
    for name, bin in (("wk", "CAST(date + CAST((7 - isodow(date)) % 7 AS INTEGER) AS DATE)"), ("mo", "last_day(date)")):
        ends = f"SELECT {keys}, {bin} AS bin, max_by(equity, date) AS v FROM eq GROUP BY ALL"
        eq[name] = f"SELECT {keys}, min(x) AS {name}_worst FROM (SELECT {keys}, v / lag(v) OVER (PARTITION BY {keys} ORDER BY bin) - 1e0 AS x FROM ({ends})) GROUP BY ALL"
    eq["fin"] = f"SELECT *, pow(l / f, 1e0 / greatest((b - a) / 3.6525e2, 1e-9)) - 1e0 AS cagr, (mean - rf / 2.52e2) * sqrt(2.52e2) AS ex FROM ag JOIN lng USING ({keys}) JOIN wk USING ({keys}) JOIN mo USING ({keys})"
    sel = f"""SELECT {keys}, a AS start, b AS "end", n AS sessions, {r('l', 'final_equity')}, {r('l / f - 1e0', 'total_return')}, {r('cagr', 'cagr')}, {r('sd * sqrt(2.52e2)', 'ann_vol')},
{r('CASE WHEN sd > 0 THEN ex / sd ELSE 0e0 END', 'sharpe')}, {r('CASE WHEN dn > 0 THEN ex / dn END', 'sortino')}, {r('mdd', 'max_drawdown')}, {r('CASE WHEN mdd < 0 THEN cagr / abs(mdd) END', 'calmar')}, longest AS longest_dd_sessions,
{r('coalesce(wd, 0e0)', 'worst_day')}, {r('coalesce(wk_worst, 0e0)', 'worst_week')}, {r('coalesce(mo_worst, 0e0)', 'worst_month')}"""
    return eq, sel


def trades_sql(keys: str, opened: str, closed: str) -> str:
    return f"""SELECT {keys}, count(*) AS n_trades, {r('avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END)', 'win_rate')}, {r('coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0e0)', 'avg_win')},
{r('coalesce(avg(pnl) FILTER (WHERE pnl <= 0), 0e0)', 'avg_loss')}, {r('coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0e0) / nullif(abs(sum(pnl) FILTER (WHERE pnl <= 0)), 0e0)', 'profit_factor')}, {r('avg(pnl)', 'ev_per_trade')},
{r('sum(pnl)', 'total_pnl')}, {r('min(pnl)', 'worst_trade')}, {r('max(pnl)', 'best_trade')}, {r(f'median({closed} - {opened})', 'median_holding_days')}"""


EQ, EQ_SELECT = equity_sql("SELECT symbol, date, close AS equity FROM px", "symbol")


@query("equity_metrics", with_tables("px", "rates", extra=EQ) + f"{EQ_SELECT} FROM fin")
def equity_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.equity_metrics(curves(spark, d), ["symbol"], S.rates(spark, d)))


RUN_EQ, RUN_SELECT = equity_sql(f"SELECT {RUN_KEYS}, session AS date, equity FROM eqs", RUN_KEYS)
COUNTS = f"""SELECT e.*, coalesce(w, 0) AS n_calls_written, coalesce(c, 0) AS n_called_away FROM (SELECT {RUN_KEYS}, max_by(shares, session) AS final_shares FROM eqs GROUP BY ALL) e
LEFT JOIN (SELECT {RUN_KEYS}, count(*) FILTER (WHERE tag = 'cc_write') AS w, count(*) FILTER (WHERE close_how = 'called_away') AS c FROM trs GROUP BY ALL) t USING ({RUN_KEYS})"""


@query("run_summary", ledger_sql(f"{RUN_SELECT}, n_calls_written, n_called_away, final_shares FROM fin JOIN cnt USING ({RUN_KEYS})", **RUN_EQ, cnt=COUNTS))
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    log = staged(ledgers(spark, d), "log")  # folded once for the metrics and the counters
    return rounded(metrics.equity_metrics(ledger.equity_log(log), KEYS, S.rates(spark, d)).join(ledger.run_counters(log), KEYS))


@query("trade_metrics_ledger", ledger_sql(f"{trades_sql(RUN_KEYS, 'open_session', 'close_session')} FROM trs WHERE pnl IS NOT NULL GROUP BY {RUN_KEYS}"))
def trade_metrics_ledger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.trade_metrics(ledger.trade_log(ledgers(spark, d)), KEYS))


@query("longest_drawdown_run", with_tables("px", extra={k: EQ[k] for k in ("eq", "isl", "lng")}) + "SELECT symbol, longest AS longest_dd_sessions FROM lng")
def longest_drawdown_run(spark: SparkSession, d: str) -> DataFrame:
    return metrics.longest_drawdown(curves(spark, d), ["symbol"])


@query("year_returns", with_tables("px", extra={"y": "SELECT symbol, year(date) AS year, max_by(close, date) AS v, min_by(close, date) AS f FROM px GROUP BY 1, 2"})
       + f"SELECT symbol, CAST(year AS BIGINT) AS year, {r('v / coalesce(lag(v) OVER (PARTITION BY symbol ORDER BY year), f) - 1e0', 'ret')} FROM y")
def year_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.yearly_returns(curves(spark, d), ["symbol"]))


# Trades: every day buys, and sells ten rows later; the pnl is the move in cents.
TRADES = {
    "tn": "SELECT symbol, date, close, lead(date, 10) OVER w AS d2, lead(close, 10) OVER w AS c2 FROM px WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "tr": "SELECT symbol, date, d2, round(c2 - close, 2) AS pnl FROM tn",
}


def trades(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    rows = S.prices(spark, d).select("symbol", "date", "close", F.lead("date", 10).over(w).alias("close_session"), F.lead("close", 10).over(w).alias("c2"))
    return rows.select("symbol", F.col("date").alias("open_session"), "close_session", F.round(F.col("c2") - F.col("close"), 2).alias("pnl"))


@query("trade_metrics", with_tables("px", extra=TRADES) + f"{trades_sql('symbol', 'date', 'd2')} FROM tr WHERE pnl IS NOT NULL GROUP BY symbol")
def trade_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.trade_metrics(trades(spark, d), ["symbol"]))


# A curve of which puts tie up a part that changes from day to day.
USED = {"u": "SELECT symbol, close AS equity, close * 6e-1 AS cash, close * 1e-1 * (row_number() OVER (PARTITION BY symbol ORDER BY date) % 4) AS reserved FROM px"}


@query("capital_utilization", with_tables("px", extra=USED) + f"SELECT symbol, {r('avg((equity - (cash - reserved)) / equity)', 'utilization')} FROM u GROUP BY 1")
def capital_utilization(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("session"))
    rows = curves(spark, d).withColumn("cash", F.col("equity") * 0.6).withColumn("reserved", F.col("equity") * 0.1 * (n % 4))
    return rounded(metrics.capital_utilization(rows, ["symbol"]))


BR = {"br": "SELECT symbol, date, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS l, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS h FROM px"}


@query("drawdown_brake", with_tables("px", extra=BR) + "SELECT symbol, date AS session, CASE WHEN l < 7.5e-1 * h THEN 0e0 WHEN l < 8.5e-1 * h THEN 5e-1 ELSE 1e0 END AS brake FROM br")
def drawdown_brake(spark: SparkSession, d: str) -> DataFrame:
    return metrics.drawdown_brake(curves(spark, d), ["symbol"]).select("symbol", "session", "brake")


@query("strided_curve", with_tables("px") + f"SELECT symbol, session, {r('equity', 'equity')} FROM (SELECT symbol, date AS session, close AS equity, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM px) WHERE (n - 1) % 5 = 0")
def strided_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sinks.strided(curves(spark, d), ["symbol"], "session"))


@query("sector_union", with_tables("sec") + "SELECT sector, count(*) AS days, " + r("max(close)", "high") + " FROM sec GROUP BY 1")
def sector_union(spark: SparkSession, d: str) -> DataFrame:
    every = S.sectors(spark, d)
    return rounded(every.groupBy("sector").agg(F.count("*").alias("days"), F.max("close").alias("high")))


@query("event_stream_buckets", "SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_stream_buckets(spark: SparkSession, d: str) -> DataFrame:
    return online.event_buckets(S.table(spark, d, "events"))


