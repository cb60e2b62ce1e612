"""DuckDB SQL that derives the market tables, for the oracle queries to build on."""

# The normal tail's coefficients, in exponent form so that every engine reads doubles.
_TOP = ("3.52624965998911e-2", "7.00383064443688e-1", "6.37396220353165e0", "3.3912866078383e1", "1.12079291497871e2", "2.21213596169931e2", "2.20206867912376e2")
_BOTTOM = ("8.83883476483184e-2", "1.75566716318264e0", "1.6064177579207e1", "8.67807322029461e1", "2.96564248779674e2", "6.37333633378831e2", "7.93826512519948e2", "4.40413735824752e2")


def _poly(cs: tuple[str, ...]) -> str:
    out = cs[0]
    for c in cs[1:]:
        out = f"({out}*abs(x)+{c})"
    return out


def ncdf(x: str) -> str:
    """The normal distribution function of a column or simple expression."""
    a = f"abs({x})"
    poly = lambda cs: _poly(cs).replace("abs(x)", a)
    z = f"exp(-({x})*({x})/2e0)"
    tail = (
        f"CASE WHEN {a} > 3.7e1 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {z}*{poly(_TOP)}/{poly(_BOTTOM)} "
        f"ELSE {z}/({a}+1e0/({a}+2e0/({a}+3e0/({a}+4e0/({a}+6.5e-1)))))/2.506628274631e0 END"
    )
    return f"CASE WHEN ({x}) > 0 THEN 1e0-({tail}) ELSE ({tail}) END"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "px": ((), """
SELECT symbol, date, 1e2 * exp(sum(1e-2 * (bar / mean - 1e0)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close
FROM (SELECT *, avg(bar) OVER (PARTITION BY symbol) AS mean FROM (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS bar FROM orders GROUP BY 1, 2))"""),
    "sec": ((), """
SELECT sector, date, 1e2 * exp(sum(1e-2 * (bar / mean - 1e0)) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close
FROM (SELECT *, avg(bar) OVER (PARTITION BY sector) AS mean FROM (
  SELECT concat(l_returnflag, l_linestatus) AS sector, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS bar FROM lineitem GROUP BY 1, 2))"""),
    "cal": ((), "SELECT date, row_number() OVER (ORDER BY date) AS dn FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"),
    "vol": (("cal",), "SELECT date, 1.5e1 + 1e1 * ((dn * 7) % 11) / 1.1e1 AS value FROM cal WHERE dn % 7 <> 0"),
    "eig": (("cal",), "SELECT date, 5e-1 + 1e-1 * ((dn * 13) % 17) / 1.7e1 AS ar1 FROM cal WHERE dn % 5 <> 0"),
    "rates": ((), "SELECT date, 1e-2 + 5e-4 * ((year(date) * 12 + month(date)) % 40) AS rate FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders)"),
    "divs": ((), """
SELECT symbol, q + 14 AS ex_date, 2.5e-1 + 1e-2 * ((year(q) * 4 + quarter(q)) % 5) AS amount
FROM (SELECT DISTINCT o_orderpriority AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q FROM orders)"""),
    "chain0": (("px",), """
SELECT symbol, date AS session, dn, dte, ki, option_type, close AS spot, round(close * (9e-1 + 2.5e-2 * ki) + 7e-2, 0) AS strike,
  1.5e-1 + 1e-2 * ((dn * 3 + ki * 5 + dte) % 10) AS iv0
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS dn FROM px)
CROSS JOIN (SELECT unnest([9, 16, 23, 33, 37, 51]) AS dte) CROSS JOIN (SELECT unnest(range(9)) AS ki) CROSS JOIN (SELECT unnest(['C', 'P']) AS option_type)"""),
    "chain1": (("chain0",), """
SELECT *, dte / 3.65e2 AS t, (ln(spot * exp((3e-2 - 1.3e-2) * dte / 3.65e2) / strike) + iv0 * iv0 * dte / 3.65e2 / 2e0) / (iv0 * sqrt(dte / 3.65e2)) AS d1,
  CASE WHEN option_type = 'C' THEN 1e0 ELSE -1e0 END AS sg FROM chain0"""),
    "chain2": (("chain1",), "SELECT *, sg * d1 AS x1, sg * (d1 - iv0 * sqrt(t)) AS x2 FROM chain1"),
    "chain3": (("chain2",), f"SELECT *, exp(-3e-2 * t) * sg * (spot * exp((3e-2 - 1.3e-2) * t) * ({ncdf('x1')}) - strike * ({ncdf('x2')})) AS mid0 FROM chain2"),
    "chain": (("chain3",), """
SELECT symbol, session, session + CAST(dte AS INTEGER) AS expiration, CAST(dte AS INTEGER) AS dte, strike, option_type,
  mid0 * (1e0 - 1e-2 * ((dn + ki * 3 + dte) % 4 + 1)) AS bid, mid0 * (1e0 + 1e-2 * ((dn + ki * 3 + dte) % 4 + 1)) AS ask,
  CASE WHEN ((dn * 37 + ki * 11 + dte * 5) % 1000) % 13 <> 0 THEN CAST((dn * 37 + ki * 11 + dte * 5) % 1000 AS DOUBLE) END AS open_interest, spot
FROM chain3"""),
}


def with_tables(*names: str, extra: dict[str, str] | None = None) -> str:
    """A WITH clause of the named tables and all they need, then the extra ones."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in CTES[n][0]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in order] + [f"{n} AS MATERIALIZED ({sql.strip()})" for n, sql in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
