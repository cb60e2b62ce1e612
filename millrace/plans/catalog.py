"""The registered queries of the engine, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.windows import ordered
from millrace.operators import features, targets
from millrace.plans.oracle_base import with_tables
from millrace.sources import synthetic as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits, counts as long, so that engines agree to the bit."""
    cols = []
    for c, kind in df.dtypes:
        x = F.col(c)
        # Adding zero turns a negative zero into zero.
        cols.append((F.round(x, digits) + F.lit(0.0)).alias(c) if kind == "double" else x.cast("long").alias(c) if kind in ("int", "bigint") else x)
    return df.select(*cols)


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"


W = "PARTITION BY symbol ORDER BY date"


def frame(n: int, by: str = W) -> str:
    return f"({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None, by: str = W) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n, by)} >= {least or n} THEN {agg}({x}) OVER {frame(n, by)} END"


def lag(x: str, k: int, by: str = W) -> str:
    return f"lag({x}, {k}) OVER ({by})"


#: Shared steps, as (name, SQL) of extra tables.
RET1 = {"r1": f"SELECT *, close / {lag('close', 1)} - 1e0 AS ret1 FROM px"}
DD = {"dd0": f"SELECT *, close / ({roll('max', 'close', 252, 60)}) - 1e0 AS dd FROM px"}


@query("returns_multi_lag", with_tables("px") + f"SELECT symbol, date, {', '.join(r(f'close / {lag('close', k)} - 1e0', f'ret{k}') for k in (1, 5, 21, 84))} FROM px")
def returns_multi_lag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.returns(S.prices(spark, d)))


@query("price_diff", with_tables("px") + f"SELECT symbol, date, {r(f'close - {lag('close', 1)}', 'diff1')}, {r(f'close - {lag('close', 20)}', 'diff20')} FROM px")
def price_diff(spark: SparkSession, d: str) -> DataFrame:
    c, w = F.col("close"), ordered()
    return rounded(S.prices(spark, d).select("symbol", "date", (c - F.lag(c, 1).over(w)).alias("diff1"), (c - F.lag(c, 20).over(w)).alias("diff20")))


MA = {"ma": f"SELECT symbol, date, close, {roll('avg', 'close', 20)} AS ma20, {roll('avg', 'close', 200)} AS ma200 FROM px"}


@query("sma_bands", with_tables("px", extra=MA) + f"""SELECT symbol, date, {r('ma20', 'ma20')}, {r('ma200', 'ma200')}, coalesce(close > ma200, false) AS above_ma200,
coalesce(close > ma200 * 1.01e0, false) AS above_ma200_up, coalesce(close > ma200 * 9.9e-1, false) AS above_ma200_dn FROM ma""")
def sma_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.with_averages(S.prices(spark, d)).drop("close"))


RSI = {
    "mv": f"SELECT symbol, date, close - {lag('close', 1)} AS m FROM px",
    "ud": "SELECT symbol, date, CASE WHEN m IS NOT NULL THEN greatest(m, 0e0) END AS u, CASE WHEN m IS NOT NULL THEN greatest(-m, 0e0) END AS dn FROM mv",
    "av": f"SELECT symbol, date, {roll('avg', 'u', 14)} AS u, {roll('avg', 'dn', 14)} AS dn FROM ud",
    "rsi": "SELECT symbol, date, 1e2 - 1e2 / (u / nullif(dn, 0e0) + 1e0) AS rsi14 FROM av",
}


@query("rsi14", with_tables("px", extra=RSI) + f"SELECT symbol, date, {r('rsi14', 'rsi14')} FROM rsi")
def rsi14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.with_rsi(S.prices(spark, d)).select("symbol", "date", "rsi14"))


@query("realized_vol", with_tables("px", extra=RET1) + f"SELECT symbol, date, {r(f'({roll('stddev_samp', 'ret1', 20)}) * sqrt(252e0)', 'rv20')} FROM r1")
def realized_vol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.with_volatility(S.prices(spark, d)).select("symbol", "date", "rv20"))


@query("rolling_high_drawdown", with_tables("px", extra=DD) + f"SELECT symbol, date, {r('dd', 'dd')} FROM dd0")
def rolling_high_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.with_drawdown(S.prices(spark, d)).select("symbol", "date", "dd"))


@query("deepest_dd_60", with_tables("px", extra=DD) + f"SELECT symbol, date, {r(roll('min', 'dd', 60), 'deep_dd_60')} FROM dd0")
def deepest_dd_60(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.with_drawdown(S.prices(spark, d)).select("symbol", "date", "deep_dd_60"))


@query("return_percentile_rank", with_tables("px", extra={
    "r21": f"SELECT symbol, date, close / {lag('close', 21)} - 1e0 AS x, row_number() OVER ({W}) AS n FROM px",
    "p": """SELECT a.symbol, a.date, count(*) FILTER (WHERE b.x < a.x) AS lo, count(*) FILTER (WHERE b.x = a.x) AS eq, count(b.x) AS n
      FROM r21 a JOIN r21 b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 755 AND a.n WHERE a.x IS NOT NULL GROUP BY 1, 2"""})
    + f"SELECT a.symbol, a.date, {r('CASE WHEN p.n >= 252 THEN (lo + (eq + 1) / 2e0) / p.n END', 'ret21_pctile')} FROM r21 a LEFT JOIN p ON a.symbol = p.symbol AND a.date = p.date")
def return_percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.with_return_percentile(S.prices(spark, d)).select("symbol", "date", "ret21_pctile"))


VOLJOIN = {
    "vj": "SELECT px.symbol, px.date, px.close, vol.value AS v0 FROM px LEFT JOIN vol ON px.date = vol.date",
    "vf": "SELECT symbol, date, close, last_value(v0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS vol_own FROM vj",
}
VRANK = {
    "vn": f"SELECT symbol, date, vol_own, row_number() OVER ({W}) AS n FROM vf",
    "vr": """SELECT a.symbol, a.date, count(*) FILTER (WHERE b.vol_own < a.vol_own) / CAST(count(*) AS DOUBLE) AS s, count(b.vol_own) AS k
      FROM vn a JOIN vn b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 251 AND a.n GROUP BY 1, 2""",
    "vrank": "SELECT symbol, date, CASE WHEN k >= 100 THEN s END AS vol_rank_252 FROM vr",
}


@query("vol_rank_252", with_tables("px", "vol", extra=VOLJOIN | VRANK) + f"SELECT symbol, date, {r('vol_rank_252', 'vol_rank_252')} FROM vrank")
def vol_rank_252(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.calendar import on_calendar

    rows = on_calendar(S.prices(spark, d), S.vol_index(spark, d).withColumnRenamed("value", "vol_own"), "vol_own")
    return rounded(features.with_share_below(rows, "vol_own", "vol_rank_252").select("symbol", "date", "vol_rank_252"))


PW = "PARTITION BY a, b ORDER BY date"
CORR = {
    "sgrid": "SELECT s.sector, c.date, x.close FROM (SELECT DISTINCT sector FROM sec) s CROSS JOIN (SELECT DISTINCT date FROM sec) c LEFT JOIN sec x ON x.sector = s.sector AND x.date = c.date",
    "sfill": "SELECT sector, date, last_value(close IGNORE NULLS) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM sgrid",
    "sret": f"SELECT sector, date, c / {lag('c', 1, 'PARTITION BY sector ORDER BY date')} - 1e0 AS x FROM sfill",
    "pairs": "SELECT l.sector AS a, m.sector AS b, l.date, CASE WHEN m.x IS NOT NULL THEN l.x END AS x, CASE WHEN l.x IS NOT NULL THEN m.x END AS y FROM sret l JOIN sret m ON l.date = m.date AND l.sector < m.sector",
    "pc": f"""SELECT date, CASE WHEN count(x) OVER {frame(60, PW)} >= 60 THEN covar_samp(x, y) OVER {frame(60, PW)} / nullif((stddev_samp(x) OVER {frame(60, PW)}) * (stddev_samp(y) OVER {frame(60, PW)}), 0e0) END AS c FROM pairs""",
    "corr": "SELECT date, avg(c) AS corr FROM pc GROUP BY date",
}


@query("pairwise_corr_mean", with_tables("sec", extra=CORR) + f"SELECT date, {r('corr', 'corr')} FROM corr")
def pairwise_corr_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.pairwise_correlation(S.sectors(spark, d)))


MARKET = "1-URGENT"
BETA = RET1 | {
    "bj": f"SELECT r1.symbol, r1.date, CASE WHEN m.ret1 IS NOT NULL THEN r1.ret1 END AS x, CASE WHEN r1.ret1 IS NOT NULL THEN m.ret1 END AS y FROM r1 LEFT JOIN r1 m ON m.symbol = '{MARKET}' AND m.date = r1.date",
    "bb": f"""SELECT symbol, date, CASE WHEN symbol = '{MARKET}' THEN 1e0 WHEN count(x) OVER {frame(60)} >= 60 THEN covar_samp(x, y) OVER {frame(60)} / nullif(var_samp(y) OVER {frame(60)}, 0e0) END AS beta_60 FROM bj""",
}


@query("rolling_beta", with_tables("px", extra=BETA) + f"SELECT symbol, date, {r('beta_60', 'beta_60')} FROM bb")
def rolling_beta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.rolling_beta(S.prices(spark, d), MARKET))


@query("ffill_calendar_join", with_tables("px", "vol", extra=VOLJOIN) + f"SELECT symbol, date, {r('vol_own', 'value')} FROM vf")
def ffill_calendar_join(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.calendar import on_calendar

    return rounded(on_calendar(S.prices(spark, d).select("symbol", "date"), S.vol_index(spark, d), "value"))


@query("asof_rate", with_tables("px", "rates") + f"SELECT px.symbol, px.date, {r('coalesce(rates.rate, 0e0)', 'rate')} FROM px ASOF LEFT JOIN rates ON px.date >= rates.date")
def asof_rate(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.calendar import as_of

    rows = as_of(S.prices(spark, d).select("symbol", "date"), S.rates(spark, d), "rate")
    return rounded(rows.withColumn("rate", F.coalesce("rate", F.lit(0.0))))


EVERY_DAY = {"days": "SELECT symbol, CAST(unnest(generate_series(min(date), max(date) + 3, INTERVAL 1 DAY)) AS DATE) AS date FROM px GROUP BY symbol"}


@query("asof_signal", with_tables("px", extra=EVERY_DAY | RSI | {"known": "SELECT * FROM rsi WHERE rsi14 IS NOT NULL"})
       + f"SELECT d.symbol, d.date, {r('k.rsi14', 'rsi14')} FROM days d ASOF LEFT JOIN known k ON d.symbol = k.symbol AND d.date >= k.date")
def asof_signal(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.calendar import as_of

    px = S.prices(spark, d)
    days = px.groupBy("symbol").agg(F.explode(F.sequence(F.min("date"), F.date_add(F.max("date"), 3))).alias("date"))
    return rounded(as_of(days, features.with_rsi(px).select("symbol", "date", "rsi14"), "rsi14", keys=("symbol",)))


@query("next_event_forward", with_tables("px", "divs", extra={"nx": "SELECT px.symbol, px.date, min(d.ex_date) AS next_day FROM px LEFT JOIN divs d ON d.symbol = px.symbol AND d.ex_date > px.date GROUP BY 1, 2"})
       + f"SELECT nx.symbol, nx.date, next_day, {r('sum(d.amount)', 'next_amount')} FROM nx LEFT JOIN divs d ON d.symbol = nx.symbol AND d.ex_date = nx.next_day GROUP BY 1, 2, 3")
def next_event_forward(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.calendar import next_event

    return rounded(next_event(S.prices(spark, d).select("symbol", "date"), S.dividends(spark, d), "date", "ex_date", "amount"))


@query("dividend_on_date", with_tables("px", "divs") + f"SELECT px.symbol, px.date, {r('sum(d.amount)', 'amount')} FROM px JOIN divs d ON d.symbol = px.symbol AND d.ex_date = px.date GROUP BY 1, 2")
def dividend_on_date(spark: SparkSession, d: str) -> DataFrame:
    paid = S.dividends(spark, d).groupBy("symbol", F.col("ex_date").alias("date")).agg(F.sum("amount").alias("amount"))
    return rounded(S.prices(spark, d).join(paid, ["symbol", "date"]).select("symbol", "date", "amount"))


PANEL = VOLJOIN | VRANK | RSI | MA | DD | RET1 | BETA | CORR | {
    "corrf": "SELECT px.symbol, px.date, last_value(corr.corr IGNORE NULLS) OVER (PARTITION BY px.symbol ORDER BY px.date ROWS UNBOUNDED PRECEDING) AS sector_corr_60 FROM px LEFT JOIN corr ON corr.date = px.date",
    "esh": "SELECT date, ar1 - lag(ar1, 20) OVER (ORDER BY date) AS e FROM eig",
    "eshf": "SELECT px.symbol, px.date, last_value(esh.e IGNORE NULLS) OVER (PARTITION BY px.symbol ORDER BY px.date ROWS UNBOUNDED PRECEDING) AS absorption_shift FROM px LEFT JOIN esh ON esh.date = px.date",
    "own": f"""SELECT symbol, date, close, close / {lag('close', 84)} - 1e0 AS trend_84d, ({roll('stddev_samp', 'ret1', 20)}) * sqrt(252e0) AS rv20 FROM r1""",
    "ddd": f"SELECT symbol, date, {roll('min', 'dd', 60)} AS deep_dd_60 FROM dd0",
    "raw": """SELECT own.symbol, own.date, rsi14, sector_corr_60, trend_84d, own.close / ma200 - 1e0 AS px_vs_ma200, absorption_shift, vol_own, vol_rank_252, vol_own / 1e2 - rv20 AS vrp_proxy, deep_dd_60, beta_60,
      own.close AS px, trend_84d AS ret84, ma200
      FROM own JOIN rsi USING (symbol, date) JOIN corrf USING (symbol, date) JOIN ma USING (symbol, date) JOIN eshf USING (symbol, date) JOIN vf USING (symbol, date) JOIN vrank USING (symbol, date)
      JOIN ddd USING (symbol, date) JOIN bb USING (symbol, date)""",
}
PANEL_TABLES = ("px", "sec", "vol", "eig")
LAGGED = PANEL | {"panel": "SELECT symbol, date, " + ", ".join(f"{lag(c, 1)} AS {c}" for c in (*features.SIGNALS, "px", "ret84", "ma200")) + " FROM raw"}


def panel(spark: SparkSession, d: str) -> DataFrame:
    return features.research_panel(S.prices(spark, d), S.sectors(spark, d), S.vol_index(spark, d), S.eigen(spark, d), MARKET)


def traded(spark: SparkSession, d: str) -> DataFrame:
    return features.signal_panel(S.prices(spark, d), S.sectors(spark, d), S.vol_index(spark, d), S.eigen(spark, d))


@query("lagged_panel", with_tables(*PANEL_TABLES, extra=LAGGED) + f"SELECT symbol, date, {', '.join(r(c, c) for c in features.SIGNALS)} FROM panel")
def lagged_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel(spark, d))


# The traded panel's columns beside those of the researched one.
SIGNAL = PANEL | {
    "rets": f"SELECT symbol, date, {', '.join(f'close / {lag('close', k)} - 1e0 AS ret{k}' for k in (1, 5, 21))} FROM px",
    "r21": f"SELECT symbol, date, ret21 AS x, row_number() OVER ({W}) AS n FROM rets",
    "pct": """SELECT a.symbol, a.date, CASE WHEN count(b.x) >= 252 THEN (count(*) FILTER (WHERE b.x < a.x) + (count(*) FILTER (WHERE b.x = a.x) + 1) / 2e0) / count(b.x) END AS ret21_pctile
      FROM r21 a JOIN r21 b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 755 AND a.n WHERE a.x IS NOT NULL GROUP BY 1, 2""",
    "bands": "SELECT symbol, date, ma20, coalesce(close > ma200, false) AS above_ma200, coalesce(close > ma200 * 1.01e0, false) AS above_ma200_up, coalesce(close > ma200 * 9.9e-1, false) AS above_ma200_dn FROM ma",
    "ddl": "SELECT symbol, date, dd FROM dd0",
    "sraw": """SELECT raw.symbol, raw.date, raw.px, rets.ret1, rets.ret5, rets.ret21, raw.ret84, raw.rsi14, bands.ma20, raw.ma200, above_ma200, above_ma200_up, above_ma200_dn, ddl.dd, raw.deep_dd_60, ret21_pctile, own.rv20,
      raw.sector_corr_60, raw.vol_own, raw.absorption_shift
      FROM raw JOIN rets USING (symbol, date) JOIN bands USING (symbol, date) JOIN ddl USING (symbol, date) JOIN own USING (symbol, date) LEFT JOIN pct USING (symbol, date)""",
}
DOUBLES = ["px", "ret1", "ret5", "ret21", "ret84", "rsi14", "ma20", "ma200", "dd", "deep_dd_60", "ret21_pctile", "rv20", "sector_corr_60", "vol_own", "absorption_shift"]
BANDS = ["above_ma200", "above_ma200_up", "above_ma200_dn"]


@query("signal_panel", with_tables(*PANEL_TABLES, extra=SIGNAL) + f"SELECT symbol, date, {', '.join([*(r(lag(c, 1), c) for c in DOUBLES), *(f'{lag(c, 1)} AS {c}' for c in BANDS)])} FROM sraw")
def signal_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(traded(spark, d))


FWD = {"fw": f"SELECT symbol, date, lead(close, 21) OVER ({W}) / close - 1e0 AS fwd_ret, max(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) / close - 1e0 AS upside_tail FROM px"}


@query("forward_return", with_tables("px", extra=FWD) + f"SELECT symbol, date, {r('fwd_ret', 'fwd_ret')} FROM fw")
def forward_return(spark: SparkSession, d: str) -> DataFrame:
    return rounded(targets.forward_return(S.prices(spark, d)))


@query("forward_max_return", with_tables("px", extra=FWD) + f"SELECT symbol, date, {r('upside_tail', 'upside_tail')} FROM fw")
def forward_max_return(spark: SparkSession, d: str) -> DataFrame:
    return rounded(targets.forward_max(S.prices(spark, d)))


TARGETS = VOLJOIN | FWD | {
    "tg": f"""SELECT fw.symbol, fw.date, fw.fwd_ret, fw.fwd_ret - m.fwd_ret AS fwd_ret_rel, fw.upside_tail, vol_own / 1e2 * sqrt(21 / 2.52e2) AS sigma
      FROM fw JOIN vf USING (symbol, date) LEFT JOIN fw m ON m.symbol = '{MARKET}' AND m.date = fw.date""",
    "targets": "SELECT *, fwd_ret / nullif(sigma, 0e0) AS vol_norm_ret, " + ", ".join(f"CASE WHEN upside_tail > sigma * {m}e0 THEN 1e0 ELSE 0e0 END AS {targets.breach(m)}" for m in targets.MULTIPLES) + " FROM tg",
}
BREACHES = [targets.breach(m) for m in targets.MULTIPLES]


def labels(spark: SparkSession, d: str) -> DataFrame:
    return targets.target_panel(S.prices(spark, d), S.vol_index(spark, d), MARKET)


@query("breach_labels", with_tables("px", "vol", extra=TARGETS) + f"SELECT symbol, date, {', '.join(BREACHES)} FROM targets")
def breach_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).select("symbol", "date", *BREACHES)


@query("vol_norm_return", with_tables("px", "vol", extra=TARGETS) + f"SELECT symbol, date, {r('vol_norm_ret', 'vol_norm_ret')}, {r('fwd_ret_rel', 'fwd_ret_rel')} FROM targets")
def vol_norm_return(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels(spark, d).select("symbol", "date", "vol_norm_ret", "fwd_ret_rel"))


def bin_sql(bin: str) -> str:
    """The label of a day's bin: the Friday or Sunday that ends its week, or its month's end."""
    return {
        "friday": "CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS DATE)",
        "sunday": "CAST(date + CAST((7 - isodow(date)) % 7 AS INTEGER) AS DATE)",
        "month": "last_day(date)",
    }[bin]


def last_sql(table: str, columns: list[str], bin: str, name: str = "week") -> str:
    cols = ", ".join(f"max_by({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in columns)
    return f"SELECT symbol, {bin_sql(bin)} AS {name}, {cols} FROM {table} GROUP BY 1, 2"


def weekly_sql(table: str, columns: list[str]) -> dict[str, str]:
    """Weekly rows, with the empty weeks in between."""
    return {
        f"{table}_f": last_sql(table, columns, "friday"),
        f"{table}_w": f"""SELECT e.symbol, e.week, {', '.join(columns)} FROM (SELECT symbol, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM {table}_f GROUP BY symbol) e
          LEFT JOIN {table}_f f ON f.symbol = e.symbol AND f.week = e.week""",
    }


@query("weekly_friday_last", with_tables("px", "vol", extra=TARGETS | weekly_sql("targets", ["fwd_ret", "upside_tail"])) + f"SELECT symbol, week, {r('fwd_ret', 'fwd_ret')}, {r('upside_tail', 'upside_tail')} FROM targets_w")
def weekly_friday_last(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.study import weekly

    return rounded(weekly(labels(spark, d).select("symbol", "date", "fwd_ret", "upside_tail")))


@query("month_end_last", with_tables("px", extra={"m": last_sql("px", ["close"], "month", "label")}) + f"SELECT symbol, label, {r('close', 'close')} FROM m")
def month_end_last(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.calendar import resample_last

    return rounded(resample_last(S.prices(spark, d), ["close"], "month"))


@query("week_sunday_last", with_tables("px", extra={"m": last_sql("px", ["close"], "sunday", "label"), "g": "SELECT symbol, CAST(unnest(generate_series(min(label), max(label), INTERVAL 7 DAY)) AS DATE) AS label FROM m GROUP BY symbol"})
       + f"SELECT g.symbol, g.label, {r('close', 'close')} FROM g LEFT JOIN m ON g.symbol = m.symbol AND g.label = m.label")
def week_sunday_last(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.calendar import resample_last

    return rounded(resample_last(S.prices(spark, d), ["close"], "week_sunday"))


@query("calendar_gap_expand", with_tables("px", extra={"g": f"SELECT symbol, date AS session, {lag('date', 1)} AS p FROM px"})
       + "SELECT symbol, session, CAST(unnest(generate_series(coalesce(p + 1, session), session, INTERVAL 1 DAY)) AS DATE) AS day FROM g")
def calendar_gap_expand(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.calendar import day_gaps

    return day_gaps(S.prices(spark, d).withColumnRenamed("date", "session"))


