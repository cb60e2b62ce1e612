"""Registered queries of files: tables written in the layout of market data and read back, and the sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import metrics
from millrace.plans.catalog import query, r, rounded
from millrace.plans.catalog_options import EQ, EQ_SELECT, MID, REL, curves
from millrace.plans.oracle_base import with_tables
from millrace.session import scratch_path
from millrace.sources import market, sinks
from millrace.sources import synthetic as S


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def write_chains(spark: SparkSession, d: str, root: str) -> None:
    """Monthly snapshot files of every symbol under ``root``."""
    late = F.to_utc_timestamp(F.col("session").cast("timestamp") + F.expr("interval 15 hours 45 minutes"), market.ZONE)
    rows = S.chain(spark, d).select(
        late.alias("ts"), "expiration", "strike", "option_type", "bid", "ask", "open_interest", F.col("spot").alias("underlying_price"),
        F.lower("symbol").alias("sym"), F.date_format("session", "yyyy-MM").alias("ym"),
    )
    rows.repartition("sym", "ym").write.partitionBy("sym", "ym").parquet(f"{root}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for sym in fs.listStatus(path(f"{root}/parts")):
        if not sym.isDirectory():
            continue
        name = sym.getPath().getName().split("=", 1)[1]
        fs.mkdirs(path(f"{root}/options/{name}"))
        for month in fs.listStatus(sym.getPath()):
            fs.rename(month.getPath(), path(f"{root}/options/{name}/chain_{month.getPath().getName().split('=', 1)[1]}.parquet"))


def chains(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "chains")
    write_chains(spark, d, root)
    return market.option_chains(spark, root)


@query("read_chain", with_tables("chain") + f"SELECT symbol, session, dte, strike, option_type, strftime(session, '%Y-%m') AS ym, {r(MID, 'mid')}, {r(REL, 'rel_spread')} FROM chain")
def read_chain(spark: SparkSession, d: str) -> DataFrame:
    rel = F.when(F.col("mid") > 0, F.col("rel_spread")).alias("rel_spread")
    return rounded(chains(spark, d).select("symbol", "session", "dte", "strike", "option_type", "ym", "mid", rel))


@query("read_sessions", with_tables("px") + f"SELECT symbol, date AS session, {r('close', 'spot')} FROM px")
def read_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The session calendar of every symbol's files, with the price of each session."""
    chain = chains(spark, d)
    return rounded(market.session_calendar(chain).join(market.session_spot(chain), ["symbol", "session"]))


#: The session that ``one_session`` reads.
SESSION = "1995-03-15"


@query("one_session", with_tables("chain") + f"SELECT symbol, session, dte, strike, option_type, {r(MID, 'mid')} FROM chain WHERE session = DATE '{SESSION}'")
def one_session(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol's quotes of one session, from one file of each."""
    return rounded(market.session_chain(chains(spark, d), SESSION).select("symbol", "session", "dte", "strike", "option_type", "mid"))


#: The volatility index's files, two with their value under another name.
INDICES = {"SPY": "vix", "QQQ": "close", "IWM": "close"}


def write_series(spark: SparkSession, d: str, root: str) -> list[str]:
    """Price, dividend, rate, index, sector and eigen files under ``root``; the first symbol pays no dividends."""
    px, paid = S.prices(spark, d).cache(), S.dividends(spark, d)
    symbols = [x.symbol for x in px.select("symbol").distinct().orderBy("symbol").collect()]  # a handful of series
    write = lambda df, path: df.coalesce(1).write.parquet(f"{root}/{path}")
    for s in symbols:
        one = px.where(F.col("symbol") == s)
        write(one.select("date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close", "adjClose")]), f"prices_long/{s}.parquet")
        if s != symbols[0]:
            write(paid.where(F.col("symbol") == s).select("ex_date", "amount"), f"prices_long/{s}_dividends.parquet")
    px.unpersist()
    write(S.rates(spark, d), "rates/tbill_4w.parquet")
    write(S.eigen(spark, d), "prices_long/eigen_features_long.parquet")
    for fund, column in INDICES.items():
        write(S.vol_index(spark, d).select("date", F.col("value").alias(column)), f"prices_long/{market.VOL_OF[fund]}.parquet")
    sectors = S.sectors(spark, d)
    names = [x.sector for x in sectors.select("sector").distinct().orderBy("sector").collect()]
    for k, s in enumerate(market.SECTORS):
        folder = "prices_long/sectors" if k % 2 else "prices_long"
        write(sectors.where(F.col("sector") == names[k % len(names)]).select("date", F.col("close").alias("adjClose")), f"{folder}/{s}.parquet")
    return symbols


SECTOR_NAMES = "(SELECT unnest([" + ", ".join(f"'{s}'" for s in market.SECTORS) + f"]) AS fund, unnest(range({len(market.SECTORS)})) AS k)"
SERIES = {
    "nm": "SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS j, count(*) OVER () AS many FROM (SELECT DISTINCT sector FROM sec)",
    "every": f"""SELECT 'price' AS kind, symbol AS name, date, close AS value FROM px
      UNION ALL SELECT 'dividend', symbol, ex_date, amount FROM divs WHERE symbol <> (SELECT min(symbol) FROM px)
      UNION ALL SELECT 'rate', '', date, rate FROM rates UNION ALL SELECT 'eigen', '', date, ar1 FROM eig
      UNION ALL SELECT 'index', fund, date, value FROM vol CROSS JOIN (SELECT unnest(['SPY', 'QQQ', 'IWM']) AS fund)
      UNION ALL SELECT 'sector', fund, date, close FROM {SECTOR_NAMES} JOIN nm ON j = k % many JOIN sec USING (sector)""",
}


@query("read_series", with_tables("px", "divs", "rates", "eig", "vol", "sec", extra=SERIES) + f"SELECT kind, name, date, {r('value', 'value')} FROM every")
def read_series(spark: SparkSession, d: str) -> DataFrame:
    """Every reader of daily series, over files in the layout it expects."""
    root = scratch_path(spark, "series")
    symbols = write_series(spark, d, root)
    row = lambda df, kind, name, date, value: df.select(F.lit(kind).alias("kind"), name.alias("name"), F.col(date).alias("date"), F.col(value).alias("value"))
    parts = [row(market.adjusted_series(spark, root, s), "price", F.col("symbol"), "date", "close") for s in symbols]
    parts += [row(market.dividends(spark, root, s), "dividend", F.col("symbol"), "ex_date", "amount") for s in symbols]
    parts += [row(market.vol_series(spark, root, s), "index", F.lit(s), "date", "value") for s in (*INDICES, "DIA")]
    parts.append(row(market.treasury_rates(spark, root), "rate", F.lit(""), "date", "rate"))
    parts.append(row(market.eigen_features(spark, root), "eigen", F.lit(""), "date", "ar1"))
    parts.append(row(market.sector_series(spark, root), "sector", F.col("sector"), "date", "close"))
    return rounded(_all(parts))


SINKS = EQ | {"all_": f"{EQ_SELECT} FROM fin", "kinds": "SELECT unnest(['csv', 'json', 'parquet', 'bundle']) AS sink"}


@query("sink_round_trip", with_tables("px", "rates", extra=SINKS) + f"""SELECT sink, symbol, sessions, {r('final_equity', 'final_equity')}, {r('max_drawdown', 'max_drawdown')},
CASE sink WHEN 'parquet' THEN sessions WHEN 'bundle' THEN (sessions + 4) // 5 END AS points FROM all_ CROSS JOIN kinds""")
def sink_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Summaries as CSV, JSON and in the bundle, and curves as Parquet by run, all read back."""
    root = scratch_path(spark, "sinks")
    equity = curves(spark, d)
    summary = metrics.equity_metrics(equity, ["symbol"], S.rates(spark, d))
    sinks.write_summary_csv(summary, f"{root}/csv")
    sinks.write_json(summary, f"{root}/json")
    sinks.write_json(sinks.bundle(summary, equity, ["symbol"]), f"{root}/bundle")
    sinks.write_logs(equity, f"{root}/log", ("symbol",))
    columns = ["symbol", "sessions", "final_equity", "max_drawdown"]
    kinds = "symbol string, sessions long, final_equity double, max_drawdown double"
    csv = spark.read.option("header", True).csv(f"{root}/csv").select("symbol", *[F.col(c).cast(k).alias(c) for c, k in (x.split() for x in kinds.split(", ")[1:])])
    back = [csv.withColumn("sink", F.lit("csv")), spark.read.schema(kinds).json(f"{root}/json").withColumn("sink", F.lit("json"))]
    back = [b.withColumn("points", F.lit(None).cast("long")) for b in back]
    bundle = spark.read.schema(kinds + ", curve array<struct<d:string,v:double>>").json(f"{root}/bundle")
    back.append(bundle.select(*columns, F.lit("bundle").alias("sink"), F.size("curve").cast("long").alias("points")))
    log = spark.read.parquet(f"{root}/log").groupBy("symbol").agg(F.count("*").alias("sessions"), F.max_by("equity", "session").alias("final_equity"), F.count("*").alias("points"))
    back.append(log.join(csv.select("symbol", "max_drawdown"), "symbol").withColumn("sink", F.lit("parquet")))
    return rounded(_all([b.select("sink", *columns, "points") for b in back]))
