"""Readers of market tables in their usual layout, and the checks they are due."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions.quotes import rel_spread

#: Above this an annual rate must be in percent.
MAX_RATE = 0.30
ZONE = "US/Eastern"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches, asked of the file system that the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def option_chains(spark: SparkSession, root: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """The monthly chain files of all symbols, or of those named, as one scan with the derived columns.

    ``symbol`` and the month ``ym`` come from each file's path, so a predicate on them
    leaves files out when the scan is planned, before any is opened.
    """
    names = sorted({s.lower() for s in symbols}) if symbols is not None else ["*"]
    for path in (paths := [f"{root}/options/{s}/chain_*.parquet" for s in names]):
        if not exists(spark, path):
            raise FileNotFoundError(path)
    where = F.url_decode("_metadata.file_path")
    rows = spark.read.schema(schemas.CHAIN).parquet(*paths).select(
        "*", F.upper(F.regexp_extract(where, r"/options/([^/]+)/chain_", 1)).alias("symbol"), F.regexp_extract(where, r"/chain_(\d{4}-\d{2})\.parquet", 1).alias("ym")
    )
    return derive_chain(rows)


def option_chain(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    """A symbol's monthly chain files with the derived columns, and their month as ``ym``."""
    return option_chains(spark, root, [symbol])


def derive_chain(rows: DataFrame) -> DataFrame:
    """Session (exchange date), days to expiry, mid and relative spread of each quote."""
    session = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), ZONE))
    rows = rows.withColumn("session", session).withColumn("expiration", F.to_date("expiration"))
    return rows.select(
        "*", F.datediff("expiration", "session").alias("dte"), ((F.col("bid") + F.col("ask")) / 2.0).alias("mid"), rel_spread(F.col("bid"), F.col("ask")).alias("rel_spread")
    )


def session_calendar(chain: DataFrame) -> DataFrame:
    return chain.select("symbol", "session").distinct()


def session_chain(chain: DataFrame, day: str) -> DataFrame:
    """One session's quotes: the month leaves out other files, the day's instants other row groups."""
    rows = chain.where(F.col("session") == F.lit(day).cast("date"))
    if "ts" in chain.columns:
        begin, end = (F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), k).cast("timestamp"), ZONE) for k in (0, 1))
        rows = rows.where((F.col("ts") >= begin) & (F.col("ts") < end))
    return rows.where(F.col("ym") == day[:7]) if "ym" in chain.columns else rows


def session_spot(chain: DataFrame) -> DataFrame:
    """(symbol, session, spot); a session with more than one underlying price is an error."""
    spots = chain.groupBy("symbol", "session").agg(F.min("underlying_price").alias("spot"), F.max("underlying_price").alias("high"))
    clash = F.raise_error(F.concat(F.lit("two underlying prices on "), F.col("session").cast("string"))).cast("double")
    return spots.select("symbol", "session", F.when(F.col("spot") == F.col("high"), F.col("spot")).otherwise(clash).alias("spot"))


def daily_prices(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/prices_long/{symbol}.parquet")
    return rows.select(F.lit(symbol).alias("symbol"), F.to_date("date").alias("date"), *[F.col(c).cast("double") for c in ("open", "high", "low", "close", "adjClose")])


def adjusted_series(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    return daily_prices(spark, root, symbol).select("symbol", "date", F.col("adjClose").alias("close"))


def dividends(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    """A symbol's ex-dividend events; a symbol without the file has none."""
    path = f"{root}/prices_long/{symbol}_dividends.parquet"
    rows = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schemas.DIVIDENDS)
    return rows.select(F.lit(symbol).alias("symbol"), F.to_date("ex_date").alias("ex_date"), F.col("amount").cast("double").alias("amount"))


def checked_rates(rates: DataFrame) -> DataFrame:
    """Rates as decimals; the read fails if the largest can only be a percentage."""
    top = rates.agg(F.max("rate")).first()[0]
    if top is not None and top > MAX_RATE:
        raise ValueError(f"rates look like percentages: largest {top}")
    return rates


def treasury_rates(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/rates/tbill_4w.parquet")
    return checked_rates(rows.select(F.to_date("date").alias("date"), F.col("rate").cast("double").alias("rate")))


# Each fund's own volatility index.
VOL_OF = {"SPY": "VIX", "QQQ": "VXN", "IWM": "RVX"}


def vol_series(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    """(date, value) of a fund's volatility index, from column ``vix`` or else ``close``; empty for others."""
    if symbol not in VOL_OF:
        return spark.createDataFrame([], schemas.RATES).select("date", F.col("rate").alias("value"))
    rows = spark.read.parquet(f"{root}/prices_long/{VOL_OF[symbol]}.parquet")
    value = "vix" if "vix" in rows.columns else "close"
    return rows.select(F.to_date("date").alias("date"), F.col(value).cast("double").alias("value"))


# The sector funds.
SECTORS = ("XLB", "XLE", "XLF", "XLI", "XLK", "XLP", "XLU", "XLV", "XLY")


def sector_series(spark: SparkSession, root: str) -> DataFrame:
    """(sector, date, close) of all sector funds as one scan, from the sectors folder or else beside the other prices."""
    nested = {s: f"{root}/prices_long/sectors/{s}.parquet" for s in SECTORS}
    paths = [path if exists(spark, path) else f"{root}/prices_long/{s}.parquet" for s, path in nested.items()]
    name = F.regexp_extract(F.url_decode("_metadata.file_path"), rf"/({'|'.join(SECTORS)})\.parquet", 1)
    return spark.read.parquet(*paths).select(name.alias("sector"), F.to_date("date").alias("date"), F.col("adjClose").cast("double").alias("close"))


def eigen_features(spark: SparkSession, root: str) -> DataFrame:
    """(date, ar1); the date was stored as a nameless index."""
    rows = spark.read.parquet(f"{root}/prices_long/eigen_features_long.parquet")
    date = next(c for c in ("date", "__index_level_0__") if c in rows.columns)
    return rows.select(F.to_date(date).alias("date"), F.col("ar1").cast("double").alias("ar1"))
