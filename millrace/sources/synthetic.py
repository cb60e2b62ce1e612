"""Market tables derived from the benchmark tables, as no licensed market data is at hand.

All large inputs are reduced to daily bars by one partial aggregation; everything
after that works on one row per symbol and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.pricing import bs_price
from millrace.functions.windows import computed
from millrace.session import busy_tasks

RATE, CARRY = 0.03, 0.013


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _walk(bars: DataFrame, key: str) -> DataFrame:
    """A smooth positive series from noisy daily bars (key, date, bar)."""
    every = Window.partitionBy(key)
    step = (F.col("bar") / F.avg("bar").over(every) - 1.0) * 0.01
    stepped = bars.withColumn("step", step)
    path = F.sum("step").over(every.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return stepped.select(key, "date", (F.exp(path) * 100.0).alias("close"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, close): a series for each order priority."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return _walk(rows.groupBy("symbol", "date").agg(F.avg("o_totalprice").alias("bar")), "symbol")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sector, date, close): a series for each return flag and line status."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("sector"), F.to_date("l_shipdate").alias("date"), "l_extendedprice"
    )
    return _walk(rows.groupBy("sector", "date").agg(F.avg("l_extendedprice").alias("bar")), "sector")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, dn): the distinct order dates, numbered from 1."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select("date", F.row_number().over(Window.orderBy("date")).alias("dn"))  # one row per day: small at any scale


def vol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, value), with every seventh day missing."""
    rows = calendar(spark, sf_dir).where("dn % 7 <> 0")
    return rows.select("date", ((F.col("dn") * 7 % 11) * 10.0 / 11.0 + 15.0).alias("value"))


def eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ar1) on a calendar of its own, with every fifth day missing."""
    rows = calendar(spark, sf_dir).where("dn % 5 <> 0")
    return rows.select("date", ((F.col("dn") * 13 % 17) * 0.1 / 17.0 + 0.5).alias("ar1"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, rate): one row per month."""
    months = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "MM").alias("date")).distinct()
    index = F.year("date") * 12 + F.month("date")
    return months.select("date", ((index % 40) * 0.0005 + 0.01).alias("rate"))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ex_date, amount): one row per symbol and quarter."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.trunc("o_orderdate", "quarter").alias("q")).distinct()
    index = F.year("q") * 4 + F.quarter("q")
    return rows.select("symbol", F.date_add("q", 14).alias("ex_date"), ((index % 5) * 0.01 + 0.25).alias("amount"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option quotes of every symbol and session around its close."""
    w = Window.partitionBy("symbol").orderBy("date")
    days = prices(spark, sf_dir).withColumn("dn", F.row_number().over(w))
    grid = spark.range(6 * 9 * 2).select(
        F.element_at(F.array(*map(F.lit, (9, 16, 23, 33, 37, 51))), (F.col("id") % 6 + 1).cast("int")).alias("dte"),
        (F.floor(F.col("id") / 6) % 9).cast("int").alias("ki"),
        F.when(F.col("id") < 54, "C").otherwise("P").alias("option_type"),
    )
    # A few bytes a day, but a hundred quotes to price: not for the tasks that so few bytes would be given.
    days = days.repartition(busy_tasks(days), "symbol", "date")
    rows = days.crossJoin(F.broadcast(grid))  # a fixed grid of 108 rows
    # Off the halves, on which a walk that ends where it began would fall and engines round apart.
    rows = rows.withColumn("strike", F.round(F.col("close") * (F.col("ki") * 0.025 + 0.9) + 0.07, 0))
    rows = rows.withColumn("iv0", ((F.col("dn") * 3 + F.col("ki") * 5 + F.col("dte")) % 10) * 0.01 + 0.15)
    t, call = F.col("dte") / F.lit(365.0), F.col("option_type") == "C"
    rows = computed(rows, mid0=bs_price(F.col("close"), F.col("strike"), t, F.col("iv0"), F.lit(RATE), F.lit(CARRY), call))
    half = ((F.col("dn") + F.col("ki") * 3 + F.col("dte")) % 4 + 1) * 0.01
    interest = (F.col("dn") * 37 + F.col("ki") * 11 + F.col("dte") * 5) % 1000
    return rows.select(
        "symbol",
        F.col("date").alias("session"),
        F.date_add("date", F.col("dte")).alias("expiration"),
        "dte",
        "strike",
        "option_type",
        (F.col("mid0") * (1.0 - half)).alias("bid"),
        (F.col("mid0") * (half + 1.0)).alias("ask"),
        F.when(interest % 13 != 0, interest.cast("double")).alias("open_interest"),
        F.col("close").alias("spot"),
    )
