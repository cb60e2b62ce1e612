"""Sinks: partitioned Parquet logs, JSON documents, CSV summaries, the compact bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIDE = 5


def write_logs(log: DataFrame, path: str, keys: tuple[str, ...] = ("symbol", "strategy")) -> None:
    """A log as Parquet, partitioned by run; nothing is written for an empty one."""
    if not log.isEmpty():
        log.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # one row per run


def write_json(rows: DataFrame, path: str) -> None:
    """One document per row. Missing and infinite figures are null, which JSON can hold."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def nested(rows: DataFrame, outer: list[str], inner: str, values: list[str]) -> DataFrame:
    """Rows of cells as a map of structs per outer key, as research documents hold them."""
    entries = F.collect_list(F.struct(F.col(inner).cast("string"), F.struct(*values)))
    return rows.groupBy(*outer).agg(F.map_from_entries(F.array_sort(entries)).alias("cells"))


def strided(curve: DataFrame, keys: list[str], order: str, step: int = STRIDE) -> DataFrame:
    """Every ``step``-th row of each curve, from its first."""
    numbered = curve.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return numbered.where((F.col("_n") - 1) % step == 0).drop("_n")


def bundle(summary: DataFrame, curve: DataFrame, keys: list[str]) -> DataFrame:
    """A document per run: its summary and its thinned equity curve."""
    points = strided(curve, keys, "session").select(*keys, F.struct(F.date_format("session", "yyyy-MM-dd").alias("d"), F.col("equity").alias("v")).alias("p"))
    return summary.join(points.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("curve")), keys)
