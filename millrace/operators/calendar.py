"""Calendar and as-of operators: alignment of series that tick on different days."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.windows import ffill, friday, last_known, ordered, sunday
from millrace.session import staged


def on_calendar(days: DataFrame, series: DataFrame, value: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Exact-date join of a series onto ``days``, then forward fill.

    Values dated between two days of the calendar are lost: this is not an as-of join.
    """
    on = [c for c in (*keys, "date") if c in series.columns]
    joined = days.join(series.select(*on, value), on, "left")
    return joined.withColumn(value, ffill(F.col(value), ordered(list(keys))))


def as_of(left: DataFrame, right: DataFrame, value: str, left_time: str = "date", right_time: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """Add the latest ``value`` at or before each left row's time, by one sort of both sides.

    With keys both sides are stacked, the right rows first within a day, and the last
    value is carried on: one shuffle on the keys instead of a range join. Without keys
    there is nothing to deal rows out by, so the times that occur, each once, are range
    partitioned (``carried``) and looked up by the left rows.
    """
    if not keys:
        times = left.select(F.col(left_time).alias("_t")).where("_t is not null")
        found = carried(times, right.select(F.col(right_time).alias("_t"), F.col(value).alias("_v")))
        return left.join(found, left[left_time] == found["_t"], "left").select(left["*"], found["_f"].alias(value))
    tag = [F.col(k) for k in keys]
    stack = left.select(*tag, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct("*").alias("_row"))
    known = right.where(F.col(value).isNotNull()).select(*tag, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    known = known.withColumn("_row", F.lit(None).cast(stack.schema["_row"].dataType))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = stack.unionByName(known).withColumn("_f", F.last("_v", ignorenulls=True).over(w))
    return out.where("_side = 1").select("_row.*", F.col("_f").alias(value))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``_f``: ``_v`` with nulls replaced by the last value before them in the partition."""
    last = None
    for b in batches:
        v = b.column("_v")
        v = v if last is None else pa.concat_arrays([last, v])
        filled = pc.fill_null_forward(v)
        found = filled if last is None else filled.slice(1)
        if len(filled):
            last = filled.slice(len(filled) - 1, 1)
        yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "_f"])


def carried(times: DataFrame, known: DataFrame) -> DataFrame:
    """(_t, _f): the latest value of ``known(_t, _v)`` at or before each distinct time of ``times(_t)``.

    The distinct times of both sides go through a range exchange. Every partition carries
    its own values on in the order of time, and is handed the last value before its first
    row: only the last value of each partition meets those of the others. Of several
    values at one time the greatest counts.
    """
    known = known.where(F.col("_v").isNotNull()).groupBy("_t").agg(F.max("_v").alias("_v"))
    both = times.distinct().join(known, "_t", "full_outer")
    ranged = both.repartitionByRange("_t").sortWithinPartitions("_t").select("_t", "_v")
    wider = T.StructType([*ranged.schema.fields, T.StructField("_f", ranged.schema["_v"].dataType)])
    placed = staged(ranged.mapInArrow(_filled, wider).withColumn("_part", F.spark_partition_id()), "carried")
    # A row per partition: what it ends with, or else what the one before it ends with.
    ends = placed.groupBy("_part").agg(F.max_by("_f", "_t").alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    handed = ends.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(handed), "_part").select("_t", F.coalesce("_f", "_before").alias("_f"))


def next_event(left: DataFrame, events: DataFrame, day: str, event_day: str, amount: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add the first event day strictly after each row's day, and that day's total amount."""
    daily = events.groupBy(*keys, F.col(event_day).alias("_t")).agg(F.sum(amount).alias("_a"))
    stack = left.select(*keys, F.col(day).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("struct<d:date,a:double>").alias("_e"), F.struct("*").alias("_row"))
    ahead = daily.select(*keys, "_t", F.lit(0).alias("_side"), F.struct(F.col("_t").alias("d"), F.col("_a").cast("double").alias("a")).alias("_e"))
    both = stack.unionByName(ahead.withColumn("_row", F.lit(None).cast(stack.schema["_row"].dataType)))
    # Backwards in time, a day's rows come before its events, so an event never serves its own day.
    w = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_n", F.last("_e", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", F.col("_n.d").alias("next_day"), F.col("_n.a").alias("next_amount"))


def day_gaps(sessions: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The calendar days of each gap (previous session, session]."""
    prev = F.lag("session").over(Window.partitionBy(*keys).orderBy("session"))
    rows = sessions.select(*keys, "session", prev.alias("prev"))
    first = F.when(F.col("prev").isNull(), F.col("session")).otherwise(F.date_add("prev", 1))
    return rows.select(*keys, "session", F.explode(F.sequence(first, F.col("session"))).alias("day"))


BINS = {"week_friday": friday, "week_sunday": sunday, "month": F.last_day, "year": lambda d: F.trunc(d, "year")}


def resample_last(rows: DataFrame, values: list[str], bin: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The last non-null value of each column in each bin; bins without rows in between are null."""
    label = BINS[bin](F.col("date"))
    found = rows.groupBy(*keys, label.alias("label")).agg(*[last_known(v).alias(v) for v in values])
    if bin not in ("week_friday", "week_sunday"):
        return found
    spans = found.groupBy(*keys).agg(F.min("label").alias("a"), F.max("label").alias("b"))
    every = spans.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("label"))
    return every.join(found, [*keys, "label"], "left")
