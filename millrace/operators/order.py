"""Order statistics and ranks within keys, whatever share of the rows a key or a value holds.

Equal values of a key are counted first, with map-side sums, so a hot value is one row.
The distinct values then go through a range exchange that cuts keys wherever they are
long, and running counts within each partition, put together with the partitions' totals,
say how many of a key's rows lie below each value. No task sees a key whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import staged


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the running sum of ``m`` over a partition."""
    before = 0
    for b in batches:
        upto = pc.add(pc.cumulative_sum(b.column("m")), before)
        if len(b):
            before = upto[-1].as_py()
        yield pa.RecordBatch.from_arrays([*b.columns, upto], [*b.schema.names, "_upto"])


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls are equal, with the keys once."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, on, how).drop(*(f"_right_{k}" for k in keys))


def tallied(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, m, before, n): each distinct value, how many rows have it and how many of its key's rows are less, of n in all.

    Nulls count for nothing: a key's null has m 0 and stands before its values.
    """
    by = [*keys, value]
    counts = rows.groupBy(*by).agg(F.count(value).alias("m"))
    ranged = counts.repartitionByRange(*by).sortWithinPartitions(*by)
    wider = T.StructType([*ranged.schema.fields, T.StructField("_upto", T.LongType())])
    placed = staged(ranged.mapInArrow(_counted, wider).withColumn("_part", F.spark_partition_id()), "tallied")
    base, bases = 0, []
    for part, n in sorted(placed.groupBy("_part").agg(F.sum("m")).collect()):  # a number per task
        bases.append((part, base))
        base += n
    known = rows.sparkSession.createDataFrame(bases, "_part int, _base long")
    placed = placed.join(F.broadcast(known), "_part").withColumn("_at", F.col("_base") + F.col("_upto") - F.col("m"))
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.sum("m").alias("n"))
    return _joined(placed, first, keys).select(*by, "m", (F.col("_at") - F.col("_first")).alias("before"), "n")


def quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: tuple[float, ...]) -> DataFrame:
    """(keys, n, quantiles): exact linear quantiles of each key's values that are not null, an array in the order of ``probabilities``.

    Only the two neighbours of each quantile leave the task that holds them. A key
    without values has 0 and nulls.
    """
    places = [(F.col("n") - 1) * F.lit(q) for q in probabilities]

    def at(place: Column) -> Column:
        """The value that holds a place in its key's order."""
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("m")), F.col(value)))

    ends = F.array(*[F.struct(at(F.floor(x)).alias("low"), at(F.ceil(x)).alias("high")) for x in places])
    found = tallied(rows, keys, value).groupBy(*keys).agg(F.max("n").alias("n"), ends.alias("_ends"))
    end = lambda k, side: F.get("_ends", F.lit(k))[side]
    values = [end(k, "low") + (end(k, "high") - end(k, "low")) * (x - F.floor(x)) for k, x in enumerate(places)]
    return found.select(*keys, "n", F.array(*values).alias("quantiles"))


def with_average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add the rank by value within keys, from 1; equal values share the mean of their ranks, nulls have none."""
    ranks = tallied(rows, keys, value).where("m > 0").select(*keys, value, (F.col("before") + (F.col("m") + 1) / 2.0).alias(name))
    return _joined(rows, ranks, [*keys, value], "left")
