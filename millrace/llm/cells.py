"""Running a function over cells: small groups of rows that meet in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import give_back, partitions


def blocked(rows: DataFrame, blocks: str = "blocks", block: str = "block") -> DataFrame:
    """Send each row of block b to the cells (min, max) of b with every block of its group."""
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    return rows.withColumn("_o", other).withColumn("low", F.least(block, "_o")).withColumn("high", F.greatest(block, "_o")).drop("_o")


def size_blocks(members: DataFrame, unit: list[str], percent: int) -> DataFrame:
    """(unit, block, since, upto): blocks of ``members`` (unit, size, block) with the blocks they can match.

    Blocks of a unit follow its sizes, so those within a ratio of ``percent`` in a
    hundred of a block's sizes are a run of blocks around it. One sort finds both ends.
    """
    spans = members.groupBy(*unit, "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    # A block's reach: the last block whose least size is in reach of its greatest, and the other way round.
    top = spans.select(*unit, F.floor(F.col("most") * 100 / percent).alias("x"), F.lit(1).alias("side"), "block")
    low = spans.select(*unit, F.col("least").alias("x"), F.lit(0).alias("side"), "block")
    by = Window.partitionBy(*unit).orderBy("x", "side", "block").rowsBetween(Window.unboundedPreceding, 0)
    upto = low.union(top).withColumn("upto", F.max(F.when(F.col("side") == 0, F.col("block"))).over(by)).where("side = 1")
    first = spans.select(*unit, F.ceil(F.col("least") * percent / 100).alias("x"), F.lit(1).alias("side"), "block")
    high = spans.select(*unit, F.col("most").alias("x"), F.lit(0).alias("side"), "block")
    back = Window.partitionBy(*unit).orderBy(F.desc("x"), "side", F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    since = high.union(first).withColumn("since", F.min(F.when(F.col("side") == 0, F.col("block"))).over(back)).where("side = 1")
    keys = [*unit, "block"]
    return since.select(*keys, "since").join(upto.select(*keys, "upto"), keys)


def run_cells(rows: DataFrame, keys: list[str], each: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Call ``each`` with the rows of every cell; it returns rows of ``schema``, of int and long columns.

    Cells are dealt out by their keys and come one after the other, so a task holds
    one cell at a time.
    """
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [{"int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds[k]) for k in range(len(names))], names)

        cell, held = None, []
        for b in batches:
            found: list[tuple] = []
            for at in range(0, len(b), 256):
                for r in b.slice(at, 256).to_pylist():
                    key = tuple(r[k] for k in keys)
                    if key != cell:
                        if held:
                            found += each(held)
                        cell, held = key, []
                    held.append(r)
            yield made(found)
        if held:
            yield made(each(held))
        give_back()

    dealt = rows.repartition(partitions(rows), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)
