"""Hilbert-curve sharding: rows sorted along a curve through their metadata.

Each metadata dimension is quantised to a few bits and the cell's index on the
Hilbert curve orders the rows. Cutting that order into runs gives shards that
are compact in every dimension, so a reader that filters on any of them skips
most files by their minima and maxima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import global_rank

SHARDS = 24
BITS = 8


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of cells (dimensions x rows), each below ``2**bits``.

    The axes are turned into the transposed index from the top bit down, undoing
    each subcube's reflection and exchange, then Gray coded and interleaved.
    """
    x = axes.astype(np.int64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[dims - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.pandas_udf(T.LongType())
def _index(cells: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for c in cells:
        yield pd.Series(hilbert_index(np.stack([s.to_numpy(np.int64) for s in c])))


def _hashed(column: str, top: int) -> Column:
    """A name's cell from the first two digits of its MD5, which any engine can take; null goes to the last cell."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(column)), 1, 2), 16, 10).cast("int") % (top + 1), F.lit(top))


def shard(docs: DataFrame, shards: int = SHARDS, keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law ``rows``, shard, slot and grown_shard of each row.

    Dimensions: source and language (hashed), the logarithm of the size, and the
    id's place between the smallest and largest. Row counts of any two shards
    differ by at most one. Ties on the curve are ordered by id and checksum, so a
    hot cell is split like any other run. Null text has size 8 and checksum 0;
    null metadata goes to the last cell of its dimension. With fewer rows than
    shards the last ones stay empty; an empty table gives no rows. ``keep`` adds
    the input row as the struct ``row``, else only the columns named are read.
    """
    top = (1 << BITS) - 1
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    span = max(1, (high or 0) - (low or 0))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    by_id = F.floor((F.coalesce(F.col("doc_id"), F.lit(low or 0)) - F.lit(low or 0)).cast("double") / F.lit(float(span)) * top)
    cells = [
        _hashed("source", top),
        _hashed("lang", top),
        F.least(F.floor(F.log2(size + 0.5) * 8), F.lit(top)),
        by_id,
    ]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    sized = docs.select(
        "doc_id",
        size.alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        *[c.cast("long").alias(f"_d{i}") for i, c in enumerate(cells)],
        *row,
    )
    placed = sized.withColumn("_h", _index("_d0", "_d1", "_d2", "_d3")).drop("_d0", "_d1", "_d2", "_d3")
    ranked = global_rank(placed, ["_h", "doc_id", "text_crc32"], "_r")
    n = ranked.count()
    each, more = divmod(n, shards)
    edge = more * (each + 1)
    r = F.col("_r")
    wide = r < edge
    number = F.when(wide, F.floor(r / F.lit(each + 1))).otherwise(more + F.floor((r - edge) / F.lit(max(each, 1))))
    slot = F.when(wide, r % (each + 1)).otherwise((r - edge) % max(each, 1))
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        number.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_h").alias("curve_index"),
        *(["row"] if keep else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` as one folder per shard, rows in curve order; a large shard gets several files.

    All columns are kept. Folders are named by ``shard``, or by that name with underscores
    before it as long as a column of ``docs`` has it. Null texts are sharded as empty ones
    and stay null; an empty table writes none.
    """
    folder = "shard"
    while folder.lower() in (c.lower() for c in docs.columns):
        folder = f"_{folder}"
    placed = shard(docs, shards, keep=True).select(F.col("shard").alias("_in"), F.col("slot").alias("_at"), "row")
    rows = placed.repartitionByRange("_in", "_at").sortWithinPartitions("_in", "_at")
    rows.select(F.col("_in").alias(folder), *[F.col("row").getField(c).alias(c) for c in docs.columns]).write.partitionBy(folder).parquet(path)
