"""Pieces shared by the corpus operators: staged tables, global ranks, components.

Lineage is cut by writing Parquet under the folder that the session names in
``spark.checkpoint.dir``. Every executor and the driver see that folder, so a
staged table survives the loss of any executor.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: the six ASCII characters.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def give_back() -> None:
    """Return a Python worker's freed memory to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="millrace-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    A folder of this process serves local mode only, where driver and executors are one
    process; on a cluster without a shared folder this is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    for held in _scopes.get():
        held.append(path)
    return path


#: Paths made inside each open ``scratch`` block of this thread of work; others have blocks of their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete all that was staged inside the block when it ends.

    For callers that write a result inside the block: frames that read staged tables
    cannot be used after it.
    """
    held: list[str] = []
    before = _scopes.set((*_scopes.get(), held))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in held:
            _delete(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_millrace_path", None):
            _delete(df.sparkSession, path)


#: Bytes of files read that one task of an exchange should stand for.
TASK_BYTES = 256 << 20


def partitions(df: DataFrame) -> int:
    """Tasks of an exchange of ``df``: the session's number, or more where the files it reads call for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [found.apply(k) for k in range(found.size())]
    size = sum(int(str(x.stats().sizeInBytes())) for x in leaves if x.getClass().getSimpleName() == "LogicalRelation")
    return max(least, size // TASK_BYTES)


#: A key with more than this share of all rows, one in HOT_KEYS, is hot. There are fewer than HOT_KEYS such keys.
HOT_KEYS = 512


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", n: str = "n", total: int | None = None) -> DataFrame:
    """Join ``right``, of one row per key, to the rows of ``left`` that share the key.

    ``right`` has the number ``n`` of left rows of each key, ``total`` in all. Rows of
    hot keys stay where they are and get their fewer than ``HOT_KEYS`` partners, fixed-size
    rows, by broadcast; all others meet by an exchange in which no key holds more than
    one in ``HOT_KEYS`` of the rows. ``n`` is dropped. Null keys find nothing. Without
    hot keys this is a plain join.
    """
    if total is None:
        total = right.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_KEYS > total
    few = right.where(is_hot).drop(n).collect()
    if not few:
        return left.join(right.drop(n), keys, how)
    hot = right.sparkSession.createDataFrame(few, right.drop(n).schema)
    cold = right.where(~is_hot).drop(n)
    near = left.join(F.broadcast(hot), keys)
    far = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(far)


_LOW = (1 << 33) - 1


def global_rank(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys``.

    A range exchange puts neighbours together, each partition sorts its own rows,
    and only the row count of each partition reaches the driver. Rows equal in all
    keys get adjacent positions in any order. A hot key is split as long as
    ``keys`` end in something that tells its rows apart.
    """
    spark = df.sparkSession
    ranged = stage(
        df.repartitionByRange(partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_at", 33).cast("int")
    counts = sorted(ranged.groupBy(part.alias("p")).count().collect())
    base, before = [], 0
    for p, n in counts:
        base.append((p, before))
        before += n
    bases = spark.createDataFrame(base, "_part int, _base long")
    out = (
        ranged.withColumn("_part", part)
        .join(F.broadcast(bases), "_part")
        .withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit(_LOW)))
        .drop("_part", "_base", "_at")
    )
    out._millrace_path = ranged._millrace_path
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected ``edges(a, b)`` as rows (node, component).

    Alternating large-star and small-star steps. A step takes each node's least
    neighbour with map-side minima and joins it back by ``beside``, so a node with a
    large share of all edges is split among tasks. Each round is staged; only a row
    count and a checksum reach the driver. Nodes without edges do not appear.
    ``component`` is the smallest node reachable.
    """
    cur = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))

    seen = mark(cur)
    while seen[0]:
        both = cur.union(cur.select("b", "a"))
        around = beside(both.where("b > a"), least(both), ["a"], total=2 * seen[0])
        large = stage(around.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: every node has only smaller neighbours left; hang them under the smallest.
        below = least(large)
        small = beside(large, below, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = stage(small.union(below.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = mark(nxt)
        unstage(cur, large)
        cur = nxt
        if now == seen:
            break
        seen = now
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, out of reach of name clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col("row").getField(f.name).alias(f.name) for f in like.schema.fields])


#: Row numbers that are sent to every task instead of all rows being dealt out: 8 MB.
FEW = 1 << 20


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows numbered in ``gone(rid)``, all columns kept.

    ``gone`` is staged and counted; up to ``FEW`` numbers are broadcast, more are joined.
    """
    gone = stage(gone, "gone")
    rows = packed(docs).withColumn("rid", F.monotonically_increasing_id())
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    return unpacked(rows.join(gone, "rid", "left_anti"), docs)


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
