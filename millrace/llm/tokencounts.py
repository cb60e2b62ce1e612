"""Token counts from flat, unindexed token files by a vectorised separator scan.

A token file is nothing but unsigned 16-bit ids, each document followed by the
end-of-document id. Files of any size are read in blocks, the reader's byte ranges,
by as many tasks as there are blocks. A block is searched for the id's two bytes
all at once, without knowing where in the file it starts. A prefix scan over the
blocks' lengths then gives every block its place, which tells real ids from pairs
of bytes that straddle two; an id cut by a block's edge is put together from the
edges. A second prefix scan, over the blocks' numbers of ends and last ends,
stitches the documents that cross a block or a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import give_back, new_path, stage
from millrace.llm.tokens import encoder

END = 49407


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END) -> None:
    """One file per partition of ``docs``: the ids of each text, then ``end_id``.

    Special tokens' strings in a text are ordinary text, so ``end_id`` ends documents
    only. The text writer puts the separator's two bytes after each row's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "<u2", True)
        for b in batches:
            for at in range(0, len(b), 512):
                texts = [t or b"" for t in b.column(0).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(enc.encode(texts), pa.binary())], ["ids"])
        give_back()

    end = np.array([end_id], "<u2").tobytes().decode("latin-1")
    ids = docs.select(F.col("text").cast("binary")).mapInArrow(run, "ids binary")
    ids.select(F.col("ids").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", end).text(path)


def _scan(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """Per block its length in bytes and its edge bytes (kind 1), and where in it the separator's bytes stand (kind 0).

    The line reader deals out byte ranges of files and knows no other way to; lines end
    at the separator's first byte here, so they are no longer than documents, and
    put together again they are the block's bytes.
    """
    first, second = np.array([end_id], "<u2").view(np.uint8).tolist()
    names = ["file", "block", "kind", "at", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(key: tuple, kind: int, at: np.ndarray, head: int, tail: int) -> pa.RecordBatch:
            n = len(at)
            fixed = [pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1], np.int64)), pa.array(np.full(n, kind, np.int32))]
            edges = [pa.array(np.full(n, x, np.int32)) for x in (head, tail)]
            return pa.RecordBatch.from_arrays([*fixed, pa.array(at.astype(np.int64)), *edges], names)

        key, size, head, last = None, 0, 0, b""
        for b in batches:
            files, starts, lines = (b.column(k).to_pylist() for k in range(3))
            at = 0
            while at < len(lines):
                upto = at
                while upto < len(lines) and (files[upto], starts[upto]) == (files[at], starts[at]):
                    upto += 1
                if key != (files[at], starts[at]):
                    if key is not None:
                        yield rows(key, 1, np.array([size]), head, last[0])
                    key, size, last = (files[at], starts[at]), 0, b""
                sep = bytes([first])
                part = np.frombuffer(last + sep.join(lines[at:upto]) + sep, np.uint8)
                yield rows(key, 0, np.flatnonzero((part[:-1] == first) & (part[1:] == second)) + size - len(last), 0, 0)
                if not size:
                    head = int(part[0])
                size += len(part) - len(last)
                last = part[-1:].tobytes()
                at = upto
        if key is not None:
            yield rows(key, 1, np.array([size]), head, last[0])

    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", chr(first)).text(path)
    found = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    return found.mapInArrow(run, "file string, block long, kind int, at long, head int, tail int")


def count_tokens(spark: SparkSession, path: str, end_id: int = END) -> DataFrame:
    """One row per document of the files under ``path``, taken in name order as one stream.

    Columns: file, ordinal (in the stream), nth_in_file, start (in the stream) and
    n_tokens, without the end. Ids after the stream's last end are no document, and
    half an id at a file's end is none. Blocks are scanned by a window over their file's
    blocks; files are summed on the driver, which has to list them anyway.
    """
    first, second = np.array([end_id], "<u2").view(np.uint8).tolist()
    found = stage(_scan(spark, path, end_id), "pairs")
    key = ["file", "block"]
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.where("kind = 1").select(
        *key, "tail", F.coalesce(F.sum("at").over(before), F.lit(0)).alias("base"), F.col("at").alias("size"), F.lead("head").over(in_file).alias("next")
    )
    blocks = stage(blocks, "blocks")
    whole = found.where("kind = 0").join(blocks.select(*key, "base"), key).select(*key, (F.col("base") + F.col("at")).alias("byte"))
    cut = blocks.where((F.col("tail") == first) & (F.col("next") == second)).select(*key, (F.col("base") + F.col("size") - 1).alias("byte"))
    ends = whole.union(cut).where("byte % 2 = 0").select(*key, F.expr("byte div 2").alias("end"))
    in_block = Window.partitionBy(*key).orderBy("end")
    ends = stage(ends.withColumn("nth", F.row_number().over(in_block) - 1).withColumn("before", F.lag("end").over(in_block)), "ends")
    counted = blocks.select(*key, "size").join(ends.groupBy(*key).agg(F.count("*").alias("n"), F.max("end").alias("last")), key, "left")
    counted = counted.withColumn("n", F.coalesce("n", F.lit(0)))
    # The reader adds a byte to a file that does not end in one that ends lines; half an id counts nothing.
    spans = counted.groupBy("file").agg(F.expr("sum(size) div 2").alias("ids"), F.sum("n").alias("ends"), F.max("last").alias("last"))
    rows, base, docs, open_ = [], 0, 0, 0
    for file, ids, n_ends, last in sorted(spans.collect()):
        rows.append((file, base, docs, open_))
        if n_ends:
            open_ = base + last + 1
        base, docs = base + ids, docs + n_ends
    files = spark.createDataFrame(rows, "file string, file_start long, docs_before long, open_at long")
    scan = counted.select(
        *key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ends_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_end")
    ).join(files, "file")
    previous = F.coalesce("before", "last_end")
    start = F.when(previous < 0, F.col("open_at")).otherwise(F.col("file_start") + previous + 1)
    nth = F.col("ends_before") + F.col("nth")
    return ends.join(scan, key).select(
        "file",
        (F.col("docs_before") + nth).alias("ordinal"),
        nth.alias("nth_in_file"),
        start.alias("start"),
        (F.col("file_start") + F.col("end") - start).alias("n_tokens"),
    )


_ROW = (1 << 33) - 1


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int = END) -> DataFrame:
    """One row per row of ``docs``: doc_id, part, nth_in_part, start, n_tokens.

    Writes ``docs`` as flat token files in the shared folder, counts from the files
    alone, and names the documents by their order: a partition's rows are a file's
    documents. ``docs`` must re-read alike, as a table does; a file that holds
    another number of documents than its partition is an error. Null and empty texts
    have no tokens. Repeated rows count each. An empty table gives no rows. Only
    doc_id and text are read. ``start`` is the place in the stream of all files.
    """
    spark = docs.sparkSession
    at = F.monotonically_increasing_id()
    names = docs.select("doc_id", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit(_ROW)).alias("nth_in_part"))
    path = new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    counted = count_tokens(spark, path, end_id).withColumn("part", F.regexp_extract("file", r"part-(\d+)-", 1).cast("int"))
    counted = stage(counted, "counts")
    n_rows = {r[0]: r[1] for r in names.groupBy("part").count().collect()}
    n_docs = {r[0]: r[1] for r in counted.groupBy("part").count().collect()}
    if n_rows != n_docs:
        raise RuntimeError("the token files do not hold the table's rows")
    same = ["part", "nth_in_part"]
    return names.join(counted.withColumnRenamed("nth_in_file", "nth_in_part"), same).select("doc_id", *same, "start", "n_tokens")
