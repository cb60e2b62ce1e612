"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their leading bytes, then each group by its next bytes,
until a group has one member or its members have ended. A digit is a block of
successive bytes whose width grows from round to round, so that most documents
leave after the first, narrow digit and copies need few rounds. Equality is that
of the bytes; the SHA-256 in the result is only reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE_RUN, stage, unstage, without

FIRST_DIGIT = 32
GROWTH = 8


def normalised(text: F.Column) -> F.Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _radix(docs: DataFrame, text: str, key: str) -> DataFrame:
    """rid, gid (smallest rid of the group), doc_id, keep_id, group_size, sha of each row."""
    body = normalised(F.col(f"`{text}`")).cast("binary")
    active = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.lit(0).cast("long").alias("gid"), F.col(f"`{key}`").alias("doc_id"), body.alias("body")
    ).withColumn("sha", F.unhex(F.sha2("body", 256)))
    done, width = [], FIRST_DIGIT
    while True:
        split = active.withColumn("digit", F.substring("body", 1, width)).withColumn("ended", F.length("body") <= width)
        counts = [F.count("*").alias("n"), F.min("doc_id").alias("keep_id"), F.min("rid").alias("next")]
        # Staged, so that the join below reads both sides as they are and can split a hot digit's rows.
        groups = stage(split.groupBy("gid", "digit", "ended").agg(*counts), "digits")
        open_ = (F.col("n") > 1) & ~F.col("ended")
        rows = split.join(groups, ["gid", "digit", "ended"]).select(
            "rid",
            F.col("next").alias("gid"),
            "doc_id",
            "keep_id",
            F.col("n").alias("group_size"),
            "sha",
            F.when(open_, F.expr(f"substring(body, {width + 1})")).alias("body"),
        )
        level = stage(rows, "radix")
        unstage(groups)
        done.append(level.where("body is null"))
        active = level.where("body is not null").select("rid", "gid", "doc_id", "body", "sha")
        if active.isEmpty():
            break
        width *= GROWTH
    return reduce(DataFrame.union, done)


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows whose normalised texts are identical form a group, and the row with the
    smallest id stays. Null and empty texts are one group. Of repeated rows, with
    the same id and text, all count and are marked as kept. Null ids sort after
    all others. An empty table gives no rows. Only ``key`` and ``text`` are read.

    Each round counts a group's digits with map-side combining and joins the
    counts back. On that join's other side stands one row per group, so a hot
    group's documents are split among tasks by the engine's skew handling. ``docs``
    must be deterministic on re-reading, as a table is: row numbers name groups.
    """
    return _radix(docs, text, key).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the first of each group of equal texts only, all columns kept.

    Null and empty texts are one group. Of repeated rows that share id and text, one
    stays. Null ids go unless all of a group are null. An empty table stays empty.
    """
    copies = _radix(docs, "text", "doc_id").where("group_size > 1")
    first = copies.where("doc_id <=> keep_id").groupBy("gid").agg(F.min("rid").alias("rid"))
    return without(docs, copies.select("rid").join(first.select("rid"), "rid", "left_anti"))
