"""Line deduplication over repeated runs of lines, found by prefix doubling.

Every text is a sequence of line ids. Suffixes are ranked by their first line, then
by their first two, four and more lines: the rank of a run of 2k lines comes from
the ranks of its two halves. Suffixes that share a rank at some depth form an
interval of the suffix array whose common prefix has at least that many lines, so
ranks tell where runs repeat. Suffixes alone in their interval are dropped at once.

A line is deleted if it lies in a run of whole lines, of ``MIN_WORDS`` words or more,
that also stands earlier, in the order of ids and lines. Five words, a shingle's
length, keep apart copies from lines of a word or two that prose repeats by chance. All such maximal runs are
unions of shortest runs of enough words that start or end at some line, and the
rank of any run follows from the ranks of the two runs of 2k lines that cover it.

Everything is DataFrame operations; lines are told apart by 128 hashed bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import beside, global_rank, packed, stage, unpacked, unstage

MIN_WORDS = 5

_WORDS = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """rid, doc_id, i, w (words), h1, h2 of each line."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")  # before the lines are parted
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = numbered.select("rid", "doc_id", F.posexplode(split).alias("i", "line"))
    return rows.select(
        "rid", "doc_id", F.col("i").cast("long").alias("i"), F.regexp_count("line", F.lit(_WORDS)).cast("long").alias("w"),
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("again"), "line").alias("h2"),
    )


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(rid, s, l): shortest runs of repeated lines with enough words, from each line on and up to each."""
    by_line = Window.partitionBy("rid").orderBy("i")
    rows = rows.withColumn("seg", F.col("i") - F.row_number().over(by_line))
    seg = Window.partitionBy("rid", "seg")
    rows = rows.withColumn("before", F.sum("w").over(seg.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    ends = rows.groupBy("rid", "seg").agg((F.max("i") + 1).alias("i"), F.sum("w").alias("before"))
    edges = rows.select("rid", "seg", "i", "before").union(ends.select("rid", "seg", "i", "before"))
    # At the edges between lines, ``before`` counts the words up to there and never falls.
    ahead = seg.orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    behind = seg.orderBy("before").rangeBetween(Window.unboundedPreceding, -min_words)
    found = edges.select("rid", "i", F.min("i").over(ahead).alias("to"), F.max("i").over(behind).alias("since"))
    forward = found.where("to is not null").select("rid", F.col("i").alias("s"), (F.col("to") - F.col("i")).alias("l"))
    backward = found.where("since is not null").select("rid", F.col("since").alias("s"), (F.col("i") - F.col("since")).alias("l"))
    return forward.union(backward).distinct()


def _doubled(level: DataFrame, width: int) -> DataFrame:
    """Ranks of runs of twice ``width`` lines, where such a run repeats."""
    right = level.select("rid", (F.col("i") - width).alias("i"), F.col("r").alias("r2"))
    pairs = stage(level.join(right, ["rid", "i"]), "pairs")
    repeated = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1")
    ranked = global_rank(repeated, ["r", "r2"], "rank")
    out = stage(beside(pairs, ranked, ["r", "r2"]).select("rid", "i", F.col("rank").alias("r")), "ranks")
    unstage(pairs, ranked)
    return out


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, start, stop) of the disjoint stretches of lines to delete; rid numbers the rows of ``docs``."""
    lines = stage(_lines(docs), "lines")
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    ranked = global_rank(counts, ["h1", "h2"], "r")
    first = stage(beside(lines, ranked, ["h1", "h2"]).select("rid", "doc_id", "i", "w", "r"), "ranks")
    unstage(lines, ranked)
    runs = stage(_windows(first, min_words), "runs")
    longest = runs.agg(F.max("l")).first()[0]
    ids = first.select("rid", "doc_id").distinct()
    level, width, later = first.select("rid", "i", "r"), 1, []
    while longest is not None and width <= longest:
        some = runs.where((F.col("l") >= width) & (F.col("l") < 2 * width))
        left = level.select("rid", F.col("i").alias("s"), F.col("r").alias("a"))
        right = level.select("rid", F.col("i").alias("t"), F.col("r").alias("b"))
        named = some.withColumn("t", F.col("s") + F.col("l") - width).join(left, ["rid", "s"]).join(right, ["rid", "t"]).join(ids, "rid")
        named = stage(named.select("rid", "s", "l", "a", "b", F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid", "s").alias("at")), "named")
        firsts = stage(named.groupBy("l", "a", "b").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
        again = beside(named, firsts, ["l", "a", "b"]).where(F.col("at") != F.col("first"))
        later.append(stage(again.select("rid", "s", (F.col("s") + F.col("l")).alias("e")), "later"))
        unstage(named, firsts)
        if 2 * width > longest:
            break
        level = _doubled(level, width)
        width *= 2
    if not later:
        return runs.select("rid", F.col("s").alias("start"), F.col("l").alias("stop")).where("false")
    spans = reduce(DataFrame.union, later)
    by_start = Window.partitionBy("rid").orderBy("s", "e")
    seen = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (seen.isNull() | (F.col("s") > seen)).cast("int")
    spans = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("rid", "island").agg(F.min("s").alias("start"), F.max("e").alias("stop")).drop("island")


def _stretches(docs: DataFrame, min_words: int) -> DataFrame:
    found = stage(repeated_lines(docs, min_words), "stretches")
    return found.groupBy("rid").agg(
        F.sum(F.col("stop") - F.col("start")).alias("n"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")
    )


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed.

    ``removed`` lists the deleted stretches as start-stop, lines from 0, stop
    exclusive, comma-joined. Lines end at line feeds and are equal byte by byte. A
    null text is one empty line. Of repeated rows the later ones, in any order
    among equals, lose what the first keeps; null ids come last. An empty table
    gives no rows. Only doc_id and text are read, and ``docs`` must re-read alike.
    """
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", n_lines.alias("n_lines"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return rows.join(_stretches(docs, min_words), "rid", "left").select(
        "doc_id", "n_lines", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce(listed, F.lit("")).alias("removed")
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the deleted lines gone from ``text``, all columns kept.

    Null and empty texts stay as they are; a text whose lines all go becomes empty. Rows
    are as in ``line_report``; an empty table stays empty.
    """
    rows = packed(docs).withColumn("rid", F.monotonically_increasing_id()).join(_stretches(docs, min_words), "rid", "left")

    def kept(lines: Column) -> Column:
        """What lies between the stretches, slice by slice."""
        stops = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["stop"]))
        starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.size(lines).cast("long")))
        gaps = F.arrays_zip(stops.alias("a"), starts.alias("b"))
        return F.flatten(F.transform(gaps, lambda g: F.slice(lines, (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))))

    split = F.array(F.split(F.col("row.text"), "\n", -1))  # bound once, not once per stretch
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(split, kept)[0], "\n"))
    return unpacked(rows.select(F.col("row").withField("text", text).alias("row")), docs)
