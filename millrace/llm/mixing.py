"""Mixing sources to target weights by fitting each source's word budget.

Every source gets a share of all words by weight, at most three times its own.
Whole passes over a source cover most of a budget above its own size. For the
rest, documents are counted by exact length, an even share of every length class
is taken, and a bounded-knapsack dynamic programme over the counts still free
hits what remains. Which documents of a class are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import beside, global_rank, packed, partitions, stage, unpacked

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 17
#: Words of the longest document that the exact part places.
LONG = 1 << 17


def subset_sum(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take for the largest sum up to ``budget``.

    Counts are split into powers of two, so that each part is taken or not.
    """
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    via = np.full(budget + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []
    for k, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist())):
        many, part = min(count, budget // size), 1
        while many > 0 and not reach[budget]:
            n = min(part, many)
            many, part, w = many - n, part * 2, n * size
            new = reach[: budget + 1 - w] & ~reach[w:]
            via[w:][new] = len(parts)
            reach[w:] |= new
            parts.append((k, n))
        if reach[budget]:
            break
    take = np.zeros(len(sizes), np.int64)
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, n = parts[via[at]]
        take[k] += n
        at -= n * int(sizes[k])
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many to take of each size so that their words come to ``budget`` or just below.

    An even share of every class comes first, short of the budget by a few of the
    longest; the exact part chooses from what every class then still has. Its arrays
    have 6 * ``LONG`` places at most: longer documents are taken by their share and, as
    long as they fit, one by one, and shorter ones make up what that leaves. Only where
    these don't suffice does a gap stay, smaller than the shortest longer document still left.
    """
    total = int((sizes * counts).sum())
    take = counts * 0
    if budget <= 0 or total == 0:
        return take
    use = sizes > 0
    longest = min(int(sizes.max()), LONG)
    shy = max(0, budget - 4 * longest)
    take[use] = [int(c) * shy // total for c in counts[use]]
    rest = budget - int((sizes * take).sum())
    for all_ in (False, True):
        for k in np.argsort(-sizes):  # rounding down loses up to one of each size
            if use[k] and rest > 6 * longest:
                many = int(counts[k] - take[k])
                room = rest if sizes[k] > LONG else rest - 4 * longest
                many = many if all_ or sizes[k] > LONG else (many + 1) // 2
                more = min(many, room // int(sizes[k]))
                take[k] += more
                rest -= more * int(sizes[k])
    free = use & (counts > take) & (sizes <= min(rest, longest))
    take[free] += subset_sum(sizes[free], (counts - take)[free], min(rest, 6 * longest))
    return take


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """Add weight and target to (key, source_size); only totals reach the driver."""
    ranked = global_rank(sources, ["key"], "at")
    named = stage(
        ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))).drop("at"), "sources"
    )
    total = named.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("source_size") * most <= F.col("weight") * F.lit(level)
        n, full, weight = named.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not weight:
            break
        capped, level = n, (total - full) / weight
    target = F.least(F.col("source_size") * most * F.lit(1.0), F.col("weight") * F.lit(float(level)))
    return named.withColumn("target", target)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, rid, source_key.

    Size is the number of words between ASCII white space; a null text has none.
    A null source is a source of its own, last in order. ``copies`` says how often
    the mix holds the row, from 0 to ``most``; ``taken`` is size times copies. A
    source without words has target 0. Repeated rows count each. An empty table
    gives no rows. Only doc_id, source and text are read.

    A hot source or length class is ranked by a range exchange on (source, size,
    hash, id), which splits it, and its rows are split again where the choice is joined
    back (``beside``); the knapsack sees one row per source and length.
    """
    text = F.col("text")
    # A null source's key sorts after every other.
    key = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("~"))
    sized = stage(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            key.alias("key"),
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
            F.xxhash64("doc_id", F.lit(seed)).alias("draw"),
            F.xxhash64("text").alias("tie"),
        ),
        "sized",
    )
    ranked = global_rank(sized, ["key", "size", "draw", "doc_id", "tie"], "position")
    classes = stage(ranked.groupBy("key", "size").agg(F.count("*").alias("n"), F.min("position").alias("first")), "classes")
    goal = targets(classes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        target, total = float(part["target"].iloc[0]), int(part["source_size"].iloc[0])
        # One pass less than would fit leaves the exact part room; it fills up to ``most`` copies.
        base = max(0, min(most, int(target // total)) - 1) if total else 0
        counts = part["n"].to_numpy()
        units = fit(part["size"].to_numpy(), counts * (most - base), round(target - base * total))
        part["each"] = base + units // counts
        part["more"] = units % counts
        return part[["key", "size", "n", "first", "source_size", "target", "each", "more"]]

    # A number of tasks of its own, so that sources, small in bytes, do not share one.
    aimed = classes.join(goal, "key").repartition(partitions(sized), "key")
    kinds = "key string, size long, n long, first long, source_size long, target double, each long, more long"
    chosen = stage(aimed.groupBy("key").applyInPandas(choose, kinds), "chosen")
    copies = F.col("each") + (F.col("position") - F.col("first") < F.col("more")).cast("long")
    return beside(ranked, chosen, ["key", "size"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "rid", F.col("key").alias("source_key")
    )


def sources_near(rows: DataFrame, words: int = 10) -> DataFrame:
    """Rows of ``mix`` with ``near``: whether what their source gives lies within so many words of its target."""
    given = rows.groupBy("source_key").agg(F.sum("taken").alias("_given"), F.count("*").alias("n"))
    return beside(rows, given, ["source_key"]).withColumn("near", F.abs(F.col("_given") - F.col("target")) <= words).drop("_given")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix holds them: each row as often as chosen, all columns kept.

    ``docs`` must be deterministic on re-reading: row numbers tell rows apart. Null texts
    and sources are as in ``mix``; repeated rows count each; an empty table stays empty.
    """
    times = mix(docs).where("copies > 0").select("rid", "copies")
    rows = packed(docs).withColumn("rid", F.monotonically_increasing_id())
    out = rows.join(times, "rid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_"))
    return unpacked(out, docs)
