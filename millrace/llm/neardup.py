"""Near-duplicate documents: Fast Similarity Sketching, banding, exact verification.

Documents with equal shingle sets form a class. Each class's sketch is cut into
bands, and classes that share a band are candidates; candidates that hang together
form a candidate group. A group is compared in full, or bucket by bucket where its
buckets, each set of members once, hold fewer pairs: then pairs that only hang
together over others are not compared. Either way members stand in the order of
their sets' sizes and meet in cells of at most two blocks, and blocks whose sizes
rule out the similarity do not meet. A block's members and shingles are bounded. A cell returns links that span what it found,
not its pairs. Bands and their rows follow from the threshold: at 0.85, 25 bands of
5 rows, and a pair at it shares no band with a probability of (1 - 0.85**5)**25 = 4e-7,
less above it; at 0.80, 32 bands of 4 rows, 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.cells import run_cells, size_blocks
from millrace.llm.common import beside, connected_components, give_back, global_rank, stage, unstage, without
from millrace.llm.shingles import COORDS, band_keys, class_key, shingle_set, sketch

PERCENT = 85
#: A pair at the threshold shares no band with this probability at most, where the sketch has coordinates enough.
MISS = 1e-6
#: Texts turned into Python objects at once.
SLICE = 256
#: Members of a block, at most, and shingles of a block, by its sizes' power of two.
BLOCK = 256
BLOCK_ITEMS = 1 << 19
#: Columns of an incidence matrix held at once.
COLUMNS = 8192


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: the most rows that keep to ``MISS`` at the threshold, one if none do."""
    for rows in range(COORDS, 1, -1):
        bands = COORDS // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return bands, rows
    return COORDS, 1


def _sketched(docs: DataFrame, percent: int) -> DataFrame:
    """rid, doc_id, n_shingles, cls (null without words), bands."""
    n_bands, n_rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            for at in range(0, len(b), SLICE):
                part = b.slice(at, SLICE)
                sizes, classes, found, rows = [], [], [], []
                for k, t in enumerate(texts.slice(at, SLICE).to_pylist()):
                    items = shingle_set(t)
                    sizes.append(len(items))
                    classes.append(class_key(items) if len(items) else None)
                    if len(items):
                        found.append(sketch(items))
                        rows.append(k)
                bands: list = [None] * len(part)
                if found:
                    for k, keys in zip(rows, band_keys(np.stack(found), n_bands, n_rows)):
                        bands[k] = keys
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["rid", "doc_id", "n_shingles", "cls", "bands"],
                )
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "rid long, doc_id long, n_shingles long, cls binary, bands array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets with each other, or of left with right sets."""
    sets = left + (right or [])
    lengths = np.array([len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    shared = counts > 1  # an item of one set only is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n = len(left)
    out = np.zeros((n, len(right) if right else n), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m[:n] @ (m[n:] if right else m).T
    return out.astype(np.int64)


def spanning_links(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric boolean matrix connects."""
    out, new = [], np.ones(len(adjacent), bool)
    for root in range(len(adjacent)):
        if not new[root]:
            continue
        new[root] = False
        front = np.array([root])
        while len(front):
            hit = adjacent[front].any(axis=0) & new
            front = np.flatnonzero(hit)
            new[front] = False
            out += [(root, int(k)) for k in front]
    return out


def cell_links(nodes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links among a cell's members: all of one block, or between two."""
    sizes = np.array([len(s) for s in sets])
    two = blocks != blocks[0]
    if two.any():
        a, b = np.flatnonzero(~two), np.flatnonzero(two)
        inter = overlaps([sets[k] for k in a], [sets[k] for k in b])
        ok = 100 * inter >= percent * (sizes[a][:, None] + sizes[b][None, :] - inter)
        adjacent = np.zeros((len(sets), len(sets)), bool)
        adjacent[np.ix_(a, b)] = ok
        adjacent[np.ix_(b, a)] = ok.T
    else:
        inter = overlaps(sets, None)
        adjacent = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    return [(int(nodes[i]), int(nodes[j])) for i, j in spanning_links(adjacent)]


def _verified(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from members (unit, low, high, block, node, items)."""

    def links(rows: list[dict]) -> list[tuple]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r["items"], np.uint64) for r in rows]
        return cell_links(np.array([r["node"] for r in rows]), np.array([r["block"] for r in rows]), sets, percent)

    return run_cells(members, ["unit", "low", "high"], links, "a long, b long")


def _with_sets(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Replace the column text by its shingle set's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), SLICE):
                part = b.slice(at, SLICE)
                items = [shingle_set(t).tobytes() for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(items, pa.binary())], [*keep, "items"])
        give_back()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, F.col("text").cast("binary")).mapInArrow(run, kinds + ", items binary")


def _units(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """(unit, node, size): what to compare, a candidate group under its number or a bucket under its key.

    Should a key equal a group's number, both are compared as one, which loses nothing.
    """
    same = [F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2")]
    buckets = stage(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("center"), *same).where("n > 1"), "buckets")
    shared = stage(beside(keys, buckets.select("key", "n", "center"), ["key"]), "shared")
    edges = shared.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    groups = stage(connected_components(edges).select("node", F.col("component").alias("grp")), "groups")
    # Bands that agree on a bucket's members make one bucket of them.
    kinds = buckets.groupBy("n", "s1", "s2").agg(F.min("key").alias("key"), F.min("center").alias("node"))
    kinds = stage(kinds.join(groups, "node").select("grp", "key", "n"), "kinds")
    pairs = kinds.groupBy("grp").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n")).join(pairs, "grp")
    sizes = stage(sizes.select("grp", "n", (F.col("pairs") < F.col("n").cast("double") * F.col("n")).alias("apart")), "sizes")
    whole = beside(groups, sizes.where("not apart").select("grp", "n"), ["grp"]).join(classes.select("node", "size"), "node")
    cut = stage(kinds.join(sizes.where("apart").select("grp"), "grp").select("key", "n"), "cut")
    parts = beside(shared, cut, ["key"])
    return whole.select(F.col("grp").alias("unit"), "node", "size").union(parts.select(F.col("key").alias("unit"), "node", "size"))


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """rid, doc_id, n_shingles, comp (null without words) of each row."""
    seen = stage(_sketched(docs, percent), "sketches")
    firsts = seen.where("cls is not null").groupBy("cls")
    classes = stage(firsts.agg(F.min("rid").alias("node"), F.count("*").alias("n"), F.max("n_shingles").alias("size")), "classes")
    nodes = seen.select("rid", "bands").join(classes.select(F.col("node").alias("rid"), "size"), "rid")
    keys = stage(nodes.select(F.explode("bands").alias("key"), F.col("rid").alias("node"), "size"), "bands")
    unit = ["unit"]
    # Members stand by size; those within a power of two make a run of blocks of so many members.
    level = F.floor(F.log2(F.col("size").cast("double"))).cast("int").alias("level")
    members = F.expr(f"greatest(least(shiftright({BLOCK_ITEMS}, level + 1), {BLOCK}), 1)")
    ranked = global_rank(_units(keys, classes).select("*", level), [*unit, "level", "size", "node"], "pos")
    spans = ranked.groupBy(*unit, "level").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*unit).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    spans = stage(spans.withColumn("base", F.coalesce(F.sum(F.ceil(F.col("n") / members)).over(earlier), F.lit(0))), "spans")
    block = (F.col("base") + F.floor((F.col("pos") - F.col("first")) / members)).cast("int").alias("block")
    placed = stage(beside(ranked, spans, [*unit, "level"]).select(*unit, "node", "size", block), "placed")
    unstage(keys, ranked)
    reach = size_blocks(placed, unit, percent)
    # A node is in one group, or in as many buckets as there are bands at most.
    places = placed.join(reach, [*unit, "block"]).groupBy("node").agg(F.collect_list(F.struct(*unit, "block", "since", "upto")).alias("places"))
    texts = docs.select(F.monotonically_increasing_id().alias("node"), "text")
    sets = _with_sets(texts.join(places, "node"), ["node", "places"]).select("node", "items", F.explode("places").alias("p"))
    other = F.explode(F.sequence("p.since", "p.upto")).alias("o")
    cells = sets.select("node", "items", "p.unit", "p.block", other)
    cells = cells.select(*unit, F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high"), "block", "node", "items")
    links = stage(_verified(cells, percent), "links")
    linked = stage(connected_components(links), "components")
    comps = stage(classes.join(linked, "node", "left").select("cls", F.coalesce("component", "node").alias("comp"), "n"), "comps")
    return beside(seen.select("rid", "doc_id", "n_shingles", "cls"), comps, ["cls"], "left").drop("cls")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows are linked if their sets of lower-cased five-word shingles have a Jaccard
    similarity of ``percent`` or more; fewer words make one shingle. Rows without
    words, null text included, are linked with nothing. ``component_id`` is the
    smallest id reachable. Of repeated rows, all are in one component and those
    with its id are marked as kept. Null ids never stand for a component unless it
    has no other. An empty table gives no rows. Only doc_id and text are read, and
    ``docs`` must be deterministic on re-reading: row numbers stand for rows.

    The rows of a hot bucket, group, class or component are split (``beside``). A
    group or bucket of any size is compared in cells of at most two blocks; for g
    different sets of about one size in it the work, not the memory, grows with the
    square of g.
    """
    rows = stage(_labelled(docs, percent), "labelled")
    least = stage(rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    return beside(rows, least, ["comp"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        (F.col("comp").isNull() | F.col("doc_id").eqNullSafe(F.col("least"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the smallest id of each component only, all columns kept.

    Of repeated rows with that id one stays; rows without words, null and empty texts
    included, all stay. Null ids stay only where a component has no other. An empty
    table stays empty. Columns of any names ride along as they are.
    """
    rows = stage(_labelled(docs, percent), "labelled")
    rows = rows.where("comp is not null")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("rid"))
    return without(docs, rows.select("rid").join(first.select("rid"), "rid", "left_anti"))
