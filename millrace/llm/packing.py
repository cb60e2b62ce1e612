"""Best-fit packing of documents into fixed-length token sequences.

Packing only looks at how many pieces there are of each length, a table of at most
``capacity`` rows. On that table, Martello and Toth's dominance reduction fixes
the piece sets that no optimal packing can improve on, a length class at a time,
and best fit decreasing packs what is left, again class by class: open sequences
are kept as runs of ids by free space. Pieces then find their place by their
position in the order of lengths, so no group of pieces meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, global_rank, stage
from millrace.llm.tokens import encoder

CAPACITY = 2048


def reduce_by_dominance(hist: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed sets with their multiplicity, and the counts that remain.

    Sets are taken for the largest length first. With the piece at most 0, 1 or 2
    others fit; a set stays fixed if it dominates every other set that holds the
    piece. All copies of a length go through together, as many as keep the case.
    """
    left = {w: n for w, n in hist.items() if n > 0}
    sizes = sorted(left)  # ascending, only lengths that are left
    passed: set[int] = set()  # lengths looked at that no set was fixed for; they still fit beside others
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*ws: int) -> int:
        """Fix as many of the set as the counts allow."""
        need: dict[int, int] = {}
        for w in ws:
            need[w] = need.get(w, 0) + 1
        n = min(left[w] // k for w, k in need.items())
        for w, k in need.items():
            left[w] -= n * k
            if not left[w]:
                sizes.remove(w)
        fixed.append((ws, n))
        return n

    def fit(room: int, without: dict[int, int]) -> int | None:
        """The largest length up to ``room`` of which a piece is left."""
        k = bisect_left(sizes, room + 1) - 1
        while k >= 0 and left[sizes[k]] <= without.get(sizes[k], 0):
            k -= 1
        return sizes[k] if k >= 0 else None

    while (j := next((w for w in reversed(sizes) if w not in passed), None)) is not None:
        room = capacity - j
        used = {j: 1}
        best = fit(room, used)
        if best is None:
            n = left[j]  # nothing fits beside any of them
            left[j] = 0
            sizes.remove(j)
            fixed.append(((j,), n))
            continue
        if best == room:
            take(j, best)
            continue
        # How many of the smallest fit beside j.
        total, k = 0, 0
        for w in sizes:
            have = left[w] - used.get(w, 0)
            can = min(have, (room - total) // w)
            total += can * w
            k += can
            if can < have or k > 2:
                break
        if k == 1:
            take(j, best)
            continue
        if k == 2:
            pair, top = None, -1
            for a in reversed(sizes[: bisect_left(sizes, room + 1)]):
                if left[a] <= used.get(a, 0):
                    continue
                b = fit(min(room - a, a), {j: 1, a: 1 + (a == j)} if a != j else {a: 2})
                if b is not None and a + b > top:
                    top, pair = a + b, (a, b)
            if pair is None or best >= top:
                take(j, best)
                continue
            a, b = pair
            larger = [w for w in sizes[bisect_left(sizes, b + 1) :] for _ in range(min(2, left[w] - used.get(w, 0)))][:2]
            if a == best and (len(larger) < 2 or sum(larger) > room):
                take(j, a, b)
                continue
        passed.add(j)
    return fixed, {w: left[w] for w in sizes}


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(first position, sequence of the first, offset) of each run, and the number of sequences.

    Positions number all pieces in the order of their lengths. The piece at
    position p of a run that starts at s lies in sequence q + p - s. The number of
    runs depends on the lengths that occur, at most ``capacity``, not on the pieces.
    """
    fixed, rest = reduce_by_dominance(dict(hist), capacity)
    at, before = {}, 0
    for w in sorted(hist):
        at[w] = before
        before += hist[w]
    starts: list[int] = []
    seqs: list[int] = []
    offs: list[int] = []
    count = 0

    def put(w: int, n: int, seq: int, off: int) -> None:
        starts.append(at[w])
        seqs.append(seq)
        offs.append(off)
        at[w] += n

    for ws, n in fixed:
        off = 0
        for w in ws:
            put(w, n, count, off)
            off += w
        count += n

    free: dict[int, deque[tuple[int, int]]] = {}
    rooms: list[int] = []

    def opened(room: int, seq: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = deque()
                insort(rooms, room)
            free[room].append((seq, n))

    for w in sorted(rest, reverse=True):
        m = rest[w]
        while m:
            k = bisect_left(rooms, w)
            if k < len(rooms):
                room = rooms[k]
                seq, n = free[room].popleft()
                if not free[room]:
                    del free[room]
                    rooms.pop(k)
            else:
                room, seq, n = capacity, count, -(-m // (capacity // w))
                count += n
            each = room // w
            whole = min(n, m // each)
            for i in range(each if whole else 0):
                put(w, whole, seq, capacity - room + i * w)
            m -= whole * each
            opened(room - each * w, seq, whole)
            if whole < n:
                for i in range(m):
                    put(w, 1, seq + whole, capacity - room + i * w)
                opened(room - m * w, seq + whole, 1)
                opened(room, seq + whole + 1, n - whole - 1)
                m = 0
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    return np.array(starts, np.int64)[order], np.array(seqs, np.int64)[order], np.array(offs, np.int64)[order], count


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, ``end_id`` last, into pieces of at most ``capacity``."""
    out_schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                cols: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts)):
                    ids += end
                    for i in range(0, len(ids), step):
                        cut_ids = ids[i : i + step]
                        row = (doc, i // step, i // 4, len(cut_ids) // 4, zlib.crc32(cut_ids), cut_ids)
                        for c, v in zip(cols, row):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                n = 5 + with_ids
                names_out = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds)], names_out)
        give_back()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(cut, out_schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Place every piece of every document; see ``pieces`` for the columns.

    Adds ``sequence_id`` and ``offset``. Null or empty text: one piece that holds
    ``end_id``. Repeated rows are packed once each. An empty table gives no rows.
    Only ``doc_id`` and ``text`` are read, so further columns cannot clash. The
    driver gets one count per piece length, at most ``capacity`` of them.
    """
    cut = stage(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    hist = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    starts, seqs, offs, _ = plan(hist, capacity)
    ranked = global_rank(cut, ["length", "doc_id", "piece", "ids_crc32"], "position")
    names = [c for c in cut.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = b.column(b.schema.get_field_index("position")).to_numpy()
            run = np.searchsorted(starts, pos, "right") - 1
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            cols += [pa.array(seqs[run] + pos - starts[run]), pa.array(offs[run])]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, length, ids) from ``pack(with_ids=True)``."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
    )


def decoded(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
