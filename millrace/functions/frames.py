"""Ranks within a moving frame, by a sorted structure that follows it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.session import busy_tasks

#: Values in a block, about; a block of twice as many is cut in two.
BLOCK = 512


class SortedFrame:
    """A multiset of numbers in sorted blocks: adding, removing and counting what is below touch one block and the blocks' lengths."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []
        self.size = 0

    def add(self, x: float) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
            return
        k = min(bisect_left(self.tops, x), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, x)
        if len(block) >= 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[k : k + 1] = [block[BLOCK - 1], block[-1]]
        else:
            self.tops[k] = block[-1]

    def remove(self, x: float) -> None:
        """Take out one ``x`` that is there."""
        self.size -= 1
        k = bisect_left(self.tops, x)
        block = self.blocks[k]
        del block[bisect_left(block, x)]
        if block:
            self.tops[k] = block[-1]
        else:
            del self.blocks[k], self.tops[k]

    def _before(self, side, x: float) -> int:
        k = side(self.tops, x)
        inside = side(self.blocks[k], x) if k < len(self.blocks) else 0
        return sum(map(len, self.blocks[:k])) + inside

    def below(self, x: float) -> int:
        return self._before(bisect_left, x)

    def upto(self, x: float) -> int:
        return self._before(bisect_right, x)


def with_frame_ranks(rows: DataFrame, value: str, n: int, by: str = "symbol", date: str = "date") -> DataFrame:
    """Add, for the frame of each row and the n - 1 before it in its series, ``_below`` and ``_same`` (values less than and equal to the row's), ``_known`` (values that are not null) and ``_rows``.

    A row whose value is null has null for the first two. One series after the other
    streams through a task in the order of its dates; the task holds one frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, frame, held = None, SortedFrame(), deque()
        for b in batches:
            out: list[tuple] = []
            for s, x in zip(b.column(by).to_pylist(), b.column(value).to_pylist()):
                if (s,) != series:
                    series, frame, held = (s,), SortedFrame(), deque()
                if x is not None:
                    x = float("inf") if x != x else x  # above all else, as in any sort
                    frame.add(x)
                held.append(x)
                if len(held) > n and (old := held.popleft()) is not None:
                    frame.remove(old)
                below = None if x is None else frame.below(x)
                out.append((below, None if x is None else frame.upto(x) - below, frame.size, len(held)))
            found = [pa.array([r[k] for r in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *ADDED])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ADDED)])
    return rows.repartition(busy_tasks(rows), by).sortWithinPartitions(by, date).mapInArrow(run, schema)


ADDED = ("_below", "_same", "_known", "_rows")
