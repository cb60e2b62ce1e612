import zlib

import numpy as np
import pytest

from millrace.llm.sharding import hilbert_index, shard, write_shards


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours_once(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
    at = hilbert_index(cells, bits)
    assert sorted(at) == list(range(cells.shape[1]))
    path = cells[:, np.argsort(at)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


ROWS = [(i, "t" * (i % 50), "en" if i % 3 else None, "s%d" % (i % 7), 1) for i in range(500)] + [(7, None, None, None, 1), (None, "é", "x", "y", 1), (7, None, None, None, 1)]
SCHEMA = "doc_id long, text string, lang string, source string, slot int"


def test_law_and_digests(spark):
    got = shard(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    slots = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # Runs of the curve: shards do not overlap.
    runs = sorted((min(r.curve_index for r in got if r.shard == k), max(r.curve_index for r in got if r.shard == k)) for k in slots)
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:]))


@pytest.mark.parametrize("n", [0, 1, 23])
def test_few_rows(spark, n):
    got = shard(spark.createDataFrame(ROWS[:n], SCHEMA)).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(k, 0) for k in range(n)]


def test_files_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text", "lang").collect())) == sorted(map(str, docs.select("doc_id", "text", "lang").collect()))
    assert {r.shard for r in back.select("shard").distinct().collect()} == set(range(5))


def test_a_column_named_shard_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i, "en", "s", 1, 100 + i) for i in range(40)], SCHEMA + ", shard int")
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.shard for r in back.collect()) == list(range(100, 140)) and {r._shard for r in back.collect()} == set(range(4))


def test_one_cell_with_most_rows_and_a_very_long_text(spark):
    rows = [(5, "same", "en", "s", 1)] * 400 + [(i, "t" * (i % 9), "de", "r", 1) for i in range(90)] + [(91, "long " * 400_000, "de", "r", 1)]
    got = shard(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert set(map(len, sizes.values())) <= {len(rows) // 24, len(rows) // 24 + 1}
    (long,) = [r for r in got if r.doc_id == 91]
    assert long["size"] == 2_000_008 and long.text_crc32 == zlib.crc32(rows[-1][1].encode())


def test_filters_skip_files(spark, tmp_path):
    """A reader that filters on one dimension skips shards, where its values lie in cells apart."""
    rows = [(i, "t" * (10 if i % 2 else 900), "en" if i % 3 else "de", "s%d" % (i % 4), 1) for i in range(2000)]
    write_shards(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select("shard", "source", "lang", "doc_id").collect()
    for column, most in (("source", 12), ("lang", 18)):
        needed = {}
        for r in back:
            needed.setdefault(r[column], set()).add(r["shard"])
        assert sum(map(len, needed.values())) / len(needed) <= most
    assert sum(max(r.doc_id for r in back if r["shard"] == k) - min(r.doc_id for r in back if r["shard"] == k) < 1500 for k in range(24)) >= 8
