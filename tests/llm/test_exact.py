import hashlib
import random
import re

from millrace.llm.exact import drop_copies, exact_groups


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    first = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(
        ((i, first[t], len(groups[t]), i == first[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str
    )


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = ["a" * n for n in (31, 32, 33, 255, 256, 257, 5000)] + ["é" * 200, "x\x00", "x", "", None, " ", "\t\n", "long " * 9000]
    texts = base + [(b or "") + e for b in base for e in ("", "z", "\x00", " ", "\n")]
    rows = [(n, rng.choice(texts)) for n in rng.sample(range(9999), 400)] + [(7, "same"), (7, "same"), (None, "same"), (None, "only null")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, digit string, gid int").repartition(5).cache()
    got = sorted((tuple(r) for r in exact_groups(docs).collect()), key=str)
    assert got == brute(rows)
    left = drop_copies(docs)
    assert left.schema == docs.schema
    want = {}
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        want[k] = min([x for x in (want.get(k), i) if x is not None], default=None)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted(want.values(), key=str)


def test_hot_group(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 300), concat('t', id)) as text")
    got = exact_groups(docs).where("group_size > 1").collect()
    assert len(got) == 1000 and {r.keep_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(docs).collect() == [] and drop_copies(docs).collect() == []


def test_very_long_texts_that_differ_in_the_last_byte(spark):
    long = "word " * 300_000
    rows = [(1, long + "a"), (2, long + "b"), (3, long.replace(" ", "\n", 9) + "a"), (4, long), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, body string, gid int").repartition(3).cache()
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1), 5: (5, 2), 6: (5, 2)}
    left = drop_copies(docs)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 5]
