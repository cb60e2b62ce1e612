import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import neardup
from millrace.llm.shingles import COORDS, shingle_set, sketch


def true_set(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [true_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        ids[r] = d if ids.get(r) is None else min(x for x in (ids[r], d) if x is not None)
    return sorted(((d, len(sets[i]), ids[root(i)], d == ids[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def texts(rng, families=25):
    out = []
    for _ in range(families):
        w = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(rng.choice([2, 4, 5, 6, 30, 200, 600]))]
        for _ in range(rng.randint(1, 6)):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 60, len(w) // 12])):
                v[rng.randrange(len(v))] = "z%d" % rng.randint(0, 9)
            out.append(rng.choice([" ", "\n", " \t "]).join(v).upper() if rng.random() < 0.2 else " ".join(v))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ts = [*texts(rng), None, "", " \n", "É é", "é é", "one", "ONE", "x\x1cy"]
    rows = list(zip(rng.sample(range(10_000), len(ts)), ts)) + [(3, "one two"), (3, "one two"), (None, "only null id"), (None, "one")]
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, node int, grp string").repartition(4).cache()
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    left = neardup.drop_near_copies(docs)
    assert left.schema == docs.schema
    want = Counter(c for _, n, c, _ in got if n) .keys()
    stay = [r for r in left.collect() if true_set(r.text)]
    assert sorted((r.doc_id for r in stay), key=str) == sorted(want, key=str)
    assert left.count() - len(stay) == 3


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(5)
    base = ["w%d" % i for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        v = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            v[rng.randrange(120)] = "q%d" % rng.randint(0, 99)
        rows.append((i, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    assert sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_chained_candidates_are_compared_by_bucket(spark):
    """Texts that share bands with their neighbours only: one group, of whose pairs the buckets hold few."""
    rng = random.Random(3)
    words = ["w%d" % rng.randrange(10**6) for _ in range(3000)]
    rows = [(i, " ".join(words[i * 11 : i * 11 + 100])) for i in range(250)]
    rows += [(500 + i, " ".join(words[i * 11 : i * 11 + 97])) for i in range(0, 250, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    seen = neardup._sketched(docs, 85).cache()
    nodes = seen.selectExpr("rid as node", "n_shingles as size")
    units = neardup._units(seen.selectExpr("explode(bands) as key", "rid as node", "n_shingles as size"), nodes).collect()
    per = Counter(r.unit for r in units)
    assert max(per.values()) < len(rows) / 3 and sum(n * n for n in per.values()) < len(rows) ** 2 / 4
    assert sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_long_and_short_texts_do_not_share_blocks(spark):
    rng = random.Random(6)
    long = [" ".join("v%d" % rng.randrange(10**7) for _ in range(n)) for n in (9_000, 40_000)]
    rows = [(i, t + (" tail" * (i % 3))) for i, t in enumerate(long * 3)] + [(50 + i, "a b c d e f") for i in range(5)] + [(90, long[0][: len(long[0]) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    assert sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_bands_follow_from_the_threshold(spark):
    assert neardup.banding(85) == (25, 5) and neardup.banding(80) == (32, 4)
    for percent in range(12, 101):
        bands, rows = neardup.banding(percent)
        assert bands * rows <= COORDS and (1 - (percent / 100) ** rows) ** bands <= 1e-6
    rng = random.Random(8)
    rows = []
    for i in range(150):  # pairs at 51 of 101 shingles, of which 25 bands of 5 rows miss four in ten
        w = ["w%d" % rng.randrange(10**6) for _ in range(80)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:55] + ["z%d" % rng.randrange(10**6) for _ in range(25)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    assert sorted((tuple(r) for r in neardup.near_duplicates(docs, 50).collect()), key=str) == brute(rows, 50)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (3, 40, 500, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 5, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = np.mean([np.mean(sketch(a ^ s) == sketch(b ^ s)) for s in rng.integers(0, 2**63, 30, dtype=np.uint64)])
        assert abs(est - true) < 0.06 and sketch(a).shape == (COORDS,) and (sketch(a) == sketch(a.copy())).all()


def test_shingle_set_sizes():
    for t in [None, "", "a", "a b c d e", "a b c d e f", "a b a b a b a b a b a b"]:
        assert len(shingle_set(None if t is None else t.encode())) == len(true_set(t))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == [] and neardup.drop_near_copies(docs).collect() == []
