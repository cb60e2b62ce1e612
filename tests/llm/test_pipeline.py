import random
import re
from collections import Counter, defaultdict

from tests.llm.test_neardup import brute as near_brute

import corpus_pipeline as P
from millrace.llm import mixing
from millrace.llm.queries import word_tokenizer


BAD = ["clown", "idiot", "loser", "scum", "trash", "worthless"]


def corpus(seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(rng.choice([8, 40, 120]))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "en", rng.choice(["a", "b", "b", "b", None])))
        labels.append((i, int(i % 4 > 0), int(toxic)))
    for i in range(240, 300):
        _, text, lang, src = rows[rng.randrange(240)]
        w = text.split()
        if i % 2:
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, "\n".join(w) if i % 3 == 0 else " ".join(w), lang, src))
    rows += [(400, None, None, None), (401, "", "en", "a"), (402, " ", "en", "a")]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    path = str(tmp_path)
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    docs = spark.read.parquet(path + "/documents.parquet")
    out = {}
    for name, step in P.STAGES:
        docs = step(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out[name] = docs.collect()
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    bad = set(BAD)
    assert Counter(r.doc_id for r in out["toxicity"]) == Counter(i for i, t, *_ in rows if not bad & set((t or "").split()))
    first = {}
    for r in sorted(out["toxicity"], key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in out["exact_dedup"]) == sorted(first.values())
    kept = [d for d, _, _, k in near_brute([(r.doc_id, r.text) for r in out["exact_dedup"]], P.NEAR) if k]
    assert sorted(r.doc_id for r in out["near_dedup"]) == sorted(kept)
    size, taken = defaultdict(int), defaultdict(int)
    for r in out["near_dedup"]:
        size[r.source] += len((r.text or "").split())
    for r in out["mix"]:
        taken[r.source] += len((r.text or "").split())
    from tests.llm.test_mixing import brute_targets

    for s, goal in brute_targets(dict(size)).items():
        assert abs(taken[s] - goal) < 8  # all sizes are multiples of 8
    assert set(Counter(r.doc_id for r in out["mix"]).values()) <= {1, 2, 3} and mixing.MAX_REPEATS == 3
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_tokenizer())
    total = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in out["mix"])
    assert sum(r.length for r in out["pack"]) == total
    again = P.run(spark, path)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out["pack"])


CLASHES = ["rid", "row", "node", "cls", "n", "key", "copies", "comp", "_at", "spans"]


def test_stages_on_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    rng = random.Random(8)
    long = " ".join("w%d" % rng.randrange(10**6) for _ in range(60_000))
    near = long.replace(" w", " v", 40)
    rows = [(1, long, "en", "a"), (2, near, "en", "b"), (3, None, None, None), (4, "", None, "a"), (None, "no id here at all", "en", None), (None, "no id here at all", "en", None)]
    rows += [(5, "one two three four five six", "en", "b")] * 3 + [(6, "one  two three four five\nsix", None, "b"), (7, "clown one", "en", "a"), (8, "ok then", "en", "a")]
    rows += [(100 + i, f"{'clown ' if i % 3 == 0 else ''}green stone {i}", "en", "a") for i in range(60)]
    labels = [(100 + i, None if i % 5 == 0 else 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (9999, 0, 1), (5, 1, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    full = [(*r, None, *["x"] * len(CLASHES)) for r in rows]
    path = str(tmp_path)
    spark.createDataFrame(full, kinds).repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    docs, ids = spark.read.parquet(path + "/documents.parquet"), {}
    for name, step in P.STAGES:
        out = step(spark, docs, path)
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        ids[name] = Counter(r.doc_id for r in docs.collect())
    toxic = {7} | {100 + i for i in range(0, 60, 3)}
    assert ids["toxicity"] == Counter(r[0] for r in rows if r[0] not in toxic)
    assert ids["exact_dedup"] == Counter({1, 2, 3, None, 5, 8} | {100 + i for i in range(60) if i % 3})
    assert ids["near_dedup"] == ids["exact_dedup"] - Counter([2])
    assert set(ids["mix"]) <= set(ids["near_dedup"]) and set(ids["pack"]) == set(ids["mix"])


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    assert P.run(spark, path).collect() == []
