import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing
from millrace.llm.queries import word_tokenizer
from millrace.llm.tokens import ChunkEncoder

ODD = [
    "Hello, WORLD!  it's 2024\n\tend",
    "",
    " \n ",
    "a<|endoftext|>b <|startoftext|>",
    "Ünïcödé é  x y \x1c\x1d z\x85w",
    "ΑΣ ΣΑΣ. ǅ İstanbul 12½ ٣٤",
    "emoji 👩‍👩‍👧 😀😀 !!!???",
    "x" * 5000 + " " + "1" * 300,
]


def test_chunked_ids_equal_whole_ids():
    enc = ChunkEncoder(word_tokenizer(), "<u4", False)
    tok = Tokenizer.from_file(word_tokenizer())
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(ODD) for _ in range(4)) for _ in range(40)]
    for t, ids in zip(texts, enc.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def optimum(sizes, cap):
    """Fewest sequences by depth-first search; small cases only."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                rooms[k] -= sizes[i]
                go(i + 1, rooms)
                rooms[k] += sizes[i]
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_gapless_and_reduction_keeps_an_optimum(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 20, 37])
    sizes = [rng.randint(rng.choice([1, cap // 4]), cap) for _ in range(rng.randint(1, 11))]
    hist = {s: sizes.count(s) for s in sizes}
    starts, seqs, offs, count = packing.plan(hist, cap)
    bins = {}
    for p, s in enumerate(sorted(sizes)):
        k = np.searchsorted(starts, p, "right") - 1
        bins.setdefault(int(seqs[k] + p - starts[k]), []).append((int(offs[k]), s))
    assert len(bins) == count
    for b in bins.values():
        at = 0
        for off, s in sorted(b):
            assert off == at
            at += s
        assert at <= cap
    fixed, rest = packing.reduce_by_dominance(hist, cap)
    assert sum(n for _, n in fixed) + optimum([w for w, n in rest.items() for _ in range(n)], cap) == optimum(sizes, cap)


def test_pack_edge_rows(spark):
    rows = [(1, None, 9, "a"), (2, "", 9, "b"), (3, "word " * 5000, 9, "c"), (4, "a b", 9, None), (4, "a b", 9, None), (None, "x", 9, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, position string").repartition(3)
    placed = packing.pack(docs, word_tokenizer(), with_ids=True)
    got = placed.collect()
    tok = Tokenizer.from_file(word_tokenizer())
    want = []
    for doc, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, i // 2048, i, ids[i : i + 2048]) for i in range(0, len(ids), 2048)]
    key = lambda r: (r[0] or -1, r[1])
    assert sorted([(r.doc_id, r.piece, r.start, packing.decoded(r.ids).tolist()) for r in got], key=key) == sorted(want, key=key)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids) for r in got)
    seqs = packing.sequences(placed).collect()
    assert sum(r.length for r in seqs) == sum(len(w[3]) for w in want) and all(len(r.ids) == 4 * r.length <= 8192 for r in seqs)
    assert len(seqs) == -(-sum(len(w[3]) for w in want) // 2048)


def test_pack_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), word_tokenizer()).collect() == []
