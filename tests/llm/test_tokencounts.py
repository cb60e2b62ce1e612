import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import tokencounts as T
from millrace.llm.queries import word_tokenizer


def test_against_tokenizer(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a<|endoftext|>b", "é 😀 x", "word " * 3000] + [" ".join(rng.choice(["the", "Anea,", "x1"]) for _ in range(rng.randint(0, 50))) for _ in range(200)]
    rows = [(i, t, "k", 3) for i, t in enumerate(texts)] + [(5, "twice", "k", 3), (5, "twice", "k", 3), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, start int").repartition(5).cache()
    tok = Tokenizer.from_file(word_tokenizer())
    tok.encode_special_tokens = True
    want = sorted(((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows), key=str)
    got = T.document_token_counts(docs, word_tokenizer()).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want
    ends = sorted((r.start, r.start + r.n_tokens + 1) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


@pytest.fixture
def ranges(spark):
    """Makes the reader deal out byte ranges of the size given."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]

    def put(size):
        for n, v in zip(names, (size, 1)):
            spark.conf.set(n, str(v))

    yield put
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.mark.parametrize("end, low, high", [(5, 0, 6), (0x0505, 0x0503, 0x0507), (0xC0FF, 0xC0FD, 0xC102), (0xFF00, 0xFEFE, 0xFF03), (0x00FF, 0x00FD, 0x0102)])
def test_documents_across_blocks_and_files(spark, tmp_path, ranges, end, low, high):
    rng = np.random.default_rng(4)
    stream = rng.integers(low, high, 997).astype("<u2")
    odd = rng.random(997) < 0.3  # bytes of the separator where no separator stands
    stream[odd] = rng.choice([(end & 255) << 8 | end >> 8, (end >> 8) << 8 | end >> 8, (end & 255) << 8 | (end & 255)], odd.sum())
    stream[[100, 639, 900]] = end
    cuts = [0, 100, 100, 101, 640, 997]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"f{k}.bin").write_bytes(stream[a:b].tobytes())
    (tmp_path / "g.bin").write_bytes(np.array([1, 2], "<u2").tobytes())
    ends = np.flatnonzero(stream == end)
    starts = np.concatenate([[0], ends[:-1] + 1])
    want = [(k, s, e - s) for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist()))]
    for size in (33, 200, 1 << 20):
        ranges(size)
        got = T.count_tokens(spark, str(tmp_path), end).orderBy("ordinal").collect()
        assert [(r.ordinal, r.start, r.n_tokens) for r in got] == want, size


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    stream = np.random.default_rng(5).integers(0, 50_000, 2_000_000).astype("<u2")
    (tmp_path / "f.bin").write_bytes(stream.tobytes())
    ranges(1 << 18)
    assert T._scan(spark, str(tmp_path), T.END).where("kind = 1").count() >= 15
    got = T.count_tokens(spark, str(tmp_path)).orderBy("ordinal").collect()
    ends = np.flatnonzero(stream == T.END)
    assert [r.n_tokens + 1 for r in got] == np.diff(np.concatenate([[-1], ends])).tolist()


def test_empty(spark):
    assert T.document_token_counts(spark.createDataFrame([], "doc_id long, text string"), word_tokenizer()).collect() == []
