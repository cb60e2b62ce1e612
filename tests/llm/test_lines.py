import random

import pytest

from millrace.llm import lines


def brute(rows, least):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    docs = [(rows[k][1] or "").split("\n") for k in order]
    gone = [set() for _ in docs]
    seen = set()
    for d, ls in enumerate(docs):
        for s in range(len(ls)):
            for e in range(s + 1, len(ls) + 1):
                if sum(len(x.split()) for x in ls[s:e]) >= least:
                    key = tuple(ls[s:e])
                    if key in seen:
                        gone[d].update(range(s, e))
                    seen.add(key)
    out = []
    for k, ls, g in zip(order, docs, gone):
        out.append((rows[k][0], len(ls), len(g), "\n".join(x for i, x in enumerate(ls) if i not in g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, least", [(1, 10), (2, lines.MIN_WORDS), (3, lines.MIN_WORDS), (4, 1)])
def test_against_brute_force(spark, seed, least):
    rng = random.Random(seed)
    pool = ["a b c", "d", "", "e f", "g h i j k", "l m", "\r", "a b c d e f g h i j k l"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in rng.sample(range(999), 40)]
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, rows[1][1] + "\n" + rows[1][1])]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, i int, r string").repartition(3).cache()
    want = brute(rows, least)
    report = lines.line_report(docs, least).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed) for r in report), key=str) == sorted([w[:3] for w in want], key=str)
    left = lines.drop_repeated_lines(docs, least)
    assert left.schema == docs.schema
    assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=str) == sorted([(w[0], w[3]) for w in want], key=str)


def test_repeated_rows_keep_one(spark):
    t = "one two three\nfour five\nsix"
    docs = spark.createDataFrame([(1, t), (1, t), (1, t)], "doc_id long, text string")
    assert sorted(r.n_removed for r in lines.line_report(docs, 6).collect()) == [0, 3, 3]


def test_one_line_in_a_third_of_all_places_and_a_long_text(spark):
    hot = "every page ends with these words"
    rows = [(i, f"text {i} of its own has six words\n{hot}") for i in range(60)]
    rows.append((60, "\n".join([f"line {k} of one long text here" for k in range(20_000)] + [hot, "", "few"])))
    rows += [(61, rows[60][1]), (62, "few\n\nfew"), (63, None), (64, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, spans int").repartition(4).cache()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in lines.line_report(docs).collect()}
    assert got[0] == (2, 0, "") and all(got[i] == (2, 1, "1-2") for i in range(1, 60))
    assert got[60] == (20_003, 1, "20000-20001") and got[61] == (20_003, 20_003, "0-20003")
    assert got[62] == (3, 0, "") and got[63] == (1, 0, "") and got[64] == (1, 0, "")
    left = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    assert left[60] == rows[60][1].replace(hot + "\n", "") and left[61] == "" and left[63] is None and left[64] == ""


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_report(docs).collect() == [] and lines.drop_repeated_lines(docs).collect() == []
