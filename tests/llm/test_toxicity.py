import random

import numpy as np

from millrace.llm import toxicity as T

INSULTS = ["clown", "idiot", "loser", "moron", "stupid"]
SCORN = ["disgusting", "pathetic", "scum", "trash", "worthless"]
CLEAN = ["the", "and", "river", "stone", "walks", "quiet", "morning", "paper", "green", "seven", "haus", "réau"]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "", "s", "ly"]) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice([*(INSULTS if i % 2 else SCORN), "réeux" + rng.choice(["a", "o", "le"])]))
        docs.append((i, " ".join(words), "x", 1))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(1500, 1)
    truth = dict(labels)
    extra = [(5000, None, None, None), (5001, "", "x", 1), (5002, "w " * 20000 + "idiot scum moron", "x", 1), (5003, "morning", "x", 1), (5003, "morning", "x", 1), (None, "stone", "x", 1)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, found string, rejected int").repartition(4).cache()
    lab = spark.createDataFrame([(i, y, i % 3 and 1) for i, y in labels[:900]] + [(7, None, 1), (None, 1, 1), (99999, 1, 1), (8, truth[8], 1)], "doc_id long, toxic int, quality int")
    got = T.toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    held = [r for r in got if r.doc_id is not None and 900 <= r.doc_id < 1500]
    wrong = sum(r.rejected != bool(truth[r.doc_id]) for r in held)
    assert wrong <= 6
    by = {r.doc_id: r for r in got}
    assert by[5002].rejected and not by[5000].rejected and not by[5001].rejected and not by[5003].rejected
    # The learnt themes tell the two kinds of toxic documents apart.
    first = [r.p_theme_1 > r.p_theme_2 for r in held if r.rejected and set(INSULTS) & set(docs[r.doc_id][1].split())]
    second = [r.p_theme_1 > r.p_theme_2 for r in held if r.rejected and set(SCORN) & set(docs[r.doc_id][1].split())]
    assert abs(sum(first) / len(first) - sum(second) / len(second)) > 0.6
    left = T.drop_toxic(d, lab)
    assert left.schema == d.schema
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(r.doc_id) for r in got if not r.rejected)
    assert sorted(map(str, got)) == sorted(map(str, T.toxicity(d, lab).collect()))


def test_later_models_use_earlier_ones():
    rng = np.random.default_rng(0)
    n = 400
    first = rng.random(n) < 0.5
    sets = [np.array([0] if f else [1]) for f in first]
    y = np.column_stack([first, first]).astype(float)
    chain = T.fit_chain(T.Rows(sets, 2), y, np.arange(n) % T.FOLDS, {"a": 0, "b": 1})
    assert chain.models[1].dense[0] > 0
    p = chain.probabilities(T.Rows([np.array([0]), np.array([1])], 2))
    assert p[0].min() > 0.9 and p[1].max() < 0.1


def plain_fit(x, dense, y, steps=150):
    """The same regression on a dense matrix, one parameter vector and no sparse sums."""
    a = np.column_stack([x, dense, np.ones(len(y))])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    theta = np.zeros(a.shape[1])
    theta[-1] = np.log(rate / (1 - rate))
    if y.min() == y.max():
        return theta
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = a.T @ ((1 / (1 + np.exp(-(a @ theta))) - y) / len(y)) + np.append(np.full(len(theta) - 1, 1e-4), 0) * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.3 / (1 + 0.02 * t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta


def test_chain_against_brute_force():
    """Every model and every out-of-fold column, from plain matrices and loops over the folds."""
    rng = np.random.default_rng(4)
    n, width = 120, 9
    x = (rng.random((n, width)) < 0.3).astype(float)
    y = np.column_stack([x[:, 0], np.maximum(x[:, 1] * x[:, 0], x[:, 2]), (x[:, :4].sum(axis=1) > 1).astype(float)])
    folds = rng.integers(0, T.FOLDS, n)
    rows = T.Rows([np.flatnonzero(r) for r in x], width)
    chain = T.fit_chain(rows, y, folds, {})
    dense, odds = np.zeros((n, 0)), np.zeros((n, 0))
    for k in range(3):
        whole = plain_fit(x, dense, y[:, k])
        assert np.allclose(np.concatenate([chain.models[k].weights, chain.models[k].dense, [chain.models[k].bias]]), whole, atol=1e-6)
        odds = np.column_stack([odds, np.clip(np.column_stack([x, odds, np.ones(n)]) @ whole, -14, 14)])
        out = np.zeros(n)
        for f in range(T.FOLDS):
            theta = plain_fit(x[folds != f], dense[folds != f], y[folds != f, k])
            for i in np.flatnonzero(folds == f):
                out[i] = np.concatenate([x[i], dense[i], [1.0]]) @ theta
        dense = np.column_stack([dense, np.clip(out, -14, 14)])
    assert np.allclose(chain.probabilities(rows), 1 / (1 + np.exp(-odds)), atol=1e-6)
    tries = np.unique(np.concatenate([1 / (1 + np.exp(-dense[:, -1])), np.linspace(0.001, 0.999, 999)]))
    score = lambda t: 2 * (y[:, 2] * (1 / (1 + np.exp(-dense[:, -1])) >= t)).sum() / ((1 / (1 + np.exp(-dense[:, -1])) >= t).sum() + y[:, 2].sum())
    assert score(chain.threshold) == max(map(score, tries))


def test_threshold_and_themes():
    odds = np.array([3.0, 2.0, 2.0, -1.0, -2.0])
    assert T.best_threshold(odds, np.array([1, 1, 1, 0, 0])) == 0.5
    assert 0.12 < T.best_threshold(odds, np.array([1, 1, 1, 1, 0])) < 0.27
    assert T.best_threshold(np.zeros(3), np.array([1, 0, 0])) <= 0.5 and T.best_threshold(odds, np.zeros(5)) == 0.5
    rows = T.Rows([np.array(s, int) for s in ([0], [0, 1], [2], [2, 3], [], [4], [4], [4], [4])], 5)
    y = np.array([1, 1, 1, 1, 1, 0, 0, 0, 0.0])
    got = T.themes(rows, y)
    assert (got[0] == got[1]).all() and (got[2] == got[3]).all() and (got[0] != got[2]).all() and got[4:].sum() == 0
    assert T.themes(rows, np.zeros(9)).sum() == 0


def test_sampling_has_no_ties_to_break(spark):
    docs = spark.createDataFrame([(i % 40, f"stone {'scum' if i % 4 == 0 else 'green'} {i}", "extra") for i in range(160)], "doc_id long, text string, y string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(40)], "doc_id long, toxic int, quality int")
    runs = [T.learn(docs.repartition(k), lab, sample=30) for k in (1, 5)]
    assert runs[0].features == runs[1].features and runs[0].threshold == runs[1].threshold
    assert all((a.weights == b.weights).all() for a, b in zip(runs[0].models, runs[1].models))


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert [r.rejected for r in T.toxicity(docs, none).collect()] == [False]
    one = spark.createDataFrame([(1, 1, None)], "doc_id long, toxic int, quality int")
    assert [r.rejected for r in T.toxicity(docs, one).collect()] == [False]
    assert T.toxicity(docs.limit(0), none).collect() == [] and T.drop_toxic(docs.where("false"), one).collect() == []
