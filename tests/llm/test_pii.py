import hashlib
import random
import re

from millrace.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(x) for x in reversed(d)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(s)) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    out = []
    for o, (kind, p) in enumerate(PATTERNS.items()):
        out += [(m.start(), o, m.end(), kind) for m in re.finditer(p, text or "", re.ASCII) if valid(kind, m[0])]
    return [(k, s, e) for s, _, e, k in sorted(out)]


PARTS = [
    "a.b+c@mail.example.com", "x@y", "x@y.z@w.v", "@a.b", "u@h.co_x@y.org", "..@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111",
    "4111111111111112", "4111-1111-1111-1111 ", "+1 (132) 555-1352", "+12", "+1--2", "+44 20 7946 0958 ", "+1234567890123456", "é", "😀", " ", "\n", ",", "12", "word", "+", "1 2 3",
    'token = "5d190bd7c06284de91015a36974748794293dd8a"', "call 212-555-0147", "jo [at] mail [dot] com",
]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "9" * 60000, "1 " * 40000, "a" * 60000, "+" * 3000, "1." * 20000, "x@y.zz " * 800]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a@b.cd")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, found string, kind int").repartition(6).cache()
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        want, r = brute(t), by[i]
        joined = ",".join("%s:%d:%d" % x for x in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t, r.spans, joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in want) for k in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(joined.split(",")) - {""} <= set(spans) and len(set(spans)) == len(spans) == r.n_spans


def test_labelers_learn_and_add(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        pick = rng.choice([f"mail a{i}@mail.example.com now", f"call +1 212 555 {1000 + i} now", f"x token = \"{rng.getrandbits(160):040x}\" y", f"call 212-555-{1000 + i} ok", f"version 900.1.{i}.4444 out", "nothing here"])
        rows.append((i, pick))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, t in rows:
        if "token" in t:
            assert got[i].spans.startswith("secret:2:")
        if "212-555" in t:
            assert got[i].spans.startswith("phone:5:")
        if "version" in t or "nothing" in t:
            assert got[i].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, t in rows:
        assert "@" not in clean[i] and "555" not in clean[i]
        if not got[i].spans:
            assert clean[i] == t


def test_candidates_beyond_strict_spans_are_kept(spark):
    rng = random.Random(4)
    card, phone = "4111111111111111", "+12125550147"
    rows = [(i, f'x token = "{rng.getrandbits(160):040x}" y') for i in range(300)]
    rows += [(300 + i, f"pay {card} or call {phone} now") for i in range(100)]
    inner = {1000: "a5d19b" + card + "c7d8e9fa0b1c2d3e4f", 1001: "Ab3dEfGh1jKlMnOpQ" + phone + "x9YzAb3dEfGhJkLm"}
    rows += [(k, f'x token = "{v}" y') for k, v in inner.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.personal_data(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for k, v in inner.items():
        at = 11 + v.index(card if k == 1000 else phone)
        kind = "card" if k == 1000 else "phone"
        assert got[k] == [f"secret:2:{12 + len(v)}", f"{kind}:{at}:{at + len(card if k == 1000 else phone)}"], got[k]
        assert clean[k] == 'x <secret> y'
    assert all(got[i] == ["card:4:20", "phone:29:41"] for i in range(300, 400))


def test_two_hundred_thousand_matches_in_one_text(spark):
    import time

    n = 200_000
    rows = [(1, "".join(f"é{k}@x.io, " for k in range(n))), (2, "no data"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    began = time.time()
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[1].n_email == n and got[2].n_spans == got[3].n_spans == 0
    joined = ",".join("%s:%d:%d" % x for x in brute(rows[0][1]))
    assert got[1].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean == {1: "é<email>, " * n, 2: "no data", 3: ""}
    assert time.time() - began < 120


def test_empty(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
