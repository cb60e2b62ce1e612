"""Personal data in texts by weak supervision, in DataFrame functions throughout.

Candidate spans come from strict patterns and from looser ones. Labelers vote on
each candidate, for it, against it or not at all: the kind's strict rule, a gazetteer
of fixed values, the words before it, and the characters around it. The votes'
patterns are counted over the whole corpus, and expectation-maximisation estimates
from the counts how often each labeler votes for true and for false candidates. The
posteriors then train the span classifier, a naive Bayes model over the votes and the
span's kind and length, whose log-odds decide on every candidate. Spans that the
strict rules accept are reported in any case.

A text's matches become rows, and running sums over them give their places, so the
work grows in proportion to the matches of a text, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
#: Log-odds from which the classifier adds a span.
DECIDE = 2.2
ROUNDS = 12
#: Code points of the blocks that redaction cuts texts into, so that a span costs no pass over the text.
REDACT_BLOCK = 1024

# The strict patterns. Possessive repeats and the guard in front leave
# the matches as they are and keep matching linear and free of recursion.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser patterns, whose spans only the classifier can accept.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![A-Za-z])(?:api[_-]?key|passwd|password|secret|token)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{16,}+\"?",
}
# A cheap test that a text can hold a match of the pattern at all.
HINT = {
    ("email", 0): lambda t: F.contains(t, F.lit("@")),
    ("ip", 0): lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    ("card", 0): lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")),
    ("phone", 0): lambda t: F.contains(t, F.lit("+")),
    ("email", 1): lambda t: F.rlike(t, F.lit(r"[\[(]at[\])]")),
    ("phone", 1): lambda t: F.rlike(t, F.lit(r"[0-9]{3}[\x20.-][0-9]{4}")),
    ("secret", 1): lambda t: F.rlike(t, F.lit(r"[=:]\x20?\"?[A-Za-z0-9+/_-]{16}")),
}
# Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": r"(?i)\b(?:address|contact|e-?mail|mail|write)\b",
    "ip": r"(?i)\b(?:address|client|from|host|ip|server)\b",
    "card": r"(?i)\b(?:account|amex|card|credit|mastercard|payment|visa)\b",
    "phone": r"(?i)\b(?:call|cell|contact|fax|mobile|phone|tel)\b",
    "secret": r"(?i)\b(?:auth|credential|key|login|private)\b",
}
AGAINST = r"(?i)(?:\b(?:build|isbn|number|order|page|release|section|serial|version)\b|[#$€£v])\W*$"
# The gazetteer's endings, prefixes and ranges, by kind.
GAZETTEER = {
    "email": r"(?i)\.(?:ac|biz|ca|co|com|de|edu|es|fr|gov|info|io|mil|net|org|uk|us)$",
    "ip": r"^(?:10|172|192|100|127|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6[045])",
    "phone": r"^(?:\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1-6]|9[0-8])|\(?[2-9][0-9]{2})",
    "secret": r"[0-9]",
}

def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.split(F.reverse(digits), "")

    def add(total: Column, x: Column) -> Column:
        d = x.cast("int") * (F.lit(1) + total["i"] % 2)
        return F.struct((total["i"] + 1).alias("i"), (total["s"] + F.when(d > 9, d - 9).otherwise(d)).alias("s"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"))
    return F.aggregate(F.filter(turned, lambda x: x != ""), start, add)["s"] % 10 == 0


def accepted(kind: str, span: Column) -> Column:
    """Whether a match of the strict pattern is of its kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        small = lambda p: F.concat(F.lit("0"), F.left(plain(p), F.lit(3))).cast("int") <= 255
        return F.forall(F.split(span, r"\."), lambda p: (F.length(plain(p)) <= 3) & small(p))
    digits = _digits(span)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    return F.length(digits).between(10, 15)


def _matches(text: Column, source: int, pattern: str, hint: Column) -> Column:
    """Array of (source, m, gap, left, right): each match with the code points between it and the one before."""
    none = F.array().cast("array<string>")
    hits = F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(hint, F.split(text, pattern, -1)).otherwise(none)
    parts = F.arrays_zip(hits.alias("m"), gaps.alias("gap"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("next"))
    found = F.filter(parts, lambda x: x["m"].isNotNull())
    return F.transform(found, lambda x: F.struct(
        F.lit(source).alias("source"), x["m"].alias("m"), F.length(x["gap"]).alias("gap"), F.right(x["gap"], F.lit(32)).alias("left"), F.left(x["next"], F.lit(1)).alias("right")
    ))


SOURCES = [(k, True, p) for k, p in STRICT.items()] + [(k, False, p) for k, p in LOOSE.items()]


def _by_source(f: Callable[[str, bool], Column]) -> Column:
    """``f`` of the kind and strictness of the row's source."""
    return reduce(lambda out, i: out.when(F.col("source") == i, f(*SOURCES[i][:2])), range(1, len(SOURCES)), F.when(F.col("source") == 0, f(*SOURCES[0][:2])))


def candidates(docs: DataFrame) -> DataFrame:
    """rid, kind, start, end, strict, v1 to v4, size: every candidate with the labelers' votes, 1, -1, or 0 for none.

    Texts are read whole; rid numbers the rows of ``docs``, and rows without candidates do not appear.
    """
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    found = [_matches(text, i, p, HINT[k, int(not s)](text)) for i, (k, s, p) in enumerate(SOURCES)]
    rows = rows.select("rid", F.posexplode(F.flatten(F.array(*found))).alias("at", "x")).select("rid", "at", "x.*")
    # One exchange of the matches by row number serves both windows.
    so_far = Window.partitionBy("rid", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("rid").withColumn("end", F.sum(F.col("gap") + F.length("m")).over(so_far).cast("int"))
    rows = rows.withColumn("start", F.col("end") - F.length("m"))
    m, left = F.col("m"), F.col("left")
    rows = rows.withColumn("kind", _by_source(lambda k, _: F.lit(k))).withColumn("strict", _by_source(lambda k, s: accepted(k, m) if s else F.lit(False)))
    rule = _by_source(lambda _, s: F.when(F.col("strict"), 1).otherwise(-1) if s else F.lit(0))
    known = _by_source(lambda k, _: F.when(F.rlike(m, F.lit(GAZETTEER[k])), 1).otherwise(-1))
    cue = _by_source(lambda k, _: F.when(F.rlike(left, F.lit(CUES[k])), 1).when(F.rlike(left, F.lit(AGAINST)), -1).otherwise(0))
    joined = F.rlike(F.concat(F.right(left, F.lit(1)), F.lit(" "), F.col("right")), F.lit(r"[\p{L}\p{N}_@]"))
    size = F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("int")
    rows = rows.select(
        "rid", "kind", "start", "end", "strict", rule.alias("v1"), known.alias("v2"), cue.alias("v3"), F.when(joined, -1).otherwise(1).alias("v4"), size.alias("size")
    )
    # Runs of fewer than 12 characters are cards no labeler could take for one: 14 digits are the least.
    rows = rows.where("strict or kind <> 'card' or size >= 3")
    # What lies inside a strict span is part of it; what reaches beyond one is voted on.
    until = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    cover = F.max(F.when(F.col("strict"), F.col("end"))).over(until)
    return rows.withColumn("cover", cover).where("strict or cover is null or cover < end").drop("cover")


_VOTES = ("v1", "v2", "v3", "v4")


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Log-likelihood ratios by (labeler, vote) and log prior odds by kind, by expectation-maximisation.

    ``patterns`` has a row per kind, votes and size with its count n: a table whose
    rows the votes' values bound. Posteriors start from the majority of votes.
    """
    kinds = [*KINDS, "secret"]
    terms = [(v, x) for v in _VOTES for x in (-1, 0, 1)]
    odds: Column = sum((F.col(v) for v in _VOTES), F.lit(0)) * F.lit(1.5)
    ratio: dict[tuple, float] = {}
    for _ in range(rounds):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))
        yes, no = F.col("n") * p, F.col("n") * (F.lit(1.0) - p)
        sums = [F.sum(F.when(F.col(v) == x, w).otherwise(0.0)) for v, x in terms for w in (yes, no)]
        sums += [F.sum(F.when(F.col("kind") == k, w).otherwise(0.0)) for k in kinds for w in (yes, no)]
        got = [x or 0.0 for x in patterns.agg(F.sum(yes), F.sum(no), *sums).first()]
        total = got[:2]
        pairs = list(zip(got[2::2], got[3::2]))
        new = {t: math.log((a + 0.5) / (total[0] + 1.5)) - math.log((b + 0.5) / (total[1] + 1.5)) for t, (a, b) in zip(terms, pairs)}
        new |= {("kind", k): math.log((a + 0.5) / (b + 0.5)) for k, (a, b) in zip(kinds, pairs[len(terms) :])}
        still = ratio and max(abs(new[t] - ratio[t]) for t in new) < 1e-4
        ratio = new
        odds = reduce(lambda o, t: o + F.when(F.col(t[0]) == t[1], F.lit(ratio[t])).otherwise(0.0), ratio, F.lit(0.0))
        if still:
            break
    return ratio


def span_classifier(patterns: DataFrame) -> dict[str, float]:
    """Log-odds of each pattern ``kind|v1|v2|v3|v4|size``: naive Bayes trained on the posteriors."""
    ratio = reliabilities(patterns)
    odds = reduce(lambda o, t: o + F.when(F.col(t[0]) == t[1], F.lit(ratio[t])).otherwise(0.0), ratio, F.lit(0.0))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))
    rows = patterns.withColumn("yes", F.col("n") * p).withColumn("no", F.col("n") - F.col("yes"))
    totals = rows.groupBy("kind").agg((F.sum("yes") + 1).alias("ty"), (F.sum("no") + 1).alias("tn"))
    by_size = rows.groupBy("kind", "size").agg(F.sum("yes").alias("sy"), F.sum("no").alias("sn"))
    shape = F.log((F.col("sy") + 0.5) / F.col("ty")) - F.log((F.col("sn") + 0.5) / F.col("tn"))
    sized = rows.join(by_size, ["kind", "size"]).join(totals, "kind").withColumn("odds", odds + shape)
    key = F.concat_ws("|", "kind", *_VOTES, "size")
    return {r.k: r.odds for r in sized.select(key.alias("k"), "odds").collect()}


_ORDER = {k: i for i, k in enumerate((*KINDS, "secret"))}


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _decided(docs: DataFrame, decide: float) -> DataFrame:
    """rid and ``spans`` (start, o, end, kind, strict): all that the strict rules or the classifier accept, of rows that have any."""
    found = stage(candidates(docs), "candidates")
    patterns = stage(found.groupBy("kind", *_VOTES, "size").agg(F.count("*").alias("n")), "patterns")
    added = sorted(k for k, odds in span_classifier(patterns).items() if odds >= decide)
    chosen = F.concat_ws("|", "kind", *_VOTES, "size").isin(added) if added else F.lit(False)
    order = reduce(lambda out, k: out.when(F.col("kind") == k, _ORDER[k]), KINDS, F.when(F.col("kind") == "secret", _ORDER["secret"]))
    # A span that two patterns find is one.
    once = found.where(F.col("strict") | chosen).groupBy("rid", "start", order.alias("o"), "end", "kind").agg(F.max("strict").alias("strict"))
    return stage(once.groupBy("rid").agg(F.collect_list(F.struct("start", "o", "end", "kind", "strict")).alias("spans")), "spans")


def personal_data(docs: DataFrame, decide: float = DECIDE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The counts of kinds and the digest are of the spans that the strict rules accept;
    ``spans`` has these and the spans the classifier adds, kind secret included, and
    ``n_spans`` counts them. Null and empty texts have none. Repeated rows are reported
    each; an empty table gives no rows. Only doc_id and text are read, and ``docs`` must
    re-read alike: row numbers name rows. Positions are code points, ends exclusive.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id")
    none = F.array().cast("array<struct<start:int,o:int,end:int,kind:string,strict:boolean>>")
    rows = rows.join(_decided(docs, decide), "rid", "left").withColumn("spans", F.coalesce("spans", none))
    base = F.filter("spans", lambda s: s["strict"])
    return rows.select(
        "doc_id",
        *[_count(base, k) for k in KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, decide: float = DECIDE) -> DataFrame:
    """doc_id and text of each row with every span replaced by its kind in angle brackets.

    Of spans that overlap, the first is replaced and what others have beyond it goes too.
    Null texts become empty; rows are as in ``personal_data``.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = _decided(docs, decide).select("rid", F.explode("spans").alias("s")).select("rid", "s.*")
    # Spans that overlap make one island.
    order = Window.partitionBy("rid").orderBy("start", "o", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("fresh", (seen.isNull() | (F.col("start") >= seen)).cast("int"))
    one = one.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = one.groupBy("rid", "island").agg(F.min(F.struct("start", "o", "kind")).alias("f"), F.max("end").alias("end"))
    ends = F.array_sort(F.collect_list(F.struct("f.start", "end", F.col("f.kind").alias("kind"))))
    found = rows.join(islands.groupBy("rid").agg(ends.alias("spans")), "rid", "left")

    def put(blocks: Column) -> Column:
        """The text between islands, read from the blocks it lies in only, with the islands' marks."""
        stops = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
        starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.col("size")))
        marks = F.concat(F.transform("spans", lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))), F.array(F.lit("")))
        parts = F.arrays_zip(stops.alias("a"), starts.alias("b"), marks.alias("m"))
        at = lambda x: F.floor(x / REDACT_BLOCK).cast("int")
        held = lambda p: F.array_join(F.slice(blocks, at(p["a"]) + 1, at(p["b"]) - at(p["a"]) + 1), "")
        return F.array_join(F.transform(parts, lambda p: F.concat(F.substring(held(p), p["a"] % REDACT_BLOCK + 1, p["b"] - p["a"]), p["m"])), "")

    blocks = F.array(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % REDACT_BLOCK), F.lit(0)))  # bound once, not once per span
    found = found.withColumn("size", F.length("text"))
    return found.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.transform(blocks, put)[0]).alias("text"))
