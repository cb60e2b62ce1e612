"""Repair of conversations by a fold over their turns.

Windows mark each row's faults. A conversation's rows are then collected in order and
``aggregate`` folds them: it carries the cheapest (cost, audit) for each of the four states
that the roles so far can be in, nothing yet, a system turn, a user's turn last, an
assistant's turn last, and moves them on with ``least``, which orders by cost and then by
audit. Audits of equal cost and length never begin one another, so the lesser one stays the
lesser whatever follows, and the audit tells all edits.

A conversation beyond ``LONG`` rows or ``LONG_BYTES`` is not collected whole: its rows are
range partitioned, pieces of it are folded from each of the four states, and the pieces'
outcomes, costs and audits without texts, are folded in their turn. Texts pass through one
after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import beside, give_back, partitions, stage

#: Rows and bytes up to which a conversation is collected, and rows of a piece of a longer one.
LONG, LONG_BYTES, PIECE = 4096, 16 << 20, 4096
#: What white space of the contracts consists of.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
STATES = ("none", "system", "user", "assistant")
_BEST = "struct<cost:bigint,audit:string>"

#: Faults that a row is reported with.
FAULTS = ("blank", "duplicate", "truncated")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with seeded damage, as rows (conv_id, turn, role, text, copy, gone).

    Null roles and texts become one space. By crc32 of ``conv_id:turn`` (null: one space)
    modulo 20 a row is dropped (0), emptied (1), loses its ``.!?`` (2), stands twice (3) or
    gets the role user (4). Dropped rows stay as ``gone``, so that no conversation is lost.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("how") == 0).alias("gone"))


def _marked(rows: DataFrame, seen: Column) -> DataFrame:
    """Add ``fault`` (the first that applies, or null) and ``initial``, the role's first character."""
    shown = F.rtrim("text", F.lit(SPACE))
    fault = F.when(shown == "", FAULTS[0]).when(seen, FAULTS[1]).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), FAULTS[2])
    return rows.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))


def _then(p: Column, cost: Column | int, letter: Column | str) -> Column:
    cost, letter = (F.lit(x) if isinstance(x, (int, str)) else x for x in (cost, letter))
    return F.when(p.isNotNull(), F.struct((p.getField("cost") + cost).alias("cost"), F.concat(p.getField("audit"), letter).alias("audit")))


def _struct(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(*[c.alias(s) for c, s in zip((none, system, user, assistant), STATES)])


def _bound(value: Column, use: object) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _opened(at: Column) -> Column:
    """The states after at most one insertion; two in a row lead back or cost more than a deletion."""
    none, system, user, assistant = (at.getField(s) for s in STATES)
    inserted = [_then(p, INSERT, "I") for p in (none, system, assistant)]
    return _struct(none, system, F.least(user, *inserted), F.least(assistant, _then(user, INSERT, "I")))


def _moved(at: Column, row: Column) -> Column:
    """The states after a row that has ``initial`` and ``fault``."""
    none, system, user, assistant = (at.getField(s) for s in STATES)
    fault = F.coalesce(row.getField("fault"), F.lit(""))
    stays = ~fault.isin(*FAULTS[:2])
    extra = F.when(fault == FAULTS[2], UNFINISHED).otherwise(0)

    def spoken(p: Column, initial: str) -> Column:
        """The row as a turn of the role with this initial: kept if it is one, else given it."""
        same = row.getField("initial") == initial
        return F.when(stays, _then(p, extra + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R")))

    kept = F.when(stays & (row.getField("initial") == "s"), _then(none, extra, "K"))
    gone = [_then(p, DELETE, "D") for p in (none, system, user, assistant)]
    return _struct(gone[0], F.least(gone[1], kept), F.least(gone[2], *(spoken(p, "u") for p in (none, system, assistant))), F.least(gone[3], spoken(user, "a")))


def _start(state: str) -> Column:
    return _struct(*[F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")) if s == state else F.lit(None).cast(_BEST) for s in STATES])


def _folded(rows: Column, state: str) -> Column:
    """All four states after ``rows``, begun in ``state``."""
    return F.aggregate(rows, _start(state), lambda at, row: _bound(_opened(at), lambda open_: _moved(open_, row)))


def _ended(at: Column) -> Column:
    """The best (cost, audit) of roles that may end."""
    return _bound(at, lambda last: _bound(_opened(last), lambda p: F.least(p.getField("none"), p.getField("assistant"))))


def _illegal(initials: Column) -> Column:
    """Neighbours among the initials that are none of su, ua and au."""
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(F.size(initials) - 1, F.lit(0))), F.slice(initials, 2, F.greatest(F.size(initials) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def _repaired(rows: Column, audit: Column) -> Column:
    """The rows (role, text) that the audit leaves."""
    turn = lambda letter, role, text: F.struct(letter.alias("letter"), role.alias("role"), text.alias("text"))
    # A letter for each row, and the insertions before each row and after the last.
    split = F.struct(F.regexp_extract_all(audit, F.lit("([DKR])"), F.lit(1)).alias("letters"), F.split(audit, "[DKR]").alias("gaps"))

    def around(parts: Column, k: Column) -> Column:
        inserted = F.array_repeat(turn(F.lit("I"), F.lit(""), F.lit("")), F.length(F.get(parts["gaps"], k)))
        own = F.array(turn(F.get(parts["letters"], k), F.get(rows, k)["role"], F.get(rows, k)["text"]))
        return F.concat(inserted, F.filter(own, lambda t: t["letter"] != "D"))

    def named(out: Column) -> Column:
        first = F.get(out, F.lit(0))
        shift = F.coalesce(((first["letter"] == "K") & (F.substring(first["role"], 1, 1) == "s")).cast("int"), F.lit(0))
        by_place = lambda k: F.when((k + shift) % 2 == 0, "user").otherwise("assistant")
        return F.transform(out, lambda t, k: F.struct(F.when(t["letter"] == "K", t["role"]).otherwise(by_place(k)).alias("role"), t["text"].alias("text")))

    # Beyond the last row the letter is null, and a filter drops what is not known to differ.
    out = _bound(split, lambda parts: F.flatten(F.transform(F.sequence(F.lit(0), F.size(rows)), lambda k: around(parts, k))))
    return _bound(out, named)


def _reported(rows: DataFrame) -> DataFrame:
    """Counts of each conversation in ``rows`` (conv_id, turn, gone, fault), by partial sums."""
    there = lambda c: F.when(~F.col("gone"), c)
    gaps = F.max(there(F.col("turn"))) - F.min(there(F.col("turn"))) + 1 - F.count_distinct(there(F.col("turn")))
    return rows.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *(F.count_if(~F.col("gone") & (F.col("fault") == f)).alias(f) for f in FAULTS))


_COLUMNS = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired", "repaired_sha256"]


def _short(rows: DataFrame) -> DataFrame:
    """One exchange by conversation serves the windows and the fold."""
    order = [F.asc_nulls_first("turn"), "role", "text", "copy"]
    rows = rows.repartition(partitions(rows), "conv_id")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(*order)))
    row = F.struct("turn", "role", "text", "copy", "nth", "fault", "initial")
    found = _marked(rows, F.col("nth") > 1).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("gone"), row))).alias("rows"),
        *(F.count_if(~F.col("gone") & (F.col("fault") == f)).alias(f) for f in FAULTS),
    )
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long")
    best = found.select("*", gaps.alias("gaps"), _illegal(F.transform("rows", lambda r: r["initial"])).alias("illegal"), _ended(_folded(F.col("rows"), "none")).alias("best"))
    out = best.select("*", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), _repaired(F.col("rows"), F.col("best.audit")).alias("repaired"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).select(*_COLUMNS)


class _Speaker:
    """Walks one audit beside the rows it is about and gives the turns that remain."""

    def __init__(self, audit: str):
        self.audit, self.at, self.spoken = audit, 0, 0

    def _next(self) -> str:
        self.spoken += 1
        return "user" if self.spoken % 2 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._next(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            yield self._next(), text
        elif letter == "K":
            # A system turn stands first and does not count as one of the two speakers.
            self.spoken += not role.startswith("s")
            yield role, text


def _streamed(audits: DataFrame, ordered: DataFrame) -> DataFrame:
    """The audits of long conversations and, after each, its rows in order, dealt out by conversation."""
    first = audits.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    rows = ordered.select("conv_id", "at", "role", "text")
    return first.unionByName(rows).repartition(partitions(ordered), "conv_id").sortWithinPartitions("conv_id", "at")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]] | None]]:
    """(conversation, turns) for every row of ``_streamed`` and (conversation, None) at each one's end."""
    conv, speaker = None, None
    for b in batches:
        for low in range(0, len(b), 256):
            for c, at, role, text in zip(*(x.to_pylist() for x in b.slice(low, 256).columns)):
                if at == -1:
                    if speaker:
                        yield conv, speaker.inserted()
                        yield conv, None
                    conv, speaker = c, _Speaker(text)
                else:
                    yield conv, speaker.row(role, text)
    if speaker:
        yield conv, speaker.inserted()
        yield conv, None
    give_back()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, begun = hashlib.sha256(), False
    for conv, turns in _walked(batches):
        if turns is None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])
            digest, begun = hashlib.sha256(), False
            continue
        for role, text in turns:
            digest.update(f"{chr(10) * begun}{role}:{text}".encode())
            begun = True


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, out = 0, []

    def made() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["conv_id", "place", "role", "text"])

    for conv, turns in _walked(batches):
        for role, text in turns or ():
            out.append((conv, place, role, text))
            place += 1
        if turns is None:
            place = 0
        if len(out) >= 256:
            yield made()
            out = []
    yield made()


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations of any length, a piece of one in a task: counts, edits, and ``_streamed`` rows."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "copy"]
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "long")
    # Equal rows are alike in all that follows; the tie only lets the exchange part them.
    ranged = rows.repartitionByRange(partitions(rows), *order, "tie").sortWithinPartitions(*order, "tie")
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("same", F.struct("conv_id", "role", "text")), "ordered")
    there = ranged.where(~F.col("gone"))
    first = stage(there.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")), "first")
    marked = stage(_marked(beside(there, first, ["same"]), F.col("at") > F.col("first")).drop("same"), "marked")
    counts = _reported(marked.unionByName(ranged.where("gone").drop("same"), allowMissingColumns=True))
    pieces = marked.withColumn("piece", F.shiftright("at", PIECE.bit_length() - 1)).groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "fault", "initial"))).alias("rows"))
    initials = F.transform("rows", lambda r: r["initial"])
    folds = F.struct(*[_folded(F.col("rows"), s).alias(s) for s in STATES])
    pieces = pieces.select("conv_id", "piece", folds.alias("after"), _illegal(initials).alias("illegal"), F.array(F.get(initials, F.lit(0)), F.element_at(initials, -1)).alias("ends"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "after", "ends"))).alias("pieces"), F.sum("illegal").alias("illegal"))

    def joined(at: Column, piece: Column) -> Column:
        def reached(state: str) -> Column:
            return F.least(*[_both(at.getField(s), piece["after"].getField(s).getField(state)) for s in STATES])

        return _struct(*[reached(s) for s in STATES])

    best = _ended(F.aggregate("pieces", _start("none"), joined))
    # The last initial of a piece and the first of the next are neighbours too.
    ends = F.flatten(F.transform("pieces", lambda p: p["ends"]))
    seams = F.slice(ends, 2, F.greatest(F.size(ends) - 2, F.lit(0)))
    odd = F.filter(F.sequence(F.lit(0), F.size("pieces") - 1), lambda k: (k + 1 < F.size("pieces")) & ~F.concat(F.get(seams, 2 * k), F.get(seams, 2 * k + 1)).isin("su", "ua", "au"))
    whole = whole.select("conv_id", (F.col("illegal") + F.size(odd)).alias("illegal"), best.alias("best"))
    audits = stage(whole.select(F.struct("conv_id").alias("key"), "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")), "audits")
    return counts, audits, _streamed(audits.select("key.conv_id", "audit"), marked)


def _long_report(rows: DataFrame) -> DataFrame:
    counts, audits, streamed = _long(rows)
    digests = streamed.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    out = counts.withColumn("key", F.struct("conv_id")).join(audits, "key", "left").join(digests.select(F.struct("conv_id").alias("key"), "repaired_sha256"), "key", "left")
    nothing = {"illegal": F.lit(0).cast("long"), "cost": F.lit(0).cast("long"), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    out = out.withColumns({c: F.coalesce(c, v) for c, v in nothing.items()})
    return out.withColumn("repaired", F.lit(None).cast("array<struct<role:string,text:string>>")).select(*_COLUMNS)


def _both(p: Column, q: Column) -> Column:
    return F.when(p.isNotNull() & q.isNotNull(), F.struct((p["cost"] + q["cost"]).alias("cost"), F.concat(p["audit"], q["audit"]).alias("audit")))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copy, gone), as ``damaged`` gives them.

    conv_id, gaps (turn numbers that are missing between the first and the last), blank,
    duplicate and truncated (rows by their first fault), illegal (neighbouring roles whose
    initials are none of su, ua and au), cost and audit of the cheapest edits that leave
    roles of the form ``(s?(ua)+)?``, repaired (the turns left) and repaired_sha256 (of
    their ``role:text`` lines).

    Rows come in the order of turn, nulls first, then role, text and copy. Rows of a null
    conv_id are one conversation. A role without a first character or with another than s, u
    and a cannot be kept. Repeated rows are duplicates after the first. Rows that are
    ``gone`` do not count, and a conversation with none left has zeros, an empty audit and
    the hash of the empty text. An empty table gives no rows; further columns are not read.
    The table must re-read alike.

    ``repaired`` is null for conversations beyond ``LONG`` rows or ``LONG_BYTES``, whose
    turns ``repaired_turns`` gives as rows. All else is the same for them. Their texts pass
    through one task that holds one row at a time, as a hash runs from front to back; the
    edits are found in pieces.
    """
    short, long = _parted(rows)
    out = _short(short)
    return out if long is None else out.unionByName(_long_report(long))


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that may be collected, and of those that may not, if there are any."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", "copy", "gone")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    beyond = stage(sizes.where((F.col("n") > LONG) | (F.col("bytes") > LONG_BYTES)).select(F.struct("conv_id").alias("key"), "n"), "beyond")
    if not beyond.count():
        return rows, None
    keyed, ids = rows.withColumn("key", F.struct("conv_id")), beyond.select("key", "n")
    return keyed.join(ids.drop("n"), "key", "left_anti").drop("key"), beside(keyed, ids, ["key"]).drop("key")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns that ``repair`` leaves, as rows (conv_id, place from 0, role, text), of conversations of any length."""
    short, long = _parted(rows)
    out = _short(short).select("conv_id", F.posexplode("repaired").alias("place", "turn")).select("conv_id", F.col("place").cast("long").alias("place"), "turn.role", "turn.text")
    return out if long is None else out.unionByName(_long(long)[2].mapInArrow(_spoken, "conv_id long, place long, role string, text string"))
