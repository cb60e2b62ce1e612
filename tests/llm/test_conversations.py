import hashlib
import heapq
import random
import re
import zlib

import pytest

from millrace.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
MUST = ("blank", "duplicate")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out += [(conv, turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, turns) by Dijkstra over (row, roles' state), edits spelled out one by one."""
    start = (0, "", 0, "", ())
    heap, done = [start], set()
    while heap:
        cost, audit, at, state, turns = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, turns
        step = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for name in ("user", "assistant"):
            if name[0] in step:
                heapq.heappush(heap, (cost + 3, audit + "I", at, name[0], turns + ((name, ""),)))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, turns))
            if fault not in MUST:
                extra = 3 * (fault == "truncated")
                if role[:1] and role[:1] in step:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[:1], turns + ((role, text),)))
                for name in ("user", "assistant"):
                    if name[0] in step:
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", at + 1, name[0], turns + ((name, text),)))


def brute(rows):
    out, convs = [], {r[0] for r in rows}
    after = brute_damage(rows)
    for conv in convs:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked = set(), []
        for _, _, role, text in mine:
            shown = text.rstrip(SPACE)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, kept = cheapest(marked)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        counts = [sum(f == x for *_, f in marked) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), kept))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, key int, rows int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(5)


def answers(spark, rows):
    damaged = C.damaged(frame(spark, rows))
    turns = {}
    for r in sorted(C.repaired_turns(damaged).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    found = C.repair(damaged).collect()
    assert all(r["repaired"] is None or [tuple(t) for t in r["repaired"]] == turns.get(r["conv_id"], []) for r in found)
    return sorted(((*[r[c] for c in C._COLUMNS if c != "repaired"], tuple(turns.get(r["conv_id"], []))) for r in found), key=str)


def made(seed, n=160):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys", "User", "unnamed"]
    texts = ["Yes.", "No!", "", "  \t", "cut off", "Why? \n", "é ends.", "\x0b", None, "x. ", "a", "b?", "c.", "d.", "e!"]
    rows = []
    for c in range(n):
        own = rng.sample(texts, rng.randint(1, len(texts)))
        for t in range(rng.randint(1, 14)):
            turn = None if rng.random() < 0.05 else t + (rng.random() < 0.1) * 3
            role = ["user", "assistant"][t % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((None if c == 5 else c, turn, role, rng.choice(own)))
    return rows + rows[:9]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = made(seed)
    assert answers(spark, rows) == brute(rows)


@pytest.mark.parametrize("piece", [2, 8])
def test_long_conversations_in_pieces(spark, monkeypatch, piece):
    """All conversations with more than a row count as long, one of them holding a third of all rows."""
    for name, value in {"LONG": 1, "PIECE": piece}.items():
        monkeypatch.setattr(C, name, value)
    rng = random.Random(9)
    rows = made(7, 40)
    rows += [(77, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Hm.", "again", "So?", "", f"Turn {t}."])) for t in range(len(rows) // 2)]
    assert answers(spark, rows) == brute(rows)


def test_long_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(C, "LONG_BYTES", 1000)
    rows = [(1, 0, "user", "x" * 5000 + "."), (1, 1, "assistant", "y."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    assert answers(spark, rows) == brute(rows)


def test_conversation_without_rows_left_and_extremes(spark):
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    rows = [(c, 0, "user", "Hi.") for c in gone] + [(300, 5, None, None), (301, None, "user", "Hello. " * 200_000), (301, None, "assistant", "Bye.")]
    got = answers(spark, rows)
    assert got == brute(rows)
    assert [r[1:9] for r in got if r[0] == gone[0]] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty(spark):
    assert answers(spark, []) == []
