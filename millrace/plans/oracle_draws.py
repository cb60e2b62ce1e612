"""DuckDB SQL of the seeded block starts: the published generator, a 128-bit congruential one, as plain arithmetic.

State k + 2**j follows from state k by one multiplication and addition, so the states
come by doubling: each step adds as many as there are. A state is kept as four limbs of
32 bits, whose products fit 128-bit integers. Every output gives two 32-bit words, low
half first; a word w falls on start w * r >> 32 of r, and the few that would make starts
unequally likely are passed over.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: the generator's multiplier.
MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645
_ALL, _LIMB = (1 << 128) - 1, (1 << 32) - 1


def _limbs(x: int) -> list[int]:
    return [(x >> (32 * i)) & _LIMB for i in range(4)]


def _advanced(source: str, k: str, factor: int, summand: int) -> str:
    """Rows (k, l0 to l3) of ``source`` after state -> factor * state + summand, numbered ``k``."""
    f, c = _limbs(factor), _limbs(summand)
    columns = [" + ".join([*(f"CAST(l{i} AS HUGEINT) * {f[d - i]}" for i in range(d + 1)), str(c[d])]) for d in range(4)]
    rows = f"SELECT {k} AS k, {', '.join(f'{x} AS c{d}' for d, x in enumerate(columns))} FROM {source}"
    for d in range(4):
        carry = f", c{d + 1} + (c{d} >> 32) AS c{d + 1}" if d < 3 else ""
        gone = f"c{d}, c{d + 1}" if d < 3 else f"c{d}"
        rows = f"SELECT * EXCLUDE ({gone}), CAST(c{d} % 4294967296 AS UBIGINT) AS l{d}{carry} FROM ({rows})"
    return rows


def words(seed: int, doublings: int = 17) -> dict[str, str]:
    """Extra tables, of which ``words`` has (i, w): the first ``2 ** (doublings + 1)`` words of ``seed``."""
    state = np.random.PCG64(seed).state["state"]
    factor, summand = MULTIPLIER, state["inc"]
    first = _limbs((state["state"] * factor + summand) & _ALL)
    out = {"g0": f"SELECT CAST(0 AS BIGINT) AS k, {', '.join(f'CAST({x} AS UBIGINT) AS l{i}' for i, x in enumerate(first))}"}
    for j in range(doublings):
        out[f"g{j + 1}"] = f"SELECT * FROM g{j} UNION ALL SELECT k, l0, l1, l2, l3 FROM ({_advanced(f'g{j}', f'k + {1 << j}', factor, summand)})"
        factor, summand = factor * factor & _ALL, (factor * summand + summand) & _ALL
    mixed = "CAST(xor(l2, l0) AS HUGEINT) + CAST(xor(l3, l1) AS HUGEINT) * 4294967296"
    turned = "v // (CAST(1 AS HUGEINT) << r) + (v % (CAST(1 AS HUGEINT) << r)) * (CAST(1 AS HUGEINT) << CAST(64 - r AS INTEGER))"
    out["outputs"] = f"SELECT k, {turned} AS o FROM (SELECT k, {mixed} AS v, CAST(l3 >> 26 AS INTEGER) AS r FROM g{doublings})"
    out["words"] = "SELECT 2 * k AS i, CAST(o % 4294967296 AS HUGEINT) AS w FROM outputs UNION ALL SELECT 2 * k + 1, CAST((o // 4294967296) % 4294967296 AS HUGEINT) FROM outputs"
    return out


def starts(lengths: str, seed: int, block: int, draws: int) -> dict[str, str]:
    """Extra tables up to ``starts`` (n, draw, s, len): the blocks of every draw for the ``n`` of the query ``lengths``."""
    blocks = f"CAST(ceil(n / {block}e0) AS BIGINT)"
    taken = "SELECT n, k, r, (w * r) >> 32 AS s, row_number() OVER (PARTITION BY n ORDER BY i) - 1 AS i FROM words JOIN sizes ON i < k * {0} + 64 WHERE (w * r) % 4294967296 >= (4294967296 - r) % r"
    return words(seed) | {
        "sizes": f"SELECT DISTINCT n, {blocks} AS k, CAST(greatest(1, n - {block} + 1) AS HUGEINT) AS r FROM ({lengths})",
        "taken": taken.format(draws),
        "starts": f"SELECT n, i // k AS draw, CAST(s AS BIGINT) AS s, CASE WHEN i % k = k - 1 THEN n - (k - 1) * {block} ELSE {block} END AS len FROM taken WHERE i < k * {draws}",
    }
