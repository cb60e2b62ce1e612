"""DuckDB SQL of this package's queries, and of what SQL can say about the others.

``op4``, ``op5``, ``op6``, ``op7``, ``op9``, ``op11`` and ``op13`` are given in full. Of ``op2``, ``op10``
and ``op12`` SQL gives the part that no model, free choice or eigenvector decides, which
``pii_base_spans``, ``mixing_targets`` and ``whitening_deviations`` register.
"""

from __future__ import annotations

from millrace.llm.lines import MIN_WORDS
from millrace.llm.sharding import BITS, SHARDS

# Each text's CRC32: the table of the 256 remainders, then a fold over the bytes.
CRC = r"""tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), crc AS MATERIALIZED (
  SELECT documents.*, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(list_reduce([4294967295]::BIGINT[] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents CROSS JOIN tab
)"""


def _hilbert(rows: str) -> str:
    """Nested selects that turn the cells x0 to x3 into the index h, a bit of an axis at a time."""
    for b in range(BITS - 1, 0, -1):
        q = 1 << b
        for i in range(4):
            up = f"x{i} & {q} <> 0"
            others = "".join(f", x{k}" for k in range(1, 4) if k != i)
            if i:
                rows = f"SELECT * EXCLUDE (x0, x1, x2, x3, s), xor(x0, CASE WHEN {up} THEN {q - 1} ELSE s END) AS x0, xor(x{i}, s) AS x{i}{others} FROM (SELECT *, CASE WHEN {up} THEN 0 ELSE xor(x0, x{i}) & {q - 1} END AS s FROM ({rows}))"
            else:
                rows = f"SELECT * EXCLUDE (x0), xor(x0, CASE WHEN {up} THEN {q - 1} ELSE 0 END) AS x0 FROM ({rows})"
    for i in range(1, 4):
        rows = f"SELECT * EXCLUDE (x{i}), xor(x{i}, x{i - 1}) AS x{i} FROM ({rows})"
    flip = "0"
    for b in range(BITS - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x3 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    rows = f"SELECT *, {flip} AS f FROM ({rows})"
    bits = " + ".join(f"(((xor(x{i}, f) >> {b}) & 1) << {4 * b + 3 - i})" for b in range(BITS) for i in range(4))
    return f"SELECT *, {bits} AS h FROM ({rows})"


_TOP = (1 << BITS) - 1
_CELL = "coalesce(CAST('0x' || left(md5({c}), 2) AS BIGINT), " + str(_TOP) + ")"
_CELLS = f"""SELECT doc_id, size, text_crc32, {_CELL.format(c='source')} AS x0, {_CELL.format(c='lang')} AS x1, CAST(least(floor(log2(size + 5e-1) * 8e0), {_TOP}) AS BIGINT) AS x2,
  CAST(floor(CAST(coalesce(doc_id, low) - low AS DOUBLE) / greatest(1, high - low) * {_TOP}) AS BIGINT) AS x3 FROM crc CROSS JOIN (SELECT coalesce(min(doc_id), 0) AS low, coalesce(max(doc_id), 0) AS high FROM documents)"""

OP5_SQL = f"""WITH {CRC}, cells AS MATERIALIZED ({_CELLS}), curve AS MATERIALIZED ({_hilbert('SELECT * FROM cells')}),
ranked AS (SELECT *, row_number() OVER (ORDER BY h, doc_id, text_crc32) - 1 AS r, count(*) OVER () // {SHARDS} AS each, count(*) OVER () % {SHARDS} AS more FROM curve)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(CASE WHEN r < more * (each + 1) THEN r // (each + 1) ELSE more + (r - more * (each + 1)) // greatest(each, 1) END AS INTEGER) AS shard,
  CASE WHEN r < more * (each + 1) THEN r % (each + 1) ELSE (r - more * (each + 1)) % greatest(each, 1) END AS slot, CAST(NULL AS INTEGER) AS grown_shard, h AS curve_index FROM ranked"""

OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

# Every run from a line on, and up to a line, that just has enough words, by its text; copies after the first go.
OP7_SQL = rf"""
WITH ln AS MATERIALIZED (
  SELECT doc_id, i - 1 AS i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), cum AS MATERIALIZED (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS before FROM ln
), ends AS MATERIALIZED (
  SELECT doc_id, i AS s, min(e) AS e FROM (SELECT a.doc_id, a.i, b.i + 1 AS e FROM cum a ASOF JOIN (SELECT doc_id, upto, min(i) AS i FROM cum GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.before + {MIN_WORDS} <= b.upto) GROUP BY ALL
  UNION
  SELECT doc_id, max(s), e FROM (SELECT a.doc_id, b.i AS s, a.i + 1 AS e FROM cum a ASOF JOIN (SELECT doc_id, before, max(i) AS i FROM cum GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.upto - {MIN_WORDS} >= b.before) GROUP BY doc_id, e
), lists AS MATERIALIZED (
  SELECT doc_id, list(line ORDER BY i) AS l FROM ln GROUP BY doc_id
), runs AS MATERIALIZED (
  SELECT doc_id, s, e, list_slice(l, s + 1, e) AS run FROM ends JOIN lists USING (doc_id)
), later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM runs) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e)) AS i FROM later
), islands AS (
  SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g
)
SELECT n.doc_id, n.n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed FROM (SELECT doc_id, count(*) AS n_lines FROM ln GROUP BY doc_id) n
LEFT JOIN (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM islands GROUP BY doc_id) g ON g.doc_id = n.doc_id
"""

# The contract's patterns.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_VALID = f"""CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0
  WHEN 'phone' THEN length({_DIGITS}) BETWEEN 10 AND 15 ELSE length({_DIGITS}) BETWEEN 14 AND 19 AND
  list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), k, 1) AS INTEGER)
    ELSE (2 * CAST(substr(reverse({_DIGITS}), k, 1) AS INTEGER)) % 10 + (2 * CAST(substr(reverse({_DIGITS}), k, 1) AS INTEGER)) // 10 END)) % 10 = 0 END"""
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, {o} AS o, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(list_slice(string_split_regex(text, '{p}'), 1, -2)) AS gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM t"
    for o, (k, p) in enumerate(_PATTERNS.items())
)
PII_BASE_SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS MATERIALIZED ({_FOUND}), placed AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM found
), spans AS (
  SELECT doc_id, kind, o, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE {_VALID}
), joined AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _PATTERNS)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS j FROM spans GROUP BY doc_id
)
SELECT t.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _PATTERNS)}, sha256(coalesce(j, '')) AS base_sha256 FROM t LEFT JOIN joined USING (doc_id)
"""

# Shares by weight, held at three times a source's words and dealt out again until none is above.
TARGETS_SQL = r"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), src AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source
), total AS (
  SELECT sum(n) AS t FROM src
), level AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS l
  UNION ALL
  SELECT k + 1, ((SELECT t FROM total) - coalesce((SELECT sum(3 * n) FROM src WHERE 3 * n <= w * l), 0)) / CAST((SELECT sum(w) FROM src WHERE 3 * n > w * l) AS DOUBLE)
  FROM level WHERE k <= (SELECT count(*) FROM src) AND (SELECT sum(w) FROM src WHERE 3 * n > w * l) IS NOT NULL
)
SELECT doc_id, size, src.n AS source_size, round(least(3e0 * src.n, w * (SELECT max(l) FROM level)), 4) + 0e0 AS target, true AS near
FROM sized JOIN src ON sized.source IS NOT DISTINCT FROM src.source
"""

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS least FROM v
  UNION SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.node WHERE reach.least < links.b
), comp AS (
  SELECT node, min(least) AS component_id FROM reach GROUP BY node
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(degree.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.node = vec_id LEFT JOIN degree ON degree.a = vec_id
"""

OP9_SQL = """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), items AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS least FROM words
  UNION SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.node WHERE reach.least < links.b
), comp AS (
  SELECT node, min(least) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp ON comp.node = doc_id
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"

OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda c: floor(1024e0 * CAST(c AS DOUBLE))) AS x FROM embeddings WHERE {_FINITE}
), pairs AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS k FROM pairs) WHERE k <= 10
"""

# How far each row lies from the mean, in whole numbers, and that the whitened covariance is the identity.
DEVIATIONS_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024e0 * CAST(c AS DOUBLE)) AS BIGINT) + 100000) AS x FROM embeddings WHERE {_FINITE}
), cells AS (
  SELECT unnest(x) AS c, generate_subscripts(x, 1) AS d FROM v
), total AS MATERIALIZED (
  SELECT list(s ORDER BY d) AS s, max(n) AS n FROM (SELECT d, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM cells GROUP BY d)
)
SELECT vec_id, CAST(k AS INTEGER) AS component, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) AS BIGINT) AS deviation, true AS identity
FROM v CROSS JOIN total CROSS JOIN range(1, 9) r(k) WHERE k <= len(x)
"""


def _later(p: str, cost: str, letter: str) -> str:
    """A fold's best so far, cost in eight digits before its audit, after one more edit."""
    return f"(lpad(CAST(CAST(left({p}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({p}, 9) || {letter})"


_OPENED = f"SELECT *, least(u, {', '.join(_later(p, '3', chr(39) + 'I' + chr(39)) for p in 'esa')}) AS ou, least(a, {_later('u', '3', chr(39) + 'I' + chr(39))}) AS oa FROM fold"
_STAYS = "CASE WHEN coalesce(fault, '') NOT IN ('blank', 'duplicate') THEN {} END"
_EXTRA = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"


def _spoken(p: str, initial: str) -> str:
    return _STAYS.format(_later(p, f"({_EXTRA} + CASE WHEN initial = '{initial}' THEN 0 ELSE 3 END)", f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END"))


_GONE = {p: _later(p, "4", "'D'") for p in ("e", "s", "ou", "oa")}
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_HASH = "xor(list_reduce([4294967295]::BIGINT[] || list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

OP13_SQL = rf"""
WITH RECURSIVE {CRC.split("), crc")[0]}
), hashed AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_HASH} % 20 AS how FROM conversations CROSS JOIN tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hashed CROSS JOIN range(2) r(copy) WHERE how <> 0 AND (copy = 0 OR how = 3)
), placed AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {_WHITE}) AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged
), marked AS MATERIALIZED (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM placed
), fold AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM conversations
  UNION ALL
  SELECT o.conv_id, m.i, {_GONE['e']}, least({_GONE['s']}, CASE WHEN initial = 's' THEN {_STAYS.format(_later('e', f'({_EXTRA})', "'K'"))} END),
    least({_GONE['ou']}, {', '.join(_spoken(p, 'u') for p in ('e', 's', 'oa'))}), least({_GONE['oa']}, {_spoken('ou', 'a')})
  FROM ({_OPENED}) o JOIN marked m ON m.conv_id IS NOT DISTINCT FROM o.conv_id AND m.i = o.i + 1
), best AS (
  SELECT conv_id, i AS n, least(e, oa) AS b FROM ({_OPENED}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), edits AS (
  SELECT conv_id, n, CAST(left(b, 8) AS BIGINT) AS cost, substr(b, 9) AS audit FROM best
), letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS spot FROM edits WHERE audit <> ''
), numbered AS (
  SELECT *, CASE WHEN letter = 'I' THEN 0 ELSE count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) END AS i FROM letters
), kept AS (
  SELECT n.conv_id, letter, role, coalesce(CASE WHEN letter = 'I' THEN '' ELSE text END, '') AS text, row_number() OVER (PARTITION BY n.conv_id ORDER BY spot) AS place,
    max(CASE WHEN letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS shift
  FROM numbered n LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM n.conv_id AND m.i = n.i WHERE letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place + shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS repaired FROM kept GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {', '.join(f"count(*) FILTER (WHERE fault = '{f}') AS {f}" for f in ('blank', 'duplicate', 'truncated'))},
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id
)
SELECT e.conv_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM edits e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""

SQL = {
    "op4_int8_embedding_dedup": OP4_SQL,
    "op5_hilbert_sharding": OP5_SQL,
    "op6_radix_exact_dedup": OP6_SQL,
    "op7_suffix_line_dedup": OP7_SQL,
    "op9_fast_similarity_dedup": OP9_SQL,
    "op11_exact_top_k": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
    "pii_base_spans": PII_BASE_SQL,
    "whitening_deviations": DEVIATIONS_SQL,
    "mixing_targets": TARGETS_SQL,
}
