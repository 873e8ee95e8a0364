"""Comparison SQL of the language model, the prefix trie and the repair of conversations, for DuckDB."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """CRC of an ASCII string: bytes and single shifts as one list, folded."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [1099511627776::UBIGINT + ord(ch)::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))"
    fold = f"list_reduce(list_prepend(4294967295::UBIGINT, {steps}), lambda a, s: CASE WHEN s > 0 THEN xor(a, s - 1099511627776::UBIGINT) ELSE xor(a >> 1, (a & 1) * 3988292384::UBIGINT) END)"
    return f"xor({fold}, 4294967295::UBIGINT)::BIGINT"


def discount(counts: str, level: str) -> str:
    """Turing's discounts of counts 1 to 5 of a table with column c: one list, ones where the numbers do not allow it."""
    options = []
    for k in (5, 4, 3, 2):
        beyond = f"({k + 1} * n[{k + 1}]::DOUBLE / n[1])"
        d = [f"(({r + 1} * n[{r + 1}]::DOUBLE / ({r} * n[{r}])) - {beyond}) / (1 - {beyond})" for r in range(1, k + 1)]
        given = " AND ".join([f"n[{r}] > 0" for r in range(1, k + 2)] + [f"{k + 1} * n[{k + 1}] < n[1]"] + [f"{x} > 0 AND {x} <= 1" for x in d])
        options.append(f"WHEN {given} THEN [{', '.join(d + ['1.0'] * (5 - k))}]")
    numbers = ", ".join(f"count(*) FILTER (WHERE c = {r})" for r in range(1, 7))
    return f"{level} AS (SELECT CASE {' '.join(options)} ELSE [1.0, 1.0, 1.0, 1.0, 1.0]::DOUBLE[] END AS d FROM (SELECT [{numbers}] AS n FROM {counts}))"


KATZ = f"""
WITH RECURSIVE i AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {crc32("coalesce(doc_id::VARCHAR, '')")} % 10 = 0 AS held,
         list_append(list_transform(regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{WORDS}'), lambda x: 'w' || x), 'end') AS ws FROM documents
), t AS MATERIALIZED (
  SELECT r, held, unnest(ws) AS w, unnest(list_prepend('start', ws[:-2])) AS u FROM i
), c1 AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w
), c2 AS MATERIALIZED (SELECT u, w, count(*) AS c FROM t WHERE NOT held GROUP BY u, w
), {discount("c1", "d1")}, {discount("c2", "d2")}, n AS MATERIALIZED (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c1
), p1 AS MATERIALIZED (SELECT w, c, CASE WHEN c <= 5 THEN (SELECT d FROM d1)[c::INT] ELSE 1 END * c / ((SELECT n FROM n) + 1) AS p FROM c1
), rest AS MATERIALIZED (SELECT 1 - coalesce(sum(p), 0) AS p FROM p1
), x AS MATERIALIZED (
  SELECT u, sum(c2.c) AS total, (1 + sum(CASE WHEN c2.c <= 5 THEN (1 - (SELECT d FROM d2)[c2.c::INT]) * c2.c ELSE 0 END)) / (sum(c2.c) + 1) / (1 - sum(p1.p)) AS alpha
  FROM c2 JOIN p1 USING (w) GROUP BY u
), s AS (
  SELECT t.r, count(*) AS n_tokens, count(p1.c) AS n_known, sum(log10(coalesce(p1.c, 0) + 0.1)) AS base,
         sum(CASE WHEN c2.c IS NOT NULL THEN log10(CASE WHEN c2.c <= 5 THEN (SELECT d FROM d2)[c2.c::INT] ELSE 1 END * c2.c / (x.total + 1))
                  ELSE log10(coalesce(x.alpha, 1)) + log10(coalesce(p1.p, (SELECT p FROM rest))) END) AS score
  FROM t LEFT JOIN p1 USING (w) LEFT JOIN c2 ON t.u = c2.u AND t.w = c2.w LEFT JOIN x ON t.u = x.u GROUP BY t.r
)
SELECT doc_id, held AS held_out, n_tokens, n_known, n AS train_tokens, round(base - n_tokens * log10(n + 0.1 * (v + 1)), 6) AS base_score, round(score, 6) AS score
FROM i JOIN s USING (r), n"""


TRIE = f"""
WITH o AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), z AS MATERIALIZED (
  SELECT c.conv_id, c.h, c.head, c.n, least(c.h, coalesce(b.n, 0)) AS taken
  FROM (SELECT conv_id, count(*) AS n, {crc32("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS head FROM o GROUP BY conv_id) c
  LEFT JOIN (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id) b ON b.conv_id = c.head
), t AS MATERIALIZED (
  SELECT z.conv_id, o.i, role, text FROM z JOIN o ON o.conv_id = z.head WHERE o.i <= z.h
  UNION ALL SELECT z.conv_id, o.i - h + taken, role, text FROM z JOIN o USING (conv_id) WHERE o.i > h
), p AS MATERIALIZED (
  SELECT conv_id, i AS depth, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY i) AS node, octet_length(encode(text)) AS bytes FROM t
  UNION ALL SELECT conv_id, 0, []::STRUCT(r VARCHAR, t VARCHAR)[], 0 FROM z
), m AS MATERIALIZED (
  SELECT node, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE depth = taken + greatest(n - h, 0)), '')) AS ends_sha256
  FROM p JOIN z ON z.conv_id = p.conv_id GROUP BY node, depth
), k AS MATERIALIZED (
  SELECT c.node, a.conv_id AS parent_conv_id FROM m c JOIN m a ON a.depth = c.depth - 1 AND a.node = c.node[:-2]
), children AS MATERIALIZED (SELECT node[:-2] AS node, count(*) AS n FROM m WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT p.node, count(*) FILTER (WHERE children.n IS NULL) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved_tokens
  FROM m d JOIN p ON p.conv_id = d.conv_id AND p.depth <= d.depth LEFT JOIN children ON children.node = d.node GROUP BY p.node
)
SELECT m.conv_id, m.depth, k.parent_conv_id, m.n_convs, coalesce(children.n, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM m JOIN below ON below.node = m.node LEFT JOIN children ON children.node = m.node LEFT JOIN k ON k.node = m.node"""


def least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def before(way: str, cost: int | str, letter: str) -> str:
    """A way is its cost in nine digits and its letters; an edit before it."""
    return f"(lpad((left({way}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({way}, 10))"


NEVER = "100000000"
EXTRA = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"


def state(delete: str, keeps: list[tuple[str, str]], other: str) -> str:
    """The best way from a state at a row: deletion, keeping it where its role may follow, another role."""
    keep = " ".join(f"WHEN initial = '{letter}' THEN {before(way, EXTRA, 'K')}" for letter, way in keeps)
    return least(before(delete, 4, "D"), f"CASE WHEN fault IN (1, 2) THEN '{NEVER}' {keep} ELSE '{NEVER}' END", f"CASE WHEN fault IN (1, 2) THEN '{NEVER}' ELSE {before(other, '3 + ' + EXTRA, 'R')} END")


# Ways from each state at a row, first without insertions before the row (b), then with.
INSERTED = f"""SELECT conv_id, i, {least("b0", before("w2", 3, "I"))} AS w0, {least("b1", before("w2", 3, "I"))} AS w1, w2, {least("b3", before("w2", 3, "I"))} AS w3
  FROM (SELECT *, {least("b2", before("b3", 3, "I"))} AS w2 FROM"""

REPAIR = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations)
), o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d
), f AS MATERIALIZED (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM o
), n AS MATERIALIZED (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), w AS (
  {INSERTED} (SELECT conv_id, n + 1 AS i, '000000000' AS b0, '{NEVER}' AS b1, '{NEVER}' AS b2, '000000000' AS b3 FROM n))
  UNION ALL
  {INSERTED} (
    SELECT f.conv_id, f.i, {state("w0", [("s", "w1"), ("u", "w2")], "w2")} AS b0, {state("w1", [("u", "w2")], "w2")} AS b1, {state("w2", [("a", "w3")], "w3")} AS b2, {state("w3", [("u", "w2")], "w2")} AS b3
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1))
), best AS MATERIALIZED (SELECT conv_id, left(w0, 9)::BIGINT AS cost, substr(w0, 10) AS audit FROM w WHERE i = 1
), e AS MATERIALIZED (
  SELECT conv_id, j, letter, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS j FROM best WHERE audit <> '')
), g AS (
  SELECT e.conv_id, e.j, letter, f.role, f.text, sum(CASE WHEN letter = 'K' AND f.initial = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY e.conv_id ORDER BY e.j) AS place
  FROM e LEFT JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i AND letter <> 'I' WHERE letter <> 'D'
), text AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole FROM g GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM c.conv_id"""
