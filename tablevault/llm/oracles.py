"""DuckDB SQL that states the results of operators 11 and 13 independently of how they are built."""

from __future__ import annotations

#: The table of CRC-32 by byte, and the checksum of an ASCII text by folding its bytes through it.
CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII expression; ``crc`` is the column of ``CRC_TABLE``."""
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen({text}) + 1),"
            f" lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT))),"
            " lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)")


def repair() -> str:
    """Operator 11: dynamic programming over turns and automaton states, one turn of all conversations a step."""
    blanks = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    key = "(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"
    return f"""
WITH RECURSIVE crcs AS {CRC_TABLE},
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(key)} % 20 AS kind
  FROM conversations, crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    left(role, 1) AS initial, rtrim(text, {blanks}) AS body FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM placed),
rows_ AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault
  FROM seen),
ids AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id),
steps(p, role, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
inserts(q, r, more, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'),
  (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')),
edits AS (
  SELECT s.p, f.fault, r.initial, s.q, f.late AS cost, 'K' AS letter FROM steps s, (VALUES ('', 0), ('t', 5)) f(fault, late),
    (SELECT DISTINCT initial FROM rows_) r WHERE r.initial = s.role
  UNION ALL SELECT s.p, f.fault, r.initial, s.q, f.late + 1, 'R' FROM steps s, (VALUES ('', 0), ('t', 5)) f(fault, late),
    (SELECT DISTINCT initial FROM rows_) r WHERE s.role <> 's'
  UNION ALL SELECT p.p, f.fault, r.initial, p.p, 2, 'D' FROM (VALUES (0), (1), (2), (3)) p(p), (VALUES (''), ('b'), ('d'), ('t')) f(fault),
    (SELECT DISTINCT initial FROM rows_) r),
dp AS (
  SELECT conv_id, 0 AS i, r AS state, {{'cost': more, 'audit': letters}} AS best FROM counts, inserts WHERE q = 0
  UNION ALL
  SELECT d.conv_id, d.i + 1, n.r, min({{'cost': d.best.cost + e.cost + n.more, 'audit': d.best.audit || e.letter || n.letters}})
  FROM dp d JOIN rows_ t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i
    JOIN edits e ON e.p = d.state AND e.fault = t.fault AND e.initial = t.initial JOIN inserts n ON n.q = e.q
  GROUP BY d.conv_id, d.i + 1, n.r),
found AS (SELECT c.conv_id, min(d.best) AS best FROM counts c JOIN dp d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.i = c.n
  WHERE d.state IN (0, 3) GROUP BY c.conv_id),
letters AS (SELECT conv_id, k, best.audit[k] AS letter, strlen(best.audit) AS n
  FROM (SELECT conv_id, best, unnest(range(1, strlen(best.audit) + 1)) AS k FROM found)),
used AS (SELECT conv_id, k, letter, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY k) - 1 AS i,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS o, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) AS total
  FROM letters),
lines AS (SELECT u.conv_id, u.o, CASE WHEN u.letter = 'K' THEN t.role WHEN (u.o - u.total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN u.letter = 'I' THEN '' ELSE t.text END AS line
  FROM used u LEFT JOIN rows_ t ON t.conv_id IS NOT DISTINCT FROM u.conv_id AND t.i = u.i WHERE u.letter <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY o) AS text FROM lines GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(f.best.cost, 0) AS BIGINT) AS cost,
  coalesce(f.best.audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id"""


def trie() -> str:
    """Operator 13: every prefix as the chain of its turns' digests; a node's subtree is found by its chain."""
    return f"""
WITH crcs AS {CRC_TABLE},
turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {crc32("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT c FROM turns), crcs),
rebuilt AS (
  SELECT t.c, pos, role, text FROM turns t JOIN ids USING (c) WHERE pos >= h
  UNION ALL SELECT i.c, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.c = i.c - i.c % 5 AND t.pos < i.h),
numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, md5(length(role) || ':' || role || text) AS name,
    strlen(text) AS size FROM rebuilt),
lengths AS (SELECT ids.c, count(n.d) AS n FROM ids LEFT JOIN numbered n USING (c) GROUP BY ids.c),
prefixes AS (
  SELECT c, d, string_agg(name, '') OVER (PARTITION BY c ORDER BY d) AS p, size FROM numbered
  UNION ALL SELECT c, 0, '', 0 FROM ids),
nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n) AS ends
  FROM prefixes JOIN lengths USING (c) GROUP BY d, p),
kids AS (SELECT d - 1 AS d, left(p, strlen(p) - 32) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
all_ AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (d, p)),
below AS (SELECT a.d, a.p, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved
  FROM all_ a JOIN all_ b ON b.d >= a.d AND left(b.p, 32 * a.d) = a.p GROUP BY a.d, a.p)
SELECT a.conv_id, a.d AS depth, up.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children,
  CAST(w.n_leaves AS BIGINT) AS n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM all_ a JOIN below w USING (d, p) LEFT JOIN all_ up ON up.d = a.d - 1 AND up.p = left(a.p, strlen(a.p) - 32)"""
