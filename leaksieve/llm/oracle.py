"""SQL that gives the rows of the registered queries, for those that SQL can express."""

from __future__ import annotations

# 52 bits of an md5, in the middle of their step: between 0 and 1.
_UNIT = "(('0x' || md5({})[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"

_MIX = f"""
WITH stats AS (SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS bytes FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN bytes > 0 THEN
    sqrt(bytes) / (SELECT sum(sqrt(bytes)) FROM stats) * (SELECT sum(bytes) FROM stats) / bytes ELSE 1.0 END AS rate FROM stats),
pieces AS (SELECT source, greatest(1, ceil(rate / 16))::INT AS n, rate / greatest(1, ceil(rate / 16)) AS m FROM rates),
sums AS (SELECT source, n, sum(exp(-m + k * ln(m) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c
    FROM pieces, generate_series(0, 80) AS t(k)),
tables AS (SELECT source, n, list(c) AS c FROM sums GROUP BY source, n),
draws AS (SELECT d.*, list_sum([len(list_filter(t.c, lambda x: x < {_UNIT.format("coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))) || ':' || i || ':2'")}))
    for i in range(1, t.n + 1)])::INT AS copies FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(copies))::INT AS copy FROM draws WHERE copies > 0
"""


_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "xor(x >> 1, 3988292384::UBIGINT * (x & 1))"
    byte = f"list_reduce([xor(c, b)] || list_transform(range(8), lambda i: 0::UBIGINT), lambda x, i: {bit})"
    letters = f"list_transform(string_split({text}, ''), lambda l: ascii(l)::UBIGINT)"
    return f"xor(list_reduce([4294967295::UBIGINT] || {letters}, lambda c, b: {byte}), 4294967295::UBIGINT)"


_REPAIR = f"""
WITH RECURSIVE ins(i, j, c, a, t) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'),
    (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
moves(r, i, j) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
made(i, j, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')),
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
live AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM plain WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n FROM live),
told AS (SELECT *, right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS tail,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1), 'first') AS pair FROM placed),
marked AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM told),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS rows,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('first', 'su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
best AS (
    SELECT conv_id, 0::BIGINT AS n, 0 AS s, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS w FROM sums
    UNION ALL
    SELECT conv_id, n, j, min({{'c': c, 'a': a, 't': t}}) FROM (
        SELECT m.conv_id, m.n, e.j, b.w.c + ins.c + e.c AS c, b.w.a || ins.a || e.a AS a, b.w.t || ins.t || e.t AS t
        FROM best b JOIN marked m ON m.conv_id = b.conv_id AND m.n = b.n + 1 JOIN ins ON ins.i = b.s,
        LATERAL (SELECT ins.j AS j, 2 AS c, 'D' AS a, '' AS t
            UNION ALL SELECT moves.j, CASE WHEN m.fault = 'truncated' THEN 5 ELSE 0 END, 'K', chr(10) || m.role || ':' || m.text
                FROM moves WHERE moves.i = ins.j AND moves.r = left(m.role, 1) AND m.fault IN ('', 'truncated')
            UNION ALL SELECT made.j, CASE WHEN m.fault = 'truncated' THEN 6 ELSE 1 END, 'R', chr(10) || made.role || ':' || m.text
                FROM made WHERE made.i = ins.j AND m.fault IN ('', 'truncated')) e)
    GROUP BY conv_id, n, j),
ended AS (SELECT b.conv_id, min({{'c': b.w.c + ins.c, 'a': b.w.a || ins.a, 't': b.w.t || ins.t}}) AS w FROM best b JOIN sums USING (conv_id)
    JOIN ins ON ins.i = b.s AND ins.j IN (0, 3) WHERE b.n = sums.rows GROUP BY b.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(w.t, '')[2:]) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN sums USING (conv_id) LEFT JOIN ended USING (conv_id)
"""


_TRIE = f"""
WITH ids AS (SELECT DISTINCT conv_id, ({_crc32("conv_id::VARCHAR")} % 6)::BIGINT AS h, conv_id - conv_id % 100 AS base FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS mark, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT ids.conv_id, 0 AS part, place, mark, chars FROM ids JOIN own ON own.conv_id = base AND place <= h
    UNION ALL SELECT ids.conv_id, 1, place, mark, chars FROM ids JOIN own ON own.conv_id = ids.conv_id AND place > h),
chained AS (SELECT conv_id, row_number() OVER w AS depth, chars, sha256(string_agg(sha256(mark), '') OVER w) AS key FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
rows AS (SELECT conv_id, depth, chars, key FROM chained UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
lasts AS (SELECT conv_id, max(depth) AS depth FROM rows GROUP BY conv_id),
linked AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM rows),
nodes AS (SELECT min(conv_id) AS conv_id, depth, key, min(above) AS above, count(*) AS n_convs, min(chars) AS chars FROM linked GROUP BY depth, key),
named AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.above = n.key AND k.depth = n.depth + 1) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.key = n.above AND p.depth = n.depth - 1),
below AS (SELECT r.depth, r.key, sum((w.n_children = 0)::INT)::BIGINT AS n_leaves, sum((w.n_convs - 1) * w.chars)::BIGINT AS saved_tokens
    FROM named w JOIN rows r ON r.conv_id = w.conv_id AND r.depth <= w.depth GROUP BY r.depth, r.key),
ends AS (SELECT depth, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM rows JOIN lasts USING (conv_id, depth) GROUP BY depth, key)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM named JOIN below USING (depth, key) LEFT JOIN ends USING (depth, key)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_poisson_mix": _MIX, "op4_ball_tree_topk": _TOPK, "op12_grammar_repair": _REPAIR, "op13_euler_trie": _TRIE}
