"""DuckDB SQL with the results of the queries that SQL can express, from the raw tables."""

WORD = r"[^\x20\x09-\x0D]+"

OP10 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS s FROM d GROUP BY source),
r AS (SELECT source, s, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w FROM s),
o AS (SELECT source, s, w, 2 * s AS c, CAST(s AS DOUBLE) / w AS ratio FROM r),
p AS (SELECT *, coalesce(sum(c) OVER f, 0) AS c_before, coalesce(sum(w) OVER f, 0) AS w_before, sum(s) OVER () AS ts, sum(w) OVER () AS tw FROM o
      WINDOW f AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, c * 2 * (tw - w_before) <= w * (ts * 3 - c_before * 2) AS capped FROM p),
t AS (SELECT source, s, CASE WHEN capped THEN CAST(c AS DOUBLE) ELSE
        CAST(w AS DOUBLE) * CAST(ts * 3 - coalesce(sum(CASE WHEN capped THEN c END) OVER (), 0) * 2 AS DOUBLE)
        / CAST((tw - coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0)) * 2 AS DOUBLE) END AS target FROM q),
j AS (SELECT d.doc_id, d.size, CAST(t.s AS BIGINT) AS source_size, t.target, CASE WHEN t.s > 0 THEN t.target / CAST(t.s AS DOUBLE) ELSE 0.0 END AS rate,
        CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM j
"""

_BUCKET = "CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) END"
_TOP = "CASE WHEN b < 64 THEN b ELSE ((b - 32 * ((b - 32) // 32) + 1) << ((b - 32) // 32)) - 1 END"
_FLOORS = {"symbols": 200, "dup_lines": 2000, "repeats": 1000, "shouts": 200, "word_length": 60}


def _fence(level: str) -> str:
    return ", ".join(f"max(CASE WHEN metric = '{m}' THEN q75 + 3 * greatest(q75 - q25, {f}) END) AS {m}_hi" for m, f in _FLOORS.items()) + ", max(CASE WHEN metric = 'word_length' THEN q25 - 3 * greatest(q75 - q25, 60) END) AS word_length_lo, max(total) AS n"


def _quart(name: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
{name}_b AS (SELECT {k}metric, b, sum(n) AS n FROM sk GROUP BY {k}metric, b),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {k}metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {k}metric) AS total FROM {name}_b),
{name}_q AS (SELECT {k}metric, max(total) AS total, min(CASE WHEN upto * 100 >= total * 25 THEN {_TOP} END) AS q25, min(CASE WHEN upto * 100 >= total * 75 THEN {_TOP} END) AS q75 FROM {name}_c GROUP BY {k}metric),
{name} AS (SELECT {k}{_fence(name)} FROM {name}_q {group})"""


_PICKED = ", ".join(f"CASE WHEN o.n >= 100 THEN o.{c} WHEN l.n >= 100 THEN l.{c} ELSE a.{c} END AS {c}" for c in [f"{m}_hi" for m in _FLOORS] + ["word_length_lo"])
_INSIDE = " AND ".join(f"{m} <= {m}_hi" for m in _FLOORS) + " AND word_length >= word_length_lo"

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, source, text, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts,
        len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (rid)),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 10000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_lines,
        n_repeat_words * 10000 // greatest(n_words, 1) AS repeats, n_shouts * 10000 // greatest(word_chars, 1) AS shouts, word_chars * 100 // greatest(n_words, 1) AS word_length FROM m),
u AS (UNPIVOT (SELECT lang, source, CAST(symbols AS BIGINT) AS symbols, CAST(dup_lines AS BIGINT) AS dup_lines, CAST(repeats AS BIGINT) AS repeats, CAST(shouts AS BIGINT) AS shouts, CAST(word_length AS BIGINT) AS word_length FROM x WHERE NOT base_failed)
      ON symbols, dup_lines, repeats, shouts, word_length INTO NAME metric VALUE v),
sk AS (SELECT lang, source, metric, {_BUCKET} AS b, count(*) AS n FROM u GROUP BY ALL),
{_quart('o', 'lang, source')},
{_quart('l', 'lang')},
{_quart('a', '')},
f AS (SELECT o.lang, o.source, {_PICKED} FROM o LEFT JOIN l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_INSIDE}, TRUE) AS kept
FROM x LEFT JOIN f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS p, ls[i] AS x, len(regexp_extract_all(ls[i], '{WORD}')) AS w, CAST('0x' || substr(md5(ls[i]), 1, 15) AS BIGINT) AS h
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) WHERE regexp_matches(ls[i], '{WORD}')),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM l),
pair AS (SELECT 1 AS dir UNION ALL SELECT -1),
g AS (SELECT a.doc_id, a.r AS r0, dir, b.r AS r1, abs(b.r - a.r) AS k, sum(b.w) OVER w AS total, b.h AS h, lag(b.h) OVER w AS hp
      FROM n a CROSS JOIN pair JOIN n b ON a.doc_id = b.doc_id AND ((dir = 1 AND b.r BETWEEN a.r AND a.r + 7) OR (dir = -1 AND b.r BETWEEN a.r - 7 AND a.r))
      WINDOW w AS (PARTITION BY a.doc_id, a.r, dir ORDER BY abs(b.r - a.r))),
c AS (SELECT doc_id, least(r0, r1) AS f, greatest(r0, r1) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, r0, dir ORDER BY k) AS o FROM g
      WHERE total >= 40 OR k = 7 OR (k > 0 AND total >= 20 AND xor(xor(hp, hp >> 7), h) % 4 = 0)) WHERE o = 1),
u AS (SELECT DISTINCT doc_id, f, t FROM c),
b AS (SELECT u.doc_id, u.f, u.t, string_agg(n.x, chr(10) ORDER BY n.r) AS x FROM u JOIN n ON n.doc_id = u.doc_id AND n.r BETWEEN u.f AND u.t GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, f) AS o FROM b),
gone AS (SELECT DISTINCT n.doc_id, n.p FROM o JOIN n ON n.doc_id = o.doc_id AND n.r BETWEEN o.f AND o.t WHERE o.o > 1),
gl AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
nl AS (SELECT doc_id, count(*) AS n FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(nl.n, 0) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(ps, i - 1)), lambda i: ls[i]), chr(10)) END AS text
FROM d LEFT JOIN gl USING (doc_id) LEFT JOIN nl USING (doc_id)
"""

# All pairs that share a shingle, and the least document that each reaches.
OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
t AS (SELECT doc_id AS v, doc_id AS root FROM n UNION SELECT e.v, t.root FROM t JOIN e ON e.u = t.v AND t.root < e.v),
r AS (SELECT v, min(root) AS root FROM t GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.v = d.doc_id
"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
_ORDER = "ORDER BY turn NULLS FIRST, role, text"
OP8 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({sum(map(len, ('<|turn|>', '<|says|>', '<|end|>')))} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES = {"op2_minhash_dedup": OP2, "op4_line_dedup": OP4, "op5_quality_rules": OP5, "op8_chat_format": OP8, "op10_mix_sources": OP10}
