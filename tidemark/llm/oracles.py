"""The numbered queries as SQL, by definition and not by method: every shingle, string and posting is compared with every other."""

from __future__ import annotations

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_UP.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
h AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM d),
k AS (SELECT row, doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS node FROM h),
n AS (SELECT k.node, any_value(k.n) AS n, any_value(s) AS s FROM k JOIN h USING (row) WHERE k.node IS NOT NULL GROUP BY 1),
u AS (SELECT node, n, md5_number(unnest(s)) AS g FROM n),
e AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.g = b.g AND a.node < b.node GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT node, node AS top FROM n UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node WHERE r.top < l.b),
t AS (SELECT node, min(top) AS top FROM r GROUP BY 1),
c AS (SELECT top, min(doc_id) AS id FROM k JOIN t USING (node) GROUP BY 1)
SELECT doc_id, n AS n_shingles, CASE WHEN node IS NULL THEN doc_id ELSE id END AS component_id, coalesce(doc_id = CASE WHEN node IS NULL THEN doc_id ELSE id END, false) AS kept
FROM k LEFT JOIN t USING (node) LEFT JOIN c USING (top)"""

REPEATS = """WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT row, x, unnest(range(0, length(x) // 2 - 199, 512)) AS base FROM d WHERE length(x) >= 400),
q AS (SELECT row, base, substr(x, 2 * base + 1, 2 * (512 + 199)) AS x FROM p),
s AS (SELECT row, base + i AS pos, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT row, base, x, unnest(range(0, least(512, length(x) // 2 - 199))) AS i FROM q)),
m AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
g AS (SELECT row, pos, pos - lag(pos) OVER (PARTITION BY row ORDER BY pos) AS gap FROM s SEMI JOIN m USING (h)),
i AS (SELECT row, pos, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY pos) AS island FROM g),
z AS (SELECT row, min(pos) AS a, max(pos) + 200 AS z FROM i GROUP BY row, island),
k AS (SELECT row, a, z, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS done FROM z),
o AS (SELECT d.row, count(*) AS n, sum(k.z - k.a) AS gone, string_agg(substr(x, 2 * done + 1, 2 * (k.a - done)), '' ORDER BY k.a) || substr(any_value(x), 2 * max(k.z) + 1) AS kept FROM d JOIN k ON k.row = d.row GROUP BY 1)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN o ON o.row = d.row"""

SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents), a AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
t AS (SELECT row, any_value(n) AS n, w, count(*) AS f FROM (SELECT row, len(w) AS n, unnest(w) AS w FROM d) GROUP BY row, w), f AS (SELECT w, count(*) AS c FROM t GROUP BY w),
p AS (SELECT row, t.w, ln(1 + (docs - c + 0.5) / (c + 0.5)) * f * 2.2::DOUBLE / (f + 1.2 * (0.25 + 0.75 * n / mean)) AS share FROM t JOIN f ON f.w = t.w, a),
q AS (SELECT row_number() OVER () AS no, * FROM (SELECT DISTINCT doc_id AS query_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 100 = 0)), u AS (SELECT DISTINCT no, query_id, unnest({_WORDS}) AS w FROM q),
s AS (SELECT no, query_id, row, round(sum(share), 9) AS score FROM u JOIN p ON p.w = u.w GROUP BY 1, 2, 3),
r AS (SELECT query_id, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s JOIN d ON d.row = s.row)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(coalesce(CAST(doc_id AS VARCHAR), ''), '.'), lambda c: CAST(ascii(c) AS BIGINT))), lambda s, c: list_reduce(list_prepend(xor(s, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"

KATZ = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_CRC} % 5 = 1 AS held_out, list_append({_WORDS}, '') AS w FROM documents),
t AS (SELECT row, held_out, unnest(w) AS w, unnest(list_prepend(' ', w[:-2])) AS h FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), b AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1, 2),
x AS (SELECT h, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n1 AS (SELECT list_transform(range(1, 7), lambda r: len(list_filter(l, lambda y: y = r))) AS n FROM (SELECT coalesce(list(c), []) AS l FROM c)), n2 AS (SELECT list_transform(range(1, 7), lambda r: len(list_filter(l, lambda y: y = r))) AS n FROM (SELECT coalesce(list(c), []) AS l FROM b)),
{{keep}},
a AS (SELECT coalesce(sum(c), 0) AS total, count(*) AS types, sum(c * coalesce(k, 1)) AS mass FROM c LEFT JOIN k1 ON k1.r = c.c),
g AS (SELECT total, types, mass, CASE WHEN total = 0 THEN 1 ELSE greatest(1 - mass / total, 0.5 / (total + 1)) END AS unseen FROM a),
p AS (SELECT w, c, c * coalesce(k, 1) * (1 - unseen) / mass AS p FROM c LEFT JOIN k1 ON k1.r = c.c, g),
s AS (SELECT b.h, sum(b.c * coalesce(k, 1)) / any_value(x.c) AS m, sum(p.p) AS seen, any_value(x.c) AS n FROM b JOIN x USING (h) JOIN p ON p.w = b.w LEFT JOIN k2 ON k2.r = b.c GROUP BY 1),
f AS (SELECT h, n, CASE WHEN m > n / (n + 1) THEN n / (n + 1) / m ELSE 1 END AS f, m, seen FROM s),
o AS (SELECT row, count(*) AS n_tokens, count(p.c) AS n_known, sum(log10((coalesce(p.c, 0) + 0.5) / (total + 0.5 * (types + 1)))) AS base,
 sum(log10(CASE WHEN b.c IS NOT NULL THEN f.f * b.c * coalesce(k, 1) / f.n WHEN f.h IS NOT NULL THEN (1 - f.f * m) / greatest(1 - seen, 1e-12) * coalesce(p.p, unseen) ELSE coalesce(p.p, unseen) END)) AS score
 FROM t LEFT JOIN p ON p.w = t.w LEFT JOIN b ON b.h = t.h AND b.w = t.w LEFT JOIN f ON f.h = t.h LEFT JOIN k2 ON k2.r = b.c, g GROUP BY row)
SELECT doc_id, held_out, n_tokens, n_known, CAST(total AS BIGINT) AS train_tokens, round(base, 7) AS base_score, round(score, 7) AS score FROM d JOIN o USING (row), g"""


def _keep(k: str, n: str) -> str:
    """Good-Turing shares of counts 1 to 5 from the numbers of types by count."""
    return f"""{k}b AS (SELECT n, CASE WHEN n[1] > 0 THEN 6.0 * n[6] / n[1] ELSE 0 END AS base FROM {n}),
{k}d AS (SELECT r, CASE WHEN n[r] > 0 AND n[r + 1] > 0 AND base < 1 THEN ((r + 1) * n[r + 1] / (r * n[r])::DOUBLE - base) / (1 - base) END AS d FROM {k}b, range(1, 6) v(r)),
{k}e AS (SELECT r, CASE WHEN d > 0 AND d < 1 THEN d ELSE 1 END AS d FROM {k}d),
{k} AS (SELECT r, CASE WHEN min(d) OVER () = 1 THEN 1 - 0.5 / r ELSE d END AS k FROM {k}e)"""


KATZ = KATZ.replace("{keep}", _keep("k1", "n1") + ",\n" + _keep("k2", "n2"))
