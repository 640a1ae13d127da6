"""DuckDB SQL for the registered queries that SQL can express."""

from taintlake.llm import repeats
from taintlake.llm.fingerprint import WORDS

_BITS = ", ".join(f"list_aggregate(list_transform(a, lambda h: ((h >> {j}) & 1099512676353)::HUGEINT), 'sum')" for j in range(WORDS))
_LANES = f"""list_transform([len(m)::HUGEINT, list_aggregate(list_transform(b, lambda h: (h & 1073741823)::HUGEINT), 'sum'),
  list_aggregate(list_transform(b, lambda h: (h >> 30)::HUGEINT), 'sum'), {_BITS}], lambda x, i: (coalesce(x, 0) % (CASE WHEN i <= 3 THEN 4294967296 ELSE 1152921504606846976 END))::BIGINT)"""
_SIGNED = "flatten(list_transform(v[4:23], lambda w: [2 * (w & 1048575) - v[1], 2 * ((w >> 20) & 1048575) - v[1], 2 * ((w >> 40) & 1048575) - v[1]]))"


def _likeness(v: str, w: str) -> str:
    a, b = _SIGNED.replace("v[", f"{v}["), _SIGNED.replace("v[", f"{w}[")

    def dot(x: str, y: str) -> str:
        return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1] * z[2]))"

    norm = f"({dot(a, a)} + {dot(b, b)})"
    return f"CASE WHEN {v} = {w} THEN 1.0 WHEN {norm} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (2 * {dot(a, b)})::DOUBLE / {norm}::DOUBLE)) END::DOUBLE"


def _shown(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x, i: lpad(lower(to_hex(x)), CASE WHEN i <= 3 THEN 8 ELSE 15 END, '0')), '')"


_BASE32 = " || ".join(f"translate(to_base(('0x' || sha1(p)[{1 + 10 * i}:{10 + 10 * i}])::BIGINT, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in range(4))

def _windows(n: int) -> str:
    """Words of each text that lie in a window of n words found twice or more."""
    return f"""(SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, i + j AS at FROM
  (SELECT doc_id, i FROM (SELECT doc_id, unnest(range(1, len(w) - {n - 2})) AS i, w FROM d) QUALIFY count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i:i + {n - 1}], ' '))) > 1),
  range({n}) AS r(j)) GROUP BY doc_id)"""


_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: "
        "[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) "
        "ELSE acc // 2 END), 4294967295)")


def _clustered(rounds: int = 3) -> str:
    """Centroids c0, c1, ... as (k, v), each from the assignment a0, a1, ... before it."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, k AS cluster, dist FROM (SELECT e.vec_id, e.v, c.k, list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
  FROM e CROSS JOIN c{i} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT cluster, j, sum(v[j]) AS total, count(*) AS n FROM a{i}, range(1, 65) AS r(j) GROUP BY cluster, j),
m{i} AS (SELECT cluster AS k, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k))""")
    return ",\n".join(parts)


ORACLES: dict[str, str] = {
    "op11_periodic_runs": rf"""
WITH d0 AS (SELECT doc_id, {_CRC} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
d1 AS (SELECT doc_id, h, h // 10 AS g, w, len(w) AS n FROM d0),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
  list_transform(range(n), lambda i: w[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE w END AS w FROM d1),
t AS (SELECT doc_id, n, i, md5(array_to_string(w[i + 1:i + 3], ' ')) AS h3 FROM (SELECT doc_id, n, w, unnest(range(0, n - 2)) AS i FROM d)),
m AS (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, h3) >= 3),
p AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.h3 = b.h3 AND b.i > a.i AND (b.i - a.i) * 4 <= a.n),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM p),
st AS (SELECT doc_id, q, min(i) AS start, count(*) + q + 2 AS length FROM isl GROUP BY doc_id, q, grp),
r AS (SELECT doc_id, start, length, min(q) AS period FROM st WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS txt FROM r GROUP BY doc_id),
top AS (SELECT doc_id, start, length, period FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.doc_id = b.doc_id AND
  (b.length * a.period > a.length * b.period OR (b.length * a.period = a.length * b.period AND (b.start < a.start OR (b.start = a.start AND b.period < a.period)))))),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(start + period, start + length)))) AS gone FROM r GROUP BY doc_id),
g AS (SELECT doc_id, list(x) AS xs FROM (SELECT doc_id, unnest(gone) AS x FROM gone) GROUP BY doc_id),
mk AS (SELECT d.doc_id, array_to_string(list(w[k + 1] ORDER BY k), ' ') AS txt FROM (SELECT d.doc_id, w, unnest(range(n)) AS k FROM d JOIN g USING (doc_id)) d
  ANTI JOIN (SELECT doc_id, unnest(xs) AS x FROM g) z ON d.doc_id = z.doc_id AND d.k = z.x GROUP BY d.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start, top.length, top.period, 1000 * top.length // top.period AS exponent_milli,
       sha256(coalesce(agg.txt, '')) AS runs_sha256, sha256(coalesce(mk.txt, array_to_string(d.w, ' '))) AS collapsed_sha256
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN mk USING (doc_id)""",
    "op12_quality_rules": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
r AS {_windows(3)}, c AS {_windows(repeats.MIN_REPEAT)}, x AS {_windows(repeats.MAX_REPEAT + 1)},
f AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(r.c, 0) AS n_repeat_words, coalesce(c.c, 0) AS covered, x.c IS NOT NULL AS long
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND covered <= {repeats.MAX_COVERED} * n_words AND NOT long AS kept FROM b""",
    "op13_centroids": f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id) - 1)::INTEGER AS k, v FROM e QUALIFY k < 16),
{_clustered()},
t AS (SELECT *, sum(dist) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(dist) OVER ()::BIGINT AS inertia FROM a3)
SELECT vec_id, cluster, dist AS distance, cluster_inertia, inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM t JOIN c3 ON c3.k = cluster""",
    "op2_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op10_warc": f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages), h AS (SELECT p, max(page_id) AS head FROM t GROUP BY p)
SELECT page_id, strlen(p) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to
FROM t JOIN h USING (p)""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n_words FROM d),
s AS (SELECT doc_id, unnest(range(1, n_words - 11)) AS i, w FROM n),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM s),
low AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
hit AS (SELECT win.doc_id, i FROM win JOIN low USING (h) WHERE first < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(13) AS r(j)),
per AS (SELECT doc_id, list(i) AS g, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n_removed > 0 THEN list_filter(w, lambda x, k: NOT list_contains(g, k)) ELSE w END, ' ')) AS kept_sha256
FROM n LEFT JOIN per USING (doc_id)""",
    "op9_fingerprints": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM t),
e AS (SELECT *, left(text, n - n // 4) || left(nxt, n // 4) AS edited FROM o),
x AS (SELECT doc_id, unnest([text, edited, nxt]) AS s, unnest([0, 1, 2]) AS k FROM e),
m AS (SELECT doc_id, k, list_transform(list_filter(regexp_split_to_array(s, '[\\n\\r.!?]+'), lambda p: p <> ''), lambda p: md5(p)) AS m FROM x),
h AS (SELECT doc_id, k, m, list_transform(m, lambda d: ('0x' || d[1:15])::BIGINT) AS a, list_transform(m, lambda d: ('0x' || d[16:30])::BIGINT) AS b FROM m),
l AS (SELECT doc_id, k, {_LANES} AS v FROM h),
w AS (SELECT a.doc_id, a.v AS v, b.v AS ve, c.v AS vn FROM l a JOIN l b ON a.doc_id = b.doc_id JOIN l c ON a.doc_id = c.doc_id WHERE a.k = 0 AND b.k = 1 AND c.k = 2)
SELECT e.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_shown('v')} AS fingerprint, {_shown('ve')} AS edited_fingerprint,
       {_likeness('v', 've')} AS near_edited, {_likeness('v', 'vn')} AS near_next
FROM e JOIN w USING (doc_id)""",
}
