"""DuckDB SQL for conversation repair, centroid clustering and sharding."""

from __future__ import annotations

#: One row with the 256 entries of CRC-32.
_TABLE = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"""


def _crc(text: str) -> str:
    """CRC-32 of a string, byte by byte; needs the column tab."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def _node(letter: str, cost: str, to: str) -> str:
    return f"{{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a}}"


def _raw(state: int, kept: dict[str, str], added: str) -> str:
    """Least (cost, letters) of the arcs over a turn from a state; no inserts."""
    keep = " ".join(f"WHEN initial = '{i}' THEN {_node('K', 'extra', s)}" for i, s in kept.items())
    return f"least({_node('D', '3', f's{state}')}, CASE WHEN must THEN {_node('D', '3', f's{state}')} ELSE least({_node('R', '2 + extra', added)}, CASE {keep} ELSE {_node('D', '3', f's{state}')} END) END)"


CONVERSATIONS = rf"""
WITH RECURSIVE {_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("conv_id || ':' || turn")} % 20 AS k FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM o),
e AS (SELECT conv_id, i, initial, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::BIGINT AS extra FROM f),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n + 1, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 4::BIGINT, 'a': 'II'}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}} FROM n
  UNION ALL
  SELECT conv_id, i, least(r0, {_node("I", "2", "u")}), least(r1, {_node("I", "2", "u")}), u, least(r3, {_node("I", "2", "u")}) FROM (
    SELECT *, least(r2, {_node("I", "2", "r3")}) AS u FROM (
      SELECT conv_id, e.i, {_raw(0, {"s": "s1", "u": "s2"}, "s2")} AS r0, {_raw(1, {"u": "s2"}, "s2")} AS r1, {_raw(2, {"a": "s3"}, "s3")} AS r2, {_raw(3, {"u": "s2"}, "s2")} AS r3
      FROM r JOIN e USING (conv_id) WHERE e.i = r.i - 1))),
b AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, unnest(range(1, length(s0.a) + 1)) AS p FROM r WHERE i = 1),
l AS (SELECT conv_id, audit, p, audit[p] AS letter, p - length(replace(left(audit, p), 'D', '')) AS gone, length(replace(left(audit, p), 'I', '')) AS i,
  length(replace(left(audit, p - 1), 'D', '')) AS k, length(replace(audit, 'D', '')) % 2 AS odd FROM b),
t AS (SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (k - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS t
  FROM l LEFT JOIN f ON l.conv_id = f.conv_id AND l.i = f.i WHERE letter <> 'D' GROUP BY l.conv_id),
a AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM r WHERE i = 1)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN n USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN t USING (conv_id)"""


def _assigned(k: int) -> str:
    far = "list_sum(list_transform(list_zip(any_value(x.v), any_value(y.v)), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"d{k} AS MATERIALIZED (SELECT vec_id, y.c, {far} AS far FROM x, c{k} y GROUP BY vec_id, y.c),\na{k} AS MATERIALIZED (SELECT vec_id, min({{'far': far, 'c': c}}) AS best FROM d{k} GROUP BY vec_id)"


def _moved(k: int) -> str:
    return f"""m{k} AS (SELECT best.c AS c, p, sum(e) AS s, count(*) AS n FROM (SELECT best, unnest(range(64)) AS p, unnest(v) AS e FROM a{k} JOIN x USING (vec_id)) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(any_value(w.v), any_value(c{k}.v)) AS v FROM c{k} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS v FROM m{k} GROUP BY c) w USING (c) GROUP BY c{k}.c)"""


CENTROIDS = f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM x QUALIFY c < 40),
{", ".join(_assigned(k) + ", " + _moved(k) for k in range(5))},
{_assigned(5)}
SELECT vec_id, best.c::INT AS cluster, best.far AS distance, sum(best.far) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.far) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a5 JOIN c5 ON best.c = c5.c"""

SHARDS = f"""
WITH RECURSIVE {_TABLE},
t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size, sha256(coalesce(text, '')) AS h FROM documents),
g AS MATERIALIZED (SELECT h, sum(size)::BIGINT AS b FROM t GROUP BY h),
l AS MATERIALIZED (SELECT list_prepend({{'n': 1, 'f': 0::BIGINT}}, list({{'n': 0, 'f': b}} ORDER BY h)) AS bs, ((sum(b) + 15) // 16)::BIGINT AS mean, max(b) AS most FROM g),
s(low, high) AS (SELECT greatest(mean, most), greatest(mean, most) + most FROM l UNION ALL
  SELECT CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END FROM (
    SELECT low, high, mid, list_reduce(bs, lambda a, x: CASE WHEN a.f + x.f <= mid THEN {{'n': a.n, 'f': a.f + x.f}} ELSE {{'n': a.n + 1, 'f': x.f}} END).n <= 16 AS fits
    FROM (SELECT low, high, (low + high) // 2 AS mid FROM s WHERE low < high), l)),
cap AS (SELECT min(high) AS cap FROM s),
p AS MATERIALIZED (SELECT h, sum(b) OVER (ORDER BY h)::BIGINT AS upto FROM g),
ps AS MATERIALIZED (SELECT list(upto) AS ps FROM p),
k(j, cut) AS (SELECT 0, 0::BIGINT UNION ALL SELECT j + 1, list_max(list_filter(ps, lambda x: x <= cut + cap)) FROM k, ps, cap WHERE j < 15),
q AS (SELECT h, (SELECT count(*) FROM k WHERE j > 0 AND cut < upto)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, {_crc("text")} AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM t JOIN q USING (h), tab"""
