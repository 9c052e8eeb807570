"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def _jump(shards: int) -> str:
    """The jump recursion on (bucket, next, state) with 128-bit arithmetic modulo 2^64."""
    step = "((state * 2862933555777941757 + 1) % 18446744073709551616)"
    return f"""
    SELECT doc_id, max(nxt) AS shard FROM walk_{shards} WHERE nxt < {shards} GROUP BY doc_id""", f"""
    walk_{shards}(doc_id, nxt, state) AS (
      SELECT DISTINCT doc_id, 0::BIGINT, doc_id::UHUGEINT FROM documents
      UNION ALL
      SELECT doc_id, floor((nxt + 1) * (2147483648.0::DOUBLE / (({step} // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT, {step}
      FROM walk_{shards} WHERE nxt < {shards}
    )"""


_S16, _W16 = _jump(16)
_S17, _W17 = _jump(17)
#: crc32 is written out bit by bit nowhere: DuckDB lacks it, so the column comes from a table-driven fold.
_CRC_TABLE = "[" + ", ".join(
    str(__import__("functools").reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(8), n)) for n in range(256)
) + "]"
OP3 = f"""
WITH RECURSIVE {_W16}, {_W17},
table_crc AS (SELECT {_CRC_TABLE} AS c),
s AS ({_S16}), g AS ({_S17}),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (
  SELECT doc_id, octet_length(b) + 1 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT)),
      lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, table_crc
)
SELECT h.doc_id, h.size, h.text_crc32, 'key' AS law, s.shard::INT AS shard,
  row_number() OVER (PARTITION BY s.shard ORDER BY md5(h.doc_id::VARCHAR), h.doc_id, h.text_crc32, h.size) - 1 AS slot,
  g.shard::INT AS grown_shard
FROM h JOIN s USING (doc_id) JOIN g USING (doc_id)
"""


def _kind(no: int, name: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {no} AS kind_no, '{name}' AS kind, pos AS start, pos + length(hit) AS stop FROM (
    SELECT doc_id, hits[i] AS hit, parts[i] AS part,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS pos
    FROM (SELECT doc_id, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS parts, regexp_split_to_array(t, '{p}') AS gaps
      FROM d)))
  WHERE length(part) >= {least}"""


#: The contract's own words, apart from the operator's: kind, pattern, group whose length counts, least length.
_RULES = (
    (0, "assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    (1, "access", "AKIA[A-Z0-9]+", 0, 16),
    (2, "hex", "[0-9a-f]+", 0, 32),
)

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_kind(*rule) for rule in _RULES)}),
s AS (SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind_no) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)
"""

def _time(area: str) -> str:
    root = f"(sqrt(greatest(0.0::DOUBLE, g0 * g0 + (g1 - g0) * {area} * 2)) - g0) / (g1 - g0)"
    return f"CASE WHEN g0 = g1 THEN {area} / g0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {root})) END"


OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(r % 3) + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT level FROM l WHERE cap > level * w ORDER BY cap / w, r LIMIT 1) AS final FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(final * w, cap)) AS target, [1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE][(r % 3) + 1] AS g0, [0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE][(r % 3) + 1] AS g1 FROM f),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.g0, t.g1,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS pos,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN pos + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END ELSE 0 END::INT AS copies FROM x),
-- the schedule runs from g0 to g1: the time t at which g0 t + (g1 - g0) t t / 2 is the share read, of its mean at t = 1
y AS (SELECT *, least(1.0::DOUBLE, pos / target) * (g0 + g1) / 2 AS a1, least(1.0::DOUBLE, (pos + source_size) / target) * (g0 + g1) / 2 AS a2 FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
  CASE WHEN copies > 0 THEN {_time('a1')} END AS position, CASE WHEN copies > 1 THEN {_time('a2')} END AS position2 FROM y
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": OP3, "op5_secrets": OP5, "op9_exact_dedup": OP9, "op10_mixing": OP10}
