"""DuckDB SQL for the queries that SQL can express."""

BENCHMARK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.rid, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""

NEAR_DUPS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.k >= 85 * (na.n + nb.n - p.k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

#: The slots are those of tables up to salts_for's first step, whose shards are numbered in one part.
SHARDS_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
hexed AS (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT rid, doc_id, size,
         xor(list_reduce(list_concat([4294967295::UBIGINT], [('0x' || h[2 * k + 1:2 * k + 2])::UBIGINT FOR k IN range(size - 8)]),
                         lambda c, b: xor(tab[(xor(c, b) & 255)::INT + 1], c >> 8)), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM hexed, tab),
jump AS (
  SELECT rid, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END)::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM hexed
  UNION ALL
  SELECT rid, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT rid, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2, j FROM jump WHERE j < 24)),
ends AS (SELECT rid, b::INT AS shard, CASE WHEN j = 24 THEN 24 ELSE b END::INT AS grown_shard FROM jump WHERE j >= 24)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, grown_shard
FROM crc JOIN ends USING (rid)
"""

LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (
  SELECT k.rid, count(*) AS n_lines, count(c.key) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL) AS kept
  FROM k LEFT JOIN c ON c.key = k.key GROUP BY k.rid)
SELECT d.doc_id, m.n_lines::BIGINT AS n_lines, m.n_dropped::BIGINT AS n_dropped, sha256(coalesce(m.kept, '')) AS kept_sha256
FROM d JOIN m USING (rid)
"""


def merkle_sql(levels: int = 6, over: int = 4) -> str:
    """SQL for trees of up to 16^levels leaves a source and 16^over sources.

    A row carries one hash, place and number of nodes for each level; a level of one node is the next one's too.
    """
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(c) for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"
    steps = []

    def tree(name: str, group: str, height: int) -> None:
        for k in range(height):
            steps.append(f"""
{name}{k + 1} AS (
  SELECT {group}, p // 16 AS p, (max(n) + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
  FROM {name}{k} GROUP BY {group}, p // 16),
{name}w{k} AS (
  SELECT {name}{k}.{group}, {name}{k}.p, max({name}{k}.n) > 1 AS up, coalesce(string_agg(o.h, '' ORDER BY o.p) FILTER (WHERE o.p < {name}{k}.p), '') AS l,
         coalesce(string_agg(o.h, '' ORDER BY o.p) FILTER (WHERE o.p > {name}{k}.p), '') AS r
  FROM {name}{k} JOIN {name}{k} o ON o.{group} = {name}{k}.{group} AND o.p // 16 = {name}{k}.p // 16 GROUP BY ALL)""")

    tree("s", "g", levels)
    steps.append(f"\nt0 AS (SELECT 1 AS one, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, h, g FROM s{levels})")
    tree("t", "one", over)
    proof, joins, folds, columns = [], ["JOIN t0 ON t0.g = f.g"], [], []
    for name, at, height in (("s", "f.p", levels), ("t", "t0.p", over)):
        for k in range(height):
            w = f"{name}w{k}"
            joins.append(f"JOIN {w} ON {w}.{'g = f.g' if name == 's' else 'one = t0.one'} AND {w}.p = {at} // {16**k}")
            proof.append(f"{w}.l || {w}.r")
            columns.append(f"{w}.up AS up_{w}, {w}.l AS l_{w}, {w}.r AS r_{w}")
            folds.append(f"CASE WHEN up_{w} THEN sha256(l_{w} || c || r_{w}) ELSE c END")
    joins.append(f"JOIN t{over} ON t{over}.one = t0.one")
    query = f"SELECT f.doc_id, f.h AS leaf, t0.h AS subroot, t{over}.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, coalesce(f.tampered, f.h) AS c, {', '.join(columns)} FROM f {' '.join(joins)}"
    for fold in folds:
        query = f"SELECT * REPLACE ({fold} AS c) FROM ({query})"
    crc = "xor(list_reduce(list_concat([4294967295::UBIGINT], [ascii((doc_id::VARCHAR)[i])::UBIGINT FOR i IN range(1, length(doc_id::VARCHAR) + 1)]), lambda c, b: xor(tab[(xor(c, b) & 255)::INT + 1], c >> 8)), 4294967295::UBIGINT)"
    return f"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
l AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS h,
         CASE WHEN doc_id IS NULL OR {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents, tab),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM l),
s0 AS (SELECT g, p, count(*) OVER (PARTITION BY g) AS n, h FROM f),{','.join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, c AS folded_root, c = root AS verified FROM ({query})
"""


MERKLE_SQL = merkle_sql()
