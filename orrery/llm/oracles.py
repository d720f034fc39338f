"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mixing"] = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sources),
filled AS (
  SELECT *,
         CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0) AS left_size,
         CAST(sum(weight) OVER () AS DOUBLE) - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
  SELECT *, CAST(cap AS DOUBLE) * left_weight <= CAST(weight AS DOUBLE) * left_size AS capped FROM filled),
level AS (
  SELECT CAST(sum(source_size) - coalesce(sum(cap) FILTER (WHERE capped), 0) AS DOUBLE)
         / CAST(nullif(sum(weight) FILTER (WHERE NOT capped), 0) AS DOUBLE) AS level,
         sum(source_size) AS total
  FROM capped),
targets AS (
  SELECT c.*, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target, total
  FROM capped c, level),
laid AS (
  SELECT b.doc_id, b.size, t.source_rank, t.source_size, t.target, t.total, b.place,
         sum(b.size) OVER (PARTITION BY t.source_rank ORDER BY b.place, b.doc_id, b.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through,
         row_number() OVER (ORDER BY t.source_rank, b.place, b.doc_id, b.size) AS rank
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT rank, size, total, epoch, CAST(epoch * source_size + through AS DOUBLE) / target AS finish,
         least(size, CAST(round(target) AS BIGINT) - (epoch * source_size + through - size)) AS due
  FROM laid, range(3) e(epoch)
  WHERE size > 0 AND target > 0 AND CAST(round(target) AS BIGINT) > epoch * source_size + through - size),
queue AS (
  SELECT rank, due, total,
         coalesce(sum(due) OVER (ORDER BY finish, rank, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM copies),
taken AS (
  SELECT rank, CAST(sum(least(due, greatest(0, total - before))) AS BIGINT) AS taken FROM queue GROUP BY rank)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(t.taken, 0) AS taken
FROM laid l LEFT JOIN taken t USING (rank)
"""

ORACLES["op8_warc"] = r"""
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (
  SELECT hex, max(page_id) AS first FROM payloads GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(p.hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM payloads p JOIN firsts f ON p.hex = f.hex
"""


def _spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """SQL for one kind's spans: the text between matches gives the places."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place, start, start + len(m) AS finish FROM (
    SELECT doc_id, m, v,
           list_sum(list_transform(between[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: len(x))), 0) AS start
    FROM (SELECT doc_id, found, between, unnest(found) AS m, unnest(vals) AS v, generate_subscripts(found, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {group}) AS vals,
                       string_split_regex(t, '{p}') AS between
                FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))
  WHERE len(v) >= {least}"""


def _secrets() -> str:
    from orrery.llm.secrets import RULES

    every = " UNION ALL ".join(_spans(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(RULES))
    listing = "string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, place)"
    return f"""
WITH spans AS ({every}),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access,
         count(*) FILTER (WHERE place = 2) AS n_hex, {listing} FILTER (WHERE place < 3) AS base, {listing} AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)
"""


ORACLES["op7_secret_scans"] = _secrets()

ORACLES["op5_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (
  SELECT *, list_dot_product(e, e) AS q FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(a.q) * sqrt(b.q)) >= 0.98),
reach AS (
  SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM links)
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
roots AS (SELECT node AS vec_id, min(root) AS root FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN roots USING (vec_id)
"""

ORACLES["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
tokens AS (
  SELECT doc_id, len(s) AS n, hash(t) AS t FROM (SELECT doc_id, s, unnest(s) AS t FROM sets)),
often AS (
  SELECT t FROM tokens GROUP BY t HAVING count(*) > 1),
kept AS (
  SELECT * FROM tokens SEMI JOIN often USING (t)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM kept a JOIN kept b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM links)
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
roots AS (SELECT node AS doc_id, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM sets LEFT JOIN roots USING (doc_id)
"""

# CRC-32 by its definition: eight steps per byte over the reflected polynomial.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, x: xor(c >> 8, list_reduce(list_prepend(xor(c, x) & 255, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END))), 4294967295)"""

ORACLES["op3_sharding"] = f"""
WITH base AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, CAST({_CRC32} AS BIGINT) AS crc, key
  FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS key FROM documents)),
grouped AS (
  SELECT *, sum(size) OVER (PARTITION BY key, size, crc) AS group_bytes, count(*) OVER (PARTITION BY key, size, crc) AS group_rows FROM base),
line AS (
  SELECT *, sum(size) OVER w - size AS before, row_number() OVER w - 1 AS rank, sum(size) OVER () / 16.0::DOUBLE AS share
  FROM grouped WINDOW w AS (ORDER BY group_bytes DESC, key, size, crc, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
placed AS (
  SELECT *, CASE WHEN group_rows > 1 THEN min(before) OVER (PARTITION BY key, size, crc) ELSE before END AS first FROM line),
cuts AS (
  SELECT *, least(floor(first / share), 15) AS low, least(floor((first + group_bytes - 1) / share), 15) AS high FROM placed),
cut AS (
  SELECT *, CAST(CASE WHEN low = high THEN low WHEN high = low + 1 AND high * share - first <= 0.05 * share THEN high
    WHEN high = low + 1 AND first + group_bytes - high * share <= 0.05 * share THEN low
    ELSE least(floor((before + size / 2.0) / share), 15) END AS INT) AS shard FROM cuts)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM cut
"""

ORACLES["op6_suffix_array_dedup"] = r"""
WITH raw AS (
  SELECT k, doc_id, hex(encode(t)) AS h, strlen(t) AS n FROM (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents)),
windows AS (
  SELECT k, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS w FROM (SELECT k, h, unnest(range(n - 199)) AS i FROM raw WHERE n >= 200)),
again AS (
  SELECT w FROM windows GROUP BY 1 HAVING count(*) > 1),
hits AS (
  SELECT k, i AS a, i + 200 AS b FROM windows SEMI JOIN again USING (w)),
runs AS (
  SELECT k, a, b, sum(fresh) OVER (PARTITION BY k ORDER BY a) AS run
  FROM (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY k ORDER BY a) THEN 0 ELSE 1 END AS fresh FROM hits)),
gone AS (
  SELECT k, run, min(a) AS a, max(b) AS b FROM runs GROUP BY 1, 2),
gaps AS (
  SELECT k, b AS a, lead(a) OVER (PARTITION BY k ORDER BY a) AS b FROM gone UNION ALL SELECT k, 0, min(a) FROM gone GROUP BY 1),
kept AS (
  SELECT g.k, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, n) - a) AS BIGINT)), '' ORDER BY a) AS h
  FROM gaps g JOIN raw USING (k) GROUP BY 1),
sums AS (
  SELECT k, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gone GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, raw.h))) AS kept_sha256
FROM raw LEFT JOIN sums USING (k) LEFT JOIN kept USING (k)
"""

# Says what the main text of the tables' pages is, which all mark it; the operator reads other pages too.
ORACLES["op10_html_extraction"] = r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS a FROM pages),
blocks AS (
  SELECT page_id, generate_subscripts(s, 1) AS i, unnest(s) AS b
  FROM (SELECT page_id, regexp_split_to_array(regexp_replace(a, '<br>', ' ', 'g'), '</?(?:h1|p)>') AS s FROM article)),
clean AS (
  SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'),
         '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS b FROM blocks)
SELECT p.page_id, p.url, coalesce(t, '') AS text, CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars
FROM pages p LEFT JOIN (SELECT page_id, string_agg(b, chr(10) ORDER BY i) AS t FROM clean WHERE b <> '' GROUP BY 1) USING (page_id)
"""
