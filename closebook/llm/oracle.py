"""SQL for the queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH texts AS (
  SELECT page_id, row_number() OVER () AS page_no,
    lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'gis'),
      '</?(p|div|h[1-6]|li|ul|ol|nav|article|section|header|footer|br|tr|td|th|table|title|body|html|head|main|aside|form|blockquote|pre)(\s[^>]*)?/?>', E'\n', 'gi'),
      '<[^>]*>', ' ', 'g'), E'\n') AS parts
  FROM pages
),
page_lines AS (
  SELECT page_id, page_no, host, trim(regexp_replace(part, '[ \t\r\f]+', ' ', 'g')) AS line, place
  FROM (SELECT page_id, page_no, host, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM texts)
  WHERE trim(regexp_replace(part, '[ \t\r\f]+', ' ', 'g')) <> ''
),
hosts AS (SELECT host, count(*) AS pages FROM texts GROUP BY host HAVING count(*) >= 5),
boilerplate AS (
  SELECT host, line FROM page_lines JOIN hosts USING (host)
  GROUP BY host, line, pages HAVING count(DISTINCT page_no) > 0.2 * pages
),
marked AS (SELECT p.*, b.line IS NOT NULL AS boiler FROM page_lines p LEFT JOIN boilerplate b USING (host, line)),
counted AS (
  SELECT page_no, count(*) AS n_lines, count(*) FILTER (WHERE boiler) AS n_dropped,
    string_agg(line, E'\n' ORDER BY place) FILTER (WHERE NOT boiler) AS kept
  FROM marked GROUP BY page_no
)
SELECT page_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN counted USING (page_no)
"""

# With a limit of repetitions the exponent has a closed form, which the operator's bisection nears.
SOURCE_MIXING = r"""
WITH keyed AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS n_tokens,
    ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 6))::INT % 64 AS block
  FROM documents
),
blocks AS (SELECT src, block, sum(n_tokens)::BIGINT AS block_tokens FROM keyed GROUP BY ALL),
sources AS (SELECT src, sum(block_tokens)::BIGINT AS tokens FROM blocks GROUP BY src HAVING sum(block_tokens) > 0),
ends AS (SELECT min(tokens) AS least, max(tokens) AS most FROM sources),
exponent AS (SELECT CASE WHEN least = most THEN 0 ELSE greatest(0, 1 + ln(1.5) / ln(least / most)) END AS a, most FROM ends),
budgets AS (SELECT src, tokens, floor(tokens * pow(tokens / most, a - 1) + 0.001)::BIGINT AS budget FROM sources, exponent),
plan AS (
  SELECT b.src, b.block, b.block_tokens, tokens, budget, coalesce(budget // tokens, 1) AS full_passes
  FROM blocks b LEFT JOIN budgets USING (src)
),
passes AS (SELECT *, unnest(range(1, full_passes + 2)) AS pass_no FROM plan),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY src, pass_no ORDER BY md5('mix|' || pass_no || '|' || src || '|' || block), block) AS place FROM passes
),
partial AS (
  SELECT src, pass_no, any_value(budget - full_passes * tokens) AS rest, list({'total': block_tokens, 'taken': [block]} ORDER BY place) AS blocks
  FROM ordered WHERE pass_no > full_passes AND budget IS NOT NULL GROUP BY src, pass_no
),
fitted AS (
  SELECT src, pass_no, list_reduce(list_prepend({'total': 0::BIGINT, 'taken': []::INT[]}, blocks),
    lambda a, b: CASE WHEN a.total + b.total <= rest THEN {'total': a.total + b.total, 'taken': a.taken || b.taken} ELSE a END).taken AS taken
  FROM partial
),
taken AS (
  SELECT src, block, pass_no, place FROM ordered WHERE pass_no <= full_passes
  UNION ALL
  SELECT src, unnest(taken), pass_no, generate_subscripts(taken, 1) FROM fitted
)
SELECT k.doc_id, k.source, k.n_tokens, o.pass_no, o.place
FROM keyed k JOIN taken o USING (src, block)
"""

# Levels are built from the leaves up; each leaf then takes the siblings of its ancestors in turn.
MERKLE_MANIFEST = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(crc ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc
    FROM (SELECT unnest(range(256)) AS i))
),
texts AS (
  SELECT doc_id, source, lang, n_chars, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256)), 4294967295) % 2 = 0 AS gone
  FROM documents, crc_table
),
fields AS (
  SELECT doc_id, source, gone, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    CASE WHEN gone THEN replace(text, E'\n', '') ELSE text END AS seen
  FROM texts
),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS seen
  FROM fields
),
placed AS (
  SELECT *, row_number() OVER () AS row_no, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves
),
levels AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM levels WHERE n > 1 GROUP BY tree, level, idx // 3
),
subroots AS (SELECT tree, digest AS subroot FROM levels WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS idx, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM tops WHERE n > 1 GROUP BY level, idx // 3
),
below AS (SELECT tree, level, idx, digest FROM levels WHERE n > 1),
heights AS (SELECT tree, count(DISTINCT level) AS height FROM below GROUP BY tree),
ancestors AS (
  SELECT row_no, tree, 0 AS level, idx, n FROM placed WHERE n > 1
  UNION ALL
  SELECT row_no, tree, level + 1, idx // 3, (n + 2) // 3 FROM ancestors WHERE n > 3
),
tops_of AS (
  SELECT tree, 0 AS level, tree AS idx, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3 FROM tops_of WHERE n > 3
),
sides AS (
  SELECT row_no, a.level, string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx) AS before,
    string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx) AS after
  FROM ancestors a JOIN below b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
  GROUP BY row_no, a.level
),
top_sides AS (
  SELECT a.tree, a.level, string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx) AS before,
    string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx) AS after
  FROM tops_of a JOIN tops b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE b.n > 1
  GROUP BY a.tree, a.level
),
path AS (
  SELECT row_no, level, coalesce(before, '') AS before, coalesce(after, '') AS after FROM sides
  UNION ALL
  SELECT row_no, coalesce(height, 0) + level, coalesce(before, ''), coalesce(after, '')
  FROM placed JOIN top_sides USING (tree) LEFT JOIN heights USING (tree)
),
folds AS (
  SELECT row_no, 0::BIGINT AS level, seen AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT row_no, level + 1, sha256(before || folded || after), proof || before || after FROM folds JOIN path USING (row_no, level)
),
folded AS (SELECT row_no, arg_max(folded, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM folds GROUP BY row_no)
SELECT doc_id, leaf, subroot, digest AS root, proof_sha256, folded_root, folded_root = digest AS verified
FROM placed JOIN subroots USING (tree) JOIN folded USING (row_no), (SELECT digest FROM tops WHERE n = 1)
"""

# Distance * 16 + cluster: the least is the nearest centroid, the smaller number of equal ones.
_ASSIGNED = """
a{i} AS (
  SELECT row_no, vec_id, v, min(d * 16 + cluster) % 16 AS cluster, min(d * 16 + cluster) // 16 AS distance
  FROM (SELECT row_no, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i})
  GROUP BY row_no, vec_id, v
)"""
_MOVED = """
s{i} AS (SELECT cluster, place, sum(x)::BIGINT AS total, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY cluster, place),
m{i} AS (SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY place) AS c FROM s{i} GROUP BY cluster),
c{j} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""
CENTROID_CLUSTERING = (
    """
WITH kept AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM kept ORDER BY 1 LIMIT 16),"""
    + ",".join(_ASSIGNED.format(i=i) + "," + _MOVED.format(i=i, j=i + 1) for i in range(3))
    + ","
    + _ASSIGNED.format(i=3)
    + """
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""
)

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": LINE_DEDUP,
    "op4_source_mixing": SOURCE_MIXING,
    "op11_merkle_manifest": MERKLE_MANIFEST,
    "op13_centroid_clustering": CENTROID_CLUSTERING,
}
