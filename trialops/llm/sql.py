"""DuckDB SQL of the queries, written apart from the operators; all constants are literal here."""

_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

REPLY_TREES = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(15 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_UUID = "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'"


def _replaced(expression: str) -> str:
    """Character references of the given pages and the usual typographic ones, the ampersand last."""
    pairs = [
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
        ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"),
        ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"),
        ("&amp;", "&"),
    ]
    for name, char in pairs:
        expression = f"replace({expression}, '{name}', '{char}')"
    return expression


WARC = f"""
WITH page AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload,
    md5('response' || coalesce('|' || CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || coalesce(html, '')) AS h
  FROM pages
), source AS (
  SELECT page_id, url, payload, {_UUID.format('h')} AS record_id, 'sha256:' || sha256(payload) AS payload_digest,
    md5('metadata|' || {_UUID.format('h')}) AS m, md5('conversion|' || {_UUID.format('h')}) AS c
  FROM page
), bare AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(payload,
    '<!--.*?-->|<script([\\s/][^>]*)?>.*?</script\\s*>|<style([\\s/][^>]*)?>.*?</style\\s*>|<noscript([\\s/][^>]*)?>.*?</noscript\\s*>|<template([\\s/][^>]*)?>.*?</template\\s*>', '', 'gis'),
    '</?(p|br|hr|div|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|title|blockquote|pre)([\\s/][^>]*)?>', chr(10), 'gi'),
    '<[/!?a-zA-Z][^>]*>', '', 'g') AS marked
  FROM source
), said AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace({_replaced('marked')},
    '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS text
  FROM bare
), derived AS (
  SELECT page_id, 'metadata' AS record_type, {_UUID.format('m')} AS record_id, record_id AS refers_to, {_UUID.format('c')} AS concurrent_to,
    url AS target_uri, payload_digest AS source_digest, 'application/warc-fields' AS content_type,
    concat_ws(chr(13) || chr(10), 'source-payload-digest: ' || payload_digest, 'source-length: ' || octet_length(encode(payload)),
      'converted-to: ' || {_UUID.format('c')}, 'source-header: HTTP/1.1 200 OK', 'source-header: Content-Type: text/html; charset=utf-8',
      'source-header: Content-Length: ' || octet_length(encode(payload)), '') AS block
  FROM said
  UNION ALL
  SELECT page_id, 'conversion', {_UUID.format('c')}, record_id, {_UUID.format('m')}, url, payload_digest, 'text/plain; charset=utf-8', text
  FROM said
)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '1970-01-01T00:00:00Z' AS date, source_digest, content_type,
  octet_length(encode(block)) AS content_length, 'sha256:' || sha256(block) AS block_digest, block
FROM derived
"""

TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_grams AS (
  SELECT item_id, len(w) AS m, least(5, len(w)) AS k,
    list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: list_slice(w, i, i + least(5, len(w)) - 1)) AS grams
  FROM item WHERE len(w) > 0
), doc_grams AS (
  SELECT doc_id, len(w) AS n, k, list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1)) AS grams
  FROM doc, (SELECT DISTINCT k FROM item_grams) WHERE len(w) >= k
), placed AS (SELECT doc_id, k, unnest(grams) AS g, generate_subscripts(grams, 1) - 1 AS p, n FROM doc_grams
), listed AS (SELECT DISTINCT item_id, m, k, unnest(grams) AS g FROM item_grams
), seeds AS (SELECT doc_id, item_id, m, k, p, n FROM placed JOIN listed USING (k, g)
), starts AS (
  SELECT DISTINCT doc_id, item_id, m, k,
    unnest(range(least(greatest(p - (m - k), 0), greatest(n - m, 0)), least(p, greatest(n - m, 0)) + 1)) AS start
  FROM seeds
), window_bags AS (
  SELECT s.doc_id, s.item_id, s.start, p.g, count(*) AS times, s.m - s.k + 1 AS size_i
  FROM starts s JOIN placed p ON p.doc_id = s.doc_id AND p.k = s.k AND p.p BETWEEN s.start AND s.start + s.m - s.k
  GROUP BY ALL
), item_bags AS (SELECT item_id, g, count(*) AS times FROM (SELECT item_id, unnest(grams) AS g FROM item_grams) GROUP BY ALL
), compared AS (
  SELECT w.doc_id, w.item_id, w.start, sum(least(w.times, coalesce(i.times, 0))) AS shared, sum(w.times) + any_value(size_i) AS weight
  FROM window_bags w LEFT JOIN item_bags i ON i.item_id = w.item_id AND i.g = w.g GROUP BY ALL
), alike AS (SELECT *, shared / (weight - shared) AS similarity FROM compared WHERE 5 * shared >= 4 * (weight - shared))
SELECT doc_id, item_id, count(*) AS n_windows, CAST(arg_min(start, (-similarity, start)) AS BIGINT) AS start, max(similarity) AS similarity
FROM alike GROUP BY doc_id, item_id
"""

JACCARD = """
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3))) END AS s FROM doc
), postings AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM postings a JOIN postings b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
  least(doc_id, coalesce((SELECT min(y) FROM reach WHERE reach.x = sets.doc_id), doc_id)) AS component_id
FROM sets
"""

# A byte moves a CRC by one of 256 values; the list is built by eight steps of its polynomial.
IMPORTANCE = """
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(0, 256) r(i))
), texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), lists AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), placed AS (SELECT side, doc_id, unnest(w) AS word FROM lists
), words AS (SELECT DISTINCT word FROM placed
), hexed AS (SELECT word, hex(encode(word)) AS h FROM words
), bytes AS (
  SELECT word, list_transform(range(0, CAST(len(h) // 2 AS BIGINT)), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)) AS b FROM hexed
), hashed AS (
  SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, steps
), counted AS (SELECT side, doc_id, bucket FROM placed JOIN hashed USING (word)
), buckets AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM counted GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000)) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM buckets
), summed AS (SELECT doc_id, sum(gain) AS weight FROM counted JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM lists LEFT JOIN summed USING (doc_id) WHERE side = 'd'
), able AS (SELECT count(*) * 10 // 100 AS drawn FROM scored WHERE n_features >= 20
), ordered AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ordered, able
"""

FILL_IN_MIDDLE = """
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS h1,
    CAST(('0x' || substr(h, 9, 8)) AS BIGINT) AS h2, CAST(('0x' || substr(h, 17, 8)) AS BIGINT) AS h3, CAST(('0x' || substr(h, 25, 8)) AS BIGINT) AS h4 FROM doc
), parts AS (
  SELECT doc_id, text, len(w) AS n, array_to_string(list_slice(w, 1, least(h1 % (len(w) + 1), h2 % (len(w) + 1))), '') AS p,
    array_to_string(list_slice(w, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) + 1, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1))), '') AS m,
    array_to_string(list_slice(w, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) + 1, len(w)), '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
