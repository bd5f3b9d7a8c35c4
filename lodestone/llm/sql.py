"""DuckDB SQL for the queries that SQL can express, each written plainly and without the operator's method."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase


def crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, a byte at a time over the usual table."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    bytes_of = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    step = f"lambda crc, b: xor(crc >> 8, ({table})[(xor(crc, b) & 255) + 1])"
    return f"xor(list_reduce({bytes_of}, {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


SHARDS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
k AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, CASE WHEN text = '' THEN 0 ELSE {crc32("text")} END AS text_crc32, source FROM d),
c AS (SELECT *, CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32 || ':' || size), 1, 15) AS BIGINT) AS h FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM c),
g AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source NULLS FIRST, h, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(place * 8 // total AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY place * 8 // total ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM g"""

REPEATS = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS w FROM (SELECT doc_id, words, unnest(generate_series(1, CAST(len(words) AS BIGINT) - 19)) AS i FROM d WHERE len(words) >= 20)),
again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM again),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM d) x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.i = x.i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


CONTAMINATION = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words("text")} AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, width, array_to_string(words[s:s + width - 1], ' ') AS w FROM (SELECT item_id, words, least(10, len(words)) AS width, unnest(generate_series(1, greatest(1, CAST(len(words) AS BIGINT) - 9))) AS s FROM b WHERE len(words) > 0)),
d AS (SELECT doc_id, {_words("text")} AS words FROM documents),
dw AS (SELECT doc_id, width, i, array_to_string(words[i:i + width - 1], ' ') AS w FROM (SELECT doc_id, words, width, unnest(generate_series(1, CAST(len(words) - width + 1 AS BIGINT))) AS i FROM d, (SELECT DISTINCT width FROM iw) WHERE len(words) >= width)),
m AS (SELECT dw.doc_id, dw.i, dw.width, iw.item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.width = iw.width),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(CAST(i AS BIGINT), CAST(i + width - 1 AS BIGINT))) AS p FROM m) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
dp AS (SELECT doc_id, generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS word FROM d),
counts AS (SELECT word, count(*) AS n FROM dp GROUP BY word),
b2 AS (SELECT item_id, words, least(10, len(words)) AS width, unnest(generate_series(1, greatest(1, CAST(len(words) AS BIGINT) - 9))) AS s FROM b WHERE len(words) > 0),
pl AS (SELECT item_id, s, width, generate_subscripts(words[s:s + width - 1], 1) - 1 AS k, unnest(words[s:s + width - 1]) AS word FROM b2),
rk AS (SELECT pl.*, row_number() OVER (PARTITION BY item_id, s ORDER BY coalesce(n, 0), pl.word, k) AS rarity FROM pl LEFT JOIN counts ON pl.word = counts.word),
cand AS (SELECT DISTINCT doc_id, item_id, s, width, pos - k AS f FROM rk JOIN dp ON rk.word = dp.word WHERE rarity <= 2),
close AS (SELECT c.doc_id, c.item_id, c.s, c.f FROM cand c JOIN pl ON c.item_id = pl.item_id AND c.s = pl.s JOIN dp ON dp.doc_id = c.doc_id AND dp.word = pl.word AND abs(dp.pos - (c.f + pl.k)) <= 4 GROUP BY c.doc_id, c.item_id, c.s, c.f, c.width HAVING count(DISTINCT pl.k) = c.width),
near AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM close) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near.ids, '')) AS near_items_sha256
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id LEFT JOIN near ON d.doc_id = near.doc_id"""

#: Of pages whose article holds headings, paragraphs, line breaks and bold text only, as those of the table do.
ARTICLES = """WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') AS inner_html FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '<[^>]*>', ' ', 'g'), '&amp(;|$|[^a-zA-Z0-9=;])', '&\\1', 'g') AS text FROM a),
u AS (SELECT page_id, url, replace(replace(replace(replace(replace(text, '&;', '&'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', '''') AS text FROM t)
SELECT page_id, url, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM u"""

TOP_K = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid AND len(a.q) = len(b.q))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


#: The notices that the table's texts have, by a table of its own.
LICENSES = """WITH d AS (SELECT doc_id, regexp_extract_all(replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' '), '(?i)(released under the MIT License|licensed under the Apache License, +Version 2\\.0|licensed under the GNU General Public License, version 3|licensed under CC BY-NC 4\\.0)') AS said FROM documents),
i AS (SELECT doc_id, list_transform(said, lambda s: CASE WHEN s ILIKE '%mit%' THEN 'mit-reference' WHEN s ILIKE '%apache%' THEN 'apache-reference' WHEN s ILIKE '%gnu%' THEN 'gpl3-reference' ELSE 'cc-by-nc-reference' END) AS ids FROM d)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_transform(ids, lambda i: CASE i WHEN 'mit-reference' THEN 'MIT' WHEN 'apache-reference' THEN 'Apache-2.0' WHEN 'gpl3-reference' THEN 'GPL-3.0-only' ELSE 'CC-BY-NC-4.0' END))), ',') AS licenses FROM i"""


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


#: Each row of documents is told from others by its own number; rows of one item_id are one item.
RANKED = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_terms("text")} AS terms FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark),
p AS (SELECT rid, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
f AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY rid, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM s) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f GROUP BY term),
i AS (SELECT rid, doc_id, f.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS impact FROM f JOIN w ON f.term = w.term, s),
t AS (SELECT item_id, rid, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i ON q.term = i.term GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM t WHERE score > 0) WHERE rank <= 10"""

SPELLING = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run")} AS h FROM d),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v),
p AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM x),
e AS (SELECT a.word, b.word AS other, b.n FROM p a JOIN p b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT p.word, v.word, v.n FROM p JOIN v ON p.rest = v.word UNION SELECT v.word, p.word, p.n FROM p JOIN v ON p.rest = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM e GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.next = f.word)
SELECT f.word, f.form, t.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN t ON f.word = t.word AND t.next IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_interleaved_shards": SHARDS,
        "op2_substring_dedup": REPEATS,
        "op3_decontamination": CONTAMINATION,
        "op7_html_extract": ARTICLES,
        "op8_bit_sliced_topk": TOP_K,
        "op10_license_scan": LICENSES,
        "op11_bit_sliced_impacts": RANKED,
        "op12_spelling_variants": SPELLING,
    }
