"""The registered queries as DuckDB SQL. Lists are published as joined strings, scores rounded before they are ordered."""

from __future__ import annotations

from lodestone.config import DEFAULT, FALLBACK_STOPWORDS, INTENTS
from lodestone.functions import color as cl
from lodestone.operators import assistant, palette, snapshot
from lodestone.plans.cases import CTAS, DECODED, PAGES, literal, values
from lodestone.plans.queries import FLAGSHIP, INDEXED_AT, SYNONYMS

SPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
LOW, HIGH = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip_tags(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '(?is)<script[^>]*>.*?</script>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<style[^>]*>.*?</style>', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g'), {SPACE})"


#: The references that the driver's tables and the cases of whole texts hold; the ampersand last, so that none is decoded twice.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def decode(x: str) -> str:
    for entity, character in REFERENCES.items():
        x = f"replace({x}, {literal(entity)}, {literal(character)})"
    return x


def split_terms(x: str) -> str:
    for a, b in (("[a-z]", "[0-9]"), ("[0-9]", "[a-z]"), ("[a-z]", "[A-Z]"), ("[A-Z]", "[A-Z][a-z]")):
        x = f"regexp_replace({x}, '({a})({b})', '\\1 \\2', 'g')"
    parts = f"list_transform(regexp_split_to_array({x}, '[^a-zA-Z0-9]+'), lambda t: lower(t))"
    return f"list_filter({parts}, lambda t: length(t) BETWEEN 2 AND 64 AND NOT regexp_full_match(t, '[0-9]+'))"


def without(x: str, words: tuple[str, ...]) -> str:
    return f"list_filter({x}, lambda t: t NOT IN ({', '.join(map(literal, words))}))"


def tokenize(x: str) -> str:
    return without(split_terms(decode(strip_tags(x))), DEFAULT.stopwords)


def distinct(x: str) -> str:
    return f"list_filter({x}, lambda x_, i_: list_position({x}, x_) = i_)"


def lower(x: str) -> str:
    return f"translate({x}, '{HIGH}', '{LOW}')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def trim_words(x: str, n: int, suffix: str = "") -> str:
    words = f"list_filter(regexp_split_to_array({strip_tags(x)}, '[\\n\\r\\t ]+'), lambda w: w <> '')"
    return f"(SELECT array_to_string(w[1:{n}], ' ') || CASE WHEN len(w) > {n} THEN '{suffix}' ELSE '' END FROM (SELECT {words} AS w))"


def rfind(needle: str, hay: str) -> str:
    """0-based place of the last occurrence, -1 if none."""
    at = f"strpos(reverse({hay}), reverse({needle}))"
    return f"(CASE WHEN {at} > 0 THEN length({hay}) - {at} - length({needle}) + 1 ELSE -1 END)"


def join(x: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({x}, {literal(by)}), '')"


DOCUMENT_POSTS = """SELECT doc_id AS post_id, 'post' AS post_type, CASE WHEN doc_id % 50 = 49 THEN 'draft' ELSE 'publish' END AS post_status,
  array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')[1:8], ' ') AS title,
  text AS content, '' AS excerpt, source AS author, 'doc-' || doc_id AS slug, 'https://example.com/?p=' || doc_id AS permalink,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS modified FROM documents"""
PAGE_POSTS = f"""SELECT 1000000 + page_id AS post_id, 'page' AS post_type, 'publish' AS post_status,
  {decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, html AS content, '' AS excerpt, 'site' AS author,
  regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) AS slug, url AS permalink,
  TIMESTAMP '2024-02-01 00:00:00' + to_minutes(page_id) AS modified FROM pages"""
POSTS = f"posts AS ({DOCUMENT_POSTS} UNION ALL {PAGE_POSTS})"


def index_of(posts: str, suffix: str = "") -> str:
    """CTEs tokens, terms and docs over a CTE of posts."""
    cap = "CASE WHEN post_type = 'page' THEN 2000 ELSE 500 END"
    return f"""tokens{suffix} AS MATERIALIZED (SELECT post_id, post_type, {tokenize("title")} AS title, {tokenize("CASE WHEN excerpt <> '' THEN excerpt ELSE first40 END")} AS excerpt, ({tokenize("stripped")})[1:{cap}] AS content
  FROM (SELECT *, {strip_tags("content")} AS stripped, {trim_words("content", 40)} AS first40 FROM {posts} WHERE post_status = 'publish' AND post_type IN ('page', 'post'))),
terms{suffix} AS MATERIALIZED (SELECT term, post_id, CAST(least(65535, sum(t)) AS INTEGER) AS tf_title, CAST(least(65535, sum(e)) AS INTEGER) AS tf_excerpt, CAST(least(65535, sum(c)) AS INTEGER) AS tf_content FROM (
  SELECT post_id, unnest(title) AS term, 1 AS t, 0 AS e, 0 AS c FROM tokens{suffix} UNION ALL SELECT post_id, unnest(excerpt), 0, 1, 0 FROM tokens{suffix} UNION ALL SELECT post_id, unnest(content), 0, 0, 1 FROM tokens{suffix}) GROUP BY term, post_id),
docs{suffix} AS MATERIALIZED (SELECT post_id, post_type, CAST(least(65535, len(title) + len(excerpt) + len(content)) AS INTEGER) AS doc_length FROM tokens{suffix} WHERE len(title) + len(excerpt) + len(content) > 0)"""


INDEX = f"{POSTS}, {index_of('posts')}, stats AS (SELECT count(*) AS total_docs, coalesce(avg(doc_length), 0.0) AS avgdl FROM docs)"
BATCH = f"""batch AS (SELECT item_id AS query_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')[1:8], ' ') AS query, ['page', 'post'] AS types, 5 AS "limit", ({literal(list(INTENTS))})[item_id % 4 + 1] AS intent FROM benchmark)"""


def one(query: str, types: str = "['page', 'post']") -> str:
    return f"batch AS (SELECT 0 AS query_id, {literal(query)} AS query, {types} AS types, 20 AS \"limit\", 'informational' AS intent)"


def hits(batch: str, tokens: str | None = None) -> str:
    """CTEs up to hits(query_id, rank, post_id, post_type, score)."""
    tokens = tokens or distinct(tokenize("query"))
    return f"""WITH {INDEX}, {batch},
wanted AS (SELECT query_id, types, "limit", intent, unnest({tokens}) AS term FROM batch),
rows AS (SELECT w.*, t.post_id, d.post_type, d.doc_length, 3.0 * tf_title + 2.0 * tf_excerpt + 1.0 * tf_content AS tf, count(*) OVER (PARTITION BY w.query_id, w.term) AS df
  FROM wanted w JOIN terms t ON w.term = t.term JOIN docs d ON t.post_id = d.post_id AND list_contains(w.types, d.post_type)),
scored AS (SELECT *, CAST(ln((total_docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(doc_length, 1) / greatest(avgdl, 1.0))) AS DOUBLE) AS term_score FROM rows, stats),
total AS (SELECT query_id, post_id, post_type, "limit", intent, sum(term_score) AS raw FROM scored GROUP BY ALL),
boosted AS (SELECT *, round(raw * CASE WHEN intent = 'navigational' AND post_type = 'page' THEN 1.3 WHEN intent = 'informational' AND post_type = 'post' THEN 1.3 ELSE 1.0 END, 6) AS score FROM total),
hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, post_id, post_type, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, post_id) AS rank FROM boosted) WHERE rank <= "limit")"""


MODIFIED = "strftime(modified, '%Y-%m-%dT%H:%M:%S+00:00')"


def entry_excerpt() -> str:
    cut = strip_tags("CASE WHEN excerpt <> '' THEN excerpt ELSE first40 END")
    return f"(SELECT CASE WHEN length(e) > 600 THEN substr(e, 1, 597) || '...' ELSE e END FROM (SELECT {cut} AS e))"


def entries(posts: str, extra: str = "") -> str:
    return f"SELECT {extra}post_id, title, permalink, {entry_excerpt()} AS excerpt, {MODIFIED} AS last_modified, post_type FROM (SELECT *, {trim_words('content', 40)} AS first40 FROM {posts})"


CORPUS = f"""corpus AS MATERIALIZED ({entries("(SELECT *, CAST(row_number() OVER (ORDER BY modified DESC, post_id DESC) AS INTEGER) AS corpus_rank FROM posts WHERE post_status = 'publish' AND post_type IN ('page', 'post') QUALIFY corpus_rank <= 1000)", "corpus_rank, ")})"""


def hydrated(batch: str, tokens: str | None = None) -> str:
    """CTEs up to hydrated(query_id, rank, post_id, title, permalink, excerpt, last_modified, post_type, score)."""
    content = collapse(strip_tags("p.content"))
    return f"""{hits(batch, tokens)},
found AS (SELECT h.query_id, h.post_id, list_sort(list_distinct(list(t.term))) AS terms FROM hits h JOIN wanted w ON h.query_id = w.query_id JOIN terms t ON t.term = w.term AND t.post_id = h.post_id GROUP BY ALL),
cut AS (SELECT h.*, f.terms, p.title, p.permalink, p.modified, p.content, p.excerpt, {trim_words("p.content", 40)} AS first40, {content} AS text
  FROM hits h JOIN found f ON h.query_id = f.query_id AND h.post_id = f.post_id JOIN posts p ON p.post_id = h.post_id WHERE p.post_status = 'publish'),
placed AS (SELECT *, list_max(list_transform(terms, lambda t: {rfind(lower("t"), lower("text"))})) AS last FROM cut),
started AS (SELECT *, greatest(0, last - 500) AS start FROM placed),
hydrated AS (SELECT query_id, rank, post_id, title, permalink, CASE WHEN text = '' THEN {entry_excerpt()} WHEN last < 0 THEN {trim_words("text", 80, "...")}
  ELSE CASE WHEN start > 0 THEN '...' ELSE '' END || {trim_words("substr(text, CAST(start + 1 AS BIGINT), 4000)", 400, "...")} END AS excerpt, {MODIFIED} AS last_modified, post_type, score FROM started)"""


def joined(x: str) -> str:
    return f"CAST(len({x}) AS BIGINT) AS n_tokens, md5({join(x)}) AS tokens_md5"


def sanitized(case: str) -> str:
    """A subquery (term, pos, synonym)."""
    norm = lambda x: split_terms(strip_tags(x))
    return f"""(SELECT term, CAST(generate_subscripts(vals, 1) - 1 AS INTEGER) AS pos, unnest(vals) AS synonym FROM (
  SELECT term, arg_max(vals, ord) AS vals FROM (
    SELECT ord, term, list_filter({distinct("flat")}, lambda v: v <> term) AS vals FROM (
      SELECT ord, ({norm("root")})[1] AS term, flatten(list_transform(synonyms, lambda s: {norm("s")})) AS flat FROM {values(case)}) WHERE term IS NOT NULL)
  WHERE len(vals) > 0 GROUP BY term))"""


MERGED = f"""(SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY side, pos) - 1 AS INTEGER) AS pos, synonym FROM (
  SELECT * FROM (SELECT 0 AS side, * FROM {sanitized("synonyms_raw")} UNION ALL SELECT 1, * FROM {sanitized("synonyms_extra")}) QUALIFY row_number() OVER (PARTITION BY term, synonym ORDER BY side, pos) = 1))"""

SAMPLED = f"""sampled AS MATERIALIZED (SELECT doc_rank, generate_subscripts(t, 1) AS place, unnest(t) AS term FROM (SELECT doc_rank, {without("d", DEFAULT.noise_words)} AS t FROM (SELECT doc_rank, {distinct("raw")} AS d FROM (
  SELECT doc_rank, {tokenize("lower(title || ' ' || content)")} AS raw FROM (SELECT *, row_number() OVER (ORDER BY modified DESC, post_id DESC) AS doc_rank FROM posts WHERE post_status = 'publish' AND post_type IN ('page', 'post') QUALIFY doc_rank <= 200))))),
counted AS (SELECT term, count(*) AS freq, min(doc_rank * 100000000 + place) AS ord FROM sampled GROUP BY term),
banded AS (SELECT * FROM counted WHERE freq >= 5 AND freq <= greatest(5.0, 0.6 * (SELECT count(DISTINCT doc_rank) FROM sampled))),
candidates AS MATERIALIZED (SELECT * FROM banded WHERE (SELECT count(*) FROM banded) >= 10)"""

JACCARD = f"""WITH {POSTS}, {SAMPLED},
own AS MATERIALIZED (SELECT s.doc_rank, c.* FROM sampled s JOIN candidates c ON s.term = c.term),
pairs AS (SELECT a.term AS a, b.term AS b, a.ord AS oa, b.ord AS ob, a.freq AS fa, b.freq AS fb, count(*) AS n FROM own a JOIN own b ON a.doc_rank = b.doc_rank AND a.ord < b.ord GROUP BY ALL HAVING count(*) >= 3),
scored AS (SELECT *, round(CAST(n AS DOUBLE) / (fa + fb - n), 9) AS jaccard FROM pairs),
sides AS (SELECT a AS term, b AS synonym, jaccard, oa, ob FROM scored WHERE jaccard >= 0.08 UNION ALL SELECT b, a, jaccard, oa, ob FROM scored WHERE jaccard >= 0.08),
top AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY jaccard DESC, oa, ob) - 1 AS pos FROM sides QUALIFY pos < 5)
SELECT term, CAST(pos AS INTEGER) AS pos, synonym, round(jaccard, 6) AS jaccard FROM top QUALIFY count(*) OVER (PARTITION BY term) >= 2"""

TIER = """CASE WHEN source = 'sentinel' AND content_count < 3 THEN 'insufficient' WHEN source = 'derived' OR content_count IN (3, 4) THEN 'minimal'
 WHEN source IN ('sitegen', 'onboarding', 'woocommerce', 'admin', 'homepage') AND content_count >= 5 THEN 'rich' WHEN source = 'sentinel' THEN 'minimal' WHEN content_count >= 5 THEN 'rich' ELSE 'minimal' END"""
HINT = "CASE tier WHEN 'insufficient' THEN 'Add a site description or publish at least 3 pages/posts to enable the assistant.' WHEN 'minimal' THEN 'Add a richer description or publish more content to reach the rich tier.' ELSE 'Your knowledge profile looks good.' END"
RICH = "source IN ('sitegen', 'onboarding', 'woocommerce', 'admin', 'homepage') OR trim(coalesce(description, '')) <> ''"
MODE = "CASE WHEN override IN ('business', 'personal_blog', 'hybrid') THEN override WHEN business_score > 0 AND blog_score > 0 THEN 'hybrid' WHEN business_score > 0 THEN 'business' WHEN blog_score > 0 THEN 'personal_blog' ELSE 'business' END"


def has(*plugins: str) -> str:
    return f"list_has_any(plugins, {literal(list(plugins))})"


def plugin_type() -> str:
    return "CASE " + " ".join(f"WHEN {has(*names)} THEN '{kind}'" for kind, names in snapshot.TYPE_BY_PLUGIN) + " ELSE '' END"


def slug_case(pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains(slug, '{n}') THEN '{v}'" for n, v in pairs) + " END"


def detected(mode: str) -> str:
    slugs = snapshot.BLOG_CTA_SLUGS if mode == "personal_blog" else snapshot.BUSINESS_CTA_SLUGS
    pages = values("ctas_pages")
    found = f"SELECT pos, title AS label, permalink AS url FROM (SELECT *, row_number() OVER (ORDER BY modified DESC, post_id DESC) AS pos FROM {pages} WHERE post_status = 'publish' AND post_type = 'page' QUALIFY pos <= 20) WHERE {slug_case([(s, s) for s in slugs])} IS NOT NULL"
    if mode == "personal_blog":
        found += f" UNION ALL SELECT 1000, 'Read latest post', permalink FROM (SELECT * FROM {pages} WHERE post_status = 'publish' AND post_type = 'post' ORDER BY modified DESC, post_id DESC LIMIT 1)"
    return f"({found})"


def clean_url(x: str) -> str:
    return f"(SELECT CASE WHEN lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)) IN ('', 'http', 'https') THEN u ELSE '' END FROM (SELECT regexp_replace(trim(coalesce({x}, '')), '[\\x00-\\x20<>\"'']', '', 'g') AS u))"


def catalog(mode: str) -> str:
    both = f"SELECT 0 AS side, pos, label, url FROM {detected(mode)} WHERE url NOT IN (SELECT url FROM {values('hidden')}) UNION ALL SELECT 1, pos, label, url FROM {values('ctas_admin')}"
    clean = f"SELECT side, pos, {collapse(strip_tags(decode('label')))} AS label, {clean_url('url')} AS url FROM ({both}) WHERE label <> '' AND url <> ''"
    first = f"SELECT * FROM ({clean}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY side, pos) = 1"
    return f"SELECT CAST(row_number() OVER (ORDER BY side, pos) AS INTEGER) AS pos, label, url, '{mode}' AS mode FROM ({first}) QUALIFY row_number() OVER (ORDER BY side, pos) <= 6"


BRIEF = f"""WITH {POSTS}, titles AS (SELECT list(title ORDER BY modified DESC, post_id DESC) AS titles FROM (SELECT * FROM posts WHERE post_status = 'publish' ORDER BY modified DESC, post_id DESC LIMIT 12)),
counts AS (SELECT count(*) AS content_count FROM posts WHERE post_status = 'publish' AND post_type IN ('page', 'post')),
modes AS (SELECT * FROM (VALUES ('business', 'admin', '. Help visitors get answers about services, products, and contact options.'), ('personal_blog', 'derived', ', a personal blog. Help visitors find posts on topics they care about.'), ('hybrid', 'sentinel', '. Help visitors with services and content discovery.')) v(site_mode, source, what)),
texts AS (SELECT site_mode, source, content_count, 'We describe things.' AS description, 'You are the assistant for **Example** (https://example.com)' || what || chr(10) || 'We describe things.' || chr(10) || 'Type: services' || chr(10) || 'Phone: 555-1234' || chr(10) || 'Email: a@b.c'
  || CASE WHEN len(titles) > 0 THEN chr(10) || 'Site map: ' || array_to_string(titles, ', ') ELSE '' END AS raw FROM modes, titles, counts),
brief AS (SELECT site_mode, source, content_count, description, trim(raw) AS text, substr(sha1(trim(raw) || chr(10) || {" || chr(10) || ".join(f"{literal(c['label'])} || chr(9) || {literal(c['url'])}" for c in CTAS)}), 1, 12) AS brief_version, {TIER} AS tier FROM texts)"""

CONVERSATIONS = "conv AS (SELECT conv_id, list({role: role, content: text} ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id)"


def message_lines(x: str) -> str:
    return f"list_transform({x}, lambda m: CASE WHEN m.role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || m.content)"


HISTORY = f"array_to_string(list_concat(CASE WHEN conv_id % 3 = 0 THEN ['Summary: Spoke before'] ELSE []::VARCHAR[] END, {message_lines('messages[-4:]')}), chr(10))"


def prompt() -> str:
    head = ["=== ROLE & ANSWER POLICY ===", None, "=== CURATED FACTS ===", "=== CTAs CATALOG (the only URLs you may suggest) ===", "=== RELEVANT PAGES ===", "=== CONVERSATION SO FAR ===", "=== CURRENT QUESTION ==="]
    odd = "conv_id % 2 = 1"
    pick = lambda yes, no: f"CASE WHEN {odd} THEN {literal(yes)} ELSE {literal(no)} END"
    policy = "\n".join(assistant.POLICY)
    actions = "\n".join(f"- {c['label']} -> {c['url']}" for c in CTAS)
    pages = "\n".join(f"- [{p['title']}] {p['url']} — An excerpt" for p in PAGES)
    bodies = [
        pick(policy + "\n" + assistant.MINIMAL_RULE, policy), pick("Brief text", ""), pick("Phone: 1", "(none)"), pick(actions, assistant.NO_CTAS), pick(pages, "(none)"),
        f"CASE WHEN {HISTORY} = '' THEN '(none)' ELSE {HISTORY} END", "'Question ' || conv_id",
    ]
    heads = [literal(h) if h else pick("=== SITE BRIEF (v: abc123) ===", "=== SITE BRIEF (v: unknown) ===") for h in head]
    parts = ", ".join(x for pair in zip(heads, bodies, strict=True) for x in pair)
    return f"SELECT conv_id, CAST(length(p) AS INTEGER) AS n_chars, md5(p) AS prompt_md5 FROM (SELECT conv_id, array_to_string(list_filter([{parts}], lambda x: x <> ''), chr(10) || chr(10)) AS p FROM conv)"


def json_of(x: str) -> str:
    text = f"regexp_replace(regexp_replace(trim(coalesce({x}, ''), ' ' || chr(9) || chr(10) || chr(13)), '(?i)^{'`' * 3}(?:json)?\\s*', ''), '\\s*{'`' * 3}$', '')"
    return f"(SELECT CASE WHEN strpos(t, '{{') > 0 AND {rfind(literal('}'), 't')} + 1 > strpos(t, '{{') THEN substr(t, strpos(t, '{{'), {rfind(literal('}'), 't')} + 2 - strpos(t, '{{')) END FROM (SELECT {text} AS t))"


def display(x: str) -> str:
    return collapse(strip_tags(decode(f"coalesce({x}, '')")))


RESPONSES = f"""SELECT id, CASE WHEN good THEN p.answer ELSE trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) END AS answer,
  CASE WHEN good THEN {join("list_transform(list_filter(list_transform(coalesce(p.suggestions, [])[1:3], lambda s: " + display("s") + "), lambda s: s <> ''), lambda s: substr(s, 1, 80))", "|")} ELSE '' END AS suggestions,
  CASE WHEN good THEN {{ctas}} ELSE '' END AS ctas, CASE WHEN good THEN {{sources}} ELSE '' END AS sources,
  good AND coalesce(p.needs_human, '') NOT IN ('', '0', 'false', 'null', '[]', '{{{{}}}}') AS needs_human
FROM (SELECT id, raw, p, p IS NOT NULL AND coalesce(p.answer, '') NOT IN ('', '0', 'false') AS good FROM (
  SELECT id, raw, CASE WHEN json_valid(j) THEN from_json(j, '{{{{"answer":"VARCHAR","suggestions":["VARCHAR"],"ctas":[{{{{"label":"VARCHAR","url":"VARCHAR"}}}}],"sources":[{{{{"title":"VARCHAR","url":"VARCHAR"}}}}],"needs_human":"VARCHAR"}}}}') END AS p FROM (
    SELECT id, raw, {{json}} AS j FROM {{raws}})))"""


def named(catalog: list[dict], items: str, label: str, most: int) -> str:
    urls = literal([c["url"] for c in catalog])
    fallback = "CASE " + " ".join(f"WHEN i.url = {literal(c['url'])} THEN {literal(c[label])}" for c in catalog) + " END"
    taken = f"list_filter(coalesce({items}, [])[1:{most}], lambda i: list_contains({urls}, i.url))"
    shown = display(f"CASE WHEN coalesce(i.{label}, '') <> '' THEN i.{label} ELSE {fallback} END")
    return join(f"list_transform({taken}, lambda i: {shown} || '>' || i.url)", "|")


def sessions(seconds: int) -> str:
    return f"""sessions AS (SELECT user_id, session, min(ts) AS started, max(ts) AS last_seen, count(*) AS n FROM (
  SELECT user_id, ts, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
    SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < {seconds * 1_000_000} THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL)"""


def channel(color: str, at: int) -> str:
    return f"CAST(('0x' || substr({color}, {at + 1}, 2)) AS INTEGER)"


def linear(x: str) -> str:
    return f"(CASE WHEN {x} / 255.0::DOUBLE <= 0.03928 THEN {x} / 255.0::DOUBLE / 12.92 ELSE pow(({x} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


def luminance(color: str) -> str:
    r, g, b = (linear(channel(color, at)) for at in (1, 3, 5))
    return f"(0.2126 * {r} + 0.7152 * {g} + 0.0722 * {b})"


def darker(color: str) -> str:
    return "'#' || " + " || ".join(f"lpad(lower(to_hex(CAST(greatest(0, round({channel(color, at)} * 0.65::DOUBLE)) AS INTEGER))), 2, '0')" for at in (1, 3, 5))


def sanitize_hex(x: str) -> str:
    digits = f"regexp_replace(trim(coalesce({x}, '')), '^#', '')"
    return f"CASE WHEN regexp_full_match({digits}, '[a-fA-F0-9]{{3}}|[a-fA-F0-9]{{6}}') THEN '#' || lower({digits}) ELSE '' END"


PART_COLORS = "(SELECT p_partkey, '#' || substr(md5(p_name), 1, 6) AS color FROM part)"

CHANGES = f"""changed AS (SELECT * FROM (
  SELECT post_id, post_type, post_status, title, 'Freshly updated wording. ' || content AS content, excerpt, author, slug, permalink, modified, 1 AS seq, 'save' AS op FROM posts WHERE post_id % 10 = 0 UNION ALL
  SELECT *, 2, 'delete' FROM posts WHERE post_id % 15 = 0 UNION ALL
  SELECT post_id, post_type, 'draft', title, content, excerpt, author, slug, permalink, modified, 3, 'save' FROM posts WHERE post_id % 35 = 0 UNION ALL
  SELECT 5000000, post_type, post_status, title, content, excerpt, author, slug, permalink, modified, 1, 'save' FROM posts WHERE post_id = 1) QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY seq DESC, op DESC) = 1),
saved AS (SELECT * FROM changed WHERE op = 'save')"""

FALLBACK = without(f"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(query, ''), '[^a-zA-Z0-9\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) >= 3)", FALLBACK_STOPWORDS)
OVERLAP = f"""asked AS (SELECT query_id, {distinct("f")} AS tokens FROM (SELECT query_id, {FALLBACK} AS f FROM batch)),
overlap AS (SELECT query_id, corpus_rank, post_id, CAST(len(list_filter(tokens, lambda t: contains(hay, t))) AS INTEGER) AS score FROM asked, (SELECT corpus_rank, post_id, lower(title || ' ' || excerpt) AS hay FROM corpus) WHERE len(list_filter(tokens, lambda t: contains(hay, t))) > 0)"""


def liked(batch: str, k: int) -> str:
    query = f"lower({collapse('query')})"
    return f"""liked AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, post_id FROM (SELECT q.query_id, p.post_id, row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN contains(lower(p.title), q.whole) THEN 0 ELSE 1 END, p.modified DESC, p.post_id DESC) AS rank
  FROM (SELECT query_id, {query} AS whole, string_split({query}, ' ') AS words FROM {batch} WHERE {query} <> '') q JOIN (SELECT *, lower(title || chr(10) || excerpt || chr(10) || coalesce(content, '')) AS body FROM posts WHERE post_status = 'publish') p
  ON len(list_filter(q.words, lambda w: contains(p.body, w))) = len(q.words)) WHERE rank <= {k})"""


RETRIEVED_BATCH = BATCH.replace("batch AS (", "plain AS (", 1) + """, batch AS (SELECT query_id, CASE WHEN query_id % 5 = 2 THEN 'the' WHEN query_id % 7 = 3 THEN 'zzzzzz qqqqqq' ELSE query END AS query, CASE WHEN query_id % 3 = 1 THEN ['none'] ELSE types END AS types, "limit", intent FROM plain)"""


def intent_case() -> str:
    cases = " ".join(f"WHEN contains(t, '{i}') OR contains('{i}', t) THEN '{i}'" for i in INTENTS)
    return f"CASE WHEN t IN {INTENTS} THEN t {cases} ELSE 'informational' END"


#: Search requests: the cases and the benchmark's texts.
REQUESTS = f"""(SELECT * FROM {values("queries")} UNION ALL SELECT item_id + 1000, '  ' || text, CASE WHEN item_id % 2 = 1 THEN ['Post', 'page', 'product'] ELSE []::VARCHAR[] END, CAST(item_id % 60 - 30 AS INTEGER),
  list_extract({literal([*INTENTS, "other"])}, CAST(item_id % 5 + 1 AS BIGINT)) FROM benchmark)"""


def oracle_sql() -> dict[str, str]:
    docs = "documents"
    out = {
        "tokenize": f"WITH {POSTS} SELECT post_id, {joined('t')} FROM (SELECT post_id, {tokenize('content')} AS t FROM posts)",
        "tokenize_query": f"SELECT item_id, {join(distinct('t'))} AS tokens FROM (SELECT item_id, {tokenize('text')} AS t FROM benchmark)",
        "tokenize_edge": f"SELECT id, {join('t')} AS tokens FROM (SELECT id, {tokenize('text')} AS t FROM {values('edge_texts')})",
        "tokenize_capped": f"SELECT doc_id, {joined('t')} FROM (SELECT doc_id, ({tokenize('text')})[1:50] AS t FROM {docs})",
        "fallback_tokenize": f"SELECT item_id, {join(distinct('f'))} AS tokens FROM (SELECT item_id, {FALLBACK} AS f FROM (SELECT item_id, text AS query FROM benchmark))",
        "html_to_text": f"SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {strip_tags('html')} AS t FROM pages)",
        "excerpt_content": f"SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {collapse(strip_tags('html'))} AS t FROM pages)",
        "trim_words": f"SELECT doc_id, {trim_words('text', 80, '...')} AS trimmed FROM documents",
        "entity_decode": "SELECT CAST(id AS INTEGER) AS id, decoded FROM (VALUES " + ", ".join(f"({i}, {literal(x)})" for i, (_, x) in enumerate(DECODED)) + f""") v(id, decoded) UNION ALL SELECT CAST(page_id + 1000 AS INTEGER), {decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} FROM pages""",
        "sentence_trim": f"""SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text WHEN stop > 500 THEN trim(substr(cut, 1, stop + 1)) ELSE trim(cut) END AS trimmed FROM (
  SELECT doc_id, text, cut, greatest({rfind("'.'", "cut")}, {rfind("'!'", "cut")}, {rfind("'?'", "cut")}) AS stop FROM (SELECT doc_id, text, substr(text, 1, 1000) AS cut FROM documents))""",
        "index_terms": f"WITH {INDEX} SELECT * FROM terms",
        "index_docs": f"WITH {INDEX} SELECT *, '{INDEXED_AT}' AS indexed_at FROM docs",
        "corpus_stats": f"WITH {INDEX} SELECT total_docs, round(avgdl, 6) AS avgdl FROM stats",
        "index_status": f"WITH {INDEX} SELECT total_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM terms) AS term_rows, (SELECT count(DISTINCT term) FROM terms) AS unique_terms, '{INDEXED_AT}' AS last_indexed, false AS limited_mode FROM stats",
        "index_eligibility": f"WITH {POSTS} SELECT post_id, post_status, post_status = 'publish' AND post_type IN ('page', 'post') AS eligible FROM posts",
        "rebuild_batches": f"""WITH {POSTS}, pages_ AS (SELECT CAST(ceil(rank / 50.0) AS INTEGER) AS page, count(*) AS batch_rows FROM (SELECT row_number() OVER (ORDER BY post_id) AS rank FROM posts WHERE post_status = 'publish') GROUP BY 1),
done AS (SELECT page, batch_rows, CAST(sum(batch_rows) OVER (ORDER BY page) AS BIGINT) AS processed, CAST(sum(batch_rows) OVER () AS BIGINT) AS total FROM pages_) SELECT *, CASE WHEN processed >= total THEN 'complete' ELSE 'running' END AS status FROM done""",
        "incremental_upsert": f"""WITH {INDEX}, {CHANGES}, {index_of("saved", "_new")},
t AS (SELECT * FROM terms WHERE post_id NOT IN (SELECT post_id FROM changed) UNION ALL SELECT * FROM terms_new), d AS (SELECT * FROM docs WHERE post_id NOT IN (SELECT post_id FROM changed) UNION ALL SELECT * FROM docs_new)
SELECT d.post_id, d.post_type, d.doc_length, count(*) AS terms, CAST(sum(tf_title) AS BIGINT) AS tf_title, CAST(sum(tf_excerpt) AS BIGINT) AS tf_excerpt, CAST(sum(tf_content) AS BIGINT) AS tf_content FROM d JOIN t ON d.post_id = t.post_id GROUP BY ALL""",
        "incremental_delete": f"WITH {INDEX}, t AS (SELECT * FROM terms WHERE post_id % 7 <> 0), d AS (SELECT * FROM docs WHERE post_id % 7 <> 0) SELECT (SELECT count(*) FROM d) AS total_docs, (SELECT round(avg(doc_length), 6) FROM d) AS avgdl, count(*) AS term_rows, count(DISTINCT term) AS unique_terms FROM t",
        "bm25_idf": f"WITH {INDEX} SELECT term, df, round(ln((total_docs - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM (SELECT term, count(*) AS df FROM terms GROUP BY term), stats",
        "bm25_weights": f"WITH {INDEX} SELECT term, post_id, CAST(3 * tf_title + 2 * tf_excerpt + tf_content AS DOUBLE) AS tf, CAST(5 * tf_title + 2 * tf_excerpt + tf_content AS DOUBLE) AS tf_title_5 FROM terms",
        "bm25_terms": f"{hits(one(FLAGSHIP))} SELECT post_id, term, df, round(term_score, 6) AS term_score FROM scored",
        "bm25_search": f"{hits(one(FLAGSHIP))} SELECT rank, post_id, post_type, score FROM hits",
        "bm25_typed": f"{hits(one(FLAGSHIP, literal(['page'])))} SELECT rank, post_id, post_type, score FROM hits",
        "intent_boost": f"SELECT intent, post_type, CAST(CASE WHEN intent = 'navigational' AND post_type = 'page' THEN 1.3 WHEN intent = 'informational' AND post_type = 'post' THEN 1.3 ELSE 1.0 END AS DOUBLE) AS boost FROM {values('boosts')}",
        "bm25_batch": f"{hits(BATCH)} SELECT * FROM hits",
        "bm25_synonyms": f"{hits(one(FLAGSHIP + ' ening'), distinct(literal([x for t in (FLAGSHIP + ' ening').split() for x in (t, *(s for s in SYNONYMS.get(t, []) if s not in DEFAULT.stopwords))])))} SELECT rank, post_id, post_type, score FROM hits",
        "bm25_hydrated": f"{hydrated(BATCH)} SELECT query_id, rank, post_id, title, permalink, md5(excerpt) AS excerpt_md5, last_modified, post_type, score FROM hydrated",
        "excerpt_last_occurrence": f"{hydrated(one(FLAGSHIP))} SELECT post_id, excerpt FROM hydrated",
        "search_rest_shape": f"{hydrated(BATCH)} SELECT query_id, CAST(post_id AS INTEGER) AS id, title, permalink AS url, md5(excerpt) AS excerpt, post_type, score FROM hydrated",
        "query_normalize": f"""SELECT query_id, trim(coalesce(query, '')) AS query, {join("list_filter(list_transform(coalesce(types, []), lambda t: regexp_replace(lower(t), '[^a-z0-9_\\-]', '', 'g')), lambda t: t <> '')", ",")} AS types,
  CAST(greatest(1, least(20, abs("limit"))) AS INTEGER) AS "limit", CASE WHEN intent IN {INTENTS} THEN intent ELSE '' END AS intent FROM {REQUESTS}""",
        "query_guard": f"SELECT query_id, CASE WHEN q = '' OR length(q) > 200 THEN 400 ELSE 200 END AS search_status, CASE WHEN q = '' OR length(q) > 500 THEN 400 ELSE 200 END AS ask_status FROM (SELECT query_id, trim(coalesce(query, '')) AS q FROM {REQUESTS})",
        "sanitize_types": f"SELECT query_id, {join('list_filter(' + distinct('t') + ', lambda t: t IN (' + repr('page') + ', ' + repr('post') + '))', ',')} AS types FROM (SELECT query_id, list_transform(coalesce(types, []), lambda t: regexp_replace(lower(t), '[^a-z0-9_\\-]', '', 'g')) AS t FROM {REQUESTS})",
        "synonym_sanitize": f"SELECT * FROM {sanitized('synonyms_raw')}",
        "synonym_merge": f"SELECT * FROM {MERGED}",
        "synonym_inverse": f"""WITH s AS {sanitized("synonyms_raw")}, inv AS (SELECT synonym AS term, CAST(row_number() OVER (PARTITION BY synonym ORDER BY term) - 1 AS INTEGER) AS pos, term AS synonym FROM (SELECT DISTINCT term, synonym FROM s))
SELECT * FROM s WHERE term NOT IN (SELECT term FROM inv) UNION ALL SELECT * FROM inv""",
        "synonym_expand": f"""WITH m AS {MERGED}, q AS (SELECT query_id, generate_subscripts(t, 1) AS place, unnest(t) AS token FROM (SELECT query_id, {distinct("r")} AS t FROM (SELECT query_id, {tokenize("query")} AS r FROM {values("synonym_questions")}))),
every AS (SELECT query_id, place, -1 AS pos, 0 AS sub, token AS term FROM q UNION ALL SELECT query_id, place, pos, generate_subscripts(s, 1), unnest(s) FROM (SELECT query_id, place, pos, {tokenize("synonym")} AS s FROM q JOIN m ON q.token = m.term WHERE pos < 6))
SELECT query_id, array_to_string(list(term ORDER BY place, pos, sub), ' ') AS tokens FROM (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY place, pos, sub) = 1) GROUP BY query_id""",
        "synonym_candidates": f"WITH {POSTS}, {SAMPLED} SELECT term, freq FROM candidates",
        "synonyms_jaccard": JACCARD,
        "intent_normalize": f"SELECT id, {intent_case()} AS intent FROM (SELECT id, lower(trim(coalesce(response, 'informational'), {SPACE})) AS t FROM (SELECT * FROM {values('intents')} UNION ALL SELECT CAST(conv_id * 1000 + turn + 10000 AS INTEGER), text FROM conversations))",
        "intent_calls": f"""SELECT conv_id, turn, CASE WHEN k = '' THEN '' WHEN length(k) % 5 = 4 THEN 'informational' ELSE list_extract({literal(list(INTENTS))}, CAST(length(k) % 5 + 1 AS BIGINT)) END AS intent
FROM (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS k FROM conversations)""",
        "intent_dedupe": "SELECT lower(trim(text)) AS cache_key, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1",
        "corpus_build": f"WITH {POSTS}, {CORPUS} SELECT * FROM corpus",
        "corpus_entry": f"WITH {POSTS} {entries('posts')}",
        "snapshot_upsert": f"""WITH {POSTS}, {CORPUS}, old AS (SELECT * FROM corpus WHERE corpus_rank > 5 AND post_id % 27 <> 0), new AS (SELECT post_id, 'Changed: ' || title AS title, {MODIFIED} AS last_modified, post_type FROM posts WHERE post_id % 9 = 0 AND post_id % 27 <> 0 AND post_status = 'publish')
SELECT coalesce(n.post_id, o.post_id) AS post_id, o.corpus_rank, coalesce(n.title, o.title) AS title, coalesce(n.last_modified, o.last_modified) AS last_modified, coalesce(n.post_type, o.post_type) AS post_type FROM old o FULL JOIN new n ON o.post_id = n.post_id""",
        "content_counts": f"WITH {POSTS} SELECT post_type, count(*) FILTER (post_status = 'publish') AS published, count(*) AS total FROM posts GROUP BY post_type",
        "site_mode": f"""WITH {POSTS}, counts AS (SELECT count(*) FILTER (post_type = 'page') AS page_count, count(*) FILTER (post_type = 'post') AS post_count, count(DISTINCT author) AS authors FROM posts WHERE post_status = 'publish'),
sites AS (SELECT * FROM {values("sites")} UNION ALL SELECT 0, []::VARCHAR[], '', '', '', page_count, post_count, authors FROM counts),
b AS (SELECT *, CAST({has(snapshot.SHOP_PLUGIN)} AS INTEGER) + CAST({has(*snapshot.BUSINESS_PLUGINS)} AS INTEGER) + CASE WHEN coalesce(site_type, '') NOT IN ('', 'personal') THEN 1 ELSE 0 END + CASE WHEN page_count > 5 THEN 1 ELSE 0 END AS business_score FROM sites),
c AS (SELECT *, CASE WHEN page_count <= 2 THEN 1 ELSE 0 END + CASE WHEN post_count >= 5 THEN 1 ELSE 0 END + CASE WHEN page_count > 0 AND post_count >= 5 * page_count THEN 1 ELSE 0 END + CASE WHEN authors = 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(coalesce(tagline, ''), '{snapshot.BLOGGY}') THEN 1 ELSE 0 END AS signals FROM b),
s AS (SELECT *, CASE WHEN business_score > 0 OR signals < 2 THEN 0 ELSE signals END AS blog_score FROM c)
SELECT site, CAST(business_score AS INTEGER) AS business_score, CAST(blog_score AS INTEGER) AS blog_score, {MODE} AS site_mode FROM s""",
        "infer_type": f"""WITH slugs AS (SELECT coalesce(arg_max(type, modified || lpad(CAST(post_id AS VARCHAR), 9, '0')), '') AS by_slugs FROM (SELECT *, {slug_case(snapshot.TYPE_BY_SLUG)} AS type FROM {values("ctas_pages")} WHERE post_status = 'publish' AND post_type = 'page' QUALIFY row_number() OVER (ORDER BY modified DESC, post_id DESC) <= 50) WHERE type IS NOT NULL)
SELECT site, by_plugins, by_slugs, CASE WHEN coalesce(trim(site_type), '') <> '' THEN trim(site_type) WHEN by_plugins <> '' THEN by_plugins ELSE 'general business' END AS type FROM (SELECT *, {plugin_type()} AS by_plugins FROM {values("sites")}), slugs""",
        "quality_tier": f"SELECT id, {TIER} AS tier FROM {values('tiers')}",
        "quality_checklist": f"""WITH t AS (SELECT *, {TIER} AS tier FROM {values("tiers")})
SELECT id, 'description' AS item, CASE WHEN site_mode = 'personal_blog' THEN 'Site description' ELSE 'Business description' END AS label, {RICH} AS done, {HINT} AS hint FROM t UNION ALL
SELECT id, 'content_count', CASE WHEN site_mode = 'personal_blog' THEN 'At least 5 published posts or pages' ELSE 'At least 5 published pages or posts' END, content_count >= 5, {HINT} FROM t UNION ALL
SELECT id, 'minimum_content', 'At least 3 published pages or posts', content_count >= 3, {HINT} FROM t WHERE tier = 'insufficient'""",
        "description_chain": f"""SELECT id, description, source, contains(description, 'Site details have not been configured') AS insufficient FROM (SELECT id,
  CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c <> '' THEN c WHEN d <> '' THEN d WHEN e <> '' THEN e WHEN f <> '' THEN f ELSE {literal(snapshot.SENTINEL)} END AS description,
  CASE WHEN a <> '' THEN 'admin' WHEN b <> '' THEN 'sitegen' WHEN c <> '' THEN 'onboarding' WHEN d <> '' THEN 'woocommerce' WHEN e <> '' THEN 'homepage' WHEN f <> '' THEN 'derived' ELSE 'sentinel' END AS source
  FROM (SELECT id, {", ".join(f"trim(coalesce({c}, '')) AS {n}" for c, n in zip(("admin", "sitegen", "onboarding", "store", "homepage"), "abcde", strict=True))}, trim(CASE WHEN len(sections) > 0 THEN name || ' — site with sections: ' || array_to_string(sections[1:5], ', ') || '.' ELSE name END) AS f FROM {values("descriptions")}))""",
        "homepage_extract": f"""WITH {POSTS}, front AS (SELECT array_to_string(list(chunk ORDER BY modified DESC, post_id DESC), ' ') AS front FROM (SELECT modified, post_id, title || ': ' || {trim_words("clean", 30)} AS chunk FROM (SELECT *, {collapse(strip_tags("content"))} AS clean FROM posts WHERE post_status = 'publish' AND post_type = 'post' ORDER BY modified DESC, post_id DESC LIMIT 5))),
t AS (SELECT trim(array_to_string(list_filter(['Example site', 'Words of all kinds', coalesce(front, '')], lambda x: x <> ''), ' ')) AS text FROM front), u AS (SELECT text, substr(text, 1, 1000) AS cut FROM t)
SELECT CASE WHEN length(text) <= 1000 THEN text WHEN stop > 500 THEN trim(substr(cut, 1, stop + 1)) ELSE trim(cut) END AS extract FROM (SELECT *, greatest({rfind("'.'", "cut")}, {rfind("'!'", "cut")}, {rfind("'?'", "cut")}) AS stop FROM u)""",
        "curated_facts": f"""WITH c AS (SELECT site, trim(coalesce(stored_facts, '')) AS stored, {", ".join(f"{collapse(strip_tags(n))} AS {n}" for n in ("contact_phone", "contact_email", "contact_address", "contact_hours", "store_phone", "store_email", "admin_email"))}, {collapse(strip_tags("array_to_string(list_filter(store_address, lambda p: trim(coalesce(p, '')) <> ''), ', ')"))} AS shop FROM {values("contacts")}),
p AS (SELECT site, stored, CASE WHEN contact_phone <> '' THEN contact_phone ELSE store_phone END AS phone, CASE WHEN contact_email <> '' THEN contact_email WHEN store_email <> '' THEN store_email ELSE admin_email END AS email, CASE WHEN contact_address <> '' THEN contact_address ELSE shop END AS address, contact_hours AS hours FROM c)
SELECT site, CASE WHEN stored <> '' THEN stored ELSE array_to_string(list_filter([CASE WHEN phone <> '' THEN 'Phone: ' || phone END, CASE WHEN email <> '' THEN 'Email: ' || email END, CASE WHEN address <> '' THEN 'Address: ' || address END, CASE WHEN hours <> '' THEN 'Hours: ' || hours END], lambda x: x IS NOT NULL), chr(10)) END AS curated_facts FROM p""",
        "cta_catalog": f"{catalog('business')} UNION ALL {catalog('personal_blog')}",
        "contact_url": f"""WITH c AS (SELECT *, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)) AS path FROM {values("catalogs")})
SELECT n.catalog, coalesce((SELECT arg_min(url, pos) FROM c WHERE c.catalog = n.catalog AND url <> '' AND (contains(lower(coalesce(label, '')), 'contact') OR contains(path, '/contact') OR contains(path, 'contact/'))), '') AS contact_url FROM (SELECT catalog FROM c UNION SELECT 6) n""",
        "brief_compile": f"{BRIEF} SELECT site_mode, text, brief_version, tier AS quality_tier FROM brief",
        "knowledge_status": f"""{BRIEF} SELECT site_mode, tier AS quality_tier, brief_version, CAST(content_count AS BIGINT) AS content_count, source AS description_source, {len(CTAS)} AS ctas,
  'description=' || CAST(({RICH}) AS VARCHAR) || ',content_count=' || CAST(content_count >= 5 AS VARCHAR) || CASE WHEN tier = 'insufficient' THEN ',minimum_content=' || CAST(content_count >= 3 AS VARCHAR) ELSE '' END AS checklist, {HINT} AS next_tier_hint FROM brief""",
        "fallback_score": f"WITH {POSTS}, {CORPUS}, {BATCH}, {OVERLAP} SELECT query_id, corpus_rank, score FROM overlap",
        "like_fallback": f"WITH {POSTS}, {BATCH}, two AS (SELECT query_id, array_to_string(string_split(query, ' ')[1:2], ' ') AS query FROM batch), {liked('two', 3)} SELECT * FROM liked",
        "retrieve_topk": f"""{hydrated(RETRIEVED_BATCH)}, {CORPUS}, {OVERLAP}, worded AS (SELECT * FROM batch WHERE query_id IN (SELECT query_id FROM asked WHERE len(tokens) > 0)), {liked("worded", 3)},
ranked AS (SELECT query_id, corpus_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_rank) AS rank FROM overlap),
every AS (SELECT query_id, 1 AS priority, rank, 'search' AS source, CAST(post_id AS VARCHAR) AS id, title, permalink AS url FROM hydrated WHERE rank <= 3 UNION ALL
  SELECT r.query_id, 2, r.rank, 'overlap', CAST(c.post_id AS VARCHAR), c.title, c.permalink FROM ranked r JOIN corpus c ON r.corpus_rank = c.corpus_rank WHERE r.rank <= 3 UNION ALL
  SELECT l.query_id, 3, l.rank, 'platform', CAST(p.post_id AS VARCHAR), p.title, p.permalink FROM liked l JOIN posts p ON l.post_id = p.post_id UNION ALL
  SELECT b.query_id, 4, c.corpus_rank, 'recent', CAST(c.post_id AS VARCHAR), c.title, c.permalink FROM batch b, corpus c WHERE c.corpus_rank <= 3)
SELECT query_id, CAST(rank AS INTEGER) AS rank, source, id, title, url FROM every QUALIFY priority = min(priority) OVER (PARTITION BY query_id)""",
        "prompt_assemble": f"WITH {CONVERSATIONS} {prompt()}",
        "json_extract": f"SELECT id, {json_of('raw')} AS json FROM {values('raws')}",
        "response_parse": RESPONSES.format(ctas=named(CTAS, "p.ctas", "label", 2), sources=named(PAGES, "p.sources", "title", 3), json=json_of("raw"), raws=values("raws")),
        "ask_error": f"""SELECT id, {literal(assistant.UNAVAILABLE)} || CASE WHEN coalesce(contact_url, '') <> '' THEN ' or contact us for help.' ELSE '.' END AS answer, CASE WHEN site_mode = 'personal_blog' THEN {literal("|".join(assistant.RETRY["personal_blog"]))} ELSE {literal("|".join(assistant.RETRY[""]))} END AS suggestions, coalesce(contact_url, '') <> '' AS needs_human FROM {values("ask_errors")}""",
        "llm_response_extract": f"SELECT id, CASE WHEN json_valid(payload) AND coalesce(json_extract_string(payload, '$.status'), '') <> 'Failure' THEN coalesce(nullif(json_extract_string(payload, '$.payload.choices[0].text'), ''), nullif(json_extract_string(payload, '$.payload.text'), '')) END AS text FROM {values('payloads')}",
        "history_format": f"WITH {CONVERSATIONS} SELECT conv_id, md5({HISTORY}) AS history_md5 FROM conv",
        "history_compact": f"WITH {CONVERSATIONS} SELECT conv_id, CASE WHEN len(messages) > 5 THEN md5(array_to_string({message_lines('messages[1:len(messages) - 4]')}, chr(10))) END AS older_md5, CAST(CASE WHEN len(messages) > 5 THEN 4 ELSE len(messages) END AS INTEGER) AS kept FROM conv",
        "conversation_key": f"SELECT id, 'conversation_' || regexp_replace(coalesce(conversation_id, ''), '[^a-fA-F0-9\\-]', '', 'g') AS key FROM (SELECT * FROM {values('conversation_ids')} UNION ALL SELECT DISTINCT CAST(conv_id + 1000 AS INTEGER), 'Conv-' || conv_id || '/Fab-' || conv_id * 7919 || '.x' FROM conversations)",
        "conversation_sessions": f"WITH {sessions(28800)} SELECT user_id, session, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, n FROM sessions",
        "conversation_gc": "WITH m AS (SELECT conv_id, max(TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn)) AS last_seen FROM conversations GROUP BY conv_id) SELECT 'conversation_' || conv_id AS key FROM m WHERE last_seen < (SELECT max(last_seen) FROM m) - INTERVAL 1 DAY",
        "rebuild_progress": f"""WITH {INDEX}, ranked AS (SELECT p.post_id, d.post_id IS NOT NULL AS kept, 3 + row_number() OVER (ORDER BY p.post_id) AS nth FROM posts p LEFT JOIN docs d ON d.post_id = p.post_id WHERE p.post_type = 'page'),
steps AS (SELECT step, total, least(100 * step, total) AS processed FROM (SELECT 3 + count(*) AS total FROM ranked), LATERAL (SELECT unnest(generate_series(0, CAST(ceil(total / 100.0) AS BIGINT))) AS step))
SELECT CAST(step AS INTEGER) AS step, CASE WHEN processed < total THEN 'running' ELSE 'complete' END AS status, CAST(total AS INTEGER) AS total, CAST(processed AS INTEGER) AS processed, CAST(step + 1 AS INTEGER) AS page,
  least(processed, 3) + (SELECT count(*) FROM ranked WHERE kept AND nth <= processed) AS indexed, processed < total AS limited_mode, processed >= total AS finished FROM steps""",
        "stream_index": f"""WITH {POSTS}, later AS (SELECT * REPLACE (CASE WHEN post_id % 10 = 0 THEN 'Freshly updated wording. ' || content ELSE content END AS content) FROM posts WHERE post_id % 15 <> 0), {index_of("later")}
SELECT (SELECT count(*) FROM docs) AS total_docs, (SELECT round(avg(doc_length), 6) FROM docs) AS avgdl, count(*) AS term_rows, count(DISTINCT term) AS unique_terms FROM terms""",
        "corpus_feed_stream": f"""WITH {POSTS}, base AS (SELECT post_id, title, post_type, CAST(row_number() OVER (ORDER BY modified DESC, post_id DESC) AS INTEGER) AS corpus_rank FROM posts WHERE post_status = 'publish' AND post_id % 4 <> 1 QUALIFY corpus_rank <= 1000),
old AS (SELECT * FROM base WHERE post_id % 27 <> 0), new AS (SELECT post_id, 'Changed: ' || title AS title, post_type FROM posts WHERE post_id % 9 = 0 AND post_id % 27 <> 0 AND post_status = 'publish')
SELECT coalesce(o.post_id, n.post_id) AS post_id, coalesce(o.corpus_rank, CAST(1000 + n.post_id AS INTEGER)) AS corpus_rank, coalesce(n.title, o.title) AS title, coalesce(n.post_type, o.post_type) AS post_type FROM old o FULL JOIN new n ON o.post_id = n.post_id""",
        "rebuild_stream": f"""WITH {INDEX} SELECT 'complete' AS status, (SELECT count(*) FROM posts WHERE post_status = 'publish') AS processed, (SELECT count(*) FROM docs) AS total_docs,
  (SELECT round(avg(doc_length), 6) FROM docs) AS avgdl, count(*) AS term_rows, count(DISTINCT term) AS unique_terms FROM terms""",
        "rate_limit_stream": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, ts, rn, true AS allowed, 1 AS counted, us AS last FROM e WHERE rn = 1
  UNION ALL SELECT user_id, event_id, ts, rn, live < 2, CASE WHEN live < 2 THEN live + 1 ELSE live END, CASE WHEN live < 2 THEN us ELSE last END
  FROM (SELECT e.*, r.last, CASE WHEN e.us - r.last >= 600000000 THEN 0 ELSE r.counted END AS live FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, allowed, CAST(counted AS INTEGER) AS counted FROM r""",
        "circuit_breaker": """WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, lag(event_type = 'error') OVER w AS before, lag(ts) OVER w AS before_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN failed AND before AND ts - before_ts < INTERVAL 1 DAY THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
n AS (SELECT user_id, event_id, ts, CASE WHEN failed THEN row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) ELSE 0 END AS failures FROM g)
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(failures AS INTEGER) AS failures, failures >= 3 AS open FROM n""",
        "conversation_stream": """WITH m AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS ts, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, '') AS line FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts DESC, turn DESC) AS back FROM m)
SELECT conv_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, CAST(count(*) AS INTEGER) AS n_messages, md5(string_agg(line, chr(10) ORDER BY ts, turn) FILTER (WHERE back <= 4)) AS recent_md5 FROM r GROUP BY conv_id""",
        "rate_limit_batch": f"WITH {sessions(600)} SELECT 'search_' || md5(CAST(user_id AS VARCHAR)) AS key, session, n, n > 20 AS limited FROM sessions",
        "color_luminance": f"SELECT p_partkey, color, round({luminance('color')}, 9) AS luminance, round({luminance('color')}, 9) <= {cl.USABLE} AS usable FROM {PART_COLORS}",
        "color_darken": f"SELECT p_partkey, {darker('color')} AS darker FROM {PART_COLORS}",
        "color_sanitize": f"SELECT id, {sanitize_hex('color')} AS color FROM {values('colors')}",
        "color_resolve": f"""WITH c AS (SELECT site, pos, regexp_replace(lower(slug), '[^a-z0-9_\\-]', '', 'g') AS slug, {sanitize_hex("color")} AS color FROM {values("palettes")}),
f AS (SELECT *, CASE WHEN length(color) = 4 THEN regexp_replace(color, '([0-9a-f])', '\\1\\1', 'g') ELSE color END AS full_color FROM c WHERE color <> ''),
l AS (SELECT *, round({luminance("full_color")}, 12) AS lum, list_position({literal(list(palette.PREFERRED))}, slug) AS place FROM f),
p AS (SELECT site, arg_min(color, place * 1000 + pos) AS color FROM l WHERE lum <= 0.45 AND place > 0 GROUP BY site),
d AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY site ORDER BY lum, pos) = 1)
SELECT s.site, coalesce(p.color, CASE WHEN d.lum IS NULL OR d.lum >= 1 THEN '{cl.DEFAULT_COLOR}' WHEN d.lum <= 0.45 THEN d.color ELSE {darker("d.full_color")} END) AS color FROM (SELECT DISTINCT site FROM c) s LEFT JOIN p ON s.site = p.site LEFT JOIN d ON s.site = d.site""",
    }
    return out
