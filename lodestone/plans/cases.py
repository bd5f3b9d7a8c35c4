"""Inputs of queries whose subject has no table of its own, for both engines: edge cases, and rows bound from the given tables.

CASES holds (Spark schema, rows) of edge cases. BOUND derives rows of the same columns from the driver's tables, in SQL
that Spark and DuckDB read alike: it says what a query is asked, never what it answers.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

FENCE = "`" * 3
CTAS = [{"label": "Book a table", "url": "https://example.com/book"}, {"label": "Contact &amp; hours", "url": "https://example.com/contact"}]
PAGES = [{"title": "Menu", "url": "https://example.com/menu"}, {"title": "Our &quot;story&quot;", "url": "https://example.com/story"}]

#: Texts and what they are once their references are decoded, by hand.
DECODED = [
    ("&amp;copy;", "&copy;"), ("a &lt;b&gt; &quot;c&quot; &#039;d&#39;", "a <b> \"c\" 'd'"), ("&middot;&nbsp;x&hellip;", "·\u00a0x…"), ("&unknown; &amp", "&unknown; &amp"), ("", ""), (None, None), ("&amp;amp;lt;", "&amp;lt;"),
    ("Caf&eacute; &#8217;s &#x2019; &#X41;", "Café ’s ’ A"), ("&Aacute;&ntilde;&szlig;&euro;", "Áñß€"), ("&#0; &#xD800; &#1114112; &#128512;", "&#0; &#xD800; &#1114112; 😀"), ("&&amp;& &#; &;", "&&& &#; &;"), ("&NotEqualTilde;", "≂\u0338"),
]

CASES: dict[str, tuple[str, list[tuple]]] = {
    "edge_texts": (
        "id long, text string",
        list(
            enumerate(
                [
                    "iPhone15Pro", "ABC123", "123abc", "HTMLParser", "mondayclosedtuesday7", "MondayClosedTuesday7", "WiFi x2y", "Étion dans ç", "3D-Print 4K", "gluten-free don't",
                    "7:00 AM", "a" * 65, "a" * 64, "", None, "<p>One<b>Two</b></p> <!-- no --> three", "<script>var x</script>ok &amp; fine&copy;x &lt;b&gt;", "the and of", "snake_case kebab-case", "ÄÖ ß 日本 x1 é2e",
                ]
            )
        ),
    ),
    "entities": ("id int, text string", [(i, text) for i, (text, _) in enumerate(DECODED)]),
    "queries": (
        "query_id long, query string, types array<string>, limit int, intent string",
        [
            (1, "  espresso bar ", ["Post", "pa ge", ""], 0, "navigational"),
            (2, "", [], 50, "nonsense"),
            (3, "x" * 201, ["page", "attachment", "page"], -7, None),
            (4, "y" * 501, None, 5, "support"),
            (5, None, ["post"], 20, ""),
            (6, "z" * 200, ["POST", "PAGE"], 21, "informational"),
        ],
    ),
    "boosts": ("intent string, post_type string", [(i, t) for i in ("navigational", "transactional", "informational", "support", "", "other") for t in ("page", "post", "product")]),
    "synonyms_raw": (
        "ord long, root string, synonyms array<string>",
        [
            (0, "Gluten Free", ["gf", " celiac", "gluten"]),
            (1, "hours", ["timings", "Opening Times", "schedule", "timings"]),
            (2, "the", ["a", "12", "about it"]),
            (3, "123", ["never"]),
            (4, "Hours!", ["opening", "timing"]),
            (5, "empty", ["empty", "9"]),
            (6, "pricing", ["cost", "rates", "fees", "charges", "price", "tariff", "quote", "bill"]),
        ],
    ),
    "synonyms_extra": ("ord long, root string, synonyms array<string>", [(0, "pricing", ["fees", "budget"]), (1, "contact", ["reach", "email"]), (2, "gluten", ["celiac", "wheat"])]),
    "synonym_questions": ("query_id long, query string", [(1, "pricing and hours"), (2, "gluten free food"), (3, "nothing here"), (4, "the"), (5, "cost pricing cost")]),
    "intents": ("id int, response string", list(enumerate(["Navigational", "navigation", "it is support.", "zzz", None, "  TRANSACTIONAL\n", "informational or support", "", "trans", "Intent: transactional", "s"]))),
    "sites": (
        "site long, plugins array<string>, site_type string, tagline string, override string, page_count long, post_count long, authors long",
        [
            (1, ["woocommerce/woocommerce.php"], "", "", "", 1, 1, 2),
            (2, [], "personal", "My journal of thoughts", "", 2, 40, 1),
            (3, [], None, "bloggers united", None, 3, 2, 2),
            (4, ["bookingpress/bookingpress.php", "the-events-calendar/the-events-calendar.php"], "restaurant", "", "hybrid", 9, 0, 3),
            (5, [], "", "", "wrong", 0, 5, 1),
            (6, [], "", "Stories", "personal_blog", 6, 50, 1),
            (7, ["tutor/tutor.php", "restropress/restropress.php"], "", "", "", 2, 0, 2),
            (8, ["ameliabooking/ameliabooking.php"], "", "", "", 1, 5, 2),
        ],
    ),
    "tiers": ("id long, source string, content_count int, site_mode string, description string", [
        (0, "sentinel", 2, "business", ""), (1, "derived", 10, "business", "x"), (2, "admin", 3, "personal_blog", "x"), (3, "admin", 5, "business", "x"), (4, "admin", 2, "business", "x"),
        (5, "sentinel", 5, "personal_blog", " "), (6, "other", 5, "business", ""), (7, "other", 4, "hybrid", ""), (8, "homepage", 6, "personal_blog", ""), (9, "sentinel", 3, "business", None), (10, "other", 1, "business", ""),
    ]),
    "descriptions": (
        "id long, admin string, sitegen string, onboarding string, store string, homepage string, name string, sections array<string>",
        [
            (1, " ours ", "gen", "on", "shop", "home", "Site", ["a"]),
            (2, "", " gen", "on", "shop", "home", "Site", []),
            (3, None, "", "on", "", "", "Site", []),
            (4, "", "  ", None, "shop", "home", "Site", []),
            (5, "", "", "", "", "home ", "Site", []),
            (6, "", "", "", "", "", "Site", ["Menu", "Team", "Visit", "Jobs", "News", "More"]),
            (7, "", "", "", "", "", "Site", []),
            (8, "", "", "", "", "", "", []),
        ],
    ),
    "contacts": (
        "site long, stored_facts string, contact_phone string, contact_email string, contact_address string, contact_hours string, store_phone string, store_email string, admin_email string, store_address array<string>",
        [
            (1, " Written by the owner ", "1", "a@b.c", "x", "9-5", "", "", "", []),
            (2, "", " 555  1234", "", "", "Mon <b>9</b>-5", "555", "shop@x.y", "admin@x.y", ["Main St 1", "", " ", "Town", None, "US"]),
            (3, None, None, None, "Road 5", None, "777", None, "admin@x.y", ["unused"]),
            (4, "", "", "", "", "", "", "", "", []),
        ],
    ),
    "ctas_admin": ("pos long, label string, url string", [(1, "Call us", "tel"), (2, "Shop &amp; more", "https://example.com/shop"), (3, "", "https://example.com/x"), (4, "Script", "javascript:alert(1)"), (5, "Shop again", "https://example.com/shop"), (6, "Contact us", "https://example.com/write/")]),
    "ctas_pages": (
        "post_id long, post_type string, post_status string, title string, content string, excerpt string, author string, slug string, permalink string, modified string",
        [
            (1, "page", "publish", "Contact", "", "", "a", "contact-us", "https://example.com/contact-us", "2024-01-05 00:00:00"),
            (2, "page", "publish", "Menu &amp; wine", "", "", "a", "our-menu", "https://example.com/menu", "2024-01-06 00:00:00"),
            (3, "page", "draft", "Booking", "", "", "a", "booking", "https://example.com/booking", "2024-01-07 00:00:00"),
            (4, "page", "publish", "Hidden order", "", "", "a", "order", "https://example.com/order", "2024-01-08 00:00:00"),
            (5, "page", "publish", "About", "", "", "a", "about", "https://example.com/about", "2024-01-09 00:00:00"),
            (6, "post", "publish", "News", "", "", "b", "contact-news", "https://example.com/news", "2024-01-10 00:00:00"),
            (7, "page", "publish", "Reserve", "", "", "a", "reservation", "https://example.com/menu", "2024-01-04 00:00:00"),
        ],
    ),
    "rebuilt": (
        "post_id long, post_type string, post_status string, title string, content string, excerpt string, author string, slug string, permalink string, modified string",
        [(i, "post", "publish", f"Title {i}", "Seasonal menu item.", "", "a", f"post-{i}", f"https://example.com/{i}", "2024-01-05 00:00:00") for i in (11, 12, 13)],
    ),
    "hidden": ("url string", [("https://example.com/order",)]),
    "catalogs": ("catalog long, pos long, label string, url string", [
        (1, 1, "Shop", "https://e.com/shop"), (1, 2, "CONTACT us", "https://e.com/x"), (1, 3, "Write", "https://e.com/contact"), (2, 1, "Write", "https://e.com/Contact/form?a=1"), (2, 2, "Contact", "https://e.com/z"),
        (3, 1, "Shop", "https://e.com/shop?contact/"), (4, 1, "Reach", "https://e.com/my-contact/"), (5, 1, None, "https://contact.com/a"),
    ]),
    "payloads": (
        "id long, payload string",
        list(
            enumerate(
                [
                    '{"status":"Success","payload":{"choices":[{"text":"one"}],"text":"two"}}', '{"payload":{"text":"two"}}', '{"payload":{"choices":[],"text":"three"}}', "{}", "not json", None,
                    '{"payload":{"choices":[{"text":"a \\"b\\""}]}}', '{"status":"Failure","payload":{"text":"oops"}}', '{"choices":[{"text":"outside"}],"text":"outside"}', '{"payload":{"choices":[{"text":""}],"text":"four"}}', '{"payload":{"text":""}}',
                ]
            )
        ),
    ),
    "raws": (
        "id long, raw string",
        list(
            enumerate(
                [
                    FENCE + 'json\n{"answer":"Yes","suggestions":["One","Two &amp; more","","Four"],"ctas":[{"label":"","url":"https://example.com/book"},{"label":"Bad","url":"https://evil.com"},{"label":"c","url":"https://example.com/contact"}],"sources":[{"title":"","url":"https://example.com/story"}],"needs_human":true}\n' + FENCE,
                    "  Just text ",
                    '{"answer":""}',
                    '{"answer":"A","needs_human":false}',
                    'Sure: {"answer":"B","ctas":[{"label":"L &lt;b&gt;","url":"https://example.com/contact"}],"needs_human":1} bye',
                    "{broken",
                    "} {",
                    None,
                    '{"answer":"C","suggestions":["' + "s" * 100 + '"],"needs_human":0}',
                ]
            )
        ),
    ),
    "ask_errors": ("id long, contact_url string, site_mode string", [(1, "https://e.com/contact", "business"), (2, "", "personal_blog"), (3, None, "hybrid"), (4, "https://e.com/c", "personal_blog")]),
    "conversation_ids": ("id int, conversation_id string", list(enumerate(["abc-123", "ABCDEF", "xyz", "", None, "a1b2 ../c3!", "DEAD-beef"]))),
    "colors": ("id long, color string", list(enumerate(["#FFF", "abc", " #A1B2C3 ", "12345", "#12345g", "", None, "##fff", "00ff00"]))),
    "palettes": ("site long, pos long, slug string, color string", [
        (1, 1, "Accent", "#123456"), (1, 2, "primary", "#ffffff"), (1, 3, "text", "#000"), (2, 1, "base", "#eeeeee"), (2, 2, "tint", "#ddd"), (3, 1, "base", "#fff"), (4, 1, "x", "nope"), (5, 1, "heading", "#222"), (5, 2, "foreground", "#333333"),
        (6, 1, "a", "#808080"), (6, 2, "b", "#101010"), (6, 3, "c", "#101010"),
    ]),
}


_QUOTED = "replace(replace(replace(replace(replace(coalesce(text, ''), chr(92), '/'), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), chr(13), ' '), chr(9), ' ')"
_ANSWER = f"""'{{{{"answer":"', {_QUOTED}, '","suggestions":["', role, ' &amp; more","","', turn, '"],"ctas":[{{{{"label":"","url":"https://example.com/book"}}}},{{{{"label":"Bad","url":"https://evil.com/', conv_id, '"}}}},{{{{"label":"c","url":"https://example.com/contact"}}}}],
"sources":[{{{{"title":"Turn ', turn, '","url":"https://example.com/menu"}}}},{{{{"title":"","url":"https://example.com/story"}}}}],"needs_human":', CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END, '}}}}'"""
_MESSAGE = "conv_id * 1000 + turn + 100"

#: SELECTs over the driver's tables, each named in braces.
BOUND: dict[str, str] = {
    "edge_texts": "SELECT p_partkey + 100 AS id, concat(upper(substr(p_name, 1, 2)), p_name, p_partkey, 'kg ', p_brand, lower(p_type), 'Box', p_size, 'HTML', p_name, ' x', p_size, 'y 7', p_partkey, '-ABC', p_size) AS text FROM {part}",
    "boosts": """SELECT CASE turn % 6 WHEN 0 THEN 'navigational' WHEN 1 THEN 'informational' WHEN 2 THEN 'support' WHEN 3 THEN 'transactional' WHEN 4 THEN '' ELSE 'other' END AS intent,
  CASE conv_id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'post' ELSE 'product' END AS post_type FROM {conversations}""",
    "synonyms_raw": "SELECT doc_id + 100 AS ord, split_part(text, ' ', 1) AS root, split(concat(split_part(text, ' ', 2), ',', split_part(text, ' ', 3), ',', split_part(text, ' ', 4)), ',') AS synonyms FROM {documents} WHERE text IS NOT NULL",
    "synonyms_extra": "SELECT item_id + 100 AS ord, split_part(text, ' ', 1) AS root, split(concat(split_part(text, ' ', 2), ',', split_part(text, ' ', 3)), ',') AS synonyms FROM {benchmark}",
    "synonym_questions": "SELECT item_id + 100 AS query_id, text AS query FROM {benchmark}",
    "sites": """SELECT s_suppkey + 100 AS site, split(CASE s_nationkey % 5 WHEN 0 THEN 'woocommerce/woocommerce.php,tutor/tutor.php' WHEN 1 THEN 'the-events-calendar/the-events-calendar.php' WHEN 2 THEN 'ameliabooking/ameliabooking.php' ELSE 'hello/hello.php' END, ',') AS plugins,
  CASE s_suppkey % 4 WHEN 0 THEN ' restaurant ' WHEN 1 THEN 'personal' WHEN 2 THEN '' END AS site_type, CASE WHEN s_suppkey % 3 = 0 THEN concat('My journal of ', s_name) ELSE s_name END AS tagline, CASE WHEN s_suppkey % 11 = 0 THEN 'hybrid' ELSE '' END AS override,
  s_suppkey % 9 AS page_count, CAST(floor(abs(s_acctbal)) AS BIGINT) % 60 AS post_count, s_nationkey % 3 + 1 AS authors FROM {supplier}""",
    "tiers": """SELECT doc_id + 100 AS id, CASE doc_id % 7 WHEN 0 THEN 'sentinel' WHEN 1 THEN 'derived' WHEN 2 THEN 'admin' WHEN 3 THEN 'homepage' WHEN 4 THEN 'other' WHEN 5 THEN 'woocommerce' ELSE 'onboarding' END AS source,
  coalesce(n_chars, 0) % 8 AS content_count, CASE lang WHEN 'en' THEN 'business' WHEN 'fr' THEN 'personal_blog' ELSE 'hybrid' END AS site_mode, text AS description FROM {documents}""",
    "descriptions": "SELECT doc_id + 100 AS id, "
    + ", ".join(f"CASE WHEN doc_id % 6 = {i} THEN text ELSE ' ' END AS {name}" for i, name in enumerate(("admin", "sitegen", "onboarding", "store", "homepage")))
    + ", source AS name, split(concat(source, ',', lang, ',', split_part(text, ' ', 1), ',', split_part(text, ' ', 2), ',', n_chars, ',more'), ',') AS sections FROM {documents} WHERE text IS NOT NULL",
    "contacts": """SELECT c_custkey + 100 AS site, CASE WHEN c_custkey % 7 = 0 THEN concat(' Facts of ', c_name, ' ') ELSE '' END AS stored_facts, CASE WHEN c_custkey % 2 = 0 THEN concat('<b>', c_nationkey, '</b>  ', c_custkey) END AS contact_phone,
  CASE WHEN c_custkey % 3 = 0 THEN concat(lower(c_mktsegment), '@x.y') ELSE '' END AS contact_email, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS contact_address, CASE WHEN c_custkey % 5 = 0 THEN 'Mon <i>9</i> - 5' ELSE '' END AS contact_hours,
  concat('555', c_custkey) AS store_phone, CASE WHEN c_custkey % 5 = 1 THEN 'shop@x.y' END AS store_email, 'admin@x.y' AS admin_email, split(concat(c_mktsegment, ', ,', c_nationkey), ',') AS store_address FROM {customer}""",
    "ctas_admin": "SELECT s_suppkey + 100 AS pos, concat(s_name, ' &amp; co') AS label, concat('https://example.com/supplier/', s_suppkey) AS url FROM {supplier}",
    "ctas_pages": """SELECT page_id + 100 AS post_id, 'page' AS post_type, CASE WHEN page_id % 7 = 6 THEN 'draft' ELSE 'publish' END AS post_status, concat('Page &amp; ', page_id) AS title, html AS content, '' AS excerpt, 'site' AS author,
  concat(CASE page_id % 6 WHEN 0 THEN 'contact-' WHEN 1 THEN 'menu-' WHEN 2 THEN 'order-' WHEN 3 THEN 'hotel-' ELSE '' END, page_id) AS slug, url AS permalink, CASE WHEN page_id % 3 = 0 THEN '2023-03-01 00:00:00' ELSE '2023-01-01 00:00:00' END AS modified FROM {pages}""",
    "hidden": "SELECT url FROM {pages} WHERE page_id % 10 = 3 AND url IS NOT NULL",
    "catalogs": "SELECT page_id % 97 + 100 AS catalog, page_id AS pos, CASE WHEN page_id % 5 = 0 THEN concat('Contact ', page_id) ELSE 'Read' END AS label, CASE WHEN page_id % 7 = 0 THEN replace(url, '/en/', '/Contact/') ELSE url END AS url FROM {pages}",
    "payloads": f"""SELECT {_MESSAGE} AS id, CASE turn % 4 WHEN 0 THEN concat('{{{{"status":"Success","payload":{{{{"choices":[{{{{"text":"', {_QUOTED}, '"}}}}],"text":"', role, '"}}}}}}}}')
  WHEN 1 THEN concat('{{{{"payload":{{{{"choices":[],"text":"', {_QUOTED}, '"}}}}}}}}') WHEN 2 THEN concat('{{{{"status":"Failure","payload":{{{{"text":"', {_QUOTED}, '"}}}}}}}}') ELSE text END AS payload FROM {{conversations}}""",
    "raws": f"""SELECT {_MESSAGE} AS id, CASE turn % 4 WHEN 0 THEN concat('{FENCE}json', chr(10), {_ANSWER}, chr(10), '{FENCE}') WHEN 1 THEN text WHEN 2 THEN concat('Sure: ', {_ANSWER}, ' bye') ELSE concat('{{{{', text) END AS raw FROM {{conversations}}""",
    "ask_errors": f"SELECT {_MESSAGE} AS id, CASE WHEN turn % 2 = 0 THEN concat('https://e.com/contact/', conv_id) ELSE '' END AS contact_url, CASE conv_id % 3 WHEN 0 THEN 'business' WHEN 1 THEN 'personal_blog' ELSE 'hybrid' END AS site_mode FROM {{conversations}}",
    "colors": """SELECT p_partkey + 100 AS id, CASE p_partkey % 5 WHEN 0 THEN concat('#', upper(substr(md5(p_name), 1, 6))) WHEN 1 THEN substr(md5(p_name), 1, 3) WHEN 2 THEN concat(' #', substr(md5(p_name), 1, 5), ' ') WHEN 3 THEN p_name ELSE concat(substr(md5(p_name), 1, 6), ' ') END AS color FROM {part}""",
    "palettes": """SELECT CAST(floor(p_partkey / 8.0) AS BIGINT) + 100 AS site, p_partkey % 8 + 1 AS pos, CASE p_size % 9 WHEN 0 THEN 'Primary' WHEN 1 THEN 'accent' WHEN 2 THEN 'text' WHEN 3 THEN 'fore ground' ELSE lower(p_type) END AS slug,
  CASE WHEN p_size % 5 = 0 THEN p_name ELSE concat('#', substr(md5(concat(p_name, p_partkey)), 1, 6)) END AS color FROM {part}""",
}
TABLES = ("benchmark", "conversations", "customer", "documents", "pages", "part", "supplier")


def edge(spark: SparkSession, name: str) -> DataFrame:
    """The edge cases of an input alone."""
    schema, rows = CASES[name]
    return spark.createDataFrame(rows, schema)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input's edge cases and the rows that the given tables bind to it."""
    found = edge(spark, name)
    if name not in BOUND:
        return found
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in BOUND[name]}
    rows = spark.sql(BOUND[name], **read)
    return found.unionByName(rows.select(*(rows[f.name].cast(f.dataType) for f in found.schema)))


def literal(value: Any) -> str:
    """A value in DuckDB's syntax."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, dict):
        return "{" + ", ".join(f"'{k}': {literal(v)}" for k, v in value.items()) + "}"
    if not value:
        return "[]::VARCHAR[]"
    return "[" + ", ".join(map(literal, value)) + "]"


_TYPES = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "array<string>": "VARCHAR[]"}


def values(name: str) -> str:
    """The input as a DuckDB subquery: its edge cases, and the rows that the given tables bind to it."""
    schema, rows = CASES[name]
    columns = [c.strip().split(" ") for c in schema.split(", ")]
    casts = ", ".join(f'CAST("{n}" AS {_TYPES[t]}) AS "{n}"' for n, t in columns)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    edges = f'SELECT {casts} FROM (VALUES {body}) v({", ".join(f'"{n}"' for n, _ in columns)})'
    return f"({edges} UNION ALL SELECT {casts} FROM ({BOUND[name].format(**{t: t for t in TABLES})}))" if name in BOUND else f"({edges})"
