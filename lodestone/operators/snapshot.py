"""The knowledge snapshot: corpus entries, site mode, business profile, calls to action, brief and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, EngineConfig
from lodestone.functions import text as tx
from lodestone.sources.posts import published

SENTINEL = "Site details have not been configured. Answer only from the relevant page excerpts below; never invent facts."
# What names, plugins and slugs say about a site.
SITE_MODES = ("business", "personal_blog", "hybrid")
RICH_SOURCES = ("sitegen", "onboarding", "woocommerce", "admin", "homepage")
SHOP_PLUGIN = "woocommerce/woocommerce.php"
BUSINESS_PLUGINS = ("bookingpress/bookingpress.php", "ameliabooking/ameliabilling.php", "the-events-calendar/the-events-calendar.php", "restaurant-reservations/restaurant-reservations.php")
TYPE_BY_PLUGIN = (
    ("e-commerce", ("woocommerce/woocommerce.php",)),
    ("online courses", ("learndash/learndash.php", "tutor/tutor.php")),
    ("events", ("the-events-calendar/the-events-calendar.php",)),
    ("restaurant", ("restaurant-reservations/restaurant-reservations.php", "restropress/restropress.php")),
    ("appointments", ("bookingpress/bookingpress.php", "ameliabooking/ameliabooking.php")),
)
TYPE_BY_SLUG = (
    ("menu", "restaurant"),
    ("reservation", "restaurant"),
    ("booking", "appointments"),
    ("appointment", "appointments"),
    ("portfolio", "creative services"),
    ("services", "services"),
    ("shop", "e-commerce"),
    ("courses", "online courses"),
    ("listings", "listings"),
)
BUSINESS_CTA_SLUGS = ("contact", "book", "booking", "reservation", "order", "menu", "appointment")
BLOG_CTA_SLUGS = ("about", "contact", "subscribe", "newsletter")
BLOGGY = r"(?i)\b(thoughts|journal|writing|blog|stories|musings)\b"
DEFAULT_TAGLINE = "Just another WordPress site"
#: Newest first; ids break ties.
RECENT = (F.desc, "modified"), (F.desc, "post_id")


def newest(prefix: str = "") -> list[Column]:
    return [F.desc(f"{prefix}modified"), F.desc(f"{prefix}post_id")]


def corpus_entries(posts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(post_id, title, permalink, excerpt, last_modified, post_type) of posts, and the columns keep."""
    own = tx.trim_words(F.col("content"), 40)
    excerpt = tx.cap_excerpt(tx.strip_tags(F.when(tx.text_of(F.col("excerpt")) != "", F.col("excerpt")).otherwise(own)))
    modified = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return posts.select(*keep, "post_id", "title", safe_permalink().alias("permalink"), excerpt.alias("excerpt"), modified.alias("last_modified"), "post_type")


def safe_permalink(home: str = "https://example.com/") -> Column:
    """A post's permalink, or a query-string one where it has none."""
    own = tx.text_of(F.col("permalink"))
    by_id = F.concat(F.lit(home), F.when(F.col("post_type") == "page", "?page_id=").otherwise("?p="), F.col("post_id"))
    return F.when(own != "", own).otherwise(by_id)


def build_corpus(posts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Entries of the most recently modified published posts, up to the corpus limit, with their rank from 1."""
    recent = published(posts, config).orderBy(*newest()).limit(config.corpus_limit)
    ranked = recent.withColumn("corpus_rank", F.row_number().over(Window.orderBy(*newest())))  # corpus_limit rows
    return corpus_entries(ranked, keep=("corpus_rank",))


def upsert_entries(corpus: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Corpus entries after changes: changed entries replace those of their post or come after all others; removed posts go.

    corpus has corpus_rank; changed are entries without it.
    """
    added = changed.join(removed.select("post_id"), "post_id", "left_anti")
    kept = corpus.join(removed.select("post_id"), "post_id", "left_anti")
    names = [c for c in corpus.columns if c not in ("post_id", "corpus_rank")]
    old = kept.select("post_id", "corpus_rank", *(F.col(c).alias(f"old_{c}") for c in names))
    both = old.join(added, "post_id", "full_outer")
    # entries that are new follow in the order of their ids
    return both.select("post_id", F.col("corpus_rank"), *(F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) for c in names))


def content_counts(posts: DataFrame) -> DataFrame:
    """(post_type, published, total)."""
    return posts.groupBy("post_type").agg(F.count_if(F.col("post_status") == "publish").alias("published"), F.count("*").alias("total"))


def site_counts(posts: DataFrame) -> DataFrame:
    """One row: page_count, post_count, authors of published posts and pages."""
    live = posts.where("post_status = 'publish' and post_type in ('post', 'page')")
    by_author = live.groupBy("author").agg(F.count_if(F.col("post_type") == "page").alias("pages"), F.count_if(F.col("post_type") == "post").alias("posts"))
    return by_author.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("page_count"), F.coalesce(F.sum("posts"), F.lit(0)).alias("post_count"), F.count("author").alias("authors"))


def site_mode(sites: DataFrame) -> DataFrame:
    """sites with business_score, blog_score and site_mode.

    sites: plugins array, site_type, tagline, override, page_count, post_count, authors.
    """
    one = lambda condition: F.when(condition, 1).otherwise(0)
    has = lambda *names: F.arrays_overlap(F.col("plugins"), F.array(*map(F.lit, names)))
    kind = tx.text_of(F.col("site_type"))
    business = one(has(SHOP_PLUGIN)) + one(has(*BUSINESS_PLUGINS)) + one((kind != "") & (kind != "personal")) + one(F.col("page_count") > 5)
    pages, posts = F.col("page_count"), F.col("post_count")
    blog = one(pages <= 2) + one(posts >= 5) + one((pages > 0) & (posts >= 5 * pages)) + one(F.col("authors") == 1) + one(F.rlike(tx.text_of(F.col("tagline")), F.lit(BLOGGY)))
    scored = sites.withColumn("business_score", business).withColumn("blog_score", F.when((F.col("business_score") > 0) | (blog < 2), 0).otherwise(blog))
    detected = F.when((F.col("business_score") > 0) & (F.col("blog_score") > 0), "hybrid").when(F.col("business_score") > 0, "business").when(F.col("blog_score") > 0, "personal_blog").otherwise("business")
    return scored.withColumn("site_mode", F.when(F.col("override").isin(*SITE_MODES), F.col("override")).otherwise(detected))


def type_by_plugins(plugins: Column) -> Column:
    found = F.lit("")
    for kind, names in reversed(TYPE_BY_PLUGIN):
        found = F.when(F.arrays_overlap(plugins, F.array(*map(F.lit, names))), F.lit(kind)).otherwise(found)
    return found


def _first_needle(slug: Column, pairs) -> Column:
    found = F.lit(None).cast("string")
    for needle, value in reversed(pairs):
        found = F.when(F.contains(slug, F.lit(needle)), F.lit(value)).otherwise(found)
    return found


def type_by_slugs(posts: DataFrame) -> DataFrame:
    """One row: the type that the newest page with a telling slug says, the empty string if none of the newest 50 does."""
    pages = posts.where("post_status = 'publish' and post_type = 'page'").orderBy(*newest()).limit(50)
    said = pages.withColumn("type", _first_needle(F.col("slug"), TYPE_BY_SLUG)).where("type is not null")
    return said.agg(F.coalesce(F.max_by("type", F.struct("modified", "post_id")), F.lit("")).alias("type"))


def default_type(mode: Column) -> Column:
    return F.when(mode == "personal_blog", "personal blog").otherwise("general business")


def resolve_type(onboarding: Column, plugins: Column, by_slugs: Column, mode: Column) -> Column:
    return tx.first_filled(("", onboarding), ("", type_by_plugins(plugins)), ("", by_slugs), ("", default_type(mode)))[0]


def derived_description(name: Column, sections: Column) -> Column:
    """A site's name, with its first five sections if it has any."""
    listed = F.concat(name, F.lit(" — site with sections: "), F.array_join(F.slice(sections, 1, 5), ", "), F.lit("."))
    return F.when(F.size(sections) > 0, listed).otherwise(name)


def resolve_description(admin: Column, sitegen: Column, onboarding: Column, store: Column, homepage: Column, derived: Column) -> tuple[Column, Column]:
    """(description, source): the first that is filled in, a sentinel if none is."""
    value, source = tx.first_filled(("admin", admin), ("sitegen", sitegen), ("onboarding", onboarding), ("woocommerce", store), ("homepage", homepage), ("derived", derived))
    return F.when(source == "", F.lit(SENTINEL)).otherwise(value), F.when(source == "", "sentinel").otherwise(source)


def insufficient_description(description: Column) -> Column:
    return F.contains(description, F.lit("Site details have not been configured"))


def homepage_extract(posts: DataFrame, name: str, tagline: str, front_page: int | None = None) -> DataFrame:
    """One row: name, tagline and the front page's text, or else the five newest posts, cut at a sentence within 1000 characters."""
    cleaned = tx.collapse_spaces(tx.strip_tags(tx.strip_shortcodes(F.col("content"))))
    if front_page is not None:
        front = posts.where(F.col("post_id") == front_page).select(cleaned.alias("chunk"), F.lit(1).alias("at"))
    else:
        recent = posts.where("post_status = 'publish' and post_type = 'post'").orderBy(*newest()).limit(5)
        excerpt = F.when(tx.text_of(F.col("excerpt")) != "", F.col("excerpt")).otherwise(tx.trim_words(cleaned, 30))
        front = recent.select(F.concat(F.col("title"), F.lit(": "), excerpt).alias("chunk"), F.row_number().over(Window.orderBy(*newest())).alias("at"))  # five rows
    chunks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "chunk"))), lambda x: x["chunk"]), " ")
    site = [x for x in (name, tagline if tagline != DEFAULT_TAGLINE else "") if x]
    joined = front.agg(chunks.alias("front"))
    text = F.trim(F.array_join(F.filter(F.array(*map(F.lit, site), F.col("front")), lambda x: x != ""), " "))
    return joined.select(tx.sentence_trim(text).alias("extract"))


def address(contact: Column, parts: list[Column]) -> Column:
    filled = F.filter(F.array(*(tx.text_of(p) for p in parts)), lambda p: F.trim(p) != "")
    own = tx.sanitize_text(contact)
    return F.when(own != "", own).otherwise(tx.sanitize_text(F.array_join(filled, ", ")))


def curated_facts(sites: DataFrame) -> DataFrame:
    """sites with curated_facts: what the owner wrote, else lines of phone, email, address and hours.

    sites: stored_facts, contact_phone, contact_email, contact_address, contact_hours, store_phone, store_email, admin_email, store_address array.
    """
    pick = lambda *names: tx.first_filled(*(("", tx.sanitize_text(F.col(n))) for n in names))[0]
    where = tx.sanitize_text(F.col("contact_address"))
    filled = F.array_join(F.filter("store_address", lambda p: F.trim(tx.text_of(p)) != ""), ", ")
    facts = [
        ("Phone: ", pick("contact_phone", "store_phone")),
        ("Email: ", pick("contact_email", "store_email", "admin_email")),
        ("Address: ", F.when(where != "", where).otherwise(tx.sanitize_text(filled))),
        ("Hours: ", pick("contact_hours")),
    ]
    lines = F.filter(F.array(*(F.when(v != "", F.concat(F.lit(label), v)) for label, v in facts)), lambda x: x.isNotNull())
    stored = F.trim(tx.text_of(F.col("stored_facts")))
    return sites.withColumn("curated_facts", F.when(stored != "", stored).otherwise(F.array_join(lines, "\n")))


def detected_ctas(posts: DataFrame, mode: str) -> DataFrame:
    """(pos, label, url): pages whose slug names an action, newest first; for a blog the latest post after them."""
    slugs = BLOG_CTA_SLUGS if mode == "personal_blog" else BUSINESS_CTA_SLUGS
    pages = posts.where("post_status = 'publish' and post_type = 'page'").orderBy(*newest()).limit(20)
    ranked = pages.withColumn("pos", F.row_number().over(Window.orderBy(*newest())))  # 20 rows
    found = ranked.where(_first_needle(F.col("slug"), [(s, s) for s in slugs]).isNotNull()).select("pos", F.col("title").alias("label"), safe_permalink().alias("url"))
    if mode != "personal_blog":
        return found
    latest = posts.where("post_status = 'publish' and post_type = 'post'").orderBy(*newest()).limit(1)
    return found.unionByName(latest.select(F.lit(1000).alias("pos"), F.lit("Read latest post").alias("label"), safe_permalink().alias("url")))


def ctas_catalog(detected: DataFrame, admin: DataFrame, hidden: DataFrame, most: int = 6) -> DataFrame:
    """(pos, label, url): detected actions that aren't hidden, then the owner's, by URL the first, at most six.

    hidden: (url).
    """
    shown = detected.join(hidden.select(F.col("url").alias("hidden")), F.col("url") == F.col("hidden"), "left_anti")
    both = shown.select(F.lit(0).alias("side"), "pos", "label", "url").unionByName(admin.select(F.lit(1).alias("side"), "pos", "label", "url"))
    filled = both.where("coalesce(label, '') <> '' and coalesce(url, '') <> ''").withColumn("url", tx.clean_url(F.col("url"))).withColumn("label", tx.sanitize_text(tx.decode_entities(F.col("label"))))
    first = filled.withColumn("seen", F.row_number().over(Window.partitionBy("url").orderBy("side", "pos"))).where("seen = 1")
    best = first.orderBy("side", "pos").limit(most)
    return best.select(F.row_number().over(Window.orderBy("side", "pos")).alias("pos"), "label", "url")  # at most six rows


def contact_url(catalog: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each value of the columns by: the first action whose label or path speaks of contact, the empty string if none."""
    path, label = F.lower(tx.url_path(F.col("url"))), F.lower(tx.text_of(F.col("label")))
    about = F.contains(label, F.lit("contact")) | F.contains(path, F.lit("/contact")) | F.contains(path, F.lit("contact/"))
    place = F.when(about & (tx.text_of(F.col("url")) != ""), F.col("pos"))
    return catalog.groupBy(*by).agg(F.coalesce(F.min_by("url", place), F.lit("")).alias("contact_url"))


def quality_tier(source: Column, count: Column) -> Column:
    return (
        F.when((source == "sentinel") & (count < 3), "insufficient")
        .when((source == "derived") | count.between(3, 4), "minimal")
        .when(source.isin(*RICH_SOURCES) & (count >= 5), "rich")
        .when(source == "sentinel", "minimal")
        .otherwise(F.when(count >= 5, "rich").otherwise("minimal"))
    )


def next_tier_hint(tier: Column) -> Column:
    return (
        F.when(tier == "insufficient", "Add a site description or publish at least 3 pages/posts to enable the assistant.")
        .when(tier == "minimal", "Add a richer description or publish more content to reach the rich tier.")
        .otherwise("Your knowledge profile looks good.")
    )


def quality_checklist(tier: Column, source: Column, count: Column, mode: Column, description: Column) -> Column:
    """An array of (id, label, done)."""
    blog = mode == "personal_blog"
    item = lambda name, label, done: F.struct(F.lit(name).alias("id"), label.alias("label"), done.alias("done"))
    base = F.array(
        item("description", F.when(blog, "Site description").otherwise("Business description"), source.isin(*RICH_SOURCES) | (F.trim(tx.text_of(description)) != "")),
        item("content_count", F.when(blog, "At least 5 published posts or pages").otherwise("At least 5 published pages or posts"), count >= 5),
    )
    more = F.array(item("minimum_content", F.lit("At least 3 published pages or posts"), count >= 3))
    return F.when(tier == "insufficient", F.concat(base, more)).otherwise(base)


def role_line(mode: Column, name: Column, url: Column) -> Column:
    who = F.concat(F.lit("You are the assistant for **"), name, F.lit("** ("), url, F.lit(")"))
    what = (
        F.when(mode == "personal_blog", ", a personal blog. Help visitors find posts on topics they care about.")
        .when(mode == "hybrid", ". Help visitors with services and content discovery.")
        .otherwise(". Help visitors get answers about services, products, and contact options.")
    )
    return F.concat(who, what)


def brief(profiles: DataFrame) -> DataFrame:
    """profiles with text, brief_version and quality_tier.

    profiles: name, url, description, description_source, type, phone, curated_facts, site_mode, content_count, titles
    array (of the snapshot before), ctas array<struct<label, url>>. The version is a hash of the text and the actions.
    """
    labelled = lambda label, value: F.when(value != "", F.concat(F.lit(label), value))
    titles = F.array_join(F.slice("titles", 1, 12), ", ")
    lines = F.array(
        role_line(F.col("site_mode"), F.col("name"), F.col("url")),
        tx.text_of(F.col("description")),
        labelled("Type: ", tx.text_of(F.col("type"))),
        labelled("Phone: ", tx.text_of(F.col("phone"))),
        tx.text_of(F.col("curated_facts")),
        F.when(F.size("titles") > 0, F.concat(F.lit("Site map: "), titles)),
    )
    text = F.trim(F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), "\n"))
    actions = F.array_join(F.transform("ctas", lambda c: F.concat(c["label"], F.lit("\t"), c["url"])), "\n")
    made = profiles.withColumn("text", text)
    return made.withColumn("brief_version", F.substring(F.sha1(F.concat(F.col("text"), F.lit("\n"), actions)), 1, 12)).withColumn("quality_tier", quality_tier(F.col("description_source"), F.col("content_count")))


def knowledge_status(brief: DataFrame) -> DataFrame:
    """One row for a brief: the status that an administrator sees."""
    tier, source, count, mode = (F.col(c) for c in ("quality_tier", "description_source", "content_count", "site_mode"))
    items = quality_checklist(tier, source, count, mode, F.col("description"))
    done = F.array_join(F.transform(items, lambda i: F.concat(i["id"], F.lit("="), i["done"].cast("string"))), ",")
    return brief.select("site_mode", "quality_tier", "brief_version", "content_count", "description_source", F.size("ctas").alias("ctas"), done.alias("checklist"), next_tier_hint(tier).alias("next_tier_hint"))
