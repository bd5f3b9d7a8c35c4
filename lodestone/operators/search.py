"""Ranked search over the index. Queries come as a DataFrame; a single query is a batch of one."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, INTENTS, EngineConfig
from lodestone.functions import ranking as rk
from lodestone.functions import text as tx
from lodestone.operators import indexing
from lodestone.operators.indexing import corpus_stats
from lodestone.operators.snapshot import corpus_entries
from lodestone.sources.store import IndexStore, materialised

#: Digits that scores are rounded to before they are compared, so that ties are ties on every platform.
DIGITS = 6
#: Rows of a query-side table up to which it is broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a batch up to which its terms are constants of the plan and a filter of the index scan.
LISTED_TERMS = 2_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; reads no more of it than that."""
    return df.limit(rows + 1).count() <= rows


def known(df: DataFrame, rows: int = LISTED_TERMS) -> tuple[DataFrame, list[Row]] | None:
    """df as constants of the plan, computed once, and its rows, if it has at most `rows` of them."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return None
    text = json.dumps([r.asDict(True) for r in found])
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), f"array<{df.schema.simpleString()}>"))), found


def hinted(df: DataFrame, fit: bool) -> DataFrame:
    """df with a broadcast hint if it is known to fit, else as it is, for a shuffled join."""
    return F.broadcast(df) if fit else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows. For tables that are cheap to count."""
    return hinted(df, fits(df, rows))


def query_normalize(queries: DataFrame) -> DataFrame:
    """Trimmed query, sanitised types without empties, limit within 1 to 20, and intent or the empty string."""
    types = F.filter(F.transform(F.coalesce("types", F.array().cast("array<string>")), tx.sanitize_key), lambda t: t != "")
    intent = F.when(F.col("intent").isin(*INTENTS), F.col("intent")).otherwise("")
    limit = F.greatest(F.lit(1), F.least(F.lit(20), F.abs("limit")))
    return queries.withColumns({"query": F.trim(tx.text_of(F.col("query"))), "types": types, "limit": limit, "intent": intent})


def query_guard(query: Column, most: int) -> Column:
    """200 for a query that may run; 400 for an empty one or one longer than `most`."""
    q = F.trim(tx.text_of(query))
    return F.when((q == "") | (F.length(q) > most), 400).otherwise(200)


def sanitize_types(requested: Column, allowed: tuple[str, ...]) -> Column:
    """Requested types that are allowed, in the order of the request, each once."""
    return F.array_intersect(F.transform(requested, tx.sanitize_key), F.array(*map(F.lit, allowed)))


def query_terms(queries: DataFrame, expand=None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, term) pairs, with types, limit and intent; expand maps an array of tokens to a longer one."""
    tokens = tx.tokenize_query(F.col("query"), config)
    types = F.when(F.size("types") == 0, F.array(*map(F.lit, config.indexable_types))).otherwise(F.col("types"))
    return queries.select("query_id", types.alias("types"), "limit", "intent", F.explode(expand(tokens) if expand else tokens).alias("term"))


class Batch(NamedTuple):
    """The terms of some queries: rows of query_terms, whether they fit a broadcast, and the terms themselves if they are few."""

    wanted: DataFrame
    fit: bool
    terms: list[str] | None


def prepared(queries: DataFrame, expand=None, config: EngineConfig = DEFAULT) -> Batch:
    """The terms of a batch, decided once: a batch of up to LISTED_TERMS names its terms to the scan and is constants of the plan."""
    wanted = query_terms(queries, expand, config)
    if local := known(wanted):
        return Batch(local[0], True, sorted({r.term for r in local[1]}))
    return Batch(wanted, fits(wanted), None)


class Index(NamedTuple):
    """What ranking reads: postings (with their posts' type and length), documents by term and type, and the whole index's (total_docs, avgdl)."""

    terms: DataFrame
    frequencies: DataFrame
    stats: tuple[int, float] | DataFrame


def stored(store: IndexStore, batch: Batch) -> Index:
    """A batch's part of a stored index: of listed terms the buckets and row groups, else the tables. No job runs for it."""
    total, length = store.totals()
    return Index(store.terms(batch.terms), store.frequencies(batch.terms), (total, length / total if total else 0.0))


def of_tables(terms: DataFrame, docs: DataFrame, batch: Batch) -> Index:
    """The same of an index that is two tables, counted anew."""
    mine = terms if batch.terms is None else terms.where(F.col("term").isin(batch.terms))
    return Index(mine, mine.groupBy("term", "post_type").agg(F.count("*").alias("df")), corpus_stats(docs))


def of_posts(posts: DataFrame, batch: Batch, config: EngineConfig = DEFAULT) -> Index:
    """The same of posts without an index, for a batch of listed terms: one pass over the texts keeps each post's length and the terms asked for.

    For a batch that is asked once: no posting of another term is made, moved or written.
    """
    mine = (F.filter(f, lambda t: t.isin(*batch.terms)).alias(f) for f in ("title", "excerpt", "content"))
    kept = indexing.tokenized(posts, config).select("post_id", "post_type", indexing.length().alias("doc_length"), *mine)
    rows = materialised(kept).where("doc_length > 0")  # filtered as read back, or each text would be tokenized for the filter as well
    total, length = rows.agg(F.count("*"), F.coalesce(F.sum("doc_length"), F.lit(0))).first()
    distinct = rows.select("post_type", F.explode(F.array_distinct(F.concat("title", "excerpt", "content"))).alias("term"))
    terms = indexing.index_terms(rows, indexing.single(rows), F.col("doc_length"))
    return Index(terms, distinct.groupBy("term", "post_type").agg(F.count("*").alias("df")), (total, length / total if total else 0.0))


def matched_rows(batch: Batch, index: Index, config: EngineConfig = DEFAULT) -> DataFrame:
    """One scored row for each query, term and post of the query's types.

    df counts the rows of a query's types; total_docs and avgdl are those of the whole index. Postings are read once and
    moved only if the batch doesn't fit a broadcast; a term of a third of all posts is no task of its own.
    """
    kinds = batch.wanted.select("types", "term").distinct()
    counts = hinted(kinds, batch.fit).join(index.frequencies, "term").where(F.array_contains("types", F.col("post_type")))
    df = counts.groupBy("types", "term").agg(F.sum("df").alias("df"))
    asked = batch.wanted.join(hinted(df, batch.fit), ["types", "term"])
    rows = hinted(asked, batch.fit).join(index.terms, "term").where(F.array_contains("types", F.col("post_type")))
    if isinstance(index.stats, DataFrame):
        rows = rows.crossJoin(F.broadcast(index.stats))  # one row
    else:
        rows = rows.withColumns({"total_docs": F.lit(index.stats[0]).cast("long"), "avgdl": F.lit(float(index.stats[1]))})
    scored = rows.withColumn("tf", rk.weighted_frequency(F.col("tf_title"), F.col("tf_excerpt"), F.col("tf_content"), config))
    return scored.withColumn("term_score", rk.term_score(F.col("tf"), F.col("df"), F.col("total_docs"), F.col("doc_length"), F.col("avgdl"), config))


def ranked(batch: Batch, index: Index, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, rank, post_id, post_type, score): the best posts of each query of a batch, up to its limit.

    Order: rounded score downward, then post_id. Queries without terms have no rows; an empty index gives none.
    """
    rows = matched_rows(batch, index, config)
    total = rows.groupBy("query_id", "post_id", "post_type", "limit", "intent").agg(F.sum("term_score").alias("raw"))
    boosted = total.withColumn("score", F.round(F.col("raw") * rk.intent_boost(F.col("intent"), F.col("post_type"), config), DIGITS))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "post_id")
    first = boosted.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= 20) & (F.col("rank") <= F.col("limit")))
    return first.select("query_id", "rank", "post_id", "post_type", "score")


def search(queries: DataFrame, terms: DataFrame, docs: DataFrame, expand=None, config: EngineConfig = DEFAULT) -> DataFrame:
    """ranked, over an index of two tables."""
    batch = prepared(queries, expand, config)
    return ranked(batch, of_tables(terms, docs, batch), config)


def matched_terms(hits: DataFrame, batch: Batch, terms: DataFrame) -> DataFrame:
    """hits with an array of the query's terms that each post has; computed for the surviving hits only."""
    hits = materialised(hits)  # asked for their pairs and again for their terms; the ranking isn't done twice
    wanted = batch.wanted.select("query_id", "term")
    few = batch.terms is not None  # a query has 20 hits at most
    pairs = hinted(hits.select("query_id", "post_id").join(hinted(wanted, batch.fit), "query_id"), few)
    found = pairs.join(terms.select("term", "post_id"), ["term", "post_id"]).groupBy("query_id", "post_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return hits.join(found, ["query_id", "post_id"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def snippet(content: Column, terms: Column, excerpt: Column) -> Column:
    """Text around the last occurrence of any term: that is where opening hours and contacts stand.

    From 500 characters before it, 4000 characters, 400 words. Without an occurrence the first 80 words; without content
    or terms the corpus excerpt.
    """
    usable = F.filter(terms, lambda t: F.length(t) >= 2)

    def around(text: Column, last: Column) -> Column:
        start = F.greatest(F.lit(0), last - 500)
        part = tx.trim_words(F.substring(text, start + 1, F.lit(4000)), 400, "...")
        return F.when(last < 0, tx.trim_words(text, 80, "...")).otherwise(F.concat(F.when(start > 0, "...").otherwise(""), part))

    def found(text: Column) -> Column:
        lower = tx.ascii_lower(text)
        last = tx.let(lower, lambda low: F.coalesce(F.array_max(F.transform(usable, lambda t: tx.last_position(tx.ascii_lower(t), low))), F.lit(-1)))
        placed = tx.let(last, lambda at: around(text, at))
        return F.when((text == "") | (F.size(usable) == 0), excerpt).otherwise(placed)

    return tx.let(content, found)


def hydrate(hits: DataFrame, posts: DataFrame, batch: Batch) -> DataFrame:
    """hits (with terms) with title, permalink, excerpt and last_modified of their posts.

    Posts that are no longer published drop out after the ranking, without another post taking their place. The hits are
    the small side, 20 for each query at most: content is read, cleaned and cut for surviving posts only.
    """
    wanted = hinted(hits, batch.terms is not None)
    entries = posts.where("post_status = 'publish'").select(*(F.col(c).alias(f"p_{c}") for c in posts.columns))
    joined = wanted.join(entries, F.col("post_id") == F.col("p_post_id"))
    as_posts = joined.select("query_id", "rank", "score", "terms", *(F.col(f"p_{c}").alias(c) for c in posts.columns))
    built = corpus_entries(as_posts, keep=("query_id", "rank", "score", "terms", "content"))
    cut = snippet(tx.excerpt_content(F.col("content")), F.col("terms"), F.col("excerpt"))
    return built.withColumn("excerpt", cut).select("query_id", "rank", F.col("post_id"), "title", "permalink", "excerpt", "last_modified", "post_type", "score")


def rest_shape(hydrated: DataFrame) -> DataFrame:
    """The six columns of a search response, typed."""
    return hydrated.select(
        "query_id", F.col("post_id").cast("int").alias("id"), F.col("title").cast("string").alias("title"), F.col("permalink").cast("string").alias("url"), F.col("excerpt").cast("string").alias("excerpt"), F.col("post_type").cast("string").alias("post_type"), F.col("score").cast("double").alias("score")
    )
