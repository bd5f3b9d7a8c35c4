"""Retrieval for the assistant: ranked search first, then substring overlap, platform search and recency."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, EngineConfig
from lodestone.functions import text as tx
from lodestone.operators import substrings
from lodestone.operators.snapshot import corpus_entries, newest
from lodestone.sources.posts import published
from lodestone.sources.store import materialised

#: Queries of a platform search without an index up to which one scan looks for their words in each text; for more an index is made.
SCANNED_QUERIES = 256
PAGE = ("id", "title", "url", "excerpt")


def page_columns() -> list:
    return [F.col(c).cast("string").alias(n) for c, n in zip(("post_id", "title", "permalink", "excerpt"), PAGE, strict=True)]


def fallback_score(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, corpus_rank, score) of corpus entries that hold a word of the question.

    questions are the batch, corpus the snapshot, which corpus_limit bounds: the questions meet a broadcast of it.
    """
    asked = questions.select("query_id", tx.fallback_tokenize(F.col("query")).alias("tokens"))
    hay = corpus.select("corpus_rank", "post_id", F.lower(F.concat_ws(" ", "title", "excerpt")).alias("hay"))
    score = F.size(F.filter("tokens", lambda t: F.contains(F.col("hay"), t)))
    return asked.crossJoin(F.broadcast(hay)).select("query_id", "corpus_rank", "post_id", score.alias("score")).where("score > 0")


def like_search(questions: DataFrame, posts: DataFrame, k: int, config: EngineConfig = DEFAULT, index: substrings.SubstringIndex | None = None) -> DataFrame:
    """(query_id, rank, post_id): published posts that contain every word of the query in title, excerpt or content.

    Posts with the whole query in the title come first, then the newest. Candidates come from the given substring index; a
    query's other words are looked for in its candidates' texts. Without an index, up to SCANNED_QUERIES queries are looked
    for in all texts by one scan, and more by an index planned on the way.
    """
    query = F.lower(tx.collapse_spaces(tx.text_of(F.col("query"))))
    asked = questions.select("query_id", query.alias("whole"), F.array_distinct(F.split(query, " ")).alias("words")).where("whole <> ''")
    if index is None and (rows := known_rows(asked, SCANNED_QUERIES)) is not None:
        return _scanned(json.dumps(rows), asked.schema.simpleString(), posts, k, config)
    found = substrings.candidates(asked, index or substrings.index(posts, config)).join(asked, "query_id")
    found = found.withColumn("others", F.array_except("words", F.array("word"))).drop("words", "word")
    text = _text()
    dated = published(posts, config).select("post_id", "modified", F.lower(tx.text_of(F.col("title"))).alias("heading"), text.alias("text"))
    best = Window.partitionBy("query_id").orderBy(F.when(F.contains("heading", F.col("whole")), 0).otherwise(1), *newest())
    whole = found.join(dated, "post_id").where(F.forall("others", lambda w: F.contains(F.col("text"), w)))
    return whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "post_id")


def known_rows(asked: DataFrame, most: int) -> list[dict] | None:
    """The rows of a small table, if it has at most `most`."""
    rows = asked.limit(most + 1).collect()
    return None if len(rows) > most else [r.asDict(True) for r in rows]


def _text():
    return F.lower(F.concat_ws("\n", "title", "excerpt", "content"))


def _scanned(asked: str, kind: str, posts: DataFrame, k: int, config: EngineConfig) -> DataFrame:
    """like_search of the queries in asked, JSON rows of (query_id, whole, words): a constant of the one scan's plan. No text is moved."""
    queries = F.from_json(F.lit(asked), f"array<{kind}>")
    held = tx.let(_text(), lambda text: F.filter(queries, lambda q: F.forall(q["words"], lambda w: F.contains(text, w))))
    found = published(posts, config).select("post_id", "modified", F.lower(tx.text_of(F.col("title"))).alias("heading"), F.explode(held).alias("q"))
    rows = found.select("q.query_id", "post_id", "modified", F.when(F.contains("heading", F.col("q.whole")), 0).otherwise(1).alias("late"))
    best = Window.partitionBy("query_id").orderBy("late", *newest())
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "post_id")


def retrieve(questions: DataFrame, hits: DataFrame, corpus: DataFrame, posts: DataFrame, k: int, config: EngineConfig = DEFAULT, index: substrings.SubstringIndex | None = None) -> DataFrame:
    """(query_id, rank, source, id, title, url, excerpt): up to k pages for each question, from the first source that has any.

    The sources in order: search hits (hydrated), corpus entries by word overlap, platform search (only if a question has
    words), and the newest corpus entries. No corpus, no fallback. Each source is asked for the questions that those before
    it left open, and none at all if there are none; what it found is written once, k rows a question.
    """

    def page(found: DataFrame, source: str, rank: str = "rank") -> DataFrame:
        return materialised(found.select("query_id", F.col(rank).cast("int").alias("rank"), F.lit(source).alias("source"), *page_columns()))

    def left(open_: DataFrame, found: DataFrame) -> DataFrame:
        return materialised(open_.join(found.select("query_id").distinct(), "query_id", "left_anti"))

    every = page(hits.where(F.col("rank") <= k), "search")
    corpus, open_ = materialised(corpus), left(questions, every)
    if open_.isEmpty() or corpus.isEmpty():
        return every
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_rank")
    overlap = fallback_score(open_, corpus).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("post_id")
    by_words = page(overlap.join(F.broadcast(corpus), "corpus_rank"), "overlap")  # corpus_limit rows
    every, open_ = every.unionByName(by_words), left(open_, by_words)
    asked = open_.where(F.size(tx.fallback_tokenize(F.col("query"))) > 0)
    if not asked.isEmpty():
        liked = materialised(like_search(asked, posts, k, config, index))
        entries = corpus_entries(posts.join(liked.select("post_id").distinct(), "post_id", "left_semi"))
        by_platform = page(liked.join(entries, "post_id"), "platform")
        every, open_ = every.unionByName(by_platform), left(open_, by_platform)
    newest_pages = open_.select("query_id").crossJoin(F.broadcast(corpus.where(F.col("corpus_rank") <= k)))  # k rows
    return every.unionByName(page(newest_pages, "recent", "corpus_rank"))
