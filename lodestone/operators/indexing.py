"""Building and maintaining the inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, EngineConfig
from lodestone.functions import text as tx
from lodestone.sources.posts import published
from lodestone.sources.store import IndexStore, materialised

#: Counters saturate here.
MOST = 65_535


def content_cap(post_type: Column, config: EngineConfig = DEFAULT) -> Column:
    cap = F.lit(max(1, config.default_content_cap))
    for kind, n in config.content_caps.items():
        cap = F.when(post_type == kind, F.lit(max(1, n))).otherwise(cap)
    return cap


def eligible(posts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """posts with a column eligible: published and of an indexable type."""
    return posts.withColumn("eligible", (F.col("post_status") == "publish") & F.col("post_type").isin(*config.indexable_types))


def tokenized(posts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(post_id, post_type, title, excerpt, content) as arrays of terms, for published posts of indexable types.

    The tokenizer is the expensive step: derive both index tables from one persisted or written result of this.
    """
    stripped = published(posts, config).select("post_id", "post_type", "title", "excerpt", tx.strip_tags(F.col("content")).alias("content"))
    excerpt = F.when(tx.text_of(F.col("excerpt")) != "", F.col("excerpt")).otherwise(tx.cut_words(F.col("content"), 40))
    return stripped.select(
        "post_id",
        "post_type",
        tx.tokenize(F.col("title"), config=config).alias("title"),
        tx.tokenize(excerpt, config=config).alias("excerpt"),
        tx.tokenize(F.col("content"), content_cap(F.col("post_type"), config), config).alias("content"),
    )


def length() -> Column:
    """The length of a row of tokenized."""
    return F.least(F.lit(MOST), F.size("title") + F.size("excerpt") + F.size("content"))


def index_terms(tokens: DataFrame, once: bool = False, doc_length: Column | None = None) -> DataFrame:
    """(term, post_id, tf_title, tf_excerpt, tf_content, post_type, doc_length): one packed row for each term of a post.

    A posting holds what its score needs of the post, so a search reads postings only. Terms are counted inside a post's row,
    so nothing is sorted or moved; once says that each post is one row, else the counts of a post's rows are added up.
    doc_length is given where tokens hold some terms of a post only.
    """
    fields = ("title", "excerpt", "content")
    columns = [f"tf_{f}" for f in fields]
    sorted_terms = F.sort_array(F.concat(*(_tag(f, n) for n, f in enumerate(fields))))
    filled = tokens.where(F.size("title") + F.size("excerpt") + F.size("content") > 0)
    counted = filled.select("post_id", "post_type", (length() if doc_length is None else doc_length).alias("doc_length"), F.explode(tx.let(sorted_terms, _runs)).alias("x"))
    rows = counted.select("x.term", "post_id", *(F.get("x.n", F.lit(n)).alias(c) for n, c in enumerate(columns)), "post_type", "doc_length")
    if not once:
        rows = rows.groupBy("term", "post_id").agg(*(F.sum(c).alias(c) for c in columns), *(F.first(c).alias(c) for c in ("post_type", "doc_length")))
    return rows.select("term", "post_id", *(F.least(F.lit(MOST), F.col(c)).cast("int").alias(c) for c in columns), "post_type", "doc_length")


def single(tokens: DataFrame) -> bool:
    """Whether each post is one row."""
    return tokens.groupBy("post_id").count().where("count > 1").isEmpty()


def _runs(tagged: Column) -> Column:
    """(term, n) of each term of a sorted array of (term, field), not an empty one: n has its number in each field."""
    at = lambda i: F.get(tagged, i)
    starts = F.filter(F.sequence(F.lit(0), F.size(tagged) - 1), lambda i: (i == 0) | (at(i)["term"] != at(i - 1)["term"]))
    single = F.array(*(F.array(*(F.lit(int(m == n)) for m in range(3))) for n in range(3)))

    def counted(starts: Column) -> Column:
        def run(start: Column, j: Column) -> Column:
            length = F.coalesce(F.get(starts, j + 1), F.size(tagged)) - start
            many = tx.let(F.slice(tagged, start + 1, length), lambda xs: F.array(*(_in_field(xs, n) for n in range(3))))
            return F.struct(at(start)["term"].alias("term"), F.when(length == 1, F.get(single, at(start)["field"])).otherwise(many).alias("n"))

        return F.transform(starts, run)

    return tx.let(starts, counted)


def _in_field(tagged: Column, n: int) -> Column:
    return F.size(F.filter(tagged, lambda x: x["field"] == n))


def _tag(field: str, n: int) -> Column:
    return F.transform(field, lambda t: F.struct(t.alias("term"), F.lit(n).alias("field")))


def index_docs(tokens: DataFrame, indexed_at: Column | None = None) -> DataFrame:
    """(post_id, post_type, doc_length, indexed_at, terms) of posts that have a term; terms are the distinct ones."""
    terms = F.array_distinct(F.concat("title", "excerpt", "content")).alias("terms")
    return tokens.select("post_id", "post_type", length().alias("doc_length"), (F.current_timestamp() if indexed_at is None else indexed_at).alias("indexed_at"), terms).where("doc_length > 0")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: total_docs, avgdl (0 without documents)."""
    return docs.agg(F.count("*").alias("total_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avgdl"))


def status_of(store: IndexStore, rebuilding: bool = False) -> DataFrame:
    """index_status of a stored index, from the frequencies kept with its segments: no posting is read."""
    by_term = store.frequencies().groupBy("term").agg(F.sum("df").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("term_rows"), F.count("*").alias("unique_terms"))
    total, length = store.totals()
    by_doc = store.docs().agg(F.max("indexed_at").alias("last_indexed"))
    counted = by_doc.select(F.lit(total).cast("long").alias("total_docs"), F.lit(length / total if total else 0.0).alias("avgdl"), "last_indexed")
    return counted.crossJoin(F.broadcast(by_term)).select("total_docs", "avgdl", "last_indexed", "term_rows", "unique_terms", F.lit(rebuilding).alias("limited_mode"))  # one row each


def index_status(terms: DataFrame, docs: DataFrame, rebuilding: bool = False) -> DataFrame:
    """One row: total_docs, avgdl, term_rows, unique_terms, last_indexed, limited_mode."""
    by_term = terms.groupBy("term").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("term_rows"), F.count("*").alias("unique_terms"))
    by_doc = docs.agg(F.count("*").alias("total_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avgdl"), F.max("indexed_at").alias("last_indexed"))
    return by_doc.crossJoin(F.broadcast(by_term)).withColumn("limited_mode", F.lit(rebuilding))  # one row each


def rebuild_batches(posts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(page, batch_rows, processed, total, status): progress after each batch of published posts.

    Progress follows from the number of posts alone, so nothing is ranked or moved to make it.
    """
    size = config.batch_size()
    total = published(posts, config).agg(F.count("*").alias("total")).where("total > 0")
    pages = total.select("total", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / size).cast("int"))).alias("page"))
    done = pages.withColumn("processed", F.least(F.col("total"), F.col("page") * F.lit(size).cast("long")))
    rows = F.col("processed") - (F.col("page") - 1) * F.lit(size).cast("long")
    return done.select("page", rows.alias("batch_rows"), "processed", "total", F.when(F.col("processed") >= F.col("total"), "complete").otherwise("running").alias("status"))


def latest_changes(changes: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The last change of each post: changes are posts with (seq, op), op being save or delete."""
    last = changes.groupBy("post_id").agg(F.max_by(F.struct(*(c for c in changes.columns if c != "post_id")), F.struct("seq", "op")).alias("last"))
    return last.select("post_id", "last.*")


def changed(changes: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, docs, touched): the new rows of changed posts, and the posts whose old rows go.

    A delete, or a save that leaves a post unpublished or of another type, only removes.
    """
    last = changes.repartition("post_id") if single(changes) else latest_changes(changes, config)
    tokens = materialised(tokenized(last.where("op = 'save'"), config))  # both tables derive from it
    return index_terms(tokens, once=True), index_docs(tokens), changes.select("post_id").distinct()


def upsert(terms: DataFrame, docs: DataFrame, changes: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Both index tables after changes: rows of changed posts go, rows of their new state come."""
    new_terms, new_docs, touched = changed(changes, config)
    return (
        terms.join(touched, "post_id", "left_anti").select(*terms.columns).unionByName(new_terms.select(*terms.columns)),
        docs.join(touched, "post_id", "left_anti").select(*docs.columns).unionByName(new_docs.select(*docs.columns)),
    )


def delete(table: DataFrame, post_ids: DataFrame) -> DataFrame:
    """Rows of an index table whose post isn't among post_ids."""
    return table.join(post_ids.select("post_id").distinct(), "post_id", "left_anti").select(*table.columns)
