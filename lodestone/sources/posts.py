"""Posts and queries as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.config import DEFAULT, INTENTS, EngineConfig
from lodestone.functions import text as tx

POSTS = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("post_type", T.StringType()),
        T.StructField("post_status", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField("permalink", T.StringType()),
        T.StructField("modified", T.TimestampType()),
    ]
)


def _minutes_after(start: str, minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + minutes * 60)


def _first_words(value: Column, n: int) -> Column:
    return F.array_join(F.slice(tx.first_words(tx.text_of(value), n, r"\s+"), 1, n), " ")


def dealt(table: DataFrame, key: str) -> DataFrame:
    """A table whose files give fewer tasks than two for each core, dealt out by its key; any other as it is.

    A small table is often one row group, which one task would tokenize alone. Only tables of that size are moved.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(2 * cores, key) if table.rdd.getNumPartitions() < 2 * cores else table


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as posts of type post."""
    return of_documents(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))


def of_documents(d: DataFrame) -> DataFrame:
    """Rows of the documents table, of a stream as well, as posts."""
    return d.select(
        F.col("doc_id").alias("post_id"),
        F.lit("post").alias("post_type"),
        F.when(F.col("doc_id") % 50 == 49, "draft").otherwise("publish").alias("post_status"),
        _first_words(F.col("text"), 8).alias("title"),
        F.col("text").alias("content"),
        F.lit("").alias("excerpt"),
        F.col("source").alias("author"),
        F.concat(F.lit("doc-"), "doc_id").alias("slug"),
        F.concat(F.lit("https://example.com/?p="), "doc_id").alias("permalink"),
        _minutes_after("2024-01-01 00:00:00", F.col("doc_id")).alias("modified"),
    )


def page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as posts of type page."""
    return of_pages(dealt(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id"))


def of_pages(p: DataFrame) -> DataFrame:
    """Rows of the pages table, of a stream as well, as posts."""
    return p.select(
        (F.col("page_id") + 1_000_000).alias("post_id"),
        F.lit("page").alias("post_type"),
        F.lit("publish").alias("post_status"),
        tx.decode_entities(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.col("html").alias("content"),
        F.lit("").alias("excerpt"),
        F.lit("site").alias("author"),
        F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)/?$", 1).alias("slug"),
        F.col("url").alias("permalink"),
        _minutes_after("2024-02-01 00:00:00", F.col("page_id")).alias("modified"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_posts(spark, sf_dir).unionByName(page_posts(spark, sf_dir))


def published(posts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return posts.where((F.col("post_status") == "publish") & F.col("post_type").isin(*config.indexable_types))


def query_batch(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    """The benchmark table as visitor queries: (query_id, query, types, limit, intent)."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    intent = F.element_at(F.array(*map(F.lit, INTENTS)), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select(F.col("item_id").alias("query_id"), _first_words(F.col("text"), 8).alias("query"), F.array().cast("array<string>").alias("types"), F.lit(limit).alias("limit"), intent.alias("intent"))


def one_query(spark: SparkSession, query: str, types: list[str] | None = None, limit: int = 20, intent: str = "informational") -> DataFrame:
    schema = "query_id long, query string, types array<string>, limit int, intent string"
    return spark.createDataFrame([(0, query, types or [], limit, intent)], schema)
