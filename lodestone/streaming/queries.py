"""Streams over the driver's tables, run to the end of what is there."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.operators import indexing, snapshot
from lodestone.sources import posts as src
from lodestone.sources.store import IndexStore, materialised, scratch
from lodestone.streaming import corpus, limits
from lodestone.streaming.conversations import conversation_store
from lodestone.streaming.index import maintain, rebuild, rebuilt


def workers_import(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it; on a cluster it is installed or sent by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream takes a folder or a pattern but no single file
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(stream: DataFrame) -> DataFrame:
    """The rows that a stream appends until its source ends, by way of files."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _events(spark, sf_dir).select("user_id", "event_id", "ts")
    return _shown(_finished(limits.rate_limited(requests, "user_id", 2, 600)))


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return _shown(_finished(limits.circuit_breaker(calls, "user_id", DEFAULT.breaker_threshold, 86_400)))


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of an index that was built from posts and then maintained from a stream of changes."""
    folder = scratch(spark)
    store = IndexStore(spark, f"{folder}/index")
    posts = src.posts(spark, sf_dir)
    tokens = materialised(indexing.tokenized(posts))
    store.write(indexing.index_terms(tokens, indexing.single(tokens)), indexing.index_docs(tokens))
    changed = posts.where("post_id % 10 = 0").withColumn("content", F.concat(F.lit("Freshly updated wording. "), "content")).withColumns({"seq": F.lit(1), "op": F.lit("save")})
    removed = posts.where("post_id % 15 = 0").withColumns({"seq": F.lit(2), "op": F.lit("delete")})
    changed.unionByName(removed).write.parquet(f"{folder}/changes")
    feed = spark.readStream.schema(spark.read.parquet(f"{folder}/changes").schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/changes")
    maintain(feed, store, f"{folder}/state").awaitTermination()
    status = indexing.status_of(store)
    return status.select("total_docs", F.round("avgdl", 6).alias("avgdl"), "term_rows", "unique_terms")


def corpus_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of three quarters of all posts after a stream of saves, of which some are new, and deletions."""
    folder = scratch(spark)
    store, posts = IndexStore(spark, f"{folder}/index"), src.posts(spark, sf_dir)
    corpus.write(store, snapshot.build_corpus(posts.where("post_id % 4 <> 1")))
    saved = posts.where("post_id % 9 = 0").withColumn("title", F.concat(F.lit("Changed: "), "title")).withColumns({"seq": F.col("post_id"), "op": F.lit("save")})
    removed = posts.where("post_id % 27 = 0").withColumns({"seq": F.col("post_id") + 10_000_000, "op": F.lit("delete")})
    saved.unionByName(removed).write.parquet(f"{folder}/changes")
    changes = spark.readStream.schema(spark.read.parquet(f"{folder}/changes").schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/changes")
    corpus.feed(changes, store, f"{folder}/state").awaitTermination()
    return corpus.read(store).select("post_id", "corpus_rank", "title", "post_type")


def rebuild_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress and the status of an index that a stream over the tables' files built, a file a table and micro-batch."""
    folder = scratch(spark)
    store = IndexStore(spark, f"{folder}/index")

    def table(name: str) -> DataFrame:
        schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")

    posts = src.of_documents(table("documents")).unionByName(src.of_pages(table("pages")))
    progress = rebuilt(rebuild(posts, store, f"{folder}/state"), store)
    shown = indexing.status_of(store).select("total_docs", F.round("avgdl", 6).alias("avgdl"), "term_rows", "unique_terms")
    return shown.select(F.lit(progress["status"]).alias("status"), F.lit(progress["processed"]).cast("long").alias("processed"), "*")


def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each conversation after a stream of its messages."""
    workers_import(spark)
    folder = scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    messages = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversation[s].parquet").select("conv_id", "turn", "role", F.col("text").alias("content"), ts.alias("ts"))

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/rows/batch-{epoch}")

    conversation_store(messages).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/rows/*")
    last = found.groupBy("conv_id").agg(F.max_by(F.struct("created_at", "last_seen", "n_messages", "recent"), "epoch").alias("last"))
    shown = lambda c: F.date_format(f"last.{c}", "yyyy-MM-dd HH:mm:ss").alias(c)
    return last.select("conv_id", shown("created_at"), shown("last_seen"), "last.n_messages", F.md5("last.recent").alias("recent_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stream_index, rebuild_stream, corpus_feed_stream, rate_limit_stream, circuit_breaker, conversation_stream)}
