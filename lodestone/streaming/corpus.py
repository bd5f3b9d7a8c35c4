"""Keeping the snapshot's corpus up with a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.config import DEFAULT, EngineConfig
from lodestone.operators import indexing, snapshot
from lodestone.sources.posts import published
from lodestone.sources.store import IndexStore

SCHEMA = "corpus_rank int, post_id long, title string, permalink string, excerpt string, last_modified string, post_type string"


def fed(corpus: DataFrame, changes: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """corpus after changes (posts with seq and op), merged by post; the last change of a post counts.

    Entries that were there keep their rank. New ones follow in the order of the feed: their rank is the corpus limit and
    their change's seq, which counts through all changes, so nothing is ranked anew and a batch may be applied again. Posts
    that were deleted, or are no longer published or of an indexable type, go.
    """
    last = indexing.latest_changes(changes, config)
    live = published(last.where("op = 'save'"), config)
    entries = snapshot.corpus_entries(live, keep=("seq",))
    gone = last.join(live.select("post_id"), "post_id", "left_anti")
    merged = snapshot.upsert_entries(corpus.withColumn("seq", F.lit(None).cast("long")), entries.withColumn("seq", F.col("seq").cast("long")), gone)
    return merged.select(F.coalesce("corpus_rank", F.lit(config.corpus_limit) + F.col("seq")).cast("int").alias("corpus_rank"), *(c.split(" ")[0] for c in SCHEMA.split(", ")[1:]))


def read(store: IndexStore) -> DataFrame:
    """The stored corpus; empty if there is none."""
    n = store.get("corpus", {"generation": 0})["generation"]
    return store.spark.read.schema(SCHEMA).parquet(f"{store.path}/corpus-{n}") if n else store.spark.createDataFrame([], SCHEMA)


def write(store: IndexStore, corpus: DataFrame) -> None:
    """The next generation of the corpus; readers see the one before until it is whole."""
    generation = store.get("corpus", {"generation": 0})["generation"] + 1
    corpus.select(*(c.split(" ")[0] for c in SCHEMA.split(", "))).write.mode("overwrite").parquet(f"{store.path}/corpus-{generation}")
    store.put("corpus", {"generation": generation})


def feed(changes: DataFrame, store: IndexStore, checkpoint: str, config: EngineConfig = DEFAULT) -> StreamingQuery:
    """Applies a stream of changes to the stored corpus until the source has no more. Without a corpus changes are passed over: a snapshot, when it is built, holds them."""

    def batch(rows: DataFrame, epoch: int) -> None:
        if store.get("corpus") and not rows.isEmpty():
            write(store, fed(read(store), rows, config))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
