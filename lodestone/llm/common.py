"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable, Hashable, Iterator
from typing import Any
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, of an Arrow batch that a Python stage works on at once; keeps a worker's memory flat when texts are
#: long. A single row may be longer.
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch between Spark and a Python worker, at most; Spark's own 10,000 rows of long texts take hundreds
#: of megabytes outside the heap.
ARROW_ROWS = 1_000
#: Rows that Spark's Parquet reader decodes at once, at most; for its own 4,096 long texts it keeps arrays of tens of megabytes
#: that grow by doubling, which makes the heap of an executor grow with them.
READ_ROWS = 512


def workers_ready(spark: SparkSession) -> None:
    """Prepares the session for Python stages over long texts.

    Workers can import this package from where the driver found it (on a cluster it is installed or sent by --py-files),
    and larger settings of spark.sql.execution.arrow.maxRecordsPerBatch and spark.sql.parquet.columnarReaderBatchSize are
    lowered to ARROW_ROWS and READ_ROWS.
    """
    for setting, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if not 0 < int(spark.conf.get(setting)) <= most:
            spark.conf.set(setting, str(most))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without one (tests) gets a temporary folder; a cluster must name one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files whose lineage was cut off: it does once the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


class Tables:
    """Intermediate Parquet tables in the shared checkpoint folder: like checkpoints, but compressed, and dropped when done with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, *by: str) -> DataFrame:
        """df written and read back. by: columns that rows are dealt by first, so that what a filter or join left thin is written as few, even files."""
        path = f"{checkpoint_folder(self.spark)}/table-{uuid4()}"
        (df.repartition(*by) if by else df).write.parquet(path)
        self.paths.append(path)
        release_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *but: DataFrame) -> None:
        """Drops all tables written so far, but for those that `but` read."""
        read = {os.path.basename(os.path.dirname(f)) for df in but for f in df.inputFiles()}
        gone = [path for path in self.paths if os.path.basename(path) not in read]
        self.paths = [path for path in self.paths if path not in gone]
        for path in gone:
            drop_folder(self.spark, path)

    def last(self, df: DataFrame, *by: str) -> DataFrame:
        """Writes df, the result, and drops all tables before it."""
        before, self.paths = self.paths, []
        done = self.write(df, *by)
        for path in before:
            drop_folder(self.spark, path)
        return done


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as one table of its own that stays."""
    return Tables(df.sparkSession).write(df, *by)


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back, so that a lost executor costs no recomputation.

    Shuffle files that only the cut lineage needed are released.
    """
    checkpoint_folder(df.sparkSession)
    cut = df.checkpoint()
    release_shuffles(df.sparkSession)
    return cut


_kept: dict[tuple[str, Hashable], Any] = {}


def kept(kind: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """What make returns, held by this worker for the tasks after this one. A worker holds one such thing at a time."""
    if (kind, key) not in _kept:
        _kept.clear()
        _kept[kind, key] = make()
    return _kept[kind, key]


def forget_others(kind: str | None) -> None:
    """Drops what stages of another kind left in this worker: Spark gives a worker to one operator's tasks after another's."""
    for known in [k for k in _kept if k[0] != kind]:
        del _kept[known]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most ROWS_AT_ONCE rows and about BYTES_AT_ONCE bytes."""
    if batch.num_rows <= 1 or batch.num_rows <= ROWS_AT_ONCE and batch.nbytes <= BYTES_AT_ONCE:
        yield batch
    else:
        yield from slices(batch.slice(0, batch.num_rows // 2))
        yield from slices(batch.slice(batch.num_rows // 2))


def map_batches(df: DataFrame, schema: str, run: Callable[[pa.RecordBatch], pa.RecordBatch], keeps: str | None = None) -> DataFrame:
    """mapInArrow in slices of at most ROWS_AT_ONCE rows and about BYTES_AT_ONCE bytes.

    keeps: the kind of what run holds between tasks by kept(); a stage drops what those of other kinds left.
    """
    workers_ready(df.sparkSession)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(keeps)
        for batch in batches:
            for part in slices(batch):
                out = run(part)
                if out.num_rows:
                    yield out

    return df.mapInArrow(stage, schema)


def utf8(name: str) -> Column:
    """The text as UTF-8 bytes: Python's byte strings are cheaper to cut and hash than str."""
    return F.col(name).cast("binary")


def hex_of_long(value: Column) -> Column:
    """16 lowercase hex digits of a long's 64 bits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def broadcast_if_small(df: DataFrame, weight: Column, limit: int = 8 << 20) -> DataFrame:
    """df with a broadcast hint if the sum of weight (bytes of a row) is within limit, else as it is, for a shuffled join."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df
