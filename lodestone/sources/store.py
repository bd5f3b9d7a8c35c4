"""The index store: term and document tables on shared storage, and small JSON artefacts beside them."""

from __future__ import annotations

import json
import re
import tempfile
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POST = [T.StructField("post_type", T.StringType()), T.StructField("doc_length", T.IntegerType())]
TERMS = T.StructType([T.StructField("term", T.StringType()), T.StructField("post_id", T.LongType()), *(T.StructField(f"tf_{f}", T.IntegerType()) for f in ("title", "excerpt", "content")), *_POST])
DOCS = T.StructType([T.StructField("post_id", T.LongType()), *_POST, T.StructField("indexed_at", T.TimestampType())])
#: The terms of a document, by which a change takes it out of the frequencies.
WITH_TERMS = T.StructType([*DOCS.fields, T.StructField("terms", T.ArrayType(T.StringType()))])
FREQUENCIES = T.StructType([T.StructField("term", T.StringType()), T.StructField("post_type", T.StringType()), T.StructField("df", T.LongType())])
VERSION = 3
#: Directories that the term table is spread over by a hash of the term; a look-up reads those of its terms only.
TERM_BUCKETS = 64
#: Postings of a file of a bucket, about: a bucket with more is spread over several tasks, and so is a term of a third of all posts.
FILE_POSTINGS = 1_000_000
#: Segments of an index beyond which a write merges the newest of like size.
SEGMENTS = 8
#: A merge goes on to the segment before as long as that has at most this many times the postings of those after it.
MERGED_TIMES = 2
TOUCHED = T.StructType([T.StructField("post_id", T.LongType())])


def term_bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; only a local session without one (tests) gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{shared.rstrip('/')}/{uuid4()}" if shared else tempfile.mkdtemp(prefix="lodestone-")


def materialised(df: DataFrame) -> DataFrame:
    """df written to a folder of its own and read back, so that it is computed once however often it is used."""
    path = f"{scratch(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class IndexStore:
    """Segments of three Parquet tables under a folder, named by a pointer: a base and what changed since.

    Terms are the postings, documents the forward index, frequencies the number of documents by term and type. A segment's
    frequencies are what it changed: its own documents, less the ones that it hid. Their sum over the segments counts the
    index as it stands, as do the totals in the pointer, so that ranking reads the postings of its terms and nothing else.

    A write adds a segment with the rows of the posts that it touched, and hides those of these posts that the segments before
    it have; a write beyond SEGMENTS merges the newest ones of like size, so that a posting is written again a number of times
    that grows with the logarithm of the writes. The pointer is a file of its own for each version, renamed into place, and
    the highest counts: readers see one state or the next, and a failed or repeated write leaves the index as it was. The
    folder must be reachable by the driver and all executors; one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/{name}.*.json")) or []
        numbers = (re.fullmatch(rf"{re.escape(name)}\.(\d+)\.json", status.getPath().getName()) for status in found)
        return sorted(int(m[1]) for m in numbers if m)

    def get(self, name: str, default: Any = None) -> Any:
        """A JSON artefact (snapshot, brief, options, rebuild progress), or default."""
        versions = self._versions(name)
        if not versions:
            return default
        stream = self._fs.open(self._path(f"{self.path}/{name}.{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, name: str, value: Any) -> None:
        """Writes the next version of an artefact and renames it into place; the one before stays until the one after."""
        versions = self._versions(name)
        new = self._path(f"{self.path}/.{name}.{uuid4()}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if not self._fs.rename(new, self._path(f"{self.path}/{name}.{(versions or [0])[-1] + 1}.json")):
            raise OSError(f"{name} could not be renamed into place")
        for old in versions[:-1]:
            self._fs.delete(self._path(f"{self.path}/{name}.{old}.json"), False)

    def state(self) -> dict[str, Any]:
        """The pointer: segments in the order of their writes, and those that the last write left behind."""
        state = self.get("index", {"version": VERSION, "next": 1, "segments": [], "dropped": [], "totals": [0, 0], "sizes": {}})
        if state["version"] != VERSION:
            raise ValueError(f"the index has schema version {state['version']}; rebuild it for {VERSION}")
        return state

    def _write(self, n: int, terms: DataFrame, docs: DataFrame, touched: DataFrame | None, totals: list[int]) -> tuple[list[int], int]:
        """Writes segment n; the totals with it, given those without, and the number of its postings."""
        docs.select(*WITH_TERMS.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/docs-{n}")
        counted = self.spark.read.schema(WITH_TERMS).parquet(f"{self.path}/docs-{n}").withColumn("sign", F.lit(1))
        if touched is not None:
            self._read("docs", TOUCHED).join(touched, "post_id", "left_semi").distinct().write.mode("overwrite").parquet(f"{self.path}/touched-{n}")
            gone = self.spark.read.schema(TOUCHED).parquet(f"{self.path}/touched-{n}")
            if not gone.isEmpty():  # else only the ids of the documents before are read
                hidden = self._read("docs", WITH_TERMS).join(gone, "post_id", "left_semi")
                counted = counted.unionByName(hidden.withColumn("sign", F.lit(-1)))
        sums = ("sign", F.col("sign") * F.col("doc_length"), F.when(F.col("sign") > 0, F.size("terms")))
        docs_more, length_more, postings = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in sums)).first()
        self._write_terms(n, terms, postings)
        by_term = counted.select("post_type", "sign", F.explode("terms").alias("term")).groupBy("term", "post_type").agg(F.sum("sign").alias("df"))
        self._write_frequencies(n, by_term)
        return [totals[0] + docs_more, totals[1] + length_more], postings

    def _write_terms(self, n: int, terms: DataFrame, postings: int) -> None:
        """A bucket goes to one task, or to as many as its postings are to fill files, whichever tasks made it."""
        spread = postings // (TERM_BUCKETS * FILE_POSTINGS) + 1
        dealt = terms.select(*TERMS.fieldNames(), term_bucket("term").alias("bucket")).repartition("bucket", F.pmod(F.xxhash64("post_id"), F.lit(spread)))
        dealt.sortWithinPartitions("bucket", "term", "post_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms-{n}")

    def _write_frequencies(self, n: int, by_term: DataFrame) -> None:
        ordered = by_term.where("df <> 0").withColumn("bucket", term_bucket("term")).repartition("bucket").sortWithinPartitions("bucket", "term")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/df-{n}")

    def _merge(self, state: dict[str, Any]) -> None:
        """Replaces the newest segments of like size by one: their rows that none of them hides, what they touched, and their frequencies added up."""
        segments, sizes = state["segments"], self._sizes(state)
        first = len(segments) - 2
        while first and sizes[segments[first - 1]] <= MERGED_TIMES * sum(sizes[n] for n in segments[first:]):
            first -= 1
        n, own, before = state["next"], segments[first:], segments[:first]
        self._read("docs", WITH_TERMS, segments=own).write.mode("overwrite").parquet(f"{self.path}/docs-{n}")
        if before:
            self.spark.read.schema(TOUCHED).parquet(*(f"{self.path}/touched-{s}" for s in own)).distinct().write.mode("overwrite").parquet(f"{self.path}/touched-{n}")
        postings = self.spark.read.schema(WITH_TERMS).parquet(f"{self.path}/docs-{n}").agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
        self._write_terms(n, self.terms(segments=own), postings)
        self._write_frequencies(n, self.frequencies(segments=own, changes=True))
        self._point(state, [*before, n], state["totals"], postings)

    def _sizes(self, state: dict[str, Any]) -> dict[int, int]:
        """The postings of each segment; 0 for those of a pointer that didn't name them yet, which are merged at once."""
        return {n: state.get("sizes", {}).get(str(n), 0) for n in state["segments"]}

    def _point(self, state: dict[str, Any], segments: list[int], totals: list[int], postings: int) -> None:
        left = [n for n in state["segments"] if n not in segments]
        sizes = {str(n): size for n, size in self._sizes(state).items() if n in segments} | {str(state["next"]): postings}
        self.put("index", {"version": VERSION, "next": state["next"] + 1, "segments": segments, "dropped": left, "totals": totals, "sizes": sizes})
        for n in state["dropped"]:
            for table in ("terms", "docs", "touched", "df"):
                self._fs.delete(self._path(f"{self.path}/{table}-{n}"), True)

    def write(self, terms: DataFrame, docs: DataFrame) -> None:
        """Replaces the index. docs come with their terms."""
        state = self.state()
        self._point(state, [state["next"]], *self._write(state["next"], terms, docs, None, [0, 0]))

    def append(self, terms: DataFrame, docs: DataFrame, touched: DataFrame) -> None:
        """Adds the rows of the posts in touched; those that they had go. Writes what changed, not the index."""
        state = self.state()
        if len(state["segments"]) >= SEGMENTS:
            self._merge(state)
            state = self.state()
        totals, postings = self._write(state["next"], terms, docs, touched, state["totals"])
        self._point(state, [*state["segments"], state["next"]], totals, postings)

    def _read(self, table: str, schema: T.StructType, wanted=None, segments: list[int] | None = None) -> DataFrame:
        """The rows of a table that no later segment hides, of all segments or of some that follow each other."""
        segments = self.state()["segments"] if segments is None else segments
        rows, hidden = None, None
        for n in reversed(segments):
            own = self.spark.read.schema(schema).parquet(f"{self.path}/{table}-{n}")
            own = wanted(own) if wanted else own
            own = own if hidden is None else own.join(hidden, "post_id", "left_anti").select(*own.columns)
            rows = own if rows is None else own.unionByName(rows)
            if n != segments[0]:
                gone = self.spark.read.schema(TOUCHED).parquet(f"{self.path}/touched-{n}")
                hidden = gone if hidden is None else hidden.unionByName(gone)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def terms(self, wanted: list[str] | None = None, segments: list[int] | None = None) -> DataFrame:
        """The term table; with wanted terms only their buckets are read, and the term filter reaches the scan."""
        stored = T.StructType([*TERMS.fields, T.StructField("bucket", T.IntegerType())])
        if wanted is None:
            return self._read("terms", stored, segments=segments).drop("bucket")
        return self._read("terms", stored, self._of(wanted), segments).drop("bucket")

    def _of(self, wanted: list[str]):
        """Confines a scan to the buckets of some terms, and to these inside them. The hash of constants is one, so the scan's partition filters have it and no job runs for it."""
        places = F.array(*(term_bucket(F.lit(t)) for t in wanted)) if wanted else F.array(F.lit(-1))
        return lambda rows: rows.where(F.array_contains(places, F.col("bucket")) & F.col("term").isin(*wanted))

    def frequencies(self, wanted: list[str] | None = None, segments: list[int] | None = None, changes: bool = False) -> DataFrame:
        """(term, post_type, df) of all terms, or of the wanted ones, whose buckets alone are read; of some segments only, by what they changed."""
        stored, rows = T.StructType([*FREQUENCIES.fields, T.StructField("bucket", T.IntegerType())]), self.spark.createDataFrame([], FREQUENCIES)
        for at, n in enumerate(self.state()["segments"] if segments is None else segments):
            own = self.spark.read.schema(stored).parquet(f"{self.path}/df-{n}")
            own = (own if wanted is None else self._of(wanted)(own)).drop("bucket")
            rows = rows.unionByName(own) if at else own
        return rows.groupBy("term", "post_type").agg(F.sum("df").alias("df")).where("df <> 0" if changes else "df > 0")

    def totals(self) -> tuple[int, int]:
        """The number of documents, and the sum of their lengths."""
        docs, length = self.state()["totals"]
        return docs, length

    def docs(self) -> DataFrame:
        return self._read("docs", DOCS)

    def truncate(self) -> None:
        self.write(self.spark.createDataFrame([], TERMS), self.spark.createDataFrame([], WITH_TERMS))
