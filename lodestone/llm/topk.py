"""Exact top-k search by a bit-sliced index.

Rows are cut into blocks; a block holds, for each dimension, the bits of the quantised values as bitmaps over its rows.
A query's scores are summed without touching single rows: each set bit of a query component adds the slices of its
dimension (their complements for a negative component) at that bit's weight, by carry-save adders over bitmaps. The top
rows are selected from the most significant slice of the sum downward, and rows that tie at the border are resolved
exactly by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Tables, workers_ready

#: Components that a block of the index holds, about; its rows if the table is small; queries of a chunk.
BLOCK_COMPONENTS, SMALL_BLOCK_ROWS, CHUNK_QUERIES = 1 << 22, 4096, 256


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    pad = -bits.shape[-1] % 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)]), axis=-1)).view("u8")


class BitSlicedIndex:
    """values: integers, a row for each vector; ids ascend, names tell rows of one id apart."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, names: np.ndarray | None = None):
        self.ids, self.names, self.low = ids, ids if names is None else names, values.min(0)
        shifted = (values - self.low).T  # a row for each dimension, from 0
        self.bits = max(1, int(shifted.max()).bit_length())
        self.slices = np.stack([_packed((shifted >> b & 1).astype("u1")) for b in range(self.bits)], axis=1)
        self.rows = _packed(np.ones((1, len(ids)), "u1"))[0]

    def stored(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.ids.tobytes(), self.names.tobytes(), self.low.tobytes(), self.slices.tobytes()

    @classmethod
    def of(cls, ids: bytes, names: bytes, low: bytes, slices: bytes) -> BitSlicedIndex:
        self = cls.__new__(cls)
        self.ids, self.names, self.low = (np.frombuffer(x, "i8") for x in (ids, names, low))
        self.rows = _packed(np.ones((1, len(self.ids)), "u1"))[0]
        self.slices = np.frombuffer(slices, "u8").reshape(len(self.low), -1, len(self.rows))
        self.bits = self.slices.shape[1]
        return self

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the sum, least significant first, what to add to it to get the inner product)."""
        weights: dict[int, list[np.ndarray]] = {}
        base = sum(q * low for q, low in zip(query.tolist(), self.low.tolist(), strict=True))  # beyond 64 bits if need be
        for dims, negative in ((np.flatnonzero(query > 0), False), (np.flatnonzero(query < 0), True)):
            if not len(dims):
                continue
            size = np.abs(query[dims])
            if negative:  # -q * x is q * complement(x) less q at every bit
                base -= sum(size.tolist()) * ((1 << self.bits) - 1)
            for bit in range(int(size.max()).bit_length()):
                own = self.slices[dims[size >> bit & 1 == 1]]
                for b in range(self.bits):
                    if len(own):
                        weights.setdefault(bit + b, []).append(own[:, b] ^ self.rows if negative else own[:, b])
        out, weight = [], 0
        while weights:
            group = weights.pop(weight, None)
            if group is None:
                out.append(np.zeros_like(self.rows))
                weight += 1
                continue
            stack = np.concatenate(group) if len(group) > 1 else group[0]
            carries = []
            while len(stack) > 1:
                whole = len(stack) // 3 * 3
                if whole:  # full adders: three bitmaps of a weight to one of it and one of the next
                    a, b, c = stack[:whole].reshape(3, -1, stack.shape[1])
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    stack = np.concatenate([half ^ c, stack[whole:]])
                else:
                    carries.append((stack[0] & stack[1])[None])
                    stack = (stack[0] ^ stack[1])[None]
            if carries:
                weights.setdefault(weight + 1, []).extend(carries)
            out.append(stack[0])
            weight += 1
        return out, base

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the k highest inner products, ties to smaller ids, without the row whose name is own."""
        slices, base = self.sums(query)
        sure, open_ = np.zeros_like(self.rows), self.rows.copy()
        if own is not None and len(at := np.flatnonzero(self.names == own)):
            gone = np.zeros((1, len(self.ids)), "u1")
            gone[0, at] = 1
            open_ &= ~_packed(gone)[0]
        have = 0
        for s in reversed(slices):
            more = open_ & s
            n = int(np.bitwise_count(more).sum())
            if have + n > k:
                open_ = more
            else:
                sure |= more
                have += n
                open_ = open_ & ~s
            if have == k:
                break
        rows = list(np.flatnonzero(np.unpackbits(sure.view("u1"))))
        if have < k:  # all rows that are open tie: the smallest ids, as rows are in their order
            rows += list(np.flatnonzero(np.unpackbits(open_.view("u1")))[: k - have])
        word, bit = np.divmod(np.array(rows, "i8"), 8)
        score = np.zeros(len(rows), "i8" if len(slices) < 63 else object)
        for weight, s in enumerate(slices):
            score += (s.view("u1")[word] >> (7 - bit) & 1).astype(score.dtype) << weight
        return sorted(((int(self.ids[r]), int(x) + base) for r, x in zip(rows, score, strict=True)), key=lambda x: (-x[1], x[0]))


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(rid, vec_id, q): floor(scale * x) of each component; vectors that take part only. rid tells the rows apart once this is written."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    floors = F.transform(x, lambda v: F.floor(v * scale))
    fits = F.array_max(F.transform(x, lambda v: F.abs(v) * scale)) < float(1 << 60)
    return (
        vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        .where(finite & (F.size(vector) > 0))
        .select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("vec_id"), F.when(fits, floors).otherwise(F.raise_error(F.lit("a component leaves the range of a long")).cast("array<bigint>")).alias("q"))
    )


def _matrix(rows: pa.Table) -> np.ndarray:
    q = rows.column("q").combine_chunks()
    return q.flatten().to_numpy().reshape(len(q), -1)


_BLOCK = "block int, dims int, kind int, ids binary, names binary, low binary, body binary"


def _stored(block: int, dims: int, kind: int, ids: bytes, names: bytes, low: bytes, body: bytes) -> pa.Table:
    fields = [c.split() for c in _BLOCK.split(", ")]
    return pa.table({n: pa.array([x], pa.int32() if t == "int" else pa.binary()) for (n, t), x in zip(fields, (block, dims, kind, ids, names, low, body), strict=True)})


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: Tables | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query over all vectors but its own row.

    vectors, queries: (rid, vec_id, q array<long>), written tables. Only vectors of a query's length are scored. Ties go to
    the smaller vec_id. Rows that repeat a vec_id are candidates, or queries, of their own. Each block of rows is sliced
    once; chunks of queries are sent to every block and met one after the other, so a task holds one block and one chunk,
    whatever the tables' sizes, and passes on k rows for each query. Rows read are those of the table and the queries times
    the blocks. Sums may pass 64 bits on the way; a score among a query's best that leaves them itself is an error, as its
    column is a long. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    workers_ready(spark)
    tables = tables or Tables(spark)  # those that go with the search
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("q").cast("long")), F.lit(0)).alias("components")).first()
    blocks = max(1, -(-size.components // BLOCK_COMPONENTS), min(spark.sparkContext.defaultParallelism, -(-size.n // SMALL_BLOCK_ROWS)))
    chunks = max(1, -(-queries.count() // CHUNK_QUERIES))
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rid"), F.lit(n)).cast("int")

    def sliced(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, names = rows.column("vec_id").to_numpy(), rows.column("rid").to_numpy()
        order = np.lexsort((names, ids))
        index = BitSlicedIndex(ids[order], _matrix(rows)[order], names[order])
        return _stored(key[0].as_py(), key[1].as_py(), 0, *index.stored())

    def chunked(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _stored(key[0].as_py(), key[1].as_py(), 1, rows.column("vec_id").to_numpy().tobytes(), rows.column("rid").to_numpy().tobytes(), b"", np.ascontiguousarray(_matrix(rows)).tobytes())

    index = vectors.select(dealt(blocks, 1).alias("block"), F.size("q").alias("dims"), "rid", "vec_id", "q").groupBy("block", "dims").applyInArrow(sliced, _BLOCK)
    asked = queries.select(dealt(chunks, 2).alias("part"), F.size("q").alias("dims"), "rid", "vec_id", "q").groupBy("part", "dims").applyInArrow(chunked, _BLOCK)
    index, asked = tables.write(index), tables.write(asked)
    everywhere = asked.drop("block").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dims", "kind", "ids", "names", "low", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            for block, dims, kind, ids, names, low, body in zip(*batch.columns, strict=True):
                key = block.as_py(), dims.as_py()
                if kind.as_py() == 0:
                    at, own = key, BitSlicedIndex.of(*(x.as_py() for x in (ids, names, low, body)))
                elif key == at:
                    found: list[tuple[int, int, int, int]] = []
                    matrix = np.frombuffer(body.as_py(), "i8").reshape(-1, key[1])
                    for query_id, name, q in zip(np.frombuffer(ids.as_py(), "i8").tolist(), np.frombuffer(names.as_py(), "i8").tolist(), matrix, strict=True):
                        found += [(name, query_id, *x) for x in own.top(q, k, name)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], names=["asked", "query_id", "vec_id", "score"])

    met = index.unionByName(everywhere).repartition(2 * blocks, "block", "dims").sortWithinPartitions("block", "dims", "kind")
    parts = met.mapInArrow(run, "asked long, query_id long, vec_id long, score long")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return tables.last(parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def query(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best rows of each row whose vec_id `every` divides. Columns other than vec_id and embedding don't matter."""
    tables = Tables(embeddings.sparkSession)
    vectors = tables.write(quantised(embeddings))
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k, tables)
