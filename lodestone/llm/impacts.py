"""Ranked lexical search by a bit-sliced impact index.

Documents are cut into blocks. A block holds, for each term, which of its rows have the term, and their impacts on a score
bit by bit: bitmap b has bit b of every impact. A query's scores over a block are sums of such bitmaps by bitwise carry
arithmetic, one word for 64 documents; no document is scored by itself. The best rows are found from the most significant
bitmap of the sums downward, and rows that tie at the border by their ids.

Lists are stored for the rows that have the term only, and spread over the block's rows when they are added. Impacts are
exact integers, so results are exact. No list grows with the corpus: a frequent term has one in every block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Tables, broadcast_if_small, map_batches, utf8, workers_ready

#: Documents, and their terms with repeats, that a task inverts at once; documents and terms that are searched as one block.
#: A longer document is a block of its own.
INVERTED_ROWS, INVERTED_TERMS, BLOCK_ROWS, BLOCK_TERMS = 1 << 14, 1 << 21, 1 << 16, 1 << 23

#: Queries of a chunk.
CHUNK_QUERIES = 256

#: Other characters of UTF-8 text separate terms.
_SEPARATORS = bytes(c for c in range(128) if not re.match("[0-9A-Za-z]", chr(c)))
_TABLE = bytes.maketrans(ascii_uppercase.encode() + _SEPARATORS, ascii_lowercase.encode() + b" " * len(_SEPARATORS))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a whole text: maximal runs of ASCII letters, digits and other characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_TABLE).split() if text else []


_INVERTED = "block long, term binary, n_rows long, n_terms long, ids binary, at binary, tf binary, size binary"


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[i]:bounds[i + 1]] as binary strings of 32-bit numbers."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype("i4").tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])


def _inverted(block: int, ids: list[int | None], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows of a block, those without an id last, and its lists: rows with the term, occurrences there, and those rows' terms."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    texts = [texts[i] for i in order]
    known = np.array([ids[i] for i in order if ids[i] is not None], "i8")
    size = np.array([len(t) for t in texts], "i8")
    codes = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    keys, tf = np.unique(codes.indices.to_numpy().astype("i8") * len(texts) + np.repeat(np.arange(len(texts)), size), return_counts=True)
    code, at = np.divmod(keys, len(texts))
    bounds = np.searchsorted(code, np.arange(len(codes.dictionary) + 1))
    head = pa.RecordBatch.from_pylist([{"block": block, "n_rows": len(texts), "n_terms": int(size.sum()), "ids": known.tobytes()}], schema=_schema())
    yield head
    n = len(codes.dictionary)
    nothing = pa.nulls(n, pa.binary())
    body = pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), codes.dictionary, pa.array(np.diff(bounds)), pa.nulls(n, pa.int64()), nothing, _lists(at, bounds), _lists(tf, bounds), _lists(size[at], bounds)], schema=_schema())
    for begin in range(0, n, 4096):
        yield body.slice(begin, 4096)


def _schema() -> pa.Schema:
    return pa.schema([(name, pa.int64() if kind == "long" else pa.binary()) for name, kind in (c.split() for c in _INVERTED.split(", "))])


def inverted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted lists of blocks of docs: for each block a row without a term, with its documents' ids, and a row for each of its terms.

    A map without a shuffle: each task inverts what it reads. Documents without a term are in no block.
    """
    workers_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for own, whole in zip(batch.column(0), batch.column(1), strict=True):
                terms = terms_of(whole.as_py())
                if texts and (len(texts) == INVERTED_ROWS or held + len(terms) > INVERTED_TERMS):
                    yield from _inverted(block, ids, texts)
                    block, ids, texts, held = block + 1, [], [], 0
                if terms:
                    ids.append(own.as_py())
                    texts.append(terms)
                    held += len(terms)
        if texts:
            yield from _inverted(block, ids, texts)

    return docs.select(F.col(key).cast("long"), utf8(text)).mapInArrow(run, _INVERTED)


def impacts(lists: DataFrame, n: int, total: int) -> DataFrame:
    """(block, no, at, slices) of inverted lists with their terms' no and weight w: of every impact w * ((10**9 * tf) div (1000 * tf + 8 * m)) a bitmap for each bit, over the rows at."""

    def sliced(w: int, tf: np.ndarray, size: np.ndarray) -> bytes:
        # 90 * size * n leaves 64 bits beyond some 10**11 documents
        m = 10 + (90 * n * size // total if 90 * n * int(size.max()) < 1 << 63 else np.array([90 * n * int(s) // total for s in size], "i8"))
        impact = w * (10**9 * tf // (1000 * tf + 8 * m))
        bits = np.arange(int(impact.max()).bit_length())[:, None]
        return np.packbits((impact >> bits & 1).astype("u1"), axis=1).tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, no, w, at, tf, size = batch.columns
        made = [sliced(a, np.frombuffer(b, "<u4").astype("i8"), np.frombuffer(c, "<u4").astype("i8")) for a, b, c in zip(w.to_pylist(), tf.to_pylist(), size.to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([block, no, at, pa.array(made, pa.binary())], names=["block", "no", "at", "slices"])

    return map_batches(lists.select("block", "no", "w", "at", "tf", "size"), "block long, no long, at binary, slices binary", run)


class Block:
    """The lists of some terms over a block's rows, as bitmaps of 64-bit words."""

    def __init__(self, ids: list[tuple[int, int, bytes]], lists: dict[int, list[tuple[int, bytes, bytes]]]):
        """ids: of each part of the block its first row, its rows and the ids of those that have one. lists: by term, of each part its first row, rows and slices."""
        self.words = max((first + rows for first, rows, _ in ids), default=0) + 63 >> 6
        self.ids, self.known = np.zeros(64 * self.words, "i8"), np.zeros(64 * self.words, bool)
        for first, _, known in ids:
            own = np.frombuffer(known, "i8")
            self.ids[first : first + len(own)], self.known[first : first + len(own)] = own, True
        self.lists = {no: self._joined(parts) for no, parts in lists.items()}

    @staticmethod
    def _joined(parts: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """A term's rows in the block and its packed slices over them."""
        rows = [np.frombuffer(at, "<u4").astype("i8") + first for first, at, _ in parts]
        slices = [np.frombuffer(s, "u1").reshape(-1, len(r) + 7 >> 3) for r, (_, _, s) in zip(rows, parts, strict=True)]
        order = sorted(range(len(parts)), key=lambda i: parts[i][0])
        if len(parts) == 1:
            return rows[0], slices[0]
        high = max(map(len, slices))
        bits = np.concatenate([np.pad(np.unpackbits(slices[i], axis=1, count=len(rows[i])), [(0, high - len(slices[i])), (0, 0)]) for i in order], axis=1)
        return np.concatenate([rows[i] for i in order]), np.packbits(bits, axis=1)

    def spread(self, no: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, bitmaps): the block's words that hold a row of the term, and a row of them for each bit of its impacts."""
        rows, slices = self.lists[no]
        word = rows >> 6
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        words = word[starts]
        place = (np.cumsum(np.diff(word, prepend=-1) > 0) - 1) * 64 + (rows & 63)
        dense = np.zeros((len(slices), 64 * len(words)), "u1")
        dense[:, place] = np.unpackbits(slices, axis=1, count=len(rows))
        return words, np.packbits(dense, axis=1).view("u8")

    def sums(self, terms: list[int]) -> np.ndarray:
        """The rows' sums of impacts over these terms, a bitmap for each bit."""
        present = [no for no in terms if no in self.lists]
        high = max((len(self.lists[no][1]) for no in present), default=0) + len(present).bit_length()
        total = np.zeros((high, self.words), "u8")
        for no in present:
            words, more = self.spread(no)
            own, carry = total[:, words], np.zeros(len(words), "u8")
            for b in range(high):
                if b < len(more):
                    half = own[b] ^ more[b]
                    carry, own[b] = own[b] & more[b] | half & carry, half ^ carry
                else:
                    carry, own[b] = own[b] & carry, own[b] ^ carry
            total[:, words] = own
        return total

    def top(self, terms: list[int], k: int) -> list[tuple[int | None, int]]:
        """(id, score) of the k highest sums above 0, ties to smaller ids, rows without an id last."""
        total = self.sums(terms)
        sure, open_ = np.zeros(self.words, "u8"), np.bitwise_or.reduce(total, axis=0, initial=0)
        have = 0
        for s in total[::-1]:
            more = open_ & s
            n = int(np.bitwise_count(more).sum())
            if have + n > k:
                open_ = more
            else:
                sure, have, open_ = sure | more, have + n, open_ & ~s
            if have == k:
                break
        rows_of = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view("u1")))
        rows = rows_of(sure)
        if have < k:  # the rows still open tie
            tied = rows_of(open_)
            rows = np.concatenate([rows, tied[np.lexsort((self.ids[tied], ~self.known[tied]))[: k - have]]])
        byte, bit = np.divmod(rows, 8)
        score = sum(((s.view("u1")[byte] >> (7 - bit) & 1).astype("i8") << b for b, s in enumerate(total)), np.zeros(len(rows), "i8"))
        return [(int(self.ids[r]) if self.known[r] else None, int(x)) for r, x in zip(rows, score, strict=True)]


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each query the k documents of the highest score above 0, of all documents.

    With N documents that have a term, L terms with repeats in them and n in one of them, df documents that hold a term and
    tf occurrences of it in one: a term's weight w is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is
    10 + (90 * n * N) div L, and its score the sum of w * ((10**9 * tf) div (1000 * tf + 8 * m)) over the query's terms.

    Rows that repeat a doc_id, or a whole row, are documents of their own. Documents without an id have none in the result
    and rank after others of their score. Queries of one id are one query with the terms of all. Null and empty texts have
    no terms; a query without terms has no rows. Empty tables give no rows; other columns don't matter.

    Every document is inverted. Lists of terms that no query has stay where they are, and only the asked ones become
    bitmaps and move: to each block go its lists and the queries, a chunk after the other. A task holds one block and a
    chunk's lists of it, and passes on k rows for each query.
    """
    spark = docs.sparkSession
    tables = Tables(spark)

    def asked(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in set(terms_of(t))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.binary())], names=["item", "term"])

    wanted = tables.write(map_batches(queries.select(F.col(query_key), utf8(query_text)), f"item {dict(queries.dtypes)[query_key]}, term binary", asked).distinct())
    lists = tables.write(inverted(docs, key, text))
    heads = lists.where("term is null").select("block", "n_rows", "n_terms", "ids")
    n, total = heads.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counted = lists.where("term is not null").join(broadcast_if_small(wanted.select("term").distinct(), F.octet_length("term") + 16), "term", "left_semi").groupBy("term").agg(F.sum("n_rows").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    terms = tables.write(counted.select("term", F.monotonically_increasing_id().alias("no"), weight.alias("w")))
    items = wanted.join(terms, "term").groupBy("item").agg(F.collect_set("no").alias("terms"))
    items = tables.write(items.select(F.monotonically_increasing_id().alias("query"), "item", "terms"))
    index = tables.write(impacts(lists.where("term is not null").join(broadcast_if_small(terms.where("w > 0"), F.octet_length("term") + 32), "term"), n, total))

    # parts of blocks as long as they come, one row for each: they begin at a new word of the bitmaps
    room = F.greatest(F.ceil(F.col("n_rows") / 64) * 64, F.ceil(F.col("n_terms") * (BLOCK_ROWS / BLOCK_TERMS) / 64) * 64)
    before = F.coalesce(F.sum("room").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = heads.withColumn("room", room).withColumn("before", before).withColumn("whole", F.floor(F.col("before") / BLOCK_ROWS))
    parts = tables.write(whole.select("block", "n_rows", "ids", "whole", (F.col("before") - F.min("before").over(Window.partitionBy("whole"))).alias("first")))
    chunks = max(1, -(-items.count() // CHUNK_QUERIES))
    chunked = items.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)))
    row = lambda kind, **own: [*("whole", "chunk"), F.lit(kind).alias("kind"), *(own.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("name", "long"), ("first", "long"), ("n_rows", "long"), ("body", "binary"), ("slices", "binary"), ("terms", "array<bigint>")))]
    each = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")).alias("chunk")
    names = parts.select("whole", "first", "n_rows", "ids", each).select(*row(0, first=F.col("first"), n_rows=F.col("n_rows"), body=F.col("ids")))
    of_chunks = chunked.select("chunk", F.explode("terms").alias("no")).distinct()
    bodies = index.join(parts.select("block", "whole", "first"), "block").join(of_chunks, "no").select(*row(1, name=F.col("no"), first=F.col("first"), body=F.col("at"), slices=F.col("slices")))
    everywhere = parts.select("whole").distinct().join(F.broadcast(chunked) if chunks == 1 else chunked).select(*row(2, name=F.col("query"), terms=F.col("terms")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held, block = None, [], {}, None
        for batch in batches:
            found: list[tuple[int, int | None, int]] = []
            for whole, chunk, kind, name, first, n_rows, body, slices, asked_for in zip(*batch.columns, strict=True):
                if (whole.as_py(), chunk.as_py()) != at:
                    at, ids, held, block = (whole.as_py(), chunk.as_py()), [], {}, None
                if kind.as_py() == 0:
                    ids.append((first.as_py(), n_rows.as_py(), body.as_py()))
                elif kind.as_py() == 1:
                    held.setdefault(name.as_py(), []).append((first.as_py(), body.as_py(), slices.as_py()))
                else:
                    if block is None:
                        block, held = Block(ids, held), {}
                    found += [(name.as_py(), *best) for best in block.top(asked_for.as_py(), k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query", "doc_id", "score"])

    met = names.unionByName(bodies).unionByName(everywhere).repartition("whole", "chunk").sortWithinPartitions("whole", "chunk", "kind")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = met.mapInArrow(run, "query long, doc_id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return tables.last(top.join(items.select("query", "item"), "query").select(F.col("item").alias("item_id"), "rank", "doc_id", "score"))


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(documents, benchmark)
