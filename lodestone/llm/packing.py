"""Best-fit packing of tokenized documents into training sequences, in bounded space and online.

A task reads its documents once. It tokenizes each, closes it with an end id, cuts what is longer than a sequence, and
places every piece at once: among a fixed number of open sequences the one with the least free space that still holds the
piece takes it. Free spaces are the bits of one integer, so that the best fit is its lowest set bit from the piece's
length upward. If none fits, a new sequence opens; if too many are open, the fullest closes first.

What tasks leave open is small: at most OPEN rows a task. Those sequences are then pieces themselves, packed by fewer
tasks in each round until one task holds the rest, so that the number of tasks leaves no trace in the number of sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Tables, forget_others, kept, utf8, workers_ready

#: Tokens of a sequence; the id that ends a document; sequences that a task holds open.
CAPACITY, END_ID, OPEN = 4096, 1, 512

#: Open sequences that a task of a later round takes, as a multiple of those that it may leave.
FAN_IN = 16

#: Words whose ids a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST_WORD = 600_000, 48

#: Rows that a task tokenizes at once, of Arrow batches that are small already.
ROWS = 256

KIND = "packing"


class OpenBins:
    """At most limit open bins of a capacity, in a bitset keyed by free space. Numbers of bins count from 0."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN):
        self.capacity, self.limit = capacity, limit
        self.spaces, self.by_space, self.held, self.opened = 0, {}, 0, 0

    def _take(self, space: int) -> int:
        """An open bin with this free space: the one that got it last."""
        bins = self.by_space[space]
        taken = bins.pop()
        if not bins:
            del self.by_space[space]
            self.spaces &= ~(1 << space)
        self.held -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece of this length (from 1 to the capacity), and its offset there."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            taken = self._take(space)
        else:
            space, taken = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:  # a full bin closes by itself
            if self.held == self.limit:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            self.by_space.setdefault(left, []).append(taken)
            self.spaces |= 1 << left
            self.held += 1
        return taken, self.capacity - space

    def left_open(self) -> list[tuple[int, int]]:
        """(bin, tokens in it) of those still open."""
        return [(b, self.capacity - space) for space, bins in sorted(self.by_space.items()) for b in bins]


#: Signs that end a word so often that they are worth a part of their own.
_TAIL = b".,;:!?"

#: A character that stands alone between the words that are encoded together, and the lead bytes of combining marks.
_BETWEEN, _MARKS = b"\x01", (b"\xcc", b"\xcd")


class WordIds:
    """The ids of texts as bytes of little-endian 32-bit numbers, word by word.

    The tokenizer drops white space before it merges anything, and its normaliser joins nothing across it, so the ids of a
    text are those of its words between ASCII white space, one after another. Words that come again are looked up, in
    lower case, as the normaliser makes them (it composes marks first, so texts with combining marks are left as they are).
    New words are encoded together, a lone character between two of them, whose id tells them apart again. Signs after
    letters are a part of their own for the tokenizer, and so they are here.
    """

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(blob)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        between = self.encoded(_BETWEEN)
        self.between = int(between[0]) if len(between) == 1 else None
        self.words: dict[bytes, bytes] = {}

    def encoded(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, new: set[bytes]) -> list[bytes]:
        """Adds words, and the parts of which they are made, to those known; these."""
        cut = {}
        for word in new:
            if word[-1] in _TAIL and (stem := word.rstrip(_TAIL)) and stem.decode("utf-8", "replace").isalpha():
                cut[word] = stem, word[len(stem) :]
        fresh = new.difference(cut)
        for both in cut.values():
            fresh.update(both)
        fresh = list(fresh.difference(self.words))
        ids = self.encoded((b" " + _BETWEEN + b" ").join(fresh)) if fresh else np.zeros(0, "<u4")
        stops = np.flatnonzero(ids == self.between)
        if fresh and len(stops) == len(fresh) - 1:
            body, starts = ids.tobytes(), [0, *(4 * stops + 4).tolist()]
            self.words.update((w, body[i:j]) for w, i, j in zip(fresh, starts, [*(4 * stops).tolist(), len(body)], strict=True))
        else:  # that character is in the words themselves, or no id of its own
            self.words.update((w, self.encoded(w).tobytes()) for w in fresh)
        known = self.words
        known.update([(w, known[stem] + known[tail]) for w, (stem, tail) in cut.items()])
        return [*fresh, *cut]

    def of(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each whole text; none for null."""
        split = [((t if any(m in t for m in _MARKS) else t.lower()).split()) if t else [] for t in texts]
        new = self.learn(set().union(*split).difference(self.words))
        get = self.words.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        for word in new:
            if len(word) > LONGEST_WORD:
                self.words.pop(word, None)
        return out


def _ids_of(blob: bytes) -> WordIds:
    return kept(KIND, hash(blob), lambda: WordIds(blob))


def _numbered(turn: int, part: int) -> int:
    """The first of the numbers of bins that a task of a round may give: they differ from any other task's."""
    return turn << 58 | part << 34


_PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, bin long, offset long"
_MOVES = "bin long, used long, into long, base long"


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of every piece of every row of docs.

    tokenizer: a file of the tokenizers library whose pre-tokenizer drops white space. A document's ids are those of its
    whole text, without special tokens, then end_id. Only documents of more than capacity ids are cut: into pieces of
    capacity ids, the last of which may be shorter. A sequence holds at most capacity ids, without a gap from 0.

    Null and empty texts are the end id alone. Rows that repeat an id, or a whole row, or have no id, are documents of their
    own. No text is too long: it is cut into as many pieces as it needs. An empty table has no pieces. Other columns don't
    matter. ids (little-endian 32-bit) is null unless with_ids. Which sequence a piece is in depends on how the rows are
    split over tasks; the pieces don't.
    """
    spark = docs.sparkSession
    workers_ready(spark)
    with open(tokenizer, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())  # of the file's size, whatever the corpus
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "bin", "offset"]
    tables = Tables(spark)

    def rows(doc_ids: list, at: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        columns = list(zip(*at, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, key_type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(KIND)
        bins, base, key_type = OpenBins(capacity, open_bins), _numbered(0, TaskContext.get().partitionId()), None
        for batch in batches:
            key_type = batch.column(0).type
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                texts = _ids_of(blob.value).of(part.column(1).to_pylist())
                cut = [(doc_id, piece, at, ids[4 * at : 4 * (at + capacity)]) for doc_id, body in zip(part.column(0).to_pylist(), texts, strict=True) for ids in (body + end,) for piece, at in enumerate(range(0, len(ids) // 4, capacity))]
                cut.sort(key=lambda x: -len(x[3]))  # of the rows at hand, the longest pieces first
                yield rows([x[0] for x in cut], [(piece, at, len(own) // 4, zlib.crc32(own), own if with_ids else None, base + taken, offset) for _, piece, at, own in cut for taken, offset in (bins.place(len(own) // 4),)], key_type)
        if still := bins.left_open():  # rows without a piece
            yield rows([None] * len(still), [(None, None, used, None, None, base + b, None) for b, used in still], key_type)

    placed = tables.write(docs.select(F.col(key).alias("doc_id"), utf8(text).alias("text")).mapInArrow(first, _PIECES.format(kind=kind)))
    left = placed.where("piece is null").select("bin", F.col("length").alias("used"))
    pieces = placed.where("piece is not null")
    count, turn, moved = left.count(), 0, None
    while count > 1:
        turn, parts = turn + 1, -(-count // (FAN_IN * open_bins))
        step = tables.write(_merged(left, parts, turn, capacity, open_bins))
        last = step.where("into is not null").select("bin", "into", "base")
        if moved is None:
            moved = last
        else:
            after = last.select(F.col("bin").alias("into"), F.col("into").alias("onward"), F.col("base").alias("more"))
            moved = moved.join(after, "into", "left").select("bin", F.coalesce("onward", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        if parts == 1:
            break
        left = step.where("into is null").select("bin", "used")
        count = left.count()
    here, there = (F.col("bin"), F.col("offset")) if moved is None else (F.coalesce("into", "bin"), F.col("offset") + F.coalesce("base", F.lit(0)))
    joined = pieces if moved is None else pieces.join(moved, "bin", "left")
    return tables.last(joined.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", here.alias("sequence_id"), there.alias("offset")))


def _merged(left: DataFrame, parts: int, turn: int, capacity: int, open_bins: int) -> DataFrame:
    """(bin, into, base) of each open bin of left, packed whole into bins of this round, the fullest first; (bin, used) of those left open."""
    types = [pa.int64()] * 4

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), _numbered(turn, TaskContext.get().partitionId())
        for batch in batches:
            at = [(b, None, base + (put := bins.place(used))[0], put[1]) for b, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*at, strict=True), types, strict=True)], names=["bin", "used", "into", "base"])
        if still := bins.left_open():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((base + b, used, None, None) for b, used in still), strict=True), types, strict=True)], names=["bin", "used", "into", "base"])

    return left.repartition(parts, "bin").sortWithinPartitions(F.desc("used"), "bin").mapInArrow(again, _MOVES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids array<int>): the packed sequences themselves, each at most a capacity long."""
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(bodies, "").alias("hex"))
    pairs = lambda at, i: F.substring(F.col("hex"), at * 8 + 7 - 2 * i, F.lit(2))
    number = lambda at: F.conv(F.concat(*(pairs(at, i) for i in range(4))), 16, 10).cast("int")
    return whole.select("sequence_id", "n_tokens", F.transform(F.sequence(F.lit(0), F.col("n_tokens").cast("int") - 1), number).alias("ids"))


def query(documents: DataFrame, tokenizer: str) -> DataFrame:
    return pack(documents, tokenizer, with_ids=False).drop("ids")
