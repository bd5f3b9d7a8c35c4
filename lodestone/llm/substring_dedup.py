"""Removal of repeated word sequences by suffix automata of reference shards.

Documents are streamed through suffix automata of the text before them; a word whose matching statistic reaches the
threshold ends a repeated window. One automaton of a whole corpus fits no machine, and a broadcast of many would meet
every document with every shard, so both are routed instead: the smallest hash among a window's inner word sequences (its
minimiser) names the shard, and equal windows have equal minimisers. Neighbouring windows of one minimiser form a segment.
Segments whose minimiser is alone in the corpus repeat nothing and go no further. Segments of the same words are one entry
of their shard, in the corpus order of its first occurrence: it goes through the automaton once, and its statistics hold
for all its copies. A shard of more than SHARD_SEGMENTS entries is dealt anew by the minimisers of longer inner sequences,
at last by whole windows, so an automaton's size has a bound whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Tables, broadcast_if_small, map_batches, utf8, workers_ready
from lodestone.llm.hashing import WORDS, mixed, range_hashes, word_hashes

#: Words of the inner sequences among which a window's minimiser is chosen, level by level; the last level's are windows.
INNER = (5, 12)
#: Entries that one automaton takes.
SHARD_SEGMENTS = 2_000
#: Words that are hashed at once; their places are packed into 24 bits.
WORDS_AT_ONCE, PLACE_BITS = 1 << 22, 24
#: Copies of an entry beyond which they meet it by a broadcast.
MANY_COPIES = 1_000
#: Bits of a segment's hash that count; words decide where hashes collide.
SEGMENT_MASK = -1
#: What names a window: the document, which of the texts under its doc_id, and the window's first word.
PLACE = ("doc_id", "tie", "first")


class SuffixAutomaton:
    """A generalised suffix automaton over word sequences that grows while it is matched."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state for the longest string of p and word; a copy is split off where the edge leads to longer strings."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def statistics(self, words: Iterable[bytes]) -> Iterator[int]:
        """For each word the length of the longest sequence that ends there and has also ended earlier; adds the words."""
        at = 0
        for n, word in enumerate(words, 1):
            if word in self.next[at]:
                at = self._split(at, word)
                yield n
                continue
            new, p = self._state(n, 0, {}), at
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word)
            at = new
            yield self.length[self.link[new]]


def _chunks(split: list[list[bytes]], length: int) -> Iterator[tuple[list[int], list[list[bytes]], list[int]]]:
    """(text, words, first word) of the texts in groups of at most WORDS_AT_ONCE words; longer texts overlap by length - 1."""
    text, words, first, held = [], [], [], 0
    for i, own in enumerate(split):
        for at in range(0, max(1, len(own) - length + 1), WORDS_AT_ONCE - length + 1):
            part = own[at : at + WORDS_AT_ONCE] if len(own) > WORDS_AT_ONCE else own
            if held and held + len(part) > WORDS_AT_ONCE:
                yield text, words, first
                text, words, first, held = [], [], [], 0
            text.append(i)
            words.append(part)
            first.append(at)
            held += len(part)
    if text:
        yield text, words, first


def segments(split: list[list[bytes]], length: int, inner: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimiser, hash of the segment's words) for each segment of the texts' words.

    A window is named by its first word. Windows within one text only; texts of fewer words have none.
    """
    found = [_segments(*chunk, length, inner) for chunk in _chunks(split, length)]
    return tuple(np.concatenate([np.zeros(0, "i8"), *(f[i] for f in found)]) for i in range(5))


def _segments(texts: list[int], split: list[list[bytes]], origins: list[int], length: int, inner: int) -> tuple[np.ndarray, ...]:
    n = np.fromiter(map(len, split), "i8", len(split))
    hashes = word_hashes([w for words in split for w in words])
    total, none = len(hashes), tuple(np.zeros(0, "i8") for _ in range(5))
    if total < length:
        return none
    starts = np.arange(total - inner + 1)
    sequence = range_hashes(hashes, WORDS, starts, starts + inner)
    # the place breaks ties to the left, alike in equal windows
    place = np.uint64(PLACE_BITS)
    least = mixed(sequence) >> place << place | starts.astype("u8")
    span, reach = length - inner + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype("i8")  # the minimiser of the window at each word
    first_word = np.cumsum(n) - n
    text = np.repeat(np.arange(len(split)), n)[: len(at)]
    window = np.arange(len(at))
    fits = window + length <= (first_word + n)[text]
    window, at, text = window[fits], at[fits], text[fits]
    if not len(window):
        return none
    begins = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    ends = np.append(begins[1:], len(window))
    own, first, n = text[begins], window[begins], ends - begins
    words = range_hashes(hashes, WORDS, first, first + n + length - 1)
    return np.array(texts)[own], first - first_word[own] + np.array(origins)[own], n, sequence[at[begins]].view("i8"), words.view("i8")


def _named(docs: DataFrame) -> DataFrame:
    """docs (doc_id, b, ...) with tie: 0, or the text's hash where a doc_id has several texts. Rows without either go."""
    own = docs.where("doc_id is not null and b is not null")
    hashed = own.select("doc_id", F.xxhash64("b").alias("h"))
    several = hashed.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a < z").select("doc_id", F.lit(True).alias("several"))
    several = broadcast_if_small(several, F.lit(32))
    return own.join(several, "doc_id", "left").withColumn("tie", F.when(F.col("several"), F.xxhash64("b")).otherwise(F.lit(0).cast("long"))).drop("several")


def _packed(docs: DataFrame, name: str) -> DataFrame:
    """docs with the binary column `name`, the last one, compressed: texts that are shuffled take half the disk."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        values = pa.array([None if x is None else pack(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=batch.schema.names)

    assert docs.columns[-1] == name
    return map_batches(docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), run)


def _unpacked(values: pa.Array) -> list[bytes | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if x is None else unpack(x) for x in values.to_pylist()]


def _routed(parts: DataFrame, length: int, inner: int) -> DataFrame:
    """(m, seg, doc_id, tie, base, first, windows) of all segments of parts of documents (doc_id, tie, base, b); base is a part's first word."""
    mask = SEGMENT_MASK

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, first, windows, m, seg = segments([t.split() for t in batch.column(3).to_pylist()], length, inner)
        at = pa.array(text)
        first = first + batch.column(2).to_numpy()[text]
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(seg & mask), *(batch.column(i).take(at) for i in range(3)), pa.array(first.astype("i4")), pa.array(windows.astype("i4"))], names=["m", "seg", "doc_id", "tie", "base", "first", "windows"])

    return map_batches(parts.select("doc_id", "tie", "base", "b"), "m long, seg long, doc_id long, tie long, base int, first int, windows int", run)


def _cut(parts: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """rows (m, seg, doc_id, tie, base, first, windows, copy, large, whole) with a digest (a, z) of their words, and with the words themselves where whole."""
    own = ("m", "seg", "first", "windows", "copy", "large", "whole")
    wanted = rows.groupBy("doc_id", "tie", "base").agg(F.collect_set(F.struct(*own)).alias("cuts"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(4)
        n = lists.value_lengths().to_numpy()
        of = np.repeat(np.arange(len(n)), n)
        flat = dict(zip(own, lists.flatten().flatten(), strict=True))
        begin = (flat["first"].to_numpy() - batch.column(2).to_numpy()[of]).tolist()
        stop = (flat["first"].to_numpy() - batch.column(2).to_numpy()[of] + flat["windows"].to_numpy() + length - 1).tolist()
        whole, at = flat["whole"].to_pylist(), 0
        digests, words = [], []
        for text, k in zip(_unpacked(batch.column(3)), n.tolist(), strict=True):
            split = text.split()
            for i in range(at, at + k):
                cut = b" ".join(split[begin[i] : stop[i]])
                digests.append(hashlib.blake2b(cut, digest_size=16).digest())
                words.append(cut if whole[i] else None)
            at += k
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        at = pa.array(of)
        columns = [flat["m"], flat["seg"], *(batch.column(i).take(at) for i in range(3)), *(flat[c] for c in ("first", "windows", "copy", "large")), *(pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)), pa.array(words, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    packed = _packed(parts.select("doc_id", "tie", "base", "b"), "b").join(wanted, ["doc_id", "tie", "base"])
    schema = "m long, seg long, doc_id long, tie long, base int, first int, windows int, copy int, large int, a long, z long, words binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return map_batches(packed.select("doc_id", "tie", "base", "b", "cuts"), schema, run)


def _matched(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, tie, first, windows) of runs of repeated windows, by the automaton of each minimiser's entries; rows: (m, doc_id, tie, first, words)."""
    workers_ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, automaton = None, None, SuffixAutomaton()
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for m, doc_id, tie, first, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if m != shard:
                    shard, automaton = m, SuffixAutomaton()
                elif (doc_id, tie, first) == last:  # rows that repeat a document
                    continue
                last = doc_id, tie, first
                open_, begin = False, 0
                for i, s in enumerate(automaton.statistics(words.split(b" ")), 1 - length):
                    if s >= length and not open_:
                        open_, begin = True, i
                    elif s < length and open_:
                        found.append((doc_id, tie, first + begin, i - begin))
                        open_ = False
                if open_:
                    found.append((doc_id, tie, first + begin, i + 1 - begin))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[*PLACE, "windows"])

    return rows.repartition("m").sortWithinPartitions("m", *PLACE).mapInArrow(run, "doc_id long, tie long, first int, windows int")


def _marked(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows with copy (1: not the first occurrence of its entry), large (1: its shard is) and whole (its words are needed).

    Rows that neither have copies nor meet other entries go. Entries of many copies are few and are broadcast, behind a
    check of their size; the others are joined by a shuffle.
    """
    known = entries.where("n > 1 or entries > 1").select("m", "seg", "n", "entries", F.struct(*PLACE).alias("origin"))
    hot = broadcast_if_small(known.where(F.col("n") > MANY_COPIES).drop("n"), F.lit(96))
    cold = known.where(F.col("n") <= MANY_COPIES).drop("n")
    by_hot = rows.join(hot, ["m", "seg"], "left")
    of_cold = by_hot.where("origin is null").drop("origin", "entries").join(cold, ["m", "seg"])
    both = by_hot.where("origin is not null").unionByName(of_cold)
    copy = (F.struct(*PLACE) > F.col("origin")).cast("int")
    return both.select("m", "seg", "doc_id", "tie", "base", "first", "windows", copy.alias("copy"), (F.col("entries") > SHARD_SEGMENTS).cast("int").alias("large"), ((copy == 0) & (F.col("entries") > 1)).alias("whole"))


def repeated_spans(docs: DataFrame, length: int = 20) -> DataFrame:
    """(doc_id, tie, spans): maximal spans [from, to) of words that lie in windows of `length` words which also start earlier.

    docs: (doc_id long, tie long, b binary). Earlier means a smaller doc_id, then a smaller tie, or the same document and
    an earlier start. Documents without a repeated window have no row; rows that repeat a document repeat nothing by
    themselves.
    """
    tables = Tables(docs.sparkSession)
    parts, found = docs.select("doc_id", "tie", F.lit(0).alias("base"), "b"), []
    levels = [*(i for i in INNER if i < length), length]
    for inner in levels:
        routed = _routed(parts, length, inner)
        # counts are cut off before they are joined: a join straight over an aggregate can't split a frequent minimiser
        shared = tables.write(routed.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m"))
        rows = tables.write(routed.join(shared, "m", "left_semi"), "doc_id", "tie")
        least = F.min(F.struct(*PLACE)).alias("at")
        entries = tables.write(rows.groupBy("m", "seg").agg(least, F.count("*").alias("n")).select("m", "seg", "at.*", "n"))
        sizes = tables.write(entries.groupBy("m").agg(F.count("*").alias("entries")).where("entries > 1"))
        sized = entries.join(sizes, "m", "left").withColumn("entries", F.coalesce("entries", F.lit(1)))
        told = tables.write(_cut(parts, _marked(rows, sized), length))
        # rows of one entry have the same words, unless their hashes collide: then each is an entry
        collided = told.groupBy("m", "seg").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("z").alias("z0"), F.max("z").alias("z1")).where("a0 < a1 or z0 < z1")
        collided = tables.write(collided.select("m", "seg"))
        copies, entered = told.where("copy = 1"), told.where("words is not null")
        if not collided.isEmpty():
            copies, entered = (x.join(collided, ["m", "seg"], "left_anti") for x in (copies, entered))
            apart = told.join(collided, ["m", "seg"], "left_semi").select("m", "seg", "doc_id", "tie", "base", "first", "windows", F.lit(0).alias("copy"), "large", F.lit(True).alias("whole"))
            entered = entered.unionByName(tables.write(_cut(parts, apart, length)))
        found.append(copies.select(*PLACE, "windows"))
        last = inner == length
        found.append(tables.write(_matched(entered.where(F.lit(last) | (F.col("large") == 0)).select("m", *PLACE, "words"), length)))
        parts = entered.where("large = 1").select("doc_id", "tie", F.col("first").alias("base"), F.col("words").alias("b"))
        if last or parts.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    span = F.struct(F.col("first").alias("from"), (F.col("first") + F.col("windows") + length - 1).alias("to"))
    return tables.last(every.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(span)).alias("spans")))


_WORD = re.compile(rb"[^ \t-\r]+")


def without_words(text: bytes, stays: np.ndarray) -> bytes:
    """text without the words that don't stay and the white space behind them, or before them at the end; all else as it is."""
    if stays.all():
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, begin = [], 0
    for i in np.flatnonzero(~stays).tolist():
        out.append(text[begin : at[i][0]] if begin < at[i][0] else b"")
        begin = at[i + 1][0] if i + 1 < len(at) else at[i][1]
    joined = b"".join(out)
    return (joined if stays[-1] else joined.rstrip()) + text[begin:]


def remove_repeats(docs: DataFrame, length: int = 20, text: str = "text", keep: list[str] | None = None, layout: bool = False) -> DataFrame:
    """docs (their columns keep, or all), with the kept words of each text joined by one space, n_words and n_removed.

    With layout the white space between kept words stays as it is, so a text that loses nothing is unchanged.

    Words lie between ASCII white space; every word of a repeated window goes, windows being judged on the input. A null
    or empty text has no words and stays as it is (null: null), a row without a doc_id keeps all of its words. Rows of one
    doc_id and one text are one document; rows of one doc_id and different texts are different ones, in the order of a hash
    of their text. Any 64-bit doc_id and texts of any length will do. Columns of docs named n_words or n_removed are
    replaced, others pass through whatever their names.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "n_removed", text.lower())]
    named = _named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("b")))
    spans = repeated_spans(named, length)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n, gone = [], [], []
        for value, found in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = value.split() if value else []
            n.append(len(words))
            stays = np.ones(len(words), bool)
            if found:
                for s in found:
                    stays[s["from"] : s["to"]] = False
                words = [words[i] for i in np.flatnonzero(stays)]
            gone.append(n[-1] - len(words))
            texts.append(None if value is None else without_words(value, stays) if layout else b" ".join(words))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["row", "b", "n_words", "n_removed"])

    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept))
    whole = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("b"))
    several = spans.where("tie <> 0").select("doc_id").distinct().withColumn("several", F.lit(True))
    tied = whole.join(broadcast_if_small(several, F.lit(32)), "doc_id", "left")
    tie = F.when(F.col("several"), F.xxhash64("b")).otherwise(F.lit(0).cast("long"))
    packed = _packed(tied.select("row", "doc_id", tie.alias("tie"), "b"), "b")
    joined = packed.join(spans, ["doc_id", "tie"], "left").select("row", "b", "spans")
    fields = [f for f in joined.schema["row"].dataType.fields]
    schema = "row struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields) + ">, b binary, n_words long, n_removed long"
    done = map_batches(joined, schema, run)
    return done.select(*(F.col(f"row.`{c}`") for c in kept), F.col("b").cast("string").alias(text), "n_words", "n_removed")


def query(docs: DataFrame, length: int = 20) -> DataFrame:
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    return remove_repeats(docs, length, keep=["doc_id"]).select("doc_id", "n_words", "n_removed", kept)
