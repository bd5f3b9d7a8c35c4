"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece of text is encoded by halves, recursively down to single bytes. Two encoded neighbours are joined by re-encoding
a window of tokens around their border. The window grows until the tokens outside provably stay as
they are: a sequence of tokens is the BPE encoding of its bytes exactly if every pair of adjacent tokens encodes to
itself, so a join may stop once the pairs at both ends of the window do. Pieces never merge across a match of the split
pattern, so encodings of whole pieces are joined by concatenation, and decoding concatenates bytes up a tree as well.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import kept, map_batches, utf8

#: Subtrees of up to this many bytes are shared: many pieces have the same ones.
SHARED_BYTES = 6
#: Windows of up to this many bytes are merged over a plain list, longer ones over a heap; the merges are the same.
SHORT_WINDOW = 128
#: Ids that a leaf of the decoding tree looks up at once.
LEAF_IDS = 256
#: Pieces, and subtrees and pairs of tokens, that a worker remembers; beyond it the memory is emptied, so a worker's size
#: doesn't depend on the corpus.
REMEMBERED, REMEMBERED_PARTS = 300_000, 300_000
_END = 1 << 60
#: The name of this operator among what a worker keeps.
KIND = "bpe"


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line)}


class TreeEncoder:
    """Encodes single pieces. ranks: token bytes to id, a lower id merging first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.shared: dict[bytes, list[int]] = {}
        self.joins = 0

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece; one that is a token by itself is that token, as in the library."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) == 1:
            return [self.ranks[piece]]
        short = len(piece) <= SHARED_BYTES
        if short and (known := self.shared.get(piece)):
            return known
        half = len(piece) // 2
        self.joins += 1
        ids = self.join(self.tree(piece[:half]), self.tree(piece[half:]))
        if short:
            if len(self.shared) >= REMEMBERED_PARTS:
                self.shared.clear()
            self.shared[piece] = ids
        return ids

    def merged(self, piece: bytes) -> list[int]:
        """Re-encodes a window: merges the adjacent pair of lowest rank, the leftmost of equals, until no pair has a rank."""
        ranks = self.ranks
        if len(piece) > SHORT_WINDOW:
            return self.merged_by_heap(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [ranks.get(piece[i : i + 2], _END) for i in range(len(piece) - 1)]
        while pair:
            best = min(pair)
            if best == _END:
                break
            i = pair.index(best)
            parts[i : i + 2] = [merged := parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + merged, _END)
            if i < len(pair):
                pair[i] = ranks.get(merged + parts[i + 1], _END)
        return [ranks[x] for x in parts]

    def merged_by_heap(self, piece: bytes) -> list[int]:
        """The same merges by a heap over a linked list: windows that grow long stay at n log n."""
        ranks, n = self.ranks, len(piece)
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or end[j] != to or not alive[j]:
                continue
            end[i], alive[j], right[i] = to, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if (k := left[i]) >= 0 and (r := ranks.get(piece[k:to])) is not None:
                heapq.heappush(heap, (r, k, to))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def keeps(self, a: int, b: int) -> bool:
        """Whether the pair of tokens encodes to itself."""
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) >= REMEMBERED_PARTS:
                self.stable.clear()
            known = self.stable[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b or self.keeps(a[-1], b[0]):
            return a + b
        from_left = from_right = 1
        while True:
            from_left, from_right = min(from_left, len(a)), min(from_right, len(b))
            window = self.merged(b"".join(self.bytes_of[t] for t in (*a[len(a) - from_left :], *b[:from_right])))
            left_ok = from_left == len(a) or self.keeps(a[-from_left - 1], window[0])
            right_ok = from_right == len(b) or self.keeps(window[-1], b[from_right])
            if left_ok and right_ok:
                return a[: len(a) - from_left] + window + b[from_right:]
            from_left, from_right = from_left * (1 if left_ok else 2), from_right * (1 if right_ok else 2)


class _Pieces(dict):
    """A piece of text to its ids as little-endian int32 bytes."""

    def __init__(self, encoder: TreeEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids = np.array(self.encoder.encode(piece.encode()), "<i4").tobytes()
        return ids


class _Vocabulary:
    def __init__(self, blob: bytes, pattern: str):
        ranks = read_ranks(blob)
        self.pieces = _Pieces(TreeEncoder(ranks))
        self.find = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        tokens = [self.pieces.encoder.bytes_of.get(i, b"") for i in range(size)]
        self.length = np.array([len(x) for x in tokens], "i8")
        self.start = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(tokens), "u1")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, concatenated up a tree: those of the left half, then those of the right."""
        if len(ids) <= LEAF_IDS:
            return self.concatenated(ids).tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def concatenated(self, ids: np.ndarray) -> np.ndarray:
        """A leaf of it: the bytes of ids, one token's after another's."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id has no token")
        length = self.length[ids]
        before = np.cumsum(length) - length
        return self.table[np.repeat(self.start[ids] - before, length) + np.arange(length.sum())]

    def encoded(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each whole text, given as UTF-8; null and empty texts get an empty list."""
        get = self.pieces.__getitem__
        each = [b"".join(map(get, self.find(str(t, "utf-8", "replace")))) if t else b"" for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in each)]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(each))]))

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; a null list gives null."""
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        return pa.array([self.decode(flat[a:b]) if known else None for a, b, known in zip(bounds[:-1], bounds[1:], lists.is_valid().to_pylist(), strict=True)], pa.binary())

    @classmethod
    def of(cls, blob: bytes, pattern: str) -> _Vocabulary:
        """One for each worker, kept between the tasks of this operator."""
        return kept(KIND, (hash(blob), pattern), lambda: cls(blob, pattern))


def _others(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def _vocabulary_blob(df: DataFrame, vocabulary: str):
    """The vocabulary file as a broadcast; its size is that of the file, whatever the corpus."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, vocabulary: str, pattern: str, read: Column, columns: list[str], made: dict[str, str], work: Callable[[_Vocabulary, pa.Array], list[pa.Array]]) -> DataFrame:
    """columns of df and those made (name to type) by work out of read. A map without a shuffle: lost executors cost their own tasks only."""
    blob = _vocabulary_blob(df, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = work(_Vocabulary.of(blob.value, pattern), batch.column(batch.num_columns - 1))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*columns, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns), *(f"`{name}` {kind}" for name, kind in made.items())])
    return map_batches(df.select(*(F.col(f"`{c}`") for c in columns), read.alias("__read")), schema, run, keeps=KIND)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """docs (their columns keep, or all) with an array<int> column out: the ids of each whole text. Null and empty texts get an empty array.

    A column that already has the name out is replaced; other columns pass through. No row is split, moved or dropped.
    """
    return _mapped(docs, vocabulary, pattern, utf8(text), _others(docs, out) if keep is None else keep, {out: "array<int>"}, lambda v, texts: [v.encoded(texts)])


def decode(tokens: DataFrame, vocabulary: str, pattern: str, ids: str = "tokens", out: str = "decoded") -> DataFrame:
    """tokens with a binary column out: the bytes of each row's ids, concatenated. Null ids give null; unknown ids raise."""
    return _mapped(tokens, vocabulary, pattern, F.col(f"`{ids}`"), _others(tokens, out), {out: "binary"}, lambda v, lists: [v.decoded(lists)])


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "tokens", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """docs (their columns keep, or all) with the columns of encode and then decode, by one worker: out is decoded from ids, not from the text."""

    def both(v: _Vocabulary, texts: pa.Array) -> list[pa.Array]:
        lists = v.encoded(texts)
        return [lists, v.decoded(lists)]

    return _mapped(docs, vocabulary, pattern, utf8(text), _others(docs, ids, out) if keep is None else keep, {ids: "array<int>", out: "binary"}, both)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded again."""
    both = round_trip(docs, vocabulary, pattern, keep=["doc_id"])
    return both.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.array_join("tokens", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
