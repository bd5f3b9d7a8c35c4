"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``distance`` bits agree in at least 8 - distance of their 8 bytes. The
index posts every distinct fingerprint under combinations of (position, byte); the combinations are few, but any set of
8 - distance positions holds one of them. Inside a posting list the shared positional bytes of a pair are tallied as the
zero bytes of its XOR; pairs below the guaranteed minimum are left and the rest are verified by their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_if_small, checkpointed, hex_of_long, workers_ready, map_batches, utf8
from lodestone.llm.graph import connected_components

#: Posting lists of up to this many fingerprints are compared by shifts of the whole partition, longer ones one by one.
SHORT_LIST = 48
#: Mean length of a posting list beyond which the index takes one byte more for each key.
MEAN_LIST = 256
#: Length of a posting list beyond which it is dealt by further bytes.
LONG_LIST = 2048


def fingerprint(text: bytes | None, width: int) -> int:
    """The SimHash of a text over its width-word shingles, repeats included, as an unsigned integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        cuts = map(joined.__getitem__, map(slice, starts, (ends[width - 1 :] - 1).tolist()))
        hashes = list(map(xxhash.xxh64_intdigest, cuts, repeat(42)))
    bits = np.unpackbits(np.array(hashes, ">u8").view("u1").reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype="i8") > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp long): A-Z lower-cased, words between ASCII white space, whole texts. Texts without a word get 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], "u8").view("i8")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("b")), "doc_id long, fp long", run)


def designs(size: int, distance: int) -> list[tuple[int, ...]]:
    """Combinations of ``size`` of 8 positions such that any 8 - distance positions hold one of them.

    Positions are dealt into as few groups as leave size of any 8 - distance positions in one group; a combination lies
    within a group. With distance 4: all 7 pairs within 3, 3 and 2 positions, or else all combinations of one group.
    """
    sure = 8 - distance
    groups = max(1, (sure - 1) // (size - 1)) if size > 1 else 8
    if size == 1:
        return [(i,) for i in range(8 - sure + 1)]
    dealt = [range(g, 8, groups) for g in range(groups)]
    return [c for own in dealt for c in combinations(own, size)]


def _links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links within each run of equal keys; keys are sorted."""
    cut = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    length = np.diff(np.append(cut, len(keys)))
    long = length > SHORT_LIST
    left, right = [np.zeros(0, "u8")], [np.zeros(0, "u8")]

    def verified(x: np.ndarray) -> np.ndarray:
        tally = (x.view("u1").reshape(-1, 8) == 0).sum(1)
        found = tally >= 8 - distance
        found[found] = np.bitwise_count(x[found]) <= distance
        return found

    in_short = np.repeat(~long, length)
    k, f = keys[in_short], fps[in_short]
    for shift in range(1, int(length[~long].max(initial=1))):
        same = np.flatnonzero(k[shift:] == k[:-shift])
        same = same[verified(f[same] ^ f[same + shift])]
        left.append(f[same])
        right.append(f[same + shift])
    for at, n in zip(cut[long], length[long], strict=True):
        rest = fps[at : at + n]
        while len(rest):
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                near = verified(rest ^ (x := reached.pop()))
                left.append(np.full(int(near.sum()), x))
                right.append(rest[near])
                reached += list(rest[near])
                rest = rest[~near]
    return np.concatenate(left).view("i8"), np.concatenate(right).view("i8")


def _dealt(index: DataFrame, long: DataFrame, distance: int) -> DataFrame:
    """index (key, fp, used positions as bits) with the lists of the keys in long dealt by one more byte.

    Fingerprints that link share 8 - distance bytes, so of the positions that a key doesn't have they share as many as the
    key lacks to that number, and any positions but one less than that leave out no link.
    """
    long = broadcast_if_small(long, F.lit(16))
    lacks = F.lit(8 - distance) - F.bit_count("used")
    free = F.filter(F.array(*map(F.lit, range(8))), lambda p: F.expr("used").bitwiseAND(F.call_function("shiftleft", F.lit(1), p)) == 0)
    more = index.join(long, "key", "left_semi").select("key", "fp", "used", F.explode(F.slice(free, F.lit(1), F.size(free) - lacks + 1)).alias("p"))
    byte = F.call_function("shiftrightunsigned", F.col("fp"), F.col("p") * 8).bitwiseAND(F.lit(255))
    again = more.select(F.xxhash64("key", "p", byte).alias("key"), "fp", F.col("used").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("p"))).alias("used"))
    return index.join(long, "key", "left_anti").unionByName(again)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(src, dst): links between distinct fingerprints of column fp, enough to reach whatever any link within distance reaches.

    A list of many near fingerprints yields a spanning forest of its links, not all of its pairs. The bytes in a key grow
    with the number of fingerprints, so that lists stay short on average; any choice finds every link. A list that is long
    all the same is dealt by further bytes, until its fingerprints share all those that a link is sure to share.
    """
    distinct = fps.select("fp").where("fp is not null").distinct()
    n = distinct.count()
    size = next((g for g in range(2, 8 - distance) if n <= MEAN_LIST << (8 * g)), 8 - distance)
    posts = []
    for i, design in enumerate(designs(size, distance)):
        key = F.lit(i).cast("long")
        for p in design:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        posts.append(F.struct(key.alias("key"), F.col("fp").alias("fp"), F.lit(sum(1 << p for p in design)).alias("used")))
    workers_ready(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, "i8"), np.zeros(0, "u8")
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(k):
                a, b = _links(k, f, distance)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view("u8")))
            if sum(len(k) for k, _ in held) < 200_000 or held[0][0][0] == held[-1][0][-1]:
                continue
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(keys, keys[-1]))
            yield from out(keys[:whole], values[:whole])
            held = [(keys[whole:], values[whole:])]
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    index = distinct.select(F.explode(F.array(*posts)).alias("p")).select("p.key", "p.fp", "p.used")
    for _ in range(8 - distance - size):
        long = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LONG_LIST).select("key")
        if long.isEmpty():
            break
        index = _dealt(index, long, distance)
    index = index.select("key", "fp")
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs; component_id is the smallest doc_id that links reach.

    Equal fingerprints are one entry of the index, so a text copied any number of times costs one. Null, empty and blank
    texts share fingerprint 0 and link like any other. Rows whose doc_id is null keep a component of the others.
    """
    fps = checkpointed(fingerprints(docs, width))
    roots = connected_components(links(fps, distance))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return fps.join(named, fps.fp == named["of"]).select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex_of_long(F.col("fp")).alias("fingerprint"), "component_id")
