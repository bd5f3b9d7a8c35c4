"""Near copies by the similarity of their word shingles, over a byte-position inverted index with count filtering.

At a Jaccard similarity of 0.8 two 64-bit SimHash fingerprints differ in about 10 bits, often more: too far for an index
that needs equal bytes of them. So the index of simhash.py is kept, and its 8 positional bytes are replaced by POSITIONS
bytes of MinHash values, which agree in as many places as the sets of shingles do. Texts are posted under stretches of
KEY_BYTES positions; of the pairs in a posting list the shared positional bytes are tallied, pairs below the minimum that
similar ones reach are left, and the sets themselves decide the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Tables, map_batches, utf8, workers_ready
from lodestone.llm.graph import connected_components
from lodestone.llm.hashing import WORDS, mixed, range_hashes, word_hashes

#: A pair of similarity s shares no key with probability (1 - s ** KEY_BYTES) ** (POSITIONS / KEY_BYTES): 3 in a million at 0.8.
POSITIONS, KEY_BYTES = 160, 5
#: Sets below FEW take the least of each of POSITIONS hashes of all their shingles, sets from MANY on the least of each of
#: POSITIONS parts of one hash's range. Similar sets differ in size by a fifth at most, so one of the two ways is both's.
MANY, FEW = 512, 640
#: Standard deviations that a tally of similar sets may lie below its mean.
DEVIATIONS = 5.5
#: Texts of a posting list that are compared at once, with each other or with as many others.
BLOCK = 2048
#: Rounds in which a list's texts meet one of them, before those that are still apart meet each other.
STARS = 3

_RANDOM = np.random.default_rng(42)
_ADD = _RANDOM.integers(0, 1 << 64, POSITIONS, "u8")
_TIMES = _RANDOM.integers(0, 1 << 64, POSITIONS, "u8") | np.uint64(1)
_EDGES = (np.arange(POSITIONS, dtype=object) * (1 << 64) // POSITIONS).astype("u8")
_PLACES = np.uint64(256) ** np.arange(KEY_BYTES, dtype="u8")
_KEYS = POSITIONS // KEY_BYTES


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's width-word shingles, sorted; a shorter text is one, a text without a word has none.

    A-Z lower-cased, words between ASCII white space.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, "u8")
    hashes = word_hashes(words)
    starts = np.arange(max(1, len(words) - width + 1))
    return np.unique(mixed(range_hashes(hashes, WORDS, starts, np.minimum(starts + width, len(words)))))


def sketches(own: np.ndarray) -> tuple[bytes | None, bytes | None]:
    """The positional bytes of a set by all hashes and by parts of one, where its size asks for them."""
    full = parts = None
    if len(own) < FEW:
        least = np.full(POSITIONS, np.iinfo("u8").max, "u8")
        if len(own):
            hashed = (own[:, None] ^ _ADD) * _TIMES
            least = (hashed ^ hashed >> np.uint64(32)).min(0)
        full = (mixed(least) >> np.uint64(56)).astype("u1").tobytes()
    if len(own) >= MANY:
        at = np.searchsorted(own, _EDGES)
        has = at < np.append(at[1:], len(own))
        parts = np.where(has, mixed(own[np.minimum(at, len(own) - 1)]) >> np.uint64(56), 0).astype("u1").tobytes()
    return full, parts


def keys(sketch: bytes, way: int) -> np.ndarray:
    """A key for each stretch of positions: the way, the stretch and its bytes."""
    stretches = np.frombuffer(sketch, "u1").reshape(_KEYS, KEY_BYTES).astype("u8")
    return (stretches @ _PLACES | np.arange(_KEYS, dtype="u8") << np.uint64(40) | np.uint64(way) << np.uint64(48)).view("i8")


def least_tally(percent: int) -> int:
    """The shared positional bytes that a pair of that similarity reaches, but for DEVIATIONS."""
    s = percent / 100
    return max(1, int(POSITIONS * s - DEVIATIONS * sqrt(POSITIONS * s * (1 - s))))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets of shingles is at least percent / 100; two empty sets are equal."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def short(own: np.ndarray) -> bytes:
    """16 bits of each shingle's hash: what two sets share, they share of these too."""
    return (own >> np.uint64(48)).astype("<u2").tobytes()


def possible(shorts: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the pairs of sets i (ascending) and j may have that similarity: no more is shared than the short hashes of one that the other has."""
    keep, present = np.zeros(len(i), bool), np.zeros(1 << 16, bool)
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for at, stop in zip(starts, [*starts[1:], len(i)][: len(starts)], strict=True):
        own, others = shorts[i[at]], [shorts[x] for x in j[at:stop]]
        present[own] = True
        size = np.array([len(x) for x in others])
        upto = np.concatenate([[0], np.cumsum(present[np.concatenate(others)])])
        ends = np.cumsum(size)
        most = np.minimum(upto[ends] - upto[ends - size], len(own))
        keep[at:stop] = 100 * most >= percent * (len(own) + size - most)
        present[own] = False
    return keep


def near_pairs(names: np.ndarray, labels: np.ndarray, block: np.ndarray, matrix: np.ndarray, shorts: list[np.ndarray], key: int, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a posting list whose labels differ and whose tally reaches least, under the first key that they share, as far as their short hashes let them be similar.

    If the list holds rows of two blocks, only those of different blocks are paired: each block meets itself elsewhere.
    """
    stretch = key >> 40 & 255
    across = block.min() != block.max()
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 23) // max(1, matrix.size))
    for at in range(0, len(names), step):
        equal = matrix[at : at + step, None] == matrix[None]
        wanted = (labels[at : at + step, None] != labels) & (names[at : at + step, None] < names)
        if across:
            wanted &= block[at : at + step, None] != block
        wanted &= equal.sum(2) >= least
        i, j = np.nonzero(wanted)
        first = equal[i, j].reshape(-1, _KEYS, KEY_BYTES).all(2).argmax(1) == stretch
        i, j = at + i[first], j[first]
        alike = possible(shorts, i, j, percent)
        out.append((names[i[alike]], names[j[alike]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _tallied(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Those of pairs (src, dst) of nodes whose tally reaches least."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        for i in (2, 3):
            known = np.flatnonzero(np.array(batch.column(i).is_valid()) & np.array(batch.column(i + 2).is_valid()))
            one, other = (np.frombuffer(b"".join(batch.column(k).take(pa.array(known)).to_pylist()), "u1").reshape(-1, POSITIONS) for k in (i, i + 2))
            keep[known] |= (one == other).sum(1) >= least
        return batch.select([0, 1]).filter(pa.array(keep))

    left = nodes.select(F.col("node").alias("src"), F.col("full").alias("full1"), F.col("parts").alias("parts1"))
    right = nodes.select(F.col("node").alias("dst"), F.col("full").alias("full2"), F.col("parts").alias("parts2"))
    both = pairs.join(left, "src").join(right, "dst").select("src", "dst", "full1", "parts1", "full2", "parts2")
    return map_batches(both, "src long, dst long", run)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (src, dst) of nodes whose texts are similar."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[int, np.ndarray] = {}
        keep = []
        for x, y, one, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for node, text in ((x, one), (y, other)):
                if node not in known:
                    known[node] = shingles(text, width)
            keep.append(similar(known[x], known[y], percent))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("src"), F.col("b").alias("one"))
    right = texts.select(F.col("node").alias("dst"), F.col("b").alias("other"))
    return map_batches(pairs.join(left, "src").join(right, "dst").select("src", "dst", "one", "other"), "src long, dst long", run)


def _paired(rest: DataFrame, least: int, percent: int) -> DataFrame:
    """(src, dst) of the near pairs of each posting list of rest (key, node, label, sketch, short), in blocks of about BLOCK rows."""
    workers_ready(rest.sparkSession)
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = rest.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "sketch", "short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (key, _, _), group in groupby(rows, key=lambda r: r[:3]):
            held = list(group)
            if len(held) > 1:
                block, names, labels = (np.array([r[i] for r in held]) for i in (3, 4, 5))
                matrix = np.frombuffer(b"".join(r[6] for r in held), "u1").reshape(-1, POSITIONS)
                shorts = [np.frombuffer(r[7], "<u2") for r in held]
                src, dst = near_pairs(names, labels, block, matrix, shorts, key, least, percent)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "src long, dst long")


def name_of(text: str) -> Column:
    """128 bits by which texts are told apart: equal texts have equal names, and null has its own."""
    return F.coalesce(F.unhex(F.md5(utf8(text))), F.lit(b""))


def rooted(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(name, first, root) for each different text of docs: its name, its smallest doc_id, and a number for its component.

    Equal texts are one node, null ones too. Within each posting list one node is compared with all others, and in further
    rounds another of those that no link joins to the first; then any two that are still apart. What is joined already
    needs no comparison, so a large group of near copies costs its size, not its square.
    """
    tables, least = Tables(docs.sparkSession), least_tally(percent)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name_of("text").alias("name"), utf8("text").alias("b"))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [sketches(shingles(t, width)) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(list(x), pa.binary()) for x in zip(*both, strict=True))], names=["doc_id", "name", "full", "parts"])

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [(way, i, s) for way in (0, 1) for i, s in enumerate(batch.column(1 + way).to_pylist()) if s is not None]
        at = np.repeat([i for _, i, _ in own], _KEYS).astype("i8")
        found = np.concatenate([keys(s, way) for way, _, s in own]) if own else np.zeros(0, "i8")
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(found)], names=["node", "key"])

    sketched = tables.write(map_batches(named, "doc_id long, name binary, full binary, parts binary", sketch))
    texts_of = sketched.groupBy("name").agg(F.min("doc_id").alias("first"), F.any_value("full").alias("full"), F.any_value("parts").alias("parts"))
    nodes = tables.write(texts_of.withColumn("node", F.monotonically_increasing_id()))  # numbers for names, fixed as they are written
    posts = map_batches(nodes.select("node", "full", "parts"), "node long, key long", post)
    shared = tables.write(posts.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").select("key", "center"))
    lists = tables.write(posts.join(shared, "key"))
    posted = nodes.join(lists.select("node").distinct(), "node", "left_semi").select("name", "node")
    texts = tables.write(named.join(posted, "name").dropDuplicates(["node"]).select("node", "b"))

    links, rest, roots = None, lists, None
    for turn in range(STARS):
        apart = rest if turn == 0 else rest.where("label <> center_label")  # a center's own component is joined to it
        stars = apart.where("node <> center").select(F.col("center").alias("src"), F.col("node").alias("dst")).distinct()
        found = tables.write(_verified(_tallied(stars, nodes, least), texts, width, percent))
        links = found if links is None else links.unionByName(found)
        roots = connected_components(links, tables)
        met = rest.where("node <> center").select("key", "node", F.col("center").alias("before"))
        every = met.unionByName(met.select("key", F.col("before").alias("node"), "before").distinct())
        labelled = every.join(roots, "node", "left").select("key", "node", "before", F.coalesce("root", "node").alias("label"))
        # the next center is any of those that are apart from this one; the lists of one component are done with
        ahead = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "label")
        own = labelled.where(F.col("node") == F.col("before")).select("key", F.col("label").alias("of"))
        centers = labelled.where(F.col("node") != F.col("before")).join(own, "key").where("label <> of").groupBy("key").agg(F.min(ahead).alias("c"))
        left = labelled.where(F.col("node") != F.col("before")).join(centers, "key")
        rest = tables.write(left.select("key", "node", "label", F.col("c.node").alias("center"), F.col("c.label").alias("center_label")))
        if rest.isEmpty():
            break
    by_way = F.when(F.shiftrightunsigned("key", 48) == 0, F.col("full")).otherwise(F.col("parts"))

    def shortened(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([short(shingles(t, width)) for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "short"])

    apart = texts.join(rest.select("node").distinct(), "node", "left_semi").select("node", "b")
    known = nodes.select("node", "full", "parts").join(map_batches(apart, "node long, short binary", shortened), "node")
    rest = tables.write(rest.join(known, "node").select("key", "node", "label", by_way.alias("sketch"), "short"))
    more = tables.write(_verified(_paired(rest, least, percent).distinct(), texts, width, percent))
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more), tables)

    return tables.last(nodes.select("node", "name", "first").join(roots, "node", "left").select("name", "first", F.coalesce("root", "node").alias("root")))


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, component_id) for each row of docs: component_id is the smallest doc_id that links reach, null if none has one."""
    named = rooted(docs, width, percent)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name_of("text").alias("name"))
    return own.join(named.join(smallest, "root").select("name", "component_id"), "name").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, then of the smallest name of its text.

    Rows without a doc_id come last. Of rows with one doc_id and one text that with the smallest other columns stays.
    """
    named = rooted(docs, width, percent)
    order = F.struct(F.col("first").isNull().alias("unnamed"), "first", "name")
    chosen = named.groupBy("root").agg(F.min(order).alias("at")).select(F.col("at.name").alias("__node"), F.col("at.first").alias("__first"))
    own = docs.withColumn("__node", name_of("text")).join(chosen, "__node").where(F.col("doc_id").cast("long").eqNullSafe(F.col("__first")))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = own.groupBy("__node").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), F.min(F.struct(F.lit(0).alias("__"), *(F.col(f"`{c}`") for c in others))).alias("__others"))
    return rows.select(*(F.col(f"__others.`{c}`") if c in others else F.col(c) for c in docs.columns))
