"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts are read as lower-case letters, a run of anything else being one boundary. The models of all languages share
sorted arrays of n-gram hashes; a row beside each hash holds the natural log-probability of the n-gram's last character
in every language. A whole text's cross-entropy is the mean over its characters; the lowest one names the language, and a
text whose best cross-entropy lies beyond that language's limit, calibrated by length, is rejected.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_batches

#: Characters of the longest n-gram; four 16-bit characters fill a 64-bit key.
ORDER = 4
#: Labelled documents that a language's model is fitted on, and those that its limit is calibrated on, in expectation.
#: All of a language's documents while there are fewer; the hash of doc_id chooses, evenly over the corpus.
FIT_DOCUMENTS, CALIBRATION_DOCUMENTS = 4_000, 500
#: Absolute discount of the counts.
DISCOUNT = 0.75
#: Where the lengths, in characters, begin that have a limit of their own; the first ones begin at 0.
BANDS = np.array([8, 16, 32, 64, 128])
#: Cuts of a calibration text for each of the lengths that begin there.
CUTS = 4
UNDETERMINED = "und"
_BOUNDARY, _ASTRAL = 0, 0xFFFF
_MASK = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]


def _letters() -> np.ndarray:
    """For each code point 1 for a letter, 2 for a mark (part of words, but no letter by itself), else 0."""
    kinds = np.zeros(sys.maxunicode + 1, "u1")
    for c in range(sys.maxunicode + 1):
        kinds[c] = {"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0)
    return kinds


class _Kinds:
    table: np.ndarray | None = None

    @classmethod
    def of(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = _letters()
        return cls.table


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, document of each code, whether each document has a letter).

    A document is ORDER - 1 boundaries, its characters from the first letter on, and a last boundary.
    """
    joined = "\0".join([*((t or "").lower() for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    kind = _Kinds.of()[points]
    ends = points == 0  # a zero in a text is a boundary as well
    if int(ends.sum()) != len(texts):
        return characters([(t or "").replace("\0", " ") for t in texts])
    doc = np.cumsum(ends) - ends
    lettered = np.bincount(doc, kind == 1, len(texts)) > 0
    inside = kind > 0
    after = np.concatenate([[False], inside[:-1]])
    kept = inside | after | ends
    codes = np.where(inside, np.minimum(points, _ASTRAL), _BOUNDARY).astype("u8")[kept]
    doc, last = doc[kept], ends[kept]
    # boundaries before each document
    pad = np.ones(len(codes), "i8")
    first = np.concatenate([[True], last[:-1]])[: len(codes)]
    pad[first] = ORDER
    padded = np.repeat(codes, pad)
    at = np.cumsum(pad) - pad
    for k in range(ORDER - 1):
        padded[at[first] + k] = _BOUNDARY
    return padded, np.repeat(doc, pad), lettered


def grams(codes: np.ndarray) -> np.ndarray:
    """The key of the ORDER-gram that ends at each code from the ORDER-th on."""
    n = len(codes) - ORDER + 1
    if n <= 0:
        return np.zeros(0, "u8")
    key = codes[:n].copy()
    for k in range(1, ORDER):
        key <<= np.uint64(16)
        key |= codes[k : k + n]
    return key


def _scored(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which ORDER-grams lie within one document."""
    return doc[ORDER - 1 :] == doc[: len(doc) - ORDER + 1]


def hashed(key: np.ndarray, order: int) -> np.ndarray:
    x = (key ^ np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tallied(keys: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, language, number) of each distinct pair."""
    own = [(i, *np.unique(keys[language == i], return_counts=True)) for i in np.unique(language)]
    if not own:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0)
    return np.concatenate([k for _, k, _ in own]), np.concatenate([np.full(len(k), i) for i, k, _ in own]), np.concatenate([n for _, _, n in own]).astype("f8")


class Models:
    """Kneser-Ney models of several languages in common sorted hash arrays."""

    def __init__(self, languages: list[str], keys: np.ndarray, language: np.ndarray, counts: np.ndarray):
        """keys, language, counts: how often each ORDER-gram ends in each language's sample, rows of (key, language) unique."""
        self.languages = languages
        n = len(languages)
        alphabet = max(2, len(np.unique(keys & _MASK[1])))
        levels = {ORDER: (keys, language, counts.astype("f8"))}
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before an n-gram
            above, lang, _ = levels[k + 1]
            levels[k] = tallied(above & _MASK[k], lang)
        self.hashes: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        self.context_hashes: dict[int, np.ndarray] = {}
        self.context_weight: dict[int, np.ndarray] = {}
        self.floor = 1.0 / alphabet
        for k in range(1, ORDER + 1):
            key, lang, number = levels[k]
            contexts, where = np.unique(key >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, (where, lang), number)
            np.add.at(kinds, (where, lang), 1)
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            distinct, row = np.unique(key, return_inverse=True)
            seen = np.zeros((len(distinct), n))
            seen[row, lang] = np.maximum(number - DISCOUNT, 0) / total[where, lang]
            context_of = np.searchsorted(contexts, distinct >> np.uint64(16))
            lower = np.full((len(distinct), n), self.floor) if k == 1 else np.exp(self._logs(distinct & _MASK[k - 1], k - 1))
            order = np.argsort(h := hashed(distinct, k))
            self.hashes[k], self.logs[k] = h[order], np.log(seen + weight[context_of] * lower)[order].astype("f4")
            order = np.argsort(h := hashed(contexts, k))
            self.context_hashes[k], self.context_weight[k] = h[order], np.log(weight)[order].astype("f4")
        self.limit = np.full((n, len(BANDS) + 1), np.inf)

    @staticmethod
    def _found(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, wanted)
        at[at == len(table)] = 0
        return at, table[at] == wanted

    def _logs(self, keys: np.ndarray, k: int) -> np.ndarray:
        """ln P(last character | the ones before) of k-grams, a column for each language."""
        if k == 0:
            return np.full((len(keys), len(self.languages)), np.log(self.floor), "f4")
        at, known = self._found(self.hashes[k], hashed(keys, k))
        out = self.logs[k][at]
        if not known.all():
            rare = keys[~known]
            lower = self._logs(rare & _MASK[k - 1], k - 1)
            at, seen = self._found(self.context_hashes[k], hashed(rare >> np.uint64(16), k))
            out[~known] = lower + np.where(seen[:, None], self.context_weight[k][at], 0)
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats a character by document and language, characters by document, whether a document has a letter)."""
        codes, doc, lettered = characters(texts)
        inside = _scored(codes, doc)
        key, doc = grams(codes)[inside], doc[ORDER - 1 :][inside]
        n = np.bincount(doc, minlength=len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        if len(key):
            begins = np.flatnonzero(np.diff(doc, prepend=-1))
            total[doc[begins]] = np.add.reduceat(self._logs(key, ORDER), begins, axis=0, dtype="f8")
        return -total / np.maximum(n, 1)[:, None], n, lettered

    def calibrate(self, own: np.ndarray, other: np.ndarray, language: np.ndarray, band: np.ndarray) -> None:
        """Limits by language and band of length: half-way from the 99.9 % quantile of own texts to the median of their cross-entropy in other languages, but not below the former.

        own: each text's cross-entropy in its language; other: its mean in the others. A shorter band's limit is no lower
        than a longer one's; a band without a text has that of the next shorter one, or none.
        """
        for i in range(len(self.languages)):
            for k in range(len(BANDS) + 1):
                mine = own[(language == i) & (band == k)]
                if not len(mine):
                    self.limit[i, k] = self.limit[i, k - 1] if k else np.inf
                    continue
                top = np.quantile(mine, 0.999)
                foreign = other[(language == i) & (band == k)]
                foreign = foreign[np.isfinite(foreign)]
                self.limit[i, k] = max(top, (top + np.median(foreign)) / 2) if len(foreign) else top + np.median(mine)
            self.limit[i] = np.maximum.accumulate(self.limit[i, ::-1])[::-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, confidence, cross-entropy, accepted) of each text."""
        entropy, n, lettered = self.cross_entropy(texts)
        best = entropy.argmin(1)
        low = entropy[np.arange(len(texts)), best]
        # a posterior over languages, as if a text were at most 50 independent characters
        gap = (entropy - low[:, None]) * np.minimum(n, 50)[:, None]
        score = np.where(lettered, 1 / np.exp(-gap).sum(1), 0.0)
        accepted = lettered & (low <= self.limit[best, np.searchsorted(BANDS, n, "right")])
        return [self.languages[b] if x else UNDETERMINED for b, x in zip(best, lettered, strict=True)], score, low, accepted


def cuts(text: str) -> list[str]:
    """The text, and runs of its words of about each length that BANDS name, from places spread over it."""
    words = text.split()
    out = [text]
    for least in (int(BANDS[0]) // 2, *BANDS[:-1].tolist()):
        for first in sorted({len(words) * k // CUTS for k in range(CUTS)}):
            size, last = 0, first
            while last < len(words) and size < least:
                size += len(words[last]) + 1
                last += 1
            if size >= least:
                out.append(" ".join(words[first:last]))
    return out


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: documents that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sampled(docs: DataFrame, languages: dict[str, int], least: float, most: float) -> DataFrame:
    """The labelled documents whose hash falls from least to most times FIT_DOCUMENTS of their language's documents."""
    place = (F.xxhash64(F.lit("langid"), "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) * F.element_at(F.create_map(*(F.lit(x) for kv in languages.items() for x in kv)), F.col("lang"))
    return docs.where((place >= least) & (place < most))


def fit(docs: DataFrame) -> Models | None:
    """Models from docs (doc_id, text, lang): every row with a text and a language may be learned from.

    The fitting and calibration samples are bounded by FIT_DOCUMENTS and CALIBRATION_DOCUMENTS a language, so what comes
    to the driver (n-gram counts of the sample, and a bounded number of rows for each calibration text) doesn't grow with the corpus.
    None if nothing can be learned.
    """
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    # a small language keeps a tenth of its documents for calibration
    fit_share = {x: min(FIT_DOCUMENTS, 0.9 * n) for x, n in sizes.items()}
    scaled = {x: n / fit_share[x] for x, n in sizes.items()}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = np.array([languages.index(x) for x in batch.column(1).to_pylist()])
        codes, doc, _ = characters(batch.column(0).to_pylist())
        inside = _scored(codes, doc)
        key, language, n = tallied(grams(codes)[inside], names[doc[ORDER - 1 :][inside]])
        return pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(language.astype("i4")), pa.array(n.astype("i8"))], names=["key", "language", "n"])

    sample = _sampled(docs, scaled, 0.0, 1.0).select("text", "lang")
    counted = map_batches(sample, "key long, language int, n long", count).groupBy("key", "language").agg(F.sum("n").alias("n")).toArrow()
    if not counted.num_rows:
        return None
    key, language, n = (counted.column(c).to_numpy() for c in ("key", "language", "n"))
    models = Models(languages, key.view("u8"), language.astype("i8"), n)

    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [cuts(t) for t in batch.column(0).to_pylist()]
        entropy, length, lettered = shared.value.cross_entropy([x for own in parts for x in own])
        own = np.repeat([languages.index(x) for x in batch.column(1).to_pylist()], [len(x) for x in parts])
        band = np.searchsorted(BANDS, length, "right")
        rows = np.arange(len(own))
        mine = entropy[rows, own]
        others = (entropy.sum(1) - mine) / (len(languages) - 1) if len(languages) > 1 else np.full(len(own), np.inf)
        return pa.RecordBatch.from_arrays([pa.array(x[lettered]) for x in (own, mine, others, band)], names=["language", "own", "other", "band"])

    calibration = _sampled(docs, scaled, 1.0, 1.0 + CALIBRATION_DOCUMENTS / FIT_DOCUMENTS).select("text", "lang")
    measured = map_batches(calibration, "language long, own double, other double, band long", measure).toArrow()
    models.calibrate(*(measured.column(c).to_numpy() for c in ("own", "other", "language", "band")))
    return models


def predict(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and accepted; columns of these names are replaced.

    lang_pred is und, score 0 and accepted false for texts that are null or have no letter, or without a model. A
    rejected text keeps the name of its nearest language; accepted tells it apart.
    """
    added = ("lang_pred", "score", "cross_entropy", "accepted")
    kept = [c for c in docs.columns if c.lower() not in added]
    shared: Broadcast[Models | None] = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        if shared.value is None:
            found = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        else:
            found = shared.value.predict(texts)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=[*kept, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "lang_pred string, score double, cross_entropy double, accepted boolean"])
    return map_batches(docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias("__text")), schema, run)


def query(docs: DataFrame) -> DataFrame:
    models = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")
