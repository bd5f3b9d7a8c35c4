"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w . x - threshold[k]): all thresholds share the weights w, so grades stay ordered. Features are the
distinct words of a text and their prefixes, by hash, and those again that it has twice or more; severity is the expected
grade. The fit is penalised by the weights'
absolute values, which leaves most of them at zero: every feature of the sample may take a weight of either sign, and the
evidence alone decides which do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Tables, map_batches
from lodestone.llm.hashing import BYTES, LETTERS, mixed, range_hashes

#: Labelled documents, and bytes of their texts, that the model is fitted on, in expectation; chosen evenly by a hash of doc_id.
FIT_DOCUMENTS, FIT_BYTES = 10_000, 48 << 20
#: Standard deviations that a feature's gradient has to exceed, and documents that it has to stand for: the penalty.
#: A gradient is below the number of a feature's documents, so features of fewer than three provably have no weight.
DEVIATIONS, LEAST_GRADIENT = 2.5, 2.5
#: Parts of the sample that are scored by a fit on the others, for the grades of binary labels and for the cut.
FOLDS = 4
#: Bytes of the prefixes that are features beside the words.
PREFIXES = (4, 5, 6, 7)
#: Grades above 0 that binary labels are spread over.
GRADES = 3
_SPACES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_FILTER_BITS = 22
_TWICE = np.uint64(1 << 63)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words and prefixes of each text, repeats included."""
    split = [(t or "").lower().encode("utf-8", "replace").translate(_SPACES).split() for t in texts]
    n = np.fromiter(map(len, split), "i8", len(split))
    words = [w for own in split for w in own]
    length = np.fromiter(map(len, words), "i8", len(words))
    start = np.cumsum(length) - length
    values = BYTES[np.frombuffer(b"".join(words), "u1")]
    text = np.repeat(np.arange(len(split)), n)
    stops = [start + length, *(np.where(length > p, start + p, -1) for p in PREFIXES)]
    hashes, owners = [], []
    for i, stop in enumerate(stops):
        has = stop >= 0
        hashes.append(mixed(range_hashes(values, LETTERS, start[has], stop[has]) + np.uint64(i > 0)) & ~_TWICE)
        owners.append(text[has])
    return np.concatenate(hashes), np.concatenate(owners)


def distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) pairs, each once and sorted by text and hash; a hash that a text has twice or more comes once more with its highest bit set."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    at = np.flatnonzero(np.concatenate([[True], (np.diff(hashes) != 0) | (np.diff(text) != 0)])[: len(hashes)])
    twice = at[np.diff(np.append(at, len(hashes))) > 1]
    hashes, text = np.concatenate([hashes[at], hashes[twice] | _TWICE]), np.concatenate([text[at], text[twice]])
    order = np.lexsort((hashes, text))
    return hashes[order], text[order]


def likelihood(z: np.ndarray, theta: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood of the grades, and its gradients by each text's score z and by the thresholds."""
    n, top = len(grade), len(theta)
    above = np.ones((n, top + 2))  # P(grade >= 0..top + 1)
    above[:, 1:-1] = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -500, 500)))
    above[:, -1] = 0
    at = np.arange(n)
    p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-300)
    slope = above * (1 - above)  # zero at both ends
    by_z = -(slope[at, grade] - slope[at, grade + 1]) / p / n
    by_theta = np.zeros(top)
    for j in range(top):
        by_theta[j] = (slope[grade == j + 1, j + 1] / p[grade == j + 1]).sum() / n - (slope[grade == j, j + 1] / p[grade == j]).sum() / n
    return float(-np.log(p).mean()), by_z, by_theta


def penalties(n_with: np.ndarray, grade: np.ndarray, deviations: float, least: float) -> np.ndarray:
    """Each feature's penalty on its weight's absolute value, from the number of texts that have it."""
    share = (grade > 0).mean()
    return np.maximum(deviations * np.sqrt(n_with * share * (1 - share)), least) / len(grade)


def solve(feature: np.ndarray, text: np.ndarray, grade: np.ndarray, penalty: np.ndarray, start: tuple[np.ndarray, np.ndarray], steps: int = 2000, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the least penalised negative log-likelihood, by accelerated proximal gradients.

    Weights are scaled by how many texts have their feature; steps are shortened until the loss falls as it should, and
    thresholds stay ordered as the loss has no bound where they meet.
    """
    n, k = len(grade), len(penalty)
    scale = np.concatenate([np.sqrt(np.maximum(np.bincount(feature, minlength=k), 1) / n), np.ones(len(start[1]))])
    cost = np.concatenate([penalty, np.zeros(len(start[1]))]) / scale

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = x[:k] / scale[:k], x[k:]
        if (np.diff(theta) <= 0).any():
            return np.inf, x
        value, by_z, by_theta = likelihood(np.bincount(text, w[feature], n), theta, grade)
        return value, np.concatenate([np.bincount(feature, by_z[text], k), by_theta]) / scale

    x = np.concatenate([start[0], start[1]]) * scale
    value, y, inertia, length = loss(x)[0] + cost @ np.abs(x), x, 1.0, 4.0
    for _ in range(steps):
        at, g = loss(y)
        while True:
            new = y - length * g
            new = np.sign(new) * np.maximum(np.abs(new) - length * cost, 0)
            d = new - y
            reached = loss(new)[0]
            if reached <= at + g @ d + d @ d / (2 * length) + 1e-14:
                break
            length /= 2
        total = reached + cost @ np.abs(new)
        if total > value:  # the inertia overshot: go on from here without it
            if inertia == 1.0:
                break
            y, inertia = x, 1.0
            continue
        done = value - total < tolerance * max(1.0, abs(total))
        following = (1 + np.sqrt(1 + 4 * inertia * inertia)) / 2
        y = new + (inertia - 1) / following * (new - x)
        if (np.diff(y[k:]) <= 0).any():
            y, following = new, 1.0
        x, value, inertia = new, total, following
        if done:
            break
        length *= 1.1
    return x[:k] / scale[:k], x[k:]


def fit_ordinal(feature: np.ndarray, text: np.ndarray, grade: np.ndarray, k: int, deviations: float = DEVIATIONS, least: float = LEAST_GRADIENT) -> tuple[np.ndarray, np.ndarray]:
    """(weights of k features, thresholds) for pairs (feature, text) and a grade for each text.

    Only features whose gradient exceeds their penalty can have a weight at the optimum, so the fit runs on those that did
    so far and takes up others as they do, until none does: the result is the optimum over all features.
    """
    n, top = len(grade), int(grade.max(initial=1))
    share = np.clip([(grade > j).mean() for j in range(top)], 1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(-np.log(share / (1 - share))) + 1e-3 * np.arange(top)
    penalty = penalties(np.bincount(feature, minlength=k), grade, deviations, least)
    _, theta = solve(feature[:0], text[:0], grade, np.zeros(0), (np.zeros(0), theta))
    weights, active = np.zeros(k), np.zeros(k, bool)
    for _ in range(50):
        by_z = likelihood(np.bincount(text, weights[feature], n), theta, grade)[1]
        violating = (np.abs(np.bincount(feature, by_z[text], k)) > penalty * (1 + 1e-3)) & ~active
        if not violating.any():
            break
        active |= violating
        place = np.cumsum(active) - 1
        own = active[feature]
        found, theta = solve(place[feature[own]], text[own], grade, penalty[active], (weights[active], theta))
        weights[active] = found
    return weights, theta


class Severity:
    """A fitted model: the hashes of features with a weight, sorted, their weights, thresholds, and a cut on P(grade > 0)."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray | None = None, thresholds: np.ndarray | None = None, cut: float = 0.5):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.weights = np.zeros(len(hashes)) if weights is None else weights[order]
        self.thresholds = np.zeros(GRADES) if thresholds is None else thresholds
        self.cut = cut
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.hashes & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def sparse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, text) pairs, each once, sorted by text."""
        hashes, text = features(texts)
        likely = self.maybe[hashes & np.uint64((1 << _FILTER_BITS) - 1)]
        hashes, text = distinct(hashes[likely], text[likely])
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(at), bool)
        return at[known], text[known]

    def exceedance(self, feature: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for each of n texts and each threshold k."""
        score = np.bincount(text, self.weights[feature], n)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -500, 500)))


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability of the best F1 on rows that their model hasn't seen; of equals the middle."""
    cuts = np.arange(5, 96) / 100
    hit = np.array([((p >= c) & toxic).sum() for c in cuts])
    f1 = 2 * hit / np.maximum(np.array([(p >= c).sum() for c in cuts]) + toxic.sum(), 1)
    best = cuts[f1 >= f1.max() - 1e-12]
    return float(best[len(best) // 2])


def held_out(feature: np.ndarray, text: np.ndarray, toxic: np.ndarray, k: int) -> np.ndarray:
    """P(toxic) of each text by a fit of the plain label on the other folds."""
    fold = np.arange(len(toxic)) % FOLDS
    p = np.zeros(len(toxic))
    for f in range(FOLDS):
        own = fold != f
        pairs = own[text]
        place = np.cumsum(own) - 1
        weights, theta = fit_ordinal(feature[pairs], place[text[pairs]], toxic[own].astype("i8"), k)
        p[~own] = (1 / (1 + np.exp(-np.clip(np.bincount(text, weights[feature], len(toxic)) - theta[0], -500, 500))))[~own]
    return p


def grades_of(label: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Grades 0..GRADES. Labels of several levels are taken as they are; a binary label's positives are spread, in equal parts, in the order of their held-out probability."""
    if label.max(initial=0) > 1:
        return np.clip(label, 0, GRADES).astype("i8")
    grade, positive = np.zeros(len(label), "i8"), np.flatnonzero(label > 0)
    order = positive[np.argsort(p[positive], kind="stable")]
    grade[order] = 1 + np.arange(len(order)) * GRADES // max(1, len(order))
    return grade


def fit(docs: DataFrame, labels: DataFrame) -> Severity | None:
    """A model from docs (doc_id, text) and labels (doc_id, toxic); None without labels of both kinds.

    The sample of labelled documents is bounded by FIT_DOCUMENTS and FIT_BYTES: nothing that comes to the driver grows with
    the corpus. Documents with several labels count with the highest. Copies of a text are one example.
    """
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("label"))
    texts = docs.select("doc_id", "text").where("text is not null")
    size = texts.select("doc_id", F.octet_length("text").alias("size")).join(labelled, "doc_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    share = min(1.0, FIT_DOCUMENTS / max(size.n, 1), FIT_BYTES / max(size.bytes, 1))
    place = F.xxhash64(F.lit("toxicity"), "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    # about FIT_DOCUMENTS rows at most: labels whose document has no text aren't among them, however many there are
    chosen = F.broadcast(texts.select("doc_id").join(labelled.where(place < share), "doc_id").distinct())
    sample = texts.join(chosen, "doc_id").select("text", "label")
    # else the rare words of a text that is often copied look telling
    sample = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.any_value("text").alias("text"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, text = distinct(*features(batch.column(2).to_pylist()))
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype("i4")
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view("i8")))], names=["h", "label", "hashes"])

    tables = Tables(docs.sparkSession)
    rows = tables.write(map_batches(sample.select("h", "label", "text"), "h long, label long, hashes array<long>", hashed))
    # fewer documents than the least gradient can't move a weight from zero
    telling = rows.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_GRADIENT).select("hash")
    hashes = np.sort(telling.toArrow().column("hash").to_numpy().view("u8"))
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, known = batch.column(2).flatten().to_numpy().view("u8"), shared.value
        text = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        has = known[at] == own if len(known) else np.zeros(len(own), bool)
        ends = np.searchsorted(text[has], np.arange(batch.num_rows + 1)).astype("i4")
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[has].astype("i4")))], names=["h", "label", "places"])

    # in one order, so that sums and folds are the same however the rows were dealt
    table = map_batches(rows, "h long, label long, places array<int>", placed).orderBy("h").toArrow()
    tables.drop()
    label, lists = table.column("label").to_numpy(), table.column("places").combine_chunks()
    if not 0 < (label > 0).sum() < len(label):
        return None
    feature, text = lists.flatten().to_numpy(), np.repeat(np.arange(len(label), dtype="i4"), lists.value_lengths().to_numpy())
    p = held_out(feature, text, label > 0, len(hashes))
    weights, theta = fit_ordinal(feature, text, grades_of(label, p), len(hashes))
    own = weights != 0
    theta = np.concatenate([theta, theta[-1] + 1.0 + np.arange(GRADES - len(theta))])  # grades that the sample lacks
    return Severity(hashes[own], weights[own], theta, best_cut(p, label > 0))


def score(docs: DataFrame, model: Severity | None, text: str = "text") -> DataFrame:
    """docs with severity (the expected grade, 0 to GRADES), grade (the likeliest), p_toxic (P(grade > 0)) and toxic (p_toxic from the model's cut on); columns of these names are replaced.

    Null and empty texts, and any text without a model, have severity 0, grade 0, p_toxic 0 and aren't toxic.
    """
    added = ("severity", "grade", "p_toxic", "toxic")
    kept = [c for c in docs.columns if c.lower() not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        above = np.zeros((len(texts), GRADES))
        if shared.value is not None:
            above = shared.value.exceedance(*shared.value.sparse(texts), len(texts))
            above[[not (t or "").strip() for t in texts]] = 0
        likely = -np.diff(np.concatenate([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))], 1), axis=1)
        found = above.sum(1), likely.argmax(1).astype("i4"), above[:, 0], above[:, 0] >= (shared.value.cut if shared.value else 1)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, map(np.ascontiguousarray, found))], names=[*kept, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "severity double, grade int, p_toxic double, toxic boolean"])
    return map_batches(docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias("__text")), schema, run)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return found.select("doc_id", "severity", "grade", "p_toxic", "toxic")
