import random

import numpy as np

from lodestone.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    clean = [f"{a}{b}" for a in ("mor", "ten", "bal", "rist", "ov") for b in ("an", "il", "ust", "ee", "ok", "um")]
    bad = ["scumbag", "filthé", "vileness", "vilest"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.choice([5, 40, 200]))
        toxic = rng.random() < 0.25
        for _ in range(rng.choice([1, 3, 8]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_severity_order(spark):
    docs, labels = corpus(1500, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    train = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    model = toxicity.fit(d, train)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = [(i, t) for i, t in labels if i % 3 == 0]
    assert np.mean([got[i].toxic == bool(t) for i, t in held]) > 0.98
    counts = {i: sum(w.strip(",!").lower() in ("scumbag", "filthé", "vileness", "vilest") for w in text.split()) for i, text in docs}
    few = np.mean([got[i].severity for i, t in held if t and counts[i] == 1])
    many = np.mean([got[i].severity for i, t in held if t and counts[i] == 8])
    clean = np.mean([got[i].severity for i, t in held if not t])
    assert clean < few < many <= toxicity.GRADES
    for r in got.values():
        assert 0 <= r.severity <= toxicity.GRADES and r.grade in range(toxicity.GRADES + 1)


def test_features_are_words_and_prefixes_once_and_twice():
    hashes, text = toxicity.features(["Abcdefgh abcd", None, "", "abcd"])
    assert len(hashes) == 5 + 1 + 1 and set(text) == {0, 3}  # a word of eight letters has four prefixes
    assert len(set(hashes)) == 6 and set(hashes[text == 3]) <= set(hashes[text == 0])
    hashes, text = toxicity.distinct(*toxicity.features(["x y x", "y", "x x x"]))
    assert list(text) == [0, 0, 0, 1, 2, 2] and len(set(hashes)) == 3 and list(hashes) == [*sorted(hashes[:3]), *hashes[3:4], *sorted(hashes[4:])]


def dense_fit(x, grade, penalty, top, steps=60_000, rate=0.02):
    """The same loss by plain subgradient-free means: proximal gradient descent over the whole dense matrix."""
    n, k = x.shape
    w, theta = np.zeros(k), np.linspace(0.5, 2.5, top)
    for _ in range(steps):
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - theta))), np.zeros((n, 1))], 1)
        p = above[np.arange(n), grade] - above[np.arange(n), grade + 1]
        slope = above * (1 - above)
        by_z = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p / n
        by_theta = np.array([((grade == j + 1) * slope[:, j + 1] / p - (grade == j) * slope[:, j + 1] / p).sum() / n for j in range(top)])
        w = w - rate * (x.T @ by_z)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        theta = theta - 10 * rate * by_theta
    return w, theta


def test_fit_equals_a_dense_one():
    rng = np.random.default_rng(2)
    x = (rng.random((80, 12)) < rng.uniform(0.05, 0.6, 12)).astype(float)
    latent = x @ np.array([3, -2.5, 2, 0, 0, 0, 0, 0, 0, 0, 1.5, 0]) + rng.logistic(size=80)
    grade = np.digitize(latent, [1, 2.5, 4])
    text, feature = np.nonzero(x)
    weights, theta = toxicity.fit_ordinal(feature, text, grade, 12, deviations=0.6, least=0.1)
    penalty = toxicity.penalties(x.sum(0), grade, 0.6, 0.1)
    w, t = dense_fit(x, grade, penalty, 3)
    assert (weights < 0).any() and (weights == 0).any()
    assert np.abs(weights - w).max() < 0.02 and np.abs(theta - t).max() < 0.02
    severity = (1 / (1 + np.exp(-((x @ w)[:, None] - t)))).sum(1)
    model = toxicity.Severity(np.arange(1, 13, dtype="u8"), weights, theta)
    assert np.abs(model.exceedance(feature, text, 80).sum(1) - severity).max() < 0.02


def test_features_of_two_documents_have_no_weight():
    rng = np.random.default_rng(3)
    n = 60
    grade = (np.arange(n) < 15).astype("i8")
    feature, text = np.array([0, 0, *([1] * 12), *([2] * 20)]), np.array([0, 1, *range(12), *rng.choice(n, 20, replace=False)])
    weights, _ = toxicity.fit_ordinal(feature, text, grade, 3)
    assert weights[0] == 0 and weights[1] > 0


def test_insults_are_found_in_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held = docs.join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "label"), "doc_id")
    got = toxicity.score(held, toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))).collect()
    insulting = [r for r in got if len({w for w in ("trash", "idiot", "scum", "loser", "moron", "clown", "stupid", "pathetic", "worthless", "disgusting") if w in r.text.lower().split()}) > 1]
    assert len(insulting) > 5 and all(r.toxic and r.label for r in insulting)
    assert sum(r.toxic and not r.label for r in got) <= 3


def test_nulls_missing_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 30000, "c"), (None, "x", "d")], "doc_id long, text string, grade string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.query(docs, none).collect()
    assert len(got) == 4 and all(r.severity == 0 and not r.toxic for r in got)
    one_kind = spark.createDataFrame([(1, 0), (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, one_kind) is None
    assert toxicity.score(docs, None).columns == ["doc_id", "text", "severity", "grade", "p_toxic", "toxic"]
    assert toxicity.query(docs.where("false"), none).count() == 0
