import random
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lodestone.llm import near_copies


def plain_shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_kept(docs, percent=80):
    """The smallest doc_id of each component of pairs whose Jaccard similarity is at least percent / 100."""
    names = {i: i for i, _ in docs}
    sets = {i: plain_shingles(t) for i, t in docs}

    def top(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            names[b] = a
    return sorted(i for i in names if top(i) == i)


def kept_of(spark, docs):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, frame, "").collect())


@pytest.mark.parametrize("block", [near_copies.BLOCK, 3])
def test_the_stage_links_what_a_jaccard_brute_force_links(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(900)]
    docs = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c d e f")]
    for family in range(25):
        base = rng.choices(vocabulary, k=rng.choice([20, 60, 200, 620, 1500]))
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 15)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((10 + rng.randrange(10**9), " ".join(words)))
    docs += [(10**10, docs[8][1]), (10**10, docs[8][1])]
    want = plain_kept(docs)
    assert 30 < len(want) < 180
    assert kept_of(spark, docs) == want


def test_a_large_group_of_near_copies_makes_links_by_its_size(spark, monkeypatch):
    """Texts around one original, many of them not similar enough to any one center: few pairs meet once three of them were one."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(600):
        words = list(base)
        for _ in range(rng.choice([1, 4, 9, 11])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    met = []
    paired = near_copies._paired
    monkeypatch.setattr(near_copies, "_paired", lambda rest, *how: met.append(paired(rest, *how).count()) or paired(rest, *how))
    assert kept_of(spark, docs) == plain_kept(docs)
    assert sum(met) <= 10 * len(docs)


def test_possible_pairs_are_all_that_are_similar():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 64, 400, "u8"))
    sets = [np.sort(rng.choice(pool, rng.integers(0, 300), replace=False)) for _ in range(60)] + [pool[:300], pool[:290], pool[5:300], pool[:0], pool[:0]]
    i, j = np.triu_indices(len(sets), 1)
    keep = near_copies.possible([np.frombuffer(near_copies.short(s), "<u2") for s in sets], i, j, 80)
    real = np.array([near_copies.similar(sets[a], sets[b], 80) for a, b in zip(i, j, strict=True)])
    assert real.sum() >= 4 and (keep | ~real).all() and keep.sum() <= real.sum() + 5


def test_rows_that_share_or_lack_a_doc_id(spark):
    texts = ["one two three four five six", "quite another text than that", "and a third one of these here"]
    rows = [(1, texts[0], "b"), (1, texts[0], "a"), (1, texts[1], "c"), (None, texts[0], "d"), (None, texts[2], "f"), (None, texts[2], "e"), (9, texts[1].upper(), "g")]
    docs = spark.createDataFrame([(i, t, "en", s, 7, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, first int")
    got = sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, texts[0], "a"), (1, texts[1], "c"), (None, texts[2], "e")], key=str)
    assert corpus_pipeline.simhash_dedup(spark, docs.where("false"), "").count() == 0


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(1)
    for n in (3, 100, 511, 600, 700, 5000):
        own = np.unique(rng.integers(0, 1 << 64, n, "u8"))
        other = np.unique(np.concatenate([own[n // 10 :], rng.integers(0, 1 << 64, n // 10, "u8")]))
        share = len(np.intersect1d(own, other)) / len(np.union1d(own, other))
        for a, b in zip(near_copies.sketches(own), near_copies.sketches(other), strict=True):
            assert (a is None) == (b is None) or n in (511, 600)
            if a and b:
                equal = np.mean(np.frombuffer(a, "u1") == np.frombuffer(b, "u1"))
                assert abs(equal - share) < 0.16, (n, equal, share)
    assert near_copies.least_tally(80) == 100


def test_the_stage_links_near_copies_of_the_table(spark):
    found = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    docs = list(zip(*(c.to_pylist() for c in found.columns), strict=True))
    assert kept_of(spark, docs) == plain_kept(docs)


@pytest.mark.parametrize(("a", "b", "want"), [("a b c d e f g h i", "a b c d e f g h j", False), ("a b c d e f g h i j k l m", "a b c d e f g h i j k l m n", True), ("", " ", True), ("", "a", False)])
def test_similar_is_by_sets_of_shingles(a, b, want):
    assert near_copies.similar(near_copies.shingles(a.encode(), 5), near_copies.shingles(b.encode(), 5), 80) is want
