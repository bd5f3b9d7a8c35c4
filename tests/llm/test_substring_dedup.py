import hashlib
import random

import pytest

from lodestone.llm import substring_dedup as sd


def plain(texts, length):
    """texts: doc_id to text. doc_id to (n_words, n_removed, kept text)."""
    seen, out = set(), {}
    for doc_id in sorted(texts):
        words = (texts[doc_id] or "").encode().split()
        gone = set()
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                gone.update(range(i, i + length))
            seen.add(w)
        out[doc_id] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


def corpus(seed, docs, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(vocabulary)]
    passages = [rng.choices(words, k=rng.choice([4, 19, 20, 21, 45, 90])) for _ in range(8)]
    texts = {}
    for i in range(docs):
        kind = rng.random()
        if kind < 0.1 and texts:
            texts[i] = texts[rng.choice(list(texts))]
            continue
        own = rng.choices(words, k=rng.choice([0, 3, 30, 120]))
        for _ in range(rng.choice([0, 1, 1, 3])):
            at = rng.randrange(len(own) + 1)
            own[at:at] = rng.choice(passages)
        texts[i] = rng.choice([" ", "\n", " \t "]).join(own)
    return texts | {docs: None, docs + 1: "", docs + 2: "la " * 200, docs + 3: "ab cd " * 90, docs + 4: " ".join(words[:1]) * 5000, docs + 5: "x y " * 30}


@pytest.mark.parametrize(("seed", "vocabulary", "length", "limit", "copies"), [(1, 400, 20, 2000, 1000), (3, 400, 20, 2, 3), (4, 4, 6, 3, 1000), (5, 50, 3, 2000, 1), (6, 3, 20, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, vocabulary, length, limit, copies):
    monkeypatch.setattr(sd, "SHARD_SEGMENTS", limit)
    monkeypatch.setattr(sd, "MANY_COPIES", copies)
    texts = corpus(seed, 70, vocabulary)
    docs = spark.createDataFrame([(t, i - 20, 5) for i, t in texts.items()], "text string, doc_id long, n_words int")
    want = plain({i - 20: t for i, t in texts.items()}, length)
    got = {r.doc_id: r for r in sd.query(docs, length).collect()}
    assert got.keys() == want.keys()
    for i, (n, gone, kept) in want.items():
        assert (got[i].n_words, got[i].n_removed) == (n, gone), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    if seed > 1:
        return
    cleaned = sd.remove_repeats(docs, length)
    assert cleaned.columns == ["doc_id", "text", "n_words", "n_removed"]
    assert {r.doc_id: r.text for r in cleaned.collect()} == {i: k if texts[i + 20] is not None else None for i, (_, _, k) in want.items()}


def test_colliding_segment_hashes(spark, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT_MASK", 1)
    monkeypatch.setattr(sd, "SHARD_SEGMENTS", 4)
    texts = corpus(8, 40, 60)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.query(docs, 8).collect()}
    assert got == {i: x[:2] for i, x in plain(texts, 8).items()}


def test_automaton_statistics():
    rng = random.Random(9)
    for alphabet in (1, 2, 3, 9):
        automaton, before = sd.SuffixAutomaton(), []
        for _ in range(12):
            own = [b"%d" % rng.randrange(alphabet) for _ in range(rng.randrange(1, 30))]
            for end, got in enumerate(automaton.statistics(own), 1):
                earlier = [*before, own[: end - 1]]
                want = max((n for n in range(end + 1) if any(own[end - n : end] == o[i : i + n] for o in earlier for i in range(len(o) - n + 1))), default=0)
                assert got == want
            before.append(own)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d " * 10), (1, "a b c d " * 10), (None, "a b c d " * 10)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in sd.query(docs).collect()) == [(0, 40, 0), (1, 40, 36), (1, 40, 36)]
    assert sd.query(docs.where("false")).count() == 0


def test_large_ids_shared_ids_and_clashing_names(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(-(1 << 63), a, 1, 2, 3, "k"), ((1 << 63) - 1, a, 1, 2, 3, "k"), (1, a, 1, 2, 3, "k"), (1, b, 1, 2, 3, "k"), (1, b, 1, 2, 3, "k"), (7, "x " + b, 1, 2, 3, "k"), (8, " ".join(a.split()[:28]), 1, 2, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, of int, __id int, `row` string")
    got = sd.remove_repeats(docs)
    assert got.columns == ["doc_id", "spans", "of", "__id", "row", "text", "n_words", "n_removed"]
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.spans) for r in got.collect())
    assert found == [(-(1 << 63), 40, 0, 1), (1, 40, 0, 1), (1, 40, 0, 1), (1, 40, 40, 1), (7, 41, 40, 1), (8, 28, 28, 1), ((1 << 63) - 1, 40, 40, 1)]


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    rng = random.Random(2)
    split = [[b"%d" % rng.randrange(30) for _ in range(n)] for n in (0, 5, 300, 40, 1000, 19, 20, 21, 64)]
    whole = sd.segments(split, 20, 5)
    monkeypatch.setattr(sd, "WORDS_AT_ONCE", 64)
    pieces = sd.segments(split, 20, 5)

    def windows(found):
        return sorted((t, f + i, m) for t, f, n, m, _ in zip(*(x.tolist() for x in found), strict=True) for i in range(n))

    assert windows(whole) == windows(pieces) and len(windows(whole)) == sum(max(0, len(s) - 19) for s in split)


def test_the_stage_keeps_line_breaks_and_indents(spark):
    import corpus_pipeline

    repeated = " ".join(f"w{i}" for i in range(25))
    texts = ["def f():\n\treturn  1\n", "head\n\n  " + repeated + "\n", "first\n\tline\n" + repeated + "\n\nlast  line\n", "other\n" + repeated.replace(" ", "\n") + "\n"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.substring_removal(spark, docs, "").collect()}
    want = {0: texts[0], 1: texts[1], 2: "first\n\tline\nlast  line\n", 3: "other\n"}
    assert got == {i: (t, len(t)) for i, t in want.items()}
