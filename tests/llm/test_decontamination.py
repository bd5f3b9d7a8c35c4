import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import decontamination as dc


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words, hit, ids = plain_words(text), set(), set()
        for item_id, item in items:
            own = plain_words(item)
            width = min(window, len(own))
            for s in range(len(own) - width + 1 if own else 0):
                for i in range(len(words) - width + 1):
                    if words[i : i + width] == own[s : s + width]:
                        hit.update(range(i, i + width))
                        ids.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(11)
    vocabulary = [f"Wörd{i}" if i % 7 else "the" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(100, "the the the the the the the the the the the the"), (101, "..."), (102, ""), (103, None), (104, items[0][1]), (105, "ÉCOLE école"), (106, "never seen anywhere")]
    docs = []
    for i in range(60):
        own = rng.choices(vocabulary, k=rng.choice([0, 5, 40]))
        for _ in range(rng.randrange(3)):
            cut = plain_words(rng.choice(items)[1])
            cut = cut[rng.randrange(len(cut) or 1) :] if rng.random() < 0.5 else cut[: rng.randrange(len(cut) + 1)]
            at = rng.randrange(len(own) + 1)
            own[at:at] = cut
        docs.append((i, rng.choice([" ", ", ", "\n", "--"]).join(own)))
    return [*docs, (60, None), (61, ""), (62, "THE " * 300), (63, "école"), (64, "Écolé ÉCOLE école"), (65, docs[5][1]), (65, docs[5][1])], items


def plain_near(docs, items, window, slop, missing):
    """(doc_id, item_id) pairs by all windows at each place of their two rarest words."""
    texts, out = [(i, plain_words(t)) for i, t in docs], set()
    n = Counter(w for _, t in texts for w in t)
    for item_id, item in items:
        own = plain_words(item)
        width = min(window, len(own))
        for s in range(len(own) - width + 1 if own else 0):
            cut = own[s : s + width]
            anchors = sorted(range(width), key=lambda k: (n[cut[k]], cut[k].encode(), k))[:2]
            for doc_id, text in texts:
                for k in anchors:
                    for f in (i - k for i, w in enumerate(text) if w == cut[k]):
                        near = sum(any(text[x] == cut[j] for x in range(max(0, f + j - slop), min(len(text), f + j + slop + 1))) for j in range(width))
                        if near >= width - (missing if width == window else 0):
                            out.add((doc_id, str(item_id)))
    return out


def test_query_equals_brute_force(spark):
    docs, items = tables()
    docs = [*docs, (None, items[0][1]), (65, "other " + (items[3][1] or ""))]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for window in (10, 3):
        got = dc.query(d, b, window)
        assert sorted(map(tuple, got.drop("n_near_items", "near_items_sha256").collect()), key=str) == plain(docs, items, window)
    assert dc.query(d.where("false"), b).count() == 0
    assert [r.contaminated for r in dc.query(d, b.where("false")).collect()] == [False] * len(docs)


def test_proximity_equals_brute_force(spark):
    docs, items = tables()
    rng = random.Random(3)
    shaken = []
    for i, (_, text) in enumerate(items[:12]):
        own = plain_words(text)
        for _ in range(2):
            at = rng.randrange(len(own))
            own[at:at] = ["filler"] * rng.randrange(3)
        own[rng.randrange(len(own))] = "changed"
        shaken.append((200 + i, " ".join(own)))
    docs = [*dict(docs).items(), *shaken]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for window, slop, missing in ((10, 4, 1), (6, 1, 0)):
        got = {(r.doc_id, r.item_id) for r in dc.proximity_matches(d, b, window, slop, missing).collect()}
        want = plain_near(docs, items, window, slop, missing)
        assert got == want and len(want) > 10


def test_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "aa bb cc", 1, 2, 3, 4)], "doc_id long, text string, of int, candidates int, rid int, words int")
    items = spark.createDataFrame([(7, "aa bb cc")], "item_id long, text string")
    got = dc.exact_matches(docs, items)
    assert got.columns == [*docs.columns, "n_words", "matches"]
    row = got.first()
    assert (row["of"], row.candidates, row.rid, row.words, row.n_words, [tuple(m) for m in row.matches]) == (1, 2, 3, 4, 3, [("7", 0, 3)])


def test_rows_of_a_long_item_hold_a_window_at_most(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3000)))], "item_id long, text string")
    windows = dc.item_windows(items, 10).collect()
    assert len(windows) == 2991 and all(len(w.own) == 10 for w in windows)


def test_main_path_is_native(spark):
    docs, items = tables()
    found = dc.matched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10, 4)
    assert not any(x in found._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_proximity_finds_a_phrase_with_an_inserted_or_replaced_word(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff"), (2, "aa bb xx cc dd ee ff"), (3, "aa " + "xx " * 30 + "ff cc"), (4, "yy"), (5, "aa bb cc xx ee ff")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "aa bb cc dd ee ff")], "item_id long, text string")
    near = lambda *how: sorted({r.doc_id for r in dc.proximity_matches(docs, items, *how).collect()})
    assert near(6, 2, 1) == [1, 2, 5] and near(6, 0, 1) == [1, 5] and near(10, 2) == [1, 2]


def test_covered_counts_each_position_once(spark):
    m = "array(named_struct('from', 2, 'width', 3), named_struct('from', 4, 'width', 2))"
    assert spark.range(1).select(F.sort_array(dc.covered(F.expr(m)))).first()[0] == [2, 3, 4, 5]


def test_repeated_words_cost_their_number(spark):
    """A text of one word: a window for each content, a look-up for each place, and rows of bounded candidates."""
    docs = [(1, "ha " * 20_000), (2, "ha ha no " * 3_000), (3, "ho " * 50), (4, "ha " * 9)]
    items = [(7, "ha " * 400), (8, "ha ha no " * 40), (9, "ho " * 3)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.item_windows(b, 10).count() == 5
    got = {r.doc_id: r for r in dc.query(d, b).collect()}
    assert {i: (r.n_hit, r.n_items) for i, r in got.items()} == {1: (20_000, 1), 2: (9_000, 1), 3: (50, 1), 4: (0, 0)}


def test_candidates_in_several_rows_give_the_same(spark, monkeypatch):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, dc.query(d, b, 3).collect()), key=str)
    monkeypatch.setattr(dc, "CANDIDATES", 2)
    assert sorted(map(tuple, dc.query(d, b, 3).collect()), key=str) == want


def test_intermediate_tables_are_dropped(spark, tmp_path):
    import os

    from lodestone.llm.common import checkpoint_folder

    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs, items = tables()
    dc.query(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(set(os.listdir(folder)) - before) <= 2  # the index and the matches, which the result reads
