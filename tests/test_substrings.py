import random

import pytest

from lodestone.operators import retrieval, substrings
from lodestone.sources.posts import POSTS


def made(spark, rows):
    from datetime import datetime, timedelta

    full = [(i, "post", status, title, content, excerpt, "me", "s", "u", datetime(2024, 1, 1) + timedelta(minutes=i)) for i, status, title, excerpt, content in rows]
    return spark.createDataFrame(full, POSTS)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abÉx.*%_", k=rng.choice([1, 2, 3, 5, 8])))
    rows = [(i, rng.choice(["publish", "publish", "draft"]), " ".join(word() for _ in range(2)), rng.choice(["", word(), None]), rng.choice([" ", "\n", "\t ", " "]).join(word() for _ in range(rng.choice([0, 2, 9])))) for i in range(150)]
    asked = [(i, " ".join(word() for _ in range(rng.choice([1, 1, 2])))) for i in range(60)]
    return rows, [*asked, (100, ""), (101, "  "), (102, None), (103, "a"), (104, "ab ab"), (105, "a\tb"), (106, "nowhere"), (107, " "), (108, "%")]


def plain(rows, asked, k):
    out = []
    for query_id, query in asked:
        whole = " ".join((query or "").lower().replace("\t", " ").replace("\n", " ").split(" ")).strip(" ")
        words = [w for w in whole.split(" ") if w]
        if words:
            hits = [(0 if " ".join(words) in title.lower() else 1, -i) for i, status, title, excerpt, content in rows if status == "publish" and all(w in "\n".join(x for x in (title, excerpt, content) if x is not None).lower() for w in words)]
            out += [(query_id, rank, -i) for rank, (_, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("stored", [False, True])
def test_search_equals_substring_search(spark, stored):
    rows, asked = texts(4)
    posts = made(spark, rows)
    questions = spark.createDataFrame(asked, "query_id long, query string")
    index = substrings.written(substrings.index(posts)) if stored else None
    found = retrieval.like_search(questions, posts, 4, index=index)
    assert sorted(map(tuple, found.collect())) == plain(rows, asked, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not stored or "dynamicpruning" in plan.lower() or "PartitionFilters" in plan


def test_nothing_to_search(spark):
    posts = made(spark, texts(1)[0])
    questions = spark.createDataFrame([(1, "ab")], "query_id long, query string")
    assert retrieval.like_search(questions, posts.where("false"), 3).count() == 0
    assert retrieval.like_search(questions.where("false"), posts, 3).count() == 0


def test_postings_are_not_moved_for_few_words(spark, monkeypatch):
    rows, asked = texts(7)
    posts = made(spark, rows)
    questions = spark.createDataFrame(asked, "query_id long, query string")
    index = substrings.written(substrings.index(posts))
    words = questions.where("length(trim(query)) > 0").selectExpr("query_id", "array_distinct(split(lower(trim(query)), ' ')) as words")

    def joins(limit):
        monkeypatch.setattr(substrings, "BROADCAST_TOKENS", limit)
        found = substrings.candidates(words, index)
        listed = sorted(map(tuple, found.collect()))
        plan = found._jdf.queryExecution().sparkPlan().toString()
        return listed, [x for x in plan.splitlines() if "Join" in x and "token" in x]

    few, broadcast = joins(1000)
    many, shuffled = joins(0)
    assert few == many and few
    assert broadcast and all("BroadcastHashJoin" in x for x in broadcast)
    assert sorted(map(tuple, retrieval.like_search(questions, posts, 4, index=index).collect())) == plain(rows, asked, 4)


def test_a_scan_finds_what_the_index_finds_and_joins_nothing(spark, monkeypatch):
    rows, asked = texts(9)
    posts = made(spark, rows)
    questions = spark.createDataFrame(asked, "query_id long, query string")
    scanned = retrieval.like_search(questions, posts, 4)
    assert "Join" not in scanned._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "SCANNED_QUERIES", 3)
    planned = retrieval.like_search(questions, posts, 4)
    assert "Join" in planned._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, scanned.collect())) == sorted(map(tuple, planned.collect())) == plain(rows, asked, 4)
