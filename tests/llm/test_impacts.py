import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lodestone.llm import impacts, sql


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, queries, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = defaultdict(set)
    for i, t in queries:
        asked[i].update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c, n in counts:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "日本", "x1", "a-b", "don't", "é"] + [f"w{i}" for i in range(60)]
    text = lambda size: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(size))
    docs = [(i, text(rng.choice([0, 1, 3, 10, 60]))) for i in range(n)]
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (None, "w3"), (1000, None), (1001, ""), (1002, " .,- "), (1003, "w1 " * 50_000), (1004, "w4 " + "long" * 30_000), *((2000 + i, "same rare words") for i in range(30))]
    queries = [(i, text(rng.choice([0, 1, 4, 30]))) for i in range(40)] + [(100, "same rare words"), (101, None), (102, ""), (103, "nowhere"), (104, "w1"), (104, "w2 w1"), (None, "w3 the"), (105, "same " * 3000)]
    rng.shuffle(docs)
    return docs, queries


def frames(spark, docs, queries):
    return (
        spark.createDataFrame([(i, t, "b", 1, 2) for i, t in docs], "doc_id long, text string, block string, rank int, score int"),
        spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, query int"),
    )


@pytest.mark.parametrize(("parts", "sizes"), [(1, {}), (6, {"INVERTED_ROWS": 7, "BLOCK_ROWS": 128, "CHUNK_QUERIES": 9}), (3, {"INVERTED_TERMS": 50, "BLOCK_TERMS": 2000, "BLOCK_ROWS": 256})])
def test_search_equals_brute_force(spark, monkeypatch, parts, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(impacts, name, size)
    docs, queries = rows(parts)
    d, q = frames(spark, docs, queries)
    d = d.repartition(parts)
    for k in (10, 1000):
        assert sorted(map(tuple, impacts.search(d, q, k).collect()), key=str) == plain(docs, queries, k)


def test_empty_tables(spark):
    d, q = frames(spark, *rows(1, 20))
    for docs, queries in ((d.where("false"), q), (d, q.where("false")), (d.where("text is null"), q)):
        assert impacts.search(docs, queries).count() == 0


def test_sums_of_bitmaps_equal_sums():
    rng = np.random.default_rng(3)
    for rows_, n_terms, high in ((1, 1, 1), (70, 5, 9), (1000, 40, 1 << 34)):
        want, lists = np.zeros(rows_ + 64, "i8"), {}
        for no in range(n_terms):
            parts = []
            for first, many in ((0, min(rows_, 64)), (64, max(0, rows_ - 64))):
                at = np.flatnonzero(rng.random(many) < rng.choice([0.02, 0.5, 1]))
                if len(at):
                    impact = rng.integers(0, high, len(at))
                    want[first + at] += impact
                    bits = np.arange(max(1, int(impact.max()).bit_length()))[:, None]
                    parts.append((first, at.astype("<u4").tobytes(), np.packbits((impact >> bits & 1).astype("u1"), axis=1).tobytes()))
            if parts:
                lists[no] = parts[::-1]
        ids = np.arange(rows_, dtype="i8")
        block = impacts.Block([(0, min(rows_, 64), ids[:64].tobytes()), (64, max(0, rows_ - 64), ids[64:].tobytes())], lists)
        total = block.sums(list(range(n_terms)))
        got = sum((np.unpackbits(s.view("u1")).astype("i8") << b for b, s in enumerate(total)), np.zeros(64 * block.words, "i8"))
        assert (got[: rows_] == want[: rows_]).all() and got[rows_:].sum() == 0
        best = sorted(((-int(s), int(i)) for i, s in zip(ids, want[:rows_], strict=True) if s > 0))[:7]
        assert sorted((-s, i) for i, s in block.top(list(range(n_terms)), 7)) == best


def test_sizes_beyond_64_bits(spark):
    lists = spark.createDataFrame([(1, 2, 3, bytearray(np.array([0], "<u4").tobytes()), bytearray(np.array([1], "<u4").tobytes()), bytearray(np.array([4_000_000_000], "<u4").tobytes()))], "block long, no long, w long, at binary, tf binary, size binary")
    n, total = 10**11, 10**14
    bits = np.unpackbits(np.frombuffer(impacts.impacts(lists, n, total).first().slices, "u1").reshape(-1, 1), axis=1)[:, 0]
    assert sum(int(b) << i for i, b in enumerate(bits)) == 3 * (10**9 // (1000 + 8 * (10 + 90 * n * 4_000_000_000 // total)))


def test_sql_agrees_on_odd_rows():
    docs, queries = rows(9)
    documents = duckdb.sql("SELECT * FROM (SELECT unnest($1) AS doc_id, unnest($2) AS text)", params=[[r[0] for r in docs], [r[1] for r in docs]])  # noqa: F841
    benchmark = duckdb.sql("SELECT * FROM (SELECT unnest($1) AS item_id, unnest($2) AS text)", params=[[r[0] for r in queries], [r[1] for r in queries]])  # noqa: F841
    assert sorted(duckdb.sql(sql.oracle_sql()["op11_bit_sliced_impacts"]).fetchall(), key=str) == plain(docs, queries)
