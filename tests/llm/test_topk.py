import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import topk


def plain(rows, every, k):
    live = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, own) in enumerate(live):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for n, (i, v) in enumerate(live) if n != at and len(v) == len(own))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_index_equals_sorting():
    rng = np.random.default_rng(1)
    for n, dims, spread in ((1, 3, 5), (7, 2, 2), (64, 5, 300), (65, 8, 1), (1000, 16, 90), (300, 4, 1 << 20)):
        values = rng.integers(-spread, spread + 1, (n, dims))
        ids = np.sort(rng.choice(10 * n, n, replace=False))
        index = topk.BitSlicedIndex(ids, values)
        for q in [*rng.integers(-spread, spread + 1, (6, dims)), np.zeros(dims, "i8"), values[0]]:
            for k in (1, 3, n, n + 2):
                own = int(ids[rng.integers(n)])
                scores = values @ q
                want = sorted(((int(i), int(s)) for i, s in zip(ids, scores, strict=True) if i != own), key=lambda x: (-x[1], x[0]))[:k]
                assert index.top(q, k, own) == want


@pytest.mark.parametrize(("components", "rows", "chunk"), [(1 << 22, 4096, 256), (64, 16, 3)])
def test_query_equals_brute_force(spark, monkeypatch, components, rows, chunk):
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", components)
    monkeypatch.setattr(topk, "SMALL_BLOCK_ROWS", rows)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", chunk)
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 0.1]) + rng.random() * rng.choice([0, 0, 1]) for _ in range(4)]) for i in range(120)]
    rows += [(150, None), (200, [1.0, None, 0.0, 0.0]), (201, [float("nan")] * 4), (202, [float("inf"), 0.0, 0.0, 0.0]), (203, []), (250, [0.5, 0.5]), (251, [0.5, 0.25]), (300, [0.0] * 4), (None, [9.0] * 4)]
    rows += [(7, [9.0, 1.0, 1.0, 1.0]), (7, [8.0, 2.0, 0.0, 1.0]), (50, [3.0, 1.0, 0.0, 1.0]), (50, [3.0, 1.0, 0.0, 1.0]), (400, [70000.0, -66000.0, 0.5, 1.0]), rows[10]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    as_float = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for every, k in ((10, 5), (50, 200)):
        assert sorted(map(tuple, topk.query(df, every, k).collect())) == plain(as_float, every, k)
    assert topk.query(df.where("false")).count() == 0


def test_repeated_ids_agree_with_the_sql(spark):
    import duckdb

    from lodestone.llm import sql

    embeddings = pa.table({"vec_id": pa.array([0, 50, 50, 7, 7, 8], pa.int64()), "embedding": pa.array([[float(i), 1.0] for i in range(6)], pa.list_(pa.float32()))})
    want = duckdb.sql(sql.oracle_sql()["op8_bit_sliced_topk"]).fetchall()
    got = topk.query(spark.createDataFrame(embeddings.to_pylist(), "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(embeddings) == 6


def test_components_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leaves the range of a long"):
        topk.query(df).collect()


def test_large_vectors_are_scored_exactly(spark):
    """Sums that pass 64 bits on the way, in rows that are no query's best, and beside rows of ordinary size."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-9, 9) for _ in range(3)]) for i in range(1, 40)] + [(0, [1.0, 2.0, 0.0]), (50, [-1.0, 0.0, 0.5]), (77, [1e9, 1.0, 0.0]), (78, [-1e9, 1.0, 2e9]), (79, [1e15, -1e15, 1e15]), (80, [0.0, 0.0, -3e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.query(df).collect())) == plain(rows, 50, 5)
