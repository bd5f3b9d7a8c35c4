import hashlib
import zlib
from collections import Counter, defaultdict

from lodestone.llm import sharding


def plain(rows, shards, seed=42):
    by = defaultdict(list)
    for doc_id, text, source in rows:
        data = (text or "").encode()
        h = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{zlib.crc32(data)}:{len(data) + 1}".encode()).hexdigest()[:15], 16)
        by[source].append((h, doc_id if doc_id is not None else -1, zlib.crc32(data), len(data) + 1))
    ranked = []
    for source, own in by.items():
        for r, x in enumerate(sorted(own)):
            ranked.append(((2 * r + 1) / (2 * len(own)), source is not None, source or "", *x))
    out = []
    for at, (_, _, _, _, doc_id, crc, size) in enumerate(sorted(ranked)):
        shard = at * shards // len(rows)
        out.append((doc_id, size, crc, shard, at - -(-shard * len(rows) // shards)))
    return sorted(out)


def rows_of(n):
    sources = ["hot"] * 5 + ["a", "b", None, "ünï", ""]
    return [(i, [None, "", "é" * i, "same text"][i % 4], sources[i * 7 % 10]) for i in range(n)] + [(3, "twin", "a"), (3, "twin", "a"), (None, "x", "hot")]


def test_equals_plain_interleaving(spark, monkeypatch):
    for rows, shards, per_bucket in ((rows_of(500), 8, 32768), (rows_of(500), 7, 1), (rows_of(2), 8, 32768)):
        monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", per_bucket)
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, bucket int")
        got = sharding.assign_shards(docs, shards)
        assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        found = got.collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32, r.shard, r.slot) for r in found) == plain(rows, shards)
        counts = Counter(r.shard for r in found)
        assert max(counts.values()) - min(counts.values()) <= 1 or len(rows) < shards
        for s, n in counts.items():
            assert sorted(r.slot for r in found if r.shard == s) == list(range(n))


def test_every_shard_matches_the_mixture(spark):
    rows = rows_of(800)
    shares = Counter(s for _, _, s in rows)
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8).collect()
    by = Counter((r.shard, r.source) for r in got)
    for (_, source), n in by.items():
        assert abs(n - shares[source] / 8) <= 2


def test_empty_table_and_native_plan(spark):
    empty = sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert empty.count() == 0 and dict(empty.dtypes)["slot"] == "bigint" and dict(empty.dtypes)["shard"] == "int"
    assert "Python" not in empty._jdf.queryExecution().toString()
