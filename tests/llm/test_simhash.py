import random
import time
from itertools import combinations

import xxhash

from lodestone.llm import simhash
from lodestone.llm.graph import connected_components


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    names = list(range(len(fps)))

    def top(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            a, b = sorted((top(i), top(j)))
            names[b] = a
    return [top(i) for i in range(len(fps))]


def test_every_design_holds_in_every_set_of_sure_positions():
    for distance in range(1, 6):
        for size in range(1, 8 - distance + 1):
            for sure in combinations(range(8), 8 - distance):
                assert any(set(d) <= set(sure) for d in simhash.designs(size, distance)), (distance, size)
    assert len(simhash.designs(2, 4)) == 7


def test_links_reach_what_all_pairs_reach(spark, monkeypatch):
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        fps.append(rng.getrandbits(64))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            x = fps[-1]
            for _ in range(rng.choice([1, 3, 4, 5])):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << a) ^ (1 << b) for a, b in combinations(range(20), 2)]
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_components(fps)
    for mean, long in ((256, 2048), (0, 2048), (256, 3), (0, 0)):  # 0: keys of more bytes, lists dealt again
        monkeypatch.setattr(simhash, "MEAN_LIST", mean)
        monkeypatch.setattr(simhash, "LONG_LIST", long)
        links = simhash.links(df)
        for r in links.collect():
            assert ((r.src ^ r.dst) & (1 << 64) - 1).bit_count() <= 4
        roots = {r.node: r.root for r in connected_components(links).collect()}
        got = [roots.get(x, x) for x in signed]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


TEXTS = [None, "", "  \n", "One two", "one TWO", "a b c d", "a b c d e " * 40, "A b c d e " * 40, "x y z\x0bq r s", "é É w " * 9, "long " * 30000]


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    texts = list(TEXTS)
    for _ in range(12):
        words = [rng.choice("alpha beta gamma delta eps zeta eta theta iota".split()) + str(rng.randrange(50)) for _ in range(120)]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            near = list(words)
            near[rng.randrange(120)] = "changed"
            texts.append(" ".join(near))
    docs = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    fps = [plain_fingerprint(t) for t in texts]
    want = [(100 + i, f"{f:016x}", 100 + c) for i, (f, c) in enumerate(zip(fps, plain_components(fps), strict=True))]
    assert sorted(map(tuple, simhash.query(docs).collect())) == want
    assert simhash.query(docs.where("false")).count() == 0


def test_components_of_chains_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (None, 5), (7, None), (9, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_a_long_list_without_links_is_dealt_by_further_bytes(spark):
    """Fingerprints that share three bytes and no link: no list of one key is left to one task. Planted links are found."""
    rng = random.Random(8)
    fps = [rng.getrandbits(40) << 24 | 0xABCDEF for _ in range(32_000)]
    planted = [(x, x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)) for x in fps[:20]]
    signed = [x - (1 << 64) if x >> 63 else x for x in dict.fromkeys([*fps, *(y for _, y in planted)])]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    began = time.time()
    found = simhash.links(df).collect()
    took = time.time() - began
    both = {frozenset((r.src & (1 << 64) - 1, r.dst & (1 << 64) - 1)) for r in found}
    assert all(frozenset(p) in both for p in planted if p[0] != p[1]) and all((a ^ b).bit_count() <= 4 for a, b in map(tuple, both))
    assert took < 60
