import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import langid


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = {"aa": "the and ing ion er es th ou wh".split(), "bb": "der die ung ein sch ich ä ß".split(), "cc": "ция про ста ний ов ал".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choices(syllables[lang], k=rng.choice([1, 2, 3]))) for _ in range(rng.choice([4, 30, 150]))]
        rows.append((i, " ".join(words).capitalize() + rng.choice([".", " 12!", "\n"]), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, accepted boolean")
    got = langid.query(docs).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 250
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.accepted for r in got]) == 1


def test_held_out_fold_follows_crc32(spark):
    import zlib

    ids = [0, 1, 7, -5, 123456789012]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert [r[0] for r in df.select(langid.held_out(F.col("doc_id"))).collect()] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]


def test_other_scripts_are_rejected_and_short_texts_are_not(spark):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string, lang string")
    models = langid.fit(docs)
    texts = [(1, "これは日本語の文章です。とても長い文章なので言語がわかります。" * 5), (2, "the"), (3, None), (4, ""), (5, "123 !? \n"), (6, "zqxj kkvw qqzx jjxw vvkq " * 10), (7, "ding " * 40000), (8, "\0the\0and\0")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), models).collect()}
    assert not got[1].accepted and not got[6].accepted
    assert got[2].accepted and got[2].lang_pred == "aa" and got[8].lang_pred == "aa" and got[7].lang_pred in models.languages
    for i in (3, 4, 5):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)


def test_probabilities_equal_a_plain_kneser_ney():
    rng = random.Random(3)
    texts = {0: ["".join(rng.choices("abc ", k=60)) for _ in range(5)], 1: ["".join(rng.choices("bcd ", k=60)) for _ in range(5)]}
    order, d = langid.ORDER, langid.DISCOUNT

    def codes(text):
        return langid.characters([text])[0].tolist()

    counts = {k: defaultdict(Counter) for k in range(1, order + 1)}
    for lang, own in texts.items():
        for t in own:
            c = codes(t)
            for i in range(order - 1, len(c)):
                counts[order][lang][tuple(c[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for lang in texts:
            for gram in counts[k + 1][lang]:
                counts[k][lang][gram[1:]] += 1
    keys = [(g, lang, n) for lang in texts for g, n in counts[order][lang].items()]
    packed = np.array([sum(c << (16 * (order - 1 - i)) for i, c in enumerate(g)) for g, _, _ in keys], "u8")
    models = langid.Models(["x", "y"], packed, np.array([x for _, x, _ in keys]), np.array([n for _, _, n in keys]))

    def probability(lang, gram):
        if not gram:
            return models.floor
        own = counts[len(gram)][lang]
        total = sum(n for g, n in own.items() if g[:-1] == gram[:-1])
        lower = probability(lang, gram[1:])
        if not total:
            return lower
        kinds = sum(g[:-1] == gram[:-1] for g in own)
        return max(own[gram] - d, 0) / total + d * kinds / total * lower

    for text in ("abcab", "ddd cba", "zebra", texts[0][0]):
        c = codes(text)
        grams = [tuple(c[i - order + 1 : i + 1]) for i in range(order - 1, len(c))]
        got, n, _ = models.cross_entropy([text])
        assert n[0] == len(grams)
        for lang in texts:
            want = -sum(math.log(probability(lang, g)) for g in grams) / len(grams)
            assert abs(got[0, lang] - want) < 1e-5
    assert abs(sum(math.exp(models._logs(np.array([packed[0] & ~np.uint64(0xFFFF) | np.uint64(c)]), order)[0, 0]) for c in (0, *map(ord, "abcd"))) - 1) < 1e-5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.query(docs).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.query(unlabelled).collect()] == [("und", 0.0, False)]


def test_short_foreign_texts_are_rejected_and_short_own_ones_are_not(spark):
    models = langid.fit(spark.createDataFrame(corpus(600), "doc_id long, text string, lang string"))
    rng = random.Random(5)
    own = [" ".join(t.split()[:4]) for _, t, _ in corpus(300, seed=2)]
    noise = ["".join(rng.choices("bcdfghjklmnpqrstvwxz ", k=40)) for _ in range(100)]
    foreign = [" ".join("".join(rng.choices("ka mi to ru sha yo ne".split(), k=3)) for _ in range(6)) for _ in range(100)]
    assert np.mean(models.predict(own)[3]) > 0.98
    assert np.mean(models.predict(noise)[3]) < 0.05 and np.mean(models.predict(foreign)[3]) < 0.05
