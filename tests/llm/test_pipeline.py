import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lodestone.llm import bpe, langid
from tests.llm.test_decontamination import plain as plain_contaminated
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_substring_dedup import plain as plain_repeats


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in ("the", "con", "pro", "mar") for b in ("ti", "lo", "ran") for c in ("on", "ing", "es", "ed")]
    passage = rng.choices(vocabulary, k=55)
    items = [(i, " ".join(rng.choices(vocabulary, k=25))) for i in range(4)]
    docs = [(0, None), (1, ""), (2, "123 ---")]
    for i in range(3, 80):
        words = rng.choices(vocabulary, k=rng.choice([30, 80, 300]))
        if i % 6 == 0:
            words[10:10] = passage
        if i % 11 == 0:
            words += rng.choice(items)[1].split()[5:20]
        docs.append((i, " ".join(words)))
        if i % 9 == 0:
            docs.append((1000 + i, docs[-1][1] if i % 2 else docs[-1][1] + " extra"))
    docs.append((2000, docs[20][1]))
    docs.append((2000, docs[20][1]))
    frame = spark.createDataFrame([(i, t, "en" if i % 4 else None, "s", len(t or ""), 7) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_every_stage_equals_brute_force(spark, tables):
    folder, docs, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    lettered = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_dedup", "substring_removal", "benchmark_decontamination", "byte_bpe"]
    of = dict(corpus_pipeline.STAGES)

    first = of["language_id"](spark, frame, folder)
    assert first.columns == list(corpus_pipeline.COLUMNS)
    rows = sorted((r.doc_id, r.text) for r in first.collect())
    assert rows == sorted(lettered)

    representatives = set(plain_kept(rows))
    want = sorted({(i, t) for i, t in rows if i in representatives})
    second = of["simhash_dedup"](spark, spark.createDataFrame(first.collect(), first.schema), folder)
    assert sorted((r.doc_id, r.text) for r in second.collect()) == want

    kept = [(i, t) for i, (n, gone, t) in plain_repeats(dict(want), 20).items() if gone < n]
    third = of["substring_removal"](spark, spark.createDataFrame(second.collect(), second.schema), folder)
    assert sorted((r.doc_id, r.text) for r in third.collect()) == kept

    clean = {r[0] for r in plain_contaminated(kept, items) if not r[-1]}
    want = [(i, t) for i, t in kept if i in clean]
    fourth = of["benchmark_decontamination"](spark, spark.createDataFrame(third.collect(), third.schema), folder)
    got = fourth.collect()
    assert sorted((r.doc_id, r.text) for r in got) == want and 0 < len(want) < len(kept)
    assert all(r.n_chars == len(r.text) for r in got)

    ranks = bpe.read_ranks(open(corpus_pipeline.VOCABULARY, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    fifth = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.tokens, r.decoded_sha256) for r in fifth) == [(i, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in want]


def test_empty_and_unlabelled_documents(spark, tables, tmp_path):
    folder, _, _ = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.where("false"), folder).count() == 0
    assert langid.fit(frame.where("lang = 'none'")) is None
