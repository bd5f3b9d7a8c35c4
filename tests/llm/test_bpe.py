import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(VOCABULARY, "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def long_pieces():
    rng = random.Random(7)
    yield from (b"a" * 1000, b"ab" * 777, b"0" * 513, "é".encode() * 400, bytes(rng.choices(range(256), k=3000)))
    for alphabet in ("ab", "the ", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éèçaeiou", "0123456789", "日本語中文"):
        for n in (65, 66, 129, 300, 1500):
            yield "".join(rng.choices(alphabet.strip(), k=n)).encode()


def test_joined_halves_equal_the_library():
    tree = bpe.TreeEncoder(RANKS)
    for piece in long_pieces():
        got = tree.encode(piece)
        assert b"".join(tree.bytes_of[t] for t in got) == piece
        assert got == LIBRARY._encode_single_piece(piece)


def test_windows_by_heap_equal_the_short_ones():
    tree = bpe.TreeEncoder(RANKS)
    for piece in long_pieces():
        assert tree.merged_by_heap(piece[:100]) == tree.merged(piece[:100])


def test_the_tree_encodes_ordinary_pieces(spark):
    """Each piece of ordinary texts that isn't one token is joined from single bytes, a join for each byte but one, or from subtrees that other pieces share."""
    find = bpe._Vocabulary.of(open(VOCABULARY, "rb").read(), public_tokenizers.PATTERN).find
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect()]
    pieces = sorted({p.encode() for t in texts for p in find(t)})
    tree, alone = bpe.TreeEncoder(RANKS), bpe.TreeEncoder(RANKS)
    for piece in pieces:
        before, alone.joins = tree.joins, 0
        alone.shared.clear()
        assert tree.encode(piece) == alone.encode(piece) == alone.tree(piece) == LIBRARY._encode_single_piece(piece)
        assert piece in RANKS or tree.joins > before or len(piece) <= bpe.SHARED_BYTES
        alone.joins = 0
        alone.shared.clear()
        alone.tree(piece)
        assert min(1, len(piece) - 1) <= alone.joins < len(piece)
    assert sum(p not in RANKS for p in pieces) > 1000


def test_decoding_up_the_tree(monkeypatch):
    v = bpe._Vocabulary.of(open(VOCABULARY, "rb").read(), public_tokenizers.PATTERN)
    ids = np.array(LIBRARY.encode_ordinary("Naïve café 日本語 " * 60))
    whole = v.concatenated(ids).tobytes()
    monkeypatch.setattr(bpe, "LEAF_IDS", 1)
    assert v.decode(ids) == whole == ("Naïve café 日本語 " * 60).encode() and v.decode(ids[:0]) == b""


def test_split_pattern_agrees_on_every_code_point():
    find = bpe._Vocabulary.of(open(VOCABULARY, "rb").read(), public_tokenizers.PATTERN).find
    tree = bpe.TreeEncoder(RANKS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}1 {c}{c}!\n" for c in points[at : at + 4096])
        if (mine := [t for p in find(text) for t in tree.encode(p.encode())]) != LIBRARY.encode_ordinary(text):
            bad = [c for c in points[at : at + 4096] if [t for p in find(f"a{c}1 {c}{c}!\n") for t in tree.encode(p.encode())] != LIBRARY.encode_ordinary(f"a{c}1 {c}{c}!\n")]
            raise AssertionError([hex(ord(c)) for c in bad], len(mine))


TEXTS = [None, "", " ", "Hello  world's\n\n end ", "x" * 5000, "naïve café 日本語 ½ ²", "the " * 3000, "tab\there\r\n  "]


def test_digests_equal_the_library_and_extra_columns_survive(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, tokens string")
    for row in bpe.digests(docs, VOCABULARY, public_tokenizers.PATTERN).collect():
        text = TEXTS[row.doc_id % len(TEXTS)] or ""
        ids = LIBRARY.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    once = bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)
    apart = bpe.decode(encoded, VOCABULARY, public_tokenizers.PATTERN)
    assert once.columns == apart.columns and sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
    assert encoded.columns == ["doc_id", "text", "tokens"] and encoded.count() == 2 * len(TEXTS)
    assert bpe.digests(docs.where("false"), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_decoding_null_and_unknown_ids(spark):
    ids = spark.createDataFrame([(1, None), (2, []), (3, [5, 5])], "doc_id long, tokens array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(ids, VOCABULARY, public_tokenizers.PATTERN).collect()}
    assert got[1] is None and got[2] == b"" and len(got[3]) == 2
    with pytest.raises(Exception, match="no token"):
        bpe.decode(ids.select(F.array(F.lit(10_000_000)).alias("tokens")), VOCABULARY, public_tokenizers.PATTERN).collect()
