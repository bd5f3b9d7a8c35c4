import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")
BLOB = open(FILE, "rb").read()
LIBRARY = Tokenizer.from_file(FILE)
LIBRARY.encode_special_tokens = True
WORDS = packing.WordIds(BLOB)


def library(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


ODD = ["don't 'tis o'clock'S I'LL", "J̌ É é ́", "A\x01B \x01 \x01\x01", "x\x85y z w", "12345 a1b2 ½ ٣", "<|endoftext|> <|startoftext|>", "ΟΔΟΣ İI ß ǅ", "...,,, ?! .a. a.,;", "日本語 中文, ไทย. देवनागरी!", "ñez*** (foo), \"bar\".", "K Å ﬁ", "\x1c\x1d\x1e\x1f", "é, Ñ. ª. µ, a̸,"]


def test_ids_equal_the_library():
    texts = [r for r in ODD] + [" ".join(ODD), "", None, "a" * 5000, "é." * 3000, "word\n\tword\r\n word\x0b\x0cword"]
    assert WORDS.of([t and t.encode() for t in texts]) == [library(t) for t in texts]
    assert WORDS.of([t and t.encode() for t in texts]) == [library(t) for t in texts]  # and from memory


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aEzñÉ'.,!?-*019 \n\t̸́̌\x01\x85 sStTmM"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_of_any_text_equal_the_library(text):
    assert WORDS.of([text.encode()]) == [library(text)]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    words = packing.WordIds(BLOB)
    for n in range(5):
        text = " ".join(f"w{n}x{i}." for i in range(20)) + " " + "q" * 100
        assert words.of([text.encode()]) == [library(text)]
        assert len(words.words) <= 10


def test_open_bins_against_a_plain_list():
    rng = random.Random(13)
    for capacity, limit in ((10, 3), (64, 8), (4096, 512)):
        bins, plain, opened = packing.OpenBins(capacity, limit), {}, 0
        for _ in range(3000):
            length = rng.randint(1, capacity)
            taken, offset = bins.place(length)
            fits = [space for space in plain.values() if space >= length]
            if fits:
                assert plain[taken] == min(fits) and offset == capacity - plain[taken]
            else:
                assert (taken, offset) == (opened, 0)
                opened += 1
                if len(plain) == limit and length < capacity:
                    fullest = min(plain.values())
                    gone = [b for b in plain if plain[b] == fullest]
                    plain.pop(gone[-1] if len(gone) == 1 else next(b for b in gone if b not in dict(bins.left_open())))
                plain[taken] = capacity
            plain[taken] -= length
            if not plain[taken]:
                del plain[taken]
            assert sorted(bins.left_open()) == sorted((b, capacity - s) for b, s in plain.items()) and len(plain) <= limit


def check(rows, want, capacity):
    """rows: (doc_id, piece, start, length, crc, sequence, offset); want: the ids of each document with its end, by doc_id."""
    got, sequences = defaultdict(list), defaultdict(list)
    for doc_id, piece, start, length, crc, sequence, offset in rows:
        got[doc_id].append((piece, start, length, crc))
        sequences[sequence].append((offset, length))
    expected = defaultdict(list)
    for doc_id, ids in want:
        for piece, at in enumerate(range(0, len(ids) // 4, capacity)):
            own = ids[4 * at : 4 * (at + capacity)]
            expected[doc_id].append((piece, at, len(own) // 4, zlib.crc32(own)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(x[3] for x in rows) // capacity)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize(("parts", "open_bins", "fan_in"), [(1, 512, 16), (7, 2, 2), (40, 4, 3)])
def test_pieces_of_odd_tables(spark, monkeypatch, parts, open_bins, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta,", "gamma.", "x9", "naïve"], k=rng.choice([0, 1, 5, 20, 60, 200])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n "), (None, "no id"), (3, "again"), (3, "again"), (600, "z9 " * 700), (601, "one " * 63), (602, "one " * 64), (603, "one " * 127)]
    df = spark.createDataFrame([(i, t, 7, 0) for i, t in rows], "doc_id long, text string, piece int, bin int").repartition(parts)
    found = packing.pack(df, FILE, capacity=64, open_bins=open_bins).collect()
    used, least = check([tuple(r[c] for c in COLUMNS) for r in found], [(i, library(t) + b"\1\0\0\0") for i, t in rows], 64)
    assert used <= least * (1.05 if open_bins > 2 else 1.3) + 1
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in found)
    assert packing.pack(df.where("false"), FILE, capacity=64).count() == 0


def test_query_over_a_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r[c] for c in COLUMNS) for r in packing.query(documents.repartition(6), FILE).collect()]
    used, least = check(rows, [(r.doc_id, library(r.text) + b"\1\0\0\0") for r in documents.collect()], 4096)
    assert used <= least + 2


def test_sequences_hold_the_pieces(spark):
    df = spark.createDataFrame([(i, "some words here " * (i % 9)) for i in range(50)], "doc_id long, text string").repartition(4)
    pieces = packing.pack(df, FILE, capacity=16)
    want = defaultdict(list)
    for r in pieces.collect():
        want[r.sequence_id].append((r.offset, np.frombuffer(r.ids, "<u4").tolist()))
    got = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert {k: [x for _, ids in sorted(v) for x in ids] for k, v in want.items()} == {k: list(r.ids) for k, r in got.items()}
    assert pieces.agg(F.max("length")).first()[0] == 16
