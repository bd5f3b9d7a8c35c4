import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.config import NOISE_WORDS, STOPWORDS, EngineConfig
from lodestone.functions import text as tx

GOLDEN = {
    "iPhone15Pro": ["phone", "15pro"],
    "ABC123": ["abc123"],
    "123abc": ["abc"],
    "HTMLParser": ["html", "parser"],
    "mondayclosedtuesday7": ["mondayclosedtuesday"],
    "MondayClosedTuesday7": ["monday", "closed", "tuesday"],
    "WiFi x2y": ["wi", "fi"],
    "Étion dans ç": ["tion", "dans"],
    "3D-Print 4K": ["3d", "print", "4k"],
    "gluten-free don't": ["gluten", "free", "don"],
    "7:00 AM": [],
    "x" * 65: [],
}


def tokens(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", tx.tokenize(F.col("t"), **options)).orderBy("i").collect()]


def test_golden_tokens(spark):
    assert tokens(spark, GOLDEN) == list(GOLDEN.values())


def test_word_lists():
    assert len(STOPWORDS) == len(set(STOPWORDS)) == 123
    assert "within" in NOISE_WORDS and "rather" in NOISE_WORDS


def plain_tokens(text):
    parts = re.split(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", text)
    lower = [p.lower() for p in parts]
    return [p for p in lower if 2 <= len(p) <= 64 and not p.isdigit() and p not in STOPWORDS]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abAB12 -éZz.", max_size=40), min_size=20, max_size=60))
def test_tokens_equal_a_plain_split(spark, texts):
    assert tokens(spark, texts) == [plain_tokens(t) for t in texts]


def test_limit_filter_and_shortcodes(spark):
    config = EngineConfig(shortcodes=("gallery",), token_filter=lambda t: F.array_remove(t, "secret"))
    assert tokens(spark, ['[gallery ids="1"]alpha[/gallery] beta secret', "[outer] gamma"], config=config) == [["beta"], ["outer", "gamma"]]
    assert tokens(spark, ["one two three four five"], limit=2) == [["one", "two"]]


@pytest.mark.parametrize(("hay", "needle", "at"), [("abcabc", "bc", 4), ("aaaa", "aa", 2), ("abc", "x", -1), ("", "x", -1), ("x", "x", 0)])
def test_last_position(spark, hay, needle, at):
    assert hay.rfind(needle) == at
    assert spark.range(1).select(tx.last_position(F.lit(needle), F.lit(hay))).first()[0] == at


@pytest.mark.parametrize(
    ("url", "path", "clean"),
    [("https://e.com/a/b?c#d", "/a/b", "https://e.com/a/b?c#d"), ("https://e.com", "", "https://e.com"), ("/x y", "/x y", "/xy"), ("javascript:alert(1)", "alert(1)", ""), ("mailto:a@b.c", "a@b.c", ""), ("", "", "")],
)
def test_urls(spark, url, path, clean):
    assert spark.range(1).select(tx.url_path(F.lit(url)), tx.clean_url(F.lit(url))).first() == (path, clean)


def test_sentence_trim(spark):
    texts = ["short", "a" * 600 + ". " + "b" * 600, "a. " + "b" * 2000, "a" * 999 + "!x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.sentence_trim(F.col("t"))).collect()]
    assert got == ["short", "a" * 600 + ".", texts[2][:1000].strip(), "a" * 999 + "!"]


def test_words_end_at_every_character_but_ascii_letters_and_digits(spark):
    """The class of BETWEEN_WORDS is that of the reference's pattern for every character."""
    codes = spark.range(1, 0x11000).where("id < 55296 or id > 57343").select(tx.character(F.col("id")).alias("c"))
    assert codes.where(F.rlike("c", F.lit(tx.BETWEEN_WORDS)) != F.rlike("c", F.lit("[^a-zA-Z0-9]+"))).isEmpty()
    assert "a-zA-Z0-9" not in tx.BETWEEN_WORDS  # twelve times as slow


@pytest.mark.parametrize("space", [r"\s+", r"[\n\r\t ]+"])
def test_first_words_are_those_of_the_whole_split(spark, space):
    texts = ["", " ", "a", " a", "a ", " a b  c ", "a b c d", "  a b c d", "a b c d e f g h", " a b c ", "a b\x0bc d e f g", "a b c d ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.array_remove(F.split("t", space), "")
    for r in rows.select(*(F.struct(F.slice(whole, 1, n).alias("w"), (F.size(whole) > n).alias("more"), F.slice(tx.first_words(F.col("t"), n, space), 1, n).alias("x"), (F.size(tx.first_words(F.col("t"), n, space)) > n).alias("m")).alias(f"n{n}") for n in (1, 2, 3, 4))).collect():
        for x in r:
            assert (x.w, x.more) == (x.x, x.m)
    long = spark.createDataFrame([("word " * 1000,)], "t string").select(F.size(tx.first_words(F.col("t"), 8, space)).alias("n")).first()
    assert long.n <= 11
