"""Substring search over posts by an n-gram index of their vocabulary.

A word of a query holds no white space, so it stands in a text exactly if it stands in one of the text's words. So the
index is of words: which posts have each, and which trigrams each has. A query's word looks up its rarest trigram, and the
few words with that one are compared. The posts of a query's rarest word are its candidates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, EngineConfig
from lodestone.functions import text as tx
from lodestone.sources.posts import published
from lodestone.sources.store import materialised, scratch

#: Stand before and after a word, so that a word of one letter has a trigram and each of its parts lies in one.
_FIRST, _LAST = "\x02", "\x03"
#: Rows up to which what a batch looks up meets the index by a broadcast: words that hold a word of a query, and pairs of
#: a query's word and a trigram. The same join runs shuffled beyond.
BROADCAST_TOKENS = 500_000
#: Folders of the postings. Each task that reads posts writes a file into each.
BUCKETS = 16


class SubstringIndex(NamedTuple):
    """postings (token, post_id, bucket); grams (gram, token, posts), posts how many have the token; parts (part, gram, n): the strings inside each trigram, itself included, and how many words have it."""

    postings: DataFrame
    grams: DataFrame
    parts: DataFrame


def _bucket(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def tokens_of(text: Column) -> Column:
    """The distinct words between white space of a lower-cased text."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"\s+"), ""))


def _strings(word: Column, size: int) -> Column:
    """The distinct strings of `size` characters in a word; none for a shorter one."""

    def cut(letters: Column) -> Column:
        last = F.size(letters) - size
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(*(F.get(letters, i + d) for d in range(size))))
        return F.when(last >= 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return tx.let(F.split(word, ""), cut)


def _grams(word: Column) -> Column:
    return _strings(F.concat(F.lit(_FIRST), word, F.lit(_LAST)), 3)


def index(posts: DataFrame, config: EngineConfig = DEFAULT) -> SubstringIndex:
    """The index of title, excerpt and content of published posts, as a plan."""
    text = F.concat_ws("\n", "title", "excerpt", "content")
    postings = published(posts, config).select("post_id", F.explode(tokens_of(text)).alias("token")).withColumn("bucket", _bucket("token"))
    grams = _grams_of(postings)
    return SubstringIndex(postings, grams, _parts(grams))


def _grams_of(postings: DataFrame) -> DataFrame:
    vocabulary = postings.groupBy("token").agg(F.count("*").alias("posts"))
    return vocabulary.select("token", "posts", F.explode(_grams(F.col("token"))).alias("gram"))


def _parts(grams: DataFrame) -> DataFrame:
    counted = grams.groupBy("gram").agg(F.count("*").alias("n"))
    inside = F.array_distinct(F.concat(*(_strings(F.col("gram"), size) for size in (1, 2, 3))))
    return counted.select("gram", "n", F.explode(inside).alias("part"))


def written(found: SubstringIndex) -> SubstringIndex:
    """The index as tables in a folder of their own: a look-up reads the buckets of the words that it found.

    Postings aren't moved: each task writes those of its posts, by bucket only, as a look-up reads all of a bucket.
    """
    spark = found.postings.sparkSession
    folder = scratch(spark)
    found.postings.write.partitionBy("bucket").parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    _grams_of(postings).write.parquet(f"{folder}/grams")
    grams = spark.read.parquet(f"{folder}/grams")
    _parts(grams).write.parquet(f"{folder}/parts")
    return SubstringIndex(postings, grams, spark.read.parquet(f"{folder}/parts"))


def _few(rows: DataFrame) -> DataFrame:
    """rows with a broadcast hint if they are no more than BROADCAST_TOKENS, else as they are, for a shuffled join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_TOKENS else rows


def tokens_with(words: DataFrame, found: SubstringIndex) -> DataFrame:
    """(word, token, n): the indexed words that hold each of words (word), which have no white space, and how many posts have them."""
    own = words.select("word").distinct().withColumn("long", F.length("word") >= 3)
    asked = own.select("word", "long", F.explode(F.when(F.col("long"), _strings(F.col("word"), 3)).otherwise(F.array("word"))).alias("part"))
    met = asked.join(found.parts, "part")
    # of a long word all trigrams are in any word that holds it: the rarest does; a short one may be in any trigram
    rarest = met.where("long").groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    looked = rarest.unionByName(met.where("not long").select("word", "gram"))
    return found.grams.join(_few(materialised(looked)), "gram").where(F.contains("token", F.col("word"))).select("word", "token", "posts").distinct()


def candidates(asked: DataFrame, found: SubstringIndex) -> DataFrame:
    """(query_id, post_id, word): for each of asked (query_id, words array<string>, distinct) the posts with its rarest word; none if a word is in no post.

    A frequent word's posts are listed only for queries that have no rarer one. The words looked up are written once, and
    postings aren't moved unless those are more than BROADCAST_TOKENS.
    """
    words = asked.select("query_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    tokens = materialised(tokens_with(words, found))
    weights = tokens.groupBy("word").agg(F.sum("posts").alias("weight"))
    chosen = words.join(weights, "word").groupBy("query_id", "n").agg(F.count("*").alias("met"), F.min_by("word", F.struct("weight", "word")).alias("word")).where("met = n").select("query_id", "word")
    chosen = materialised(chosen)
    placed = tokens.join(chosen.select("word").distinct(), "word", "left_semi").select("word", "token", _bucket("token").alias("bucket"))
    listed = found.postings.join(_few(placed), ["bucket", "token"]).select("word", "post_id").distinct()
    return chosen.join(listed, "word").select("query_id", "post_id", "word")
