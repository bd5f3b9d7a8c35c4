"""Groups of spelling variants in a corpus's vocabulary, without pairs of words.

Words are near if they differ by one replaced, inserted or deleted code point. A word of n letters belongs to n wildcard
groups, (position, prefix, suffix) with that position's letter left out. Words of a group are near each other, so a group
needs no more than its size and its two most frequent words: the first is the best partner of all others, the second that
of the first. A word less one letter that is a word itself is near by an insertion: the same strings, now without the
position, meet the vocabulary. A word takes its count and its best partner from those summaries.

A group's members differ in one letter, so no group is larger than the alphabet times the word's length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Tables, map_batches

#: Code points of a word at least, its occurrences at least, and how many times as frequent a form must be.
SHORTEST, OFTEN, TIMES = 6, 5, 5

#: A run is misspelt by a rule where this divides its checksum.
DELETES = 199

_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """(word, n): runs of Latin letters of whole texts with A-Z lower-cased, as they are or less a letter, that have at least shortest code points and often occurrences.

    Where DELETES divides the unsigned CRC-32 h of "<key>:<run>", the run loses its code point h % length. A row without a
    key writes it as null. Null texts have no words. Words are counted in each slice of rows before they are shuffled.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}").findall  # shorter runs can't give a word

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter[str] = Counter()
        for own, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if whole:
                start = zlib.crc32(f"{'null' if own is None else own}:".encode())
                for word, n in Counter(runs(whole.translate(_LOWER))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DELETES == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] += n
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    words = map_batches(docs.select(F.col(key).cast("string"), F.col(text)), "word string, n long", run)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _partner(n: Column | str = "n", word: Column | str = "word") -> Column:
    """Orders partners: the most frequent first, then the smallest in code-point order. So the least of these is the best."""
    return F.struct((-F.col(n) if isinstance(n, str) else -n).alias("less"), (F.col(word) if isinstance(word, str) else word).alias("word"))


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<less, word>) of each word of (word, n) that has a near one; best.less is the partner's n, negated.

    Two shuffles of a row for each letter of each word, and one of the rows of groups with partners; none holds pairs.
    """
    places = F.sequence(F.lit(1), F.length("word"))
    at = words.select("word", "n", F.explode(places).alias("at"))
    less = at.withColumn("rest", F.concat(F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1)")))

    group = Window.partitionBy("at", "rest")
    ranked = group.orderBy(F.desc("n"), "word")
    sized = less.select("word", "n", F.count("*").over(group).alias("size"), F.row_number().over(ranked).alias("place"), F.first(_partner()).over(ranked).alias("top"), F.lead(_partner()).over(ranked).alias("next"))
    replaced = sized.where("size > 1").select("word", (F.col("size") - 1).alias("n_near"), F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top")).alias("best"))

    # of equal letters beside each other, leaving out any gives the same string: the first stands for them
    shorter = less.where("at = 1 or substring(word, at, 1) <> substring(word, at - 1, 1)").select("rest", "word", "n", F.lit(False).alias("whole"))
    met = shorter.unionByName(words.select(F.col("word").alias("rest"), "word", "n", F.lit(True).alias("whole")))
    same = Window.partitionBy("rest")
    summed = met.select(
        "word", "whole",
        F.count(F.when(~F.col("whole"), 1)).over(same).alias("longer"), F.min(F.when(~F.col("whole"), _partner())).over(same).alias("top"),
        F.min(F.when(F.col("whole"), _partner())).over(same).alias("shorter"),
    )
    inserted = summed.where(F.col("whole") & (F.col("longer") > 0)).select("word", F.col("longer").alias("n_near"), F.col("top").alias("best"))
    deleted = summed.where(~F.col("whole") & F.col("shorter").isNotNull()).select("word", F.lit(1).cast("long").alias("n_near"), F.col("shorter").alias("best"))
    return replaced.unionByName(inserted).unionByName(deleted).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of (word, n), which is a written table.

    form is the best near word if it is at least times as frequent, root what the forms lead to. Each form is times as
    frequent as the word before it, so a chain is as long as the logarithm of the largest count, and roots are found by
    doubling in its logarithm of rounds.
    """
    tables = Tables(words.sparkSession)
    known = words.join(near(words), "word", "left")
    good = -F.col("best.less") >= times * F.col("n")
    rows = tables.write(known.select("word", F.when(good, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, -F.col("best.less")).alias("form_n")))
    ups = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = ups.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = tables.write(ups.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ups = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    out = rows.join(ups, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return tables.last(out)


def query(documents: DataFrame) -> DataFrame:
    """The spelling variants of all documents. Empty tables give no rows; repeated rows count; texts of any length count whole; other columns don't matter."""
    words = Tables(documents.sparkSession)
    found = forms(words.write(counted(documents)))
    words.drop()
    return found
