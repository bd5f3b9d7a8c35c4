"""Synonym maps as tables, query expansion, and mining by co-occurrence.

A synonym table has rows (term, pos, synonym): the pos-th synonym of a term.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, EngineConfig
from lodestone.functions import ranking as rk
from lodestone.functions import text as tx
from lodestone.sources.posts import published

ENTRIES = "ord int, root string, synonyms array<string>"


def entries(spark: SparkSession, raw: dict[str, list[str] | str]) -> DataFrame:
    """A raw map (lists or comma-separated strings) as rows (ord, root, synonyms)."""
    rows = [(i, str(k), [str(x) for x in v] if isinstance(v, (list, tuple)) else str(v).split(",")) for i, (k, v) in enumerate(raw.items())]
    return spark.createDataFrame(rows, ENTRIES)


def sanitize(raw: DataFrame) -> DataFrame:
    """A synonym table from raw entries: the first term of each root is the key, all terms of its synonyms but the key are values.

    Entries without a key or without values go; of several entries with one key the last wins.
    """
    key = F.get(tx.normalize_terms(F.col("root")), F.lit(0))
    values = F.array_distinct(F.flatten(F.transform("synonyms", tx.normalize_terms)))
    clean = raw.select("ord", key.alias("term"), F.array_remove(values, key).alias("values")).where("term is not null and size(values) > 0")
    last = clean.groupBy("term").agg(F.max_by("values", "ord").alias("values"))
    return last.select("term", F.posexplode("values").alias("pos", "synonym"))


def as_lists(table: DataFrame) -> DataFrame:
    """(term, synonyms): one array for each term, in the order of pos."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "synonym"))), lambda x: x["synonym"])
    return table.groupBy("term").agg(ordered.alias("synonyms"))


def merge(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Both tables: a term's synonyms of base first, then those of extra that are new."""
    both = base.select("term", F.lit(0).alias("side"), "pos", "synonym").unionByName(extra.select("term", F.lit(1).alias("side"), "pos", "synonym"))
    first = both.groupBy("term", "synonym").agg(F.min(F.struct("side", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("term").orderBy("at")) - 1
    return first.select("term", place.alias("pos"), "synonym")


def with_inverse(table: DataFrame) -> DataFrame:
    """The table with an entry for each synonym that lists its terms; it replaces an entry that the synonym has already."""
    inverse = table.select(F.col("synonym").alias("term"), F.col("term").alias("synonym")).distinct()
    place = F.row_number().over(Window.partitionBy("term").orderBy("synonym")) - 1
    inverse = inverse.select("term", place.alias("pos"), "synonym")
    kept = table.join(inverse.select("term").distinct(), "term", "left_anti").select("term", "pos", "synonym")
    return kept.unionByName(inverse)


def expander(mapping: dict[str, list[str]], config: EngineConfig = DEFAULT):
    """A function from an array of tokens to the tokens and, after each, up to six of its synonyms; all distinct."""
    limit = max(0, config.synonym_expansion_limit)
    if not mapping:
        return lambda tokens: tokens
    known = F.create_map(*(x for k, v in mapping.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def expand(tokens: Column) -> Column:
        def own(token: Column) -> Column:
            found = F.coalesce(F.try_element_at(known, token), F.array().cast("array<string>"))
            retokenized = F.flatten(F.transform(F.slice(found, 1, limit), lambda s: tx.tokenize_query(s, config))) if limit else F.array().cast("array<string>")
            return F.concat(F.array(token), retokenized)

        return F.array_distinct(F.flatten(F.transform(tokens, own)))

    return expand


def expand(queries: DataFrame, table: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, tokens): each query's tokens expanded by a synonym table that is too large for a literal map."""
    tokens = queries.select("query_id", F.posexplode(tx.tokenize_query(F.col("query"), config)).alias("at", "token"))
    own = tokens.select("query_id", "at", F.lit(-1).alias("pos"), F.lit(0).alias("sub"), F.col("token").alias("term"))
    limited = table.where(F.col("pos") < max(0, config.synonym_expansion_limit))
    found = tokens.join(limited, tokens.token == limited.term).select("query_id", "at", "pos", F.posexplode(tx.tokenize_query(F.col("synonym"), config)).alias("sub", "term"))
    first = own.unionByName(found).groupBy("query_id", "term").agg(F.min(F.struct("at", "pos", "sub")).alias("place"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"])
    return first.groupBy("query_id").agg(ordered.alias("tokens"))


def sampled_terms(posts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(doc_rank, at, term): the distinct terms of the most recently modified posts, noise words left out.

    The sample of posts is the feature: it bounds the pairs that mining compares.
    """
    recent = published(posts, config).orderBy(F.desc("modified"), F.desc("post_id")).limit(config.synonym_sample)
    ranked = recent.select(F.row_number().over(Window.orderBy(F.desc("modified"), F.desc("post_id"))).alias("doc_rank"), "title", "content")  # synonym_sample rows
    ranked = ranked.repartition("doc_rank")  # the limit left one partition; tokenizing and pairing are the work
    tokens = tx.without(tx.tokenize_query(F.lower(F.concat_ws(" ", "title", "content")), config), config.noise_words)
    return ranked.select("doc_rank", F.posexplode(tokens).alias("at", "term"))


def candidates(sampled: DataFrame) -> DataFrame:
    """(term, freq, ord): terms of at least 5 and at most 60 % of the sampled posts, ord by first appearance; none if fewer than 10."""
    n = sampled.agg(F.count_distinct("doc_rank").alias("posts"))
    counted = sampled.groupBy("term").agg(F.count("*").alias("freq"), F.min(F.shiftleft(F.col("doc_rank").cast("long"), 32) + F.col("at")).alias("first"))
    banded = counted.crossJoin(F.broadcast(n)).where((F.col("freq") >= 5) & (F.col("freq") <= F.greatest(F.lit(5.0), F.col("posts") * 0.6)))  # n has one row
    enough = banded.agg(F.count("*").alias("found"))
    kept = banded.crossJoin(F.broadcast(enough)).where("found >= 10")
    return kept.select("term", "freq", "first")


def mine(posts: DataFrame, config: EngineConfig = DEFAULT, prepared: DataFrame | None = None) -> DataFrame:
    """A synonym table of up to five co-occurring terms for each term, by Jaccard index; terms with fewer than two go."""
    sampled = sampled_terms(posts, config) if prepared is None else prepared
    known = candidates(sampled)
    rows = sampled.join(F.broadcast(known), "term").select("doc_rank", "term", "freq", "first")  # terms of synonym_sample posts
    a = rows.select("doc_rank", F.col("term").alias("a"), F.col("freq").alias("fa"), F.col("first").alias("oa"))
    b = rows.select("doc_rank", F.col("term").alias("b"), F.col("freq").alias("fb"), F.col("first").alias("ob"))
    pairs = a.join(b, "doc_rank").where("oa < ob").groupBy("a", "b", "fa", "fb", "oa", "ob").agg(F.count("*").alias("both")).where("both >= 3")
    scored = pairs.withColumn("jaccard", F.round(rk.jaccard(F.col("both"), F.col("fa"), F.col("fb")), 9)).where(F.col("jaccard") >= config.jaccard_threshold)
    both_ways = F.explode(F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("synonym")), F.struct(F.col("b").alias("term"), F.col("a").alias("synonym"))))
    sides = scored.select(both_ways.alias("x"), "jaccard", "oa", "ob").select("x.*", "jaccard", "oa", "ob")
    best = Window.partitionBy("term").orderBy(F.desc("jaccard"), "oa", "ob")
    top = sides.withColumn("pos", F.row_number().over(best) - 1).where("pos < 5")
    return top.withColumn("n", F.count("*").over(Window.partitionBy("term"))).where("n >= 2").select("term", "pos", "synonym", "jaccard")


def suggestion_prompt(site_name: str, lines: Iterable[str]) -> str | None:
    """The prompt that asks a language model for synonyms; None without content. lines: `title: excerpt` of recent entries."""
    sample = "\n".join(list(lines)[:30])[:4000]
    if not sample.strip():
        return None
    return f'Site: {site_name}\n{sample}\n\nFor up to 15 words of these texts, name other words that searchers use for the same thing. JSON object: {{"synonyms": {{word: [other words]}}}}'
