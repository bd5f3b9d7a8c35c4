"""BM25 and similarity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, EngineConfig


def idf(total_docs: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5) + 1), always above zero."""
    return F.log((total_docs - df + 0.5) / (df + 0.5) + 1.0)


def weighted_frequency(title: Column, excerpt: Column, content: Column, config: EngineConfig = DEFAULT) -> Column:
    w = config.weights()
    return (title * F.lit(float(w["title"])) + excerpt * F.lit(float(w["excerpt"])) + content * F.lit(float(w["content"]))).cast("double")


def term_score(tf: Column, df: Column, total_docs: Column, doc_length: Column, avgdl: Column, config: EngineConfig = DEFAULT) -> Column:
    """BM25 of one term; 0 without the term or without documents. Lengths below 1 count as 1."""
    length = F.greatest(doc_length.cast("double"), F.lit(1.0))
    mean = F.greatest(avgdl.cast("double"), F.lit(1.0))
    norm = tf + config.k1 * (1 - config.b + config.b * length / mean)
    score = idf(total_docs.cast("double"), df.cast("double")) * tf * (config.k1 + 1) / norm
    return F.when((tf <= 0) | (total_docs <= 0), F.lit(0.0)).otherwise(score)


def intent_boost(intent: Column, post_type: Column, config: EngineConfig = DEFAULT) -> Column:
    boost = F.lit(1.0)
    for name, by_type in config.intent_boosts.items():
        for kind, factor in by_type.items():
            boost = F.when((intent == name) & (post_type == kind), F.lit(float(factor))).otherwise(boost)
    return boost


def jaccard(both: Column, a: Column, b: Column) -> Column:
    return both.cast("double") / (a + b - both).cast("double")
