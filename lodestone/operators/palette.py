"""Choosing a site's brand colour from its palette."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import color as cl
from lodestone.functions.text import sanitize_key

# Palette slugs from most to least preferred.
PREFERRED = ("primary", "accent", "contrast", "heading", "foreground", "text")


def resolve(palettes: DataFrame) -> DataFrame:
    """(site, color) for palettes (site, pos, slug, color).

    The first usable colour by preferred slug; else the darkest if usable, else the darkest darkened; the default colour
    for a site without a valid one.
    """
    clean = palettes.select("site", "pos", sanitize_key(F.col("slug")).alias("slug"), cl.sanitize_hex(F.col("color")).alias("color"))
    valid = clean.where("color <> ''").withColumn("luminance", F.round(cl.luminance(F.col("color")), 12))
    usable = F.col("luminance") <= cl.USABLE
    place = F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("slug"))
    order = F.when(usable & (place > 0), F.struct(place.alias("place"), "pos"))
    best = valid.groupBy("site").agg(F.min_by("color", order).alias("preferred"), F.min_by("color", F.struct("luminance", "pos")).alias("darkest"), F.min("luminance").alias("least"))
    # white never counts as the darkest colour
    darkest = F.when(F.col("least") >= 1, cl.DEFAULT_COLOR).when(F.col("least") <= cl.USABLE, F.col("darkest")).otherwise(cl.darken(F.col("darkest")))
    chosen = best.select("site", F.coalesce("preferred", darkest).alias("color"))
    return palettes.select("site").distinct().join(chosen, "site", "left").select("site", F.coalesce("color", F.lit(cl.DEFAULT_COLOR)).alias("color"))
