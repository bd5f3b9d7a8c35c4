"""Colour expressions over #rrggbb strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luminance up to which a colour can be read on white.
USABLE = 0.45
DEFAULT_COLOR = "#005FA3"


def sanitize_hex(value: Column) -> Column:
    """#rgb or #rrggbb in lower case, the empty string for anything else."""
    digits = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^#", "")
    return F.when(F.rlike(digits, F.lit("^(?:[a-fA-F0-9]{3}|[a-fA-F0-9]{6})$")), F.concat(F.lit("#"), F.lower(digits))).otherwise(F.lit(""))


def channels(color: Column) -> list[Column]:
    """Red, green and blue as 0 to 255."""
    digits = F.regexp_replace(color, "^#", "")
    full = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return [F.conv(F.substring(full, at, 2), 16, 10).cast("int") for at in (1, 3, 5)]


def _linear(channel: Column) -> Column:
    x = channel.cast("double") / 255.0
    return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def luminance(color: Column) -> Column:
    r, g, b = map(_linear, channels(color))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def darken(color: Column, share: float = 0.35) -> Column:
    return F.format_string("#%02x%02x%02x", *(F.greatest(F.lit(0), F.round(c * (1 - share))).cast("int") for c in channels(color)))
