"""Reading JSON out of a language model's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import last_position, text_of


def json_extract(raw: Column) -> Column:
    """What lies from the first { to the last }, code fences removed; null if there is no such stretch."""
    text = F.regexp_replace(F.trim(text_of(raw), F.lit(" \t\n\r")), r"(?i)^```(?:json)?\s*", "")
    text = F.regexp_replace(text, r"\s*```$", "")
    start, end = F.position(F.lit("{"), text), last_position(F.lit("}"), text) + 1
    return F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))


def completion_text(body: Column) -> Column:
    """The answer in a completion service's reply: payload.choices[0].text, else payload.text; null for a failure and without either."""
    found = F.coalesce(*(F.nullif(F.get_json_object(body, path), F.lit("")) for path in ("$.payload.choices[0].text", "$.payload.text")))
    failed = F.coalesce(F.get_json_object(body, "$.status"), F.lit("")) == "Failure"
    return F.when(~failed, found)
