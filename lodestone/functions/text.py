"""Text expressions."""

from __future__ import annotations

import json
from html.entities import html5
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, FALLBACK_STOPWORDS, EngineConfig

#: Terms are separated by runs of other characters, by letter-digit borders in lower case, and by camel-case humps.
#: \p{Alnum} is ASCII's letters and digits; a negated class of the three ranges is the same and takes twelve times as long.
BETWEEN_WORDS = r"[^\p{Alnum}]+"
INSIDE_WORDS = "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: What a word with an inner border has. Few words do: the rest are spared the look-arounds.
INNER_BORDER = "[a-z][0-9A-Z]|[0-9][a-z]|[A-Z][A-Z][a-z]"
#: Named character references of HTML, from the standard library's table.
NAMED_REFERENCES = {name.removesuffix(";"): character for name, character in html5.items() if name.endswith(";")}
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def ascii_lower(value: Column) -> Column:
    """A-Z to a-z and nothing else, so that lengths and positions stay."""
    return F.translate(value, ascii_uppercase, ascii_lowercase)


def strip_tags(value: Column) -> Column:
    """Markup removed: script and style with their content, comments, then tags. Nothing is put in their place."""

    def bare(text: Column) -> Column:
        text = F.regexp_replace(text, r"(?is)<script[^>]*>.*?</script>", "")
        text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", "")
        return F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "")

    stripped = let(text_of(value), lambda t: F.when(F.contains(t, F.lit("<")), bare(t)).otherwise(t))
    return F.trim(stripped, F.lit(" \t\n\r\0\x0b"))


def strip_shortcodes(value: Column, config: EngineConfig = DEFAULT) -> Column:
    if not config.shortcodes:
        return value
    names = "|".join(config.shortcodes)
    return F.regexp_replace(value, rf"(?s)\[({names})\b[^\]]*\](?:.*?\[/\1\])?", "")


def character(code: Column) -> Column:
    """The character of a code point; null for 0, surrogates, and what lies beyond Unicode."""
    known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(value: Column) -> Column:
    """Character references decoded once: all of HTML's names, and numbers. What isn't one stays; a reference ends with a semicolon."""
    named = F.from_json(F.lit(json.dumps(NAMED_REFERENCES)), "map<string, string>")

    def referred(name: Column) -> Column:
        number = F.when(F.rlike(name, F.lit("^#[xX]")), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("long")
        return F.when(F.startswith(name, F.lit("#")), character(number)).otherwise(F.try_element_at(named, name))

    def part(piece: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        plain = F.concat(F.lit("&"), piece)
        return F.when(name == "", plain).otherwise(let(referred(name), lambda c: F.when(c.isNull(), plain).otherwise(F.concat(c, F.substring(piece, F.length(name) + 2, F.length(piece))))))

    def decoded(pieces: Column) -> Column:
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), part), ""))

    return let(value, lambda t: F.when(F.contains(t, F.lit("&")), let(F.split(t, "&"), decoded)).otherwise(t))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_terms(value: Column) -> Column:
    """The words of a text, cut at their inner borders. A border is of letters and digits only, so a text without one has no word with one."""
    bordered = lambda w: F.rlike(w, F.lit(INNER_BORDER))
    inner = lambda w: F.when(bordered(w), F.split(w, INSIDE_WORDS)).otherwise(F.array(w))
    cut = lambda text: F.split(text, BETWEEN_WORDS)
    return let(value, lambda text: F.when(bordered(text), F.flatten(F.transform(cut(text), inner))).otherwise(cut(text)))


def _terms(parts: Column) -> Column:
    """Lower-case parts of 2 to 64 characters that aren't all digits. Parts are ASCII, so most are told by their first letter."""
    lower = F.transform(parts, F.lower)
    return F.filter(lower, lambda t: F.length(t).between(2, 64) & ((t >= "a") | F.rlike(t, F.lit("[a-z]"))))


def without(tokens: Column, words: tuple[str, ...]) -> Column:
    """tokens that aren't among words, repeats kept. A list of literals this long becomes a hash set."""
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def tokenize(value: Column, limit: Column | int | None = None, config: EngineConfig = DEFAULT) -> Column:
    """The index terms of a text in order, repeats included; the first `limit` of them after filtering if given."""
    plain = decode_entities(strip_tags(strip_shortcodes(text_of(value), config)))
    tokens = without(_terms(split_terms(plain)), config.stopwords)
    if limit is not None:
        tokens = F.slice(tokens, F.lit(1), limit if isinstance(limit, Column) else F.lit(limit))
    return config.token_filter(tokens)


def tokenize_query(value: Column, config: EngineConfig = DEFAULT) -> Column:
    return F.array_distinct(tokenize(value, config=config))


def normalize_terms(value: Column) -> Column:
    """Terms of a synonym entry: like tokenize, but entities aren't decoded and stopwords stay."""
    return _terms(split_terms(strip_tags(value)))


def fallback_tokenize(question: Column) -> Column:
    """Distinct words of at least three characters for substring matching; digits stay."""
    cleaned = F.lower(F.regexp_replace(text_of(question), r"[^a-zA-Z0-9\s]", " "))
    words = F.filter(F.split(cleaned, r"\s+"), lambda w: F.length(w) >= 3)
    return F.array_distinct(without(words, FALLBACK_STOPWORDS))


def collapse_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def excerpt_content(content: Column) -> Column:
    return collapse_spaces(strip_tags(content))


def first_words(value: Column, n: int, space: str) -> Column:
    """The first n words of a text between runs of space; more than n come back only if it has more. The rest of the text isn't split."""
    return F.array_remove(F.split(value, space, n + 3), "")  # the first piece may be empty, the last is the rest


def cut_words(value: Column, n: int, suffix: str = "") -> Column:
    """The first n words of a text, with suffix only if there were more."""

    def cut(words: Column) -> Column:
        return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, suffix).otherwise(""))

    return let(first_words(value, n, r"[\n\r\t ]+"), cut)


def trim_words(value: Column, n: int, suffix: str = "") -> Column:
    """cut_words of a text without markup."""
    return cut_words(strip_tags(value), n, suffix)


def cap_excerpt(value: Column, most: int = 600) -> Column:
    return let(value, lambda v: F.when(F.length(v) > most, F.concat(F.substring(v, 1, most - 3), F.lit("..."))).otherwise(v))


def last_position(needle: Column, haystack: Column) -> Column:
    """0-based place of needle's last occurrence in haystack, -1 if none; overlapping occurrences count."""
    reverse = F.position(F.reverse(needle), F.reverse(haystack))
    return let(reverse, lambda r: F.when(r > 0, F.length(haystack) - r - F.length(needle) + 1).otherwise(F.lit(-1)))


def sanitize_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(text_of(value)), r"[^a-z0-9_\-]", "")


def sanitize_text(value: Column) -> Column:
    """One line of plain text: no tags, single spaces, trimmed."""
    return collapse_spaces(strip_tags(value))


def clean_url(value: Column) -> Column:
    """A URL without spaces and controls; other schemes than http and https give the empty string."""
    url = F.regexp_replace(F.trim(text_of(value)), r"[\x00-\x20<>\"']", "")
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    return F.when((scheme == "") | scheme.isin("http", "https"), url).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """The path of a URL, empty if it has none."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def sentence_trim(text: Column, most: int = 1000) -> Column:
    """At most `most` characters, ending at the last . ! or ? if that lies beyond the half."""

    def short(cut: Column) -> Column:
        stop = F.greatest(*(last_position(F.lit(c), cut) for c in ".!?"))
        return let(stop, lambda s: F.when(s > most // 2, F.trim(F.substring(cut, F.lit(1), s + 1))).otherwise(F.trim(cut)))

    return F.when(F.length(text) <= most, text).otherwise(let(F.substring(text, 1, most), short))


def conversation_key(value: Column) -> Column:
    return F.concat(F.lit("conversation_"), F.regexp_replace(text_of(value), r"[^a-fA-F0-9\-]", ""))


def first_filled(*named: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, name) of the first value that isn't blank; empty strings if none."""
    value, name = F.lit(""), F.lit("")
    for label, column in reversed(named):
        trimmed = F.trim(text_of(column))
        value, name = F.when(trimmed != "", trimmed).otherwise(value), F.when(trimmed != "", F.lit(label)).otherwise(name)
    return value, name
