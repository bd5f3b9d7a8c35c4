"""Benchmark decontamination by a distributed positional inverted index, with DataFrame operations only.

The index stores every document's words once, in their order: word i of a row is the posting (term, document, i). Counts
and posting lists are taken from it. Each window of a test item looks up its rarest terms, by counts over the whole
corpus. A posting shifted by the term's place in the item is an alignment of the item with the document; the lists of a
window's rarest terms are intersected on it, equal shifts for exact phrases and near ones for proximity matches. Windows
that survive are compared word by word with the document.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Tables, broadcast_if_small

#: Terms of a window whose postings are intersected for an exact match. Two also anchor a proximity match.
RAREST = 2
#: What separates words once A-Z are lower-cased: ASCII but for digits and a-z.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Candidates of a document that a row holds, about: a text of one word repeated has as many as words.
CANDIDATES = 4096
_MATCHES = "array<struct<item_id:string,from:int,width:int>>"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    lower = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lower, _BETWEEN), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_key, item_id, start, width, own) for each window of each item, own its words; an item of fewer words, but not none, is one window.

    Windows of an item that have the same words are one. Rows grow with the items' words: none holds more than a window.
    """
    n = F.size("item")
    named = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item")).where(n > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("start")
    cut = named.select(F.xxhash64("item_id", "item").alias("item_key"), "item_id", "item", F.least(F.lit(window), n).alias("width"), starts)
    return cut.select("item_key", "item_id", "start", "width", F.slice("item", F.col("start") + 1, F.col("width")).alias("own")).dropDuplicates(["item_key", "own"])


def _term_bytes() -> Column:
    return F.octet_length("term") + 48


def _window_bytes() -> Column:
    return F.octet_length(F.array_join("own", " ")) * 2 + 64


def index(docs: DataFrame, tables: Tables, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The stored index (row, rid, n_words, words): row holds docs' columns (or keep), rid names the row, words are its postings in order, joined by spaces."""
    kept = docs.columns if keep is None else keep
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept))
    cut = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("rid"), words(F.col(f"`{text}`")).alias("words"))
    return tables.write(cut.select("row", "rid", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words")))


def _postings() -> Column:
    """The words of a row of the index; none has no word."""
    return F.when(F.col("n_words") > 0, F.split("words", " ")).otherwise(F.array().cast("array<string>"))


def ranked_terms(posted: DataFrame, windows: DataFrame, most: int, tables: Tables) -> DataFrame:
    """(item_key, start, width, place, term, n, rank, least): each window's `most` rarest terms; n counts a term's postings, least is the window's smallest n."""
    places = windows.select("item_key", "start", "width", F.posexplode("own").alias("k", "term"))
    places = tables.write(places.select("item_key", "start", "width", (F.col("start") + F.col("k")).alias("place"), "term"))
    vocabulary = places.select("term").distinct()
    counts = posted.select(F.explode(_postings()).alias("term")).join(broadcast_if_small(vocabulary, _term_bytes()), "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = tables.write(counts)
    by_window = Window.partitionBy("item_key", "start")
    found = places.join(broadcast_if_small(counts, _term_bytes()), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = found.select("*", F.row_number().over(by_window.orderBy("n", "term", "place")).alias("rank"), F.min("n").over(by_window).alias("least"))
    return tables.write(ranked.where(F.col("rank") <= most))


def alignments(posted: DataFrame, terms: DataFrame) -> DataFrame:
    """(rid, item_key, place, shift, single): the postings of terms (term, item_key, place, width); shift is the document's position less the item's place."""
    looked_up = terms.select("term", "item_key", "place", (F.col("width") == 1).alias("single")).distinct()
    lists = posted.select("rid", F.posexplode(_postings()).alias("at", "term")).join(broadcast_if_small(looked_up, _term_bytes()), "term")
    return lists.select("rid", "item_key", "place", (F.col("at") - F.col("place")).alias("shift"), "single")


def _exact(hits: DataFrame, chosen: DataFrame, windows: DataFrame) -> DataFrame:
    """(rid, item_id, from, own): windows whose rarest terms all have a posting at one shift."""
    needed = chosen.where((F.col("rank") <= RAREST) & (F.col("least") > 0)).groupBy("item_key", "start").agg(F.collect_set("place").alias("need"))
    needs = needed.groupBy("item_key").agg(F.collect_list(F.struct("start", "need")).alias("needs"), F.min(F.size("need")).alias("fewest"))
    fewest = broadcast_if_small(needs.select("item_key", "fewest"), F.lit(32))
    needs = broadcast_if_small(needs.drop("fewest"), F.size("needs") * 48 + 32)
    aligned = hits.groupBy("rid", "item_key", "shift").agg(F.collect_set("place").alias("places"))
    several = aligned.join(fewest, "item_key").where(F.size("places") >= F.col("fewest")).join(needs, "item_key")
    whole = F.filter("needs", lambda n: F.size(F.array_except(n["need"], F.col("places"))) == 0)
    starts = several.select("rid", "item_key", "shift", F.explode(F.transform(whole, lambda n: n["start"])).alias("start"))
    known = broadcast_if_small(windows.select("item_key", "start", "item_id", "own"), _window_bytes())
    return starts.join(known, ["item_key", "start"]).select("rid", "item_id", (F.col("shift") + F.col("start")).alias("from"), "own")


def _near(hits: DataFrame, chosen: DataFrame, windows: DataFrame, slop: int, missing: int) -> DataFrame:
    """(rid, item_id, from, own): windows at each place of one of their RAREST rarest terms that has another of the rarest ones near.

    Of RAREST + missing rarest terms at least RAREST stand near a match that lacks `missing` words. Shifts are dealt into cells that
    overlap, so that any two within slop of each other share one, and a frequent term meets only postings near it.
    """
    span = 2 * (slop + 1)
    cells = F.array(F.floor(F.col("shift") / span) * 2, F.floor((F.col("shift") + slop + 1) / span) * 2 + 1)
    dealt = hits.select("rid", "item_key", F.explode(cells.cast("array<int>")).alias("cell"), "place", "shift", "single")
    met = dealt.groupBy("rid", "item_key", "cell").agg(F.collect_set(F.struct("place", "shift")).alias("hits"), F.min("place").alias("a"), F.max("place").alias("z"), F.max("single").alias("single"))
    beside = F.filter("hits", lambda x: F.col("single") | F.exists("hits", lambda y: (y["place"] != x["place"]) & (F.abs(y["shift"] - x["shift"]) <= slop)))
    pairs = met.where("a < z or single").select("rid", "item_key", F.explode(beside).alias("hit")).select("rid", "item_key", "hit.place", "hit.shift").distinct()
    anchors = chosen.where((F.col("rank") <= RAREST) & (F.col("n") > 0)).select("item_key", "start", "place")
    start = pairs.join(broadcast_if_small(anchors, F.lit(40)), ["item_key", "place"]).select("rid", "item_key", "start", (F.col("shift") + F.col("start")).alias("from")).distinct()
    known = broadcast_if_small(windows.select("item_key", "start", "item_id", "own"), _window_bytes())
    return start.join(known, ["item_key", "start"]).select("rid", "item_id", "from", "own")


def _at(words: Column, place: Column, word: Column) -> Column:
    """Whether a word stands at a place, which may lie outside. A look-up of one word, however long the document is."""
    return F.coalesce(F.get(words, place) == word, F.lit(False))


def _same(words: Column, c: Column) -> Column:
    """Whether the candidate's words stand at their places."""
    return F.forall(F.transform(c["own"], lambda word, k: _at(words, c["from"] + k, word)), lambda x: x)


def _close(words: Column, c: Column, window: int, slop: int, missing: int) -> Column:
    """Whether the candidate's words, all but `missing` of a whole window, stand within slop of their places."""
    off = F.array(*(F.lit(d) for d in range(-slop, slop + 1)))
    stands = F.transform(c["own"], lambda word, k: F.exists(off, lambda d: _at(words, c["from"] + k + d, word)))
    return F.size(F.filter(stands, lambda x: ~x)) <= F.when(F.size(c["own"]) == window, missing).otherwise(0)


def _confirmed(posted: DataFrame, found: DataFrame, few: bool, tables: Tables, **good) -> DataFrame:
    """(rid, and for each name of good an array of (item_id, from, width)) of the candidates found (rid, item_id, from, own) for which good holds.

    A document's candidates are rows of at most about CANDIDATES. Rows that have a match are few: they are broadcast behind
    a check of their size, else joined by a shuffle. Rows that have a candidate may be told to be `few`; else their number
    follows the corpus, and they are always shuffled.
    """
    each_once = tables.write(found.select("rid", "item_id", F.col("from").cast("int").alias("from"), "own").distinct())
    many = each_once.groupBy("rid").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("item_id", "from"), F.col("parts")), F.lit(0))
    dealt = each_once.join(broadcast_if_small(many, F.lit(32)), "rid", "left").withColumn("part", part)
    by_row = tables.write(dealt.groupBy("rid", "part").agg(F.collect_list(F.struct("item_id", "from", "own")).alias("c")).drop("part"))
    weight = F.octet_length(F.array_join(F.flatten(F.col("c.own")), "")) + F.size("c") * 96 + 32
    by_row = broadcast_if_small(by_row, weight) if few else by_row.hint("merge")
    named = lambda c: F.struct(c["item_id"].alias("item_id"), c["from"].alias("from"), F.size(c["own"]).alias("width"))

    def those(holds) -> Column:  # the words are split once for all candidates of a row
        return F.get(F.transform(F.array(_postings()), lambda ws: F.transform(F.filter("c", lambda c: holds(ws, c)), named)), F.lit(0))

    each = [those(holds).alias(name) for name, holds in good.items()]
    kept = posted.select("rid", "n_words", "words").join(by_row, "rid").select("rid", *each)
    n = sum((F.size(name) for name in good), F.lit(0))
    whole = tables.write(kept.where(n > 0)).groupBy("rid").agg(*(F.flatten(F.collect_list(name)).alias(name) for name in good))
    return broadcast_if_small(tables.write(whole), n * 64 + 32)


def matched(docs: DataFrame, items: DataFrame, window: int = 10, slop: int | None = None, missing: int = 0, keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, matches, near) for each row of docs: row holds its columns (or keep), matches and near are arrays of (item_id, from, width).

    All windows of all items against all words of all documents: the rarest terms only choose which windows are compared.
    near is empty without a slop. Null and empty texts have no words and no matches; an item without words has no window;
    repeated items match by each of their ids; rows that share or lack a doc_id are rows like others.
    """
    tables = Tables(docs.sparkSession)
    posted = index(docs, tables, keep)
    windows = tables.write(item_windows(items, window))
    chosen = ranked_terms(posted, windows, RAREST + missing, tables)
    hits = alignments(posted, chosen.where("n > 0"))
    if slop is None:
        found = _confirmed(posted, _exact(hits, chosen, windows), True, tables, matches=_same)
    else:  # an exact match is a near one, so both come from one list
        found = _confirmed(posted, _near(hits, chosen, windows, slop, missing), False, tables, matches=_same, near=lambda ws, c: _close(ws, c, window, slop, missing))
    tables.drop(posted, found)
    none = F.array().cast(_MATCHES)
    both = posted.select("row", "rid", "n_words").join(found, "rid", "left")
    return both.select("row", "n_words", F.coalesce("matches", none).alias("matches"), (none if slop is None else F.coalesce("near", none)).alias("near"))


def exact_matches(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs with n_words and matches, an array of (item_id, from, width): whole windows of items in the document at word from.

    Columns of docs that have these names are replaced; others pass through, whatever their names. See matched for the rest.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "matches")]
    found = matched(docs, items, window, keep=kept)
    return found.select(*(F.col(f"row.`{c}`") for c in kept), "n_words", "matches")


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 4, missing: int = 0) -> DataFrame:
    """(doc_id, item_id, from): windows of items whose words all stand near their places in the document, each within slop.

    A window of full width may lack `missing` of its words. It is placed by one of its RAREST rarest terms, by corpus
    counts, then term, then place: that one stands exactly at its place, counted from `from`, which may lie before the text.
    """
    found = matched(docs, items, window, slop, missing, keep=["doc_id"])
    return found.select("row.doc_id", F.explode("near").alias("m")).select("doc_id", "m.item_id", "m.from").distinct()


def covered(matches: Column) -> Column:
    """The positions that matches cover, each once."""
    return F.array_distinct(F.flatten(F.transform(matches, lambda m: F.sequence(m["from"], m["from"] + m["width"] - 1))))


def query(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 4) -> DataFrame:
    found = matched(docs.select("doc_id", "text"), items, window, slop, keep=["doc_id"])
    ids = lambda c: F.array_sort(F.array_distinct(F.col(f"{c}.item_id")))
    flat = found.select("row.doc_id", "n_words", F.size(covered(F.col("matches"))).cast("long").alias("n_hit"), ids("matches").alias("ids"), ids("near").alias("near"))
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return flat.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), digest("ids").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near_items"), digest("near").alias("near_items_sha256")
    )
