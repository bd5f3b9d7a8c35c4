"""Main text of web pages by structure and nearest-URL page differencing.

A page becomes lines (blocks of text) whose containers say article, boilerplate or nothing; those of boilerplate go. The
others, of every page, are differenced: the different contents of a host are ordered by URL path, each is paired with its
nearest neighbour there, and the lines of both are aligned by a longest common subsequence. A shared line that says nothing,
on a page without an article, goes if it repeats across the host. Inside an article, where copies and versions share most
lines and short ones repeat by chance, it takes more: over half of the host's articles must find the line in an alignment
with a page that shares less than half of their text. Differencing alone can't decide the rest: menus, adverts and footers
differ from page to page.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Tables, broadcast_if_small, map_batches, slices, workers_ready

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"""[^>"']*""")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe desc metadata annotation annotation-xml select button".split())
_FOREIGN = frozenset(("svg", "math"))
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mspace mstyle mpadded semantics tspan".split())
_ARTICLE = frozenset(("article", "main"))
#: Elements and roles that hold no part of an article.
_BOILERPLATE = frozenset("nav footer aside form dialog menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words that mark a container if they are a whole class (or, for those that name a part of a page, an id), by themselves
#: or within one of these prefixes and suffixes. So "sidebar" and "site-sidebar" mark one, "no-sidebar" doesn't.
_WORDS = "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice notices menu nav navbar navigation sidebar breadcrumb breadcrumbs footer comment comments disqus commentlist share sharing social related newsletter subscribe signup popup modal".split()
_PARTS = "comments cookie-banner cookie-consent cookie-notice disqus_thread newsletter-signup related-articles related-posts share-buttons sidebar".split()
_OUTSIDE = "header banner masthead topbar topnav toolbar copyright".split()
_PREFIXES = "site page main top bottom left right global primary secondary side sticky fixed mobile desktop".split()
_SUFFIXES = "area articles bar banner block box buttons column container content form group inner items label links list menu notice overlay panel posts section slot thread unit widget wrap wrapper".split()


def _marks(words: list[str]) -> re.Pattern[str]:
    either = "|".join
    return re.compile(rf"(?:(?:{either(_PREFIXES)})[-_])?(?:{either(words)})(?:[-_](?:{either([*_SUFFIXES, *_WORDS])}))*")


_MARKED, _MARKED_OUTSIDE, _NAMED_PART = _marks([*_WORDS, "author-social"]), _marks([*_WORDS, *_OUTSIDE]), _marks([*_PARTS, "comments-section"])
_ASIDE = frozenset("comment comments ad advert advertisement promo related teaser sponsored".split())
#: A class, id or role counts on these elements only.
_CONTAINERS = frozenset("div section ul ol dl table p li details center span header".split())
#: Elements whose end tag may be omitted: what a start tag closes, and what shields those outside of it.
_ENDS = {name: (frozenset("p".split()), frozenset("table caption td th".split())) for name in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
_ENDS |= {"li": (frozenset("li p".split()), frozenset("ul ol menu table td th".split()))}
_ENDS |= {name: (frozenset("dt dd p".split()), frozenset("dl table td th".split())) for name in ("dt", "dd")}
_ENDS |= {name: (frozenset("td th".split()), frozenset("table tr".split())) for name in ("td", "th")}
_ENDS |= {"tr": (frozenset("tr td th caption".split()), frozenset(("table",)))}
_ENDS |= {name: (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(("table",))) for name in ("thead", "tbody", "tfoot")}
#: What a line's containers say. OPEN_FORM: boilerplate, unless an article lies in it, as where a form wraps the whole page.
ARTICLE, OTHER, NONE, OPEN_FORM = 2, 1, 0, -1
#: Different contents of a host that hold a line, from which on it is taken for one of its template.
REPEATS = 3
#: Rows of the alignment that are kept at once; others are worked out again on the way back.
ROWS_KEPT = 512
#: Bytes of a digest that stands for a line, and for a content, while pages are compared.
LINE_BYTES, ENTRY_BYTES = 12, 16


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in _ARTICLE:  # a reader's comment or an advert may be an article element of its own
        return any(not _ASIDE.isdisjoint((a or b or c).lower().split()) for name, a, b, c in _NAMED.findall(attributes) if name.lower() == "class")
    if tag in _BOILERPLATE or tag == "header" and not in_article:
        return True
    if tag not in _CONTAINERS or in_article and tag in ("span", "header"):
        return False
    for name, a, b, c in _NAMED.findall(attributes) if attributes else ():
        tokens, name = (a or b or c).lower().split(), name.lower()
        marks = _MARKED_OUTSIDE if not in_article else _NAMED_PART if name == "id" else _MARKED
        if any(t in _ROLES if name == "role" else marks.fullmatch(t) for t in tokens):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag in page order, with an empty name for comments and declarations.

    A quote in a tag lasts until the next one; one that never ends is a character like any other. A tag, comment or
    declaration that never ends lasts to the end of the page. Each character is passed once. After a tag whose content is
    raw, the reader sends the place from which to go on.
    """
    at, last = 0, {q: page.rfind(q) for q in "\"'"}
    while (start := page.find("<", at)) >= 0:
        m = _TAG.match(page, start)
        if not m:
            at = start + 1
            if page.startswith("!--", at):
                end = page.find("-->", at + 3)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith(("!", "?"), at):
                at = page.find(">", at) + 1 or len(page)
            else:
                continue
            yield start, at, "", "", ""
            continue
        at = m.end()
        while True:
            at = _UNQUOTED.match(page, at).end()
            if at == len(page) or page[at] == ">":
                break
            at = page.find(page[at], at + 1) + 1 if at < last[page[at]] else at + 1
        own = page[m.end() : at]
        at = min(at + 1, len(page))
        onward = yield start, at, m[1], m[2].lower(), own
        if onward is not None:
            at = onward
            yield start, at, "", "", ""  # what send() returns


def lines(page: str | None) -> list[tuple[int, str]]:
    """(ARTICLE or OTHER, text) of each block outside boilerplate, in page order, white space as single spaces.

    End tags may be omitted as HTML allows; a slash before the end of a tag closes nothing but in SVG and MathML.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # (element, kind of its text)
    kind, parts, at, foreign = OTHER, [], 0, 0
    page = page or ""
    where: dict[str, list[int]] = {}  # the places of open elements in the stack, by name

    def flush() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((kind, text))
            parts.clear()

    def pop(n: int) -> None:
        nonlocal kind, foreign
        for x, _ in stack[len(stack) - n :]:
            where[x].pop()
            foreign -= x in _FOREIGN
        del stack[len(stack) - n :]
        if (new := stack[-1][1] if stack else OTHER) != kind:
            flush()
            kind = new

    def end_omitted(name: str) -> None:
        """Closes the open elements that a start tag ends."""
        ended, shields = _ENDS[name]
        above = max((where[x][-1] for x in shields if where.get(x)), default=-1)
        first = min((own[i] for x in ended if (own := where.get(x)) and (i := bisect_right(own, above)) < len(own)), default=None)
        if first is not None:
            pop(len(stack) - first)

    tags = tokens(page)
    for start, end, slash, name, attributes in tags:
        if kind > NONE:
            parts.append(page[at:start])
        at = end
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if slash:
            if where.get(name):
                pop(len(stack) - where[name][-1])
            continue
        if name in _ENDS:
            end_omitted(name)
        closed = foreign and attributes.endswith("/")
        if name in _RAW:
            if not closed:
                ending = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = ending.end() if ending else len(page)
                tags.send(at)
        elif name not in _VOID and not closed:
            if kind == NONE or _boilerplate(name, attributes, kind == ARTICLE):
                new = OPEN_FORM if name == "form" and kind == OTHER else NONE
            else:
                new = ARTICLE if name in _ARTICLE else kind
            if new != kind:
                flush()
                kind = new
            where.setdefault(name, []).append(len(stack))
            stack.append((name, kind))
            foreign += name in _FOREIGN
    if kind > NONE:
        parts.append(page[at:])
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """The places in a of a longest common subsequence of a and b, by bit-parallel rows.

    Lines that the other side lacks, and those that both begin or end with, need no alignment. Of the rows of the rest every
    ROWS_KEPT-th is kept, and a stretch of them worked out again on the way back, so memory stays far below their product.
    """
    in_a, in_b = set(a), set(b)
    left, b = [(i, x) for i, x in enumerate(a) if x in in_b], [x for x in b if x in in_a]
    begin = 0
    while begin < min(len(left), len(b)) and left[begin][1] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(left), len(b)) - begin and left[-1 - end][1] == b[-1 - end]:
        end += 1
    found = {i for i, _ in left[:begin]} | {i for i, _ in left[len(left) - end :]}
    left, b = left[begin : len(left) - end], b[begin : len(b) - end]
    if not left or not b:
        return found
    where: dict[str, int] = {}
    for i, (_, x) in enumerate(left):
        where[x] = where.get(x, 0) | 1 << i
    mask = (1 << len(left)) - 1

    def following(v: int, x: str) -> int:
        u = v & where.get(x, 0)
        return ((v + u) | (v - u)) & mask

    v, kept = mask, [mask]
    for j, x in enumerate(b, 1):
        v = following(v, x)
        if j % ROWS_KEPT == 0:
            kept.append(v)
    i, j = len(left), len(b)
    for stretch in reversed(range(len(kept))):
        rows = [kept[stretch]]
        for x in b[stretch * ROWS_KEPT : min(j, (stretch + 1) * ROWS_KEPT)]:
            rows.append(following(rows[-1], x))
        while i and j > stretch * ROWS_KEPT:
            if rows[j - stretch * ROWS_KEPT] >> (i - 1) & 1:
                i -= 1
                continue
            j -= 1
            if rows[j - stretch * ROWS_KEPT] >> (i - 1) & 1:
                i -= 1
                found.add(left[i][0])
    return found


def _host_and_path(url: str | None) -> tuple[str, str]:
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def _entry(url: str | None, found: list[tuple[int, str]]) -> bytes | None:
    """Names the content of a page by its host and lines; null for pages without any."""
    return hashlib.sha256("\n".join([_host_and_path(url)[0], *(x for _, x in found)]).encode()).digest()[:ENTRY_BYTES] if found else None


def _digests(packed: bytes) -> list[bytes]:
    return [packed[i : i + LINE_BYTES] for i in range(0, len(packed), LINE_BYTES)]


def _shared(content: dict, near: list[dict | None]) -> dict[str, list[int]]:
    """Places of content's lines that the nearest of near shares: in_article, those an article votes for; in_other, those of a content that a page without one has."""
    beside = [x for x in near if x and x["host"] == content["host"]]
    nearest = max(beside, key=lambda x: len(commonprefix([x["path"], content["path"]])), default=None)
    found = sorted(common_lines(_digests(content["digests"]), _digests(nearest["digests"]))) if nearest else []
    weights = content["weights"]
    votes = 2 * sum(weights[i] for i in found) < sum(weights)
    return {"in_article": [i for i in found if weights[i]] if votes else [], "in_other": found if content["open"] else []}


def _compared(contents: DataFrame, tables: Tables) -> DataFrame:
    """(entry, host, digests, article, in_article, in_other) of contents (entry, host, path, digests, weights, open), each compared with the nearer of those beside it.

    In the order of host, path and entry, which is cut into ranges, so a host with a third of all pages spans many tasks.
    A range is compared as it streams past, three contents at a time; its first and last one wait, in a table of two rows
    for each range, for those of the ranges beside it.
    """
    order = ["host", "path", "entry"]
    near = "struct<host: string, path: string, digests: binary>"
    columns = "entry binary, host string, digests binary, article boolean, in_article array<int>, in_other array<int>"
    edge = f"edge struct<path: string, weights: array<int>, open: boolean, before: {near}, after: {near}>"
    places = pa.list_(pa.int32())
    arrow_near = pa.struct([("host", pa.string()), ("path", pa.string()), ("digests", pa.binary())])
    arrow_edge = pa.struct([("path", pa.string()), ("weights", places), ("open", pa.bool_()), ("before", arrow_near), ("after", arrow_near)])
    arrow = pa.schema([("entry", pa.binary()), ("host", pa.string()), ("digests", pa.binary()), ("article", pa.bool_()), ("in_article", places), ("in_other", places)])
    with_edge = arrow.append(pa.field("edge", arrow_edge))

    def placed(before: dict | None, here: dict, after: dict | None) -> dict:
        out = {"entry": here["entry"], "host": here["host"], "digests": here["digests"], "article": max(here["weights"]) > 0, "edge": None}
        if before and after:
            return out | _shared(here, [before, after])
        beside = {k: x and {name: x[name] for name in ("host", "path", "digests")} for k, x in (("before", before), ("after", after))}
        return out | {"in_article": None, "in_other": None, "edge": {name: here[name] for name in ("path", "weights", "open")} | beside}

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = here = None
        for part in (x for batch in batches for x in slices(batch)):
            out = []
            for row in part.to_pylist():
                if here:
                    out.append(placed(before, here, row))
                before, here = here, row
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=with_edge)
        if here:
            yield pa.RecordBatch.from_pylist([placed(before, here, None)], schema=with_edge)

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [{k: row[k] for k in ("entry", "host", "digests", "article")} | _shared(row, [row["before"], row["after"]]) for row in batch.to_pylist()]
        return pa.RecordBatch.from_pylist(out, schema=arrow)

    workers_ready(contents.sparkSession)
    compared = tables.write(contents.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(ranges, f"{columns}, {edge}"))
    own, along = F.struct("host", "path", "digests"), Window.orderBy(*order)  # two rows for each range
    waiting = compared.where("edge is not null").select("entry", "host", "digests", "article", "edge.*")
    waiting = waiting.withColumns({"before": F.coalesce("before", F.lag(own).over(along)), "after": F.coalesce("after", F.lead(own).over(along))})
    met = tables.write(map_batches(waiting, columns, edges))
    return compared.where("edge is null").drop("edge").union(met)


def _differenced(pages: DataFrame, tables: Tables) -> DataFrame:
    """(entry, in_article, in_other) for contents of pages (entry, host, path, digests, weights): the places of the lines that are of the host's template.

    digests are those of all lines outside boilerplate, end to end; weights the lengths of lines in an article, 0 for others.
    A content's lines go if its nearest different content shares them and, on pages without an article, REPEATS different
    contents of the host hold them. On pages with one, contents that share less than half of their article's text with the
    nearest one vote for the lines that they share, and lose those that get REPEATS votes and over half of those possible.
    """
    has_article = F.array_max("weights") > 0
    # weights: copies whose markup differs may lack an article; the greatest array has one if any copy does
    copies = [F.min("path").alias("path"), F.first("digests").alias("digests"), F.max("weights").alias("weights"), F.max(~has_article).alias("open")]
    compared = _compared(pages.groupBy("entry", "host").agg(*copies), tables)

    def line(place: Column) -> Column:
        return F.substring("digests", place * LINE_BYTES + 1, F.lit(LINE_BYTES))

    def lines_at(places: Column) -> Column:
        return F.explode(F.array_distinct(F.transform(places, line))).alias("line")

    votes = compared.select("host", lines_at(F.col("in_article"))).groupBy("host", "line").agg(F.count("*").alias("votes")).where(F.col("votes") >= REPEATS)
    articles = compared.where("article").groupBy("host").agg(F.count("*").alias("articles"))
    voted = votes.join(articles, "host").where(2 * F.col("votes") > F.col("articles")).select("host", "line", F.lit(True).alias("article"))
    asked = compared.select("host", lines_at(F.col("in_other"))).distinct()
    asked = broadcast_if_small(asked, F.lit(64))
    held = compared.select("host", lines_at(F.sequence(F.lit(0), (F.length("digests") / LINE_BYTES).cast("int") - 1)))
    repeated = held.join(asked, ["host", "line"], "left_semi").groupBy("host", "line").count().where(F.col("count") >= REPEATS).select("host", "line", F.lit(False).alias("article"))

    kinds = [F.struct(F.lit(of_article).alias("article"), F.col(name).alias("places")) for of_article, name in ((True, "in_article"), (False, "in_other"))]
    shared = compared.select("entry", "host", "digests", F.explode(F.array(*kinds)).alias("kind")).select("entry", "host", "digests", "kind.article", F.explode("kind.places").alias("place"))
    shared = shared.select("entry", "host", "article", "place", line(F.col("place")).alias("line"))
    gone = shared.join(voted.union(repeated), ["host", "line", "article"], "left_semi")
    places = [F.collect_set(F.when(which, F.col("place"))).alias(name) for name, which in (("in_article", F.col("article")), ("in_other", ~F.col("article")))]
    return gone.groupBy("entry").agg(*places)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    Null, empty and markup-only pages have the empty text. A page with article or main elements is the text in them, any
    other page its lines outside boilerplate, both less the lines that differencing with the nearest page of other content
    on its host finds to be of the host's template. An article never loses half of its text. Copies have the same text,
    each row its own, whatever ids they repeat or lack. Extra columns are left.
    """

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if found := lines(page):
                digests = b"".join(hashlib.blake2b(x.encode(), digest_size=LINE_BYTES).digest() for _, x in found)
                out.append((_entry(url, found), *_host_and_path(url), digests, [len(x) if kind == ARTICLE else 0 for kind, x in found]))
        types = [pa.binary(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], t) for i, t in enumerate(types)], names=["entry", "host", "path", "digests", "weights"])

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        entries, articles, texts = [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = lines(page)
            article = any(kind == ARTICLE for kind, _ in found)
            entries.append(_entry(url, found))
            articles.append(article)
            texts.append([x if kind == ARTICLE or not article else None for kind, x in found])  # other lines keep their places only
        arrays = [*batch.columns[:2], pa.array(entries, pa.binary()), pa.array(articles, pa.bool_()), pa.array(texts, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "entry", "article", "lines"])

    tables = Tables(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    digests = map_batches(pages, "entry binary, host string, path string, digests binary, weights array<int>", compared)
    gone = tables.write(_differenced(digests, tables))
    tables.drop(gone)
    gone = broadcast_if_small(gone, 64 + 8 * (F.size("in_article") + F.size("in_other")))
    # parsed again: a table of all texts would take as much disk as the pages, beside the shuffle where many lose lines
    texts = map_batches(pages, "page_id long, url string, entry binary, article boolean, lines array<string>", read)
    joined = texts.join(gone, "entry", "left").withColumn("gone", F.when(F.col("article"), F.col("in_article")).otherwise(F.col("in_other")))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("gone", i)))
    done = joined.select("page_id", "url", F.array_join(kept, " ").alias("text"))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))
