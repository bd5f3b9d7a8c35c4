import hashlib
import random

import pytest

from lodestone.llm import html_extract as he

ARTICLE = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/x">menu</a></nav><!-- ad --><div class="ad">Buy</div><article><h1>A &amp; B&amp</h1><p><b>One\n two<br>three</p><aside>side</aside><p>fo<i>ur</i> &lt;5&gt;<div class="comments">first!</div></article><div class="sidebar">s</div><footer>&copy; x</footer></body></html>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (ARTICLE, "A & B& One two three four <5>"),
        (None, ""),
        ("", ""),
        ("<article></article>", ""),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut <off", "cut"),
        ("<main><p>a<p>b<ul><li>c<li>d</ul></main>", "a b c d"),
        ("<article><header><h1>H</h1></header>x<form>f<input>g</form>y</article>", "H x y"),
        ("<ARTICLE>x<SCRIPT>if (a<b) '</article>'</SCRIPT>y</ARTICLE>", "x y"),
        ("<article>a&nbsp;&nbsp;b c</article>", "a b c"),
        ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
        ("<article>" + "<div>w</div>" * 20000 + "</article>", " ".join(["w"] * 20000)),
        ("<article><div class='cookie-notice'>we use</div><p>z</article><article>second</article>", "z second"),
        ("<main><h1>t</h1><article class='comment'>no</article><article class='post no-comments'>yes</article></main>", "t yes"),
        ("<article><textarea>q</textarea>r</b></article>", "r"),
    ],
)
def test_article_text(page, text):
    assert " ".join(x for kind, x in he.lines(page) if kind == he.ARTICLE) == text


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(4)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = (rng.choices("abcde"[: rng.randrange(1, 6)], k=rng.randrange(0, 14)) for _ in "ab")
        found = sorted(he.common_lines(a, b))
        assert len(found) == longest(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_pages_without_an_article_are_differenced(spark):
    plain = "<body><div>Home</div><div>Body of {}</div><div>All rights</div></body>"
    rows = [(i, f"http://h.example/d/{i:02d}", plain.format(i), "x") for i in range(30)]
    rows += [(100, "http://alone.example/", plain.format("alone"), "x"), (101, "http://h.example/z", ARTICLE, "x"), (102, None, None, "x"), (103, "http://h.example/same", plain.format("one"), "x"), (104, "http://h.example/same", plain.format("one"), "x")]
    rows += [(None, "http://h.example/none", plain.format("none"), "x")]
    got = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    assert len(found) == len(rows)
    for i in range(30):
        assert found[i].text == f"Body of {i}"
    assert found[100].text == "Home Body of alone All rights"
    assert found[101].text == "A & B& One two three four <5>" and found[101].n_chars == len(found[101].text)
    assert (found[102].text, found[102].n_chars) == ("", 0)
    assert found[103].text == found[104].text == "Body of one" and found[None].text == "Body of none"
    assert he.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_and_shared_paragraphs_keep_their_text(spark):
    def page(*own):
        return "<body><div>Home</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights</div></body>"

    rows = [(1, "http://two.example/a", page("Twice")), (2, "http://two.example/b", page("Twice"))]
    rows += [(i, f"http://h.example/d/{i}", page(f"Body of {i}")) for i in range(10, 14)]
    rows += [(i, f"http://h.example/e/{i}", page("Copied", "text")) for i in range(20, 25)]
    rows += [(30, "http://h.example/f/30", page("Shared paragraph", "Own 30")), (31, "http://h.example/f/31", page("Shared paragraph", "Own 31"))]
    rows += [(None, "http://h.example/e/none", page("Copied", "text"))]
    got = {r.page_id: (r.text, r.n_chars) for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {1: "Home Twice All rights", 2: "Home Twice All rights", 30: "Shared paragraph Own 30", 31: "Shared paragraph Own 31", None: "Copied text"}
    want |= {i: f"Body of {i}" for i in range(10, 14)} | {i: "Copied text" for i in range(20, 25)}
    assert got == {i: (t, len(t)) for i, t in want.items()}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='layout no-sidebar'><article>a</article></div>", "a"),
        ("<div class='page has-sidebar with-ads'><main>a</main><div class='site-sidebar'>s</div></div>", "a"),
        ("<form id='aspnetForm'><nav>n</nav><article><p>a</article><div>x</div></form>", "a"),
        ("<article>a<form>b<p>c</form>d</article>", "a d"),
        ("<article><p class='ad'>Buy<p>Real one<p>Real two</article>", "Real one Real two"),
        ("<article><div class='ad'/>Buy</div>text</article>", "text"),
        ("<article><svg><path d='M0'/><text>label</text></svg><div/>a</div>b</article>", "label a b"),
        ("<article>a <object data='x'>instead</object> b<button>press</button></article>", "a instead b"),
        ("<aside><article class='teaser'>t</article></aside><article>a</article>", "a"),
        ("<article><div class='ads-wrapper'>x</div><div class='site-footer-menu'>y</div><div class='newsletter_signup'>z</div><div class='adsorption'>a</div></article>", "a"),
    ],
)
def test_wrappers_and_marks(page, text):
    assert " ".join(x for kind, x in he.lines(page) if kind == he.ARTICLE) == text


def test_alignment_keeps_few_rows(monkeypatch):
    rng = random.Random(5)
    pairs = [[rng.choices("abcd", k=rng.randrange(1, 60)) for _ in "ab"] for _ in range(60)]
    whole = [len(he.common_lines(a, b)) for a, b in pairs]
    monkeypatch.setattr(he, "ROWS_KEPT", 3)
    for (a, b), n in zip(pairs, whole, strict=True):
        found = he.common_lines(a, b)
        rest = iter(b)
        assert len(found) == n and all(a[i] in rest for i in sorted(found))


def plain_differencing(pages):
    """pages: (url, lines). The text of each: without the lines of a longest common subsequence with the nearest different page that three different pages of the host hold."""
    from os.path import commonprefix

    hosts = {}
    for url, own in pages:
        host, path = url.split("/", 3)[2], "/" + url.split("/", 3)[3]
        first = hosts.setdefault(host, {})
        first[tuple(own)] = min(first.get(tuple(own), path), path)
    out = []
    for url, own in pages:
        host = hosts[url.split("/", 3)[2]]
        order = sorted(host, key=lambda x: (host[x], hashlib.sha256("\n".join([url.split("/", 3)[2], *x]).encode()).hexdigest()))
        at = order.index(tuple(own))
        near = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order)]
        if not near:
            out.append(" ".join(own))
            continue
        best = max(near, key=lambda x: len(commonprefix([host[x], host[tuple(own)]])))
        shared = {own[i] for i in he.common_lines(own, list(best))}
        template = {x for x in shared if sum(x in other for other in host) >= 3}
        out.append(" ".join(x for x in own if x not in template))
    return out


def test_differencing_equals_brute_force(spark):
    rng = random.Random(6)
    pages = []
    for n in range(120):
        host = rng.choice(["a.example", "a.example", "b.example", "c.example"])
        section = rng.choice(["news", "shop", "x"])
        own = [f"Menu of {host}", f"{section} section", *(f"Body {rng.randrange(60)}.{i}" for i in range(rng.randrange(4))), f"All rights {host}"]
        pages.append((f"http://{host}/{section}/{rng.randrange(50)}", own))
    rows = [(i % 40, url, "<body>" + "".join(f"<div>{x}</div>" for x in own) + "</body>") for i, (url, own) in enumerate(pages)]
    got = sorted((r.page_id, r.url, r.text) for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == sorted((i % 40, url, text) for i, ((url, _), text) in enumerate(zip(pages, plain_differencing(pages), strict=True)))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h2 id='related-work'>Related work</h2><h2 id=social-history>History</h2><section id='notice-period'>a</section></article>", "Related work History a"),
        ("<article><pre><code>x = 1 <span class='hljs-comment'># one</span></code></pre></article>", "x = 1 # one"),
        ("<article><p class='ad'>x<p>article text</article>", "article text"),
        ("<article><ul><li class='share'>x<li>y<ul><li class='promo'>z</ul>w</ul>v</article>", "y w v"),
        ("<article><div class='ad'>x<p>y</div><p>z<table><tr><td class='ad'>c<td>d<tr><td>e</table></article>", "z c d e"),
        ("<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='application/x-tex'>E=m</annotation></math> it is</article>", "Energy E=m it is"),
        ("<article>a<svg><title>t</title><text>label</text><path d='M0'/></svg>b</article>", "a label b"),
        ("<article><div class='post-related x'>a</div><div class='related-posts'>b</div><div id='comments'>c</div><div role='navigation'>d</div>e</article>", "a e"),
        ("<article><p>a<div>b</div></p>c<dl><dt>d<dd class='ad'>e<dt>f</dl></article>", "a b c d e f"),
    ],
)
def test_an_article_loses_only_marked_containers(page, text):
    assert " ".join(x for kind, x in he.lines(page) if kind == he.ARTICLE) == text


@pytest.mark.parametrize("page", ["<a " * 350_000 + "'\">'", '<a "' * 250_000, "<div>" * 100_000 + "</b>" * 100_000, "<p><div>" * 50_000 + "<li>" * 50_000 + "</ul>" * 50_000, "<" * 1_000_000, "<!--" * 200_000, "<a href='x\">" * 80_000])
def test_malformed_pages_cost_their_length(page):
    import time

    began = time.thread_time()
    he.lines(page)
    assert time.thread_time() - began < 10


def test_a_tag_with_a_quote_that_never_ends():
    text = lambda page: " ".join(x for _, x in he.lines(page))
    assert text("<p title=\"a>one</p><p>two</p>") == "one two"
    assert text("<p title='a>b' class=x>one</p> a < b <c") == "one a < b"
    assert text("<script>if (a<b) x</script>one<textarea><p></textarea> two") in ("one two", "onetwo")


def test_parts_of_a_page_without_an_article():
    page = "<div id='header'>Head</div><div id='nav'>Nav</div><div class='topnav'>Top</div><p>Text</p><ol class='commentlist'><li>Said</li></ol><div id='footer'>Foot</div>"
    assert [x for _, x in he.lines(page)] == ["Text"]


def test_articles_are_differenced(spark):
    """Lines that over half of a host's articles share with a nearest page of other text go; versions, copies and chance repeats stay."""

    def page(*own, outside=""):
        return f"<body><nav>n</nav><article>{''.join(f'<p>{x}</p>' for x in own)}</article>{outside}</body>"

    def story(n):
        return f"Story {n} tells at some length what is told nowhere else, word by word {n}"

    share, login = "Share this story with friends", "Log in to read on"
    rows = [(i, f"http://h.example/d/{i:02d}", page(f"Title {i}", story(i), *(["The."] if i % 3 == 0 else []), share, outside="<div>Follow us</div>")) for i in range(12)]
    rows += [(20, "http://h.example/d/03/copy", rows[3][2]), (21, "http://h.example/d/30", page(story(21), share.upper()))]
    rows += [(i, f"http://versions.example/{i}", page(story(0), f"Version {i}", login)) for i in range(40, 48)]
    rows += [(i, f"http://two.example/{i}", page(story(i), share)) for i in (50, 51)]
    rows += [(60, "http://h.example/d/11/x", f"<body><div>{story(60)}</div><div>{share}</div><div>Follow us</div></body>")]
    got = {r.page_id: (r.text, r.n_chars) for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Title {i} {story(i)}" + (" The." if i % 3 == 0 else "") for i in range(12)}
    want |= {20: want[3], 21: f"{story(21)} {share.upper()}", 50: f"{story(50)} {share}", 51: f"{story(51)} {share}", 60: story(60)}
    want |= {i: f"{story(0)} Version {i} {login}" for i in range(40, 48)}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_ranges_meet_at_their_ends(spark):
    """As many ranges as shuffle partitions, some of one content or none: first and last contents meet those of the ranges beside."""
    rng = random.Random(8)
    pages = []
    for n in range(90):
        host = "a.example" if n % 5 else rng.choice(["b.example", "c.example", "d.example"])
        pages.append((f"http://{host}/{n % 3}/{n}", [f"Menu of {host}", f"Section {n % 3}", *(f"Body {rng.randrange(9)}" for _ in range(rng.randrange(3)))]))
    for few in (pages, pages[:5]):
        rows = [(i, url, "<body>" + "".join(f"<div>{x}</div>" for x in own) + "</body>") for i, (url, own) in enumerate(few)]
        settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
        before = {k: spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert got == dict(enumerate(plain_differencing(few)))


def test_files_of_intermediate_tables_do_not_grow_with_the_splits_of_the_input(spark, monkeypatch):
    """Each file that an executor writes may start a process; a table of each split's lines would take one a split."""
    from pathlib import Path

    from lodestone.llm import common

    paths = []
    monkeypatch.setattr(common, "drop_folder", lambda _, path: paths.append(path))
    rows = [(i, f"http://h.example/{i}", f"<article><p>Text {i}</p></article>") for i in range(64)]
    done = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(32))
    assert sorted(r.text for r in done.collect()) == sorted(f"Text {i}" for i in range(64))
    assert paths and sum(len(list(Path(x.removeprefix("file:")).glob("part-*"))) for x in paths) < 8
