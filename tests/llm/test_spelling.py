import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lodestone.llm import spelling, sql


def vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def are_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    n = vocabulary(rows)
    out = {}
    for word in n:
        others = sorted((-n[o], o) for o in n if are_near(word, o))
        form = others[0][1] if others and -others[0][0] >= 5 * n[word] else None
        out[word] = (form, n[word], len(others), n[form] if form else None)
    roots = {}
    for word in n:
        at = word
        while out[at][0]:
            at = out[at][0]
        roots[word] = at
    return sorted((w, f, roots[w], *rest) for w, (f, *rest) in out.items())


def got(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=lambda r: r[0])


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "aaaaaa", "Bananna", "banana", "BANANAS", "ÀÉÎÕÜß", "àéîõüß", "straße×÷"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.choice([0, 3, 40])):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "1", "_"]).join(words)))
    return [*rows, (2000, "qwertaa " * 6 + "qwertab " * 31), (2001, "qwerbab " * 160), (1000, None), (1001, ""), (None, "banana " * 30), (None, "abaabaaa " * 7), (5, "banana bananas"), (5, "banana bananas"), (1002, "x" * 100_000), (1003, "longer" * 20_000 + " banana")]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(5)
    want = plain(rows)
    assert got(spelling.query(df)) == want
    assert sum(r[1] is not None for r in want) > 5 and any(r[1] != r[2] and r[1] for r in want)


def test_sql_agrees_on_odd_rows():
    rows = texts(3)
    documents = duckdb.sql("SELECT * FROM (SELECT unnest($1) AS doc_id, unnest($2) AS text)", params=[[r[0] for r in rows], [r[1] for r in rows]])  # noqa: F841
    found = duckdb.sql(sql.oracle_sql()["op12_spelling_variants"]).fetchall()
    assert sorted(found) == plain(rows)


def test_empty_table(spark):
    assert spelling.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chains_of_forms(spark):
    """Each form is five times as frequent as the one before: the roots are found in a logarithm of rounds."""
    chain = [("a" * i + "zzzzzzz"[: 12 - i], 5**i) for i in range(12)]
    words = spark.createDataFrame([(w[:12].ljust(12, "z"), n) for w, n in chain], "word string, n long")
    found = {r.word: r for r in spelling.forms(words).collect()}
    assert {r.root for r in found.values()} == {"a" * 11 + "z"} and sum(r.form is None for r in found.values()) == 1
