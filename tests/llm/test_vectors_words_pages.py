"""Whitening, spelling variants and main text against brute force, exact arithmetic and planted pages."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import extract, queries, spelling, whitening

# 11


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}")


def test_polynomial_equals_exact_determinants(spark):
    rng = random.Random(1)
    half = [[rng.randint(-10**7, 10**7) for _ in range(5)] for _ in range(6)]
    m = [[sum(a * b for a, b in zip(x, y)) for y in half] for x in half]  # of rank 5, so one root is 0
    poly = whitening.characteristic_polynomial(spark, m)

    def determinant(a):
        a, out = [[Fraction(v) for v in row] for row in a], Fraction(1)
        for k in range(len(a)):
            at = next((i for i in range(k, len(a)) if a[i][k]), None)
            if at is None:
                return 0
            if at != k:
                a[k], a[at], out = a[at], a[k], -out
            out *= a[k][k]
            for i in range(k + 1, len(a)):
                f = a[i][k] / a[k][k]
                a[i] = [x - f * y for x, y in zip(a[i], a[k])]
        return out

    for t in (-3, 0, 1, 10**9, 10**14):
        assert sum(c * t**k for k, c in enumerate(poly)) == determinant([[(t if i == j else 0) - m[i][j] for j in range(6)] for i in range(6)])
    assert poly[0] == 0 and poly[-1] == 1


def test_whitening_against_floating_point(spark, sf_dir):
    rows = queries.op11_whitening(spark, sf_dir).toPandas()
    x = np.floor(64 * np.array(spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"].tolist(), np.float64)) + 1_000_000
    n = len(x)
    e, u = np.linalg.eigh(np.cov((x - 1e6).T, bias=True))
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - x.mean(axis=0)) @ u / np.sqrt(e)
    want *= np.sign((want * got).sum(axis=0))
    assert got == pytest.approx(want, abs=1e-7)
    assert rows["identity_error"].max() == rows["identity_error"].min() < 1e-9
    assert (rows["n"] == n).all() and len(rows) == 32 * n
    assert rows[rows["vec_id"] == 0]["explained"].to_numpy() == pytest.approx(e / np.trace(np.cov((x - 1e6).T, bias=True)))
    z = n * x.astype(np.int64) - x.astype(np.int64).sum(axis=0)
    assert rows.groupby("vec_id")["deviation"].first().tolist() == (z * z).sum(axis=1).tolist()


def test_whitening_equal_roots_and_none(spark):
    """Two equal variances get two orthogonal components; a direction without variance has none."""
    points = [(float(a), float(b), 5.0) for a in (-1, 1) for b in (-1, 1)]
    df = frame(spark, [(i, list(p)) for i, p in enumerate(points)])
    model = whitening.fit(df)
    assert [float(v) for v in model.values] == pytest.approx([16 * 64**2, 16 * 64**2, 0])
    assert np.abs(model.vectors @ model.vectors.T - np.eye(3)).max() < 1e-15
    assert whitening.identity_error(df, "embedding", model) < 1e-12
    got = whitening.whitened(df, model).collect()
    assert len(got) == 12 and all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert {r["explained"] for r in got if r["component"] < 3} == {0.5}


def test_whitening_close_roots(spark):
    """Variances that differ by a part in 10^9 still have exact components."""
    n = 1000
    rows = [(i, [float(v) for v in p]) for i, p in enumerate([(n, 0), (-n, 0), (0, n), (0, -n), (1 / 64, 0), (-1 / 64, 0)])]
    model = whitening.fit(frame(spark, rows))
    assert model.values[0] > model.values[1] and np.abs(model.vectors - np.eye(2)).max() < 1e-15


def test_whitening_large_entries_add_up_exactly(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-1.0, 1.0)) * rng.randint(2**40, 2**50) for _ in range(3)]) for i in range(20)]
    y = np.array([[int(64 * v) for v in r] for _, r in rows], object)
    n, s, m = whitening.scatter(frame(spark, rows).repartition(3), "embedding")
    assert n == 20 and s == y.sum(axis=0).tolist()
    assert m == (n * (y.T @ y) - np.outer(y.sum(axis=0), y.sum(axis=0))).tolist()


def test_whitening_odd_input(spark):
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [1e300, 0.0]), (7, [1.0, 2.0, 3.0])]
    df = frame(spark, [*odd, (8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [3.0, 1.0])]).withColumns({c: F.lit(1) for c in ("ident", "d", "i", "v", "n", "component")})
    model = whitening.fit(df)
    got = whitening.whitened(df, model).collect()
    assert model.n == 3 and Counter(r["ident"] for r in got) == {8: 4, None: 2}
    same = frame(spark, [(1, [2.0]), (2, [2.0])])
    model = whitening.fit(same)
    assert {(r["whitened"], r["explained"], r["deviation"]) for r in whitening.whitened(same, model).collect()} == {(None, None, 0)}
    assert whitening.identity_error(same, "embedding", model) is None
    for empty in (df.where("false"), frame(spark, odd[:2])):
        assert whitening.fit(empty) is None and whitening.whitened(empty, None).count() == 0
    floats = frame(spark, [(1, [0.5, 0.25]), (2, [0.75, 1.0]), (3, [0.5, 1.0])], "array<float>")
    assert whitening.whitened(floats, whitening.fit(floats)).count() == 6


# 12


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=10):
    out = {}
    for w, n in words.items():
        beside = [(-words[x], x) for x in words if near(w, x)]
        form = min(beside)[1] if beside and -min(beside)[0] >= times * n else None
        out[w] = (n, len(beside), form)

    def root(w):
        return root(out[w][2]) if out[w][2] else w

    return {(w, n, k, f, words[f] if f else None, root(w)) for w, (n, k, f) in out.items()}


def counted(docs):
    c = Counter()
    for ident, text in docs:
        for run, n in spelling.runs_of(text).items():
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += n
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def rows_of(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abc", 2), ("aé", 3), ("abcdefgh", 4)])
def test_spelling_against_all_pairs(spark, letters, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(60)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(("", rng.choice(letters), rng.choice(letters) + w[k])) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.2 and "é" not in w else w)
        docs.append((i, ", ".join(words)))
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got) == brute(counted(docs))


def test_spelling_counts_by_hash(spark, docs):
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert got == counted([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_spelling_chains_and_ties(spark):
    """A rare word follows a common one, that a more common one; of two equal ones the smaller is the form."""
    n = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "ccccccc": 2, "cccccccd": 30, "ccccccca": 30}
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    found = {(r["word"], r["near"]) for r in spelling.near_pairs(rows).collect()}
    assert found == {(a, b) for a in n for b in n if near(a, b)}
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "word string, form string")
    assert {(r["word"], r["root"]) for r in spelling.roots(forms).collect()} == {("a", "e"), ("b", "e"), ("c", "e"), ("d", "e"), ("x", "y")}


def test_spelling_odd_input(spark, edge, none):
    rows = edge.select("doc_id", "text").collect()
    assert rows_of(spelling.variants(edge)) == brute(counted([(r["doc_id"], r["text"]) for r in rows]))
    assert spelling.variants(none).count() == 0
    long = "q" * 70_000
    docs = [(1, f"{long} {long} {long}x {long}x Ünïcödé×÷ÿÿ ünïcödé×÷ÿÿ")]
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got) == brute(counted(docs))


# 13


def article(*blocks):
    return "\n\n".join(blocks)


BODY = ["A heading", "The first paragraph of the article is long enough to be taken for text by anyone who reads it.", "Short.", "One more paragraph with some words & marks in it, so that there is more than one.", "End."]
PAGES = [
    ("<html><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About us and what we do all day long</a></ul></nav><article><h1>{0}</h1><p>{1}<p>{2}<p>{3}<p>{4}</article><footer>Copyright of a long company name and its many subsidiaries</footer>"),
    ("<body><header><h1>Site name</h1></header><div id=content class='with-sidebar'><h1>{0}</h1><div class=body><p>{1}</p><p>{2}</p><p>{3}</p><p>{4}</p></div></div><div class='sidebar'><p>Other things that one may read on this page, at some length.</p></div>"),
    ("<body><div class='cookie-notice'><p>We use cookies to give you the best experience on this site, and to count you.</p></div><main><h2>{0}</h2><p>{1}</p><div class='ad'>Buy now, this is a very good thing for you and all of your friends.</div><p>{2}</p><blockquote>{3}</blockquote><p>{4}</p></main><section id=comments><h3>Comments</h3><article class=comment><p>I do not agree with any of this, and here is why, in many words of my own.</p></article></section>"),
    ("<body><form action=/s><input name=q><label>Search the whole of this site for words</label><button>Go</button></form><article><header><h1>{0}</h1></header><script>var t='</p><p>x</p>';</script><p>{1}</p><style>p{{}}</style><p>{2}<!-- <p>no</p> --></p><aside>Read also this other article about something else altogether.</aside><p>{3}</p><p>{4}</p></article>"),
    ("<table><tr><td><div class=menu><a href=1>One</a> <a href=2>Two</a></div></td></tr></table><div class=post><h1>{0}</h1><p>{1}</p><ul><li>{2}</li><li>{3}</li></ul><p>{4}</p></div><div class=related><a href=x>Another article that has a long name here</a></div>"),
    ("<body class='has-sidebar no-header'><div id='main-nav'><a href=/>A rather long list of all the places on this site</a></div><div class='page-header'>The name of the site and what it is for</div><div id='mainContent'><h1>{0}</h1><p>{1}</p><p>{2}</p><div class='post-header'>{3}</div><p>{4}</p><div class='shareBar'>Share this with all of your friends and their friends</div></div><div class='page-footer'>All rights reserved by the owner of the site, whoever that is</div>"),
    ("<body><div class='ad'>An advert that nobody closes<article><h1>{0}</h1><p>{1}<br><p><b>{2}<br><p>{3}<p>{4}</article></body>"),
]


@pytest.mark.parametrize("page", PAGES)
def test_main_text_of_planted_pages(page):
    html = page.format(*[b.replace("&", "&amp;") for b in BODY])
    assert extract.main_text(html) == article(*BODY)
    spread = html.replace("enough to", "enough\n\t to&#32;&nbsp; ")
    assert extract.main_text(spread) == article(*BODY)


def test_main_text_in_pieces(monkeypatch):
    """Where the parser is cut does not matter."""
    html = PAGES[3].format(*[b.replace("&", "&amp;") for b in BODY])
    for piece in (1, 2, 7, 50):
        monkeypatch.setattr(extract, "PIECE", piece)
        assert extract.main_text(html) == article(*BODY)


def test_smoothing_and_threshold():
    flat = extract.smoothed(np.full(9, 5.0))
    assert flat == pytest.approx(np.full(9, 5.0))
    peak = extract.smoothed(np.array([0, 0, 0, 0, 9.0, 0, 0, 0, 0]))
    assert peak.argmax() == 4 and peak[3] == pytest.approx(peak[5]) and peak[3] > peak[2] > peak[1]
    lines = extract.lines_of("<div>" + "".join(f"<p><a href=x>{w}</a></p>" for w in "abcdef") + "".join(f"<p>{'word ' * 40}</p>" for _ in range(6)) + "</div>")
    assert extract.content(lines).tolist() == [False] * 4 + [True] * 8 or extract.content(lines).tolist()[:3] == [False] * 3


def test_main_text_odd_input(spark):
    long = "<article>" + "<p>word word word</p>" * 20_000 + "</article>"
    pages = [(1, "u", None), (2, None, ""), (None, "u", "no markup at all"), (4, "u", "<p></p><br>&nbsp;"), (5, "u", long), (5, "u", long), (6, "u", "<article><p>a &lt;b&gt; &copy; &#x41;</p>"), (7, "u", "</p></div><<>< a <p"), (8, "u", "<script>x"), (9, "u", "<nav>only a menu</nav>"), (10, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("ident", "text", "n_chars")})
    got = [(r["ident"], r["text"], r["n_chars"]) for r in extract.extracted(df).collect()]
    by_id = {i: t for i, t, _ in got}
    assert len(got) == len(pages) and all(n == len(t) for _, t, n in got)
    assert by_id[1] == by_id[2] == by_id[4] == by_id[8] == by_id[9] == "" and by_id[None] == "no markup at all" and by_id[10] == "deep"
    assert by_id[6] == "a <b> \xa9 A" and by_id[5].count("\n\n") == 19_999
    assert extract.extracted(df.where("false")).count() == 0


def test_main_text_of_the_table(spark, sf_dir):
    """The pages of the tables have one article each, cut out here by its tags."""
    import html
    import re

    for r in queries.op13_main_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == article(*filter(None, blocks)) and r["n_chars"] == len(r["text"])
