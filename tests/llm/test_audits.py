"""Whitening, source divergence and main text against plain versions, planted pages and awkward tables."""

import html
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from matchlake.llm import divergence, extraction, whitening

# whitening


def plain_whitening(vectors):
    """n, exact deviations, whitened values and explained shares with Python's integers and one eigendecomposition."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    y = [[n * int(c) - s for c, s in zip(row, sums, strict=True)] for row in x]
    z = [[n * int(c) - s for c, s in zip(row, sums, strict=True)] for row in fit]
    d = x.shape[1]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, [sum(c * c for c in row) for row in y], (np.array(y, float) / n) @ u / np.sqrt(np.where(e > 0, e, 1)), e / np.trace(v)


def test_whitening_query_against_plain_numpy(spark, sf):
    import pyarrow.parquet as pq

    from matchlake.llm.registry import QUERIES

    table = pq.read_table(f"{sf}/embeddings.parquet").to_pandas()
    n, deviation, whitened, explained = plain_whitening(table["embedding"].tolist())
    got = QUERIES["op11_embedding_whitening"](spark, sf).toPandas()
    assert len(got) == 4 * len(table)
    at = dict(zip(table["vec_id"], range(len(table)), strict=True))
    for k in range(4):
        own = got[got["component"] == k + 1]
        rows = own["vec_id"].map(at).to_numpy()
        assert sorted(rows) == list(range(len(table)))
        assert own["deviation"].tolist() == [deviation[i] for i in rows] and set(own["n"]) == {n}
        w = own["whitened"].to_numpy()
        sign = 1 if w @ whitened[rows, k] > 0 else -1
        assert np.allclose(w * sign, whitened[rows, k], atol=1e-9)
        assert np.allclose(own["explained"], explained[k], rtol=1e-9) and own["identity_error"].max() < 1e-9


def test_whitening_of_awkward_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5], 9), (1, [1.0, 2.0, 0.5], 9), (None, [0.25, -1.0, 3.0], 9), (3, None, 9), (4, [1.0, None, 2.0], 9), (5, [1.0, float("nan"), 2.0], 9), (6, [float("inf"), 1.0, 2.0], 9), (7, [1.0], 9), (8, [], 9), (9, [0.0, -0.001, 7.0], 9), (10, [1.0, 5.0, -2.0], 9), (11, [-4.0, 2.0, 2.5], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")
    got = whitening.whiten(df).toPandas()
    used = [r for r in rows if r[0] in (1, None, 9, 10, 11)]
    n, deviation, _, _ = plain_whitening([r[1] for r in used])
    assert len(got) == 3 * len(used) and set(got["n"]) == {n} == {5} and got["vec_id"].isna().sum() == 3
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation) and got["identity_error"].max() < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 3")).count() == 0
    one = whitening.whiten(df.where("vec_id = 1")).collect()
    assert len(one) == 6 and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)


def test_scatter_beyond_doubles_and_longs(spark):
    rng = random.Random(3)
    vectors = [[rng.uniform(-1, 1) * 10 ** rng.choice([0, 6, 15]) for _ in range(5)] for _ in range(60)] + [[1e30, -1e30, 0.0, 1.0, 2.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(7)
    x = [[max(-(2**63), min(2**63 - 1, int(np.floor(256 * c)))) for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    own = whitening.Whitening(whitening.integers(df))
    assert own.n == n and own.sums == sums
    assert own.scatter == [[sum(r[i] * r[j] for r in y) for j in range(5)] for i in range(5)]
    exact = {i: sum(c * c for c in row) for i, row in enumerate(y)}
    for r in own.transform(whitening.integers(df)).collect():
        assert r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 2**63 else None)


def test_remainders():
    moduli = whitening.primes(10**40)
    assert len(set(moduli)) == len(moduli) and all(all(p % q for q in range(2, 1025)) for p in moduli)
    for value in (0, 1, -1, 10**39, -(10**39), 123456789):
        assert whitening.remainders_to_integer([value % p for p in moduli], moduli) == value


# source divergence


def plain_audit(rows, least):
    """The audit by plain loops over every group and term."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        v = len(kept)
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if held[t] >= least) for s in {d[1] for d in own}}
        count[None] = Counter(t for d in own for t in d[2] if held[t] >= least)
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count.keys() - {None}:
            pairs = sorted(((-sum(f(p[s][t], p[h][t]) for t in kept), h.encode(), h) for h in count.keys() - {None, s}))
            out += [(lang, s, "pair", h, -value, i + 1) for i, (value, _, h) in enumerate(pairs)]
            told = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t])[:10]
            out += [(lang, s, "term", t, -value, i + 1) for i, (value, _, t) in enumerate(told)]
    return sorted(out)


def _told(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("seat", "shard"), [(1, 3), (2, 1), (50, 4096)])
def test_divergence(spark, seat, shard):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "gamma", "élan", "ÉLAN", "naïve", "straße", "日本", "delta", "epsilon", "zeta"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "D", "é", None, ""]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) + rng.choice(["", " 12-x_y", "\x00q\x7f"])) for _ in range(90)]
    rows += [("en", "hot", "alpha beta " * 300)] * 30 + [("en", "nothing", None), ("xx", "only", "alone"), ("yy", "one", ""), ("yy", "two", "42")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, value long, item string")
    assert _told(divergence.audit(df, least=4, seat=seat, shard_terms=shard)) == plain_audit(rows, 4)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


@pytest.mark.parametrize("seats", [0, 1, 2, 3, 6, 7])
def test_every_two_seats_meet_once(seats):
    rounds = divergence.opponents(seats)
    met = [frozenset(p) for r in rounds for p in r]
    assert sorted(map(sorted, met)) == sorted([a, b] for a in range(seats) for b in range(a + 1, seats))
    assert all(len({s for p in r for s in p}) == 2 * len(r) for r in rounds)


def test_counts_leave_when_memory_is_full(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_ENTRIES", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 3), pa.array(["s"] * 3), pa.array(["x y", "y z w", "x x"])], ["lang", "source", "text"])
    total, docs = Counter(), Counter()
    parts = list(divergence._count(iter([batch])))
    for part in parts:
        for r in part.to_pylist():
            total[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert len(parts) > 1 and total == {"x": 3, "y": 2, "z": 1, "w": 1} and docs == {"x": 2, "y": 2, "z": 1, "w": 1}


# main text

A = "The history of the town is long and it was written by many people who lived there for years."
B = "In the second part of the text there is more to read, and that is all for now, as it was said before."
JUNK = "xq%% zzv&&& wqq$$$ " * 8

PAGES = {
    "sidebar": (f"<body><header><h1>Site</h1><p>{A}</p></header><div id='main'><h1>Title here</h1><p>{A}</p><p>Short.</p><p>{B}</p></div><aside><p>{A}</p></aside><footer>x</footer>", f"Title here {A} Short. {B}"),
    "notice and comments": (f"<div class='cookie-banner'><p>{B}</p><button>OK</button></div><div class='post-content'><h2>T</h2><p>{A}</p><ul><li>one</li><li>two &amp; three</li></ul><p>{B}</p></div><section id='comments'><article class='c'><p>{A}</p></article></section>", f"T {A} one two & three {B}"),
    "a form around the page": (f"<form action=x><label>Name</label><input name=q><article><p>{A}</p><p>Fin.</p></article></form>", f"{A} Fin."),
    "a form within": (f"<article><p>{A}</p><form><p>{B}</p><select><option>x</select></form></article>", A),
    "unclosed menu": (f"<nav><ul><li><a href=/>Home</a><article><p>{A}<p>Next<p>{B}</article>", f"{A} Next {B}"),
    "links": (f"<article><p>See <a href=x>this</a> one, {A}</p><p><a href=a>Share</a> <a href=b>Tweet</a></p></article>", f"See this one, {A}"),
    "unclosed link": (f"<article><p>see <a href=x>this<p>{A}</p></article>", f"see this {A}"),
    "quotes": (f'<article title="a > b"><p data-x="1 > 0">{A}</p><p>5 < 6 and a <b>bold</b>ly</p></article>', f"{A} 5 < 6 and a boldly"),
    "unknown language": (f"<nav><a href=/>x</a></nav><article><p>{JUNK}</p><p>q</p></article>", f"{html.unescape(JUNK).strip()} q"),
    "title within": (f"<main><article><header><h1>Head line</h1></header><p>{A}</p><footer>By me</footer></article><div class=sidebar><p>{B}</p></div></main>", f"Head line {A}"),
    "divs": (f"<div class='nav'><a href=1>a</a></div><div><h1>Title</h1><div>{A}</div><div>Tiny.</div><div>{B}</div></div><div class='footer'>&copy; me</div>", f"Title {A} Tiny. {B}"),
    "body text": (f"<body class='no-sidebar has-ads'><div class='ad-slot'>{B}</div><h1>T</h1>{A}<br>More<div>© 2020 The firm</div>", f"T {A} More"),
    "references": ("<article><p>&lt;b&gt; &amp;amp; &#8364; &nbsp; x&nbsp;y &eacute;</p></article>", "<b> &amp; € x y é"),
    "hidden": (f"<article><p>{A}</p><div style='display: none'>{B}</div><p hidden>{B}</p></article>", A),
    "scripts": (f"<article><script>var x='</p>{A}'</script><p>{A}</p><style>p{{}}</style><!-- <p>{B}</p> --></article>", A),
    "teasers": (f"<article><p>{A}</p><p>{B}</p></article><div class='related'><article><h3><a href=x>Other</a></h3><p>{A}</p></article></div>", f"{A} {B}"),
    "short": ("<p>Short text.</p>", "Short text."),
    "no tags": ("just  text", "just text"),
    "empty": ("", ""),
    "only a menu": ("<nav><a href=x>y</a></nav>", ""),
    "endless script": ("<p>a</p><script>var x='<p>no</p>'", "a"),
    "endless comment": ("<p>a</p><!-- <p>b</p>", "a"),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(name):
    page, expected = PAGES[name]
    assert extraction.main_text(page) == expected


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_extraction_query_against_the_articles(spark, sf, table):
    """On the given tables the main text is what stands in the article element; here by a regular expression."""
    import pyarrow.parquet as pq

    from matchlake.llm.registry import QUERIES

    folder = f"{sf.rpartition('/')[0]}/{table}"
    pages = pq.read_table(f"{folder}/pages.parquet").to_pylist()
    article = {r["page_id"]: re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1] for r in pages}
    expected = sorted((r["page_id"], r["url"], text := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article[r["page_id"]])).split()), len(text)) for r in pages)
    got = QUERIES["op13_html_extraction"](spark, folder).collect()
    assert sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got) == expected


def test_extraction_of_awkward_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, f"<article><p>{A}</p></article>", "x"), (2, "v", f"<article><p>{'Über ' * 300_000}</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["text"][:20], r["n_chars"]) for r in extraction.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (None, None, A[:20], len(A)), (2, "v", ("Über " * 4)[:20], 5 * 300_000 - 1)], key=str)
    assert extraction.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a "' * 150_000 + ">", "<div>" * 200_000 + "x", "<b>" * 100_000 + "<p>x</b>" * 5000, "</div>" * 200_000, "<li>" * 150_000, "<!-- -" * 200_000, "<p><a href=x>" * 100_000])
def test_malformed_pages_take_seconds(page):
    began = time.time()
    extraction.main_text(page)
    assert time.time() - began < 20
