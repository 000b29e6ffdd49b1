"""URL filters, fill-in-middle and centroid clustering against plain Python, and on nulls, repeats, ties and empty tables."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import catalog, centroids, fill_middle, url_filter

SF = "/root/testdata/sf0.01"

# -- URL filters --------------------------------------------------------------------------------

URLS = [
    (1, "http://Example.COM/en/a?q=/x"), (2, "https://www.example.com/en/"), (3, "http://a.www.example.com/en/b"), (4, "http://b.example.com/de/"), (5, "http://x.net/es/1"), (6, "http://x.net/ES/1"), (7, "http://com"), (8, "http://notexample.com/en/"),
    (9, "ftp://net/fr/"), (10, None), (11, ""), (12, "no scheme"), (13, "http://a.org#x://net/fr/"), (14, "http://É.NET/fr/é"), (None, "http://x.net/es/1"), (5, "http://x.net/es/1"), (16, "http://"), (17, "http://x.org/" + "é9" * 40_000), (18, "http://h?a/b"), (19, "http://xcom/"), (20, "x://a://b/c"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def grams(host, path):
    out = {}
    for kind, text in (("host", f"^{host}$"), ("path", f"^{path}$")):
        for i in range(len(text) - 2):
            seed = xxhash.xxh64_intdigest(kind.encode(), 42)
            h = xxhash.xxh64_intdigest(text[i : i + 3].encode(), seed)
            out[(h - (1 << 64) if h >= 1 << 63 else h) % url_filter.DIM] = 1
    return list(out)


def regression(rows, rounds=30, ridge=1e-4):
    x, y = np.zeros((len(rows), url_filter.DIM + 1)), np.array([r[1] for r in rows], dtype=float)
    for i, (f, _) in enumerate(rows):
        x[i, f] = 1 / math.sqrt(max(len(f), 1))
        x[i, -1] = 1
    w = ahead = np.zeros(url_filter.DIM + 1)
    t = 1.0
    for _ in range(rounds):
        slope = x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) / len(rows)
        pull = ridge * ahead
        pull[-1] = 0
        new, later = ahead - 2 * (slope + pull), (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w


def judged(urls, weights):
    out = []
    for key, url in urls:
        host, path = parts(url)
        r = ruled(host, path)
        if r:
            out.append((key, host, path, r.name, r.verdict, None))
        else:
            f = grams(host, path)
            s = 1 / (1 + math.exp(-(sum(weights[i] for i in f) / math.sqrt(max(len(f), 1)) + weights[-1])))
            out.append((key, host, path, None, "block" if s >= 0.5 else "allow", s))
    return out


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    got, want = order(got), order(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert (g[5] is None) == (w[5] is None) and (g[5] is None or abs(g[5] - w[5]) < 1e-7)


def test_url_filter(spark):
    urls = duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()
    known = {u: ruled(*parts(u)) for _, u in urls}
    weights = regression([(grams(*parts(u)), r.verdict == "block") for u, r in known.items() if r])
    same([tuple(r) for r in catalog.queries()["op11_url_filter"](spark, SF).collect()], judged(urls, weights))


def test_url_edges(spark):
    rows = [(k, u, "host", 1.0) for k, u in URLS]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score double")
    known = {u: ruled(*parts(u)) for _, u in URLS}
    weights = regression([(grams(*parts(u)), r.verdict == "block") for u, r in known.items() if r])
    got = [tuple(r) for r in url_filter.judge(pages).collect()]
    same(got, judged(URLS, weights))
    by = {r[0]: r for r in got}
    assert by[1][3] == "example.com/en/" and by[2][3:5] == ("www.example.com/en/", "allow") and by[8][3] == "com/" and by[7][3] is None and by[14][1] == "É.net" and by[20][1:3] == ("a:", "//b/c")
    assert url_filter.judge(pages.limit(0)).count() == 0
    # nothing labelled: the chance is a half
    assert [r.score for r in url_filter.judge(pages.where("page_id = 13")).collect()] == [0.5]


def test_url_regression_learns(spark):
    """Held-out urls of two families of hosts get their family's verdict."""
    rnd = random.Random(3)
    url = lambda bad: f"http://{'casino' if bad else 'museum'}{rnd.randrange(10**6)}.org/{rnd.randrange(1000)}"
    training = spark.createDataFrame([(url(i % 2), "block" if i % 2 else "allow") for i in range(200)], "u string, v string")
    pages = spark.createDataFrame([(i, url(i % 2)) for i in range(100)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, (), training).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(100))


def test_url_rules_of_equal_length(spark):
    rules = (url_filter.Rule("b.c", "/xyz", "allow"), url_filter.Rule("a.b.c", "/", "block"), url_filter.Rule("a.b.c", "/", "allow"))
    got = url_filter.judge(spark.createDataFrame([(1, "http://a.b.c/xyz")], "page_id long, url string"), rules).first()
    assert (got.rule, got.verdict) == ("b.c/xyz", "allow")
    got = url_filter.judge(spark.createDataFrame([(1, "http://a.b.c/x")], "page_id long, url string"), rules).first()
    assert (got.rule, got.verdict) == ("a.b.c/", "block")


def test_url_labels_are_bounded(spark):
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('http://h', CASE WHEN id % 3 = 0 THEN 0 ELSE id END, CASE WHEN id % 2 = 0 THEN '.com/' ELSE '.net/fr/' END) AS url")
    n = {r.v: r.n for r in url_filter.labelled(pages, url_filter.RULES, about=500).groupBy("v").agg({"*": "count"}).toDF("v", "n").collect()}
    assert set(n) == {"allow", "block"} and all(350 < x < 650 for x in n.values())


# -- fill in middle -----------------------------------------------------------------------------

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def cut(text, key):
    text = text or ""
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    u = UNIT.findall(text)
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abZ <>PSM.é😀\n\t", max_size=400), st.integers(0, 10**6))
def test_rope_against_lists(text, key):
    old, fill_middle.LEAF = fill_middle.LEAF, 8
    try:
        got = fill_middle.transform(text, str(key))
        assert got == cut(text, key) and fill_middle.invert(got[4], got[1]) == text
    finally:
        fill_middle.LEAF = old


def test_rope_stays_balanced():
    rope = fill_middle.build("ab. " * 100_000)
    assert (rope.units, rope.points) == (300_000, 400_000)
    rnd = random.Random(1)
    for _ in range(200):
        a, b = fill_middle.split(rope, rnd.randrange(rope.units))
        rope = fill_middle.join(b, a)
    assert rope.units == 300_000 and rope.height <= 40
    for rank in (0, 1, 150_000, 300_000, 300_001):
        a, b = fill_middle.split(rope, rank)
        assert (a.units if a else 0) == min(rank, 300_000) and fill_middle.points(a) + fill_middle.points(b) == 400_000


def test_fill_in_middle_texts(spark):
    docs = [(1, None), (2, ""), (3, "x" * 50_000 + " end"), (4, "a<P>b"), (5, "é😀\u2028 z\r\n"), (5, "é😀\u2028 z\r\n"), (None, "some words here"), *((i, f"Document {i} with <half P> marks, {'word ' * i}end.") for i in range(6, 90))]
    df = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, form string, n int")
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output, r.restored) for r in fill_middle.restore(fill_middle.fill_in_middle(df)).collect())
    want = []
    for d, t in docs:
        n, form, p, m, out = cut(t, "" if d is None else d)
        want.append((str(d), n, form, p or 0, m or 0, out, t or ""))
    assert got == sorted(want) and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_fill_middle", "op13_centroids"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(catalog.oracle_sql()[name]).df(), catalog.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    by = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(by(want), by(got), check_dtype=False)


# -- centroids ----------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dim):
    q = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    c = [v for _, v in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in q)[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (d2(v, c[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in q]
        new = []
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(q, of, strict=True) if a == j]
            new.append([sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else c[j])
        c = new
    out = [(i, nearest(v), d2(v, c[nearest(v)]), hashlib.sha256(",".join(map(str, c[nearest(v)])).encode()).hexdigest()) for i, v in q]
    per = {j: sum(o[2] for o in out if o[1] == j) for j in range(len(c))}
    return sorted((str(i), j, d, per[j], sum(per.values()), s) for i, j, d, s in out)


@pytest.mark.parametrize(("n", "k", "near", "spread"), [(600, 8, None, 3), (300, 20, 5, 40), (300, 20, 1, 40), (5, 8, None, 3), (1, 8, None, 3), (60, 2, None, 1)])
def test_centroids(spark, n, k, near, spread):
    """Few distinct small integers give many ties and equal vectors."""
    rnd = random.Random(n * k)
    rows = [(i, [rnd.randrange(-spread, spread) / 1024 for _ in range(4)]) for i in range(n)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=k, rounds=6, dim=4, near=near)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == lloyd(rows, k, 6, 4)


def test_centroid_edges(spark):
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 3.0]), (5, [float("nan")] * 3), (6, [float("inf"), 0.0, 0.0]), (7, [0.0] * 3), (7, [0.0] * 3), (None, [1.5, -2.25, 1e4]), (8, [-0.0001, 5.0, 5.0]), (9, [1e4, 0.0, 0.0]), (10, [1e4, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, own int, q string")
    got = sorted((str(r[0]), *r[1:]) for r in centroids.cluster(df, k=3, dim=3).collect())
    assert got == lloyd(rows, 3, 10, 3) and len(got) == 6
    empty = centroids.cluster(df.limit(0))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.count() == 0
    huge = centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>"), k=1, dim=2).collect()
    assert [r.distance for r in huge] == [(1 << 54), (1 << 54)]


def test_bounds_spare_work():
    """Most vectors are not measured again once centroids move little, and what the bounds say is what measuring everything says."""
    rnd = np.random.default_rng(5)
    c = rnd.integers(-10_000, 10_000, (32, 16))
    x = np.concatenate([c[i] + rnd.integers(-3000, 3000, (200, 16)) for i in range(32)])
    s, skipped = centroids.Bounds.of_all(x, c, 8), []
    for _ in range(8):
        new = c + rnd.integers(-40, 40, c.shape)
        by = centroids.up(np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)))
        before = s.upper + by[s.own]
        s, c = s.moved(x, new, by), new
        skipped.append((s.upper >= before).mean())
        assert (s.own == centroids.squared(x, c).argmin(axis=1)).all()
    assert skipped[0] > 0.5
    s = s.narrowed(3)
    d = np.sqrt(np.sort(centroids.squared(x, c), axis=1).astype(float))
    assert (s.rest <= d[:, 4]).all() and s.near.shape[1] == 3
