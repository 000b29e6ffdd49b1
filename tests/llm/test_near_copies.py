"""Near copies against brute force, and rows that are null, repeated or share an id."""

import collections
import math

import duckdb
import numpy as np
import pytest

from podium.llm import decontaminate, embedding_dedup, line_dedup, ngram_join

SF = "/root/testdata/sf0.01"


def runs(line):
    u = line.encode("utf-16-be")
    return frozenset(u[2 * i : 2 * i + 10] for i in range(max(1, len(u) // 2 - 4)))


def components(sets, threshold):
    """Least member of each set's component, by prefix lists in order of size."""
    freq = collections.Counter(x for s in sets for x in s)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s = sets[i]
        prefix = sorted(s, key=lambda x: (freq[x], x))[: len(s) - math.ceil(threshold * len(s)) + 1]
        for j in {j for x in prefix for j in lists[x]}:
            if len(s & sets[j]) >= threshold * len(s | sets[j]) - 1e-9:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in prefix:
            lists[x].append(i)
    return [root(i) for i in range(len(sets))]


def test_lines_against_brute_force(spark):
    rows = sorted(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where text is not null").fetchall())
    places = collections.defaultdict(list)
    for d, text in rows:
        for i, line in enumerate(text.split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                places[line].append((d, i))
    lines = list(places)
    groups = collections.defaultdict(list)
    for i, g in enumerate(components([runs(x) for x in lines], 0.8)):
        groups[g] += places[lines[i]]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    want = collections.Counter(d for d, _ in gone)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert sum(got.values()) >= 0.99 * len(gone)
    assert all(n <= want.get(d, 0) for d, n in got.items())


def test_families_of_related_lines(spark):
    """Pairs of near copies among lines that are all somewhat alike: most pairs are found, nothing else goes."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    frame, lines = [word() for _ in range(100)], []
    for _ in range(200):
        own = [w if rng.random() < 0.8 else word() for w in frame]
        other = list(own)
        for i in rng.choice(100, 7, replace=False):
            other[i] = word()
        lines += [" ".join(own), " ".join(other)]
    part = components([runs(x) for x in lines], 0.8)
    want = {i for i, g in enumerate(part) if g != i}
    got = {r["doc_id"] for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect() if r["n_removed"]}
    assert len(want) >= 190 and got <= want and len(got) >= 0.95 * len(want)


def test_first_of_each_group(spark):
    base = [f"w{i}" for i in range(60)]
    near, other = [*base[:-1], "x"], [f"v{i}" for i in range(40)]
    rows = [(5, " ".join(base)), (None, " ".join(near)), (7, " ".join(near)), (7, " ".join(other)), (7, " ".join(other)), (8, None), (9, ""), (9, "")]
    kept = ngram_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=key) == sorted([rows[0], rows[3], rows[5], rows[6], rows[7]], key=key)


def test_clean_judges_each_row_by_its_text(spark):
    item = " ".join(f"tok{i}" for i in range(20))
    rows = [(1, f"a {item} b"), (1, "nothing of it"), (None, item), (None, "fine"), (2, None), (3, "")]
    kept = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item), (9, item)], "item_id long, text string"))
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {rows[1], rows[3], rows[4], rows[5]}


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_rows_and_columns(spark, tmp_path, stage):
    """Nulls in every column, empty and blank texts, repeats, and columns named like a stage's own."""
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(f"tok{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, n_removed long, __tag long, node long, pos int, item string, have string, id long, tag string, c1 string"
    some = "the quick brown fox jumps over the lazy dog and runs far away"
    rest = ("en", "s", 1, 2, 3, 4, 5, 6, "i", "h", 7, "t", "c")
    rows = [(1, some, *rest), (1, some, *rest), (2, None, *rest), (3, "", *rest), (None, "quite another text with words of its own", *[None] * 13), (4, " \n ", *rest)]
    docs = spark.createDataFrame(rows, names)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    got = collections.Counter(tuple(r) for r in out.collect())
    assert not got - collections.Counter((*r[:4], len(r[1]) if stage == 1 and r[1] is not None else None if stage == 1 else r[4], *r[5:]) for r in rows)
    assert {r[1] for r in got} >= {some, "quite another text with words of its own"}
    none = corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0 and none.columns == docs.columns


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("dims", [2, 3, 8, 16, 24, 32, 48, 64, 256])
def test_codes_bring_near_vectors_together(dims, clustered):
    """Pairs at cosine 0.90 to 0.92, the least that link, of vectors of every length: at least 0.95 share a key and lie within the radius."""
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(6000, dims))
    if clustered:
        x = rng.normal(size=(40, dims))[rng.integers(0, 40, 6000)] + 0.4 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, projection = embedding_dedup.turns(x[:4000])
    a = x[4000:]
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.92, (len(a), 1))
    b = cos * a + np.sqrt(1 - cos**2) * noise
    ca, cb = (embedding_dedup.encode(v, mean, projection) for v in (a, b))
    met = np.bitwise_count(ca ^ cb) <= 20
    met &= np.any([np.bitwise_count((ca ^ cb) >> np.uint64(16 * t) & np.uint64(0xFFFF)) <= 2 for t in range(4)], axis=0)
    assert met.mean() >= 0.95


def test_links_of_short_vectors_against_brute_force(spark):
    """Sixteen dimensions, most pairs near 0.9: at least 0.95 of all links are found, and none below 0.9."""
    rng = np.random.default_rng(16)
    a = rng.normal(size=(1500, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.95, (len(a), 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * noise])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.9).sum(axis=1) - 1
    assert sum(got.values()) >= 0.95 * want.sum() and all(got[i] <= want[i] for i in got)


def test_line_signature_holds_no_bands(spark):
    """F2 (op6): what is kept for each line is its minima and bitmap, not a hash for each band; a byte of each goes into two longs."""
    from pyspark.sql import functions as F

    rows = line_dedup.signed(spark.createDataFrame([(1, "some line of text"), (1, "some line of text"), (2, "b")], "node long, line string"), 5)
    assert rows.columns == ["node", "n", *line_dedup.SKETCH, *(f"m{i}" for i in range(16))] and {t for _, t in rows.dtypes[-16:]} == {"int"}
    got = {r["node"]: r for r in rows.select("*", line_dedup.packed(0).alias("s0"), line_dedup.packed(8).alias("s1")).collect()}
    assert got[1]["n"] == 2 and got[2]["n"] == 1
    for r in got.values():
        both = r["s0"].to_bytes(8, "little", signed=True) + r["s1"].to_bytes(8, "little", signed=True)
        assert list(both) == [r[f"m{i}"] & 255 for i in range(16)]
    # the number of equal bytes decides, whichever bits of the others differ
    for k in range(17):
        other = [x ^ (0 if i < k else 1 << i % 8) for i, x in enumerate(range(100, 116))]
        sides = [(int.from_bytes(bytes(b[:8]), "little", signed=True), int.from_bytes(bytes(b[8:]), "little", signed=True)) for b in (list(range(100, 116)), other)]
        pair = spark.range(1).select(*(F.lit(v).alias(f"{s}s{i}") for s, two in zip("ab", sides) for i, v in enumerate(two)))
        assert pair.where(line_dedup.agreeing()).count() == (k >= line_dedup.AGREE)


def test_lines_pair_is_made_once(spark):
    """op6, pipeline: a pair of lines that meets in several bands is made in the first of them, and in no other."""
    from podium.llm import line_dedup

    names = [f"k{b}" for b in range(len(line_dedup.BANDS) - 1)]
    held = [{b for b in range(12) if (7919 * (i + 1) >> b) & 1} for i in range(20)]
    row = lambda i, b: (i, b, *(16 * (b2 % 3) + b2 if b2 in held[i] else None for b2 in range(11)))
    sides = [spark.createDataFrame([row(i, b) for i in range(20) for b in held[i]], f"{s}node long, band long, " + ", ".join(f"{s}{k} long" for k in names)) for s in "ab"]
    left, right, first = line_dedup.first_met(*sides, names)
    met = left.join(right, "band").where("anode < bnode").where(first).select("anode", "bnode", "band")
    want = {(i, j, min(held[i] & held[j])) for i in range(20) for j in range(i + 1, 20) if held[i] & held[j]}
    assert sorted(map(tuple, met.collect())) == sorted(want)
