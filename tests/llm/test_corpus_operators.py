"""Corpus operators against brute force on the small tables and on hand-made edge cases."""

import collections
import hashlib
import json
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from podium.llm import catalog, decontaminate, embedding_dedup, language_id, license_scan, line_dedup, lm_score, ngram_join, packing, quality, substring_dedup

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, score double"
EDGE = [
    (1, None, "en", None, None, "x", 0.0), (2, "", None, "a", 0, None, None), (3, "one", "en", "a", 3, "y", 1.0), (3, "one", "en", "a", 3, "y", 1.0), (None, "two words", None, None, 9, "z", 2.0),
    (5, "long " * 30_000, "en", "a", 150_000, "q", 3.0), (6, "...\n\n \n", "fr", "b", 7, "w", 4.0), (7, "one\ntwo lines of text\none", "en", "b", 20, "v", 5.0),
]


@pytest.fixture(scope="module")
def rows():
    return sorted(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


def run(spark, name):
    return catalog.queries()[name](spark, SF).toPandas()


def words(text):
    return (text or "").encode().split()


def test_substring_dedup(spark, rows):
    seen, want = set(), {}
    for d, t in rows:
        w = words(t)
        gone = bytearray(len(w))
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = b"\1" * 20
            else:
                seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want[d] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op3_substring_dedup").itertuples()}
    assert got == want


def test_ngram_join(spark, rows):
    sets = {d: frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if (w := [x.lower() for x in words(t)]) else frozenset() for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for d, s in sets.items():
        shared = collections.Counter(y for x in s for y in lists[x])
        for x in s:
            lists[x].append(d)
        for y, k in shared.items():
            if 100 * k >= 90 * (len(s) + len(sets[y]) - k) and root(d) != root(y):
                parent[max(root(d), root(y))] = min(root(d), root(y))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op2_ngram_join").itertuples()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}


def test_small_sets_link_by_subsets(spark):
    base = [f"w{i}" for i in range(20)]
    texts = [(i, " ".join([*base[:n], *extra])) for i, (n, extra) in enumerate([(12, []), (12, ["x"]), (13, []), (20, []), (20, ["y"]), (4, []), (4, [])])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5}


@pytest.mark.parametrize("k, num, boundary, size", [(3, 90, 17, 12), (5, 80, 7, 9)])
def test_subsets_link_only_the_sizes_they_are_for(spark, monkeypatch, k, num, boundary, size):
    monkeypatch.setattr(ngram_join.Bounds, "boundary", lambda self, length: boundary)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(size)]
    texts = [base, [*base[:-1], "other"]]
    for g in range(12):
        own = [f"g{g}x{i}" for i in range(boundary + k - 1)]
        texts += [[*own[: rng.integers(k, len(own) + 1)], *([f"t{j}"] if j % 2 else [])] for j in range(5)]
    sets = [{tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))} for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                part = [min(part[i], part[j]) if x in (part[i], part[j]) else x for x in part]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, k=k, num=num).collect()}
    assert got == dict(enumerate(part)) and got[1] == 1


def test_lm_base_score(spark, rows):
    tokens = {d: [*(x.lower() for x in words(t)), b"\n"] for d, t in rows}
    training = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for d in training for w in tokens[d])
    n, v = sum(c.values()), len(c)
    got = run(spark, "op4_lm_score").set_index("doc_id")
    for d, t in tokens.items():
        r = got.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_filter_reads_levels_back(spark):
    rng = np.random.default_rng(3)
    h, c = rng.integers(0, 1 << 63, 20_000), rng.integers(2, 5000, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"h": h, "c": c}))
    want = np.floor(np.log2(c)) + 1
    blocks, rest, _ = lm_score.build_filter(df.limit(0), df, most=30, bits_per_key=10)
    got = lm_score.Filter(blocks).levels(h.astype(np.uint64))
    assert rest is None and len(blocks) * 8 >= 10 * want.sum()
    assert (got >= want).all()
    assert (got == want).mean() > 0.95
    blocks, rest, least = lm_score.build_filter(df.limit(0), df, most=20, bits_per_key=10)
    assert len(blocks) * 8 <= 1 << 21 and rest.count() == (want < least[2]).sum() > 0


def lm_by_hand(texts, held, weight=1000.0):
    """Scores from exact counts, quantised as the filter does."""
    tokens = {d: [x.lower() for x in words(t)] + [b"\n"] for d, t in texts}
    training = [t for d, t in tokens.items() if not held(d)]
    one, two = collections.Counter(w for t in training for w in t), collections.Counter(p for t in training for p in zip([None, *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    one[None] = len(training)

    def level(c):
        low = 2.0 ** (c.bit_length() - 1)
        return math.sqrt(low * (2 * low - 1)) if c else 0.0

    def p(a, b):
        return (min(level(two[a, b]), level(one[a])) + weight * (level(one[b]) + 1) / (n + v + 1)) / (level(one[a]) + weight)

    return {d: sum(math.log10(p(a, b)) for a, b in zip([None, *t], t, strict=False)) for d, t in tokens.items()}


@pytest.mark.parametrize("most", [30, 21, 20])
def test_lm_score_by_exact_counts(spark, rows, most):
    texts = rows[:400]
    want = lm_by_hand(texts, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, most=most, bits_per_key=16).collect()}
    off = np.array([abs(got[d] / want[d] - 1) for d in want])
    assert got.keys() == want.keys() and off.mean() < 0.005 and off.max() < 0.05


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 64))
    x = np.concatenate([base, base[:40] + 0.25 * rng.normal(size=(40, 64)), base[:5], base[:1].repeat(30, 0) + 0.2 * rng.normal(size=(30, 64))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (904, [1.0]), (None, x[1].tolist())]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    links = links + (u @ u[1] >= 0.9)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.9 * links.sum() and all(got[i]["n_links"] <= links[i] for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 905))


def test_embeddings_of_every_length(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, 32))
    many = np.concatenate([base, base[:200] + 0.2 * rng.normal(size=(200, 32)), base[:3]])
    few = rng.normal(size=(4, 64))
    few = np.concatenate([few, few + 0.1 * rng.normal(size=(4, 64)), 2 * few[:1]])
    groups = [(0, many), (10_000, few), (20_000, np.array([[1.0, 2.0], [2.0, 4.0], [-1.0, -2.0]])), (30_000, np.array([[3.0]]))]
    rows = [(first + i, v.tolist()) for first, x in groups for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got.keys() == {r[0] for r in rows}
    for first, x in groups:
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        links = (u @ u.T >= 0.9).sum(axis=1) - 1
        found = np.array([got[first + i]["n_links"] for i in range(len(x))])
        assert (found <= links).all() and found.sum() >= (0.9 if first == 0 else 1.0) * links.sum()
    assert links.sum() == 0 and got[20_001]["component_id"] == 20_000 and got[10_008]["component_id"] == 10_000


def test_embeddings_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_language_id(spark):
    got = run(spark, "op7_language_id").merge(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").df(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_quality(spark):
    got = run(spark, "op9_quality_classifier").merge(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").df(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_license_scan(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want, got = con.sql(license_scan.oracle()).df(), run(spark, "op8_license_scan")
    cols = sorted(want.columns)
    by = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(by(want), by(got), check_dtype=False)


def test_license_runs(spark):
    import textwrap

    notices = dict(license_scan.TEMPLATES)
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    wrapped = "Copyright (c) A. Author\n\n" + textwrap.fill(mit, 72) + "\n\nThe above copyright notice shall be included.\nTHE SOFTWARE IS PROVIDED AS IS.\n"
    changed = mit.replace("free of charge", "at no cost").replace("merge, ", "")
    rows = [
        (1, wrapped), (2, "Some prose before it. " + textwrap.fill(notices["ISC"], 60) + " And prose after."), (3, "word " * 5000 + changed + " end" * 3000),
        (4, "This file, by the way, is licensed under CC BY-SA today; all rights were reserved."), (5, "permission is hereby"), (6, None), (7, ""), (8, "Foo. All rights reserved."), (8, "x"),
        (9, "rights"),
    ]
    got = {(r["doc_id"], r["license"], r["line_no"]): r["dice"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() >= {(1, "MIT", -2), (2, "ISC", -2), (3, "MIT", -2), (8, "Proprietary", -2)}
    assert got[1, "MIT", -2] == got[2, "ISC", -2] == 1.0 and 0.8 <= got[3, "MIT", -2] < 1
    assert not any(d in (4, 5, 6, 7, 9) for d, _, _ in got)


def check_packing(pieces, ids, length=2048):
    for d, g in pieces.groupby("doc_id", dropna=False):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert zlib.crc32(np.array(ids[d][at : at + r.length], dtype="<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[d])
    for _, g in pieces.groupby("sequence_id"):
        at = 0
        for r in g.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= length


def test_packing(spark, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(text, add_special_tokens=False).ids, 1] for d, text in rows}
    pieces = run(spark, "op10_packing")
    check_packing(pieces, ids)
    assert pieces.length.sum() / 2048 / pieces.sequence_id.nunique() > 0.99


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}, {"a": 1, "b": 1, "c": 0}])
def test_schedule_with_shares(weights):
    totals = {"a": 5000, "b": 31_000, "c": 777}
    s = packing.Schedule(totals, 256, weights)
    used = collections.defaultdict(list)
    for source, n in totals.items():
        at = 0
        while at < n:
            k = min(n - at, 97)
            for w, place, size in s.pieces(source, at, k):
                used[w].append((place, size))
            at += k
    for w, parts in used.items():
        end = 0
        for place, size in sorted(parts):
            assert place == end
            end += size
        assert end <= 256 and (end == 256 or w == max(used))
    assert sorted(used) == list(range(len(used)))


def test_tokens_like_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own, t = packing.Tokens(P.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in ("a  b", " a", "a ", "a\n b\n\nc", "x\t y", "a<|endoftext|>b", "été don't 12ab  \n", "   ", "a  b　 c", "a  b"):
        assert np.frombuffer(own.encode(text), dtype="<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_decontaminate(spark, rows):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    split = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip().split(" ")
    want = set()
    for d, t in rows:
        have = split(t or "")
        place = collections.defaultdict(list)
        for j, x in enumerate(have):
            place[x].append(j)
        for i, text in items:
            tokens = split(text)
            w = min(13, len(tokens))
            shifts = collections.Counter(p - j for j, x in enumerate(tokens) for p in place.get(x, ()))
            for shift, k in shifts.items():
                if k >= w - 2:
                    m = [0 <= j + shift < len(have) and have[j + shift] == tokens[j] for j in range(len(tokens))]
                    if any((w - sum(m[s : s + w])) * 13 <= w * 2 for s in range(len(tokens) - w + 1)):
                        want.add((d, i))
    got = run(spark, "op1_decontaminate")
    assert set(zip(got.doc_id, got.item_id, strict=True)) == want


def test_substitutions_are_tolerated(spark):
    item = [f"tok{i}" for i in range(30)]
    spoilt = [x if i % 6 else "other" for i, x in enumerate(item)]
    wrong = [x if i % 3 else "other" for i, x in enumerate(item)]
    docs = spark.createDataFrame([(1, "a b c " + " ".join(spoilt)), (2, " ".join(wrong)), (3, None), (4, "")], "doc_id long, text string")
    found = decontaminate.find(docs, spark.createDataFrame([(9, " ".join(item)), (8, None), (7, "too short")], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 9)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).orderBy("doc_id").collect()] == [2, 3, 4]


def test_short_items(spark):
    items = {n: [f"i{n}t{j}" for j in range(n)] for n in range(1, 14)}
    texts, want = [], set()
    for n, item in items.items():
        for spoilt in [(), *((j,) for j in range(n)), *((j, (j + 3) % n) for j in range(n))]:
            if len(spoilt) * 13 <= n * 2 or not spoilt:
                want.add((len(texts), n))
            elif len(set(spoilt)) * 13 <= n * 2:
                want.add((len(texts), n))
            texts.append("before it " + " ".join("other" if j in spoilt else x for j, x in enumerate(item)) + " after it")
    want |= {(len(texts), 50)}
    texts += ["他说今天的天气非常好所以出去", "...", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = [(n, " ".join(x)) for n, x in items.items()] + [(50, "今天的天气非常好"), (51, "?!")]
    found = decontaminate.find(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog and runs far away from the old stone house by the river bank near here while all the other animals of the forest sleep well until the next morning comes today"
    near = line.replace("today", "tonight")
    docs = spark.createDataFrame([(1, f"{line}\nfirst"), (2, f"second\n{near}\n"), (3, f"{line}\n\n{line}"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup(docs).collect()}
    assert got == {1: (f"{line}\nfirst", 2, 0), 2: ("second\n", 3, 1), 3: ("", 3, 2), 4: (None, 0, 0)}


def test_lines_without_white_space(spark):
    starts = ["https://www.example.com/", "identifier_of_many_", "今天的天气非常好我们一起去公园里散步然后"]
    lines = [s + e for s in starts for e in ("index/of/all/things", "quite-another-place", "zzz")] + ["x", "xy", "😀😀"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert {r["n_removed"] for r in line_dedup.dedup(docs).collect()} == {0}


def test_lines_beside_the_pivots(spark):
    """Several clusters of near copies of one template, which share buckets."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    frame, lines = [word() for _ in range(40)], []
    for _ in range(60):
        own = [*frame, *(word() for _ in range(8))]
        lines += [" ".join([*own, word()]) for _ in range(3)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    part = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                part = [min(part[i], part[j]) if x in (part[i], part[j]) else x for x in part]
    got = {r["doc_id"] for r in line_dedup.dedup(docs, q=5).collect() if r["n_removed"]}
    assert got == set(range(len(lines))) - set(part) and len(got) == 120


def test_one_changed_word_of_25(spark):
    line = "the quick brown fox jumps over the lazy dog and runs far away from the old stone house by the river bank near here today"
    assert len(line.split()) == 25
    docs = spark.createDataFrame([(1, line), (2, line.replace("stone", "brick")), (3, line.replace("today", "tonight"))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(docs).collect()} == {1: 0, 2: 1, 3: 1}


def test_edges(spark, edge):
    """Nulls, empty and long texts, repeated rows, clashing columns: every row is answered."""
    n = len(EDGE)
    assert language_id.identify(edge).count() == n
    assert {r["lang_pred"] for r in language_id.identify(edge.where("doc_id in (1, 2, 6)")).collect()} == {"und"}
    assert substring_dedup.dedup(edge).count() == n
    near = ngram_join.near_duplicates(edge).collect()
    assert len(near) == n and {r["n_shingles"] for r in near if r["doc_id"] in (1, 2)} == {0}
    assert lm_score.score(edge).count() == n
    assert line_dedup.dedup(edge).count() == n
    labels = spark.createDataFrame([(3, 1), (6, 0), (6, None), (None, 1)], "doc_id long, quality int")
    assert quality.score(edge, labels).count() == n
    license_scan.scan(edge).collect()
    pieces = packing.pack(edge, tokens_path=catalog.vocabulary()).toPandas()
    assert pieces[pieces.doc_id.isin([1, 2])].doc_tokens.eq(1).all()


def test_empty_tables(spark, edge):
    none = edge.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (language_id.identify(none), substring_dedup.dedup(none), ngram_join.near_duplicates(none), lm_score.score(none), line_dedup.dedup(none), quality.score(none, labels), license_scan.scan(none), packing.pack(none, tokens_path=catalog.vocabulary()), decontaminate.find(none, none.selectExpr("doc_id as item_id", "text"))):
        assert out.count() == 0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() > 800  # lines of junk and repeated lines make some texts empty


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 11))
    assert json.dumps(catalog.oracle_sql())
