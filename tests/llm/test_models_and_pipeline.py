"""Language profiles, quality rules and the whole pipeline against plain Python."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_near_copies import components, runs

from podium.llm import catalog, language_id, quality

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# -- languages ----------------------------------------------------------------------------------


class Profiles:
    """One letter, one n-gram and one text after the other."""

    def __init__(self, dims=1024, seed=7):
        self.dims, self.seed, self.letters = dims, seed, {}

    def letter(self, c):
        if c not in self.letters:
            self.letters[c] = np.random.default_rng([self.seed, ord(c)]).integers(0, 2, self.dims, dtype=np.int8).astype(np.int64) * 2 - 1
        return self.letters[c]

    def text(self, text):
        plain = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f"   {(text or '').lower()}   "))
        grams = collections.Counter(plain[i : i + 3] for i in range(len(plain) - 2))
        out = np.zeros(self.dims, dtype=np.int64)
        for (a, b, c), n in grams.items():
            out += n * np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return out if any(x.isalpha() for x in plain) else np.zeros(self.dims)

    def prototypes(self, rows):
        total = {}
        for d, text, lang in rows:
            if d is not None and not held(d) and lang is not None and text is not None:
                v = self.text(text)
                if v.any():
                    total[lang] = total.get(lang, 0) + v / np.linalg.norm(v)
        return {k: v / np.linalg.norm(v) for k, v in sorted(total.items())}


def told(profiles, prototypes, text):
    v = profiles.text(text)
    if not v.any() or not prototypes:
        return "und", 0.0
    cos = {k: float(v @ p / np.linalg.norm(v)) for k, p in prototypes.items()}
    best = max(cos, key=lambda k: (cos[k], [-ord(c) for c in k]))
    return best, min(1.0, max(0.0, cos[best]))


def test_language_profiles(spark):
    rows = duckdb.sql(f"select doc_id, text, lang from '{SMALL}/documents.parquet'").fetchall()
    p = Profiles()
    prototypes = p.prototypes(rows)
    got = {r.doc_id: r for r in catalog.queries()["op7_language_id"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for d, text, _ in rows:
        lang, score = told(p, prototypes, text)
        assert (got[d].held_out, got[d].lang_pred) == (held(d), lang) and abs(got[d].score - score) < 1e-4


def test_equal_cosines_go_to_the_first_language(spark):
    """Two languages that learned the same texts, in either order of arrival; und where there is no letter."""
    texts = ["one two three", "four five six", "seven", "eight"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, lang) for t in texts for lang in ("zz", "aa")] * 3)]
    learned = [(d, t, lang) for d, t, lang in rows if not held(d)]
    per = collections.Counter((t, lang) for _, t, lang in learned)
    extra = [(1000 + i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("zz", "aa") for _ in range(9 - per[t, lang]))]
    even, i = list(learned), 2000
    for _, t, lang in extra:
        while held(i):
            i += 1
        even.append((i, t, lang))
        i += 1
    even += [(5000, "…12", None), (5001, "one", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(even, "doc_id long, text string, lang string")).collect()}
    assert got[5001][0] == "aa" and got[5000] == ("und", 0.0) and {lang for lang, _ in got.values()} == {"aa", "und"}


# -- quality ------------------------------------------------------------------------------------


def numbers(text):
    text = text or ""
    size, words = max(len(text), 1), text.split(" ")
    lost = lambda pattern: (len(text) - len(re.sub(pattern, "", text))) / size
    return {
        "log_size": float(np.log1p(float(len(text)))), "word_length": size / len(words), "shout": lost("[A-Z]{2,}"), "digits": lost("[0-9]+"), "symbols": lost(r"[#$%&*@^~<>{}\\|=_+]+"),
        "bars": text.count("|") / size, "bangs": text.count("!") / size, "stops": text.count(".") / size, "lines": text.count("\n") / size, "variety": len(set(words)) / len(words),
    }


def judged(rules, x):
    z = rules.base
    for rule, weight in zip(rules.rules, rules.weights, strict=True):
        if all(x[name] <= bound if at_most else x[name] > bound for name, at_most, bound in rule):
            z += weight
    return 1 / (1 + np.exp(-z))


def test_quality_rules(spark):
    """The rules are what the labelled rows outside the held-out fold give, and every document's score is what they say of it."""
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    labels = sorted((d, q) for d, q in duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall() if d in docs and not held(d) and q is not None)
    x = {d: numbers(t) for d, t in docs.items()}
    rules = quality.fit({k: np.array([x[d][k] for d, _ in labels]) for k in numbers("")}, np.array([q for _, q in labels], dtype=float))
    got = catalog.queries()["op9_quality_classifier"](spark, SF).collect()
    assert len(got) == len(docs) and len(rules.rules) > 3
    for r in got:
        want = judged(rules, x[r.doc_id])
        assert abs(r.score - want) < 1e-6 and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3)


def test_trees_go_on_from_their_leaves():
    """A leaf that stops for want of gain counts too: what is boosted twice doesn't find the same again."""
    rng = np.random.default_rng(0)
    x = {"a": rng.random(400)}
    y = (x["a"] > 0.5).astype(float)
    leaves = [(path, rows) for path, _, rows, leaf in quality.grow(x, {"a": np.array([0.5])}, 0.5 - y, np.full(400, 0.25), 3, np.arange(400)) if leaf]
    assert len(leaves) == 2 and sum(len(r) for _, r in leaves) == 400


def test_repeated_documents_are_learned_from_once(spark):
    """A labelled id that holds most rows brings one row to the driver; ids may be texts."""
    docs = spark.range(3000).selectExpr("CASE WHEN id < 2900 THEN 'hot' ELSE concat('d', id) END AS doc_id", "concat(repeat('!', cast(id % 2 AS int) * 30), ' word ', id) AS text")
    labels = spark.range(2890, 3000).selectExpr("CASE WHEN id < 2900 THEN 'hot' ELSE concat('d', id) END AS doc_id", "cast(id % 2 AS int) AS quality")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        fit = quality.fit
        m.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
        out = quality.score(docs, labels)
    assert seen[0] <= 101 and out.count() == 3000


# -- the pipeline -------------------------------------------------------------------------------


def shingles(text, k=5):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def without_repeated_lines(rows):
    """Texts without lines that are near copies of earlier ones."""
    places = collections.defaultdict(list)
    for d, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                places[line].append((d, i))
    lines, groups = list(places), collections.defaultdict(list)
    for i, g in enumerate(components([runs(x) for x in lines], 0.8)):
        groups[g] += places[lines[i]]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    out = []
    for d, text in rows:
        kept = [x for i, x in enumerate((text or "").split("\n")) if (d, i) not in gone]
        lost = len((text or "").split("\n")) - len(kept)
        if not lost or "\n".join(kept).strip():
            out.append((d, "\n".join(kept) if text is not None else None))
    return out


def leaked(text, items):
    split = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip().split(" ")
    have, place = split(text or ""), collections.defaultdict(list)
    for j, x in enumerate(have):
        place[x].append(j)
    for item in items:
        want = split(item)
        w = min(13, len(want))
        for shift, k in collections.Counter(p - j for j, x in enumerate(want) for p in place.get(x, ())).items():
            if k >= w - 2:
                m = [0 <= j + shift < len(have) and have[j + shift] == want[j] for j in range(len(want))]
                if any((w - sum(m[s : s + w])) * 13 <= w * 2 for s in range(len(want) - w + 1)):
                    return True
    return False


def test_pipeline(spark, tmp_path):
    """Each stage against loops over what the stage before it gave, then the packed tokens against the tokenizers library, and run() against the stages."""
    import corpus_pipeline
    import public_tokenizers as P
    from tokenizers import Tokenizer

    sf_dir, benchmark = str(tmp_path), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    benchmark.write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = docs.where("lang = 'en' and n_chars > 500").orderBy("doc_id").first().text
    some, cut = some.replace("\n", " "), some.index(" ", len(some) // 2)  # the same words in other lines
    leak = [(900_000 + i, f"A line of its own number {i}, then {r.text} and {'more ' * i}of it.", "en", None, None) for i, r in enumerate(benchmark.orderBy("item_id").limit(3).collect())]
    odd = [(900_010, None, None, None, None), (900_011, "12 34", "en", "s", 5), (900_013, some, "en", None, None), (900_012, f"{some[:cut]}\n{some[cut:]}", "en", "s", None)]
    docs.unionByName(spark.createDataFrame([*leak, *odd], docs.schema)).write.parquet(f"{sf_dir}/documents.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.collect()
    kept = []
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, frames[-1], sf_dir).collect()
        frames.append(spark.createDataFrame(rows, docs.schema))
        kept.append(sorted((r.doc_id, r.text) for r in rows))
    p = Profiles()
    prototypes = p.prototypes([(r.doc_id, r.text, r.lang) for r in first])
    assert kept[0] == sorted((r.doc_id, r.text) for r in first if told(p, prototypes, r.text)[0] != "und")
    assert kept[1] == without_repeated_lines(kept[0])
    part = components([shingles(t) for _, t in kept[1]], 0.8)
    assert kept[2] == [row for i, row in enumerate(kept[1]) if part[i] == i]
    items = [t for (t,) in duckdb.sql(f"select text from '{SMALL}/benchmark.parquet'").fetchall()]
    assert kept[3] == [row for row in kept[2] if not leaked(row[1], items)]
    left = [{d for d, _ in rows} for rows in kept]
    assert left[0].isdisjoint({900_010, 900_011}) and {900_000, 900_001, 900_002} <= left[2] and not {900_000, 900_001, 900_002} & left[3] and len(left[2]) < len(left[1]) < len(first)

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(text or "", add_special_tokens=False).ids, 1] for d, text in kept[3]}
    for out in (corpus_pipeline.STAGES[-1][1](spark, frames[-1], sf_dir).toPandas(), corpus_pipeline.run(spark, sf_dir).toPandas()):
        assert set(out.doc_id) == set(ids)
        for d, own in out.sort_values("start").groupby("doc_id"):
            assert own.doc_tokens.eq(len(ids[d])).all() and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids[d])
            for r in own.itertuples():
                assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], dtype="<u4").tobytes())
        for _, own in out.sort_values("offset").groupby("sequence_id"):
            assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
        assert out.length.sum() > 2048 * (out.sequence_id.nunique() - 1)
