"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, as connected components.

Size-aware heavy-light join. Two sets of n and m n-grams reach Jaccard J only with t(n, m) in common.
A small set enumerates its subsets of the sizes t that matter, each under the pair of sizes (n, m) it is
meant for; sets of just these two sizes that share one are linked, with no further test. A large set scans inverted lists: in a global order with rare n-grams first, two similar
sets share one of the first n - ceil(J n) + 1, so lists of those are enough. The boundary between small
and large is where enumeration would cost more rows than scanning, by the measured list lengths.

Equal sets are one node from the start, named by the 64-bit sum of their hashed n-grams (n-grams are
counted by 64-bit hashes, and compared by 48 of these bits). Lists are not expanded into pairs: each set is first tested
against the pivot of its lists, the one with the most and longest lists among sets of about its size; sets that came near a pivot go on with other pivots, drawn at random, as long as that links
components. Only pairs across the components so found are then generated, under bounds that are asked before a row is made: their
sizes; the places of the n-gram in both orders (what follows it must suffice for the overlap); the Hamming
distance of 512-bit parity sketches, which no symmetric difference undercuts; and that of 256-bit sketches of one n-gram in
32, which tells long sets apart, with six standard deviations allowed. All that pass are verified with
whole sets, so that components are exact but for one pair in some 10**9.

Defined results: null and empty texts have no n-grams and link with nothing; a text of fewer than
``k`` words is one n-gram; every row of the input gives a row, repeated rows too; a null id keeps a
null component unless it is linked to an id.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SKETCH_BITS = 19  # counters of the frequency sketch: 2 MB, broadcast
BITMAP_BITS = 26
SAMPLED = 32  # one n-gram in so many goes into the second sketch
PARITY = [f"p{i}" for i in range(8)]
SAMPLE = [f"q{i}" for i in range(4)]
SKETCH = [*PARITY, *SAMPLE]
#: Turns of pivots at most, and the share of tested pairs that a turn must link for another one.
TURNS, WORTH = 3, 0.1


class Bounds:
    """What Jaccard num/den asks of two set sizes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def most(self, n: int) -> int:
        return n * self.den // self.num

    def common(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def subsets(self, n: int, boundary: int):
        """(partner size, elements left out) for each kind of subset that a small set enumerates."""
        for m in range(self.least(n), min(self.most(n), boundary) + 1):
            if self.common(n, m) <= min(n, m):
                yield m, n - self.common(n, m)

    def boundary(self, list_length: float) -> int:
        """The largest size up to which enumeration makes no more rows than scanning."""
        n = 0
        while True:
            rows = sum(math.comb(n + 1, out) for _, out in self.subsets(n + 1, self.most(n + 1)))
            if rows > self.prefix(n + 1) * (1 + (list_length - 1) * (n + 1) / 2) or n > 64:
                return max(n, 1)
            n += 1


def sets_of(texts: list[bytes | None], k: int):
    """(sorted distinct n-gram hashes, signature, parity words) of each text."""
    owner, h = common.Words([t.lower() if t else t for t in texts]).shingles(k)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[new], h[new]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(common.mix(h + np.uint64(0x51ED270B)), dtype=np.uint64)])
    sigs = common.signed(total[edges[1:]] - total[edges[:-1]])

    def parity(owner, h, bits):
        odd = np.bincount(owner * bits + (h >> np.uint64(20)).astype(np.int64) % bits, minlength=len(texts) * bits).astype(np.uint8) & 1
        return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)

    some = (h >> np.uint64(34)) % np.uint64(SAMPLED) == 0
    return h, edges, sigs, np.concatenate([parity(owner, h, 64 * len(PARITY)), parity(owner[some], h[some], 64 * len(SAMPLE))], axis=1)


def stored(s: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def restored(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def groups_of(docs: DataFrame, *, id_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, tag, n, grp) for each row of docs: hash of the text, size of its set, a name of its component (null for empty sets)."""
    spark = docs.sparkSession
    common.ready(spark)
    scratch, need = common.Scratch(spark), Bounds(num, den)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))
    mask = (1 << SKETCH_BITS) - 1

    def survey(batches):
        """Each document's set; at the end of a task what it adds to the frequency sketch and the sample."""
        names = ["kind", "id", "tag", "n", "sig", *SKETCH, "items"]
        counts, sample, done = np.zeros(mask + 1, dtype=np.int64), {}, set()
        for b in batches:
            h, edges, sigs, words = sets_of(b["text"].to_pylist(), k)
            counts += np.bincount((h >> np.uint64(16)).astype(np.int64) & mask, minlength=mask + 1)
            for x in h[(h >> np.uint64(50)) == 0].tolist():
                sample[x] = sample.get(x, 0) + 1
            items = []
            for sig, a, z in zip(sigs.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                items.append(None if sig in done or a == z else stored(h[a:z]))
                done.add(sig)
            if len(done) > 500_000:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sigs), dtype=np.int32)), b["id"], b["tag"], pa.array(edges[1:] - edges[:-1]), pa.array(sigs), *(pa.array(words[:, i]) for i in range(len(SKETCH))), pa.array(items, pa.binary())], names=names)
        at = np.flatnonzero(counts)
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 1, dtype=np.int32)), pa.array(at), none(len(at)), pa.array(counts[at]), *[none(len(at))] * (1 + len(SKETCH)), pa.nulls(len(at), pa.binary())], names=names)
        own = np.fromiter(sample, dtype=np.uint64, count=len(sample))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), 2, dtype=np.int32)), pa.array(own.view(np.int64)), none(len(own)), pa.array(np.fromiter(sample.values(), dtype=np.int64, count=len(own))), *[none(len(own))] * (1 + len(SKETCH)), pa.nulls(len(own), pa.binary())], names=names)

    seen = scratch.put(texts.mapInArrow(survey, "kind int, id long, tag long, n long, sig long, " + ", ".join(f"{p} long" for p in SKETCH) + ", items binary"), "survey")
    sketch = np.zeros(mask + 1, dtype=np.int64)
    got = seen.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    sketch[got["id"].to_numpy()] = got["n"].to_numpy()
    total, distinct = seen.where("kind = 2").groupBy("id").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.count("n")).first()
    boundary = need.boundary(total / distinct if distinct else 1.0)
    own = spark.sparkContext.broadcast(np.minimum(sketch, (1 << 31) - 1).astype(np.int32))
    del sketch, got

    def keys(batches):
        for b in batches:
            out = [(np.zeros(0, dtype=np.uint64), 0, 0, False, 0)]  # keys, set, side of the key's two sizes, sure, size of the set; places are 0, 1, ...
            for sig, n, data in zip(b["sig"].to_pylist(), b["n"].to_pylist(), b["items"].to_pylist(), strict=True):
                s = restored(data)
                if n <= boundary:
                    h = common.mix(s)
                    for m, leave in need.subsets(n, boundary):
                        name = np.uint64(min(n, m) * 100_003 + max(n, m))
                        rest = np.array([h.sum(dtype=np.uint64) - h[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), leave)], dtype=np.uint64)
                        out.append((common.mix(rest + common.mix(np.array([name]))), sig, (n > m) - (n < m), True, n))
                if n > boundary or need.most(n) > boundary:
                    rank = own.value[(s >> np.uint64(16)).astype(np.int64) & mask]
                    out.append((s[np.lexsort((s, rank))[: need.prefix(n)]], sig, 0, False, n))
            size = [len(x[0]) for x in out]
            cols = [pa.array(common.signed(np.concatenate([x[0] for x in out])))]
            cols += [pa.array(np.repeat(np.array([x[i] for x in out], dtype=t), size)) for i, t in ((1, np.int64), (2, np.int8), (3, bool))]
            cols.append(pa.array(np.repeat(np.array([x[4] for x in out], dtype=np.int32), size)))
            cols.append(pa.array(np.concatenate([np.arange(x, dtype=np.int32) if not o[3] else np.zeros(x, dtype=np.int32) for x, o in zip(size, out, strict=True)])))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "sig", "side", "sure", "n", "at"])

    whole = seen.where("kind = 0 and items is not null").select("sig", "n", "items")
    posted = scratch.put(whole.mapInArrow(keys, "key long, sig long, side byte, sure boolean, n int, at int"), "lists")
    # a key of two sizes links only across them: two sets of one size may share too little for each other
    ends = [f("sig").alias(s) for f, s in ((F.min, "lo"), (F.max, "hi"))] + [f("side").alias(s) for f, s in ((F.min, "less"), (F.max, "more"))]
    shared_keys = scratch.put(posted.groupBy("key", "sure").agg(*ends).where("lo <> hi and (less = 0 or less <> more)").select("key", "sure"), "keys")
    key_bits = spark.sparkContext.broadcast(common.bitmap(shared_keys, "key", BITMAP_BITS))

    def in_keys(batches):
        for b in batches:
            yield b.filter(pa.array(common.in_bitmap(key_bits.value, b["key"].to_numpy())))

    perhaps = posted.mapInArrow(in_keys, "key long, sig long, side byte, sure boolean, n int, at int")
    lists = scratch.put(perhaps.join(shared_keys, ["key", "sure"], "left_semi").distinct(), "shared")
    scratch.drop(posted, shared_keys)
    meta = scratch.put(seen.where("kind = 0 and n > 0").groupBy("sig").agg(F.first("n").alias("n"), *(F.first(p).alias(p) for p in SKETCH)).join(lists.select("sig").distinct(), "sig", "left_semi"), "meta")
    def overlap(batches):
        for b in batches:
            ok = []
            for x, y, n, m in zip(b["x"].to_pylist(), b["y"].to_pylist(), b["an"].to_pylist(), b["bn"].to_pylist(), strict=True):
                both = len(np.intersect1d(restored(x), restored(y), assume_unique=True))
                ok.append(den * both >= num * (n + m - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that hold with whole sets, which are fetched for the sets in pairs alone."""
        pairs = scratch.put(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
        bits = spark.sparkContext.broadcast(common.bitmap(ids, "sig", BITMAP_BITS))

        def wanted(batches):
            for b in batches:
                yield b.filter(pa.array(common.in_bitmap(bits.value, b["sig"].to_numpy())))

        sets = scratch.put(whole.mapInArrow(wanted, "sig long, n long, items binary").dropDuplicates(["sig"]), "sets")
        with_x = pairs.join(sets.select(F.col("sig").alias("a"), F.col("n").alias("an"), F.col("items").alias("x")), "a")
        with_y = with_x.join(sets.select(F.col("sig").alias("b"), F.col("n").alias("bn"), F.col("items").alias("y")), "b")
        out = scratch.put(with_y.select("a", "b", "an", "bn", "x", "y").mapInArrow(overlap, "a long, b long"), "links")
        scratch.drop(sets)
        return out

    def near(a: str, b: str):
        """Bounds that linked pairs keep: sizes, and differing bits of both sketches."""
        apart, some = (" + ".join(f"bit_count({a}{p} ^ {b}{p})" for p in words) for words in (PARITY, SAMPLE))
        most = f"(({a}n + {b}n) * {(den - num) / (num + den) / SAMPLED!r}D)"
        return f"{a}n * {num} <= {b}n * {den} and {b}n * {num} <= {a}n * {den} and ({apart}) * {num + den} <= ({a}n + {b}n) * {den - num} and {some} <= {most} + 6 * sqrt({most}) + 6"

    sides = [meta.select(F.col("sig").alias(s), *(F.col(c).alias(f"{s}{c}") for c in ["n", *SKETCH])) for s in "ab"]
    sure = lists.where("sure")
    heads = sure.groupBy("key", (-F.col("side")).alias("side")).agg(F.min("sig").alias("a"))
    links = sure.join(heads, ["key", "side"]).where("sig <> a").select("a", F.col("sig").alias("b")).distinct()
    scan = lists.where("not sure").select("key", "sig", "n", "at")
    # sets close to the midst of a group of near copies have few n-grams of their own, and so more and longer lists
    lengths = scan.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    central = scan.join(lengths, "key").groupBy("sig").agg(F.sum(F.log2("length")).alias("weight"))
    groups, part = common.components(scratch, links), scratch.put(scan.join(central, "sig"), "scan")
    for turn in range(TURNS):
        # each set with the pivot that most of its lists have for sets of about its size, among those not yet in its component
        sized = part.withColumn("class", F.floor(F.log("n") / -math.log(need.num / need.den) + turn / TURNS))
        order = F.struct("weight", "sig") if turn == 0 else F.xxhash64("sig", F.lit(turn))
        pivots = sized.groupBy("key", "class").agg(F.max_by("sig", order).alias("a"))
        pairs = sized.join(pivots, ["key", "class"]).where("a <> sig").groupBy("a", F.col("sig").alias("b")).count()
        at = [groups.select(F.col("id").alias(s), F.col("component").alias(f"{s}_in")) for s in "ab"]
        pairs = pairs.join(at[0], "a", "left").join(at[1], "b", "left").where("coalesce(a_in, a) <> coalesce(b_in, b)").select("a", "b", "count")
        pairs = scratch.put(pairs.join(sides[0], "a").join(sides[1], "b").where(near("a", "b")).select("a", "b", "count"), "near")
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a"))
        new = verified(best.select("a", "b"))
        links = scratch.put(links.unionByName(new), "links")
        groups = common.components(scratch, links)
        if turn == 0:
            related = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
            part = scratch.put(part.join(related, "sig", "left_semi"), "related")
        elif new.count() < WORTH * best.count():
            break
    at = groups.select(F.col("id").alias("sig"), "component")
    placed = scan.join(at, "sig", "left").select("key", "sig", "at", F.coalesce("component", "sig").alias("grp"))
    mixed = placed.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("key")
    placed = scratch.put(placed.join(mixed, "key", "left_semi").join(meta, "sig"), "placed")
    left, right = ([F.col("key"), *(F.col(c).alias(f"{s}{c}") for c in ["sig", "at", "grp", "n", *SKETCH])] for s in "ab")
    # the first n-gram that two linked sets share leaves enough behind it in both
    ahead = " and ".join(f"({s}n - {s}at) * {num + den} >= (an + bn) * {num}" for s in "ab")
    pairs = placed.select(*left).join(placed.select(*right), "key").where("agrp < bgrp").where(f"{ahead} and {near('a', 'b')}")
    pairs = scratch.put(pairs.select(F.col("asig").alias("a"), F.col("bsig").alias("b")).distinct(), "pairs")
    scratch.drop(placed)
    if not pairs.isEmpty():
        groups = common.components(scratch, links.unionByName(verified(pairs)))

    named = groups.select(F.col("id").alias("sig"), "component")
    rows = seen.where("kind = 0").select("id", "tag", "n", "sig").join(named, "sig", "left")
    return rows.select("id", "tag", "n", F.when(F.col("n") > 0, F.coalesce("component", "sig")).alias("grp"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id for each row of docs; sets link from Jaccard num/den on."""
    rows = groups_of(docs, id_col=id_col, k=k, num=num, den=den)
    lowest = rows.where("grp is not null").groupBy("grp").agg(F.min("id").alias("lowest"))
    out = rows.where("grp is not null").join(lowest, "grp").select("id", "n", "lowest")
    out = out.unionByName(rows.where("grp is null").select("id", "n", F.col("id").alias("lowest")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("lowest").alias("component_id"))


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs but for those that have an earlier row in their component.

    Earlier is the smaller id (null last), then the smaller hash of the text. Of rows with the same id and text
    one stays; rows without an n-gram all stay.
    """
    scratch = common.Scratch(docs.sparkSession)
    rows = scratch.put(groups_of(docs, id_col=id_col, k=k, num=num, den=den).where("grp is not null"), "groups")
    at = F.struct(F.col("id").isNull().alias("last"), "id", "tag")
    first = rows.groupBy("grp").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = rows.join(first, "grp").where(F.struct(F.col("id").isNull().alias("last"), "id", "tag") != F.col("first"))
    later = later.select(F.col("id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    twins = rows.groupBy("id", "tag").count().where("count > 1").select(F.col("id").alias("__id"), F.col("tag").alias("__tag"))
    own = docs.withColumns({"__id": F.col(id_col).cast("long"), "__tag": F.xxhash64("text")})
    same = lambda x: (own["__id"].eqNullSafe(x["__id"])) & (own["__tag"] == x["__tag"])
    kept = own.join(later, same(later), "left_anti")
    single = kept.join(twins, kept["__id"].eqNullSafe(twins["__id"]) & (kept["__tag"] == twins["__tag"]), "left_anti")
    double = kept.join(twins, kept["__id"].eqNullSafe(twins["__id"]) & (kept["__tag"] == twins["__tag"]), "left_semi").dropDuplicates(["__id", "__tag"])
    return single.unionByName(double).drop("__id", "__tag")
