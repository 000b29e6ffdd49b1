"""LM scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised to 1 + floor(log2(count)); the filter holds, for each of
them, one key per level up to its own. A count is read back by probing levels until one is missing. The
filter is sized from the counted keys and broadcast; it is split into blocks of 8 KB by the n-gram's
hash, each of which one task fills from its own n-grams. Scores are Dirichlet-smoothed word-pair
probabilities over add-one word probabilities, all from the filter.

Beyond the bound on what is broadcast (``most``) the filter holds the frequent levels, which answer
nearly every probe, and the rest stays a table: tokens whose word or pair the filter doesn't hold meet
their levels there in joins. So nothing counted is ever left out, whatever the size. The base score needs
exact counts: words among the most frequent are looked up by 64-bit hash in a bounded table, all others
are counted by document and meet their counts in a join.

Defined results: null texts are empty, which is the end token alone; words are compared as bytes with
A-Z lower-cased; a null id is trained on by no fold and not held out; repeated rows count repeatedly;
with nothing to learn from, N and V are 0 and every base score is 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .language_id import bucket_of

END, START = b"\n", b"\n\n"  # no word has such bytes
HEAVY = 150_000  # words in the broadcast table of exact counts
BLOCK = 16  # log2 of a block's bits
STEP = 0x9E3779B97F4A7C15
LEVEL = np.uint64(63)  # the bits of a hash in whose place its level travels
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


class Filter:
    """2**bits bits in blocks; levels of hashed n-grams by repeated probes."""

    def __init__(self, blocks: np.ndarray):
        self.bytes, self.shift = blocks, np.uint64(64 - ((len(blocks) * 8 >> BLOCK).bit_length() - 1))

    @staticmethod
    def slots(h: np.ndarray, level: int) -> list[np.ndarray]:
        key = common.mix((h | LEVEL) + np.uint64(STEP * level & common.M64))
        return [(key >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in range(4)]

    def levels(self, h: np.ndarray) -> np.ndarray:
        out, live, level = np.zeros(len(h), dtype=np.int64), np.arange(len(h)), 1
        while len(live):
            x = h[live]
            base, slots = (x >> self.shift) << np.uint64(BLOCK), self.slots(x, level)
            ok = np.arange(len(live))
            for s in slots:
                at = base[ok] + s[ok]
                bit = self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
                ok = ok[bit & 1 != 0]
            live = live[ok]
            out[live] = level
            level += 1
        return out


def typical(levels: np.ndarray) -> np.ndarray:
    """A count for a level: the geometric mean of its bounds; 0 for none."""
    low = np.exp2(levels - 1.0)
    return np.where(levels > 0, np.sqrt(low * (2 * low - 1)), 0.0)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def pairs_of(h: np.ndarray) -> np.ndarray:
    """Hashes of (previous, word) for hashed words that begin with START."""
    return common.mix(h[:-1] * PAIR + h[1:])


def count_words(texts: DataFrame) -> DataFrame:
    def of(batches):
        found: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])
            found.clear()
            return got

        for b in batches:
            for text in b["text"].to_pylist():
                found.update(words_of(text))
                found[END] += 1
                if len(found) > 500_000:
                    yield out()
        yield out()

    return texts.mapInArrow(of, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_pairs(texts: DataFrame) -> DataFrame:
    def of(batches):
        held, size = [], 0
        for b in batches:
            for text in b["text"].to_pylist():
                held.append(pairs_of(common.word_hashes([START, *words_of(text), END])))
                size += len(held[-1])
                if size > 1_500_000:
                    yield packed(held)
                    held, size = [], 0
        yield packed(held)

    def packed(held):
        h, c = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(common.signed(h)), pa.array(c.astype(np.int32))], names=["h", "c"])

    return texts.mapInArrow(of, "h long, c int").groupBy("h").agg(F.sum("c").alias("c"))


def build_filter(words: DataFrame, pairs: DataFrame, *, most: int, bits_per_key: int) -> tuple[np.ndarray, DataFrame | None, dict[int, int]]:
    """words, pairs: (h, c) -> the filter's bytes; the n-grams beyond 2**most bits as (n, h, level), or None;
    and the least level that is held of words (1) and of pairs (2)."""
    level = (F.floor(F.log2("c")) + 1).cast("int").alias("level")
    grams = words.select("h", level, F.lit(1).alias("n")).unionByName(pairs.select("h", level, F.lit(2).alias("n")))
    sizes = {(r["n"], r["level"]): r["count"] for r in grams.groupBy("n", "level").count().collect()}
    least = {1: 1, 2: 1}

    def need() -> int:
        return bits_per_key * sum(c * level for (n, level), c in sizes.items() if level >= least[n])

    while need() > 1 << most:
        least[2 if least[2] <= least[1] + 4 else 1] += 1
    bits = max(BLOCK + 4, need().bit_length())
    blocks = bits - BLOCK

    def fill(batch: pa.Table) -> pa.Table:
        h = batch["h"].to_numpy().view(np.uint64)
        levels = h & LEVEL
        own = np.zeros(1 << BLOCK, dtype=np.uint8)
        for level in range(1, int(levels.max()) + 1):
            for s in Filter.slots(h[levels >= level], level):
                own[s.astype(np.int64)] = 1
        return pa.table({"block": batch["block"][:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    held = (F.col("n") == 1) & (F.col("level") >= least[1]) | (F.col("n") == 2) & (F.col("level") >= least[2])
    own = F.col("h").bitwiseAND(F.lit(~63)).bitwiseOR(F.col("level").cast("long")).alias("h")
    got = grams.where(held).select(own, F.shiftrightunsigned("h", 64 - blocks).cast("int").alias("block")).groupBy("block").applyInArrow(fill, "block int, bits binary").toArrow()
    size = 1 << (BLOCK - 3)
    out = np.zeros((1 << blocks, size), dtype=np.uint8)
    common.release(words.sparkSession)
    for batch in got.to_batches():
        out[batch["block"].to_numpy()] = np.frombuffer(b"".join(batch["bits"].to_pylist()), dtype=np.uint8).reshape(-1, size)
    return out.ravel(), grams.where(~held) if max(least.values()) > 1 else None, least


def score(docs: DataFrame, *, id_col: str = "doc_id", folds: int = 7, held: int = 2, most: int = 30, bits_per_key: int = 10, weight: float = 1000.0) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learns from rows whose crc32(id as text) mod folds is not ``held``. most: log2 of the greatest
    filter to broadcast, in bits; weight: tokens that the word distribution counts for in a pair's probability.
    """
    spark = docs.sparkSession
    common.ready(spark)
    scratch = common.Scratch(spark)
    fold = bucket_of(id_col, folds)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    training = docs.where(fold != held).select(F.col("text").cast("binary").alias("text"))
    vocab = scratch.put(count_words(training), "words")
    total, size, docs_seen = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))).first()

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(common.word_hashes(b["word"].to_pylist()))), b["c"]], names=["h", "c"])

    pairs = scratch.put(count_pairs(training), "pairs")
    common.release(spark)
    starts = spark.createDataFrame([(int(common.signed(common.word_hashes([START]))[0]), docs_seen)], "h long, c long").where("c > 0")
    singles = vocab.mapInArrow(hashed, "h long, c long").unionByName(starts)
    known, rest, least = build_filter(singles, pairs, most=most, bits_per_key=bits_per_key)
    if rest is None:
        scratch.drop(pairs)
    filled = spark.sparkContext.broadcast(known)
    top = vocab.orderBy(F.desc("c"), "word").limit(HEAVY).toArrow()
    keys = common.word_hashes(top["word"].to_pylist())
    order = np.argsort(keys)
    heavy = spark.sparkContext.broadcast((keys[order], top["c"].to_numpy()[order]))
    all_heavy, log_all = size <= HEAVY, float(np.log10(total + size + 1))
    floor = total + size + 1

    def exact(words: np.ndarray) -> np.ndarray:
        keys, counts = heavy.value
        if not len(keys):
            return np.zeros(len(words), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        return np.where(keys[at] == words, counts[at], 0)

    def look(batches):
        probe = Filter(filled.value)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            tokens = [[*words_of(t), END] for t in b["text"].to_pylist()]
            n = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
            at = 0
            while at < len(tokens):  # some 300,000 words at a time
                stop = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 300_000, "right")) + at)
                yield from measured(probe, tokens[at:stop], n[at:stop], row + np.arange(at, stop), b["id"][at:stop], b["held_out"][at:stop])
                at = stop
            row += len(tokens)

    def measured(probe: Filter, tokens, n, rows, ids, held_out):
        every = common.word_hashes([w for t in tokens for w in (START, *t)])
        words, back = np.unique(every, return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)
        first = np.zeros(len(every), dtype=bool)
        first[np.cumsum(n + 1) - n - 1] = True
        at = np.flatnonzero(~first)
        here, before = back[at], back[at - 1]
        counted = exact(words)
        base = np.bincount(owner, np.log10(counted + 1)[here], len(n))
        hits = np.bincount(owner, (counted > 0)[here], len(n)).astype(np.int64)
        c1 = typical(probe.levels(words))
        both = common.mix(every[at - 1] * PAIR + every[at])
        # a pair can't be known if one of its words isn't, unless words are left to the table
        maybe = (c1[here] > 0) & (c1[before] > 0) | (least[1] > 1)
        c2 = np.zeros(len(both))
        pairs, of = np.unique(both[maybe], return_inverse=True)
        c2[maybe] = typical(probe.levels(pairs))[of]
        p = (np.minimum(c2, c1[before]) + weight * (c1[here] + 1) / floor) / (c1[before] + weight)
        open_ = np.zeros(len(both), dtype=bool)
        if least[2] > 1:
            open_ |= (c2 == 0) & maybe
        if least[1] > 1:
            open_ |= (c1[here] == 0) | (c1[before] == 0)
        yield batch(row=rows, id=ids, held_out=held_out, n_tokens=n, n_known=hits, base=base, score=np.bincount(owner, np.where(open_, 0.0, np.log10(p)), len(n)))
        if open_.any():
            o = np.flatnonzero(open_)
            own = common.mix(rows[owner[o]].astype(np.uint64) << np.uint64(20) ^ o.astype(np.uint64)).view(np.int64)
            # what the filter knows carries a number of its own, so that no frequent word's rows meet
            key = lambda h, c: np.where(c > 0, own, common.signed(h))
            yield batch(row=rows[owner[o]], here=key(every[at[o]], c1[here[o]]), before=key(every[at[o] - 1], c1[before[o]]), pair=key(both[o], c2[o]), c_here=c1[here[o]], c_before=c1[before[o]], c_pair=c2[o])
        if not all_heavy and (lost := np.flatnonzero(counted[here] == 0)).size:
            _, where, k = np.unique(owner[lost] * len(words) + here[lost], return_index=True, return_counts=True)
            flat = [w for t in tokens for w in t]
            yield batch(row=rows[owner[lost[where]]], n_tokens=k.astype(np.int64), word=[flat[i] for i in lost[where].tolist()])

    kinds = {"row": pa.int64(), "id": None, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "word": pa.binary()}
    kinds |= {c: pa.int64() for c in ("here", "before", "pair")} | {c: pa.float64() for c in ("c_here", "c_before", "c_pair")}
    kinds["id"] = to_arrow_type(texts.schema["id"].dataType)

    def batch(**columns):
        rows = len(columns["row"])
        made = [pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(rows, t)) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays(made, names=list(kinds))

    kind = texts.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, here long, before long, pair long, c_here double, c_before double, c_pair double"
    looked = scratch.put(texts.mapInArrow(look, schema), "looked")
    rare = looked.where("word is not null").select("row", "word", F.col("n_tokens").alias("k")).join(vocab, "word")
    rare = rare.groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("sum"))
    out = looked.where("word is null and here is null").join(rare, "row", "left")
    score = F.col("score")
    if rest is not None:
        low = F.pow(F.lit(2.0), F.col("level") - 1)
        rest = rest.select("n", F.col("h"), F.sqrt(low * (2 * low - 1)).alias("got"))
        probes = looked.where("here is not null").select("row", "here", "before", "pair", "c_here", "c_before", "c_pair")
        for name, order_ in (("here", 1), ("before", 1), ("pair", 2)):
            met = rest.where(F.col("n") == order_).select(F.col("h").alias(name), F.col("got").alias(f"t_{name}"))
            probes = probes.join(met, name, "left").withColumn(f"c_{name}", F.coalesce(f"t_{name}", f"c_{name}")).drop(f"t_{name}")
        p = (F.least("c_pair", "c_before") + weight * (F.col("c_here") + 1) / F.lit(float(floor))) / (F.col("c_before") + weight)
        out = out.join(probes.groupBy("row").agg(F.sum(F.log10(p)).alias("late")), "row", "left")
        score = score + F.coalesce("late", F.lit(0.0))
    base = F.col("base") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
