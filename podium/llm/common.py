"""Shared pieces of the corpus operators: scratch tables, word hashing, bitmaps, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python agree on this pattern; it is also what bytes.split() splits on.
WORD_GAP = r"[\x20\x09-\x0D]+"
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Let Python workers find this package, and keep Arrow batches of long texts small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def release(spark: SparkSession) -> None:
    """Let the driver notice which shuffles nobody needs any more, so that their files go."""
    spark._jvm.System.gc()


class Scratch:
    """Parquet tables in the shared checkpoint folder, which cut lineage and survive lost executors.

    ``drop()`` deletes what later steps no longer read. Without a shared folder a cluster is refused; a
    local session gets a temporary one.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = os.path.join(os.environ.get("TMPDIR", "/tmp"), "podium-checkpoints")
        self.spark, self.base = spark, f"{base.rstrip('/')}/podium-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        to = self.path(name)
        df.write.option("compression", "zstd").parquet(to)
        release(self.spark)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._podium_path = to
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(df._podium_path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 50_000  # some 6 MB in each worker

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def word_hashes(words: Iterable[bytes], count: int = -1) -> np.ndarray:
    """Hashed anew each time: that takes less than half the time of a memory in which rare words crowd out frequent ones."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=count)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of k words; of the whole sequence if it is shorter."""
    n = max(1, len(h) - k + 1) if len(h) else 0
    out, width = np.zeros(n, dtype=np.uint64), min(k, len(h))
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] + np.uint64(i + 1))
    return mix(out + np.uint64(width))


class Words:
    """Words of a batch of texts, hashed together: one array for all, with each word's text."""

    def __init__(self, texts: list[bytes | None]):
        self.words = [t.split() if t else [] for t in texts]
        self.sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(texts))
        self.hashes = word_hashes(chain.from_iterable(self.words), int(self.sizes.sum()))
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: words from each word to the end of its text
        self.left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(self.hashes))

    def grams(self, k: int) -> np.ndarray:
        """At each word the hash of the k words from there on; only meaningful where left >= k."""
        out = np.zeros(max(0, len(self.hashes) - k + 1), dtype=np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[i : i + len(out)] + np.uint64(i + 1))
        return mix(out + np.uint64(k))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(owner, hash) of every run of k words, and of the whole of shorter texts."""
        at = np.flatnonzero(self.left >= k)
        short = np.flatnonzero((self.sizes > 0) & (self.sizes < k))
        rest = [ngram_hashes(self.hashes[self.starts[i] : self.starts[i] + self.sizes[i]], k) for i in short]
        return np.concatenate([self.owner[at], short]), np.concatenate([self.grams(k)[at], *rest])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# -- fixed-size bitmaps -------------------------------------------------------------------------


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with a bit for each value of a long column.

    It has the same size for any input (2**bits / 8 bytes), so that it may be broadcast. It answers
    "perhaps" for values that are not there; users of it must only save work by it.
    """
    slot = F.expr(f"xxhash64(`{column}`) & {(1 << bits) - 1}L")
    words = (
        df.select(slot.alias("s"))
        .groupBy(F.expr("shiftright(s, 6)").cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a long column."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of the hash
    rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    x = x.view(np.uint64) if x.dtype != np.uint64 else x
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + p5 + np.uint64(8)
        h = h ^ (rot(x * p2, 31) * p1)
        h = rot(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = xxhash64_long(values) & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


# -- connected components -----------------------------------------------------------------------


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Edges (a, b), longs -> (id, component): the smallest id reachable, for every id in an edge.

    Union-find by contraction, all of it joins and aggregates: each node hangs itself on its smallest
    smaller neighbour, the trees are flattened by pointer doubling, and edges between different trees
    go on to the next round. A hub's edges are plain join rows, so that skewed joins can be split.
    """
    spark = scratch.spark
    left = scratch.put(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    rounds = []
    while not left.isEmpty():
        tree = scratch.put(left.groupBy("b").agg(F.min("a").alias("p")), "tree")
        while True:
            up = tree.select(F.col("b").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.put(tree.join(up, "p", "left").select("b", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "tree")
            moved = not jumped.where("moved").isEmpty()
            scratch.drop(tree)
            tree = jumped
            if not moved:
                break
        flat = tree.select("b", "p")
        rounds.append(flat)
        ra, rb = flat.select(F.col("b").alias("a"), F.col("p").alias("pa")), flat.select("b", F.col("p").alias("pb"))
        new = left.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        new = scratch.put(new.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        scratch.drop(left)
        left = new
    if not rounds:
        return spark.range(0).select("id", F.col("id").alias("component"))  # rows from Python would start workers of their own
    out = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("b").alias("p"), F.col("p").alias("pp"))
        out = out.join(up, "p", "left").select("b", F.coalesce("pp", "p").alias("p")).unionByName(later)
    out = out.select(F.col("b").alias("id"), F.col("p").alias("component"))
    return scratch.put(out.unionByName(out.select(F.col("component").alias("id"), "component").distinct()), "components")
