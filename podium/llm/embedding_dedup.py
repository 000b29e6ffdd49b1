"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking.

A rotation learned on a bounded sample makes binary codes whose bits are balanced and keep angles; vectors
of fewer than 64 dimensions are turned further, until there are 64 bits. The code is cut into four substrings of 16 bits, one table each; a vector enters a table under its
substring and those one bit away, so that two vectors whose substrings differ in at most two bits meet.
Pairs within the Hamming radius are compared by cosine in double precision on the original vectors.

Equal vectors are one node with a weight. A pair that meets under several keys counts under one of
them, worked out from the two codes. Buckets hold codes only; vectors are sent to those buckets alone
in which their codes have company. Buckets over ``BUCKET`` members are cut into blocks, and pairs of
blocks are compared by different tasks. Tasks return link counts and spanning edges, never pairs.

Vectors are compared with those of their own length, one length after the other, each with a rotation of
its own. A length of at most ``BUCKET`` different vectors is one bucket, compared in full.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing,
nor do vectors of different lengths; every row gives a row, equal vectors included, repeated ids too; a
null id keeps a null component unless linked to an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKET = 1024
SUB = 16
CODE = 64


def learn_rotation(sample: np.ndarray, bits: int, *, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions, rotated so that signs lose least."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, directions = np.linalg.eigh(x.T @ x)
    p = directions[:, ::-1][:, :bits]
    v = x @ p
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return mean, p @ r


def turns(sample: np.ndarray, *, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) to CODE bits: the learned rotation, and for fewer dimensions further turns of it until the bits are full.

    Learning would bring every further turn to the same place, so those are random; each is balanced by the mean as the first is.
    """
    mean, first = learn_rotation(sample, min(CODE, sample.shape[1]), seed=seed)
    rng, parts = np.random.default_rng(seed + 1), [first]
    while sum(p.shape[1] for p in parts) < CODE:
        parts.append(first @ np.linalg.qr(rng.normal(size=(first.shape[1],) * 2))[0])
    out = np.concatenate(parts, axis=1)[:, :CODE]
    if sample.shape[1] < 3:  # in a plane bits fall together; half of each substring stays empty, so that more pairs meet
        out[:, np.arange(CODE) % SUB >= SUB // 2] = 0
    return mean, out


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(x), CODE), dtype=np.uint8)
    bits[:, : projection.shape[1]] = (x - mean) @ projection > 0
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dims)


def canonical(a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """For codes a (column) and b (row): the one key under which the pair counts, or -1."""
    out = np.full(np.broadcast(a, b).shape, -1, dtype=np.int64)
    x = a ^ b
    for t in range(tables - 1, -1, -1):
        shift = np.uint64(SUB * t)
        d = ((x >> shift) & np.uint64(0xFFFF)).astype(np.int64)
        s = ((a >> shift) & np.uint64(0xFFFF)).astype(np.int64)
        far = np.bitwise_count(d)
        low = d & -d
        key = np.minimum(s ^ low, s ^ d ^ low)  # between them; at distance 1 or 0, one of the two
        np.copyto(out, key | t << SUB, where=far <= 2)
    return out


def probes(codes: np.ndarray, tables: int) -> np.ndarray:
    flips = np.concatenate([[0], 1 << np.arange(SUB)])
    subs = (codes[:, None] >> (np.arange(tables, dtype=np.uint64) * np.uint64(SUB))) & np.uint64(0xFFFF)
    return ((subs.astype(np.int64)[:, :, None] ^ flips) | (np.arange(tables)[None, :, None] << SUB)).reshape(len(codes), -1)


def meeting(key: int, i: np.ndarray, j: np.ndarray, codes: np.ndarray, blocks: np.ndarray, pair: int, radius: int, tables: int):
    """Positions in i and j whose pairs count here: other block against own, or a block against itself once."""
    near = np.bitwise_count(codes[i][:, None] ^ codes[j][None, :]) <= radius
    rows, cols = np.nonzero(near)
    rows, cols = i[rows], j[cols]
    ok = (blocks[rows] < blocks[cols]) | (blocks[rows] == blocks[cols]) & (rows < cols)
    rows, cols = rows[ok], cols[ok]
    here = canonical(codes[rows], codes[cols], tables) == key
    return rows[here], cols[here]


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", column: str = "embedding", threshold: float = 0.9, sample: int = 20_000, radius: int = 20) -> DataFrame:
    """id, n_links, component_id, kept for each row of vectors."""
    spark = vectors.sparkSession
    common.ready(spark)
    scratch = common.Scratch(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    named = scratch.put(own.withColumn("v", F.when(good, F.col("v"))).select("id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("node"), "v"), "vectors")
    lengths = [r["n"] for r in named.where("node is not null").select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    out = named.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for dims in lengths:
        out = out.unionByName(of_length(scratch, named.where(F.size("v") == dims), dims, threshold, sample, radius))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def of_length(scratch: common.Scratch, valid: DataFrame, dims: int, threshold: float, sample: int, radius: int) -> DataFrame:
    """id, n_links, component_id for rows (id, node, v) whose vectors have ``dims`` components."""

    def packed(batches):
        for b in batches:
            raw = [np.array(x, dtype=np.float64) for x in b["v"].to_pylist()]
            unit = [(x / np.abs(x).max()) for x in raw]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([(x / np.linalg.norm(x)).tobytes() for x in unit], pa.binary())], names=["node", "unit"])

    single = valid.groupBy("node").agg(F.count("id").alias("w"), F.min("id").alias("lowest"), F.count(F.lit(1)).alias("rows"))
    single = scratch.put(single.withColumn("w", F.col("rows")), "nodes")
    units = scratch.put(valid.groupBy("node").agg(F.first("v").alias("v")).mapInArrow(packed, "node long, unit binary"), "units")
    picked = units.orderBy(F.xxhash64("node"), "node").limit(max(sample, BUCKET + 1)).toArrow()["unit"].combine_chunks()
    if len(picked) > BUCKET:
        mean, projection = turns(matrix(picked, dims))
    else:
        mean, projection = np.zeros(dims), np.zeros((dims, 1))  # one code for all
    tables = -(-projection.shape[1] // SUB)

    def keyed(batches):
        for b in batches:
            codes = encode(matrix(b["unit"], dims), mean, projection)
            keys = probes(codes, tables)
            each = lambda x: pa.array(np.repeat(x, keys.shape[1]))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), each(b["node"].to_numpy()), each(codes.view(np.int64))], names=["key", "node", "code"])

    entries = scratch.put(units.mapInArrow(keyed, "key int, node long, code long"), "entries")
    # at most tables * 65,536 keys, so that their block counts can be broadcast
    sizes = entries.groupBy("key").count().where("count > 1").withColumn("n", F.ceil(F.col("count") / BUCKET).cast("int")).drop("count")
    blocked = entries.join(F.broadcast(sizes), "key").withColumn("block", F.expr("cast(pmod(xxhash64(node), n) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    dealt = blocked.select("key", "node", "code", "block", other.alias("o")).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "node", "code", "block")

    def groups_of(batches, cols):
        """Rows of sorted batches, by (key, i, j)."""
        held = None
        for b in batches:
            at = np.stack([b[c].to_numpy() for c in ("key", "i", "j")], axis=1)
            edges = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1 if len(at) else np.zeros(0, dtype=int)
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                if z == a:
                    continue
                name, part = tuple(at[a].tolist()), b.slice(a, z - a).select(cols)
                if held and held[0] == name:
                    held[1].append(part)
                else:
                    if held:
                        yield held[0], pa.Table.from_batches(held[1])
                    held = (name, [part])
        if held:
            yield held[0], pa.Table.from_batches(held[1])

    def met(name, t):
        codes, blocks = t["code"].to_numpy().view(np.uint64), t["block"].to_numpy()
        i, j = np.flatnonzero(blocks == name[1]), np.flatnonzero(blocks == name[2])
        return meeting(name[0], i, j, codes, blocks, 0, radius, tables)

    def company(batches):
        for name, t in groups_of(batches, ["node", "code", "block"]):
            rows, cols = met(name, t)
            live = np.unique(np.concatenate([rows, cols]))
            if len(live):
                k = pa.array(live)
                fill = lambda x: pa.array(np.full(len(live), x, dtype=np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([fill(name[0]), fill(name[1]), fill(name[2]), *(t[c].combine_chunks().take(k) for c in ("node", "code", "block"))], names=["key", "i", "j", "node", "code", "block"])

    kinds = "key int, i int, j int, node long, code long, block int"
    alive = scratch.put(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(company, kinds), "alive")

    def rerank(batches):
        for name, t in groups_of(batches, ["node", "code", "block", "w", "unit"]):
            rows, cols = met(name, t)
            x, w, nodes = matrix(t["unit"], dims), t["w"].to_numpy(), t["node"].to_numpy()
            cos = np.concatenate([np.zeros(0), *((x[rows[a : a + 65536]] * x[cols[a : a + 65536]]).sum(axis=1) for a in range(0, len(rows), 65536))])
            rows, cols = rows[cos >= threshold], cols[cos >= threshold]
            if not len(rows):
                continue
            links = np.bincount(rows, w[cols], len(nodes)) + np.bincount(cols, w[rows], len(nodes))
            label = np.arange(len(nodes))
            while True:  # labels spread to their least
                new = label.copy()
                np.minimum.at(new, rows, label[cols])
                np.minimum.at(new, cols, label[rows])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            live = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[live]), pa.array(links[live].astype(np.int64)), pa.array(nodes[label[live]])], names=["node", "links", "peer"])

    full = alive.join(units, "node").join(single.select("node", "w"), "node")
    found = scratch.put(full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "node", "code", "block", "w", "unit").mapInArrow(rerank, "node long, links long, peer long"), "links")
    groups = common.components(scratch, found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = single.join(groups.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("lowest").alias("component_id"))
    nodes = placed.join(lowest, "component").join(links, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    return valid.select("id", "node").join(nodes, "node").select("id", "n_links", "component_id")
