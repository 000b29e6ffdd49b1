"""Centroid clustering in exact integers, with Drake's adaptive bounds.

Each vector keeps its centroid, an upper bound of the distance to it, lower bounds of the distances to its ``near`` next
centroids, and one lower bound for all the rest. When centroids move, bounds move with them; a vector whose upper bound
stays below all lower ones is not measured. Otherwise the own distance is measured, then the listed centroids whose order is open, and if the rest
can't be ruled out either, all of them. Bounds are rounded outwards after each operation, and only a strictly smaller
bound certifies, so that ties and rounding give the same clusters as measuring everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ready

SCALE = 1024
#: integers beyond this would let squared distances leave 64 bits; components are held within it
MOST = 1 << 27
STATE = "own int, upper double, near array<int>, lows array<double>, rest double, used int"


def quantised(vectors: DataFrame, *, key: str, vector: str, dim: int) -> DataFrame:
    """(id, q): vectors of exactly dim finite components as integers floor(1024 * x)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))
    x = vectors.select(F.col(key).alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("x"))
    kept = x.where((F.size("x") == dim) & F.forall("x", finite))
    return kept.select("id", F.transform("x", lambda c: F.floor(held(c)).cast("long")).alias("q"))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the rows of c: (rows, centroids)."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


class Bounds:
    """The state of a batch of vectors as arrays."""

    def __init__(self, own, upper, near, lows, rest):
        self.own, self.upper, self.near, self.lows, self.rest = own, upper, near, lows, rest
        self.used = np.zeros(len(own), dtype=np.int32)

    @classmethod
    def of_all(cls, x: np.ndarray, c: np.ndarray, near: int) -> Bounds:
        """Every centroid measured: the nearest (smallest number first), the next ones, and what bounds the others."""
        d2 = squared(x, c)
        order = np.argsort(d2, axis=1, kind="stable")
        d = np.sqrt(np.take_along_axis(d2, order, axis=1).astype(float))
        rest = down(d[:, near + 1]) if near + 1 < len(c) else np.full(len(x), np.inf)
        return cls(order[:, 0].astype(np.int32), up(d[:, 0]), order[:, 1 : near + 1].astype(np.int32), down(d[:, 1 : near + 1]), rest)

    def narrowed(self, near: int) -> Bounds:
        """Fewer lower bounds; the remainder takes the others in."""
        self.rest = np.minimum(self.rest, self.lows[:, near:].min(axis=1, initial=np.inf))
        self.near, self.lows = self.near[:, :near], self.lows[:, :near]
        return self

    def moved(self, x: np.ndarray, c: np.ndarray, by: np.ndarray) -> Bounds:
        """After each centroid has moved by at most ``by``; x and c as they are now."""
        self.upper, self.lows, self.rest = up(self.upper + by[self.own]), down(self.lows - by[self.near]), down(self.rest - by.max())
        open_ = np.flatnonzero(self.upper >= np.minimum(self.lows.min(axis=1, initial=np.inf), self.rest))
        if len(open_):
            diff = x[open_] - c[self.own[open_]]
            self.upper[open_] = up(np.sqrt((diff * diff).sum(axis=1).astype(float)))
            open_ = open_[self.upper[open_] >= np.minimum(self.lows[open_].min(axis=1, initial=np.inf), self.rest[open_])]
        listed = self.upper[open_] < self.rest[open_]
        self._among_listed(open_[listed], x, c)
        self._among_all(open_[~listed], x, c)
        return self

    def _among_listed(self, rows: np.ndarray, x: np.ndarray, c: np.ndarray) -> None:
        """The rest is farther than the own centroid: the nearest is one of the list or the own one."""
        if not len(rows):
            return
        among = np.concatenate([self.own[rows, None], self.near[rows]], axis=1)
        diff = x[rows][:, None, :] - c[among]
        d2 = (diff * diff).sum(axis=2)
        order = np.lexsort((among, d2), axis=1)
        among, d = np.take_along_axis(among, order, axis=1), np.sqrt(np.take_along_axis(d2, order, axis=1).astype(float))
        # how many of the list, in its stored order, could not be ruled out
        self.used[rows] = (self.lows[rows] <= self.upper[rows, None]).sum(axis=1)
        self.own[rows], self.upper[rows], self.near[rows], self.lows[rows] = among[:, 0], up(d[:, 0]), among[:, 1:], down(d[:, 1:])

    def _among_all(self, rows: np.ndarray, x: np.ndarray, c: np.ndarray) -> None:
        if len(rows):
            near = self.near.shape[1]
            new = Bounds.of_all(x[rows], c, near)
            self.own[rows], self.upper[rows], self.near[rows], self.lows[rows], self.rest[rows] = new.own, new.upper, new.near, new.lows, new.rest
            self.used[rows] = near + 1


def assigned(state: DataFrame, c: np.ndarray, by: np.ndarray | None, near: int) -> DataFrame:
    """Rows (id, q[, bounds]) with their bounds brought to the centroids c; by is None where there are none yet."""
    import pyarrow as pa

    def flat(column: pa.ListArray, kind) -> np.ndarray:
        return np.array(column.flatten(), dtype=kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=kind)

    def rows_of(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        n, width = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = flat(b["q"], np.int64)
            if by is None:
                s = Bounds.of_all(x, c, near)
            else:
                n = b.num_rows
                s = Bounds(np.array(b["own"], dtype=np.int32), np.array(b["upper"], dtype=float), flat(b["near"], np.int32).reshape(n, -1), flat(b["lows"], float).reshape(n, -1), np.array(b["rest"], dtype=float))
                s = s.narrowed(near).moved(x, c, by)
            yield pa.RecordBatch.from_arrays([b["id"], b["q"], pa.array(s.own, pa.int32()), pa.array(s.upper), rows_of(s.near, pa.int32()), rows_of(s.lows, pa.float64()), pa.array(s.rest), pa.array(s.used, pa.int32())], names=["id", "q", "own", "upper", "near", "lows", "rest", "used"])

    kind = state.schema["id"].dataType.simpleString()
    return state.mapInArrow(work, f"id {kind}, q array<bigint>, {STATE}")


def means(state: DataFrame, c: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids as exact floors of the means of their vectors, empty ones as they were; and how many bounds a vector needed.

    One row for each centroid comes to the driver. Sums are 64 bits wide, room for 2**36 vectors of the largest components in one cluster.
    """
    dim = c.shape[1]
    total = [F.sum(F.get("q", F.lit(i))).alias(f"s{i}") for i in range(dim)]
    out, used = c.copy(), 0
    for r in state.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("used"), *total).collect():
        out[r["own"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
        used = max(used, r["used"])
    return out, used


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, key: str = "vec_id", vector: str = "embedding", salt: str = "3:", near: int | None = None) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of exactly dim components, none null or non-finite; the others, nulls and empty ones get no row. Repeated
    rows count each; a null key counts as an empty text. The first centroids are the k vectors of smallest sha256(salt + key), of equal
    ones the smaller vector; of fewer than k vectors, all. Components are held within 2**17, the largest whose distances fit
    64 bits; an inertia beyond 64 bits is null. Without a vector the result is empty. Other columns are not read.

    State lies in a table of the shared folder, which each round rewrites; k rows and k centroids go through the driver. ``near``
    is the number of lower bounds in the first round, by default k / 4 and at least 2; later rounds keep as many as the last one needed, at least k / 8.
    """
    spark = vectors.sparkSession
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    scratch = Scratch(spark)
    state = scratch.put(quantised(vectors, key=key, vector=vector, dim=dim), "vectors")
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    seeds = state.select("q", named.alias("h")).orderBy("h", "q").limit(k).collect()
    c = np.array([r["q"] for r in seeds], dtype=np.int64).reshape(len(seeds), dim)
    near = max(2, len(c) // 4) if near is None else near
    near = max(0, min(near, len(c) - 1))
    by = None
    for done in range(rounds + 1 if len(c) else 0):
        new = scratch.put(assigned(state, c, by, near), "bounds")
        scratch.drop(state)
        state = new
        if done == rounds:
            break
        after, used = means(state, c)
        if (after == c).all():  # later rounds would change nothing
            break
        diff = after - c
        by, c = up(np.sqrt((diff * diff).sum(axis=1).astype(float))), after
        if done:
            near = min(near, max(used, -(-len(c) // 8)))
    if not len(c):
        return state.select(F.col("id").alias(key), *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    # k is a parameter: the centroids and what is said of them are literals and a small broadcast
    at = F.get(F.array(*(F.array(*(F.lit(int(v)) for v in row)) for row in c)), F.col("own"))
    distance = F.aggregate(F.zip_with("q", at, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda t, v: t + v)
    measured = state.select("id", "own", distance.alias("distance"))
    per = {r["own"]: r["s"] for r in measured.groupBy("own").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    fits = lambda v: F.lit(int(v) if v < 1 << 63 else None).cast("long")
    shas = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    return measured.select(
        F.col("id").alias(key),
        F.col("own").alias("cluster"),
        "distance",
        F.get(F.array(*(fits(per.get(i, 0)) for i in range(len(c)))), F.col("own")).alias("cluster_inertia"),
        fits(sum(per.values())).alias("inertia"),
        F.get(F.array(*map(F.lit, shas)), F.col("own")).alias("centroid_sha256"),
    )


def oracle(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The same clusters by measuring everything, one round after the other."""
    near = lambda c: f"SELECT v.vec_id, v.n, any_value(v.q) AS q, arg_min(c.cluster, (list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster)) AS cluster FROM v CROSS JOIN {c} c GROUP BY 1, 2"
    steps = []
    for i in range(rounds):
        mean = ", ".join(f"CAST(CAST(sum(q[{j}]) AS BIGINT) // count(*) AS BIGINT) - CASE WHEN sum(q[{j}]) < 0 AND sum(q[{j}]) % count(*) <> 0 THEN 1 ELSE 0 END" for j in range(1, dim + 1))
        steps.append(f"a{i} AS MATERIALIZED ({near(f'c{i}')}), m{i} AS (SELECT cluster, [{mean}] AS q FROM a{i} GROUP BY 1), c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
      c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS cluster, q FROM (SELECT q, sha256(concat('3:', CAST(vec_id AS VARCHAR))) AS h FROM v ORDER BY h, q LIMIT {k})),
      {', '.join(steps)},
      a AS MATERIALIZED ({near(f'c{rounds}')}),
      d AS MATERIALIZED (SELECT vec_id, a.cluster, CAST(list_sum(list_transform(list_zip(a.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c USING (cluster))
      SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM d"""
