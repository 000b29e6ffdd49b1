"""Operators that split large groups: ranks, interval sweeps and shard packing against plain Python."""

import heapq
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from podium.functions import intervals
from podium.operators import ranges, ranks, shards

RANGES = "k string, lo int, hi int"


def some_ranges(seed, n, *, top=60):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["a", "a", "a", "b", None])
    return [(key(), (lo := rnd.randrange(top)), lo + rnd.randrange(-2, 9)) for _ in range(n)]


def places(rows):
    out = {}
    for k, lo, hi in rows:
        if lo is not None and hi is not None and lo <= hi:
            out.setdefault(k, set()).update(range(lo, hi + 1))
    return out


def runs(found):
    out = []
    for k, ps in found.items():
        for p in ps:
            if p - 1 not in ps:
                hi = p
                while hi + 1 in ps:
                    hi += 1
                out.append((str(k), p, hi))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_range_algebra(spark, seed):
    a, b = [*some_ranges(seed, 40), ("a", None, 4), ("only", 3, 3)], [*some_ranges(seed + 50, 30), ("b", 7, None), ("other", 1, 2)]
    da, db, pa, pb = spark.createDataFrame(a, RANGES), spark.createDataFrame(b, RANGES), places(a), places(b)
    keys = set(pa) | set(pb)
    for holds, op in ((ranges.UNION, set.union), (ranges.INTERSECTION, set.intersection), (ranges.DIFFERENCE, set.difference)):
        got = sorted((str(r.k), r.lo, r.hi) for r in ranges.combined(da, db, ["k"], holds).collect())
        assert got == runs({k: op(pa.get(k, set()), pb.get(k, set())) for k in keys})
    assert sorted((str(r.k), r.lo, r.hi) for r in ranges.combined(da, None, ["k"]).collect()) == runs(pa)
    got = {r.k: (r.n_a, r.n_b, r.n_both) for r in ranges.measured(da, db, ["k"]).collect()}
    assert got == {k: (len(pa.get(k, ())), len(pb.get(k, ())), len(pa.get(k, set()) & pb.get(k, set()))) for k in keys}
    assert ranges.combined(da.limit(0), db.limit(0), ["k"]).count() == 0


def test_long_ranges(spark):
    """A thousand million places cost no more than their ends, as tables and as arrays in a row."""
    a = spark.createDataFrame([("a", 1, 10**9), ("a", 10**9 + 1, 2 * 10**9), ("a", 5, 7)], RANGES)
    b = spark.createDataFrame([("a", 10**9, 10**9 + 4)], RANGES)
    assert [tuple(r) for r in ranges.combined(a, None, ["k"]).collect()] == [("a", 1, 2 * 10**9)]
    assert sorted(tuple(r) for r in ranges.combined(a, b, ["k"], ranges.DIFFERENCE).collect()) == [("a", 1, 10**9 - 1), ("a", 10**9 + 5, 2 * 10**9)]
    assert [tuple(r) for r in ranges.coverage(b, a, ["k"]).collect()] == [("a", 2 * 10**9, 5, 1.0)]
    row = spark.sql("SELECT array(struct(1 AS lo, 1000000000 AS hi), struct(5 AS lo, 7 AS hi), struct(9 AS lo, 3 AS hi)) AS a, array(struct(999999999 AS lo, 1000000002 AS hi)) AS b, cast(null AS array<struct<lo:int,hi:int>>) AS none")
    got = row.select(intervals.size(F.col("a")).alias("n"), intervals.coverage(F.col("b"), F.col("a")).alias("c"), intervals.coverage(F.filter("a", lambda r: r["lo"] > 99), F.col("b")).alias("e"), intervals.coverage(F.col("b"), F.col("none")).alias("z")).first()
    assert tuple(got) == (10**9, 0.5, None, None)


def test_arrays_against_sets(spark):
    rnd = random.Random(4)
    rows = [([(lo, lo + rnd.randrange(6)) for lo in (rnd.randrange(30) for _ in range(rnd.randrange(6)))], [(lo, lo + rnd.randrange(6)) for lo in (rnd.randrange(30) for _ in range(rnd.randrange(6)))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<struct<lo:int,hi:int>>, b array<struct<lo:int,hi:int>>")
    for r in df.select("a", "b", intervals.size(F.col("a")).alias("n"), intervals.coverage(F.col("a"), F.col("b")).alias("c")).collect():
        a, b = ({p for x in y for p in range(x["lo"], x["hi"] + 1)} for y in (r["a"], r["b"]))
        assert r["n"] == len(a) and (r["c"] is None) == (not a) and (not a or abs(r["c"] - len(a & b) / len(a)) < 1e-12)


def test_ranks_of_a_large_group(spark):
    """Nine tenths of the rows in one group, ties and null keys: numbers as a window gives them."""
    df = spark.range(4000).selectExpr("CASE WHEN id % 10 = 0 THEN concat('g', id % 7) WHEN id % 101 = 0 THEN null ELSE 'hot' END AS g", "id * 7919 % 50 AS x", "id")
    got = ranks.placed(df, ["g"], [F.desc("x"), "id"])
    from pyspark.sql import Window as W

    want = df.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(F.desc("x"), "id")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and dict(got.dtypes)["place"] == "int"
    tied = ranks.placed(df.select("g", F.lit(1).alias("x")), ["g"], ["x"]).groupBy("g").agg(F.count_distinct("place").alias("n"), F.max("place").alias("top"), F.count("*").alias("all"))
    assert all(r["n"] == r["top"] == r["all"] for r in tied.collect())
    assert ranks.placed(df.limit(0), ["g"], ["x"]).count() == 0


def test_no_window_holds_a_group(spark):
    """Every window over rows is cut by part; the one over totals sees a row for each part of a group."""
    df = spark.range(100).selectExpr("'hot' AS g", "id AS x")
    rows = ranks.spread(df, ["g"], ["x"])
    plan = ranks.running(rows, ["g"], ["x"], {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("specifiedwindowframe(RowFrame, unboundedpreceding$(), -1)" in w for w in windows) == 1
    assert all("_part" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows)
    assert rows.select(ranks.PART).distinct().count() > 1


def greedy(sizes, *, shards=None, max_tasks=None, max_tokens=None):
    out, heap, opened = [], [(0, 0, i) for i in range(1, (shards or 0) + 1)], shards or 0
    for t in sizes:
        if max_tokens is not None and not (heap and heap[0][0] + t <= max_tokens):
            opened += 1
            load, n, i = 0, 0, opened
        else:
            load, n, i = heapq.heappop(heap)
        out.append(i)
        if max_tasks is None or n + 1 < max_tasks:
            heapq.heappush(heap, (load + t, n + 1, i))
    return out


def by_classes(sizes, **how):
    deal, out = shards.Deal(least=sizes[-1], **({"shards": None} | how)), []
    for size, same in groupby(sizes):
        for s in deal.give(size, len(list(same))):
            for rank in range(s.count):
                place = rank // s.per % s.width
                at, first = [x for x in s.ranges if x[0] <= place][-1]
                out.append(first + place - at)
    return out


def test_classes_are_dealt_as_one_by_one():
    rnd = random.Random(0)
    for _ in range(1500):
        most = rnd.choice([1, 3, 10, 1000])
        sizes = sorted([rnd.randrange(most + 1) for _ in range(rnd.randrange(1, 80))] + [rnd.randrange(most + 1)] * rnd.randrange(120), reverse=True)
        how = {"shards": rnd.randrange(1, 9)} if rnd.random() < 0.5 else {"max_tokens": rnd.randrange(1, 3 * most + 2)}
        assert by_classes(sizes, **how) == greedy(sizes, **how)
        if "shards" in how:
            how["max_tasks"] = -(-len(sizes) // how["shards"]) + rnd.randrange(3)
            assert by_classes(sizes, **how) == greedy(sizes, **how)


def test_a_huge_class_is_a_few_segments():
    deal = shards.Deal(shards=6, least=1)
    n = [sum(1 for _ in deal.give(size, count)) for size, count in ((1000, 3), (7, 10**12), (1, 10**12))]
    assert max(n) < 50
    capped = shards.Deal(shards=None, max_tokens=100, least=1)
    assert [sum(1 for _ in capped.give(size, count)) for size, count in ((30, 10**12), (10, 10**12))] < [5, 20]


TASKS = "pool string, name string, ord long, tokens long"


@pytest.mark.parametrize("how", [{"shards": 5}, {"shards": 5, "max_tasks": 130}, {"max_tokens": 50}])
def test_shards_of_tasks(spark, how):
    """A hot size, ties, null pools and null sizes; the plan groups classes, not tasks."""
    rnd = random.Random(7)
    rows = [(rnd.choice(["p", "p", None]), f"t{i % 50}", i // 3, rnd.choice([None, 0, 7, 7, 7, 7, rnd.randrange(60)])) for i in range(600)]
    df = spark.createDataFrame(rows, TASKS)
    out = (shards.shard if "shards" in how else shards.shard_under_cap)(df, **how)
    got = sorted((str(r.pool), r.name, r.ord, r.tokens, r.shard) for r in out.collect())
    want = []
    for pool in ("p", None):
        own = sorted((-(t or 0), o, n) for p, n, o, t in rows if p == pool)
        want += [(str(pool), n, o, -t, s) for (t, o, n), s in zip(own, greedy([-t for t, _, _ in own], **how), strict=True)]
    assert got == sorted(want)
    assert {r.shard: r.tasks for r in shards.totals(out.where("pool = 'p'")).collect()} == {s: sum(w[4] == s for w in want if w[0] == "p") for s in {w[4] for w in want if w[0] == "p"}}


def test_too_few_places(spark):
    df = spark.createDataFrame([("p", str(i), i, 1) for i in range(5)], TASKS)
    with pytest.raises(Exception, match="max_tasks is too small"):
        shards.shard(df, shards=2, max_tasks=2).collect()
