"""Balanced packing of tasks into shards: each task, largest first, goes to the shard with fewest (tokens, tasks, number).

The rule is one task after the other, but tasks of one size are alike, so that whole size classes are dealt at once: shards
with the same load and count are one entry of a heap, an entry takes as many rounds as keep it smallest, and once all loads lie within one task's size
shards take turns in a fixed cycle. What a class is dealt is a few segments of its ranks; tasks find theirs in a join. The sizes of a pool (at most as
many as its largest size) pass through one task in order, and segments leave it by the batch: it keeps the open shards of one pool, neither sizes nor tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate, chain
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import importable, placed

#: ranks of a class that share one key of the join
BLOCK = 64
#: runs of shards after which a batch of segments is handed on
RUNS = 10_000


class Segment(NamedTuple):
    """Ranks start to start + count - 1 of a class: the shard at place ((rank - start) // per) % width of the ranges."""

    start: int
    count: int
    per: int
    width: int
    ranges: list[tuple[int, int]]  # (place, shard) where each run of consecutive shards begins


class Deal:
    """The shards of a pool while its size classes are dealt, largest first. Heap entries: (tokens, tasks, first shard, number of shards)."""

    def __init__(self, *, shards: int | None, max_tasks: int | None = None, max_tokens: int | None = None, least: int = 0):
        self.heap = [(0, 0, 1, shards)] if shards else []
        self.live = shards or 0  # shards in the heap
        self.opened, self.max_tasks, self.max_tokens, self.least = shards or 0, max_tasks, max_tokens, least

    def push(self, load: int, tasks: int, first: int, width: int) -> None:
        """Shards that can take nothing more are left out."""
        if width and not (self.max_tasks is not None and tasks >= self.max_tasks) and not (self.max_tokens is not None and load + self.least > self.max_tokens):
            heapq.heappush(self.heap, (load, tasks, first, width))
            self.live += width

    def most_rounds(self, size: int, load: int, tasks: int) -> int | None:
        """Tasks of a size that a shard can still take; None without a bound."""
        bounds = [] if self.max_tasks is None else [self.max_tasks - tasks]
        if self.max_tokens is not None and size:
            bounds.append((self.max_tokens - load) // size)
        return min(bounds, default=None)

    def give(self, size: int, count: int) -> Iterator[Segment]:
        at = 0
        while count:
            if self.max_tokens is not None and not (self.heap and self.heap[0][0] + size <= self.max_tokens):
                yield self.open(size, at, count)
                return
            if not self.heap:
                raise ValueError("max_tasks is too small for the number of shards")
            got = self.cycles(size, at, count) or self.rounds(size, at, count)
            yield got
            at, count = at + got.count, count - got.count

    def open(self, size: int, at: int, count: int) -> Segment:
        """No shard has room: new ones are filled one after the other."""
        per = max(1, self.max_tokens // size) if size else count
        width = -(-count // per)
        first, last = self.opened + 1, count - (width - 1) * per
        self.opened += width
        self.push(per * size, per, first, width - 1)
        self.push(last * size, last, first + width - 1, 1)
        return Segment(at, count, per, width, [(0, first)])

    def cycles(self, size: int, at: int, count: int) -> Segment | None:
        """Whole turns of all shards whose loads are closer than the size; of a size of 0, of the smallest, if they hold equally many tasks."""
        if count < 2 * (self.live if size else self.heap[0][3]) or len(self.heap) < 2:
            return None
        low = self.heap[0][0]
        turn = sorted(self.heap if size else (e for e in self.heap if e[0] == low))
        width = sum(e[3] for e in turn)
        if len(turn) < 2 or count < 2 * width or (turn[-1][0] - low >= size if size else turn[-1][1] != turn[0][1]):
            return None
        bounds = [b for e in turn if (b := self.most_rounds(size, e[0], e[1])) is not None]
        n = min([count // width, *bounds])
        if n < 1:
            return None
        rest = [] if size else [e for e in self.heap if e[0] != low]
        ranges, place = [], 0
        for e in turn:
            ranges.append((place, e[2]))
            place += e[3]
        self.heap = rest
        heapq.heapify(self.heap)
        self.live -= width
        for load, tasks, first, w in turn:
            self.push(load + n * size, tasks + n, first, w)
        return Segment(at, n * width, 1, width, ranges)

    def rounds(self, size: int, at: int, count: int) -> Segment:
        """The smallest shards take turns for as long as they stay the smallest."""
        load, tasks, first, width = heapq.heappop(self.heap)
        self.live -= width
        n = count
        if self.heap:
            load2, tasks2, first2, _ = self.heap[0]
            if not size:
                n = count if load < load2 else tasks2 - tasks + (first < first2)
            else:
                n = -(-(load2 - load) // size)
                if load + n * size == load2 and (tasks + n, first) < (tasks2, first2):
                    n += 1
        most = self.most_rounds(size, load, tasks)
        taken = min(count, max(1, n) * width, count if most is None else most * width)
        whole, part = divmod(taken, width)
        self.push(load + (whole + 1) * size, tasks + whole + 1, first, part)
        self.push(load + whole * size, tasks + whole, first + part, width - part)
        return Segment(at, taken, 1, width, [(0, first)])


def in_batches(rows: Iterator[tuple], pool_type) -> Iterator:
    """(pool, tokens, Segment) as Arrow batches of about RUNS runs of shards."""
    import pyarrow as pa

    def batch(held: list[tuple]) -> pa.RecordBatch:
        runs = [r for _, _, s in held for r in s.ranges]
        ends = pa.array(accumulate((len(s.ranges) for _, _, s in held), initial=0), pa.int32())
        places = pa.StructArray.from_arrays([pa.array([r[k] for r in runs], pa.int64()) for k in (0, 1)], names=["place", "shard"])
        numbers = [pa.array(x, pa.int64()) for x in zip(*((size, s.start, s.count, s.per, s.width) for _, size, s in held), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in held], pool_type), *numbers, pa.ListArray.from_arrays(ends, places)], names=["pool", "tokens", "start", "count", "per", "width", "ranges"])

    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[2].ranges)
        if n >= RUNS:
            yield batch(held)
            held, n = [], 0
    if held:
        yield batch(held)


def dealt(tasks: DataFrame, **how) -> DataFrame:
    importable(tasks.sparkSession)
    own = tasks.select("pool", "name", "ord", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    ranked = placed(own, ["pool", "tokens"], ["ord", "name"], "rank").withColumn("rank", F.col("rank") - 1)
    classes = own.groupBy("pool", "tokens").agg(F.count(F.lit(1)).alias("n"))
    least = classes.groupBy(F.col("pool").alias("of")).agg(F.min("tokens").alias("least"))
    in_order = classes.join(least, F.col("pool").eqNullSafe(F.col("of"))).select("pool", "tokens", "n", "least").repartition("pool").sortWithinPartitions("pool", F.desc("tokens"))

    def deal(batches):
        kind = None

        def given():
            nonlocal kind
            state = None
            for b in batches:
                kind = b.schema.field("pool").type
                for pool, size, n, low in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if state is None or pool != last:
                        state, last = Deal(least=low, **how), pool
                    for s in state.give(size, n):
                        yield pool, size, s

        rows = given()
        for first in rows:  # the type of pools is known once there is one
            yield from in_batches(chain([first], rows), kind)

    kind = own.schema["pool"].dataType.simpleString()
    segments = in_order.mapInArrow(deal, f"pool {kind}, tokens long, start long, count long, per long, width long, ranges array<struct<place:long,shard:long>>")
    blocks = segments.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("count") - 1) / BLOCK))))
    own_, seg = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).alias("t"), blocks.alias("s")
    here = F.col("t.pool").eqNullSafe(F.col("s.pool")) & (F.col("t.tokens") == F.col("s.tokens")) & (F.col("t.block") == F.col("s.block")) & F.col("t.rank").between(F.col("s.start"), F.col("s.start") + F.col("s.count") - 1)
    place = F.expr("(t.rank - s.start) div s.per % s.width")
    run = F.element_at(F.filter("s.ranges", lambda r: r["place"] <= place), -1)
    return own_.join(seg, here).select("t.pool", "t.name", "t.ord", "t.tokens", (run["shard"] + place - run["place"]).cast("int").alias("shard"))


def shard(tasks: DataFrame, *, shards: int, max_tasks: int | None = None) -> DataFrame:
    """(pool, name, ord, tokens, shard) in a fixed number of shards, at most max_tasks tasks in each; ties of size by (ord, name).

    Null tokens count as 0. A pool with more tasks than its shards may hold stops the query.
    """
    return dealt(tasks, shards=shards, max_tasks=max_tasks)


def shard_under_cap(tasks: DataFrame, *, max_tokens: int) -> DataFrame:
    """The same into shards of at most max_tokens, opened when none has room; a task over the cap gets its own."""
    return dealt(tasks, shards=None, max_tokens=max_tokens)


def totals(packed: DataFrame) -> DataFrame:
    """Tasks, tokens and largest task of each shard."""
    return packed.groupBy("pool", "shard").agg(F.count(F.lit(1)).alias("tasks"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
