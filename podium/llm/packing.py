"""Mixture-controlled packing of token queues into windows of one length.

All tokens of a source, in the order in which its documents stand in the input, are its queue. Deficit
round-robin gives every window its quota of each queue: the target share times the window's length,
where what rounding leaves over or short is a deficit that the next window settles. Because quotas are
constant while no queue runs dry, the state after w windows has a closed form: with F(s) the quotas
summed up to source s, source s has given floor(w * F(s)) - floor(w * F(s - 1)) tokens. Its deficit is
always under one token, every window is exactly full, and any task can work out which window a token
falls into from its place in its queue. So deficits carry across windows and partitions, and nothing
but a table of counts by partition and source has to be gathered.

When a queue runs dry its share goes to the others, which starts a new phase with new quotas; there
are at most two phases for each source. Without target shares the shares are those of the input, all
queues end together, and only the last window is padded.

Defined results: a null or empty text is the end token alone; a null source is a source of its own;
repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows (partition, source) up to which queue bases travel by broadcast; beyond, by a join.
BASES = 500_000
_loaded: dict = {}


class Tokens:
    """Text -> ids as bytes: a text is encoded in one call that gives an array, which costs less than to look words up."""

    def __init__(self, path: str):
        import base64

        import tiktoken

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of the vocabulary
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        self.kind = "<u2" if len(ranks) < 1 << 16 else "<u4"

    def encode(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype(self.kind).tobytes()


def tokenizer(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


class Schedule:
    """Which window and place each token of each queue falls into.

    Sources whose quota is under one token share a lane, one after the other.
    """

    def __init__(self, totals: dict, length: int, weights: dict | None = None):
        share = {s: Fraction(weights.get(s, 0)) if weights else Fraction(n) for s, n in totals.items() if n}
        lanes: list[list] = []
        for s in sorted(share, key=lambda s: (share[s], s is not None, s or "")):
            if lanes and sum(share[x] for x in lanes[-1]) * length < sum(share.values()):
                lanes[-1].append(s)
            else:
                lanes.append([s])
        #: source -> (lane, its first token there)
        self.at = {s: (i, sum(totals[x] for x in lane[:k])) for i, lane in enumerate(lanes) for k, s in enumerate(lane)}
        total = [sum(totals[s] for s in lane) for lane in lanes]
        part = [sum(share[s] for s in lane) for lane in lanes]
        left, window = list(total), 0
        #: (first window, first token of each lane, quotas summed up to each lane)
        self.phases: list[tuple[int, list[int], list[Fraction]]] = []
        while any(left):
            live = [i for i, n in enumerate(left) if n]
            rest = sum(part[i] for i in live)
            quota = {i: length * part[i] / rest if rest else Fraction(length, len(live)) for i in live}
            n = min(int(left[i] / quota[i]) for i in live if quota[i])
            if not n:  # one window of what is left of the lane that ends, filled up from the others in turn
                n, quota = 1, self.last_of(left, part, length)
            sums = [Fraction(0)]
            for i in range(len(lanes)):
                sums.append(sums[-1] + quota.get(i, 0))
            self.phases.append((window, [t - x for t, x in zip(total, left, strict=True)], sums))
            left = [x - int(n * sums[i + 1]) + int(n * sums[i]) for i, x in enumerate(left)]
            window += n
        self.ends = [[p[1][i] for p in self.phases] for i in range(len(lanes))]
        #: by phase and lane: first window, first token, and the bounds of the lane's quota as whole numbers
        self.plain = [[(first, bases[i], sums[i].numerator, sums[i].denominator, sums[i + 1].numerator, sums[i + 1].denominator, float(sums[i + 1] - sums[i])) for i in range(len(lanes))] for first, bases, sums in self.phases]

    @staticmethod
    def last_of(left: list[int], part: list[Fraction], length: int) -> dict[int, Fraction]:
        live = sorted((i for i, n in enumerate(left) if n), key=lambda i: (not part[i], Fraction(left[i]) / (part[i] or 1)))
        if sum(left) <= length:
            return {i: Fraction(left[i]) for i in live}
        quota, room = {}, length
        for k, i in enumerate(live):
            rest = sum(part[x] for x in live[k:])
            want = room * part[i] / rest if rest else Fraction(room, len(live) - k)
            quota[i] = Fraction(min(left[i], -(-want.numerator // want.denominator)))
            room -= int(quota[i])
        return quota

    def pieces(self, source, start: int, n: int):
        """(window, place in it, tokens) for n tokens of a queue from start on."""
        i, base = self.at[source]
        start += base
        ends = self.ends[i]
        while n:
            p = bisect_right(ends, start) - 1
            first, begin, ln, ld, hn, hd, quota = self.plain[p][i]
            stop = ends[p + 1] if p + 1 < len(ends) else start + n
            t = start - begin
            w = max(0, int(t / quota) - 2)
            low = w * ln // ld
            took = w * hn // hd - low
            while n and start < stop:
                next_low = (w + 1) * ln // ld
                after = (w + 1) * hn // hd - next_low
                if after > t:
                    k = min(n, after - t, stop - start)
                    yield first + w, next_low - low + t - took, k
                    start, t, n = start + k, t + k, n - k
                if after <= t:
                    w, low, took = w + 1, next_low, after


def pack(docs: DataFrame, *, tokens_path: str, id_col: str = "doc_id", source_col: str = "source", length: int = 2048, end_id: int = 1, weights: dict | None = None) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids (binary).

    tokens_path: the vocabulary as ranks. weights: target share by source; else the input's.
    """
    spark = docs.sparkSession
    common.ready(spark)
    scratch = common.Scratch(spark)

    def encode(batches):
        bpe, part, so_far = tokenizer(tokens_path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], dtype=bpe.kind).tobytes()
        for b in batches:
            ids, ns, ats = [], [], []
            for text, source in zip(b["text"].to_pylist(), b["source"].to_pylist(), strict=True):
                own = (bpe.encode(text) if text else b"") + end
                n = len(own) // len(end)
                ids.append(own)
                ns.append(n)
                ats.append(so_far.get(source, 0))
                so_far[source] = ats[-1] + n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(ns, pa.int64()), pa.array(ats, pa.int64()), pa.array([part] * len(ids), pa.int32())], names=["id", "source", "ids", "n", "at", "part"])

    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), "text")
    kind = own.schema["id"].dataType.simpleString()
    coded = scratch.put(own.mapInArrow(encode, f"id {kind}, source string, ids binary, n long, at long, part int"), "ids")
    counts = scratch.put(coded.groupBy("source", "part").agg(F.sum("n").alias("n")), "counts")
    totals = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    schedule, width = Schedule(totals, length, weights), tokenizer(tokens_path).kind
    bases = counts.selectExpr("source", "part", "sum(n) over (partition by source order by part) - n as base")
    few = bases.count() <= BASES
    key = F.col("coded.source").eqNullSafe(F.col("bases.source")) & (F.col("coded.part") == F.col("bases.part"))
    placed = coded.alias("coded").join(F.broadcast(bases).alias("bases") if few else bases.alias("bases"), key).select("id", "coded.source", "ids", "n", (F.col("at") + F.col("base")).alias("at"))

    def cut(batches):
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
        for b in batches:
            row, windows, places, sizes, starts, sums, pieces = [], [], [], [], [], [], []
            for r, (source, ids, n, at) in enumerate(zip(*(b[c].to_pylist() for c in ("source", "ids", "n", "at")), strict=True)):
                data, start = np.frombuffer(ids, dtype=width).astype("<u4").tobytes(), 0
                for window, place, k in schedule.pieces(source, at, n):
                    piece = data[4 * start : 4 * (start + k)]
                    row.append(r)
                    windows.append(window)
                    places.append(place)
                    sizes.append(k)
                    starts.append(start)
                    sums.append(zlib.crc32(piece))
                    pieces.append(piece)
                    start += k
            take = pa.array(row, pa.int64())
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"].take(take), long(starts), long(sizes), long(sums), b["n"].take(take), long(windows), long(places), b["source"].take(take), pa.array(pieces, pa.binary())], names=names)

    out = placed.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")
    return out.withColumnRenamed("id", id_col)
