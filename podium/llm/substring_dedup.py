"""Substring dedup: words of windows that also start earlier in the corpus are removed.

A window is ``k`` consecutive words of one document. Windows are brought together by their minimiser,
the least of the hashes of their runs of ``m`` words: consecutive windows that share one make a
super-k-mer, which travels as one packed string of words to the minimiser's bucket, where the bucket's
windows are unpacked and sorted, so that equal ones meet in order of their places.

Only what can matter travels. A first pass counts minimisers; a window whose minimiser occurs once in
the corpus is unique, and a fixed-size bitmap of the others prunes such windows at the source. Very
frequent runs of words come last in the order of minimisers, so that a window that holds anything
rarer goes to the rarer bucket. And a packed string that occurs many times within a task travels once,
with its first place; its later occurrences are repeats whatever the bucket says.

Defined results: null and empty texts have no words; documents are ordered by id, null ids first;
rows that share an id count as one place, so that a repeated row is not removed by its twin, but
removed with it where both repeat something earlier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Windows in a super-k-mer at most; longer runs go as several.
LONGEST = 64
#: Bytes of packed strings that a task keeps in order to send each once.
HELD = 48 << 20
#: Frequent runs of words that come last as minimisers: so many at most, with so many occurrences at least.
HOT, HOT_COUNT = 20_000, 48
BITMAP_BITS = 26
TOP = np.uint64(1 << 63)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def runs(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where runs of equal values of one owner begin, none longer than LONGEST; and the end."""
    edges = np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]) | (owner[1:] != owner[:-1])) + 1, [len(x)]])
    long = np.flatnonzero(edges[1:] - edges[:-1] > LONGEST)
    return np.unique(np.concatenate([edges, *(np.arange(edges[i], edges[i + 1], LONGEST) for i in long)])) if len(long) else edges


def windows(words: common.Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of runs of m words, least of them in each window, places of windows within texts)."""
    g = words.grams(m) >> np.uint64(1)
    at = np.flatnonzero(words.left >= k)
    return g, sliding_min(g, k - m + 1) if len(at) else g[:0], at


def minimisers(texts: DataFrame, k: int, m: int) -> DataFrame:
    """The minimiser at each place that is the least of some window."""

    def of(batches):
        for b in batches:
            words = common.Words(b["text"].to_pylist())
            g, low, at = windows(words, k, m)
            out = np.zeros(0, dtype=np.uint64)
            if len(at):
                # the greatest minimum of the windows over a place is the place's hash if that is a minimum
                width = k - m + 1
                low = np.where(words.left[: len(low)] >= k, low, np.uint64(0))
                padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), low, np.zeros(width - 1, dtype=np.uint64)])
                out = g[g == ~sliding_min(~padded, width)]
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(out))], names=["mini"])

    return texts.select("text").mapInArrow(of, "mini long")


def repeats(texts: DataFrame, scratch: common.Scratch, *, k: int, m: int) -> DataFrame:
    """(place, tag, start, n): windows that start earlier too, as runs of n from start on."""
    spark = scratch.spark
    counts = minimisers(texts, k, m).groupBy("mini").count().where("count > 1")
    counts = scratch.put(counts, "minimisers")
    bits = spark.sparkContext.broadcast(common.bitmap(counts, "mini", BITMAP_BITS))
    top = counts.where(F.col("count") >= HOT_COUNT).orderBy(F.desc("count"), "mini").limit(HOT).toArrow()["mini"].to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(top.view(np.uint64)))

    def pack(batches):
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        names = ["mini", "packed", "place", "tag", "start", "n", "lost"]
        first: dict = {}
        rows, held = [], 0

        def flush(last):
            nonlocal rows, held
            if last or held > HELD:
                rows += [(mini, packed, *at, False) for (mini, packed), at in first.items()]
                first.clear()
                held = 0
            out, rows = rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)

        for b in batches:
            words = common.Words(b["text"].to_pylist())
            g, low, at = windows(words, k, m)
            if len(at):
                low = low[at]
                maybe = common.in_bitmap(bits.value, common.signed(low))
                if len(hot.value):
                    slot = np.minimum(np.searchsorted(hot.value, g), len(hot.value) - 1)
                    is_hot = hot.value[slot] == g
                    if is_hot.any():
                        late = sliding_min(np.where(is_hot, g | TOP, g), k - m + 1)[at]
                        maybe |= (late & ~TOP) != low  # such minimisers weren't counted
                        low = late
                owner = words.owner[at]
                edges = runs(low, owner)
                sent_ = np.flatnonzero(np.add.reduceat(maybe, edges[:-1]) > 0)
                places, tags = b["place"].to_pylist(), b["tag"].to_pylist()
                begin, size = edges[sent_], edges[sent_ + 1] - edges[sent_]
                docs_ = owner[begin]
                for i, a, n, mini in zip(docs_.tolist(), (at[begin] - words.starts[docs_]).tolist(), size.tolist(), common.signed(low[begin]).tolist(), strict=True):
                    packed = b" ".join(words.words[i][a : a + n + k - 1])
                    here, old = (places[i], tags[i], a, n), first.get((mini, packed))
                    if old is None:
                        first[mini, packed] = here
                        held += len(packed) + 200
                    elif (here[0], a) == (old[0], old[2]):
                        rows.append((mini, packed, *here, False))
                    else:
                        early, later = (here, old) if (here[0], a) < (old[0], old[2]) else (old, here)
                        first[mini, packed] = early
                        rows.append((None, None, *later, True))
            yield flush(False)
        yield flush(True)

    sent = scratch.put(texts.mapInArrow(pack, "mini long, packed binary, place long, tag long, start int, n int, lost boolean"), "superkmers")

    def bucket(rows):
        """Runs of windows of one bucket that have an earlier equal."""
        if len(rows) == 1 and rows[0][4] == 1:
            return
        windows = []
        for r, (packed, place, _, start, n) in enumerate(rows):
            words = packed.split(b" ")
            windows += [(b" ".join(words[i : i + k]), place, start + i, r, i) for i in range(n)]
        windows.sort()
        late: dict[int, list[int]] = {}
        head = (None, None, None)
        for w in windows:
            if w[0] != head[0]:
                head = w
            elif (w[1], w[2]) != (head[1], head[2]):
                late.setdefault(w[3], []).append(w[4])
        for r, at in late.items():
            at.sort()
            _, place, tag, start, _ = rows[r]
            a = at[0]
            for x, y in zip(at, [*at[1:], -1], strict=True):
                if y != x + 1:
                    yield place, tag, start + a, x + 1 - a
                    a = y

    def count(batches):
        mini, rows = None, []
        for b in batches:
            out = []
            for x, *row in zip(*(b[c].to_pylist() for c in ("mini", "packed", "place", "tag", "start", "n")), strict=True):
                if x != mini:
                    out += bucket(rows)
                    mini, rows = x, []
                rows.append(tuple(row))
            yield runs_batch(out)
        yield runs_batch(list(bucket(rows)))

    inside = sent.where("not lost").repartition("mini").sortWithinPartitions("mini")
    counted = inside.select("mini", "packed", "place", "tag", "start", "n").mapInArrow(count, "place long, tag long, start int, n int")
    return sent.where("lost").select("place", "tag", "start", "n").unionByName(counted)


def runs_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["place", "tag", "start", "n"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", k: int = 20, m: int = 10) -> DataFrame:
    """id, n_words, n_removed, kept_text (kept words joined by blanks) for each row of docs."""
    spark = docs.sparkSession
    common.ready(spark)
    scratch = common.Scratch(spark)
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(F.col(id_col).alias("id"), place.alias("place"), F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))
    found = repeats(texts.select("place", "tag", "text"), scratch, k=k, m=m)
    # a document has no more runs than words
    by_doc = found.groupBy("place", "tag").agg(F.collect_list(F.struct("start", "n")).alias("cut"))
    kind = texts.schema["id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, parts in zip(b["text"].to_pylist(), b["cut"].to_pylist(), strict=True):
                words = text.split() if text else []
                n_words.append(len(words))
                if parts:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, [p["start"] for p in parts], 1)
                    np.add.at(change, [p["start"] + p["n"] + k - 1 for p in parts], -1)
                    words = [w for w, c in zip(words, np.cumsum(change).tolist(), strict=False) if not c]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    out = texts.join(by_doc, ["place", "tag"], "left").select("id", "text", "cut")
    return out.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
