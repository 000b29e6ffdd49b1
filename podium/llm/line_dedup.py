"""Line dedup: of lines that are equal or nearly so, the first in the corpus stays.

A line's shingles are its runs of ``q`` characters at every position, or the whole of a shorter line. Sixteen MinHash
values of them (the shingle hashes' minima under fixed bit flips) make twelve bands of four, which are lines
of a plane of sixteen points, so that two bands share one value at most. Within a band's bucket every line is
compared with the bucket's pivot, the line with most and fullest buckets, if it shares more bands with it than with other pivots, and then with all members
that are in another component yet. A byte of each minimum goes with a line: pairs of a bucket of which fewer than seven bytes agree are
passed over, which at the threshold happens to two pairs in ten thousand. Bitmaps of the shingles are met with what is left, and tell which lines have company there: somebody whose bitmap differs in
no more bits, by four standard deviations, than the threshold lets expect. Those get parity sketches, and a pair is only
made if its sketches differ in no more bits than its shingles may, which loses none. They are compared with pivots drawn at random
first, so that few pairs within one group are made. All pairs made are tested by exact Jaccard
over the shingles, by their 64-bit hashes. A character is a unit of UTF-16. Links make components by union-find, and each component keeps one line. Equal lines are one node from the start, named by the line's 64-bit hash. Everything is DataFrame functions.

Defined results: ids are whole numbers; null texts stay null and have no lines; blank lines are never removed and never
counted as copies; lines are ordered by document id (null first), then by their place; rows that share
id and text count as one place, so that a repeated row loses the same lines as its twin; rows that
share an id but not the text are told apart by the text's hash; columns n_lines and n_removed of the
input give way to those of the result; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Minima that make a band: three classes of parallels of the affine plane of order 4, y = m * x + c over the field of four
#: elements. Two lines of text meet in some band with probability 0.98 at Jaccard 0.8, 0.994 at 0.85, 0.999 at 0.9.
BANDS = [tuple(4 * x + ((0 if 0 in (m, x) else (m + x - 2) % 3 + 1) ^ c) for x in range(4)) for m in range(3) for c in range(4)]
MINIMA = 16
#: Longs of a line's bitmap, which has a bit for each class of shingles.
WORDS = 8
SKETCH = ["zeros", *(f"p{j}" for j in range(WORDS))]
#: Minima, of sixteen, of which a byte must agree for two lines of a bucket to be compared. Each agrees with probability
#: Jaccard: at 0.8 fewer than seven do with probability 0.0002.
AGREE = 7
#: Two longs of eight bytes, one from each minimum.
BYTES = ["s0", "s1"]
#: Longs of a parity sketch, in which a bit is set if its class has an odd number of shingles.
PARITY = 32
#: Longs to which it is folded where all pairs of a bucket are compared; so many fit a method that the JVM compiles.
FOLDED = 8
#: Turns of pivots drawn at random among lines with company.
TURNS = 2
#: Shingles that one row of the signature's aggregate takes up.
AT_ONCE = 8
#: Band keys of several lines up to which they are broadcast (8 bytes each, and what the hash table adds); beyond, by a shuffle.
FEW_KEYS = 2_000_000
#: Nodes in candidate pairs up to which they are broadcast in order to fetch their lines (8 bytes each, and what the hash table adds); beyond, by a shuffle.
FEW = 1_000_000
#: Removed lines up to which their places are broadcast to the documents (under 100 bytes each); beyond, by a shuffle.
FEW_CUTS = 1_000_000


def once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f refers to it."""
    return F.transform(F.array(value), f)[0]


def flips(n: int) -> list[int]:
    """Bit patterns whose leading bits differ, so that the minima under them are of different shingles."""
    out = [((i * 0x9E3779B97F4A7C15) ^ (0x0F3C5A69 * (2 * i + 1) << 16)) & common.M64 for i in range(n)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def shingles(line: Column, q: int) -> Column:
    """Distinct hashed runs of q characters, or of the whole of a shorter line."""
    at = lambda b: F.sequence(F.lit(1), F.greatest(F.length(b) - (2 * q - 1), F.lit(1)), F.lit(2))
    return F.array_distinct(once(F.encode(line, "UTF-16BE"), lambda b: F.transform(at(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(2 * q))))))


def located(docs: DataFrame, id_col: str) -> DataFrame:
    """(place, tag, pos, line, node) for each line that isn't blank."""
    own = docs.where("text is not null").select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("place"), F.xxhash64("text").alias("tag"), "text")
    lines = own.select("place", "tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.ltrim("line", F.lit(" \t\n\x0b\f\r")) != "")
    return lines.withColumn("node", F.xxhash64("line"))


def signed(lines: DataFrame, q: int) -> DataFrame:
    """(node, n, zeros, p0, p1, ..., m0, m1, ...): how many lines a node has, bitmap with its share of zeros, minima."""
    last = F.length("b") - (2 * q - 1)
    at = lines.select("node", F.encode("line", "UTF-16BE").alias("b"))
    at = at.select("node", "b", F.explode(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(2 * AT_ONCE))).alias("at"))
    run = lambda j: F.xxhash64(F.substring("b", F.col("at") + 2 * j, F.lit(2 * q)))
    # the upper halves are enough to compare
    half = lambda j: F.shiftright(run(j) if j == 0 else F.when(F.col("at") + 2 * j <= last, run(j)).otherwise(run(0)), 32).cast("int")
    rows = at.select("node", F.when(F.col("at") == 1, 1).otherwise(0).alias("one"), *(half(j).alias(f"h{j}") for j in range(AT_ONCE)))
    least = lambda x: F.least(*(F.col(f"h{j}").bitwiseXOR(F.lit(x >> 32).cast("int")) for j in range(AT_ONCE)))
    minima = [F.min(least(x)).alias(f"m{i}") for i, x in enumerate(flips(MINIMA))]
    bit = lambda j, w: f"if((h{j} & {WORDS - 1}) = {w}, shiftleft(1L, shiftright(h{j}, 3) & 63), 0L)"
    bitmap = [F.expr(f"bit_or({' | '.join(bit(j, w) for j in range(AT_ONCE))})").alias(f"p{w}") for w in range(WORDS)]
    out = rows.groupBy("node").agg(F.sum("one").alias("n"), *minima, *bitmap)
    zeros = F.expr(f"1 - ({' + '.join(f'bit_count(p{w})' for w in range(WORDS))}) / {64 * WORDS}D").alias("zeros")
    return out.select("node", "n", zeros, *(f"p{w}" for w in range(WORDS)), *(f"m{i}" for i in range(MINIMA)))


def packed(first: int) -> Column:
    """The lowest bytes of eight minima in one long."""
    return F.expr(" | ".join(f"shiftleft(cast(m{first + i} & 255 as bigint), {8 * i})" for i in range(8)))


def agreeing(least: int = AGREE) -> str:
    """Whether sides a and b have a byte in common for so many of the minima, by s0 and s1."""
    # a byte that differs leaves its lowest bit set once its bits are folded onto it
    fold = lambda x, n: f"({x} | shiftrightunsigned({x}, {n}))"
    apart = (f"bit_count({fold(fold(fold(f'(a{c} ^ b{c})', 4), 2), 1)} & {0x0101010101010101}L)" for c in BYTES)
    return f"{' + '.join(apart)} <= {MINIMA - least}"


def first_met(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, str]:
    """Sides a and b of a join by band, and whether no band before the one in which they meet has both; keys: a side's bands by number, or null."""
    # no key ends in the bits of -1 or -2; without nulls the condition stays short enough to be compiled
    left = left.withColumns({f"a{k}": F.when(F.col("band").bitwiseAND(F.lit(15)) > b, F.coalesce(f"a{k}", F.lit(-1))).otherwise(F.lit(-1)) for b, k in enumerate(keys)})
    right = right.withColumns({f"b{k}": F.coalesce(f"b{k}", F.lit(-2)) for k in keys})
    return left, right, f"not ({' or '.join(f'a{k} = b{k}' for k in keys)})"


def near(threshold: float) -> str:
    """Whether sides a and b, by their bitmaps, may reach the threshold.

    A set of x shingles leaves a share exp(-x / bits) of zeros; the union of two sets of n and m has
    (n + m) / (1 + Jaccard) shingles, which gives the bits that only one of the two has; about half of the
    differing shingles show, so that their number varies by half of it.
    """
    size = 64 * WORDS
    expected = f"{size} * (azeros + bzeros - 2 * pow(azeros * bzeros, {1 / (1 + threshold)!r}D))"
    bits = " + ".join(f"bit_count(ap{w} ^ bp{w})" for w in range(WORDS))
    return f"{bits} <= {expected} + 4 * sqrt(1 + greatest(0D, {expected}) / 2)"


def links(lines: DataFrame, known: DataFrame, scratch: common.Scratch, *, q: int, threshold: float) -> DataFrame:
    """Edges (a, b) between nodes that are joined by pairs with exact Jaccard from threshold on; known: signed(lines)."""
    # the lowest four bits of a band's key are its number
    bands = F.array(*(F.xxhash64(F.lit(b), *(F.col(f"m{i}") for i in points)).bitwiseAND(F.lit(~15)).bitwiseOR(F.lit(b)) for b, points in enumerate(BANDS)))
    entries = known.select("node", packed(0).alias("s0"), packed(8).alias("s1"), F.explode(bands).alias("band"))

    def only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "node", "left_semi")

    def texts_of(nodes: DataFrame) -> DataFrame:
        return only(lines.select("node", "line"), nodes).groupBy("node").agg(F.first("line").alias("line"))

    def ends(pairs: DataFrame) -> DataFrame:
        return scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")

    def verified(pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b) that hold over all shingles of both lines."""
        pairs = scratch.put(pairs, "pairs")
        if texts is None:
            texts = texts_of(ends(pairs))
        full = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
        sets = F.struct(*(shingles(F.col(c), q).alias(c) for c in "xy"))
        both = lambda s: once(F.size(F.array_intersect(s["x"], s["y"])), lambda k: k >= threshold * (F.size(s["x"]) + F.size(s["y"]) - k))
        out = scratch.put(full.where(once(sets, both)).select("a", "b"), "links")
        scratch.drop(pairs)
        return out

    keys = scratch.put(entries.groupBy("band").count().where("count > 1"), "keys")
    met = scratch.put(entries.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, "band"), "met")
    scratch.drop(keys)
    # lines in the midst of a group of near copies share more bands with more lines; each line with the pivot that it meets in most bands
    central = met.select("band", "node", *BYTES, F.sum(F.log2("count")).over(Window.partitionBy("node")).alias("weight"))
    pivots = central.groupBy("band").agg(F.max(F.struct("weight", "node", *BYTES)).alias("top"))
    pairs = met.select("band", "node", *BYTES).join(pivots.select("band", "top.*").toDF("band", "weight", "a", "as0", "as1"), "band").where("node <> a")
    pairs = pairs.withColumnsRenamed({"s0": "bs0", "s1": "bs1"}).where(agreeing())
    pairs = pairs.groupBy(F.col("node").alias("b"), "a").agg(F.count(F.lit(1)).alias("shared"), F.max("weight").alias("weight"))
    pairs = scratch.put(pairs.groupBy("b").agg(F.max(F.struct("shared", "weight", "a")).alias("best")).select("best.a", "b"), "pairs")
    seen = only(known.select("node", *SKETCH), ends(pairs))
    bitmaps = [seen.select(F.col("node").alias(s), *(F.col(c).alias(s + c) for c in SKETCH)) for s in "ab"]
    found = verified(pairs.join(bitmaps[0], "a").join(bitmaps[1], "b").where(near(threshold)).select("a", "b"))
    # members of a bucket that are in different components by now are compared with each other
    at = components(found, scratch)
    scratch.drop(pairs)
    placed = met.join(F.broadcast(at) if at.count() <= FEW else at, "node", "left").select("band", "node", F.coalesce("component", "node").alias("grp"), *BYTES)
    mixed = placed.groupBy("band").agg(F.min("grp").alias("least"), F.max("grp").alias("most")).where("least <> most").select("band")
    placed = scratch.put(placed.join(mixed, "band", "left_semi"), "placed")
    scratch.drop(met)
    some = scratch.put(company(placed, agreeing()), "company")
    scratch.drop(placed)
    seen = only(known.select("node", *SKETCH), scratch.put(some.select("node").distinct(), "nodes"))
    active = scratch.put(company(some.join(seen, "node"), near(threshold)).select("band", "node", "grp", *BYTES), "active")
    scratch.drop(some)
    nodes = scratch.put(active.select("node").distinct(), "nodes")
    texts = scratch.put(texts_of(nodes), "texts")
    hashed = texts.select("node", F.explode(shingles(F.col("line"), q)).alias("h"))
    words = [f"w{w}" for w in range(PARITY)]
    parity = [F.expr(f"bit_xor(if((h & {PARITY - 1}) = {w}, shiftleft(1L, cast(shiftright(h, 5) & 63 as int)), 0L))").alias(c) for w, c in enumerate(words)]
    wide = scratch.put(hashed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *parity), "parity")
    bound = lambda cols: f"({' + '.join(f'bit_count(a{c} ^ b{c})' for c in cols)}) * {1 + threshold!r}D <= (an + bn) * {1 - threshold!r}D + 1e-6D"
    sides = [wide.select(F.col("node").alias(s), *(F.col(c).alias(s + c) for c in ["n", *words])) for s in "ab"]
    for turn in range(TURNS):
        pivots = active.groupBy("band").agg(F.max_by(F.struct("node", "grp"), F.xxhash64("node", F.lit(turn))).alias("top")).select("band", "top.*")
        pairs = active.join(pivots.toDF("band", "a", "agrp"), "band").where("grp <> agrp").select("a", F.col("node").alias("b")).distinct()
        found = told(at).unionByName(verified(pairs.join(sides[0], "a").join(sides[1], "b").where(bound(words)).select("a", "b"), texts))
        at = components(found, scratch)
        active = scratch.put(active.join(at, "node", "left").select("band", "node", F.coalesce("component", "node").alias("grp"), *BYTES), "active")
    # within buckets by few words, which are the others' sums and lose none either; pairs that are left by all words;
    # a pair that meets in several bands is made in the first of them only
    folded = [f"f{i}" for i in range(FOLDED)]
    short = wide.select("node", "n", *(F.expr(" ^ ".join(words[i::FOLDED])).alias(c) for i, c in enumerate(folded)))
    keys = [f"k{b}" for b in range(len(BANDS) - 1)]
    own = active.groupBy("node").agg(*(F.max(F.when(F.col("band").bitwiseAND(F.lit(15)) == b, F.col("band"))).alias(k) for b, k in enumerate(keys)))
    full = active.join(short, "node").join(own, "node")
    left, right = (full.select("band", *(F.col(c).alias(f"{s}{c}") for c in ("node", "grp", "n", *BYTES, *folded, *keys))) for s in "ab")
    left, right, first = first_met(left, right, keys)
    rest = left.join(right, "band").where("agrp < bgrp").where(agreeing()).where(first).where(bound(folded)).select(F.col("anode").alias("a"), F.col("bnode").alias("b")).distinct()
    more = verified(rest.join(sides[0], "a").join(sides[1], "b").where(bound(words)).select("a", "b"), texts)
    scratch.drop(active, nodes, wide, texts)
    return told(at).unionByName(more)


def company(entries: DataFrame, close: str) -> DataFrame:
    """Entries (band, node, grp, ...) with another of their band in another component that is close."""
    left, right = (entries.select(*(F.col(c).alias(f"{s}{c}") for c in entries.columns)) for s in "ab")
    # the nodes differ if their components do; naming both lets the two sides be one shuffle
    other = (F.col("aband") == F.col("bband")) & (F.col("agrp") != F.col("bgrp")) & (F.col("anode") != F.col("bnode"))
    return left.join(right, other & F.expr(close), "left_semi").toDF(*entries.columns)


def told(components: DataFrame) -> DataFrame:
    """Edges (a, b) that say what components say, one for each node: far fewer than the pairs they come from, and without chains."""
    return components.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    return common.components(scratch, edges).select(F.col("id").alias("node"), "component")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", q: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs with text without its repeated lines, and n_lines and n_removed."""
    scratch = common.Scratch(docs.sparkSession)
    lines = located(docs, id_col)
    known = scratch.put(signed(lines, q), "signed")
    groups = common.components(scratch, links(lines, known, scratch, q=q, threshold=threshold)).select(F.col("id").alias("node"), "component")
    acting = known.select("node", "n").join(groups, "node", "left").where("n > 1 or component is not null")
    acting = scratch.put(acting.select("node", F.coalesce("component", "node").alias("component")), "acting")
    scratch.drop(known)
    wanted = F.broadcast(acting) if acting.count() <= FEW else acting
    there = scratch.put(lines.select("node", "place", "tag", "pos").join(wanted, "node").drop("node"), "there")
    keepers = there.groupBy("component").agg(F.min(F.struct("place", "pos", "tag")).alias("keep"))
    keepers = keepers.select("component", F.col("keep.place").alias("k_place"), F.col("keep.pos").alias("k_pos"))
    gone = scratch.put(there.join(keepers, "component").where("place <> k_place or pos <> k_pos").select("place", "tag", "pos"), "gone")
    scratch.drop(there)
    # a document has no more of these than lines
    cut = gone.groupBy("place", "tag").agg(F.collect_list("pos").alias("cut"))
    own = docs.withColumns({"__place": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "__tag": F.xxhash64("text")})
    cut = cut.select(F.col("place").alias("__place"), F.col("tag").alias("__tag"), F.array_distinct("cut").alias("__cut"))
    out = own.join(F.broadcast(cut) if gone.count() <= FEW_CUTS else cut, ["__place", "__tag"], "left")
    kept = once(F.split("text", "\n", -1), lambda w: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col("__cut")), lambda i: F.get(w, i)), "\n"))
    count = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"))) + 1
    counts = [F.coalesce(count, F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.size("__cut"), F.lit(0)).cast("long").alias("n_removed")]
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(kept).alias("text")
    return out.select(*(text if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")), *counts)
