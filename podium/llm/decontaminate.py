"""Benchmark decontamination with spaced seeds.

A seed is the hash of the tokens that a fixed mask looks at; it ignores the others, so that a
substituted token spoils only seeds that look at it. The two masks are chosen together: wherever two
of ``WINDOW`` tokens are substituted, one of the masks fits somewhere between them. Seeds of test items
and training texts are joined; a hit names an alignment (test item, offset between the two), of which the
windows around the hit are verified token by token: it counts if some window of the item matches in all but ``ERRORS`` tokens.

An item shorter than the window is seeded by runs of its tokens: where its rule allows no substitution,
by the whole item, where it allows one, by its two halves, one of which is intact. Texts are seeded by
runs of just the lengths that the items at hand need.

Tokens are runs of letters and digits, lower-cased; a letter of a script without spaces is a token. While the seeds and
tokens of the test items are few, by count, they are broadcast: each text then meets them where it lies, and nothing
but results is shuffled. Beyond that they are joined by a shuffle of seeds, and then of the texts that have hits.
Everything is DataFrame functions.

Defined results: null and empty texts hit nothing; items of under 13 tokens must match as a whole, in
all but a proportional number of tokens (2 of 13); items without a token are never found; rows that share id and text give one
result, rows that share an id one for each item, with the earliest place and the best match of them; so do test rows that share an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .line_dedup import once

WINDOW, ERRORS = 13, 2
#: Fixed masks: places within a window that a seed looks at. No two substitutions in 13 tokens escape both.
MASKS = ((0, 3, 6, 7, 8, 9), (0, 1, 3, 4, 6, 10))
#: Seeds, and tokens, of test items up to which they are broadcast (some 20 bytes each, and what the hash table adds).
FEW = 400_000


#: All of these scripts begin at U+0E00; that is asked first, as it takes no look-up.
UNSPACED = r"([\x{E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]])"


def tokens(text: Column) -> Column:
    apart = F.regexp_replace(F.lower(text), UNSPACED, " $1 ")
    return F.split(F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " ")), " ")


def parts(n: int) -> list[tuple[int, int]]:
    """(place, length) of the runs that seed an item of n tokens, fewer than WINDOW."""
    errors = n * ERRORS // WINDOW
    edges = [n * i // (errors + 1) for i in range(errors + 2)]
    return [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


def kinds(lengths: list[int]) -> list[tuple[int, ...]]:
    """Places that each kind of seed looks at: the masks, and runs of these lengths."""
    return [*MASKS, *(tuple(range(n)) for n in lengths)]


def seed(tokens_: Column, at: Column, places: tuple[int, ...]) -> Column:
    """The hash of tokens at these places from ``at`` on, told apart from other kinds by their number and span."""
    return F.xxhash64(F.lit(len(places)), F.lit(places[-1]), *(F.get(tokens_, at + m) for m in places))


def seeds_of_texts(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """texts with (pos, seed) for each seed of ``have``: one row at a time, none where a kind doesn't fit."""
    spots = texts.select("*", F.explode(F.sequence(F.lit(0), F.size("have") - 1)).alias("pos"))
    made = [F.when(F.col("pos") + p[-1] < F.size("have"), seed(F.col("have"), F.col("pos"), p)) for p in kinds(lengths)]
    return spots.select("*", F.explode(F.array(*made)).alias("seed")).where("seed is not null")


def seeds_of_items(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(item, seed, item_pos): all masks of items of WINDOW tokens or more, the parts of shorter ones."""
    spots = items.select("item", "want", F.explode(F.sequence(F.lit(0), F.size("want") - 1)).alias("item_pos"))
    size = F.size("want")
    made = [F.when((size >= WINDOW) & (F.col("item_pos") + p[-1] < size), seed(F.col("want"), F.col("item_pos"), p)) for p in MASKS]
    for n in range(1, WINDOW):
        for at, length in parts(n):
            if length in lengths:
                made.append(F.when((size == n) & (F.col("item_pos") == at), seed(F.col("want"), F.col("item_pos"), tuple(range(length)))))
    return spots.select("item", "item_pos", F.explode(F.array(*made)).alias("seed")).where("seed is not null").distinct()


def windows(have: Column, want: Column, shift: Column, first: Column, last: Column, width: Column) -> Column:
    """The best of the windows of the item that begin at first to last: struct of matching tokens and minus its place."""
    same = F.transform(F.sequence(first, last + width - 1), lambda j: F.when((j + shift >= 0) & (F.get(have, j + shift) == F.get(want, j)), 1).otherwise(0))
    sums = once(same, lambda m: F.transform(F.sequence(F.lit(1), F.size(m) - width + 1), lambda s: F.struct(F.aggregate(F.slice(m, s, width), F.lit(0), lambda a, x: a + x).alias("n"), (-(first + s - 1)).alias("minus_at"))))
    return F.array_max(sums)


def matches(docs: DataFrame, items: DataFrame, *, id_col: str, item_col: str, text_col: str) -> DataFrame:
    """(id, tag, item, shift, b) for each hit that holds: hash of the text, offset of the item in it, best window around the hit."""
    scratch = common.Scratch(docs.sparkSession)
    tests = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), tokens(F.col(text_col)).alias("want"))
    tests = scratch.put(tests.where(F.col("want")[0] != "").distinct(), "items")
    sizes = [r["n"] for r in tests.select(F.size("want").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]  # under WINDOW rows
    lengths = sorted({length for n in sizes for _, length in parts(n)})
    # rows of the test table that share an id are told apart by their tokens
    tests = tests.withColumn("item_tag", F.xxhash64("want"))
    item_seeds = seeds_of_items(tests.select(F.struct("item", "item_tag").alias("item"), "want"), lengths).select("item.*", "item_pos", "seed")
    item_seeds = scratch.put(item_seeds, "seeds")
    own = docs.where("text is not null").select(F.col(id_col).alias("id"), F.xxhash64("text").alias("tag"), tokens(F.col("text")).alias("have"))
    few = item_seeds.limit(FEW + 1).count() <= FEW and (tests.agg(F.sum(F.size("want"))).first()[0] or 0) <= FEW
    if few:
        hits = seeds_of_texts(own, lengths).join(F.broadcast(item_seeds), "seed")
        near = hits.join(F.broadcast(tests), ["item", "item_tag"])
    else:
        hits = seeds_of_texts(own, lengths).select("id", "tag", "pos", "seed").join(item_seeds, "seed")
        hits = scratch.put(hits.select("id", "tag", "item", "item_tag", "pos", "item_pos").distinct(), "hits")
        texts = own.join(hits.select("id", "tag").distinct(), ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"])
        near = hits.join(tests, ["item", "item_tag"]).join(texts, ["id", "tag"])
    # windows of the item that hold the hit's place; a mask spans less than the window
    width = F.least(F.size("want"), F.lit(WINDOW))
    near = near.withColumns({"width": width, "shift": F.col("pos") - F.col("item_pos"), "first": F.greatest(F.col("item_pos") - (WINDOW - 1), F.lit(0)), "last": F.least(F.col("item_pos"), F.size("want") - width)})
    best = near.select("id", "tag", "item", "shift", "width", windows(F.col("have"), F.col("want"), F.col("shift"), F.col("first"), F.col("last"), F.col("width")).alias("b"))
    return best.where((F.col("width") - F.col("b.n")) * WINDOW <= F.col("width") * ERRORS)


def find(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id, item id, first_pos (token of the text where a match begins), n_matched (of a window, at best)."""
    good = matches(docs, items, id_col=id_col, item_col=item_col, text_col=text_col)
    return good.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.min(F.greatest(F.col("shift") - F.col("b.minus_at"), F.lit(0))).alias("first_pos"), F.max("b.n").alias("n_matched"))


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that no test item was found in; rows that share an id, null too, are judged each by its text."""
    hit = matches(docs, items, id_col=id_col, item_col="item_id", text_col="text").select(F.col("id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    own = docs.withColumn("__tag", F.xxhash64("text"))
    return own.join(hit, own[id_col].eqNullSafe(hit["__id"]) & (own["__tag"] == hit["__tag"]), "left_anti").drop("__tag")
