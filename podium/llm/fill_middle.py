"""Fill-in-middle: texts are ropes that are split at two unit ranks and joined again in another order, with sentinels.

A unit is a run of letters A to Z or one other code point. A rope is a balanced tree over leaves that hold a piece of
text, and every node knows its units and code points, so that a split walks down one path and cuts one leaf.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LEAF = 2048
LETTERS = re.compile("[A-Za-z]*")


def starts(text: str) -> np.ndarray:
    """Where the units of a text start, in code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = c | np.uint32(32)
    letter = (low >= 97) & (low <= 122)
    goes_on = np.zeros(len(c), dtype=bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~goes_on)


class Node:
    """A leaf with its text, or two subtrees; units and code points are cached in both."""

    __slots__ = ("height", "left", "points", "right", "text", "units")

    def __init__(self, text: str | None, left: Node | None = None, right: Node | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.units, self.points, self.height = left.units + right.units, left.points + right.points, 1 + max(left.height, right.height)
        else:
            self.units, self.points, self.height = len(starts(text)), len(text), 0


Rope = Node | None


def build(text: str) -> Rope:
    """A balanced rope; leaves of about LEAF code points end where a unit ends, so a longer run of letters is one leaf."""
    leaves, at = [], 0
    while at < len(text):
        end = min(at + LEAF, len(text))
        if LETTERS.fullmatch(text, end - 1, end):  # a letter: its run belongs to this leaf
            end = LETTERS.match(text, end).end()
        leaves.append(Node(text[at:end]))
        at = end
    while len(leaves) > 1:
        leaves = [Node(None, *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def join(a: Rope, b: Rope) -> Rope:
    """One rope of two; the higher one takes the lower one in along its edge, so that heights stay within a small factor of balance."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return Node(None, a.left, join(a.right, b))
    if b.height > a.height + 1:
        return Node(None, join(a, b.left), b.right)
    return Node(None, a, b)


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points) and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if rope.text is not None:
        cut = rank if by == "points" else int(starts(rope.text)[rank])
        return Node(rope.text[:cut]), Node(rope.text[cut:])
    here = getattr(rope.left, by)
    if rank <= here:
        a, b = split(rope.left, rank, by)
        return a, join(b, rope.right)
    a, b = split(rope.right, rank - here, by)
    return join(rope.left, a), b


def text_of(rope: Rope) -> str:
    out, todo = [], [rope] if rope else []
    while todo:
        node = todo.pop()
        if node.text is None:
            todo += [node.right, node.left]
        else:
            out.append(node.text)
    return "".join(out)


def points(rope: Rope) -> int:
    return rope.points if rope else 0


def transform(text: str | None, key: str, *, plain_from: int = 90, suffix_first_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text, as its key deals it."""
    text = text or ""
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    rope = build(text)
    n = rope.units if rope else 0
    if not text or h3 % 100 >= plain_from or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(rope, second)
    prefix, middle = split(head, first)
    p, s = (PREFIX, prefix), (SUFFIX, suffix)
    form, order = ("spm", (s, p)) if h4 % 100 < suffix_first_below else ("psm", (p, s))
    out = None
    for mark, part in (*order, (MIDDLE, middle)):
        out = join(join(out, Node(mark)), part)
    return n, form, points(prefix), points(middle), text_of(out)


def invert(output: str | None, form: str) -> str:
    """The text that gave an output: its rope is split at the sentinels, and the parts are joined in their first order."""
    if form == "plain" or not output:
        return output or ""
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    parts, rest, gone = {}, build(output), 0
    at = [output.find(m) for m in marks]
    ends = [*at[1:], len(output)]
    for mark, start, end in zip(marks, at, ends, strict=True):
        _, rest = split(rest, start + len(mark) - gone, "points")
        parts[mark], rest = split(rest, end - start - len(mark), "points")
        gone = end
    return text_of(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): every row's whole text in a form that trains filling in.

    A null text is an empty one, and an empty text stays plain; so does a text that holds a sentinel. Rows with equal keys are dealt alike, a null
    key like an empty one. Other columns of docs are not read. Nothing is shuffled; a row is as large as its text.
    """
    import pyarrow as pa

    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [transform(t, "" if k is None else k) for k, t in zip(b["k"].to_pylist(), b["t"].to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*got, strict=True) if got else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.large_string()).cast(pa.string())], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def restore(made: DataFrame) -> DataFrame:
    """Rows of fill_in_middle with ``restored``, the text rebuilt from output and form alone; a null output gives an empty text."""
    import pyarrow as pa

    ready(made.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = pa.array([invert(o, f) for o, f in zip(b["output"].to_pylist(), b["form"].to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, back], names=[*b.schema.names, "restored"])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in made.drop("restored").dtypes)
    return made.drop("restored").mapInArrow(work, f"{fields}, restored string")


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns: sizes, and hashes of output and restored text."""
    made = restore(fill_in_middle(docs))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def oracle() -> str:
    """The same digests by lists of units."""
    h = lambda i: f"CAST(concat('0x', substr(h, {8 * i + 1}, 8)) AS BIGINT)"
    part = lambda a, b: f"array_to_string(list_slice(u, {a}, {b}), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
      t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
      r AS (SELECT *, len(u) AS n, least({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1)) AS x, greatest({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1)) AS y FROM t),
      f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h(2)} % 100 >= 90 THEN 'plain' WHEN {h(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
        {part(1, 'x')} AS p, {part('x + 1', 'y')} AS m, {part('y + 1', 'len(u)')} AS s FROM r)
      SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""
