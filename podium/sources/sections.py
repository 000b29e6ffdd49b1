"""Sectioned tables by a table function that carries its state over a document's rows, so that a document may be split into any number of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.ranks import importable
from .texts import scores

GAP, WORD = re.compile(r"\s+", re.ASCII), re.compile(r"\S+", re.ASCII)


class Sections:
    """Pieces (file, pos, text) of documents -> (file, n, target, header, line) for each line that isn't a header: what stood last before it.

    The pieces of a file come to one task in order, one at a time; kept are the line that isn't ended yet, its number, and the last target and header.
    """

    @staticmethod
    def analyze(pieces: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in pieces.dataType.fields}
        if not pieces.isTable or not {"file", "pos", "text"} <= kinds.keys():
            raise ValueError("expected TABLE(...) with columns file, pos and text")
        schema = StructType().add("file", kinds["file"]).add("n", LongType()).add("target", StringType()).add("header", ArrayType(StringType())).add("line", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("file")], orderBy=[OrderingColumn("pos")])

    def __init__(self):
        self.file, self.n, self.open, self.target, self.header = None, 0, [], None, None

    def take(self, line: str) -> Iterator[tuple]:
        n, self.n = self.n, self.n + 1
        line = line.removesuffix("\r").strip(" ")
        if not line:
            return
        if line.startswith("Target:"):
            self.target = (WORD.findall(line[7:]) or [""])[0]
        elif line.startswith("#"):
            cells = GAP.split(line.lstrip("#").strip(" "))
            if "Model" in cells:
                self.header = cells
        elif self.header is not None:
            yield self.file, n, self.target, self.header, line

    def eval(self, piece) -> Iterator[tuple]:
        self.file = piece["file"]
        *whole, rest = (piece["text"] or "").split("\n")
        if whole:
            yield from self.take("".join([*self.open, whole[0]]))
            for line in whole[1:]:
                yield from self.take(line)
            self.open = []
        self.open.append(rest)

    def terminate(self) -> Iterator[tuple]:
        yield from self.take("".join(self.open))


def told_lines(pieces: DataFrame) -> DataFrame:
    """What Sections gives for all files: pieces come sorted and in batches, and a file's state is carried from batch to batch."""
    import pyarrow as pa

    importable(pieces.sparkSession)
    schema = StructType().add("file", pieces.schema["file"].dataType).add("n", LongType()).add("target", StringType()).add("header", ArrayType(StringType())).add("line", StringType())

    def parse(batches):
        at, known = None, False
        for batch in batches:
            rows, files = [], batch["file"].to_pylist()
            texts, begin = batch["text"].to_pylist(), 0
            while begin < len(files):
                file, end = files[begin], begin + 1
                while end < len(files) and files[end] == file:
                    end += 1
                if not known or at.file != file:
                    if known:
                        rows.extend(at.terminate())
                    at, known = Sections(), True
                # adjoining pieces of a file are one text
                rows.extend(at.eval({"file": file, "text": "".join(t for t in texts[begin:end] if t)}))
                begin = end
            yield made(rows, batch.schema.field("file").type)
        if known:
            yield made(list(at.terminate()), batch.schema.field("file").type)

    def made(rows, kind):
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (kind, pa.int64(), pa.string(), pa.list_(pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "n", "target", "header", "line"])

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.select("file", "pos", "text").repartition(n, "file").sortWithinPartitions("file", "pos").drop("pos").mapInArrow(parse, schema)


def score_table_pieces(pieces: DataFrame, category: str) -> DataFrame:
    """score_table() of documents that are split into pieces (file, pos, text), anywhere, even within a line."""
    spark = pieces.sparkSession
    importable(spark)
    spark.udtf.register("podium_sections", F.udtf(Sections))
    return scores(told_lines(pieces), category)
