"""The folder source, the store sink, and the table function over split documents."""

import os
import random

import pytest
from pyspark.sql import functions as F

from podium.sources import folders, sections, texts


@pytest.fixture
def root(tmp_path):
    for name, size in (("a/x.cif", 3), ("a/deep/er/y.pdb", 0), ("a/z.txt", 1), ("b/x.cif", 0), ("top.pdb", 2), ("c.d/n", 1)):
        f = tmp_path / "in" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * size)
    return str(tmp_path / "in")


def test_files_of_a_folder(spark, root):
    got = sorted((r.category, os.path.relpath(r.path, root), r.name, r.suffix, r.length) for r in folders.files(spark, root).collect())
    assert got == [("", "top.pdb", "top.pdb", ".pdb", 2), ("a", "a/deep/er/y.pdb", "y.pdb", ".pdb", 0), ("a", "a/x.cif", "x.cif", ".cif", 3), ("a", "a/z.txt", "z.txt", ".txt", 1), ("b", "b/x.cif", "x.cif", ".cif", 0), ("c.d", "c.d/n", "n", "", 1)]
    assert folders.files(spark, root + "/nowhere").count() == 0
    listed = [(os.path.relpath(r.path, root), r.place) for r in folders.listing(spark, "file://" + root).orderBy("place").collect()]
    assert listed == [("a/x.cif", 1), ("b/x.cif", 2), ("a/deep/er/y.pdb", 3), ("top.pdb", 4)]
    with pytest.raises(Exception, match="isn't a mounted folder"):
        folders.files(spark, "s3a://bucket/x").count()


def test_filters_reach_the_source(spark, root):
    """A category that isn't asked for isn't listed, and nothing is left to filter above the scan."""
    few = folders.files(spark, root).where("category = 'a' AND suffix IN ('.pdb', '.txt') AND length >= 0")
    plan = few._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
    assert kept and all("category" not in k and "suffix" not in k and "length" in k for k in kept)
    assert sorted(r.name for r in few.collect()) == ["y.pdb", "z.txt"]
    reader = folders.FolderReader(root)
    assert list(reader.pushFilters([folders.EqualTo(("category",), "a"), folders.In(("category",), ("a", "b")), folders.EqualTo(("length",), 1)])) == [folders.EqualTo(("length",), 1)]
    assert [p.folder for p in reader.partitions()] == ["a"]


def test_hashes_of_listed_files(spark, root):
    import hashlib

    listed = [f"{root}/a/x.cif", f"file://{root}/top.pdb", f"{root}/b/x.cif", f"{root}/gone", f"{root}/a", None, f"{root}/a/x.cif"]
    got = [tuple(r) for r in folders.hashes(spark.createDataFrame([(p,) for p in listed], "path string")).collect()]
    sha = lambda n: hashlib.sha256(b"x" * n).hexdigest()
    assert sorted(got) == sorted([(listed[0], 3, sha(3)), (listed[0], 3, sha(3)), (listed[1], 2, sha(2)), (listed[2], 0, sha(0)), (listed[3], None, ""), (listed[4], None, "")], key=lambda r: r[0])


def test_store_copies_once(spark, root, tmp_path):
    at = str(tmp_path / "store")
    rows = [("a/x.cif", "k1"), ("top.pdb", "k2"), ("a/x.cif", "k1"), ("gone", "k3"), ("a/z.txt", None)]
    df = spark.createDataFrame([(f"{root}/{s}", p and f"{p[:2]}/{p}/part") for s, p in rows], "source string, store_path string").repartition(4)
    first = folders.store(df, at)
    assert {k: first[k] for k in ("copied", "bytes", "missing")} == {"copied": 2, "bytes": 5, "missing": 1} and first["present"] == 1
    assert folders.store(df, at) == {"copied": 0, "present": 3, "missing": 1, "bytes": 0}
    assert sorted(r.path[len(at) :] for r in folders.files(spark, at).where("name = 'part'").collect()) == ["/k1/k1/part", "/k2/k2/part"]
    assert not [n for n in os.listdir(at) if n.startswith("_copying")]


def test_a_killed_copy_leaves_nothing(spark, root, tmp_path, monkeypatch):
    """A copy that dies halfway lies beside the store; the job's end clears it away, and the next one makes the file."""
    at = str(tmp_path / "store")
    os.makedirs(at)

    def dies(source, to):
        with open(to, "wb") as out:
            out.write(b"h")
        raise OSError("killed")

    writer = folders.StoreWriter(at)
    with monkeypatch.context() as m:
        m.setattr(folders.shutil, "copyfile", dies)
        with pytest.raises(OSError, match="killed"):
            writer.write(iter([{"source": f"{root}/a/x.cif", "store_path": "k1/part"}]))
    assert os.listdir(at) == [os.path.basename(writer.aside)] and len(os.listdir(writer.aside)) == 1
    writer.abort([None])
    assert os.listdir(at) == []
    again = folders.StoreWriter(at)
    again.commit([again.write(iter([{"source": f"{root}/a/x.cif", "store_path": "k1/part"}]))])
    assert os.path.getsize(f"{at}/k1/part") == 3


DOCUMENT = """Target: T1001 first
 # note
#  Model  GR#  GDT_TS  Comment
1   T1001TS100_1   100   50.5   a b c
T1001TS200_2 200 -
no row

Target:  T1002
2 T1002TS100_1 100 7
## Rank Model Gr.Code
3 TSX 9
"""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_pieces_parse_like_the_whole(spark, end):
    rnd = random.Random(3)
    docs = {"a": DOCUMENT.replace("\n", end), "b": DOCUMENT.replace("\n", end).strip(), "none": None, "empty": "", "headless": "1 TS 5"}
    whole = spark.createDataFrame(list(docs.items()), "file string, text string")
    want = sorted(map(str, texts.score_table(whole, "prot_domains").collect()))
    pieces = []
    for file, text in docs.items():
        at, pos = 0, 0
        while text and at < len(text):
            n = rnd.choice([0, 1, 2, 5, 40])
            pieces.append((file, pos, text[at : at + n] if n else None))
            at, pos = at + n, pos + 1
    rnd.shuffle(pieces)
    split = spark.createDataFrame(pieces, "file string, pos int, text string")
    got = sorted(map(str, sections.score_table_pieces(split, "prot_domains").collect()))
    assert got == want and len(got) == 8


def test_pieces_keep_the_type_of_the_file(spark):
    """The function's schema follows its argument's; columns that are missing are refused when the query is analysed."""
    df = spark.createDataFrame([(7, 0, "#Model\nTS")], "file long, pos int, text string")
    out = sections.score_table_pieces(df, "prot_domains")
    assert dict(out.dtypes)["file"] == "bigint" and out.first().file == 7
    with pytest.raises(Exception, match="file, pos and text"):
        spark.sql("SELECT * FROM podium_sections(TABLE({df}))", df=df.drop("pos"))


def test_a_document_too_large_for_one_row(spark):
    """A hundred thousand lines in as many pieces, header in the first."""
    head = spark.createDataFrame([("big", -1, "Target: T1\n# Model GDT_TS\n")], "file string, pos long, text string")
    body = spark.range(100_000).select(F.lit("big").alias("file"), F.col("id").alias("pos"), F.concat(F.lit("T1TS"), F.col("id").cast("string"), F.lit("_1 "), (F.col("id") % 100).cast("string"), F.lit("\n")).alias("text"))
    out = sections.score_table_pieces(head.unionByName(body), "prot_domains")
    assert tuple(out.agg(F.count("*"), F.sum("primary_score"), F.max("n"), F.count_distinct("target_id")).first()) == (100_000, 100_000 * 49.5, 100_001, 1)
