"""Streams with state: the same answers as batches, bounded state, restarts and repeated batches."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from podium.operators import lookups
from podium.streaming import machines, status

LINES = "run_id string, status string, ord long, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def feed(spark, folder, rows, schema):
    """One more file; the stream takes them by name."""
    n = len(glob.glob(f"{folder}/*.parquet"))
    made = f"{folder}-{n}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(made)
    os.makedirs(folder, exist_ok=True)
    os.rename(glob.glob(f"{made}/part-*.parquet")[0], f"{folder}/{n:04}.parquet")


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_silence(spark, tmp_path):
    """Late lines don't change the status; an open run falls overdue once, a later line wakes it, a closed one is forgotten."""
    folder = str(tmp_path / "lines")
    batches = [
        [("a", "pending", 1, at(0)), ("b", "pending", 2, at(1)), ("c", "running", 9, at(1)), (None, "running", 3, at(1))],
        [("a", "running", 5, at(5)), ("b", "done", 6, at(6)), ("c", "pending", 4, at(7))],  # c: an old line that comes late
        [("z", "pending", 20, at(200))],  # time passes
        [("a", "running", 30, at(201)), ("b", "pending", 31, at(202))],  # a wakes, b begins anew
        [("z", "done", 40, at(300))],
    ]
    out = []
    for rows in batches:
        feed(spark, folder, rows, LINES)
        stream = machines.silence(read(spark, folder, LINES), closed=("done",), limit="1 hour", keep="2 hours", late="10 minutes")
        got = machines.drained(stream, str(tmp_path / "out"), str(tmp_path / "state"), mode="update")
        now = sorted(map(tuple, got.collect()))
        out.append([r for r in now if r not in sum(out, [])])
    assert out[0] == [("a", "pending", 1, 0, False), ("b", "pending", 2, 0, False), ("c", "running", 9, 0, False)]
    assert out[1] == [("a", "running", 5, 0, False), ("b", "done", 6, 0, False), ("c", "running", 9, 1, False)]
    assert out[2] == [("a", "running", 5, 0, True), ("c", "running", 9, 1, True), ("z", "pending", 20, 0, False)]
    assert out[3] == [("a", "running", 30, 0, False), ("b", "pending", 31, 0, False)]
    assert out[4] == [("a", "running", 30, 0, True), ("b", "pending", 31, 0, True), ("z", "done", 40, 0, False)]


def test_complete_tasks(spark, tmp_path):
    """Merge when all files have come, repeats aside; stop where benchmarks differ; wait when time is up; then nothing is kept."""
    schema, folder = "task string, path string, benchmark string, ts timestamp", str(tmp_path / "files")
    batches = [
        [("a", "1", "x", at(0)), ("a", "1", "x", at(1)), ("b", "1", "x", at(1)), ("c", "1", "x", at(2)), (None, "1", "x", at(2))],
        [("a", "1", "x", at(3)), ("b", "2", "x", at(3)), ("c", "2", "y", at(4)), ("c", "3", "y", at(4))],
        [("a", "1", "x", at(5))],
        [("d", "1", "x", at(500))],
        [("d", "2", "x", at(510)), ("e", "1", "x", at(2000))],
        [("f", "1", "x", at(4000))],
    ]
    progress = None
    for rows in batches:
        feed(spark, folder, rows, schema)
        out = machines.complete_tasks(read(spark, folder, schema), 2, limit="1 hour", late="10 minutes")
        query = out.writeStream.outputMode("append").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"b{n}"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        progress = query.recentProgress[-1]
    got = sorted(map(tuple, spark.read.option("recursiveFileLookup", True).schema(machines.Gate.OUT).parquet(str(tmp_path / "out")).collect()))
    assert got == [("a", 1, "wait:incomplete"), ("b", 2, "merge"), ("c", 3, "stop:incompatible"), ("d", 2, "merge"), ("e", 1, "wait:incomplete")]
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) <= 4  # of the one task in flight


INDEX = "key string, ord long, n_paths int, has_hash boolean"


@pytest.fixture
def table(spark, tmp_path):
    folder = str(tmp_path / "in")

    def run(rows=None, *, stop_after_rows=False):
        if rows is not None:
            feed(spark, folder, rows, INDEX)

        def merge(old, new):
            return lookups.merge_preferred(old, new, "key").drop("side")

        status.upsert_into(read(spark, folder, INDEX), str(tmp_path / "table"), "key", merge, str(tmp_path / "state"), buckets=8).awaitTermination()
        return {r.key: (r.ord, r.n_paths, r.has_hash) for r in spark.read.parquet(str(tmp_path / "table/rows")).collect()}

    run.path = str(tmp_path / "table")
    run.state = str(tmp_path / "state")
    return run


def test_refresh(spark, table):
    assert table([("a", 1, 1, False), ("b", 2, 1, True), (None, 3, 1, True)]) == {"a": (1, 1, False), "b": (2, 1, True)}
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/rows/bucket=*/*.parquet")}
    assert len(before) == 2
    # a better row replaces, an equal one doesn't; the bucket of the key that isn't in the batch stays as it is
    assert table([("a", 4, 2, False), ("a", 5, 2, False)]) == {"a": (4, 2, False), "b": (2, 1, True)}
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/rows/bucket=*/*.parquet")}
    assert len(before.keys() & after.keys()) == 1
    # nothing new: nothing is written
    assert table() == {"a": (4, 2, False), "b": (2, 1, True)}
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/rows/bucket=*/*.parquet")} == after


def test_a_repeated_batch_changes_nothing(spark, table):
    """A job that died before it could say that a batch was done gets it again: with its number known it is left out, without, it is merged to the same rows."""
    rnd = random.Random(1)
    rows = lambda: [(f"k{rnd.randrange(12)}", rnd.randrange(1000), rnd.randrange(3), rnd.random() < 0.5) for _ in range(30)]
    table(rows())
    want = table(rows())
    os.remove(f"{table.state}/commits/1")
    for crc in glob.glob(f"{table.state}/commits/.1.crc"):
        os.remove(crc)
    files = sorted(glob.glob(f"{table.path}/rows/bucket=*/*.parquet"))
    assert table() == want and sorted(glob.glob(f"{table.path}/rows/bucket=*/*.parquet")) == files
    os.remove(f"{table.state}/commits/1")
    for crc in glob.glob(f"{table.state}/commits/.1.crc"):
        os.remove(crc)
    os.rmdir(f"{table.path}/_applied/1")
    assert table() == want
