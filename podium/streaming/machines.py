"""Operators with state and timers of their own: runs that fall silent, tasks that become complete.

Both keep one small row for each key in a state store on disk, drop it by timer, and give the same answer whatever way lines are cut into batches, as
long as none is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ranks import importable

if TYPE_CHECKING:
    import pandas as pd

STORE = "spark.sql.streaming.stateStore.providerClass"


def with_store(spark: SparkSession) -> None:
    """State with timers needs the store on disk; a provider that was chosen already stays."""
    importable(spark)
    if "RocksDB" not in spark.conf.get(STORE):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def frame(**columns) -> pd.DataFrame:
    import pandas as pd

    return pd.DataFrame({k: [v] for k, v in columns.items()})


class Silence(StatefulProcessor):
    """The last line of each run by ord; an open run without a newer one for ``limit`` ms is overdue; a closed run is forgotten after ``keep`` ms."""

    OUT = "run_id string, status string, ord long, late long, overdue boolean"

    def __init__(self, closed: tuple[str, ...], limit: int, keep: int | None):
        self.closed, self.limit, self.keep = closed, limit, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, ord long, at long, late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        import pandas as pd

        lines = pd.concat(list(rows))
        top = lines.loc[lines["ord"].idxmax()]
        status, ord_, at, late = self.last.get() if self.last.exists() else (None, None, 0, 0)
        if ord_ is not None:
            late += int((lines["ord"] <= ord_).sum())
        if ord_ is None or top["ord"] > ord_:
            status, ord_ = top["status"], int(top["ord"])
        at = max(at, int(lines["at"].max()))
        self.last.update((status, ord_, at, late))
        self.set_timer(status, at)
        yield frame(run_id=key[0], status=status, ord=ord_, late=late, overdue=False)

    def set_timer(self, status: str, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        wait = self.keep if status in self.closed else self.limit
        if wait is not None:
            self.handle.registerTimer(at + wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            status, ord_, _, late = self.last.get()
            if status in self.closed:
                self.last.clear()
            else:
                yield frame(run_id=key[0], status=status, ord=ord_, late=late, overdue=True)

    def close(self) -> None:
        pass


def silence(lines: DataFrame, *, closed: tuple[str, ...] = ("done", "failed"), limit: str = "1 hour", keep: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Lines (run_id, status, ord, ts) of a stream -> (run_id, status, ord, late, overdue), a row for each change and each timeout.

    The line with the largest ord counts, whenever it comes; older ones that come later are counted in ``late``. Time is that of the lines, as far
    as the watermark (``late`` behind the newest line) has come. Without ``keep`` closed runs are never forgotten; with it, a line that comes after begins a run anew. Null run ids are left out.
    """
    with_store(lines.sparkSession)
    ms = lambda text: int(lines.sparkSession.sql(f"SELECT cast(INTERVAL '{text}' AS INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds() * 1000)
    rows = lines.where("run_id is not null").withWatermark("ts", late).select("run_id", "status", "ord", "ts", F.unix_millis("ts").alias("at"))
    machine = Silence(closed, ms(limit), None if keep is None else ms(keep))
    return rows.groupBy("run_id").transformWithStateInPandas(machine, Silence.OUT, "Update", "EventTime")


class Gate(StatefulProcessor):
    """Counts the files of a task; says merge when all have come, stop when they don't belong together, wait when time is up."""

    OUT = "task string, files int, action string"

    def __init__(self, expected: int, limit: int):
        self.expected, self.limit = expected, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "files int, benchmark string, told string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        import pandas as pd

        new = pd.concat(list(rows))
        files, benchmark, told = self.seen.get() if self.seen.exists() else (0, new["benchmark"].iloc[0], "")
        if not self.seen.exists():
            self.handle.registerTimer(int(new["at"].min()) + self.limit)
        files += len(new)
        action = "stop:incompatible" if told.startswith("stop") or (new["benchmark"] != benchmark).any() else "merge" if files >= self.expected else ""
        self.seen.update((files, benchmark, action))
        if action != told:
            yield frame(task=key[0], files=files, action=action)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            files, _, told = self.seen.get()
            self.seen.clear()
            if not told:
                yield frame(task=key[0], files=files, action="wait:incomplete")

    def close(self) -> None:
        pass


def complete_tasks(files: DataFrame, expected: int, *, limit: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Files (task, path, benchmark, ts) of a stream -> (task, files, action): merge, stop:incompatible or wait:incomplete, once each.

    A path counts once within the watermark. What is known of a task is dropped ``limit`` after its first file, and what is known of paths with the
    watermark, so that state follows the tasks in flight and not all that ever came. Null tasks are left out.
    """
    with_store(files.sparkSession)
    span = files.sparkSession.sql(f"SELECT cast(INTERVAL '{limit}' AS INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds() * 1000
    once = files.where("task is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["task", "path"])
    rows = once.select("task", F.coalesce("benchmark", F.lit("")).alias("benchmark"), "ts", F.unix_millis("ts").alias("at"))
    return rows.groupBy("task").transformWithStateInPandas(Gate(expected, int(span)), Gate.OUT, "Append", "EventTime")


def drained(out: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> DataFrame:
    """All that a stream has now, written as Parquet by batch (a repeated batch replaces itself), then read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).option("recursiveFileLookup", True).parquet(path)
