"""Programs run on rows, and facts about files joined to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_commands(rows: DataFrame, *, key: str = "key", timeout: float = 300.0) -> DataFrame:
    """(key, command: array<string>) -> (key, exit_code, stdout, stderr); null exit code where there is no such program or it ran out of time."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import subprocess

        for pdf in batches:
            out = []
            for command in pdf["command"]:
                try:
                    p = subprocess.run(list(command), capture_output=True, text=True, timeout=timeout)  # noqa: S603
                    out.append((p.returncode, p.stdout, p.stderr))
                except (OSError, subprocess.TimeoutExpired) as e:
                    out.append((None, "", str(e)))
            pdf = pdf[[key]].copy()
            pdf["exit_code"], pdf["stdout"], pdf["stderr"] = zip(*out, strict=True) if out else ([], [], [])
            pdf["exit_code"] = pdf["exit_code"].astype("Int32")
            yield pdf

    return rows.select(key, "command").mapInPandas(run, f"{key} {kind}, exit_code int, stdout string, stderr string")


def with_files(rows: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows with the existence and size of the file that a column names."""
    have = files.select(F.col("path").alias(column), F.col("length").alias(f"{column}_bytes"))
    return rows.join(have, column, "left").withColumn(f"{column}_exists", F.col(f"{column}_bytes").isNotNull())


def newest_source(files: DataFrame, specs: DataFrame, priority: list[str]) -> DataFrame:
    """One file for each run: of those in its folder, the first kind by priority, then path."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.element_at(F.split("path", "/"), -1))
    own = files.select("path", place.alias("place"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("run_dir")).where("place > 0")
    return specs.join(own, "run_dir").groupBy("run_id").agg(F.min_by("path", F.struct("place", "path")).alias("source"))
