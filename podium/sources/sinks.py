"""Writers: delimited tables, documents, Markdown, hash manifests and an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def delimited(df: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """Fixed columns in order; missing ones and nulls are empty."""
    out = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))
    out.write.mode("overwrite").options(sep=sep, header=True, quote='"', escape='"', emptyValue="").csv(path)


def documents(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, columns: list[str], *, most: int = 1000) -> str:
    """A table of a short result (at most ``most`` rows), bars escaped; says so if there are none, or more."""
    rows = df.select(*(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")).alias(c) for c in columns)).limit(most + 1).collect()
    if not rows:
        return "_No rows._"
    line = lambda cells: f"| {' | '.join(cells)} |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line(list(r)) for r in rows[:most]), *([f"_Only the first {most} rows are shown._"] if len(rows) > most else [])])


def hash_manifest(files: DataFrame, root: str) -> DataFrame:
    """(path, bytes, sha256) of listed files below a folder; what is listed but isn't there has an empty hash.

    The folder is read where its files are listed, and paths meet in a join: neither goes through the driver.
    """
    bare = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/*", "/")
    read = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    hashes = read.select(bare("path").alias("at"), F.sha2("content", 256).alias("sha256"))
    joined = files.join(hashes, bare(files["path"]) == F.col("at"), "left")
    return joined.select("path", F.col("length").alias("bytes"), F.when(F.col("length") > 0, F.coalesce("sha256", F.lit(""))).otherwise("").alias("sha256"))


def append_status(spark: SparkSession, path: str, *, run_id: str, status: str, benchmark: str, message: str = "", ord: int) -> None:
    """One line more in an append-only log with a single writer; lines are ordered by ord."""
    spark.createDataFrame([(ord, run_id, status, benchmark, message)], "ord long, run_id string, status string, benchmark string, message string").write.mode("append").parquet(path)
