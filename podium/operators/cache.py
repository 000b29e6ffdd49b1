"""A cache of computed inputs, keyed by the hash of the exact sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduced(rows: DataFrame) -> DataFrame:
    """One record for each sequence: more paths, then a hash, then earlier arrival."""
    best = F.struct("n_paths", "has_hash", -F.col("ord"))
    return rows.withColumn("key", F.sha2("sequence", 256)).groupBy("key").agg(F.max_by("ord", best).alias("ord"), F.max_by("n_paths", best).alias("n_paths"), F.max_by("has_hash", best).alias("has_hash"), F.count(F.lit(1)).alias("copies"), F.max_by("source_run", best).alias("source_run"), F.max_by("bytes", best).alias("bytes"))


def summary(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("records"), F.sum("n_paths").cast("long").alias("paths"), F.count_if(F.expr("has_hash")).alias("hashed"), F.sum("bytes").alias("bytes"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.round(F.avg("bytes"), 6).alias("mean"))


def top_sources(index: DataFrame, n: int = 10) -> DataFrame:
    return index.groupBy("source_run").agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "source_run").limit(n)


def reuse(chains: DataFrame, index: DataFrame) -> DataFrame:
    """Chains with what the cache has for them; chains that have usable paths keep them."""
    keyed = chains.withColumn("key", F.sha2("sequence", 256)).join(index.select("key", F.col("ord").alias("source_ord"), F.col("n_paths").alias("cached_paths"), "has_hash"), "key", "left")
    status = F.when(F.col("own_paths") > 0, "existing").when(F.col("cached_paths").isNull(), "missing").when(~F.col("has_hash"), "stale").otherwise("reused")
    return keyed.withColumn("status", status).select("ord", "task", "residues", "status", F.when(F.col("status") == "reused", F.col("source_ord")).alias("source_ord"))


def reuse_summary(rows: DataFrame) -> DataFrame:
    """Counts by status and the covered share, which is 1 where there is nothing to cover."""
    covered = F.count_if(F.col("status").isin("existing", "reused"))
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("chains"), covered.alias("covered"), F.count_if(F.expr("status = 'missing'")).alias("missing"), F.count_if(F.expr("status = 'stale'")).alias("stale"), F.round(F.coalesce(F.try_divide(covered, F.count(F.lit(1))), F.lit(1.0)), 6).alias("coverage"))


def missing_work(rows: DataFrame, n: int) -> DataFrame:
    """Tasks with most missing residues."""
    return rows.where("status = 'missing'").groupBy("task").agg(F.count(F.lit(1)).alias("chains"), F.sum("residues").alias("residues"), F.max("residues").alias("longest")).orderBy(F.desc("residues"), F.desc("chains"), "task").limit(n)


def checks(summaries: DataFrame, *, complete: bool, least: float) -> DataFrame:
    ok = (F.col("coverage") >= least) & (F.lit(not complete) | (F.col("missing") == 0))
    return summaries.withColumn("passes", ok)


def store_paths(index: DataFrame, root: str) -> DataFrame:
    """Content-addressed places: two letters of the hash, the hash, the kind."""
    return index.withColumn("store_path", F.concat_ws("/", F.lit(root), F.substring("key", 1, 2), F.col("key"), F.concat(F.lit("part."), F.substring("key", 1, 12), F.lit(".a3m"))))
