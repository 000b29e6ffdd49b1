"""Run registers, status logs, readiness checks and decision ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import budget_tier, candidate_count, ladder
from .lookups import upsert


def latest_status(log: DataFrame) -> DataFrame:
    """The last line of each run, by line and not by time."""
    return log.groupBy("run_id").agg(F.max_by("status", "ord").alias("status"), F.max("ord").alias("ord"), F.count(F.lit(1)).alias("lines"))


def run_rows(specs: DataFrame, log: DataFrame) -> DataFrame:
    """Specs with their latest status; runs without a line are pending."""
    return specs.join(latest_status(log).select("run_id", "status"), "run_id", "left").na.fill("pending", ["status"])


def tiers(specs: DataFrame) -> DataFrame:
    """Candidates and tier of each spec; a declared dev tier is overridden by what the spec amounts to."""
    n = F.greatest(candidate_count(F.col("seeds"), F.col("sample")), F.coalesce("declared", F.lit(0)))
    out = specs.withColumn("candidates", n).withColumn("inferred", budget_tier(F.col("candidates"), F.col("policy"), F.col("rank_eligible"), F.col("fixed_budget")))
    asked = F.nullif(F.col("requested"), F.lit(""))
    return out.withColumn("tier", F.when(asked.isNull() | ((asked == "dev") & (F.col("inferred") != "dev")), F.col("inferred")).otherwise(asked))


def runnable(rows: DataFrame) -> DataFrame:
    """Pending and failed runs in the order of registration, unless one is running."""
    busy = rows.agg(F.coalesce(F.bool_or(F.col("status") == "running"), F.lit(False)).alias("busy"))
    return rows.where(F.col("status").isin("pending", "failed")).join(F.broadcast(busy)).where("not busy").drop("busy")


def register(specs: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(specs, new, "run_id")


def preflight(results: DataFrame, requested: DataFrame) -> DataFrame:
    """Results by kind; requested runs that aren't there count as missing."""
    full = requested.join(results, "run_id", "left").withColumn("result", F.coalesce("result", F.lit("missing_run")))
    return full.groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.startswith("result", F.lit("blocked"))).alias("blocked"))


def shard_check(shards: DataFrame, tasks: DataFrame, observed: DataFrame) -> DataFrame:
    """Per merged run: do shards agree on what they must share, and is each task's work complete?"""
    same = shards.groupBy("merged").agg(*((F.count_distinct(c) == 1).alias(f"same_{c}") for c in ("benchmark", "manifest", "policy")), F.sum("expected_per_task").alias("expected"))
    have = tasks.join(observed, ["merged", "task"], "left").join(same.select("merged", "expected"), "merged")
    gap = F.greatest(F.col("expected") - F.coalesce("files", F.lit(0)), F.lit(0))
    work = have.groupBy("merged").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(gap > 0).alias("incomplete_tasks"), F.sum(gap).alias("missing_files"))
    out = same.join(work, "merged")
    return out.withColumn("action", ladder((~(F.col("same_benchmark") & F.col("same_manifest") & F.col("same_policy")), "stop:incompatible"), (F.col("incomplete_tasks") > 0, "wait:incomplete"), otherwise="merge"))


def merged_files(shards: DataFrame) -> DataFrame:
    """Files of all shards under one root; a path that two shards have stops the query."""
    per = shards.groupBy("rel_path").agg(F.count_distinct("shard").alias("n"), F.min("shard").alias("shard"), F.max("bytes").alias("bytes"))
    return per.withColumn("shard", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("collision: "), "rel_path"))).otherwise(F.col("shard"))).drop("n")


def merged_runs(specs: DataFrame, files: DataFrame) -> DataFrame:
    """One run for each merged id: seeds of its shards in order of arrival, candidates, files, and what speaks against the merge.

    specs: (merged, shard, ord, seeds, sample, benchmark, model, manifest, policy); files: (merged, shard, rel_path). The first problem is told: a field that
    the shards don't share, a shard without files, or paths that several shards have. Without seeds the run has seed 101.
    """
    same = ("benchmark", "model", "manifest", "policy", "sample")
    per = specs.groupBy("merged").agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"n_{c}") for c in same), F.count_distinct("shard").alias("shards"), F.min("sample").alias("sample"))
    each = specs.select("merged", "ord", F.posexplode(F.split(F.coalesce("seeds", F.lit("")), ",")).alias("pos", "seed")).withColumn("seed", F.trim("seed")).where("seed <> ''")
    first = each.groupBy("merged", "seed").agg(F.min(F.struct("ord", "pos")).alias("at"))
    seeds = first.groupBy("merged").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "seed"))), lambda s: s["seed"]).alias("seeds"))
    paths = files.groupBy("merged", "rel_path").agg(F.count_distinct("shard").alias("n")).groupBy("merged").agg(F.sum("n").alias("files"), F.count_if(F.col("n") > 1).alias("collisions"))
    with_files = files.join(specs.select("merged", "shard").distinct(), ["merged", "shard"], "left_semi").groupBy("merged").agg(F.count_distinct("shard").alias("delivered"))
    out = per.join(seeds, "merged", "left").join(paths, "merged", "left").join(with_files, "merged", "left")
    all_seeds = F.coalesce("seeds", F.array(F.lit("101")))
    problem = ladder(*((F.col(f"n_{c}") > 1, f"mixed_{c}") for c in same), (F.coalesce("delivered", F.lit(0)) < F.col("shards"), "shard_without_files"), (F.col("collisions") > 0, "path_collision"), otherwise="none")
    return out.select("merged", "shards", F.array_join(all_seeds, ",").alias("seeds"), (F.size(all_seeds) * F.greatest(F.coalesce(F.col("sample").cast("int"), F.lit(1)), F.lit(1))).alias("candidates"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("collisions", F.lit(0)).alias("collisions"), problem.alias("problem"))


def merged_listing(merged: DataFrame, files: DataFrame) -> DataFrame:
    """(merged, rel_path, shard) of the runs that can be merged."""
    return files.join(merged.where("problem = 'none'").select("merged"), "merged", "left_semi").select("merged", "rel_path", "shard").distinct()


def branch(summary: DataFrame, *, floor: float, probe_floor: float, min_nonzero: int) -> DataFrame:
    """The next step from a run's summary, told by the first rule that holds."""
    return summary.withColumn(
        "next_branch",
        ladder((F.col("not_ok") > F.col("ok"), "repair_inputs"), (F.col("mean") >= floor, "promote"), (F.col("mean") >= probe_floor, "probe_exact"), (F.col("nonzero") < min_nonzero, "recover_sequences"), otherwise="diagnose"),
    )


def plan(branches: DataFrame) -> DataFrame:
    """Launch steps by branch, from a fixed table."""
    steps = branches.sparkSession.createDataFrame([("promote", 1, "merge"), ("promote", 2, "replay"), ("probe_exact", 1, "probe"), ("repair_inputs", 1, "repair"), ("repair_inputs", 2, "rerun"), ("recover_sequences", 1, "recover"), ("diagnose", 1, "report")], "next_branch string, step int, launch string")
    return branches.join(F.broadcast(steps), "next_branch")


def guard(variants: DataFrame, comparators: DataFrame, columns: list[str], *, most: int = 25) -> DataFrame:
    """For each variant, what differs from its comparator, as a bounded list of messages."""
    other = comparators.select("run_id", *(F.col(c).alias(f"__{c}") for c in columns))
    both = variants.join(other, "run_id", "left")
    failed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(f"differs:{c}")) for c in columns)))
    return both.select("run_id", F.array_join(F.slice(failed, 1, most), ";").alias("failures"), F.size(failed).alias("n_failures"))


def validate(documents: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Messages of the rules (message: SQL condition) that each document breaks."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(cond), F.lit(False)), F.lit(msg)) for msg, cond in rules.items())))
    return documents.withColumn("failures", F.array_join(broken, ";")).withColumn("ok", F.size(broken) == 0)
