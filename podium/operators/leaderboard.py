"""Leaderboards over fixed sets of targets, where work that is missing counts as zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def group_leaderboard(rows: DataFrame, *, server_suffix: str | None = None, all_targets: bool = False) -> DataFrame:
    """(category, grp, target, metric, score, ord) -> a ranked row for each group of a category.

    A group has its best score of each target, and zero for targets of the category that it lacks. Rows
    with an empty key part are left out, from the denominator too unless all_targets. server_suffix:
    only groups whose name ends in it are ranked, over the targets of all groups. Rank is the position
    by the mean to six decimals, then the number of targets, then first arrival.
    """
    named = rows.where("category <> '' and grp <> '' and target <> ''")
    eligible = (rows if all_targets else named).select("category", "target").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("eligible"))
    own = named.where(F.col("grp").endswith(server_suffix)) if server_suffix else named
    best = own.groupBy("category", "grp", "target").agg(F.max("score").alias("best"), F.min("ord").alias("ord"), F.collect_set("metric").alias("metrics"))
    groups = best.groupBy("category", "grp").agg(
        F.count(F.lit(1)).alias("submitted"), F.sum("best").alias("total"), F.median("best").alias("median"), F.max("best").alias("best"), F.min("ord").alias("ord"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("metrics")))), ",").alias("metrics")
    )
    joined = groups.join(F.broadcast(eligible), "category")  # a row for each category
    six = lambda c: F.round(c, 6)
    out = joined.select("category", "grp", "eligible", "submitted", (F.col("eligible") - F.col("submitted")).alias("missing"), six(F.col("total") / F.col("eligible")).alias("mean_fixed"), six(F.col("total") / F.col("submitted")).alias("mean_submitted"), F.col("median").alias("median_submitted"), F.col("best").alias("best_score"), "metrics", "ord")
    order = W.partitionBy("category").orderBy(F.desc("mean_fixed"), F.desc("submitted"), "ord")
    return out.withColumn("rank", F.row_number().over(order)).drop("ord")


def top(ranked: DataFrame, n: int, *, by: str = "category") -> DataFrame:
    """The first n of each category for display."""
    return ranked.where(F.col("rank") <= n)


def target_stats(rows: DataFrame, *, server_suffix: str = "s") -> DataFrame:
    """For each (category, target): rows, groups, server groups, and the best group with its score, the first on ties."""
    # groups first, so that distinct ones are counted without a copy of the rows for each count
    server = F.col("grp").endswith(server_suffix)
    groups = rows.groupBy("category", "target", "grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("score", (-F.col("ord")).alias("minus"))).alias("first"), F.collect_set("metric").alias("metrics"))
    return groups.groupBy("category", "target").agg(
        F.sum("n").alias("scored_rows"),
        F.count("grp").alias("group_count"),
        F.count_if(server).alias("server_group_count"),
        F.max_by("grp", "first").alias("best_group"),
        F.max("first.score").alias("best_score"),
        F.max_by(F.when(server, F.col("grp")), F.when(server, F.col("first"))).alias("server_best_group"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("metrics")))), ",").alias("metrics"),
    )


def unresolved(rows: DataFrame) -> DataFrame:
    """Rows without a group or target, by what is known of them, with their number and first example."""
    return rows.where("coalesce(grp, '') = '' or coalesce(target, '') = ''").groupBy("category", "target", "metric", "reason").agg(F.count(F.lit(1)).alias("row_count"), F.min_by("example", "ord").alias("example"))


def run_leaderboard(scores: DataFrame, targets: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Score rows of runs over eligible targets -> a row for each (run, track), ranked within the track.

    Scores are summed over eligible rows and divided by the eligible targets of the track. A run that
    isn't eligible itself, has unavailable metrics or nothing scored is not ranked: it sorts last, and
    takes a place but gets no rank.
    """
    eligible = targets.where(F.lower("rank_eligible") == "true").groupBy("track").agg(F.count(F.lit(1)).alias("eligible"))
    ranked = F.lower("rank_eligible") == "true"
    with_status = lambda *names: F.count_if(ranked & F.col("status").isin(*names))
    policy = F.coalesce(F.nullif("selected_model_policy", F.lit("")), F.lit("first_output_only"))
    per = scores.groupBy("run_id", "track").agg(
        F.sum(F.when(ranked, F.coalesce("score", F.lit(0.0))).otherwise(0.0)).alias("total"),
        F.count_if(ranked).alias("rows"),
        with_status("ok").alias("ok"),
        with_status("missing_prediction").alias("missing"),
        with_status("partial_candidates").alias("partial"),
        with_status("metric_failed", "metric_unparseable", "missing_reference", "partial_candidates").alias("failed"),
        with_status("metric_unavailable").alias("unavailable"),
        F.array_join(F.array_sort(F.collect_set(policy)), ",").alias("policy"),
        F.min_by("prediction_path", F.when(F.col("prediction_path") != "", F.col("ord"))).alias("first_path"),
    )
    per = per.join(F.broadcast(eligible), "track", "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))
    flag = F.lit(True)
    if runs is not None:
        per = per.join(runs.select("run_id", F.col("rank_eligible").alias("run_eligible")), "run_id", "left")
        flag = F.coalesce("run_eligible", F.lit(True))
    status = rank_status(F.col("eligible"), F.col("unavailable"), F.col("ok"), flag, F.col("policy"))
    out = per.select(
        "run_id", "track", status.alias("rank_status"), F.col("policy").alias("selected_model_policy"),
        F.round(F.when(F.col("eligible") > 0, F.col("total") / F.col("eligible")).otherwise(0.0), 6).alias("mean_score"),
        F.col("eligible").alias("eligible_targets"), F.col("ok").alias("ok_targets"), (F.col("missing") + F.greatest(F.col("eligible") - F.col("rows"), F.lit(0))).alias("missing_targets"),
        F.col("failed").alias("failed_targets"), F.col("partial").alias("partial_targets"), F.coalesce("first_path", F.lit("")).alias("artifact_path"),
    )
    place = F.row_number().over(W.partitionBy("track").orderBy(F.col("rank_status") != "ranked", F.desc("mean_score"), F.desc("ok_targets"), "run_id"))
    return out.withColumn("rank", F.when(F.col("rank_status") == "ranked", place))


def rank_status(eligible, unavailable, ok, run_eligible, policy):
    """Why a run is or isn't ranked; a run that isn't eligible is told before anything else."""
    return (
        F.when(~run_eligible, "unranked:run_not_rank_eligible")
        .when(eligible == 0, "unranked:no_eligible_targets")
        .when(unavailable > 0, "unranked:metric_unavailable")
        .when(ok == 0, "pending:no_scored_targets")
        .when(~policy.isin("", "first_output_only"), F.concat(F.lit("attack:"), policy))
        .otherwise("ranked")
    )


def coverage(targets: DataFrame, *, by: str = "track") -> DataFrame:
    """Targets, eligible ones and those with a reference."""
    return targets.groupBy(by).agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.lower("rank_eligible") == "true").alias("eligible"), F.count_if(F.col("reference_status") == "available").alias("with_reference"), F.count_distinct("reference_status").alias("statuses"))


def deltas(scores: DataFrame, run_id: str, baseline: str) -> DataFrame:
    """Two runs side by side: score, baseline score, delta and statuses for each target of either."""
    side = lambda run, s: scores.where(F.col("run_id") == run).select("track", "target_id", F.col("score").alias(f"{s}_score"), F.col("status").alias(f"{s}_status"))
    both = side(run_id, "new").join(side(baseline, "base"), ["track", "target_id"], "full_outer")
    new, base = F.coalesce("new_score", F.lit(0.0)), F.coalesce("base_score", F.lit(0.0))
    none = lambda c: F.coalesce(c, F.lit("absent"))
    return both.select("track", "target_id", new.alias("new_score"), base.alias("base_score"), F.round(new - base, 6).alias("delta"), F.concat_ws("->", none("base_status"), none("new_status")).alias("transition"))


def delta_summary(delta: DataFrame) -> DataFrame:
    return delta.groupBy("track").agg(
        F.count_if(F.expr("delta > 0")).alias("improved"), F.count_if(F.expr("delta < 0")).alias("regressed"), F.count_if(F.expr("delta = 0")).alias("unchanged"),
        F.count_if(F.expr("new_score > 0 and base_score = 0")).alias("gained_nonzero"), F.count_if(F.expr("new_score = 0 and base_score > 0")).alias("lost_nonzero"), F.round(F.avg("delta"), 6).alias("mean_delta"),
    )


def transitions(delta: DataFrame) -> DataFrame:
    return delta.groupBy("track", "transition").agg(F.count(F.lit(1)).alias("n"))


def top_changes(delta: DataFrame, n: int) -> DataFrame:
    """The n largest gains and losses; ties by track and target in both directions."""
    side = lambda name, keep, order: delta.where(keep).orderBy(order, "track", "target_id").limit(n).select(F.lit(name).alias("side"), "track", "target_id", "delta")
    return side("gain", "delta > 0", F.desc("delta")).unionByName(side("loss", "delta < 0", F.asc("delta")))


def winner_gap(ranked: DataFrame, runs: DataFrame) -> DataFrame:
    """Target-weighted means of the best group and the best run over all tracks; gap, level and multiplier."""
    pair = ranked.join(runs, "track")
    w = F.sum("eligible")
    out = pair.agg((F.sum(F.col("winner_mean") * F.col("eligible")) / w).alias("winner"), (F.sum(F.col("run_mean") * F.col("eligible")) / w).alias("run"))
    return out.select(F.round("winner", 6).alias("winner"), F.round("run", 6).alias("run"), F.round(F.col("winner") - F.col("run"), 6).alias("gap"), F.round(F.try_divide("run", "winner"), 6).alias("level"), F.round(F.try_divide("winner", "run"), 6).alias("multiplier"))


def readout(scores: DataFrame) -> DataFrame:
    """One pass over a run's score rows: counts by outcome, and diagnostic ids, for each track."""
    ids = lambda when: F.size(F.array_sort(F.collect_set(F.when(when, F.col("target_id")))))
    return scores.groupBy("run_id", "track").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("status = 'ok'")).alias("ok"), F.count_if(F.expr("status = 'ok' and score > 0")).alias("nonzero"), F.count_if(F.expr("status <> 'ok'")).alias("not_ok"),
        F.count_if(F.expr("prediction_path = ''")).alias("without_path"), ids(F.col("status") == "metric_failed").cast("long").alias("failed_ids"), F.round(F.coalesce(F.sum("score") / F.count(F.lit(1)), F.lit(0.0)), 6).alias("mean"),
    )


def confidence_means(files: DataFrame, keys: tuple[str, ...] = ("plddt", "ptm", "iptm")) -> DataFrame:
    """By run: files (run_id, body), how many of them could be read as objects, and the mean of each key over those that give it as a number."""
    fields = F.from_json("body", "map<string,string>")
    told = files.select("run_id", fields.alias("f"))
    mean = lambda k: F.round(F.avg(F.element_at("f", F.lit(k)).try_cast("double")), 6).alias(f"mean_{k}")
    return told.groupBy("run_id").agg(F.count(F.lit(1)).alias("files"), F.count("f").alias("read"), *map(mean, keys))
