"""Queries on leaderboards, scores and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import leaderboard as L
from ..operators import runs as R
from .registry import query

NORM = "CASE WHEN lower(metric) = 'rmsd' THEN 1 / (1 + greatest(raw, 0)) WHEN lower(metric) IN ('gdt_ts', 'gdt-ha', 'gdt_ha') OR raw > 1 THEN greatest(0, least(raw / 100, 1)) ELSE greatest(0, least(raw, 1)) END"
SCORED = f"scored AS (SELECT ord, category, grp, target, metric, {NORM} AS score FROM submissions)"


def scored(t):
    return t.submissions.withColumn("score", S.normalized(F.col("metric"), F.col("raw")))


def board_sql(groups: str, denominator: str = "SELECT category, count(DISTINCT target) AS eligible FROM scored GROUP BY 1") -> str:
    return f"""WITH {SCORED}, elig AS ({denominator}),
      best AS (SELECT category, grp, target, max(score) AS b, min(ord) AS ord FROM scored WHERE {groups} GROUP BY 1, 2, 3),
      mets AS (SELECT category, grp, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM scored WHERE {groups} GROUP BY 1, 2),
      per AS (SELECT category, grp, count(*) AS submitted, sum(b) AS total, median(b) AS med, max(b) AS mx, min(ord) AS ord FROM best GROUP BY 1, 2),
      full_ AS (SELECT per.category, per.grp, eligible, submitted, eligible - submitted AS missing, round(total / eligible, 6) AS mean_fixed, round(total / submitted, 6) AS mean_submitted, med AS median_submitted, mx AS best_score, metrics, ord
        FROM per JOIN elig USING (category) JOIN mets ON per.category = mets.category AND per.grp = mets.grp)
      SELECT category, grp, eligible, submitted, missing, mean_fixed, mean_submitted, median_submitted, best_score, metrics, CAST(row_number() OVER (PARTITION BY category ORDER BY mean_fixed DESC, submitted DESC, ord) AS INTEGER) AS rank FROM full_"""


@query("agg2_group_leaderboard", board_sql("true"), "submissions")
def _(t):
    return L.group_leaderboard(scored(t))


@query("agg3_server_leaderboard", board_sql("grp LIKE '%s'"), "submissions")
def _(t):
    return L.group_leaderboard(scored(t), server_suffix="s", all_targets=True)


@query("srt3_top_of_each_category", f"SELECT * FROM ({board_sql('true')}) WHERE rank <= 10", "submissions")
def _(t):
    return L.top(L.group_leaderboard(scored(t)), 10)


@query("agg1_count_by_value", "SELECT metric, count(*) AS n FROM submissions GROUP BY 1", "submissions")
def _(t):
    return L.counts(t.submissions, "metric")


@query("agg4_mean_and_median", f"WITH {SCORED} SELECT category, round(coalesce(avg(score), 0), 6) AS mean, round(median(score), 6) AS median FROM scored GROUP BY 1", "submissions")
def _(t):
    return scored(t).groupBy("category").agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean"), F.round(F.median("score"), 6).alias("median"))


@query(
    "agg5_target_stats",
    f"""WITH {SCORED} SELECT category, target, count(*) AS scored_rows, count(DISTINCT grp) AS group_count, count(DISTINCT CASE WHEN grp LIKE '%s' THEN grp END) AS server_group_count,
      arg_max(grp, (score, -ord)) AS best_group, max(score) AS best_score, arg_max(grp, (score, -ord)) FILTER (WHERE grp LIKE '%s') AS server_best_group, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM scored GROUP BY 1, 2""",
    "submissions",
)
def _(t):
    return L.target_stats(scored(t))


UNRESOLVED = "SELECT category, CASE WHEN ord % 13 = 0 THEN '' ELSE target END AS target, CASE WHEN ord % 7 = 0 THEN '' ELSE grp END AS grp, metric, ord, concat(target, 'TS', grp, '_1') AS example, CASE WHEN ord % 13 = 0 THEN 'no_target' ELSE 'no_group' END AS reason FROM submissions"


@query("agg6_unresolved", f"WITH u AS ({UNRESOLVED}) SELECT category, target, metric, reason, count(*) AS row_count, arg_min(example, ord) AS example FROM u WHERE target = '' OR grp = '' GROUP BY 1, 2, 3, 4", "submissions")
def _(t):
    rows = t.submissions.select("category", F.when(F.col("ord") % 13 == 0, "").otherwise(F.col("target")).alias("target"), F.when(F.col("ord") % 7 == 0, "").otherwise(F.col("grp")).alias("grp"), "metric", "ord", F.concat("target", F.lit("TS"), "grp", F.lit("_1")).alias("example"), F.when(F.col("ord") % 13 == 0, "no_target").otherwise("no_group").alias("reason"))
    return L.unresolved(rows)


RUNS_SQL = """WITH elig AS (SELECT track, count(*) AS eligible FROM run_targets WHERE rank_eligible = 'true' GROUP BY 1),
  per AS (SELECT run_id, track, sum(CASE WHEN rank_eligible = 'true' THEN score ELSE 0 END) AS total, count(*) FILTER (WHERE rank_eligible = 'true') AS n, count(*) FILTER (WHERE rank_eligible = 'true' AND status = 'ok') AS ok,
      count(*) FILTER (WHERE rank_eligible = 'true' AND status = 'missing_prediction') AS missing, count(*) FILTER (WHERE rank_eligible = 'true' AND status = 'partial_candidates') AS partial,
      count(*) FILTER (WHERE rank_eligible = 'true' AND status IN ('metric_failed', 'partial_candidates')) AS failed, string_agg(DISTINCT CASE WHEN selected_model_policy = '' THEN 'first_output_only' ELSE selected_model_policy END, ',') AS policy,
      coalesce(arg_min(prediction_path, ord) FILTER (WHERE prediction_path <> ''), '') AS artifact_path FROM run_scores GROUP BY 1, 2),
  full_ AS (SELECT run_id, track, CASE WHEN run_id = 'R5' THEN 'unranked:run_not_rank_eligible' WHEN eligible = 0 THEN 'unranked:no_eligible_targets' WHEN ok = 0 THEN 'pending:no_scored_targets' WHEN policy NOT IN ('', 'first_output_only') THEN concat('attack:', policy) ELSE 'ranked' END AS rank_status,
      policy AS selected_model_policy, round(total / eligible, 6) AS mean_score, eligible AS eligible_targets, ok AS ok_targets, missing + greatest(eligible - n, 0) AS missing_targets, failed AS failed_targets, partial AS partial_targets, artifact_path FROM per JOIN elig USING (track))
  SELECT *, CASE WHEN rank_status = 'ranked' THEN CAST(row_number() OVER (PARTITION BY track ORDER BY rank_status <> 'ranked', mean_score DESC, ok_targets DESC, run_id) AS INTEGER) END AS rank FROM full_"""


@query("agg7_run_leaderboard", RUNS_SQL, "run_scores run_targets")
def _(t):
    runs = t.run_scores.select("run_id").distinct().withColumn("rank_eligible", F.col("run_id") != "R5")
    return L.run_leaderboard(t.run_scores, t.run_targets, runs)


@query("win1_group_rank", f"SELECT category, grp, rank FROM ({board_sql('true')})", "submissions")
def _(t):
    return L.group_leaderboard(scored(t)).select("category", "grp", "rank")


@query("win2_run_rank", f"SELECT run_id, track, rank FROM ({RUNS_SQL})", "run_scores run_targets")
def _(t):
    runs = t.run_scores.select("run_id").distinct().withColumn("rank_eligible", F.col("run_id") != "R5")
    return L.run_leaderboard(t.run_scores, t.run_targets, runs).select("run_id", "track", "rank")


@query("prj13_rank_status", f"SELECT run_id, track, rank_status FROM ({RUNS_SQL})", "run_scores run_targets")
def _(t):
    runs = t.run_scores.select("run_id").distinct().withColumn("rank_eligible", F.col("run_id") != "R5")
    return L.run_leaderboard(t.run_scores, t.run_targets, runs).select("run_id", "track", "rank_status")


@query("agg8_coverage", "SELECT track, count(*) AS targets, count(*) FILTER (WHERE rank_eligible = 'true') AS eligible, count(*) FILTER (WHERE reference_status = 'available') AS with_reference, count(DISTINCT reference_status) AS statuses FROM run_targets GROUP BY 1", "run_targets")
def _(t):
    return L.coverage(t.run_targets)


DELTA = """a AS (SELECT * FROM two_runs WHERE run_id = 'new'), b AS (SELECT * FROM two_runs WHERE run_id = 'base'),
  delta AS (SELECT coalesce(a.track, b.track) AS track, coalesce(a.target_id, b.target_id) AS target_id, coalesce(a.score, 0) AS new_score, coalesce(b.score, 0) AS base_score, round(coalesce(a.score, 0) - coalesce(b.score, 0), 6) AS delta, concat(coalesce(b.status, 'absent'), '->', coalesce(a.status, 'absent')) AS transition FROM a FULL OUTER JOIN b ON a.track = b.track AND a.target_id = b.target_id)"""


@query("join11_delta", f"WITH {DELTA} SELECT * FROM delta", "two_runs")
def _(t):
    return L.deltas(t.two_runs, "new", "base")


@query("agg17_delta_summary", f"WITH {DELTA} SELECT track, count(*) FILTER (WHERE delta > 0) AS improved, count(*) FILTER (WHERE delta < 0) AS regressed, count(*) FILTER (WHERE delta = 0) AS unchanged, count(*) FILTER (WHERE new_score > 0 AND base_score = 0) AS gained_nonzero, count(*) FILTER (WHERE new_score = 0 AND base_score > 0) AS lost_nonzero, round(avg(delta), 6) AS mean_delta FROM delta GROUP BY 1", "two_runs")
def _(t):
    return L.delta_summary(L.deltas(t.two_runs, "new", "base"))


@query("agg17_transitions", f"WITH {DELTA} SELECT track, transition, count(*) AS n FROM delta GROUP BY 1, 2", "two_runs")
def _(t):
    return L.transitions(L.deltas(t.two_runs, "new", "base"))


@query("srt4_top_changes", f"WITH {DELTA} SELECT * FROM (SELECT 'gain' AS side, track, target_id, delta FROM delta WHERE delta > 0 ORDER BY delta DESC, track, target_id LIMIT 15) UNION ALL SELECT * FROM (SELECT 'loss' AS side, track, target_id, delta FROM delta WHERE delta < 0 ORDER BY delta, track, target_id LIMIT 15)", "two_runs")
def _(t):
    return L.top_changes(L.deltas(t.two_runs, "new", "base"), 15)


GAP = f"""best AS (SELECT category AS track, max(mean_fixed) AS winner_mean, max(eligible) AS eligible FROM ({board_sql('true')}) GROUP BY 1), own AS (SELECT track, max(mean_score) AS run_mean FROM ({RUNS_SQL}) GROUP BY 1),
  w AS (SELECT sum(winner_mean * eligible) / sum(eligible) AS winner, sum(run_mean * eligible) / sum(eligible) AS run FROM best JOIN own USING (track))"""


@query("agg15_winner_gap", f"WITH {GAP} SELECT round(winner, 6) AS winner, round(run, 6) AS run, round(winner - run, 6) AS gap, round(run / winner, 6) AS level, round(winner / run, 6) AS multiplier FROM w", "submissions run_scores run_targets")
def _(t):
    ranked = L.group_leaderboard(scored(t)).groupBy(F.col("category").alias("track")).agg(F.max("mean_fixed").alias("winner_mean"), F.max("eligible").alias("eligible"))
    runs = L.run_leaderboard(t.run_scores, t.run_targets).groupBy("track").agg(F.max("mean_score").alias("run_mean"))
    return L.winner_gap(ranked, runs)


READOUT = "SELECT run_id, track, count(*) AS rows, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'ok' AND score > 0) AS nonzero, count(*) FILTER (WHERE status <> 'ok') AS not_ok, count(*) FILTER (WHERE prediction_path = '') AS without_path, count(DISTINCT CASE WHEN status = 'metric_failed' THEN target_id END) AS failed_ids, round(sum(score) / count(*), 6) AS mean FROM run_scores GROUP BY 1, 2"


@query("agg16_readout", READOUT, "run_scores")
def _(t):
    return L.readout(t.run_scores)


@query("prj17_branch", f"WITH r AS ({READOUT}) SELECT run_id, track, CASE WHEN not_ok > ok THEN 'repair_inputs' WHEN mean >= 0.2 THEN 'promote' WHEN mean >= 0.15 THEN 'probe_exact' WHEN nonzero < 5 THEN 'recover_sequences' ELSE 'diagnose' END AS next_branch FROM r", "run_scores")
def _(t):
    return R.branch(L.readout(t.run_scores), floor=0.2, probe_floor=0.15, min_nonzero=5).select("run_id", "track", "next_branch")


@query(
    "prj18_launch_plan",
    f"""WITH r AS ({READOUT}), b AS (SELECT run_id, track, CASE WHEN not_ok > ok THEN 'repair_inputs' WHEN mean >= 0.2 THEN 'promote' WHEN mean >= 0.15 THEN 'probe_exact' WHEN nonzero < 5 THEN 'recover_sequences' ELSE 'diagnose' END AS next_branch FROM r),
      p(next_branch, step, launch) AS (VALUES ('promote', 1, 'merge'), ('promote', 2, 'replay'), ('probe_exact', 1, 'probe'), ('repair_inputs', 1, 'repair'), ('repair_inputs', 2, 'rerun'), ('recover_sequences', 1, 'recover'), ('diagnose', 1, 'report'))
      SELECT run_id, track, next_branch, step, launch FROM b JOIN p USING (next_branch)""",
    "run_scores",
)
def _(t):
    return R.plan(R.branch(L.readout(t.run_scores), floor=0.2, probe_floor=0.15, min_nonzero=5).select("run_id", "track", "next_branch"))


@query("math1_normalized", f"SELECT ord, round({NORM}, 9) AS score FROM submissions", "submissions")
def _(t):
    return t.submissions.select("ord", F.round(S.normalized(F.col("metric"), F.col("raw")), 9).alias("score"))


@query(
    "math2_primary_metric",
    """SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'GDT_TS' WHEN p_size % 2 = 0 THEN 'TMscore' ELSE '' END AS metric, CASE WHEN p_size % 3 <> 0 THEN p_retailprice WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS score FROM part""",
)
def _(t):
    metrics = F.create_map(F.lit("GDT_TS"), F.when(F.col("p_size") % 3 == 0, "N/A").otherwise(F.col("p_retailprice").cast("string")), F.lit("TMscore"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("-"))
    rows = t.part.select("p_partkey", S.primary(F.lit("prot_domains"), metrics).alias("p"))
    return rows.select("p_partkey", F.coalesce("p.metric", F.lit("")).alias("metric"), "p.score")


@query("str1_lenient_float", "SELECT event_id, TRY_CAST(regexp_extract(props, '[-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][-+]?\\d+)?', 0) AS DOUBLE) AS number FROM events")
def _(t):
    return t.events.select("event_id", S.lenient_float(F.col("props")).alias("number"))


@query("str2_float_or_default", "SELECT p_partkey, coalesce(TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE), -1) AS n, coalesce(CAST(trunc(TRY_CAST(CASE WHEN p_size % 2 = 0 THEN CAST(p_retailprice AS VARCHAR) ELSE p_type END AS DOUBLE)) AS BIGINT), 7) AS i FROM part")
def _(t):
    return t.part.select("p_partkey", S.float_or(F.split_part("p_brand", F.lit("#"), F.lit(2)), -1.0).alias("n"), S.int_or(F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise(F.col("p_type")), 7).alias("i"))


@query("prj5_lenient_boolean", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS flag FROM part")
def _(t):
    text = F.element_at(F.array(*map(F.lit, ("", " Yes", "TRUE ", "no", "2"))), (F.col("p_size") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", S.truthy(text, True).alias("flag"))


@query("prj3_ok_targets", "SELECT DISTINCT target_id FROM run_scores WHERE status = 'ok'", "run_scores")
def _(t):
    return t.run_scores.where("status = 'ok'").select("target_id").distinct()


@query("prj4_scoreable", "SELECT target_id, reference_status = 'available' AS scoreable FROM run_targets WHERE rank_eligible <> 'false'", "run_targets")
def _(t):
    eligible = S.truthy(F.col("rank_eligible"), True)
    return t.run_targets.where(eligible).select("target_id", (F.lower(F.trim("reference_status")) == "available").alias("scoreable"))


SPECS = "SELECT s_suppkey AS ord, concat('R', CAST(s_suppkey AS STRING)) AS run_id, CASE s_suppkey % 3 WHEN 0 THEN '101' WHEN 1 THEN '101, 102,,' ELSE '' END AS seeds, CAST(s_nationkey % 4 AS INT) AS sample, CASE WHEN s_suppkey % 5 = 0 THEN 'confidence_v1' ELSE '' END AS policy, s_suppkey % 7 <> 0 AS rank_eligible, s_suppkey % 2 = 0 AS fixed_budget, CASE s_suppkey % 4 WHEN 0 THEN 'dev' WHEN 1 THEN 'attack' ELSE '' END AS requested, CAST(s_suppkey % 6 AS INT) AS declared, concat('B', CAST(s_suppkey % 5 AS STRING)) AS benchmark FROM supplier"


def specs(t):
    return t.spark.sql(SPECS.replace("FROM supplier", "FROM {supplier}"), supplier=t.supplier)


@query(
    "prj11_budget_tier",
    f"""WITH s AS ({SPECS}), c AS (SELECT *, greatest((CASE ord % 3 WHEN 1 THEN 2 ELSE 1 END) * greatest(1, sample), declared) AS candidates FROM s),
      i AS (SELECT *, CASE WHEN NOT rank_eligible THEN 'diagnostic' WHEN candidates > 1 OR policy <> '' THEN 'attack' WHEN fixed_budget THEN 'dev' ELSE 'diagnostic' END AS inferred FROM c)
      SELECT run_id, CAST(candidates AS INTEGER) AS candidates, CASE WHEN requested = '' OR (requested = 'dev' AND inferred <> 'dev') THEN inferred ELSE requested END AS tier FROM i""",
)
def _(t):
    return R.tiers(specs(t)).select("run_id", "candidates", "tier")


@query("win3_latest_status", "SELECT run_id, arg_max(status, ord) AS status, max(ord) AS ord, count(*) AS lines FROM status_log GROUP BY 1", "status_log")
def _(t):
    return R.latest_status(t.status_log)


@query("prj12_run_rows", f"WITH s AS ({SPECS}), l AS (SELECT run_id, arg_max(status, ord) AS status FROM status_log GROUP BY 1) SELECT s.run_id, s.benchmark, coalesce(l.status, 'pending') AS status FROM s LEFT JOIN l USING (run_id)", "status_log")
def _(t):
    return R.run_rows(specs(t), t.status_log).select("run_id", "benchmark", "status")


@query("ctl2_runnable", f"WITH s AS ({SPECS}), l AS (SELECT run_id, arg_max(status, ord) AS status FROM status_log WHERE status <> 'click' GROUP BY 1) SELECT s.run_id FROM s LEFT JOIN l USING (run_id) WHERE coalesce(l.status, 'pending') IN ('pending', 'failed')", "status_log")
def _(t):
    return R.runnable(R.run_rows(specs(t), t.status_log.where("status <> 'click'"))).select("run_id")


@query("snk9_register", f"WITH s AS ({SPECS}) SELECT run_id, benchmark FROM s WHERE ord % 3 <> 0 UNION ALL SELECT run_id, 'B9' FROM s WHERE ord % 3 = 0", "")
def _(t):
    s = specs(t).select("run_id", "benchmark", "ord")
    return R.register(s.drop("ord"), s.where("ord % 3 = 0").select("run_id", F.lit("B9").alias("benchmark")))


@query("agg19_preflight", "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'missing_run' WHEN c_acctbal < 0 THEN 'blocked:funds' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'blocked:segment' ELSE 'ready' END AS result, count(*) AS n, count(*) FILTER (WHERE c_custkey % 4 <> 0 AND (c_acctbal < 0 OR c_mktsegment = 'HOUSEHOLD')) AS blocked FROM customer GROUP BY 1")
def _(t):
    rows = t.customer.withColumn("run_id", F.col("c_custkey"))
    result = F.when(F.col("c_acctbal") < 0, "blocked:funds").when(F.col("c_mktsegment") == "HOUSEHOLD", "blocked:segment").otherwise("ready")
    return R.preflight(rows.where("c_custkey % 4 <> 0").select("run_id", result.alias("result")), rows.select("run_id"))


@query(
    "join17_shard_check",
    """WITH shards AS (SELECT s_nationkey AS merged, CASE WHEN s_nationkey % 4 = 0 THEN s_suppkey % 2 ELSE 0 END AS benchmark, 1 AS manifest, CASE WHEN s_nationkey % 5 = 1 THEN s_suppkey % 2 ELSE 0 END AS policy, 2 AS e FROM supplier),
      same AS (SELECT merged, count(DISTINCT benchmark) = 1 AS same_benchmark, count(DISTINCT manifest) = 1 AS same_manifest, count(DISTINCT policy) = 1 AS same_policy, CAST(sum(e) AS BIGINT) AS expected FROM shards GROUP BY 1),
      work AS (SELECT c_nationkey AS merged, c_custkey AS task, count(o_orderkey) AS files FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
      agg AS (SELECT merged, count(*) AS tasks, count(*) FILTER (WHERE files < expected) AS incomplete_tasks, CAST(sum(greatest(expected - files, 0)) AS BIGINT) AS missing_files FROM work JOIN same USING (merged) GROUP BY 1)
      SELECT *, CASE WHEN NOT (same_benchmark AND same_manifest AND same_policy) THEN 'stop:incompatible' WHEN incomplete_tasks > 0 THEN 'wait:incomplete' ELSE 'merge' END AS action FROM same JOIN agg USING (merged)""",
)
def _(t):
    key = F.col("s_nationkey")
    shards = t.supplier.select(key.alias("merged"), F.when(key % 4 == 0, F.col("s_suppkey") % 2).otherwise(0).alias("benchmark"), F.lit(1).alias("manifest"), F.when(key % 5 == 1, F.col("s_suppkey") % 2).otherwise(0).alias("policy"), F.lit(2).alias("expected_per_task"))
    tasks = t.customer.select(F.col("c_nationkey").alias("merged"), F.col("c_custkey").alias("task"))
    observed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("merged"), F.col("c_custkey").alias("task")).agg(F.count(F.lit(1)).alias("files"))
    return R.shard_check(shards, tasks, observed)


@query("snk8_merged_files", "SELECT concat(CAST(l_orderkey AS VARCHAR), '/', CAST(l_linenumber AS VARCHAR), '/', CAST(l_partkey AS VARCHAR)) AS rel_path, min(l_suppkey) AS shard, CAST(max(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def _(t):
    files = t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("rel_path"), F.col("l_suppkey").alias("shard"), F.col("l_quantity").cast("bigint").alias("bytes"))
    twice = files.groupBy("rel_path").agg(F.count_distinct("shard").alias("n")).where("n > 1")
    return R.merged_files(files.join(twice, "rel_path", "left_anti"))


@query("join18_variant_guard", "SELECT concat('R', CAST(a.p_partkey AS VARCHAR)) AS run_id, concat_ws(';', CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'differs:p_brand' END, CASE WHEN a.p_type IS DISTINCT FROM b.p_type THEN 'differs:p_type' END) AS failures, CAST((a.p_brand IS DISTINCT FROM b.p_brand)::INT + (a.p_type IS DISTINCT FROM b.p_type)::INT AS INTEGER) AS n_failures FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(t):
    name = lambda shift: F.concat(F.lit("R"), (F.col("p_partkey") - shift).cast("string")).alias("run_id")
    return R.guard(t.part.select(name(0), "p_brand", "p_type"), t.part.select(name(1), "p_brand", "p_type"), ["p_brand", "p_type"])


@query("prj19_design_guard", "SELECT event_id, concat_ws(';', CASE WHEN NOT (CAST(json_extract_string(props, '$.k') AS INT) < 50) THEN 'k too large' END, CASE WHEN NOT (value >= 5) THEN 'value too small' END) AS failures, (CAST(json_extract_string(props, '$.k') AS INT) < 50) AND value >= 5 AS ok FROM events")
def _(t):
    docs = t.events.select("event_id", "value", F.from_json("props", "k int").alias("d"))
    return R.validate(docs, {"k too large": "d.k < 50", "value too small": "value >= 5"}).select("event_id", "failures", "ok")
