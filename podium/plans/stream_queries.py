"""Queries that replay a table as a stream; what they give is what a batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.ranks import shared_folder
from ..streaming import machines, status
from .registry import query


def streamed(t, name: str):
    """A table as a stream of files."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.sf_dir}/{name}.parquet*")


def fresh(t) -> str:
    return f"{shared_folder(t.spark)}/podium-stream-{uuid.uuid4().hex}"


@query(
    "win3_stream_overdue",
    "WITH e AS (SELECT concat('R', CAST(user_id AS VARCHAR)) AS run_id, event_type AS status, event_id AS ord, epoch_ms(ts) AS ms FROM events), r AS (SELECT run_id, arg_max(status, ord) AS status, max(ord) AS ord, max(ms) AS ms FROM e GROUP BY 1) SELECT run_id, status, ord, status NOT IN ('purchase', 'signup') AND ms + 21600000 <= (SELECT max(ms) FROM e) - 600000 AS overdue FROM r",
)
def _(t):
    lines = streamed(t, "events").select(F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("ts"))
    out = machines.silence(lines, closed=("purchase", "signup"), limit="6 hours", late="10 minutes")
    at = fresh(t)
    rows = machines.drained(out, f"{at}/out", f"{at}/state", mode="update")
    newest = F.struct("ord", "overdue")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("status", "ord", "overdue"), newest).alias("r")).select("run_id", "r.*")


@query("set2_stream_refresh", "WITH keyed AS (SELECT *, sha256(sequence) AS key FROM cache) SELECT key, arg_max(ord, (n_paths, CAST(has_hash AS INT), -ord)) AS ord, arg_max(n_paths, (n_paths, CAST(has_hash AS INT), -ord)) AS n_paths, arg_max(has_hash, (n_paths, CAST(has_hash AS INT), -ord)) AS has_hash FROM keyed GROUP BY 1", "cache")
def _(t):
    rows = streamed(t, "documents").select(F.sha2("text", 256).alias("key"), F.col("doc_id").alias("ord"), F.when(F.col("n_chars") % 3 == 0, 1).otherwise(2).alias("n_paths"), (F.col("n_chars") % 2 == 0).alias("has_hash"))

    def better(old, new):
        best = F.struct("n_paths", "has_hash", -F.col("ord"))
        return old.unionByName(new).groupBy("key").agg(F.max_by(F.struct("ord", "n_paths", "has_hash"), best).alias("r")).select("key", "r.*")

    at = fresh(t)
    status.upsert_into(rows, f"{at}/table", "key", better, f"{at}/state").awaitTermination()
    return t.spark.read.parquet(f"{at}/table/rows").drop("bucket")
