"""Streaming forms of the log operators; extensions that the batch operators don't need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def latest(stream: DataFrame) -> DataFrame:
    """Last status of each run by line, kept as state."""
    return stream.groupBy("run_id").agg(F.max_by("status", "ord").alias("status"), F.max("ord").alias("ord"))


def activity(stream: DataFrame, *, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows of event time, closed by a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def upsert_into(stream: DataFrame, path: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, *, buckets: int = 64) -> StreamingQuery:
    """Each micro-batch merged into a table of one row for each key, all that is there and then stop.

    The table lies in buckets of keys, and a batch rewrites only those that it touches: merge(old rows, new rows) -> rows. A batch that was
    applied leaves its number; one that comes again changes nothing. If a job dies between the rows and the number, the batch is merged again, so merge must give the same for
    rows that are in already, as merge_preferred() does. Null keys are left out.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_applied/{number}")
        files = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(done):
            return
        new = batch.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # numbers below ``buckets``
        table = spark.createDataFrame([], new.schema)
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")):
            table = spark.read.schema(new.schema).parquet(f"{path}/rows").where(F.col("bucket").isin(touched))
        if touched:
            out = merge(table.drop("bucket"), new.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
        files.mkdirs(done)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
