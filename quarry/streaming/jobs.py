"""Structured Streaming twins of the log operators, and tables that several micro-batches and runs keep up to date.

A stream's aggregation state lives below its checkpoint and outlives the run; the rows that a micro-batch changes are merged
by key into a Parquet table of BUCKETS partitions. Only partitions with changed keys are written again, by dynamic
partition overwrite from a staged copy, and a changed row replaces its key's row whole: a batch that is run twice after a
lost driver leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import logs
from quarry.sources.sinks import shared_folder

#: Partitions of a kept table, and the sets of files in which a table is run through a stream.
BUCKETS, SETS = 16, 3


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def merge_into(path: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch's rows replace those of the same keys (unique in a batch) in the table at `path`."""

    def merge(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        new = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        staged = f"{path}-staged"
        if exists(spark, path):
            new.write.mode("overwrite").parquet(f"{staged}-new")  # read twice below
            new = spark.read.schema(new.schema).parquet(f"{staged}-new")
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched))
            new = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
        new.repartition("bucket").write.mode("overwrite").parquet(staged)
        spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return merge


def run(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Takes in all files of `source` that no run with this checkpoint has taken in before."""
    changed = transform(spark.readStream.schema(schema).parquet(source))
    query = changed.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def sets(rows: DataFrame, order: str, n: int = SETS) -> list[DataFrame]:
    """The rows in n sets by ranges of `order` (a null order in the last)."""
    cuts = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 1000).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts))
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if low is None else F.col(order) > low
        parts.append(rows.filter((inside if high is None else inside & (F.col(order) <= high)) | (F.col(order).isNull() if high is None else F.lit(False))))
    return parts


def drain(source: DataFrame, transform, name: str, keys: list[str], order: str) -> DataFrame:
    """Runs a table through a stream to its end, in several sets of files by `order`, each taken in by a run that begins
    from the checkpoint of the one before. The table of the last states of all keys."""
    spark, root = source.sparkSession, shared_folder(source.sparkSession, name)
    for part in sets(source, order):
        part.write.mode("append").parquet(f"{root}/in")
        run(spark, f"{root}/in", source.schema, transform, merge_into(f"{root}/table", keys), f"{root}/checkpoint")
    if exists(spark, f"{root}/table"):
        return spark.read.parquet(f"{root}/table").drop("bucket")
    return transform(source).limit(0)


def daily_counts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """day, event_type, n, cents: tumbling daily counts; a day's latest state is its result.

    Days that lie further than `delay` behind the newest row leave the state; rows that come later than that are left
    out. A table that is drained comes in order of time, so it has no such rows.
    """

    def counts(rows: DataFrame) -> DataFrame:
        cents = F.round(F.col("value") * 100).cast("bigint")
        timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
        timed = timed.withWatermark("ts", delay) if timed.isStreaming else timed
        grouped = timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"))
        return grouped.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")

    return drain(events.select("ts", "event_type", "value"), counts, "daily", ["day", "event_type"], "ts")


def job_states(events: DataFrame, final: list[str]) -> DataFrame:
    """The streaming twin of the job fold (see logs.fold_jobs)."""
    return drain(events, lambda rows: logs.fold_jobs(rows, final), "jobs", ["job"], "ts")


def conversation_state(turns: DataFrame) -> DataFrame:
    """conv_id, turns, last_turn, last_text: the state that a conversation is taken up from, kept by a streaming fold."""
    fold = lambda rows: rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max(F.struct("turn", "text")).alias("last"))
    states = drain(turns, fold, "conversations", ["conv_id"], "turn")
    return states.select("conv_id", "turns", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("last_text"))
