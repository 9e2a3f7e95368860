"""Writers. Each writes under a folder of the caller's choice, whole partitions in parallel, and returns the path."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master (tests)
    gets a temporary folder, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    run = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{root.rstrip('/')}/{name}-{run}"


def json_lines(rows: DataFrame, path: str, by: str | None = None) -> str:
    """One JSON object a line, in UTF-8; nulls are written, so that every line has the same keys. With `by`, one folder for
    each of its values, each written by as many tasks as hold it."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)
    return path


def csv_report(rows: DataFrame, path: str, fields: list[str]) -> str:
    """A CSV with a header, of these fields in this order; others are left out, missing ones empty."""
    shown = [F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields]
    rows.select(*shown).write.mode("overwrite").option("header", True).csv(path)
    return path


def append_csv(rows: DataFrame, path: str, fields: list[str]) -> str:
    """Rows added to a registry; every file has its own header, so that the first run needs no other form."""
    rows.select(*fields).write.mode("append").option("header", True).csv(path)
    return path


def text_files(docs: DataFrame, path: str, key: str = "doc_id") -> str:
    """Texts in a folder for each document. For as many documents as a file system bears; `text_buckets` for more."""
    docs.select(key, F.col("text").alias("value")).write.mode("overwrite").partitionBy(key).text(path)
    return path


def text_buckets(docs: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> str:
    """Texts as JSON lines (key, text) in a fixed number of folders by a hash of the key, so that one document is found in one
    of them and the number of files doesn't grow with the documents."""
    own = docs.select(key, "text", F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"))
    own.write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", "false").json(path)
    return path


def assignment(units: DataFrame, path: str) -> str:
    """Which split each unit went to: one object {unit: split} a line, which together are the assignment document."""
    units.select(F.to_json(F.create_map("unit", "split")).alias("value")).write.mode("overwrite").text(path)
    return path


def append_log(rows: DataFrame, path: str) -> str:
    rows.write.mode("append").parquet(path)
    return path


def evaluation_rows(events: DataFrame) -> DataFrame:
    """Evaluation log rows: seconds to two places, error texts cut, unscored attempts kept with a null score."""
    return events.withColumn("elapsed_s", F.round("elapsed_s", 2)).withColumn("error", F.substring("error", 1, 1000))


def resource_rows(resources: DataFrame) -> DataFrame:
    """Resource log rows: score and threshold lifted from the verdict, attempts counted, a preview of the source."""
    return resources.select("*", F.col("verdict.score").alias("score"), F.col("verdict.threshold").alias("threshold"), F.size("attempts").alias("n_attempts"), F.substring("source", 1, 1000).alias("source_preview")).drop("source")
