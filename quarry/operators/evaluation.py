"""Scoring predictions against records: chat records, correctness, grounding, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import citations as ct
from quarry.functions import render as rd
from quarry.functions import text as tx
from quarry.operators import logs

SYSTEM = "You answer from the excerpt alone."


def chat_record(pairs: DataFrame, version: str) -> DataFrame:
    """pair_id, pair_type, section_id, split, dataset_version, messages (system, user, assistant). pairs: pair_id, pair_type,
    section_id, split, instruction, excerpt, output."""
    user = F.concat_ws("\n", "instruction", F.lit(rd.EXCERPT_MARK), "excerpt")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.lit(SYSTEM)), message("user", user), message("assistant", F.col("output")))
    return pairs.select("pair_id", "pair_type", "section_id", "split", F.lit(version).alias("dataset_version"), messages.alias("messages"))


def sources(records: DataFrame) -> DataFrame:
    """pair_id, pair_type, section_id, source, gold: what a record asks from, and its answer."""
    said = lambda role: F.get(F.filter("messages", lambda m: m.role == role), 0)["content"]
    return records.select("pair_id", "pair_type", "section_id", rd.source_of(said("user")).alias("source"), said("assistant").alias("gold"))


def is_correct(pair_type: Column, said: Column, gold: Column, least: float = DEFAULTS.f1_pass) -> Column:
    """The same letter for multiple choice, else a token F1 of at least `least`."""
    letter = F.coalesce(tx.answer_letter(said) == tx.answer_letter(gold), F.lit(False))
    return F.when(pair_type == "mcq", letter).otherwise(tx.token_f1(tx.tokens(said), tx.tokens(gold)) >= least)


def is_hallucinated(said: Column, source: Column, section: Column) -> Column:
    missing = ct.unsupported(ct.cited(said), ct.supported(source), section)
    return ct.reject_reason(said, missing).isNotNull()


def scored(predictions: DataFrame, records: DataFrame) -> DataFrame:
    """Predictions (pair_id, split, candidate, candidate_ms) with correct and hallucinated; one without a record has no
    gold answer and an empty source. Joined by pair_id, not by position."""
    both = predictions.join(sources(records), "pair_id", "left")
    gold, source = F.coalesce("gold", F.lit("")), F.coalesce("source", F.lit(""))
    return both.select("pair_id", "split", is_correct(F.col("pair_type"), F.coalesce("candidate", F.lit("")), gold).alias("correct"), is_hallucinated(F.col("candidate"), source, F.col("section_id")).alias("hallucinated"), F.coalesce("candidate_ms", F.lit(0.0)).alias("ms"))


def measured(rows: DataFrame, group: str = "split") -> DataFrame:
    """group, n, accuracy, hallucination_rate, groundedness, latency_p95 (the value at floor(0.95 (n - 1)))."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    base = rows.groupBy(group).agg(F.round(rate("correct"), 4).alias("accuracy"), F.round(rate("hallucinated"), 4).alias("hallucination_rate"), F.round(1 - rate("hallucinated"), 4).alias("groundedness"))
    slow = logs.at_rank(rows, group, "ms", {"latency_p95": F.floor(F.lit(0.95) * (F.col("n") - 1))})
    return base.join(slow, group).select(F.col(group).alias("group"), "n", "accuracy", "hallucination_rate", "groundedness", "latency_p95")


def last_of_run(registry: DataFrame, run: str) -> DataFrame:
    """eval_split and the last row of the run for it, dry runs left out. registry: run_id, eval_split, notes, row_no, ..."""
    own = registry.filter((F.col("run_id") == run) & (F.coalesce("notes", F.lit("")) != "dry_run"))
    return logs.latest_wins(own, ["eval_split"], ["row_no"])


def compared(now: DataFrame, registry: DataFrame, run: str) -> DataFrame:
    """Splits measured now with what the registry said last; 0 where it has nothing."""
    last = last_of_run(registry, run).select(F.col("eval_split").alias("group"), F.col("accuracy").alias("before"))
    return now.join(last, "group", "left").withColumn("before", F.coalesce("before", F.lit(0.0)))


def token_lengths(rows: DataFrame, group: str, length: str) -> DataFrame:
    """group, n, p50 (upper median), p95 (at min(n - 1, floor(0.95 n))), longest, window (the power of two that holds p95,
    within 256 and 4096), cut (rows longer than that)."""
    n = F.col("n")
    ranks = logs.at_rank(rows, group, length, {"p50": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * 0.95)), "longest": n - 1})
    sized = ranks.withColumn("window", rd.power_of_two_at_least(F.col("p95")))
    over = rows.join(sized.select(group, "window"), group).groupBy(group).agg(F.count_if(F.col(length) > F.col("window")).alias("cut"))
    return sized.join(over, group)


def positions(path_rows: DataFrame) -> DataFrame:
    """The rows of a read of Parquet files with `position` from 0: by file name, then by place in the file.

    The places come from the reader, and what the files before hold from one count a file: no row is moved.
    """
    own = path_rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    earlier = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(W.unboundedPreceding, -1))  # one row a file
    files = own.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).select("__file", F.coalesce(earlier, F.lit(0)).alias("__before"))
    return own.join(files, "__file").withColumn("position", F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


def zipped(predictions: DataFrame, rows: DataFrame) -> DataFrame:
    """Predictions and rows (reads of Parquet files, no filters) by position: position, prediction (struct), row (struct), matched.

    Tables of unequal length keep all positions: where one ends, its struct is null and `matched` is false.
    """
    left = positions(predictions).select("position", F.struct(*predictions.columns).alias("prediction"))
    right = positions(rows).select("position", F.struct(*rows.columns).alias("row"))
    both = left.join(right, "position", "full_outer")
    return both.withColumn("matched", F.col("prediction").isNotNull() & F.col("row").isNotNull())
