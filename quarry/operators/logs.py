"""Operators over append-mostly logs: merges, folds, listings, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.sources.sinks import shared_folder


def latest_wins(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the greatest version: the upsert of plain Parquet tables. Pre-aggregates before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*version, *[c for c in rest if c not in version])).alias("__r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def set_on_insert(rows: DataFrame, keys: list[str], ts: str, tie: str, first: str, last: list[str]) -> DataFrame:
    """Upsert in which the time of the first insert survives and the other columns are the latest."""
    newest = F.max(F.struct(ts, tie, *last)).alias("__r")
    return rows.groupBy(*keys).agg(F.min(ts).alias(first), newest).select(*keys, first, *[F.col(f"__r.{c}").alias(c) for c in last])


def keep_known(rows: DataFrame, keys: list[str], version: list[str], columns: list[str]) -> DataFrame:
    """Upsert in which a null never overwrites: the latest known value of each column."""
    known = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*version, c)))[c].alias(c)
    return rows.groupBy(*keys).agg(*map(known, columns))


def insert_absent(new: DataFrame, old: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: keys that the table lacks, the first row of each."""
    fresh = new.join(old.select(key), key, "left_anti")
    rest = [c for c in new.columns if c not in (key, order)]
    return fresh.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in [order, *rest]])


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of deleted keys."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def orphans(links: DataFrame, unlinked: DataFrame, pair: list[str], owned: str) -> DataFrame:
    """Owned keys without an owner after the links of `unlinked` are removed (reference-counted delete)."""
    left = links.join(unlinked.select(*pair), pair, "left_anti").select(owned).distinct()
    return links.select(owned).distinct().join(left, owned, "left_anti")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with `number` from 1 in their order, without one task that holds them all: they are dealt by range and
    written once, the parts' sizes are summed up, and each part numbers its own."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "numbered")
    rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    earlier = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # one row a part
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(sizes), "__part").withColumn("number", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def newest(rows: DataFrame, where: dict, order: str, tie: str, limit: int) -> DataFrame:
    """Rows that match all given values (None: no condition), newest first."""
    for column, value in where.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(F.desc(order), tie).limit(limit)


def linked(links: DataFrame, table: DataFrame, key: str, order: str, tie: str, limit: int) -> DataFrame:
    """The newest links, limited before the join; dangling ones drop out."""
    return links.orderBy(F.desc(order), tie).limit(limit).join(table, key)


def last_turns(turns: DataFrame, n: int = DEFAULTS.history_turns) -> DataFrame:
    """The last 2n turns of each conversation."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= 2 * n).drop("__r")


#: Words that open a question which refers back.
REFERS_BACK = r"^(it|this|that|he|she|his|her|they|their|what about|why)\b"


def needs_rewrite(turns: DataFrame) -> DataFrame:
    """Users' turns with follow_up: history, and at most four words, an opening that refers back, or no word of the turn
    before. Words are runs of letters (of any script), digits and underscores."""
    w = W.partitionBy("conv_id").orderBy("turn")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    told = turns.withColumn("before", F.lag("text").over(w))
    short = F.size(F.filter(F.split("text", "[ \t\r\n]+"), lambda x: x != "")) <= 4
    apart = ~F.arrays_overlap(words(F.col("text")), words(F.col("before")))
    return told.filter("role = 'user'").select("conv_id", "turn", (F.col("before").isNotNull() & (short | F.lower("text").rlike(REFERS_BACK) | apart)).alias("follow_up"))


def sessions(turns: DataFrame, at: str, limit: int = 20) -> DataFrame:
    """conv_id, turns, last_activity: the sessions that were active last."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max(at).alias("last_activity")).orderBy(F.desc("last_activity"), "conv_id").limit(limit)


#: Slices of a group's values, by approximate quantiles.
SLICES = 64


def at_rank(values: DataFrame, group: str, value: str, picks: dict[str, Column]) -> DataFrame:
    """Order statistics at ranks (from 0) that depend on n, exact at any size. picks: name -> rank as a column of `n`.

    Values are counted first (partial sums). Prefix sums over distinct values then go in two levels: over the slices of
    a group, cut at approximate quantiles, and within those slices alone that hold a wanted rank.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    cuts = F.percentile_approx(value, [i / SLICES for i in range(1, SLICES)], 1000).alias("cuts")
    ends = counts.groupBy(group).agg(F.sum("c").alias("n"), cuts)
    sliced = counts.join(ends, group).select(group, value, "c", F.size(F.filter("cuts", lambda x: x < F.col(value))).alias("slice"))
    sums = sliced.groupBy(group, "slice").agg(F.sum("c").alias("s"))
    earlier = F.coalesce(F.sum("s").over(W.partitionBy(group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = lambda rank: (rank >= F.col("s0")) & (rank < F.col("s0") + F.col("s"))
    names = F.array_compact(F.array(*[F.when(inside(rank), F.lit(name)) for name, rank in picks.items()]))
    slices = sums.withColumn("s0", earlier).join(ends.select(group, "n"), group).select(group, "slice", "s0", "n", names.alias("names")).filter(F.size("names") > 0)
    near = sliced.join(slices, [group, "slice"])
    placed = near.withColumn("upto", F.col("s0") + F.sum("c").over(W.partitionBy(group, "slice").orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    found = [F.min(F.when(F.array_contains("names", name) & (F.col("upto") > rank), F.col(value))).alias(name) for name, rank in picks.items()]
    return placed.groupBy(group).agg(F.max("n").alias("n"), *found)


def judge_stats(events: DataFrame, threshold: int = DEFAULTS.judge_threshold) -> DataFrame:
    """task, n, low, median (upper), high, mean, distinct, pass_rate of whole scores. events: task, score."""
    counted = events.filter("score is not null")
    mid = at_rank(counted, "task", "score", {"median": F.floor(F.col("n") / 2)}).drop("n")
    base = counted.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg("score"), 1).alias("mean"),
        F.count_distinct("score").alias("distinct_scores"), F.round(F.avg((F.col("score") >= threshold).cast("double")), 3).alias("pass_rate"),
    )
    return base.join(mid, "task")


def best_attempts(attempts: DataFrame) -> DataFrame:
    """key, attempt, score: the best score, the earliest on ties; without scores, the last attempt."""
    scored = F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("attempt")).alias("m"))))
    g = attempts.groupBy("key").agg(scored.alias("b"), F.max("attempt").alias("last"))
    return g.select("key", F.coalesce(-F.col("b.m"), "last").alias("attempt"), F.col("b.score").alias("score"))


def daily(events: DataFrame, ts: str, days: int) -> DataFrame:
    """day, n: events on each of the last `days` days up to the latest, empty days as 0."""
    last = events.agg(F.to_date(F.max(ts)).alias("last"))
    calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    counts = events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("c"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("c", F.lit(0)).cast("bigint").alias("n"))


def fold_jobs(events: DataFrame, final: list[str]) -> DataFrame:
    """job, status, transitions, done, partial, progress, reply_ready, error: the last transition of each job (ties: the
    later event).

    events: job, ts, event_id, status, partial, progress, reply, error. The partial text and the progress message are the
    last known ones. The first complete reply is published: it stands as the partial text from then on, whatever comes
    later, and sets reply_ready. A final status clears all three. The error is the last one, cut at 2000 characters, and
    stays only with status `error`.
    """
    known = lambda c, pick: pick(F.when(F.col(c).isNotNull(), F.struct("ts", "event_id", c)))[c]
    told = [known("partial", F.max).alias("told"), known("progress", F.max).alias("message"), known("reply", F.min).alias("reply")]
    g = events.groupBy("job").agg(F.max(F.struct("ts", "event_id", "status", "error")).alias("s"), F.count(F.lit(1)).alias("transitions"), *told)
    status, done = F.col("s.status"), F.col("s.status").isin(final)
    return g.select(
        "job", status.alias("status"), "transitions", done.alias("done"), F.when(~done, F.coalesce("reply", "told")).alias("partial"), F.when(~done, F.col("message")).alias("progress"),
        (~done & F.col("reply").isNotNull()).alias("reply_ready"), F.when(status == "error", F.substring("s.error", 1, 2000)).alias("error"),
    )


def fail_running(jobs: DataFrame, live: list[str], reason: str) -> DataFrame:
    """Jobs that were under way become failed, with the reason; others stay."""
    running = F.col("status").isin(live)
    return jobs.withColumn("error", F.when(running, reason).otherwise(F.col("error"))).withColumn("status", F.when(running, "failed").otherwise(F.col("status")))


def acceptance(rows: DataFrame) -> DataFrame:
    """task, total, accepted, rate (null without rows), and a row for all tasks. rows: task, accepted."""
    sums = rows.groupBy("task").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("accepted").cast("bigint")).alias("accepted"))
    whole = sums.agg(F.sum("total").alias("total"), F.sum("accepted").alias("accepted")).select(F.lit("all").alias("task"), "total", "accepted")
    return sums.unionByName(whole).withColumn("rate", F.round(F.col("accepted") / F.nullif("total", F.lit(0)), 3))
