"""Streaming replies: throttled emissions of a text that grows token by token, by keyed state with event-time timers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.sinks import shared_folder
from quarry.streaming import jobs

#: Fixed value: microseconds between two emissions of a reply, at least.
GAP = 200_000


#: Groups of replies, by a hash of the key: what one group's calls cost is shared by its replies.
BUCKETS = 1024
OUT = ["key", "seq", "at", "n", "chars", "last"]


class Reply:
    __slots__ = ("n", "chars", "told", "told_n", "frozen", "seq")

    def __init__(self, n: int = 0, chars: int = 0, told: int | None = None, told_n: int = 0, frozen: bool = False, seq: int = 0):
        self.n, self.chars, self.told, self.told_n, self.frozen, self.seq = n, chars, told, told_n, frozen, seq

    def due(self) -> int | None:
        """When the timer tells what waits."""
        return None if self.frozen or self.n == self.told_n else self.told + GAP

    def tell(self, key, at: int, last: bool, out: list) -> None:
        self.seq, self.told, self.told_n = self.seq + 1, at, self.n
        out.append((key, self.seq, at, self.n, self.chars, last))


def throttle(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of each reply of a bucket: what it has come to, when it was last told, and whether it is complete.

    Tokens of a batch are taken in order of time. A token that comes GAP or more after the last emission is told with all
    before it; others wait. What waits is told GAP after the last emission, when the watermark has passed it (the
    bucket's timer stands at the earliest such time), and at once by the reply's last token, after which the reply is
    frozen: later tokens count for nothing, and no timer tells anything. A reply's state is of fixed size: counts and
    times, never the tokens themselves.
    """
    replies = {k: Reply(*own) for k, own in pickle.loads(bytes(state.get[0])).items()} if state.exists else {}
    out, parts = [], [] if state.hasTimedOut else list(frames)
    if parts:
        batch = pd.concat(parts).sort_values(["at", "seq_no"])  # the tokens of one bucket in one micro-batch
        for key, at, size, last in zip(*(batch[c].tolist() for c in ("key", "at", "size", "last")), strict=True):
            reply = replies.get(key)
            if reply is None:
                reply = replies[key] = Reply()
            if reply.frozen:
                continue
            while reply.told is not None and reply.n > reply.told_n and at > reply.told + GAP:
                reply.tell(key, reply.told + GAP, False, out)  # the timer comes before this token
            reply.n, reply.chars = reply.n + 1, reply.chars + size
            if last:
                reply.tell(key, at, True, out)
                reply.frozen = True
            elif reply.told is None or at - reply.told >= GAP:
                reply.tell(key, at, False, out)
    passed, timers = state.getCurrentWatermarkMs(), []
    for key, reply in replies.items():
        if (due := reply.due()) is not None:
            if due // 1000 + 1 < passed:
                reply.tell(key, due, False, out)
            else:
                timers.append(due // 1000 + 1)
    state.update((pickle.dumps({k: tuple(getattr(r, f) for f in Reply.__slots__) for k, r in replies.items()}),))
    if timers:
        state.setTimeoutTimestamp(max(min(timers), passed + 1))
    if out:
        yield pd.DataFrame(out, columns=OUT)


def throttled(tokens: DataFrame, delay: str) -> DataFrame:
    """key, seq, at, n, chars, last: emissions of each reply. tokens (a stream): key, at (microseconds), seq_no (order among
    equal times), size, last.

    `delay` is how late a token may come behind the newest one of all; later ones are left out.
    """
    spark = tokens.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = tokens.schema["key"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    timed = tokens.filter("key is not null").select(bucket, "key", "at", "seq_no", "size", "last", F.timestamp_micros("at").alias("ts")).withWatermark("ts", delay)
    out = f"key {kind}, seq bigint, at bigint, n bigint, chars bigint, last boolean"
    return timed.groupBy("bucket").applyInPandasWithState(throttle, out, "replies binary", "append", GroupStateTimeout.EventTimeTimeout)


def emissions(tokens: DataFrame, delay: str = "1 second") -> DataFrame:
    """All emissions of a table of tokens (null keys and times have none), run through the stream in several sets of files
    by time, each by a run from the checkpoint of the one before. What waits when the log ends, without a last token and
    without later tokens of any reply, is told by no one."""
    spark, root = tokens.sparkSession, shared_folder(tokens.sparkSession, "replies")
    rows = tokens.select("key", "at", "seq_no", "size", "last").filter("key is not null and at is not null")
    rows.write.parquet(f"{root}/tokens")  # read for the cuts and for each set
    rows = spark.read.schema(rows.schema).parquet(f"{root}/tokens")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    for part in jobs.sets(rows, "at"):
        part.write.mode("append").parquet(f"{root}/in")
        jobs.run(spark, f"{root}/in", rows.schema, lambda stream: throttled(stream, delay), keep, f"{root}/checkpoint", mode="append")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, seq bigint, at bigint, n bigint, chars bigint, last boolean"
    if not jobs.exists(spark, f"{root}/out"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/out").drop("batch")


def token_texts(tokens: DataFrame) -> DataFrame:
    """key, n, chars, done: what a reply has come to at its newest emission. A reply is frozen at its first last token."""
    newest = F.max(F.struct("seq", "n", "chars", "last")).alias("e")
    return emissions(tokens).groupBy("key").agg(newest).select("key", "e.n", "e.chars", F.col("e.last").alias("done"))
