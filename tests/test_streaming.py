"""Streams over several micro-batches, repeated batches and restarts."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import logs
from quarry.streaming import jobs, replies

START = 1_700_000_000_000_000
TOKENS = "key bigint, at bigint, seq_no bigint, size bigint, last boolean"


def replayed(tokens, end=None):
    """Emissions of one reply by the clock: tokens in order, a gap of 0.2 s between emissions, what waits told when it is over."""
    out, told, n, chars, told_n = [], None, 0, 0, 0
    for at, size, last in tokens:
        while told is not None and n > told_n and at > told + 200_000:
            told, told_n = told + 200_000, n
            out.append((len(out) + 1, told, n, chars, False))
        n, chars = n + 1, chars + size
        if last:
            out.append((len(out) + 1, at, n, chars, True))
            return out
        if told is None or at - told >= 200_000:
            told, told_n = at, n
            out.append((len(out) + 1, at, n, chars, False))
    if end is not None and told is not None and n > told_n and told + 200_000 < end:
        out.append((len(out) + 1, told + 200_000, n, chars, False))
    return out


def test_throttled_replies_over_batches(spark):
    draw = random.Random(1)
    rows, want = [], []
    for key in range(25):
        at, own = START + draw.randrange(3_000_000), []
        for i in range(draw.randrange(1, 60)):
            own.append((at, draw.randrange(9), False))
            at += draw.choice([0, 1000, 30_000, 199_999, 200_000, 200_001, 900_000])
        if key % 3:
            own[-1] = (*own[-1][:2], True)
            own += [(at + 5, 7, False), (at + 400_000, 7, True)]  # after the end: nothing
        rows += [(key, a, i, s, e) for i, (a, s, e) in enumerate(own)]
        want.append((key, own))
    end = max(r[1] for r in rows) + 60_000_000
    rows.append((99, end, 0, 1, True))  # moves the watermark past all timers
    frame = spark.createDataFrame(rows, TOKENS)
    sizes = [p.count() for p in jobs.sets(frame, "at")]
    assert len([n for n in sizes if n]) >= 3
    made = sorted(tuple(r) for r in replies.emissions(frame).collect() if r.key != 99)
    expected = sorted((key, *e) for key, own in want for e in replayed(sorted(own, key=lambda t: t[0]), end))
    assert made == expected


class Kept:
    """A bucket's state that counts its calls."""

    hasTimedOut, value, calls = False, None, 0

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def setTimeoutTimestamp(self, at):
        self.timer, self.calls = at, self.calls + 1

    def getCurrentWatermarkMs(self):
        return 0


def test_a_batch_of_many_replies_costs_one_update_and_one_timer():
    state, draw, made = Kept(), random.Random(3), []
    tokens = [(START + 70_000 * i, i, draw.randrange(9), i == 899) for i in range(900)]
    for part in range(3):
        frames = [pd.DataFrame([(k, *t) for t in tokens[300 * part : 300 * part + 300]], columns=["key", "at", "seq_no", "size", "last"]).sample(frac=1, random_state=1) for k in range(20)]
        made += [tuple(r) for out in replies.throttle((0,), iter(frames), state) for r in out.itertuples(index=False)]
        assert state.calls <= 2 * (part + 1)
    want = replayed([(a, s, e) for a, _, s, e in tokens])
    assert sorted(made) == sorted((k, *e) for k in range(20) for e in want)


def test_replies_of_no_tokens(spark):
    none = spark.createDataFrame([(None, START, 0, 1, True), (1, None, 0, 1, True)], TOKENS)
    assert replies.emissions(none).collect() == [] and replies.emissions(none.limit(0)).collect() == []


def fold(rows):
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


def test_state_outlives_runs_and_batches_can_repeat(spark, tmp_path):
    path, seen = f"{tmp_path}/table", []
    sink = jobs.merge_into(path, ["k"], buckets=4)

    def twice(rows, n):  # a driver lost after the merge: the batch comes again
        seen.append(n)
        sink(rows, n)
        sink(rows, n)

    counts = {}
    for part in range(4):
        rows = [(k, part * 10 + k) for k in range(part, 12, part + 1)]
        for k, v in rows:
            n, top = counts.get(k, (0, -1))
            counts[k] = (n + 1, max(top, v))
        spark.createDataFrame(rows, "k bigint, v bigint").write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run(spark, f"{tmp_path}/in", "k bigint, v bigint", fold, twice, f"{tmp_path}/checkpoint")  # each time a restart
        assert {r.k: (r.n, r.top) for r in spark.read.parquet(path).collect()} == counts
    assert seen == sorted(seen) and len(set(seen)) == 4
    before = sorted(map(tuple, spark.read.parquet(path).collect()))
    jobs.run(spark, f"{tmp_path}/in", "k bigint, v bigint", fold, twice, f"{tmp_path}/checkpoint")  # no new files: nothing changes
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == before


JOBS = "job bigint, status string, ts bigint, event_id bigint, partial string, progress string, reply string, error string"


def test_progress_and_reply_of_a_job(spark):
    rows = [
        (1, "running", 1, 1, "a", "reading", None, None), (1, "running", 2, 2, "ab", None, None, None), (1, "running", 3, 3, None, "judging", "whole", None), (1, "running", 4, 4, "second try", None, "other", None),
        (2, "running", 1, 5, "x", "reading", None, None), (2, "done", 2, 6, "y", "late", "z", None), (3, "error", 1, 7, None, None, None, "e" * 3000), (4, "running", 1, 8, "p", None, None, "not shown"),
    ]
    made = {r.job: r for r in logs.fold_jobs(spark.createDataFrame(rows, JOBS), ["done", "error"]).collect()}
    assert (made[1].partial, made[1].progress, made[1].reply_ready, made[1].done) == ("whole", "judging", True, False)
    assert (made[2].partial, made[2].progress, made[2].reply_ready, made[2].done) == (None, None, False, True)
    assert len(made[3].error) == 2000 and (made[4].partial, made[4].reply_ready, made[4].error) == ("p", False, None)
    streamed = {r.job: tuple(r[c] for c in ("partial", "progress", "reply_ready")) for r in jobs.job_states(spark.createDataFrame(rows, JOBS), ["done", "error"]).collect()}
    assert streamed == {k: (r.partial, r.progress, r.reply_ready) for k, r in made.items()}


def test_sets_hold_every_row_once(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(60)], "id int, o int")
    parts = [[r.id for r in p.collect()] for p in jobs.sets(rows, "o")]
    assert sorted(x for p in parts for x in p) == list(range(60))
    assert [r.id for p in jobs.sets(rows.filter("o is null"), "o") for r in p.collect()] == [i for i in range(60) if i % 7 == 0]
