"""Greedy runs of neighbours, exact for groups of any size.

A run is closed by the first row that no longer fits, so each row's run depends on all before it. Rows are dealt over
parts by range of their order. A part says what it makes of every way in which a run can come in: only the few rows that
can be the first not to fit matter for that. The parts' answers, small rows, are followed in order, and each part then
numbers its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.sinks import shared_folder

#: Characters between two rows of a run.
GAP = 2
#: Characters of text in a part of `Strung`, its rows, and parts at most (beyond which parts grow with the input).
PART_CHARS, PART_ROWS, MOST_PARTS = 16 << 20, 1 << 16, 512
#: What a part makes of the run that comes in, and where the first run begins in it (null: nowhere).
ENTRIES = "g string, part int, run bigint, size bigint, count bigint, n bigint, first bigint, first_run bigint, runs bigint"


def tails(n: np.ndarray, limit: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a run that begins at each row: the row that begins the next one (len(n): none); and at the part's end the runs
    closed, and the size and rows of the open one."""
    size = len(n)
    before = np.concatenate([[0], np.cumsum(n + GAP)])
    following, j = np.empty(size, np.int64), 0
    for i in range(size):
        j = max(j, i + 1)
        while j < size and j - i < most and before[j] - before[i] + n[j] <= limit:
            j += 1
        following[i] = j
    closed, open_size, open_rows = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for i in range(size - 1, -1, -1):
        k = following[i]
        if k == size:
            open_size[i], open_rows[i] = before[size] - before[i], size - i
        else:
            closed[i], open_size[i], open_rows[i] = closed[k] + 1, open_size[k], open_rows[k]
    return following, closed, open_size, open_rows


def breaks(n: np.ndarray, limit: int, most: int, most_known: bool) -> list[int]:
    """Rows that can be the first not to fit into a run that comes in: those that reach further than all before them, and
    with a bound of rows the first so many."""
    reach = np.concatenate([[0], np.cumsum(n + GAP)])[:-1] + n
    rows, best = set(range(min(most, len(n)))) if most_known else set(), -1
    for j, r in enumerate(reach.tolist()):
        if r > best:
            rows.add(j)
            best = r
        if best > limit:
            break
    return sorted(rows)


def pack(rows: DataFrame, group: str, order: str, limit: int | str, most: int | None = None) -> DataFrame:
    """group, run (from 0), rows, chars: runs of at most `limit` characters with GAP between rows, and `most` rows; a row
    that is larger alone is a run. rows: group, order (a number), text. A limit that is a name is a column, the same in all rows of a group."""

    def whole(numbers: np.ndarray, n: np.ndarray, made: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame(made, columns=["run", "rows", "chars"])

    made = dealt(rows, group, order, limit, most, whole, "run bigint, rows bigint, chars bigint")
    return made.filter("rows > 0").groupBy(F.col("g").alias(group), "run").agg(F.sum("rows").alias("rows"), F.sum("chars").alias("chars"))


def assigned(rows: DataFrame, group: str, order: str, limit: int | str, most: int | None = None) -> DataFrame:
    """group, order, run: the run of each row (see `pack`)."""

    def each(numbers: np.ndarray, n: np.ndarray, made: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"o": numbers, "run": np.repeat([r for r, _, _ in made], [k for _, k, _ in made])})

    made = dealt(rows, group, order, limit, most, each, "o bigint, run bigint")
    return made.select(F.col("g").alias(group), F.col("o").alias(order), "run")


def entered(parts: DataFrame, top: int, most_known: bool) -> DataFrame:
    """ENTRIES: for each group and part, in order, the run that comes in (its number, size and rows), the part's rows, its
    first row that begins a run with that run's number, and the group's runs so far. parts: g, o, n, limit, part."""

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("o")
        n, limit = frame.n.to_numpy(), int(frame.limit.iloc[0])
        _, closed, size, count = tails(n, limit, top)
        at = breaks(n, limit, top, most_known)
        reach = (np.concatenate([[0], np.cumsum(n + GAP)])[:-1] + n)[at]
        places = [None if pd.isna(o) else int(o) for o in frame.o.iloc[[0, *at]]]
        row = [frame.g.iloc[0], int(frame.part.iloc[0]), limit, len(n), int((n + GAP).sum()), at, reach.tolist(), closed[at].tolist(), size[at].tolist(), count[at].tolist(), places, int(closed[0]), int(size[0]), int(count[0])]
        return pd.DataFrame([row], columns=["g", "part", "limit", "n", "total", "at", "reach", "closed", "size", "count", "places", "closed0", "size0", "count0"])

    lists = ", ".join(f"{c} array<bigint>" for c in ("at", "reach", "closed", "size", "count", "places"))
    summaries = parts.groupBy("g", "part").applyInPandas(summary, f"g string, part int, limit bigint, n bigint, total bigint, {lists}, closed0 bigint, size0 bigint, count0 bigint")

    def first_break(r, size: int, count: int) -> int | None:
        """Place in `at` of the first row that doesn't fit into a run of this size and number of rows."""
        fits = [k for k, (j, reach) in enumerate(zip(r.at, r.reach, strict=True)) if size + reach > r.limit or j + count >= top]
        return fits[0] if fits and r.at[fits[0]] < r.n else None

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        out, run, size, count = [], 0, 0, 0
        for r in frame.sort_values("part").itertuples():
            came, first = (run, size, count), None
            if not count:
                first, began = r.places[0], run
                run, size, count = run + r.closed0, r.size0, r.count0
            elif (k := first_break(r, size, count)) is None:
                size, count = size + r.total, count + r.n
            else:
                first, began = r.places[k + 1], run + 1
                run, size, count = run + 1 + r.closed[k], r.size[k], r.count[k]
            out.append((r.g, r.part, *came, r.n, first, None if first is None else began, run + 1))
        columns = zip((f.split()[0] for f in ENTRIES.split(", ")), zip(*out, strict=True), strict=True)
        return pd.DataFrame({c: pd.array(v, dtype="Int64") if c.startswith("first") else v for c, v in columns})

    return summaries.groupBy("g").applyInPandas(chain, ENTRIES)  # one small row a part


def dealt(rows: DataFrame, group: str, order: str, limit: int | str, most: int | None, tell, fields: str) -> DataFrame:
    """What `tell` makes of each part's order numbers, sizes and runs (run, rows, chars)."""
    spark, top = rows.sparkSession, most or 1 << 60
    path = shared_folder(spark, "pack")
    most_chars = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    sized = rows.select(F.col(group).cast("string").alias("g"), F.col(order).cast("bigint").alias("o"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"), most_chars.cast("bigint").alias("limit"))
    sized.repartitionByRange("g", "o").select("*", F.spark_partition_id().alias("part")).write.parquet(path)
    parts = spark.read.schema("g string, o bigint, n bigint, limit bigint, part int").parquet(path)
    entries = entered(parts, top, most is not None)
    names = ["g", *(f.split()[0] for f in fields.split(", "))]

    def assign(key, frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame({c: [] for c in names})
        frame = frame.sort_values("o")
        n, limit = frame.n.to_numpy(), int(frame.limit.iloc[0])
        following, *_ = tails(n, limit, top)
        run, size, count = (int(entry[c].iloc[0]) for c in ("run", "size", "count"))
        start, out = 0, []
        if count:  # rows that go on with the run that came in
            reach = np.concatenate([[0], np.cumsum(n + GAP)])[:-1] + n
            over = np.flatnonzero((size + reach > limit) | (np.arange(len(n)) + count >= top))
            start = int(over[0]) if len(over) else len(n)
            out.append((run, start, int(n[:start].sum())))
            run += 1
        while start < len(n):
            stop = int(following[start])
            out.append((run, stop - start, int(n[start:stop].sum())))
            run, start = run + 1, stop
        return tell(frame.o.to_numpy(), n, out).assign(g=frame.g.iloc[0])[names]

    return parts.groupBy("g", "part").cogroup(entries.groupBy("g", "part")).applyInPandas(assign, f"g string, {fields}")


class Strung:
    """Runs of at most `limit` characters as texts, found by sizes alone: texts move once, and so that a run's rows meet.

    rows: key (a string), place (a bigint), n (characters of text), text, none of them null; a stored table, of which the
    sizes are read apart from the texts. The bounds of the parts, MOST_PARTS at most, are rows that begin a run, so that
    no run is in two parts.
    """

    def __init__(self, rows: DataFrame, limit: int, path: str):
        spark, self.rows, self.limit = rows.sparkSession, rows, limit
        sized = rows.select(F.col("key").alias("g"), F.col("place").alias("o"), "n", F.lit(limit).cast("bigint").alias("limit"))
        chars, n = rows.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.count = min(MOST_PARTS, 1 + max((chars or 0) // PART_CHARS, n // PART_ROWS))
        if self.count == 1:
            parts = sized.withColumn("part", F.lit(0))
        else:
            sized.repartitionByRange(self.count, "g", "o").select("*", F.spark_partition_id().alias("part")).write.parquet(f"{path}/parts")
            parts = spark.read.schema("g string, o bigint, n bigint, limit bigint, part int").parquet(f"{path}/parts")
        entered(parts, 1 << 60, False).write.parquet(f"{path}/entries")
        self.entries = spark.read.schema(ENTRIES).parquet(f"{path}/entries")
        self.bounds = sorted(self.entries.filter("first is not null").groupBy("part").agg(F.min(F.struct("g", "first")).alias("b")).select("b.*", "part").collect()) if self.count > 1 else []

    def sizes(self) -> DataFrame:
        """key, notes, runs: rows and runs of each key."""
        return self.entries.groupBy(F.col("g").alias("key")).agg(F.sum("n").alias("notes"), F.max("runs").alias("runs"))

    def part(self) -> Column:
        """The part whose bound is the last that isn't behind a row; looked up among every 32nd bound, then among 32."""
        if len(self.bounds) < 2:
            return F.lit(self.bounds[0].part if self.bounds else 0)
        own, step = F.struct("key", "place"), 32
        listed = lambda rows: F.array(*[F.struct(F.lit(r.g).alias("key"), F.lit(r.first).cast("bigint").alias("place")) for r in rows])
        reached = lambda bounds: F.size(F.filter(bounds, lambda b: b <= own))
        skipped = (reached(listed(self.bounds[::step])) - 1) * step
        return F.element_at(F.array(*[F.lit(r.part) for r in self.bounds]), skipped + reached(F.slice(listed(self.bounds), skipped + 1, step)))

    def texts(self, keys: DataFrame, runs: int | None = None) -> DataFrame:
        """key, run (from 0), text, chars: the texts of each run in order, a blank line between, and their characters without
        these lines. keys: key; only their runs are told, with `runs` the first so many of each."""
        limit, known = self.limit, runs or 1 << 60
        begun = self.entries.filter("first is not null").join(keys.select(F.col("key").alias("g"), F.lit(True).alias("told")), "g", "left")
        begun = begun.select("part", F.col("g").alias("key"), F.col("first").alias("place"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("text"), F.when(F.col("told"), F.col("first_run")).otherwise(-1).alias("run"))
        own = self.rows.select(self.part().alias("part"), "key", "place", "n", F.col("text").cast("binary").alias("text"), F.lit(None).cast("bigint").alias("run"))

        def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A part's rows in order; before a key's first row a row with the number of the run that it begins (-1: not told)."""
            key, run, size, chars, waiting = None, -1, 0, 0, []

            def told(made: list) -> pa.RecordBatch:
                columns = list(zip(*made, strict=True)) or [()] * 4
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["key", "run", "text", "chars"])

            for batch in batches:
                made = []
                for k, n, text, begins in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "text", "run")), strict=True):
                    if begins is None and (run < 0 or run >= known):
                        continue
                    if waiting and (begins is not None or size + n > limit):
                        made.append((key, run, b"\n\n".join(waiting), chars))
                        run, size, chars, waiting = run + 1, 0, 0, []
                    if begins is not None:
                        key, run = k, begins
                    elif run < known:
                        waiting.append(text)
                        size, chars = size + n + GAP, chars + n
                yield told(made)
            if waiting:
                yield told([(key, run, b"\n\n".join(waiting), chars)])

        ordered = own.unionByName(begun).repartition(self.count, "part").sortWithinPartitions("part", "key", "place", F.col("run").isNull())
        made = ordered.select("key", "n", "text", "run").mapInArrow(string, "key string, run bigint, text binary, chars bigint")
        return made.withColumn("text", F.col("text").cast("string"))
