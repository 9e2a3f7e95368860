"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Training texts are scanned once by windows of `n` words whose hashes are looked up in the sorted set of benchmark
windows; each hit is verified word by word. An item of fewer words than n is one window of its own length. Null or
wordless texts and items have no windows and hit nothing; very long texts are scanned whole. Repeated items with equal
windows each count. Rows are independent: repeated rows repeat, whatever their doc_id. An empty benchmark marks nothing,
an empty table gives an empty table. Columns named __row are the operator's; others, whatever their names, stay.

The window set is broadcast only up to MAX_BROADCAST_WINDOWS (a window of ten words takes about 200 bytes in a worker).
A larger benchmark is scanned in several passes of that size, each with its own broadcast, freed before the next; one
item is never split over passes. Rows get a number that is
written once with their texts, and the passes' hits are merged by it, so that results don't depend on the passes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD_BYTES, Workspace, hash_words, map_text, roll, slices

MAX_BROADCAST_WINDOWS = 1_000_000
WINDOW = 10


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """Benchmark windows by length: sorted hashes, and for each hash its word tuples with their items."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.by_length: dict[int, tuple[np.ndarray, dict]] = {}
        found: dict[int, dict] = {}
        for item, text in items:
            words = words_of(text)
            k = min(n, len(words))
            if k:
                grams = found.setdefault(k, {})
                for i, h in enumerate(roll(hash_words(words), k).tolist()):
                    grams.setdefault(h, {}).setdefault(tuple(words[i : i + k]), set()).add(item)
        for k, grams in found.items():
            self.by_length[k] = (np.array(sorted(grams), np.uint64), grams)

    def hits(self, text: bytes) -> tuple[int, np.ndarray, set]:
        """Number of words, a flag for each word inside an occurrence, and the items met."""
        words = words_of(text)
        flags, met = np.zeros(len(words) + 1, np.int64), set()
        hashes = hash_words(words)
        for k, (known, grams) in self.by_length.items():
            own = roll(hashes, k)
            if not len(own):
                continue
            place = np.searchsorted(known, own)
            place[place == len(known)] = 0
            for at in np.flatnonzero(known[place] == own).tolist():
                if (items := grams[int(own[at])].get(tuple(words[at : at + k]))) is not None:
                    met |= items
                    flags[at] += 1
                    flags[at + k] -= 1
        return len(words), np.cumsum(flags)[: len(words)] > 0, met


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words bigint, hit_spans array<struct<start:bigint,end:bigint>>, items array<string>"


def items_of(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Items with a text, and the number of passes that they take."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows, max(1, -(-total // (2 * MAX_BROADCAST_WINDOWS)))  # a word takes two characters at least


def windows_of(rows: DataFrame, n: int, k: int, passes: int):
    """Broadcast windows of the k-th pass."""
    part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k) if passes > 1 else rows
    return rows.sparkSession.sparkContext.broadcast(Windows([(r.item, r.text.encode()) for r in part.collect()], n))


def passed(rows: DataFrame, n: int, passes: int, ws: Workspace, search_one) -> list[DataFrame]:
    """The written result of each pass; a pass's windows are freed before the next ones are made."""
    made = []
    for k in range(passes):
        windows = windows_of(rows, n, k, passes)
        made.append(ws.save(search_one(windows), f"pass{k}"))
        windows.unpersist(blocking=True)
    return made


def numbered(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The rows with a number of their own, __row, which stays the same over all passes."""
    return ws.save(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def search(docs: DataFrame, windows, keep: tuple[str, ...]) -> DataFrame:
    """For each row: `keep`, n_words, hit_spans and items of one pass."""

    def run(texts: list[bytes]) -> dict:
        counts, spans, met = [], [], []
        for text in texts:
            count, flags, items = windows.value.hits(text)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
            counts.append(count)
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            met.append(sorted(items))
        return {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, SPAN), "items": pa.array(met, pa.list_(pa.string()))}

    return map_text(docs, run, FOUND, keep=keep, as_bytes=True)


def joined(spans: list[dict]) -> list[dict]:
    """Spans that overlap or touch as one, in order."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """For each document: doc_id, n_words, hit_spans (word positions, end exclusive) and items (ids as strings, sorted)."""
    rows, passes = items_of(benchmark)
    if passes == 1:
        return search(docs, windows_of(rows, n, 0, 1), ("doc_id",))
    ws = Workspace(docs.sparkSession, "decontam")
    own = numbered(docs.select("doc_id", "text"), ws)
    found = passed(rows, n, passes, ws, lambda windows: search(own, windows, ("__row", "doc_id")))
    flat = reduce(DataFrame.unionAll, [found[0], *[f.filter(F.size("items") > 0) for f in found[1:]]])
    each = flat.groupBy("__row", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("hit_spans")
            yield batch.set_column(at, "hit_spans", pa.array([joined(s) for s in batch.column(at).to_pylist()], SPAN))

    made = each.select("doc_id", "n_words", "hit_spans", "items")
    return made.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def hit_words(spans):
    """Words inside any of the spans, which may overlap."""
    ordered = F.array_sort(spans)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("reach"))
    add = lambda a, s: F.struct((a.n + F.greatest(F.lit(0).cast("bigint"), s.end - F.greatest(s.start, a.reach))).alias("n"), F.greatest(a.reach, s.end).alias("reach"))
    return F.aggregate(ordered, zero, add, lambda a: a.n)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan(docs, benchmark)
    hit = hit_words(F.col("hit_spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns.

    Decided row by row; a null or repeated doc_id is kept or dropped by its own text.
    """
    rows, passes = items_of(benchmark)
    if passes > 1:
        ws = Workspace(docs.sparkSession, "decontam")
        own = numbered(docs, ws)
        found = passed(rows, WINDOW, passes, ws, lambda windows: search(own, windows, ("__row",)).filter(F.size("items") > 0).select("__row"))
        return own.join(reduce(DataFrame.unionAll, found), "__row", "left_anti").select(*docs.columns)
    windows = windows_of(rows, WINDOW, 0, 1)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            keep = [t is None or not windows.value.hits(t)[1].any() for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

