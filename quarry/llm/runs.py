"""Periodic runs of words by maximal-pair enumeration over the LCP-interval tree.

A run is a stretch of words with smallest period q and a length of at least max(6, 4 q) that no neighbouring word extends.
Two suffixes of a text that share l words, then differ, and stand after different words are a maximal pair; where their
distance q is at most l / 3, the stretch of l + q words from the first one on is a run, with no further extension. Runs of
all texts of a batch are found together: prefix doubling in numpy ranks the suffixes (each text has its own alphabet, so
no match leaves it) and keeps the ranks of all powers of two, from which the longest common prefixes of neighbours follow.
The tree is walked bottom-up; each node holds its positions in one sorted list and in a list for each left word, the
smaller child is looked up in the larger one within the distance allowed, and lists of the same left word are passed over.
As every run needs at least five shared words, suffixes that share no five words with another one of their text, and
intervals whose closest positions are too far apart for their longest prefix, hold no run and aren't walked.

Null texts have no words; rows are independent, so repeated rows and doc_ids repeat their runs, and an empty table gives
an empty table. A text of any length is taken whole and is the work of one task; a text of n words takes O(n log² n) for the ranks
and, with repeats of many classes, O(n^1.5) look-ups at worst. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quarry.llm.common import roll, slices

#: Words that two places of a run share at least: length >= max(6, 4 q) leaves max(5, 3 q).
SHARED = 5
#: Copies of the period that a run holds at least.
COPIES = 4
#: Bytes of text handled together.
BATCH_BYTES = 2 << 20


class Node:
    """Positions of an interval, all of them and by their left word, both sorted."""

    __slots__ = ("by_left", "places")

    def __init__(self, place: int, left: int):
        self.places, self.by_left = [place], {left: [place]}


def joined(a: Node, b: Node, shared: int, left: list[int], found: list) -> Node:
    """One node of two children of an interval of `shared` words; notes the maximal pairs between them that are runs."""
    big, small = (a, b) if len(a.places) >= len(b.places) else (b, a)
    reach, places, lists = shared // (COPIES - 1), big.places, big.by_left
    for own, some in small.by_left.items():
        for p in some:
            lo, hi = bisect_left(places, p - reach), bisect_right(places, p + reach)
            if hi - lo <= len(lists):
                met = [x for x in places[lo:hi] if left[x] != own]
            else:
                met = [x for word, part in lists.items() if word != own for x in part[bisect_left(part, p - reach) : bisect_right(part, p + reach)]]
            found.extend((min(p, x), max(p, x), shared) for x in met)
    for own, some in small.by_left.items():
        held = lists.setdefault(own, [])
        for p in some:
            insort(places, p)
            insort(held, p)
    return big


def walk(places: list[int], shared: list[int], left: list[int], found: list) -> None:
    """Bottom-up walk over one interval: suffixes in order, and the words that each shares with the one before it."""
    stack: list[tuple[int, Node]] = []
    node = Node(places[0], left[places[0]])
    for p, h in zip([*places[1:], -1], [*shared[1:], 0], strict=True):
        while stack and stack[-1][0] > h:
            depth, other = stack.pop()
            node = joined(other, node, depth, left, found)
        if stack and stack[-1][0] == h:
            node = joined(stack.pop()[1], node, h, left, found)
        stack.append((h, node))
        if p >= 0:
            node = Node(p, left[p])


def repeated(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each position's next five words may stand elsewhere in the same text (by hashes: no miss, few mistakes)."""
    n = len(words) - SHARED + 1
    out = np.zeros(len(words), bool)
    if n > 0:
        inside = text[:n] == text[SHARED - 1 :]
        grams = roll(words.astype(np.uint64), SHARED) ^ (text[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.flatnonzero(inside)[np.argsort(grams[inside], kind="stable")]
        same = grams[order][1:] == grams[order][:-1]
        out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the words that each shares with the one before it.

    Prefix doubling sorts again only what is still tied. Level k tells prefixes of 2^k words apart.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    fresh = np.r_[True, words[order][1:] != words[order][:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        first = rank[order]
        tied = np.flatnonzero(np.r_[first[1:] == first[:-1], False] | np.r_[False, first[1:] == first[:-1]])
        if not len(tied):
            break
        held = order[tied]
        second = rank[np.minimum(held + step, n)]
        again = np.lexsort((second, first[tied]))
        held, one, two = held[again], first[tied][again], second[again]
        order[tied] = held
        fresh = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        rank[held] = np.maximum.accumulate(np.where(fresh, tied, 0))
        step *= 2
        levels.append(rank.astype(np.int32))
    shared = np.zeros(n, np.int64)
    one, two = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(one, n)] == levels[k][np.minimum(two, n)]
        step = same.astype(np.int64) << k
        one += step
        two += step
        shared[1:] += step
    return order, shared


def find(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, given as word numbers, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    words = np.concatenate(texts).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    some = np.zeros(len(texts), bool)
    some[text[repeated(words, text)]] = True
    kept = some[text]
    words, text = words[kept], text[kept]
    if not len(words):
        return out
    words = words + text * (int(words.max()) + 1)  # an alphabet of its own for each text
    order, shared = suffixes(words)
    heads = np.flatnonzero((shared < SHARED) & np.r_[shared[1:] >= SHARED, False])  # first suffix of each interval of five words
    if not len(heads):
        return out
    inside = np.flatnonzero((shared >= SHARED) | np.r_[shared[1:] >= SHARED, False])
    interval = np.cumsum(shared[inside] < SHARED) - 1
    sizes = np.bincount(interval)
    place = order[inside]
    by_place = np.lexsort((place, interval))
    gaps = np.diff(place[by_place])
    gaps[np.diff(interval[by_place]) != 0] = len(words)
    closest, longest = np.full(len(sizes), len(words)), np.zeros(len(sizes), np.int64)
    np.minimum.at(closest, interval[by_place][1:], gaps)
    depth = np.where(shared[inside] >= SHARED, shared[inside], 0)
    np.maximum.at(longest, interval, depth)
    left = np.r_[-1, words[:-1]].tolist()
    starts = np.r_[0, np.cumsum(sizes)]
    found: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(closest * (COPIES - 1) <= longest).tolist():
        part = slice(starts[k], starts[k + 1])
        walk(place[part].tolist(), depth[part].tolist(), left, found)
    period: dict[tuple[int, int], int] = {}
    for p, x, h in found:
        q = x - p
        period[p, h + q] = min(q, period.get((p, h + q), q))
    offset = np.searchsorted(text, np.arange(len(texts)))
    for (start, length), q in sorted(period.items(), key=lambda r: (r[0][0], r[1])):
        k = int(text[start])
        out[k].append((start - int(offset[k]), length, q))
    return out


def split(texts: list[bytes]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words of each text, between white space of ASCII, and their numbers."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    words = [t.split() for t in texts]
    return words, [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without the words that any run repeats after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equal ones the first, then the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def per_text(docs: DataFrame, fn, ddl: str, id_column: str, text: str) -> DataFrame:
    key = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, BATCH_BYTES):
            words, numbers = split([b"" if t is None else t for t in batch.column(text).cast(pa.binary()).to_pylist()])
            made = fn(words, find(numbers))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *made.values()], names=[id_column, *made])

    return docs.select(id_column, text).mapInArrow(run, f"{key}, {ddl}")


def runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text with runs collapsed to one period."""
    kind = ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType()))

    def made(words, found):
        cells = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
        arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return {
            "n_words": pa.array([len(w) for w in words], pa.int64()),
            "runs": pa.array(cells, arrow),
            "collapsed": pa.array([collapsed(w, r).decode() for w, r in zip(words, found, strict=True)], pa.string()),
        }

    return per_text(docs, made, f"n_words bigint, runs {kind.simpleString()}, collapsed string", id_column, text)


def report(docs: DataFrame) -> DataFrame:
    """Digest columns of the runs of each text; see `runs` for the runs themselves."""

    def made(words, found):
        best = [strongest(r) or (None, None, None) for r in found]
        sha = hashlib.sha256
        return {
            "n_runs": pa.array([len(r) for r in found], pa.int64()),
            "start": pa.array([b[0] for b in best], pa.int64()),
            "length": pa.array([b[1] for b in best], pa.int64()),
            "period": pa.array([b[2] for b in best], pa.int64()),
            "exponent_milli": pa.array([None if b[2] is None else 1000 * b[1] // b[2] for b in best], pa.int64()),
            "runs_sha256": pa.array([sha("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in found], pa.string()),
            "collapsed_sha256": pa.array([sha(collapsed(w, r)).hexdigest() for w, r in zip(words, found, strict=True)], pa.string()),
        }

    return per_text(docs, made, "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string", "doc_id", "text")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one document of ten (by the checksum of its id) is periodic from some word on.

    A null doc_id or text is left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("__words"), F.floor(h / 10).cast("bigint").alias("__g"))
    n = F.size("__words").cast("bigint")
    cut = chosen.withColumn("__a", F.when(n > 0, F.col("__g") % n))
    cut = cut.withColumn("__p", 1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8)).cast("bigint"))
    told = F.expr("array_join(concat(slice(__words, 1, int(__a)), transform(sequence(bigint(0), size(__words) - 1 - __a), i -> __words[int(__a + i % __p)])), ' ')")
    return cut.select("doc_id", F.when(F.col("__a").isNotNull(), told).otherwise(F.col("text")).alias("text"))
