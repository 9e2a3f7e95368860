"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The pretokens of the whole table are counted (partly in each task, then in a shuffle). Those that make up at least a
HOT-th of all, so HOT at most, are the corpus that is replayed once: dealt over partitions, each of which holds an inverted
index from a token pair to the positions where it stands, applies merges in rank order to every position of a pair at
once, and looks only the neighbours of a merged position up again. Their ids, a table of bounded size, are broadcast. Rarer
pretokens are replayed in the same way where they stand, those of a batch of texts together; bringing them together too
would shuffle every place where they stand, which costs more than the replay of a few short words. They are remembered
for two generations of a bounded number.

Null texts are empty and give no ids; a text of any length is taken whole; rows are independent, so repeated rows repeat,
and an empty table gives an empty table. Vocabulary files hold tens of thousands of ranks and are read by each Python
worker once.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, map_text, slices

#: Pretokens that are replayed for the whole table and broadcast (about 150 bytes each), at most.
HOT = 200_000
#: Rarer pretokens of a generation (about 200 bytes each): a worker remembers this one and the one before.
REMEMBERED = 300_000
#: Distinct pretokens that a task counts before it passes their numbers on.
COUNTED = 400_000
#: Bytes of text that a worker splits into pretokens at once.
CORPUS_BYTES = 1 << 20


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the merge of two tokens, by left << 20 | right."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                pairs[left << 20 | right] = rank
    return pairs


def byte_tables(ranks: dict[bytes, int], pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of single bytes, and ranks of the merges of two of them (-1: none)."""
    own = np.array([ranks[bytes([b])] for b in range(256)])
    return own, np.array([[pairs.get(int(a) << 20 | int(b), -1) for b in own] for a in own])


def replay(words: list[bytes], pairs: dict[int, int], tables: tuple[np.ndarray, np.ndarray]) -> list[list[int]]:
    """Token ids of each word. Ties of rank go to the leftmost place, as in one-word-at-a-time BPE."""
    if not words:
        return []
    own, first = tables
    data = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    symbols = own[data]
    symbols[ends] = -1  # no pair reaches over the end of a word
    # The inverted index: rank of a pair -> positions of its left token.
    inner = np.delete(np.arange(len(data)), ends)
    inner = inner[symbols[inner + 1] >= 0]
    rank_at = first[data[inner], data[inner + 1]]
    inner, rank_at = inner[rank_at >= 0], rank_at[rank_at >= 0]
    order = np.argsort(rank_at, kind="stable")
    some, cuts = np.unique(rank_at[order], return_index=True)
    index = {r: p.tolist() for r, p in zip(some.tolist(), np.split(inner[order], cuts[1:]), strict=True)} if len(some) else {}
    queue = list(index)
    heapify(queue)
    token = symbols.tolist()
    after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
    find, note = pairs.get, index.get
    while queue:
        rank = heappop(queue)
        places = index.pop(rank)
        places.sort(reverse=True)
        while places:
            at = places.pop()
            left, right = token[at], after[at]
            if left < 0 or find(left << 20 | token[right]) != rank:
                continue  # merged away, or its neighbour has merged since it was noted
            token[at] = rank
            token[right] = -2
            after[at] = end = after[right]
            lower = False
            if token[end] >= 0:
                before[end] = at
                if (new := find(rank << 20 | token[end])) is not None:
                    if new == rank:
                        places.append(at)
                    elif (held := note(new)) is not None:
                        held.append(at)
                    else:
                        index[new] = [at]
                        heappush(queue, new)
                    lower = new < rank
            start = before[at]
            if start >= 0 and token[start] >= 0 and (new := find(token[start] << 20 | rank)) is not None:
                if new == rank:
                    places.append(start)
                elif (held := note(new)) is not None:
                    held.append(start)
                else:
                    index[new] = [start]
                    heappush(queue, new)
                lower = lower or new < rank
            if lower and places:  # of this word, that pair comes first; the others lose nothing by waiting
                index[rank] = places
                heappush(queue, rank)
                break
    out, at = [], 0
    for length in lengths.tolist():
        ids, place, stop = [], at, at + length
        while place < stop:
            ids.append(token[place])
            place = after[place]
        out.append(ids)
        at = stop + 1
    return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pairs = pair_ranks(ranks)
        self.tables = byte_tables(ranks, self.pairs)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.hot: dict[str, bytes] | None = None

    def replayed(self, words: list[str]) -> list[bytes]:
        """Ids of pretokens, replayed together; one that is a token stays whole."""
        out, split = [], []
        for word in words:
            rank = self.ranks.get(raw := word.encode())
            out.append(None if rank is None else rank.to_bytes(4, "little"))
            if rank is None:
                split.append(raw)
        made = iter(replay(split, self.pairs, self.tables))
        return [np.array(next(made), "<u4").tobytes() if ids is None else ids for ids in out]

    def encode(self, texts: list[str], hot: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. hot: pretokens with their ids."""
        parts = [self.split(t) for t in texts]
        if self.hot is not hot:
            self.hot, self.known, self.older = hot, dict(hot), {}
        elif len(self.known) > REMEMBERED + len(hot):  # pretokens met since the last time stay known
            self.known, self.older = dict(hot), self.known
        known = self.known
        new = {w for p in parts for w in p if w not in known}
        again = new & self.older.keys()
        known.update((w, self.older[w]) for w in again)
        fresh = list(new - again)
        known.update(zip(fresh, self.replayed(fresh), strict=True))
        return [b"".join([known[w] for w in p]) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(vocabulary: str, pattern: str) -> Codec:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def pretoken_counts(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """word, n: how often each pretoken stands in the whole table."""
    split = regex.compile(pattern).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter[str] = Counter()
        for batch in slices(batches, text, CORPUS_BYTES):
            for t in batch.column(text).to_pylist():
                if t:
                    held.update(split(t))
            if len(held) >= COUNTED:
                yield told()
                held.clear()
        if held:
            yield told()

    return docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, vocabulary: str, pattern: str, most: int | None = None) -> dict[str, bytes]:
    """Ids of the pretokens that make up at least one of `most` (HOT) of all, each replayed once."""
    ws = Workspace(docs.sparkSession, "pretokens")
    counts = ws.save(pretoken_counts(docs, pattern), "counts")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return {}

    def run(words: list[str]) -> dict:
        return {"ids": pa.array(codec(vocabulary, pattern).replayed(words), pa.binary())}

    hot = counts.filter(F.col("n") >= -(-total // (most or HOT))).select("word", F.col("word").alias("text"))  # their numbers add up to no more than all
    made = map_text(hot, run, "ids binary", keep=("word",)).toArrow()
    ws.drop("counts")
    return dict(zip(made.column("word").to_pylist(), made.column("ids").to_pylist(), strict=True))


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and token_ids (little-endian unsigned 32-bit, binary) of each text.

    `vocabulary` is a file of the tokenizer package, which every node has; it is never copied. Other columns, whatever their names, are left out.
    """
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs, vocabulary, pattern))

    def run(texts: list[str]) -> dict:
        ids = codec(vocabulary, pattern).encode(texts, hot.value)
        return {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary())}

    return map_text(docs, run, "n_tokens bigint, token_ids binary", size=CORPUS_BYTES)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and decoded (binary) of rows with token_ids; a null is empty, an unknown id fails."""

    def run(ids: list[bytes]) -> dict:
        own = codec(vocabulary, pattern)
        return {"decoded": pa.array([own.decode(x) for x in ids], pa.binary())}

    return map_text(encoded, run, "decoded binary", keep=keep, text="token_ids", as_bytes=True, size=CORPUS_BYTES)


def report(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests of the ids and of the bytes that they decode to."""
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs, vocabulary, pattern))

    def run(texts: list[str]) -> dict:
        own, sha, counts, ids_sha, decoded_sha = codec(vocabulary, pattern), hashlib.sha256, [], [], []
        for ids in own.encode(texts, hot.value):
            counts.append(len(ids) // 4)
            ids_sha.append(sha(ids).hexdigest())
            decoded_sha.append(sha(own.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}

    return map_text(docs, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", size=CORPUS_BYTES)
