"""Alignment of two tokenizers on the same texts: a byte-level BPE (A) and a SentencePiece model (B).

Both see a space and the text (B adds that space itself). Spans that the libraries report are coarse cuts: A's are of
characters, and all bytes of a character that was split share its span. Where a span is as long as the bytes that its
token decodes to, it stands; elsewhere the decoded bytes tell where the token ends. Places where tokens of both end cut
the text into groups, and the last tokens of a group are linked.

Neither tokenizer joins what stands on both sides of a single space between two characters that are no white space
(checked when the files are read; otherwise texts stay whole), so texts are cut there and pieces met before are looked
up. How often two ids are linked in the whole corpus comes from partial sums, merged in a shuffle. Pairs of at least a
millionth of all links, thus a million at most, are broadcast to where the texts' links are; the others, none of which
is a hot key, meet the texts' links in a shuffle.

Null and empty texts, and texts whose bytes the tokens don't give back (such as those with U+2581), have no tokens:
zeros and an empty digest. Rows are told apart by a number given once, so repeated rows and doc_ids count each for
themselves; an empty table gives an empty table; other columns, whatever their names, are left out; a text of any length
is taken whole, by one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, slices

#: Pieces of text of a generation (about 400 bytes each): a worker remembers this one and the one before.
REMEMBERED = 300_000
#: Bytes of text handled together.
BATCH_BYTES = 1 << 20
#: Pairs that are broadcast at most.
HOT = 1_000_000
#: Links of texts that a task adds up before it passes pairs on.
SUMMED = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refined(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: of a span as long as its token's bytes its own end, of others the end before and those bytes."""
    whole = ends - begins == sizes
    known = np.maximum.accumulate(np.where(whole, np.arange(len(sizes)), -1))
    upto = np.cumsum(sizes)
    return np.where(known >= 0, ends[known] - upto[known], 0) + upto


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet.get(c, 0) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.pairs_of_a = len(pieces)
        with open(a_path, encoding="utf-8") as file:
            rules = json.load(file)
        cut = (rules.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and rules["pre_tokenizer"].get("use_regex", True) and not rules.get("normalizer")
        cut = cut and not any("▁" in p.lstrip("▁") for p in pieces)
        self.cut = re.compile(r"(?<=\S) (?=\S)").split if cut else lambda text: [text]
        self.known: dict[str, tuple[int, int, int, str, bytes] | None] = {}
        self.older: dict[str, tuple[int, int, int, str, bytes] | None] = {}

    def learn(self, bodies: list[str]) -> None:
        """Aligns pieces of text that stand after a space, all of them as one row of bytes."""
        if not bodies:
            return
        first = self.a.encode_batch([" " + s for s in bodies], add_special_tokens=False)
        second = self.b.encode(bodies, return_type="offset_mapping", return_bytes=True, num_threads=1)
        raw = [b" " + s.encode() for s in bodies]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        a, a_of, a_begins, a_ends, a_sizes, a_data = self.row([x.ids for x in first], [x.offsets for x in first], self.a_bytes)
        b, b_of, b_begins, b_ends, b_sizes, b_data = self.row([y["ids"] for y in second], [y["offsets"] for y in second], self.b_bytes)
        # Bodies that tokens of both give back; the others have no tokens.
        good = np.ones(len(bodies), bool)
        for of, lengths, made in ((a_of, a_sizes, a_data), (b_of, b_sizes, b_data)):
            if not np.array_equal(made, data):
                came = np.bincount(of, lengths, len(bodies)).astype(np.int64)
                good &= came == sizes
                stops, starts = np.cumsum(sizes), np.cumsum(came)
                for k in np.flatnonzero(good).tolist():
                    good[k] = np.array_equal(made[starts[k] - came[k] : starts[k]], data[stops[k] - sizes[k] : stops[k]])
        if not good.all():
            self.known.update((bodies[k], None) for k in np.flatnonzero(~good).tolist())
            self.learn([bodies[k] for k in np.flatnonzero(good).tolist()])
            return
        base = np.cumsum(sizes) - sizes
        heads = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # where characters begin
        chars = np.searchsorted(heads, base)
        a_stop = refined(heads[a_begins + chars[a_of]], heads[a_ends + chars[a_of]], a_sizes)
        lead = np.r_[True, b_of[1:] != b_of[:-1]] & (b_begins == 0)  # B's first token has the space, which its offsets leave out
        b_stop = refined(b_begins + base[b_of] + ~lead, b_ends + base[b_of] + 1, b_sizes)
        a_cut = np.flatnonzero(np.isin(a_stop, b_stop, assume_unique=True)) + 1
        b_cut = np.flatnonzero(np.isin(b_stop, a_stop, assume_unique=True)) + 1
        pairs = a[a_cut - 1] * self.pairs_of_a + b[b_cut - 1]
        said, also = list(map(str, a.tolist())), list(map(str, b.tolist()))
        told, i, j = [], 0, 0
        for x, y in zip(a_cut.tolist(), b_cut.tolist(), strict=True):
            told.append(f"{said[i] if x == i + 1 else ','.join(said[i:x])}|{also[j] if y == j + 1 else ','.join(also[j:y])}")
            i, j = x, y
        n_a, n_b, n = (np.bincount(of, minlength=len(bodies)).tolist() for of in (a_of, b_of, a_of[a_cut - 1]))
        at = 0
        for k, body in enumerate(bodies):
            self.known[body] = (n_a[k], n_b[k], n[k], ";".join(told[at : at + n[k]]), pairs[at : at + n[k]].tobytes())
            at += n[k]

    @staticmethod
    def row(ids: list, spans: list, raw) -> tuple[np.ndarray, ...]:
        """Ids of all bodies in a row, the body of each, begins and ends of its span, its bytes' number, and all bytes."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        edges = np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int64, 2 * len(flat))
        parts = list(map(raw.__getitem__, flat.tolist()))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return flat, np.repeat(np.arange(len(ids)), counts), edges[::2], edges[1::2], sizes, np.frombuffer(b"".join(parts), np.uint8)

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, bytes]]:
        """Tokens of A, tokens of B, groups, groups as text, and linked pairs as 64-bit integers (a * size of B's vocabulary + b)."""
        parts = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:  # pieces met since the last time stay known
            self.known, self.older = {}, self.known
        new = {p for some in parts for p in some if p not in self.known}
        again = new & self.older.keys()
        self.known.update((p, self.older[p]) for p in again)
        self.learn(list(new - again))
        out = []
        for some in parts:
            made = list(map(self.known.__getitem__, some))
            if not made or None in made:
                out.append((0, 0, 0, "", b""))
            else:
                a, b, n, told, pairs = zip(*made, strict=True)
                out.append((sum(a), sum(b), sum(n), ";".join(told), b"".join(pairs)))
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def vocabulary_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def groups(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2`, with `digests` their SHA-256), and the distinct linked pairs with their counts.

    pairs (ascending, 64-bit) and counts (32-bit) are packed little-endian integers; a pair is a * size of B's vocabulary + b.
    """
    key = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in slices(batches, text, BATCH_BYTES):
            made = own.align(batch.column(text).to_pylist())
            told = [m[3] if not digests or not m[3] else hashlib.sha256(m[3].encode()).hexdigest() for m in made]
            pairs = [np.unique(np.frombuffer(m[4], np.int64), return_counts=True) for m in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), *(pa.array([m[k] for m in made], pa.int64()) for k in range(3)), pa.array(told, pa.string()),
                 pa.array([p.astype("<i8").tobytes() for p, _ in pairs], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in pairs], pa.binary())],
                names=[id_column, "n_a", "n_b", "n_groups", "groups", "pairs", "counts"],
            )

    return docs.select(id_column, text).mapInArrow(run, f"{key}, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs binary, counts binary")


def pair_counts(grouped: DataFrame, b_size: int) -> DataFrame:
    """pair, links (in the whole corpus) and best (whether no pair of the same B id has more)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            pair, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            links = np.bincount(place, np.concatenate([n for _, n in held]), len(pair)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(links, pa.int64())], names=["pair", "links"])

        for batch in batches:
            for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if pairs:
                    held.append((np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<u4")))
                    size += len(pairs) // 8
                if size >= SUMMED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    links = grouped.select("pairs", "counts").mapInArrow(summed, "pair bigint, links bigint").groupBy("pair").agg(F.sum("links").alias("links"))
    return links.withColumn("b", F.col("pair") % b_size)


def with_links(grouped: DataFrame, counted: DataFrame, session_counts: tuple[int, int]) -> DataFrame:
    """Each row of `grouped` (which has __row) with n_best and count_sum over its links."""
    spark = grouped.sparkSession
    total, limit = session_counts
    least = -(-total // limit) if total else 1
    hot = counted.where(F.col("links") >= least).select("pair", "links", "best").toArrow()  # at most `limit` rows: their links add up to no more than `total`
    pair = hot.column("pair").to_numpy()
    order = np.argsort(pair)
    told = spark.sparkContext.broadcast((pair[order], hot.column("links").to_numpy()[order], np.asarray(hot.column("best").to_numpy(zero_copy_only=False), bool)[order]))

    def known(pairs: bytes, counts: bytes):
        keys, links, best = told.value
        own, n = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64)
        place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        found = keys[place] == own if len(keys) else np.zeros(len(own), bool)
        return own, n, place, found, links, best

    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_best, count_sum = [], []
            for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                _, n, place, found, links, best = known(pairs, counts)
                place, n = place[found], n[found]
                n_best.append(int(n[best[place]].sum()))
                count_sum.append(int((n * links[place]).sum()))
            kept = [c for c in batch.schema.names if c not in ("pairs", "counts")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*kept, "__n_best", "__count_sum"])

    def rare_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own_pairs, own_counts = [], [], []
            for row, pairs, counts in zip(batch.column("__row").to_pylist(), batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own, n, _, found, _, _ = known(pairs, counts)
                rows.append(np.full(int((~found).sum()), row, np.int64))
                own_pairs.append(own[~found])
                own_counts.append(n[~found])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (rows, own_pairs, own_counts)], names=["__row", "pair", "n"])

    kept = [f for f in grouped.schema.fields if f.name not in ("pairs", "counts")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    firm = grouped.mapInArrow(hot_sums, f"{ddl}, __n_best bigint, __count_sum bigint")
    if not counted.where(F.col("links") < least).limit(1).count():
        return firm.withColumnsRenamed({"__n_best": "n_best", "__count_sum": "count_sum"}).drop("__row")
    rare = grouped.select("__row", "pairs", "counts").mapInArrow(rare_links, "__row bigint, pair bigint, n bigint")
    rare = rare.join(counted.where(F.col("links") < least).select("pair", "links", "best"), "pair")
    sums = rare.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("__b"), F.sum(F.col("n") * F.col("links")).alias("__c"))
    both = firm.join(sums, "__row", "left")
    n_best = (F.col("__n_best") + F.coalesce("__b", F.lit(0))).alias("n_best")
    return both.select(*[c for c in firm.columns if not c.startswith("__")], n_best, (F.col("__count_sum") + F.coalesce("__c", F.lit(0))).alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, digests: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (text; with `digests` groups_sha256)."""
    ws = Workspace(docs.sparkSession, "alignment")
    grouped = ws.save(groups(docs, a_path, b_path, digests=digests).withColumn("__row", F.monotonically_increasing_id()), "groups")
    counted = ws.save(pair_counts(grouped, vocabulary_size(b_path)), "counts")
    top = counted.groupBy("b").agg(F.max("links").alias("most"))  # no more rows than B has ids
    counted = ws.save(counted.join(F.broadcast(top), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "pairs")
    total = counted.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]
    out = with_links(grouped, counted, (total, hot))
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", F.col("groups").alias("groups_sha256" if digests else "groups"))
