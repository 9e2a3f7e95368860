"""SentencePiece encoding and decoding that keeps offsets (BPE models with byte fallback).

A text is normalised from left to right: at each place the longest key of the model's compiled character map (a double
array of 32-bit units) is replaced, any other character stands for itself, and spaces become U+2581. With each byte of the normal form the
byte of the source is recorded where the replaced characters began. Pieces are merged in the normal form and projected
through that alignment to byte spans of the source. As no piece of such a model holds U+2581 after another character
(checked when it is loaded), merges never cross the start of a word, and words met before are looked up.

Null texts are empty and give no ids; a text of any length is taken whole; rows are independent, so repeated rows
repeat, and an empty table gives an empty table. Other columns, whatever their names, are left out. Model files are read
by each Python worker once. Pieces of a character that is not in the vocabulary are its bytes: the last of them spans the
character, those before it nothing.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Words of a generation (about 250 bytes each): a worker remembers this one and the one before.
REMEMBERED = 500_000
#: Characters of a word from which pairs are kept in a queue.
LONG = 48
#: No piece: worse than any score.
NONE = float("inf")
#: Bytes of text handled together.
BATCH_BYTES = 1 << 20


class CharacterMap:
    """A compiled character map: a double-array trie over bytes, and the strings that its values point to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        self.plain = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in range(128) if b != 32 and self.longest(bytes([b]), 0, first=True) is None) + b"]+")

    @staticmethod
    def step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int, first: bool = False) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key at `at`; with `first`, anything at all where a key begins so."""
        if not self.units:
            return None
        found, place = None, self.step(self.units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            unit = self.units[place]
            if unit & 0x800000FF != data[i]:
                break
            if first:
                return 1, b""
            place ^= self.step(unit)
            if unit & 256:
                start = self.units[place] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(0, start)]
        return found


def normalise(text: str, keys: CharacterMap, dummy_prefix: bool, extra_spaces_removed: bool, space: str = SPACE) -> tuple[bytes, np.ndarray]:
    """Normal form, and for each of its bytes (and its end) the byte of the source where it comes from."""
    data, mark = text.encode(), space.encode()
    if not keys.units and not extra_spaces_removed:  # each character stands for itself
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        heads = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0))
        align = np.repeat(heads, np.where(raw == 32, len(mark), 1))
        front = len(mark) if dummy_prefix else 0
        return mark[:front] + data.replace(b" ", mark), np.concatenate([np.zeros(front, np.int64), align, [len(raw)]])
    at = 0

    def one() -> tuple[int, bytes]:
        """Length of what stands at `at`, and what it becomes."""
        size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
        return keys.longest(data, at) or (size, data[at : at + size])

    if extra_spaces_removed:
        while at < len(data) and (found := one())[1] == b" ":
            at += found[0]
    if at == len(data):
        return b"", np.zeros(1, np.int64)
    out, align = [mark] * dummy_prefix, [at] * (len(mark) * dummy_prefix)
    spaced = extra_spaces_removed  # a space here would follow another one, or begin the text
    while at < len(data):
        if (run := keys.plain.match(data, at)) is not None:
            length, made, spaced = run.end() - at, run.group(), False
            align.extend(range(at, run.end()))
        else:
            length, made = one()
            if spaced:
                made = made.lstrip(b" ")
            if made:
                spaced = extra_spaces_removed and made.endswith(b" ")
            made = made.replace(b" ", mark)
            align.extend([at] * len(made))
        out.append(made)
        at += length
    whole = b"".join(out)
    if extra_spaces_removed:
        while whole.endswith(mark):
            at = align[len(whole) - len(mark)]
            whole = whole[: -len(mark)]
            del align[len(whole) :]
    return whole, np.array([*align, at], np.int64)


class Model:
    """Vocabulary and rules of a model file."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto.FromString(raw)
        kind = proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and leading spaces is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.scores = {p.piece: -p.score for p in model.pieces if p.type == kind.NORMAL}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.byte_of[i] = int(p.piece[1:-1], 16)
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN}
        self.unknown_text = model.trainer_spec.unk_surface
        spec = model.normalizer_spec
        if not spec.escape_whitespaces:
            raise ValueError("a model that escapes spaces is needed")
        self.keys = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.extra_spaces_removed = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile("(?s).+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.sizes = np.array([1 if i in self.byte_of else len(p.encode()) for i, p in enumerate(self.pieces)], np.int64)
        self.plain_bytes = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for i, b in self.byte_of.items()}
        self.simple_start = [not self.extra_spaces_removed and self.dummy_prefix and i in self.plain_bytes and p.startswith(SPACE) for i, p in enumerate(self.pieces)]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: str) -> list[str]:
        """Pieces of a word: of all neighbours that together are a piece, those of the best score first, then the leftmost."""
        if len(word) > LONG:
            return self.merge_long(word)
        find, parts = self.scores.get, list(word)
        ranks = [find(a + b, NONE) for a, b in zip(word, word[1:], strict=False)]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            parts[i : i + 2] = [piece := parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = find(parts[i - 1] + piece, NONE)
            if i < len(ranks):
                ranks[i] = find(piece + parts[i + 1], NONE)
        return parts

    def merge_long(self, word: str) -> list[str]:
        """The same with a queue of pairs, for words of any length."""
        symbols: list[str | None] = list(word)
        scores = self.scores
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        queue = [(scores[p], i, p) for i, p in enumerate(map("".join, zip(symbols, symbols[1:], strict=False))) if p in scores]
        heapify(queue)
        while queue:
            _, i, piece = heappop(queue)
            left = symbols[i]
            if left is None or (j := after[i]) >= len(symbols) or len(left) + len(symbols[j]) != len(piece):
                continue  # merged since it was noted
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < len(symbols):
                before[k] = i
                if (new := piece + symbols[k]) in scores:
                    heappush(queue, (scores[new], i, new))
            if (k := before[i]) >= 0 and (new := symbols[k] + piece) in scores:
                heappush(queue, (scores[new], k, new))
        return [s for s in symbols if s is not None]

    def word(self, word: str) -> bytes:
        """Ids of a word as 32-bit integers; the bytes of what is no piece."""
        if (held := self.older.get(word)) is not None:
            self.known[word] = held
            return held
        ids: list[int] = []
        find = self.ids.get
        for piece in self.merge(word):
            if (own := find(piece)) is not None:
                ids.append(own)
            else:
                ids += [self.byte_ids[b] for b in piece.encode()]
        held = self.known[word] = array("i", ids).tobytes()
        return held

    def decoded(self, ids: list[int], at_start: bool = True) -> str:
        """Text of ids. At its start one space goes if encoding puts one there, all of them if it removes extra ones."""
        out: list[str] = []
        held = bytearray()
        seen = not (at_start and (self.dummy_prefix or self.extra_spaces_removed))
        for i in [*ids, None]:
            if i is not None and (byte := self.byte_of.get(i)) is not None:
                held.append(byte)
                continue
            if held:
                out.append(lenient(bytes(held)))
                seen = True
                held.clear()
            if i is None or i in self.silent:
                continue
            if i in self.unknown:
                piece = self.unknown_text
            else:
                piece = self.pieces[i]
                if not seen and piece.startswith(SPACE):
                    piece = piece[1:]
                    seen = not self.extra_spaces_removed
                piece = piece.replace(SPACE, " ")
            if piece:
                out.append(piece)
                seen = True
        return "".join(out)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and end bytes in the source of each piece."""
        normal, align = normalise(text, self.keys, self.dummy_prefix, self.extra_spaces_removed)
        if len(self.known) >= REMEMBERED:  # words met since the last time stay known
            self.known, self.older = {}, self.known
        find, make = self.known.get, self.word
        ids = np.frombuffer(b"".join([find(w) or make(w) for w in self.words(normal.decode())]), np.int32)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return ids, align[ends - sizes], align[ends]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; ids that come from a text take the short way."""
        if ids and self.simple_start[ids[0]]:
            try:
                return b"".join(map(self.plain_bytes.__getitem__, ids)).decode()[1:]
            except (KeyError, UnicodeDecodeError):
                pass
        return self.decoded(ids)


def lenient(raw: bytes) -> str:
    """UTF-8 in which each byte that is part of no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, the decoded text, begins and ends (arrays; bytes of the source).

    With `digests`, SHA-256 digests stand for ids (decimal, joined by commas), decoded text and spans (begin and end as little-endian unsigned 32-bit integers).
    """
    from quarry.llm.common import map_text

    def run(texts: list[str]) -> dict:
        own, sha = model(path), hashlib.sha256
        counts, first, second, third, fourth = [], [], [], [], []
        for text in texts:  # one after another: only what is returned is kept
            ids, begins, ends = own.encode(text)
            numbers = ids.tolist()
            decoded = own.decode(numbers)
            counts.append(len(numbers))
            if digests:
                first.append(sha(",".join(map(own.decimal.__getitem__, numbers)).encode()).hexdigest())
                second.append(sha(decoded.encode()).hexdigest())
                third.append(sha(np.stack([begins, ends], 1).astype("<u4").tobytes()).hexdigest())
            else:
                first.append(ids)
                second.append(decoded)
                third.append(begins.astype(np.int32))
                fourth.append(ends.astype(np.int32))
        n = pa.array(counts, pa.int64())
        if digests:
            return {"n_tokens": n, "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string()), "spans_sha256": pa.array(third, pa.string())}
        ints = pa.list_(pa.int32())
        return {"n_tokens": n, "ids": pa.array(first, ints), "decoded": pa.array(second, pa.string()), "begins": pa.array(third, ints), "ends": pa.array(fourth, ints)}

    schema = "n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string, spans_sha256 string" if digests else "ids array<int>, decoded string, begins array<int>, ends array<int>")
    return map_text(docs, run, schema, size=BATCH_BYTES)
