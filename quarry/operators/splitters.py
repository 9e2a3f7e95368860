"""Chunkers that depend on what was cut before. They run in Arrow batches of whole documents; each row is independent."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import text as tx
from quarry.operators import chunks

#: Places at which a text may be cut, the best first. A separator stays with what follows it.
SEPARATORS = (". ", "; ", ": ", "? ", "! ", ") ", ", ", " ", "")


LEADERS = re.compile(r"(?:\.[ \t\r\n]*){3,}")


def packed(text: str, starts: Sequence[int], first: int, stop: int, size: int, overlap: int) -> Iterator[str]:
    """Runs of the pieces first to stop (piece i is text[starts[i]:starts[i + 1]], shorter than `size`) of at most `size`
    characters, each beginning with up to `overlap` characters of the one before. Ends are found by bisection: pieces lie
    side by side, so a run is a stretch of the text."""
    while first < stop:
        end = min(bisect_right(starts, starts[first] + size, first, stop + 1) - 1, stop)
        if whole := text[starts[first] : starts[end]].strip():
            yield whole
        if end == stop:
            return
        # What the next run keeps of this one: no more than the overlap, and no more than leaves room for its next piece.
        first = bisect_left(starts, max(starts[end] - overlap, starts[end + 1] - size), first, end)


def recursive_split(text: str, size: int = DEFAULTS.chunk_chars, overlap: int = DEFAULTS.chunk_overlap, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks cut at the best separator that occurs; pieces that are still too long are cut at the next ones."""
    k = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, rest = separators[k], separators[k + 1 :]
    if not separator:
        return list(packed(text, range(len(text) + 1), 0, len(text), size, overlap)) if size > 1 else [c for c in text if c.strip()]
    starts = [m.start() for m in re.finditer(re.escape(separator), text)]
    starts = [*([0] if not starts or starts[0] else []), *starts, len(text)]
    long = [i for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if b - a >= size]
    out, first = [], 0
    for i in [*long, len(starts) - 1]:
        out += packed(text, starts, first, i, size, overlap)
        if i < len(starts) - 1:
            piece = text[starts[i] : starts[i + 1]]
            out += recursive_split(piece, size, overlap, rest) if rest else [piece]
        first = i + 1
    return out


def section_pieces(text: str, most: int) -> list[str]:
    """A unit whole, or runs of its lines of at most `most` characters."""
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    out = []
    for line in filter(None, map(str.strip, text.split("\n"))):
        if out and len(out[-1]) + 1 + len(line) <= most:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def section_chunks(units: list[dict], most: int = DEFAULTS.max_unit_chars, merge_below: int = DEFAULTS.merge_below_chars) -> list[dict]:
    """Chunks of a document's units in order; a piece of few characters joins the chunk before where it fits."""
    out: list[dict] = []
    for unit in units:
        for piece in section_pieces(unit["text"], most):
            if out and len(piece) < merge_below and len(out[-1]["text"]) + 1 + len(piece) <= most:
                out[-1]["text"] += "\n" + piece
            else:
                out.append({**unit, "text": piece})
    return out


#: Texts that are chunked at once, and bytes of them.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows and bytes, so that the texts and chunks held as Python strings don't grow with the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        start = ends[at - 1] if at else 0
        stop = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, start + SLICE_BYTES, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def page_chunks(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, chunk_index (of those kept), chunk. pages: doc_id, page_number, text (cleaned).

    Contents pages are left out whole, then chunks that are too thin or look like contents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            # Contents pages are told here: as a filter before, the test would have a page cleaned twice.
            made = [[] if len(LEADERS.findall(t or "")) >= DEFAULTS.page_contents_leaders else recursive_split(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("page_number"), pa.array(made, pa.list_(pa.string()))], names=["doc_id", "page_number", "chunks"])

    split = pages.select("doc_id", F.col("page_number").cast("bigint").alias("page_number"), "text").mapInArrow(run, "doc_id bigint, page_number bigint, chunks array<string>")
    good = F.filter("chunks", lambda c: tx.is_substantive(c) & ~tx.is_contents(c, DEFAULTS.chunk_contents_leaders))
    return split.select("doc_id", "page_number", F.posexplode(good).alias("chunk_index", "chunk"))


def unit_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, at, section_id, section_heading, chapter, part, text: a document's structure in chunks."""
    fields = ["section_id", "section_heading", "chapter", "part", "text"]
    schema = pa.struct([("at", pa.int64()), *[(f, pa.string()) for f in fields]])
    units = chunks.structure(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit", *fields))).alias("units"))  # one document's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[{"at": i, **{f: c[f] for f in fields}} for i, c in enumerate(section_chunks(units))] for units in b.column("units").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.list_(schema))], names=["doc_id", "made"])

    ddl = "doc_id bigint, made array<struct<at:bigint," + ",".join(f"{f}:string" for f in fields) + ">>"
    return units.mapInArrow(run, ddl).select("doc_id", F.explode("made").alias("c")).select("doc_id", "c.*")


def preprocessed(pages: DataFrame, book: str, page: str, share: float = 0.5) -> DataFrame:
    """book, page, text: pages without repeated lines, cleaned; those left empty drop out."""
    gone = chunks.repeated_lines(pages, book, page, share)
    left = chunks.without_lines(pages.select(book, page, "text"), book, page, gone)
    # Exploded instead of filtered: a filter would move below and clean each page twice.
    cleaned = F.filter(F.array(tx.clean_page(F.col("text"))), lambda t: t != "")
    return left.select(book, page, tx.nfkc("text").alias("text")).select(book, page, F.explode(cleaned).alias("text"))
