"""Readers: HTML pages, files with reject reasons, JSON lines and manifests."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Closing tags that end a line, and tags whose text is dropped.
BLOCKS, DROPPED = {"p", "div", "br", "li", "h1", "h2", "h3", "tr"}, {"script", "style"}


class TextOf(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in DROPPED

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def text_of(html: str | None) -> str:
    parser = TextOf()
    parser.feed(html or "")
    parser.close()
    text = "".join(parser.parts)
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip()


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, text: parsed in Arrow batches by the standard parser; regular expressions couldn't follow the tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([text_of(x) for x in b.column("html").to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, text string")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def manifest(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    return rows


def files(spark: SparkSession, folder: str, skip: tuple[str, ...] = (), suffixes: str = r"(?i)\.(pdf|html?)$") -> DataFrame:
    """Files below a folder, without their content until it is selected. `skip` names folders below it, or files with or
    without their ending, that are left out whole; what the path above the folder holds doesn't matter. A folder that itself
    has a wanted name, as a table of many part files has, is one entry: `entries` names it once."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    above = root.makeQualified(root.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), root).toUri().getPath().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = F.split(F.substring_index("path", f"{above}/", -1), "/")
    # The way to each part of the path below the folder; the first of a wanted name is the entry.
    ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, 1, i))
    entry = F.get(F.filter(ways, lambda w: F.element_at(w, -1).rlike(suffixes)), 0)
    found = found.withColumn("entry", F.array_join(entry, "/")).filter(F.col("entry").isNotNull())
    own = F.split("entry", "/")
    names = F.array_union(own, F.array(F.regexp_replace(F.element_at(own, -1), r"\.[^.]*$", "")))
    return found.filter(~F.arrays_overlap(names, F.array(*map(F.lit, skip)))) if skip else found


def entries(spark: SparkSession, folder: str, skip: tuple[str, ...] = (), suffixes: str = r"(?i)\.(pdf|html?)$") -> DataFrame:
    """path, name: what `files` finds, below the folder; the part files of one entry are one row."""
    return files(spark, folder, skip, suffixes).select(F.col("entry").alias("path"), F.substring_index("entry", "/", -1).alias("name")).distinct()


def reject_reason(name: Column, size: Column, pages: Column | None = None, most_mb: int = 10, most_pages: int = 300) -> Column:
    reason = F.when(~F.lower(name).endswith(".pdf"), "not a PDF").when(size == 0, "empty").when(size > most_mb * 2**20, "too large")
    return reason if pages is None else reason.when((pages < 1) | (pages > most_pages), "page count")


def capped(pages: DataFrame, book: str, number: str, most: int = 80) -> DataFrame:
    """Pages up to the cap, and a closing page that says so where there were more."""
    over = pages.groupBy(book).agg(F.max(number).alias("m")).filter(F.col("m") > most)
    closing = over.select(book, F.lit(most + 1).cast(pages.schema[number].dataType).alias(number), F.lit("[TRUNCATED]").alias("text"))
    return pages.filter(F.col(number) <= most).select(book, number, "text").unionByName(closing)
