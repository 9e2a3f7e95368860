"""Line, page and chunk operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import text as tx
from quarry.operators import logs

#: Header and footer lines, matched from the start of a trimmed line.
FURNITURE = [r"(?i)^page\s+\d+(\s+of\s+\d+)?$", r"(?i)^\d+\s*$", r"(?i)^cap\.?\s*\d+\]?.*", r"(?i)^.*official\s+reprint.*", r"(?i)^printed\s+by\s+.*"]
#: Lines that open a chapter, a part or a section.
CHAPTER, PART = r"(?i)^\s*CHAPTER\s+([IVXLC]+|\d+)\s*[-\x{2013}.:)]?\s*(.*)$", r"(?i)^\s*PART\s+([IVXLC]+|\d+)\s*[-\x{2013}.:)]?\s*(.*)$"
SECTION = r"(?i)^\s*(\d+[A-Za-z]?)\.\s+(.+)$"


def lines(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def sliding(docs: DataFrame, size: int = DEFAULTS.window_chars, overlap: int = DEFAULTS.window_overlap) -> DataFrame:
    """doc_id, chunk_index, start, chunk: windows of `size` characters, until one reaches the end. Empty texts have none."""
    step, n = size - overlap, F.length("text")
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    numbered = docs.filter("text is not null").withColumn("__n", count).filter("__n > 0")
    each = numbered.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return each.select("doc_id", "chunk_index", start.alias("start"), F.substring("text", start + 1, F.lit(size)).alias("chunk"))


def windows_of(text: Column, size: int = DEFAULTS.window_chars, overlap: int = DEFAULTS.window_overlap) -> Column:
    """The windows of `sliding` as an array."""
    step, n = size - overlap, F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int")))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size))))


def repeated_lines(docs: DataFrame, book: str, page: str, share: float = 0.5, least_pages: int = 6, longest: int = 90) -> DataFrame:
    """book, line: short lines on at least max(3, share) of the pages of a book of at least `least_pages`."""
    pages = docs.groupBy(book).agg(F.count_distinct(page).alias("pages"))
    each = docs.select(book, page, F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line"))
    often = each.filter((F.col("line") != "") & (F.length("line") <= longest)).groupBy(book, "line").agg(F.count_distinct(page).alias("on"))
    need = F.greatest(F.lit(3), F.floor(F.col("pages") * share))
    return often.join(pages.filter(F.col("pages") >= least_pages), book).filter(F.col("on") >= need).select(book, "line", "on")


#: Books whose repeated lines (a few hundred bytes each) may be broadcast; more meet their pages in a shuffle.
BROADCAST_BOOKS = 100_000


def without_lines(pages: DataFrame, book: str, page: str, gone: DataFrame) -> DataFrame:
    """Pages (book, page, text) without the lines of `gone` (book, line); blank lines stay.

    A book's repeated lines travel to its pages as one array: a line is on half of the pages or more, so there are few.
    """
    listed = gone.groupBy(book).agg(F.collect_set("line").alias("__gone"))
    few = listed.count() <= BROADCAST_BOOKS
    both = pages.join(F.broadcast(listed) if few else listed, book, "left")
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("__gone", F.trim(x)))
    return both.select(book, page, F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def trimmed_lines(text: Column) -> Column:
    """Lines without white space at both ends, and without blank ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def strip_furniture(docs: DataFrame, patterns: list[str] = FURNITURE) -> DataFrame:
    """doc_id, text (trimmed lines that match no pattern), kept and stripped (numbers of lines)."""
    hit = lambda x: F.lit(False) if not patterns else x.rlike("|".join(f"(?:{p})" for p in patterns))
    parts = docs.select("doc_id", trimmed_lines(F.col("text")).alias("parts"))
    kept = parts.select("doc_id", F.filter("parts", lambda x: ~hit(x)).alias("own"), F.size("parts").alias("n"))
    return kept.select("doc_id", F.array_join("own", "\n").alias("text"), F.size("own").cast("bigint").alias("kept"), (F.col("n") - F.size("own")).cast("bigint").alias("stripped"))


def structure(docs: DataFrame) -> DataFrame:
    """doc_id, unit (from 1), section_id, section_heading, chapter, part, text: units of a document's trimmed lines.

    A chapter or part line ends the unit and belongs to none; a chapter ends its part. A section line begins a unit and
    is its first line; other lines go on with the unit, or begin one without a section after a chapter or part line. Only
    a document's own lines are ordered together.
    """
    at = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = docs.select("doc_id", F.posexplode(trimmed_lines(F.col("text"))).alias("line_no", "line"))
    c, line = F.col, F.col("line")
    kind = F.when(line.rlike(CHAPTER), "chapter").when(line.rlike(PART), "part").when(line.rlike(SECTION), "section").otherwise("body")
    rows = rows.withColumn("kind", kind)
    starts = c("kind").isin("chapter", "part", "section") | F.coalesce(F.lag("kind").over(W.partitionBy("doc_id").orderBy("line_no")).isin("chapter", "part"), F.lit(True))
    marked = rows.withColumns({
        "unit": F.sum(starts.cast("int")).over(at), "chapter": F.last(F.when(c("kind") == "chapter", line), ignorenulls=True).over(at),
        # a chapter sets an empty part, so that the last mark of either kind tells the part
        "part": F.nullif(F.last(F.when(c("kind") == "part", line).when(c("kind") == "chapter", F.lit("")), ignorenulls=True).over(at), F.lit("")),
    })
    body = marked.filter(~c("kind").isin("chapter", "part"))
    grouped = body.groupBy("doc_id", "unit").agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "line"))).alias("ls"), F.first("chapter").alias("chapter"), F.first("part").alias("part"))
    head = F.get("ls", 0)
    is_section = head["kind"] == "section"
    number = F.when(is_section, F.regexp_extract(head["line"], SECTION, 1))
    title = F.regexp_replace(F.regexp_extract(head["line"], SECTION, 2), r"\s+$", "")
    heading = F.when(is_section, F.concat(number, F.lit(". "), F.substring(title, 1, 120))).otherwise(F.coalesce("chapter", "part", F.lit("preamble")))
    dense = F.row_number().over(W.partitionBy("doc_id").orderBy("unit"))
    return grouped.select("doc_id", dense.alias("unit"), number.alias("section_id"), heading.alias("section_heading"), "chapter", "part", F.array_join(F.transform("ls", lambda x: x.line), "\n").alias("text"))


def numbered_sections(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, at, section_id, section_heading, text) without contents tables, numbered, with the last section so
    far where they have none of their own (inherited)."""
    w = W.partitionBy("doc_id").orderBy("at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    own = F.nullif("section_id", F.lit(""))
    kept = chunks.filter(~tx.is_toc(F.col("text"))).withColumn("__own", own)
    last_id = F.last("__own", ignorenulls=True).over(upto)
    last_heading = F.last(F.when(F.col("__own").isNotNull(), F.col("section_heading")), ignorenulls=True).over(upto)
    number = F.row_number().over(w)
    return kept.select(
        F.format_string("%s-C%04d", F.col("doc_id").cast("string"), number).alias("chunk_id"), "doc_id", last_id.alias("section_id"),
        F.coalesce(F.nullif("section_heading", F.lit("")), last_heading).alias("section_heading"),
        (F.col("__own").isNull() & last_id.isNotNull()).alias("inherited"), "text", F.length("text").alias("chars"), (F.length("text") < DEFAULTS.min_unit_chars).alias("thin"),
    )


def forward_fill(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds filled (the last value so far in the group) and inherited."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(w)).withColumn("inherited", F.col(value).isNull() & F.col("filled").isNotNull())


def units(rows: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """group, unit, lines, chars: rows from one start to the next."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("unit", F.sum(starts.cast("int")).over(w)).groupBy(group, "unit").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


#: Parts of a group whose first rows are found before they meet.
PARTS = 64


def firsts(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each group: of each of its parts first, so that no task sorts all of a large group."""
    part = F.pmod(F.xxhash64(order), F.lit(PARTS))
    some = rows.withColumn("__part", part).withColumn("__r", F.row_number().over(W.partitionBy(group, "__part").orderBy(order))).filter(F.col("__r") <= most)
    return some.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("__r") <= most).drop("__part", "__r")


def page_budget(pages: DataFrame, book: str, page: str, limit: int = DEFAULTS.source_chars, least: int = 300) -> DataFrame:
    """book, page, taken: pages in order until the budget is spent (two characters go between pages); the first that
    doesn't fit gives a part if more than `least` characters remain. Only as many pages as could fit meet in a task."""
    w = W.partitionBy(book).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    n = F.col("n")
    sized = firsts(pages.select(book, page, F.length("text").alias("n")), book, page, limit // 2 + 1)  # a page costs two at least
    cost = sized.withColumn("before", F.coalesce(F.sum(n + 2).over(w), F.lit(0)))
    rest = limit - F.col("before")
    taken = F.when(n <= rest, n).when(rest > least, rest)
    return cost.withColumn("taken", taken.cast("bigint")).filter((rest > 0) & F.col("taken").isNotNull()).select(book, page, "taken")


def even_sample(rows: DataFrame, group: str, order: str, calls: int) -> DataFrame:
    """Of each group, the rows at floor(i * n / calls) in order, for i under calls: order statistics of `order`, which
    has to be a number that no two rows of a group share."""
    picks = {f"p{i}": F.floor(i * F.col("n") / calls) for i in range(calls)}
    found = logs.at_rank(rows, group, order, picks)
    wanted = found.select(group, F.explode(F.array_distinct(F.array(*picks))).alias(order))
    return rows.join(wanted, [group, order], "left_semi")


def united(*parts: DataFrame) -> DataFrame:
    """Chunks of several sources as one table, with the place of their source among them; columns that a source lacks are null."""
    out = None
    for k, part in enumerate(parts):
        own = part.withColumn("origin", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def chunked_pages(pages: DataFrame, chunks: DataFrame, *key: str) -> DataFrame:
    """Pages that gave a chunk at least: the pages of the chunks' own keys."""
    return pages.join(chunks.select(*key).distinct(), list(key), "left_semi")
