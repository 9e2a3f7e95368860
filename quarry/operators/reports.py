"""Reports of a corpus build: manifests, parse status, summaries and cross-tabulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: The subject of a file by its name, the first rule that matches.
SUBJECTS = [
    (r"criminal.?procedure|code.?of.?criminal|bail", "criminal_procedure"),
    (r"penal|crime|offence|drugs|poisons|opium", "criminal_law"),
    (r"civil.?procedure", "civil_procedure"),
    (r"constitution", "constitutional_law"),
    (r"evidence", "evidence"),
    (r"compan", "company_commercial"),
    (r"intellectual|copyright|patent|trademark|geographical.?indication", "intellectual_property"),
    (r"marriage|maintenance|divorce|kandyan|muslim|domestic.?violence|family|adoption|custody", "family_law"),
    (r"sale.?of.?goods|consumer|contract", "contract_law"),
    (r"registration.?of.?documents|trust|land|property|frauds|partition|notaries", "property_land"),
    (r"industrial|labour|labor|employ", "labour_industrial"),
    (r"judicature|mediation|arbitration|primary.?court|data.?protection|right.?to.?information", "administrative_public"),
    (r"black.?s.?law|judgment|appeal", "case_law_methodology"),
]
OTHER_SUBJECT = "administrative_public"
#: Manifest rows that stand for a portal, not a document.
NOT_DOCUMENTS = ("portal", "index", "portal_index")


def guessed(filename: Column) -> Column:
    return tx.rule_label(filename, SUBJECTS, OTHER_SUBJECT)


def usable(manifest: DataFrame) -> DataFrame:
    """Manifest rows of documents: no portals, no duplicates."""
    return manifest.filter(~F.coalesce(F.col("doc_type").isin(*NOT_DOCUMENTS), F.lit(False)) & ~F.coalesce(F.trim("download_status").startswith("duplicate"), F.lit(False)))


def subject_lookup(manifest: DataFrame) -> DataFrame:
    """filename (lower case), subject: of rows that have both and aren't duplicates; the last row of a name wins."""
    own = manifest.select(F.lower(F.trim("filename")).alias("filename"), F.trim("subject_area").alias("subject"), "row_no", F.coalesce("download_status", F.lit("")).alias("s"))
    kept = own.filter((F.col("filename") != "") & (F.col("subject") != "") & ~F.trim("s").startswith("duplicate"))
    return kept.groupBy("filename").agg(F.max_by("subject", "row_no").alias("subject"))


def with_subject(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with subject and subject_source: what the manifest says, else the rule of the name. The manifest is joined by
    name, not broadcast: it may be as large as the files."""
    told = subject_lookup(manifest).withColumnRenamed("filename", "__key").withColumnRenamed("subject", "__told")
    both = files.join(told, F.lower("filename") == F.col("__key"), "left")
    rule = guessed(F.col("filename"))
    return both.withColumn("subject", F.coalesce("__told", rule)).withColumn("subject_source", F.when(F.col("__told").isNotNull(), "manifest").otherwise("filename_rule")).drop("__key", "__told")


def disagreements(manifest: DataFrame) -> DataFrame:
    """doc_id, declared, guessed: rows whose name alone would give another subject."""
    rule = guessed(F.trim("filename"))
    named = manifest.filter((F.trim("filename") != "") & ~F.coalesce(F.trim("download_status").startswith("duplicate"), F.lit(False)))
    return named.select("doc_id", F.trim("subject_area").alias("declared"), rule.alias("guessed")).filter("declared != guessed")


def claimed_twice(manifest: DataFrame) -> DataFrame:
    """filename, doc_id, first_by: rows that claim a name which the row before them claims."""
    named = manifest.filter((F.trim("filename") != "") & ~F.coalesce(F.trim("download_status").startswith("duplicate"), F.lit(False)))
    w = W.partitionBy("filename").orderBy("row_no")
    return named.select(F.lower(F.trim("filename")).alias("filename"), "doc_id", "row_no").withColumn("first_by", F.lag("doc_id").over(w)).filter("first_by is not null").select("filename", "doc_id", "first_by")


def manifest_balance(manifest: DataFrame, least: int) -> DataFrame:
    """kind (subject or tier), name, n, thin: numbers of documents, and whether a subject has too few."""
    own = usable(manifest)
    subjects = own.groupBy(F.trim("subject_area").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("subject").alias("kind"), "name", "n", (F.col("n") < least).alias("thin"))
    tiers = own.groupBy(F.trim(F.coalesce("source_tier", F.lit("?"))).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("tier").alias("kind"), "name", "n", F.lit(False).alias("thin"))
    return subjects.unionByName(tiers)


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Failed reports of manifest rows whose file isn't there."""
    there = files.select(F.lower("filename").alias("__name"))
    gone = manifest.filter(F.trim("filename") != "").join(there, F.lower(F.trim("filename")) == F.col("__name"), "left_anti")
    return gone.select("doc_id", "filename", F.lit("FAIL").alias("status"), F.lit("File not found").alias("errors"))


def parse_status(parsed: DataFrame) -> DataFrame:
    """Adds status and errors. parsed: chars (of all pages), lines_kept, units, chunks, warnings (an array), error (of the
    reader, else null)."""
    c = F.col
    error = F.when(c("error").isNotNull(), c("error")).when(c("chars") == 0, "No extractable text").when(c("lines_kept") == 0, "All text stripped as headers/footers").when(c("units") == 0, "No structural units detected").when(c("chunks") == 0, "Zero chunks emitted")
    return parsed.withColumn("errors", error).withColumn("status", F.when(F.col("errors").isNotNull(), "FAIL").when(F.size("warnings") > 0, "OK_WARN").otherwise("OK"))


def build_summary(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents by outcome, chunks by where their section comes from, and where subjects come from."""
    n = lambda cond: F.count_if(cond)
    docs = reports.agg(
        F.count(F.lit(1)).alias("documents_total"), n(F.col("status").startswith("OK")).alias("documents_ok"), n(F.col("status") == "FAIL").alias("documents_failed"),
        F.coalesce(F.sum("toc_dropped"), F.lit(0)).cast("bigint").alias("toc_chunks_dropped"),
        n(F.col("subject_source") == "manifest").alias("subject_from_manifest"), n(F.col("subject_source") == "filename_rule").alias("subject_from_filename_rule"),
    )
    own = chunks.agg(F.count(F.lit(1)).alias("chunks_total"), n(F.col("inherited")).alias("chunks_with_inherited_section"), n(F.coalesce("section_id", F.lit("")) == "").alias("chunks_without_section_id"))
    return docs.crossJoin(own)  # one row each


def type_counts(pairs: DataFrame, types: list[str], key: str = "pair_type") -> DataFrame:
    """key, kept, rejected, rejection_rate for every configured type, 0 where there are none. pairs: key, reason (null: kept)."""
    ok = F.col("reason").isNull()
    counts = pairs.groupBy(key).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"))
    every = pairs.sparkSession.createDataFrame([(t,) for t in types], f"{key} string")
    rate = F.round(F.col("rejected") / F.greatest(F.col("kept") + F.col("rejected"), F.lit(1)), 4)
    return every.join(counts, key, "left").fillna(0, ["kept", "rejected"]).withColumn("rejection_rate", rate)


def failures(pairs: DataFrame, k: int = 10, chars: int = 160) -> DataFrame:
    """The first k rejected pairs with a preview on one line."""
    flat = F.replace(F.substring("output", 1, chars), F.lit("\n"), F.lit(" "))
    return pairs.filter("reason is not null").orderBy("pair_id").limit(k).select("pair_id", "pair_type", "reason", flat.alias("preview"))


def units_of(pairs: DataFrame) -> DataFrame:
    """unit, subject (of the first pair), n. pairs: unit, subject, pair_id."""
    return pairs.groupBy("unit").agg(F.min_by("subject", "pair_id").alias("subject"), F.count(F.lit(1)).alias("n"))


def split_report(rows: DataFrame, splits: list[str]) -> DataFrame:
    """subject, pairs and documents in each split, missing_in and warning. rows: subject, doc, split, pair_id.

    A document counts for the subject of its first pair alone.
    """
    owner = rows.groupBy("split", "doc").agg(F.min_by("subject", "pair_id").alias("subject")).groupBy("subject", "split").agg(F.count(F.lit(1)).alias("docs"))
    both = rows.groupBy("subject", "split").agg(F.count(F.lit(1)).alias("pairs")).join(owner, ["subject", "split"], "full_outer")
    at = lambda c, s: F.coalesce(F.max(F.when(F.col("split") == s, F.col(c))), F.lit(0)).cast("bigint").alias(f"{c}_{s}")
    wide = both.groupBy("subject").agg(*[at(c, s) for s in splits for c in ("pairs", "docs")])
    missing = F.array_compact(F.array(*[F.when(F.col(f"pairs_{s}") == 0, s) for s in splits]))
    told = F.when(F.size(missing) > 0, F.concat("subject", F.lit(" missing from: "), F.array_join(missing, ", ")))
    return wide.withColumn("missing_in", F.array_join(missing, "|")).withColumn("warning", told)


def versions(rows: DataFrame, expected: str) -> DataFrame:
    """versions (distinct, sorted, joined), n and whether the expected one is missing."""
    got = rows.agg(F.array_sort(F.collect_set("dataset_version")).alias("v"), F.count(F.lit(1)).alias("n"))
    return got.select(F.array_join("v", ",").alias("versions"), "n", (~F.array_contains("v", expected)).alias("expected_missing"))
