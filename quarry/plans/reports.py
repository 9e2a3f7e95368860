"""Queries of manifests, build reports, splits and evaluations. Parts stand for manifest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import render as rd
from quarry.operators import chunks, dataset, evaluation, reports, splitters
from quarry.plans.catalog import GROUNDING_SQL, checked_pairs
from quarry.plans.registry import docs, query, table
from quarry.plans.structure import FILE_SQL, PAGED_SQL, SUBJECT_SQL, named_files, paged

MANIFEST_SQL = f"""m AS (SELECT p_partkey AS doc_id, p_partkey AS row_no, CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE regexp_replace({FILE_SQL}, '[a-z]+-[a-z]+.pdf$', 'x.pdf') END AS filename, CASE p_partkey % 6 WHEN 0 THEN ' evidence ' WHEN 1 THEN '' WHEN 2 THEN 'criminal_law' WHEN 3 THEN 'family_law' WHEN 4 THEN 'property_land' ELSE 'evidence' END AS subject_area,
    CASE WHEN p_size % 3 > 0 THEN 'tier' || p_size % 3 END AS source_tier, CASE WHEN p_size % 10 = 0 THEN 'portal' ELSE 'act' END AS doc_type, CASE WHEN p_partkey % 17 = 0 THEN 'duplicate of 1' WHEN p_partkey % 5 = 0 THEN NULL ELSE 'ok' END AS download_status FROM part)"""


def manifest(spark, d):
    i, size = F.col("p_partkey"), F.col("p_size")
    subject = F.get(F.array(*map(F.lit, [" evidence ", "", "criminal_law", "family_law", "property_land", "evidence"])), (i % 6).cast("int"))
    return named_files(spark, d).select(
        i.alias("doc_id"), i.alias("row_no"), F.when(i % 19 == 0, " ").otherwise(F.regexp_replace("filename", "[a-z]+-[a-z]+.pdf$", "x.pdf")).alias("filename"), subject.alias("subject_area"),
        F.when(size % 3 > 0, F.concat(F.lit("tier"), (size % 3).cast("string"))).alias("source_tier"), F.when(size % 10 == 0, "portal").otherwise("act").alias("doc_type"),
        F.when(i % 17 == 0, "duplicate of 1").when(i % 5 == 0, None).otherwise("ok").alias("download_status"),
    )


LOOKUP_SQL = "l AS (SELECT lower(trim(filename)) AS filename, arg_max(trim(subject_area), row_no) AS told FROM m WHERE trim(filename) <> '' AND trim(subject_area) <> '' AND NOT coalesce(download_status, '') LIKE 'duplicate%' GROUP BY 1)"


@query(f"""WITH {MANIFEST_SQL}, {LOOKUP_SQL}, f AS (SELECT doc_id, filename FROM m WHERE trim(filename) <> '')
    SELECT doc_id, coalesce(told, {SUBJECT_SQL.format('f.filename')}) AS subject, CASE WHEN told IS NULL THEN 'filename_rule' ELSE 'manifest' END AS subject_source FROM f LEFT JOIN l ON l.filename = lower(f.filename)""")
def resolved_subjects(spark, d):
    rows = manifest(spark, d)
    files = rows.select("doc_id", "filename").filter("trim(filename) != ''")
    return reports.with_subject(files, rows).select("doc_id", "subject", "subject_source")


@query(f"WITH {MANIFEST_SQL} SELECT doc_id, trim(subject_area) AS declared, {SUBJECT_SQL.format('trim(filename)')} AS guessed FROM m WHERE trim(filename) <> '' AND NOT coalesce(download_status, '') LIKE 'duplicate%' AND trim(subject_area) <> {SUBJECT_SQL.format('trim(filename)')}")
def subject_disagreements(spark, d):
    return reports.disagreements(manifest(spark, d))


@query(f"WITH {MANIFEST_SQL}, n AS (SELECT lower(trim(filename)) AS filename, doc_id, lag(doc_id) OVER (PARTITION BY lower(trim(filename)) ORDER BY row_no) AS first_by FROM m WHERE trim(filename) <> '' AND NOT coalesce(download_status, '') LIKE 'duplicate%') SELECT * FROM n WHERE first_by IS NOT NULL")
def claimed_twice(spark, d):
    return reports.claimed_twice(manifest(spark, d))


@query(f"""WITH {MANIFEST_SQL}, u AS (SELECT * FROM m WHERE doc_type <> 'portal' AND NOT coalesce(download_status, '') LIKE 'duplicate%')
    SELECT 'subject' AS kind, trim(subject_area) AS name, count(*) AS n, count(*) < 25 AS thin FROM u GROUP BY 2 UNION ALL SELECT 'tier', coalesce(source_tier, '?'), count(*), FALSE FROM u GROUP BY 2""")
def manifest_balance(spark, d):
    return reports.manifest_balance(manifest(spark, d), 25)


@query(f"WITH {MANIFEST_SQL}, f AS (SELECT DISTINCT lower(filename) AS name FROM m WHERE doc_id % 30 < 7) SELECT doc_id, filename, 'FAIL' AS status, 'File not found' AS errors FROM m WHERE trim(filename) <> '' AND lower(trim(filename)) NOT IN (SELECT name FROM f)")
def missing_files(spark, d):
    rows = manifest(spark, d)
    return reports.missing_files(rows, rows.filter("doc_id % 30 < 7").select("filename"))


PARSED_SQL = rf"""p AS {PAGED_SQL}, v AS (SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN '  ' WHEN 2 THEN 'Page 7' || chr(10) || '12' WHEN 3 THEN 'CHAPTER 1' ELSE text END AS text FROM p),
    w AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM v),
    x AS (SELECT *, list_filter(ls, lambda x: NOT regexp_matches(x, '(?i)^page\s+\d+(\s+of\s+\d+)?$') AND NOT regexp_matches(x, '(?i)^\d+\s*$') AND NOT regexp_matches(x, '(?i)^cap\.?\s*\d+\]?.*') AND NOT regexp_matches(x, '(?i)^.*official\s+reprint.*') AND NOT regexp_matches(x, '(?i)^printed\s+by\s+.*')) AS own FROM w),
    z AS (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS chars, len(own) AS lines_kept, len(ls) - len(own) AS stripped, len(list_filter(own, lambda x: NOT regexp_matches(x, '{chunks.CHAPTER}') AND NOT regexp_matches(x, '{chunks.PART}'))) AS body, doc_id % 10 = 4 AS broken FROM x)"""


def parsed(spark, d):
    """Documents as read: some blank, some all furniture, some without a unit, some that the reader failed on."""
    i = F.col("doc_id")
    text = F.when(i % 8 == 1, "  ").when(i % 8 == 2, "Page 7\n12").when(i % 8 == 3, "CHAPTER 1").otherwise(F.col("text"))
    rows = paged(spark, d).withColumn("text", text)
    kept = chunks.strip_furniture(rows).withColumnRenamed("text", "own")
    body = F.size(F.filter(chunks.trimmed_lines(F.col("own")), lambda x: ~x.rlike(chunks.CHAPTER) & ~x.rlike(chunks.PART)))
    both = rows.select("doc_id", F.length(F.regexp_replace("text", r"\s", "")).alias("chars")).join(kept, "doc_id")
    warned = F.when(F.col("stripped") > 1, F.array(F.lit("stripped"))).otherwise(F.array().cast("array<string>"))
    return both.select("doc_id", "chars", F.col("kept").alias("lines_kept"), body.alias("units"), body.alias("chunks"), warned.alias("warnings"), F.when(i % 10 == 4, "ValueError: bad file").alias("error"), F.col("stripped").alias("toc_dropped"), F.when(i % 3 == 0, "manifest").otherwise("filename_rule").alias("subject_source"))


STATUS_SQL = PARSED_SQL + """, s AS (SELECT *, CASE WHEN broken THEN 'ValueError: bad file' WHEN chars = 0 THEN 'No extractable text' WHEN lines_kept = 0 THEN 'All text stripped as headers/footers' WHEN body = 0 THEN 'No structural units detected' END AS errors FROM z),
    t AS (SELECT *, CASE WHEN errors IS NOT NULL THEN 'FAIL' WHEN stripped > 1 THEN 'OK_WARN' ELSE 'OK' END AS status FROM s)"""


@query(f"WITH {STATUS_SQL} SELECT doc_id, status, errors FROM t")
def parse_reports(spark, d):
    return reports.parse_status(parsed(spark, d)).select("doc_id", "status", "errors")


@query(f"""WITH {STATUS_SQL} SELECT count(*) AS documents_total, count(*) FILTER (status LIKE 'OK%') AS documents_ok, count(*) FILTER (status = 'FAIL') AS documents_failed, CAST(sum(stripped) AS BIGINT) AS toc_chunks_dropped,
    count(*) FILTER (doc_id % 3 = 0) AS subject_from_manifest, count(*) FILTER (doc_id % 3 <> 0) AS subject_from_filename_rule,
    (SELECT count(*) FROM conversations) AS chunks_total, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS chunks_with_inherited_section, (SELECT count(*) FROM conversations WHERE role = 'user') AS chunks_without_section_id FROM t""")
def build_summary(spark, d):
    made = table(spark, d, "conversations").select((F.col("role") == "assistant").alias("inherited"), F.when(F.col("role") == "user", "").otherwise("1").alias("section_id"))
    return reports.build_summary(reports.parse_status(parsed(spark, d)), made)


@query(GROUNDING_SQL + ", t AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS pair_type) SELECT t.pair_type, count(*) FILTER (doc_id IS NOT NULL AND reason IS NULL) AS kept, count(reason) AS rejected, round(count(reason) / CAST(greatest(count(doc_id), 1) AS DOUBLE), 4) AS rejection_rate FROM t LEFT JOIN r ON r.pair_type = t.pair_type GROUP BY 1")
def rejection_rates(spark, d):
    """Kept and rejected pairs of every configured type, also of those without any."""
    return reports.type_counts(checked_pairs(spark, d), ["de", "en", "es", "fr", "it"])


@query(GROUNDING_SQL + " SELECT doc_id AS pair_id, pair_type, reason, replace(d.text[1:160], chr(10), ' ') AS preview FROM r JOIN documents d USING (doc_id) WHERE reason IS NOT NULL ORDER BY doc_id LIMIT 10")
def first_failures(spark, d):
    pairs = checked_pairs(spark, d).join(docs(spark, d).select("doc_id", F.col("text").alias("output")), "doc_id")
    return reports.failures(pairs.withColumnRenamed("doc_id", "pair_id"))


UNITS_SQL = "p AS (SELECT doc_id AS pair_id, lang AS subject, source AS doc, source || '::' || coalesce(nullif(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'ch' || doc_id % 3 END, ''), nullif(CASE WHEN doc_id % 4 = 2 THEN 'part' END, ''), '_nogroup') AS unit FROM documents)"


def unit_pairs(spark, d):
    i, c = F.col("doc_id"), F.col
    chapter, part = F.when(i % 4 == 0, "").when(i % 4 == 1, F.concat(F.lit("ch"), (i % 3).cast("string"))), F.when(i % 4 == 2, "part")
    return docs(spark, d).select(i.alias("pair_id"), c("lang").alias("subject"), c("source").alias("doc"), dataset.unit_key(c("source"), chapter, part).alias("unit"))


@query(f"WITH {UNITS_SQL} SELECT unit, arg_min(subject, pair_id) AS subject, count(*) AS n FROM p GROUP BY 1")
def units(spark, d):
    return reports.units_of(unit_pairs(spark, d))


SPLIT_SQL = UNITS_SQL + """, h AS (SELECT subject, doc FROM (SELECT subject, doc, count(*) AS n FROM p GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n, doc) = 1),
    s AS (SELECT *, CASE WHEN doc IN (SELECT doc FROM h) THEN 'test_strict' WHEN pair_id % 10 < 7 OR subject = 'es' THEN 'train' WHEN pair_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM p)"""
SPLITS = ["train", "val", "test", "test_strict"]


def split_pairs(spark, d):
    """Documents chosen as strict holdout go whole; the rest by their id."""
    rows = unit_pairs(spark, d)
    counts = rows.groupBy("subject", "doc").agg(F.count(F.lit(1)).alias("n")).groupBy("subject").agg(F.min(F.struct("n", "doc"))["doc"].alias("doc"))
    held, rest = dataset.parted(rows, counts.select("doc").distinct(), "doc")
    place = F.col("pair_id") % 10
    split = F.when((place < 7) | (F.col("subject") == "es"), "train").when(place < 9, "val").otherwise("test")
    return held.withColumn("split", F.lit("test_strict")).unionByName(rest.withColumn("split", split))


@query(f"""WITH {SPLIT_SQL}, o AS (SELECT split, doc, arg_min(subject, pair_id) AS subject FROM s GROUP BY 1, 2), k AS (SELECT DISTINCT subject FROM p), t AS (
    SELECT k.subject, """ + ", ".join(f"(SELECT count(*) FROM s WHERE s.subject = k.subject AND split = '{x}') AS pairs_{x}, (SELECT count(*) FROM o WHERE o.subject = k.subject AND split = '{x}') AS docs_{x}" for x in SPLITS)
    + ", concat_ws('|', " + ", ".join(f"CASE WHEN (SELECT count(*) FROM s WHERE s.subject = k.subject AND split = '{x}') = 0 THEN '{x}' END" for x in SPLITS) + ") AS missing_in FROM k) SELECT *, CASE WHEN missing_in <> '' THEN subject || ' missing from: ' || replace(missing_in, '|', ', ') END AS warning FROM t")
def split_report(spark, d):
    return reports.split_report(split_pairs(spark, d), SPLITS)


@query(f"WITH {SPLIT_SQL} SELECT split, count(*) AS n, count(DISTINCT unit) AS units, bit_xor(pair_id) AS ids FROM s GROUP BY 1")
def split_parts(spark, d):
    """Rows of each split, the strict ones by a semi join, the rest by an anti join."""
    return split_pairs(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("units"), F.bit_xor("pair_id").alias("ids"))


RECORDS_SQL = """q AS (SELECT a.conv_id || '-' || a.turn AS pair_id, CASE WHEN a.conv_id % 3 = 0 THEN 'mcq' ELSE 'qa' END AS pair_type, a.text AS instruction, b.text AS output, 'section 7A ' || b.text AS excerpt, CASE WHEN a.turn % 2 = 0 THEN '9' END AS section_id, CASE WHEN a.conv_id % 2 = 0 THEN 'test' ELSE 'val' END AS split,
        a.conv_id, a.turn FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"""


def records(spark, d):
    """Chat records of a conversation's user turns with the answers behind them."""
    rows, c = table(spark, d, "conversations"), F.col
    later = rows.select("conv_id", (c("turn") - 1).alias("turn"), c("text").alias("output"))
    both = rows.filter("role = 'user'").join(later, ["conv_id", "turn"])
    pairs = both.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.when(c("conv_id") % 3 == 0, "mcq").otherwise("qa").alias("pair_type"), F.when(c("turn") % 2 == 0, "9").alias("section_id"), F.when(c("conv_id") % 2 == 0, "test").otherwise("val").alias("split"), c("text").alias("instruction"), F.concat(F.lit("section 7A "), "output").alias("excerpt"), "output")
    return evaluation.chat_record(pairs, "v0.1")


@query(f"WITH {RECORDS_SQL} SELECT pair_id, md5(regexp_replace(excerpt, '^\\s+|\\s+$', '', 'g')) AS source_md5, md5(output) AS gold_md5, section_id FROM q")
def record_sources(spark, d):
    return evaluation.sources(records(spark, d)).select("pair_id", F.md5("source").alias("source_md5"), F.md5("gold").alias("gold_md5"), "section_id")


@query(f"WITH {RECORDS_SQL} SELECT 'v0.1' AS versions, count(*) AS n, TRUE AS expected_missing FROM q")
def dataset_versions(spark, d):
    return reports.versions(records(spark, d), "v0.2")


F1_SQL = "CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (len(x) + len(y)) END"
SCORED_SQL = rf"""{RECORDS_SQL}, e AS (SELECT a.conv_id || '-' || a.turn AS pair_id, CASE WHEN a.conv_id % 2 = 0 THEN 'test' ELSE 'val' END AS split, CASE a.turn % 4 WHEN 0 THEN a.text || ' see section 7a and rule 9' WHEN 1 THEN b.text ELSE b.text || ' under article 8' END AS candidate, CAST(a.turn * 1000.0 AS DOUBLE) AS ms
        FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
    j AS (SELECT e.*, pair_type, section_id, coalesce(output, '') AS gold, coalesce(regexp_replace(excerpt, '^\s+|\s+$', '', 'g'), '') AS source FROM e LEFT JOIN q USING (pair_id)),
    k AS (SELECT *, regexp_extract_all(lower(coalesce(candidate, '')), '[a-z0-9]+') AS x, regexp_extract_all(lower(gold), '[a-z0-9]+') AS y,
        list_filter(list_distinct(regexp_extract_all(lower(coalesce(candidate, '')), '\b(?:section|sections|sec\.|s\.|article|articles|art\.|chapter|part|rule|order)[\t-\r ]+([0-9]{{1,3}}[a-z]{{0,2}})', 1)), lambda z: NOT list_contains(list_concat(
            regexp_extract_all(lower(source), '\b(?:section|sections|sec\.|s\.|article|articles|art\.|chapter|part|rule|order)[\t-\r ]+([0-9]{{1,3}}[a-z]{{0,2}})', 1), regexp_extract_all(lower(source), '(?:^|\n)[\t-\r ]*([0-9]{{1,3}}[a-z]{{0,2}})[\t-\r ]*\.', 1),
            regexp_extract_all(lower(source), '([0-9]{{1,3}}[a-z]{{0,2}})[\t-\r ]*\.[\t-\r ]*\([0-9a-z]', 1), regexp_extract_all(lower(source), '\b([0-9]{{1,3}}[a-z]{{1,2}})\b', 1), [coalesce(section_id, '')]), z)) AS missing FROM j),
    n AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0) AS c FROM k),
    s AS (SELECT pair_id, split, ms, CASE WHEN pair_type = 'mcq' THEN coalesce(nullif(regexp_extract(upper(coalesce(candidate, '')), '\b([ABCD])\b', 1), '') = nullif(regexp_extract(upper(gold), '\b([ABCD])\b', 1), ''), FALSE) ELSE {F1_SQL} >= 0.5 END AS correct,
        length(regexp_replace(coalesce(candidate, ''), '^[\t-\r ]+|[\t-\r ]+$', '', 'g')) < 40 OR len(missing) > 0 AS hallucinated FROM n)"""
MEASURED_SQL = SCORED_SQL + """, m AS (SELECT split AS "group", count(*) AS n, round(avg(CAST(correct AS INT)), 4) AS accuracy, round(avg(CAST(hallucinated AS INT)), 4) AS hallucination_rate, round(1 - avg(CAST(hallucinated AS INT)), 4) AS groundedness, list_sort(list(ms))[CAST(floor(0.95 * (count(*) - 1)) AS INT) + 1] AS latency_p95 FROM s GROUP BY 1)"""


def scored(spark, d):
    rows, c = table(spark, d, "conversations"), F.col
    later = rows.select("conv_id", (c("turn") - 1).alias("turn"), c("text").alias("output"))
    both = rows.join(later, ["conv_id", "turn"], "left")
    said = F.when(c("turn") % 4 == 0, F.concat("text", F.lit(" see section 7a and rule 9"))).when(c("turn") % 4 == 1, c("output")).otherwise(F.concat("output", F.lit(" under article 8")))
    predictions = both.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.when(c("conv_id") % 2 == 0, "test").otherwise("val").alias("split"), said.alias("candidate"), (c("turn") * 1000.0).alias("candidate_ms"))
    return evaluation.scored(predictions, records(spark, d))


@query(f"WITH {SCORED_SQL} SELECT pair_id, split, correct, hallucinated, ms FROM s")
def scored_predictions(spark, d):
    """Predictions against their records; some have no record."""
    return scored(spark, d)


def registry(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("row_no"), F.when(F.col("user_id") % 2 == 0, "run-a").otherwise("run-b").alias("run_id"), F.when(F.col("event_id") % 3 == 0, "test").otherwise("other").alias("eval_split"), F.when(F.col("event_type") == "view", "dry_run").alias("notes"), F.round(F.col("value") / 100, 4).alias("accuracy"))
    return rows


@query(f"""WITH {MEASURED_SQL}, r AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'other' END AS "group", arg_max(round(value / 100, 4), event_id) AS before FROM events WHERE user_id % 2 = 0 AND event_type <> 'view' GROUP BY 1)
    SELECT m.*, coalesce(before, 0.0) AS before FROM m LEFT JOIN r USING ("group")""")
def compared_runs(spark, d):
    """Splits measured now beside the last row that the registry has of a run."""
    return evaluation.compared(evaluation.measured(scored(spark, d)), registry(spark, d), "run-a")


@query(f"""WITH {MEASURED_SQL}, f AS (SELECT round(avg(value) / 100, 4) AS fa, 0.5 AS fg FROM events), g AS (SELECT m.*, fa, fg FROM m, f),
    v AS (SELECT *, concat_ws(';', CASE WHEN accuracy < 0.7 THEN 'accuracy' END, CASE WHEN groundedness < 0.85 THEN 'groundedness' END, CASE WHEN hallucination_rate > 0.15 THEN 'hallucination_rate' END, CASE WHEN latency_p95 > 8000 THEN 'latency_p95_ms' END,
        CASE WHEN NOT (accuracy >= fa OR (groundedness >= fg AND accuracy >= fa - 0.05)) THEN 'fallback comparison' END) AS violations FROM g)
    SELECT "group", n, accuracy, hallucination_rate, groundedness, latency_p95, violations, violations = '' AS promote FROM v""")
def promotion_gate(spark, d):
    fallback = table(spark, d, "events").agg(F.round(F.avg("value") / 100, 4).alias("fallback_accuracy")).withColumn("fallback_groundedness", F.lit(0.5))
    return dataset.gate(evaluation.measured(scored(spark, d)), fallback)


@query("""WITH r AS (SELECT lang, length(text) // 4 AS t FROM documents), k AS (SELECT lang, count(*) AS n, list_sort(list(t))[count(*) // 2 + 1] AS p50, list_sort(list(t))[CAST(least(count(*) - 1, floor(count(*) * 0.95)) AS INT) + 1] AS p95, max(t) AS longest FROM r GROUP BY 1),
    w AS (SELECT *, greatest(256, least(4096, CAST(pow(2, ceil(log2(greatest(p95, 1)))) AS INT))) AS "window" FROM k) SELECT w.*, (SELECT count(*) FROM r WHERE r.lang = w.lang AND t > "window") AS cut FROM w""")
def token_lengths(spark, d):
    rows = docs(spark, d).select("lang", F.floor(F.length("text") / 4).alias("t"))
    return evaluation.token_lengths(rows, "lang", "t")


@query()
def unit_chunk_report(spark, d):
    """Section chunks by document and whether their section is inherited: the chunker's own counts."""
    made = chunks.numbered_sections(splitters.unit_chunks(paged(spark, d)))
    return made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("inherited").alias("inherited"), F.sum("chars").alias("chars"))


@query("""WITH s AS (SELECT source, doc_id, length(text) AS n FROM documents) SELECT source, count(*) AS n, min(n) AS shortest, max(n) AS longest FROM s GROUP BY 1""")
def source_sizes(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN text[1:60] || '...' ELSE text END AS preview FROM documents")
def previews(spark, d):
    return docs(spark, d).select("doc_id", rd.capped(F.col("text"), 60, "...").alias("preview"))
