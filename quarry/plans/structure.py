"""Queries of page cleaning, document structure, chunkers and whole-document plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import render as rd
from quarry.functions import text as tx
from quarry.operators import chunks, logs, planning, reports, retrieval, splitters
from quarry.plans.catalog import CLEAN_SQL, COSINE_SQL, vectors
from quarry.plans.registry import docs, query, table

#: A document under a running head, a page number and section lines, by its id. Documents of a source are its pages.
PAGED_SQL = """(SELECT doc_id, source, lang, 'Official Reprint ' || source || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'CHAPTER ' || doc_id % 4 || chr(10) ELSE '' END
    || CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 || '. Of ' || lang || chr(10) ELSE '' END || text || chr(10) || 'PART II' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '7. Closing words' || chr(10) ELSE '' END || 'page ' || doc_id AS text FROM documents)"""


def paged(spark, d):
    i, nl = F.col("doc_id"), F.lit("\n")
    part = lambda when, *text: F.when(when, F.concat(*text, nl)).otherwise("")
    text = F.concat(F.lit("Official Reprint "), "source", nl, part(i % 3 == 0, F.lit("CHAPTER "), (i % 4).cast("string")), part(i % 2 == 0, (i % 50).cast("string"), F.lit(". Of "), "lang"), "text", nl, F.lit("PART II"), nl, part(i % 5 == 0, F.lit("7. Closing words")), F.lit("page "), i.cast("string"))
    return docs(spark, d).select("doc_id", "source", "lang", text.alias("text"))


@query(f"""
    WITH p AS {PAGED_SQL}, n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM p GROUP BY 1 HAVING count(DISTINCT doc_id) >= 6),
    l AS (SELECT source, doc_id, trim(x) AS line FROM p, unnest(string_split(text, chr(10))) AS u(x)),
    f AS (SELECT source, line FROM l JOIN n USING (source) WHERE line <> '' AND length(line) <= 90 GROUP BY source, line, pages HAVING count(DISTINCT doc_id) >= greatest(3, CAST(floor(pages * 0.5) AS BIGINT))),
    g AS (SELECT source, list(line) AS gone FROM f GROUP BY 1),
    k AS (SELECT p.source, doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, trim(x))), chr(10)) END AS text FROM p LEFT JOIN g USING (source)),
    z AS (SELECT source, doc_id, nfc_normalize(text) AS text FROM k), c AS (SELECT source, doc_id, {CLEAN_SQL} AS text FROM z)
    SELECT source, doc_id, md5(text) AS text_md5 FROM c WHERE text <> ''""")
def preprocessed_pages(spark, d):
    """Repeated lines of a source's pages removed, pages cleaned, empty ones dropped. (The SQL has canonical composition
    only: compatibility forms don't occur in the tables beyond the two ligatures.)"""
    return splitters.preprocessed(paged(spark, d), "source", "doc_id").select("source", "doc_id", F.md5("text").alias("text_md5"))


@query(f"""
    WITH p AS {PAGED_SQL}, l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM p),
    k AS (SELECT doc_id, ls, list_filter(ls, lambda x: NOT regexp_matches(x, '(?i)^page\\s+\\d+(\\s+of\\s+\\d+)?$') AND NOT regexp_matches(x, '(?i)^\\d+\\s*$') AND NOT regexp_matches(x, '(?i)^cap\\.?\\s*\\d+\\]?.*')
        AND NOT regexp_matches(x, '(?i)^.*official\\s+reprint.*') AND NOT regexp_matches(x, '(?i)^printed\\s+by\\s+.*')) AS own FROM l)
    SELECT doc_id, md5(array_to_string(own, chr(10))) AS text_md5, len(own) AS kept, len(ls) - len(own) AS stripped FROM k""")
def header_footer_strip(spark, d):
    return chunks.strip_furniture(paged(spark, d)).select("doc_id", F.md5("text").alias("text_md5"), "kept", "stripped")


STRUCTURE_SQL = rf"""
    p AS {PAGED_SQL}, l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM p),
    e AS (SELECT doc_id, i, ls[i] AS line FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
    k AS (SELECT *, CASE WHEN regexp_matches(line, '{chunks.CHAPTER}') THEN 'chapter' WHEN regexp_matches(line, '{chunks.PART}') THEN 'part' WHEN regexp_matches(line, '{chunks.SECTION}') THEN 'section' ELSE 'body' END AS kind FROM e),
    s AS (SELECT *, CASE WHEN kind <> 'body' OR coalesce(lag(kind) OVER o IN ('chapter', 'part'), TRUE) THEN 1 ELSE 0 END AS fresh, last_value(CASE WHEN kind = 'chapter' THEN line END IGNORE NULLS) OVER o AS chapter,
        nullif(last_value(CASE kind WHEN 'part' THEN line WHEN 'chapter' THEN '' END IGNORE NULLS) OVER o, '') AS part FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
    u AS (SELECT doc_id, g, any_value(chapter) AS chapter, any_value(part) AS part, arg_min(line, i) AS head, arg_min(kind, i) = 'section' AS is_section, string_agg(line, chr(10) ORDER BY i) AS text FROM n WHERE kind NOT IN ('chapter', 'part') GROUP BY 1, 2),
    units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS unit, CASE WHEN is_section THEN regexp_extract(head, '{chunks.SECTION}', 1) END AS section_id,
        CASE WHEN is_section THEN regexp_extract(head, '{chunks.SECTION}', 1) || '. ' || substr(regexp_replace(regexp_extract(head, '{chunks.SECTION}', 2), '\s+$', ''), 1, 120) ELSE coalesce(chapter, part, 'preamble') END AS section_heading, chapter, part, text FROM u)"""


@query(f"WITH {STRUCTURE_SQL} SELECT doc_id, CAST(unit AS INT) AS unit, section_id, section_heading, chapter, part, md5(text) AS text_md5 FROM units")
def document_structure(spark, d):
    return chunks.structure(paged(spark, d)).select("doc_id", "unit", "section_id", "section_heading", "chapter", "part", F.md5("text").alias("text_md5"))


@query(f"""WITH {STRUCTURE_SQL}, c AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ts FROM units),
    t AS (SELECT doc_id, unit, section_id, section_heading, text FROM c WHERE NOT (len(ts) >= 3 AND (len(list_filter(ts, lambda x: regexp_matches(x, '\\. ?\\. ?\\.'))) * 10 >= len(ts) * 3 OR len(list_filter(ts, lambda x: length(x) < 90 AND regexp_matches(x, '[ \\t][0-9]{{1,4}}[ \\t]*$'))) * 10 >= len(ts) * 7)))
    SELECT doc_id || '-C' || lpad(CAST(row_number() OVER w AS VARCHAR), 4, '0') AS chunk_id, doc_id, last_value(section_id IGNORE NULLS) OVER w AS section_id,
        section_heading, section_id IS NULL AND last_value(section_id IGNORE NULLS) OVER w IS NOT NULL AS inherited, md5(text) AS text_md5, length(text) AS chars, length(text) < 120 AS thin FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY unit)""")
def section_fill(spark, d):
    """Numbered units without contents tables, with the section they belong to."""
    units = chunks.structure(paged(spark, d)).withColumnRenamed("unit", "at")
    return chunks.numbered_sections(units).withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@query()
def section_chunks(spark, d):
    """Structure, chunked: long units split on lines, short pieces merged; then filled and numbered."""
    made = chunks.numbered_sections(splitters.unit_chunks(paged(spark, d)))
    return made.withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@query()
def recursive_chunks(spark, d):
    """Cleaned documents cut at sentence and clause ends, thin and contents chunks left out."""
    pages = docs(spark, d).select("doc_id", F.lit(1).alias("page_number"), tx.clean_page(tx.nfkc("text")).alias("text"))
    return splitters.page_chunks(pages).select("doc_id", "page_number", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("chars"))


@query(f"SELECT doc_id, source FROM (SELECT source, doc_id, {CLEAN_SQL} AS text FROM documents) WHERE length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 80")
def pages_with_chunks(spark, d):
    """Only pages that gave a chunk themselves."""
    made = docs(spark, d).filter(tx.is_substantive(tx.clean_page(F.col("text")))).select("doc_id")
    return chunks.chunked_pages(docs(spark, d), made, "doc_id").select("doc_id", "source")


HITS_SQL = COSINE_SQL.format(where="") + ", h AS (SELECT query_id, vec_id AS page, rank, length(text) AS n FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 12)"


@query(f"""WITH RECURSIVE {HITS_SQL.strip()[5:]}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h),
    f AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT query_id FROM h)
        UNION ALL SELECT f.query_id, o.i, CASE WHEN total > 0 AND total + n > 6000 THEN total ELSE total + n + 2 END, CASE WHEN total > 0 AND total + n > 6000 THEN kept ELSE list_append(kept, page) END FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1)
    SELECT query_id, unnest(arg_max(kept, i)) AS page FROM f GROUP BY query_id""")
def relevant_pages(spark, d):
    """Of each query's pages as many as fit, the best first; pages that don't fit are skipped."""
    queries, corpus = vectors(spark, d)
    hits = retrieval.cosine_top_k(queries, corpus, 12).withColumnRenamed("vec_id", "page")
    sizes = docs(spark, d).select(F.col("doc_id").alias("page"), F.length("text").alias("n"))
    return planning.relevant(hits.join(sizes, "page"), "query_id", "page")


PROSE_SQL = r"p AS (SELECT source, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents), q AS (SELECT * FROM p WHERE length(text) >= 200)"


@query(f"""WITH {PROSE_SQL}, t AS (SELECT source, count(*) AS pages, CAST(sum(length(text) + 2) AS BIGINT) AS chars, ['mcq', 'practice_qsn', 'keypoints', 'flashcards'][CAST(length(source) % 4 + 1 AS INT)] AS task FROM q GROUP BY 1),
    c AS (SELECT *, CASE task WHEN 'mcq' THEN 8 WHEN 'practice_qsn' THEN 10 WHEN 'keypoints' THEN 16 ELSE 8 END AS most FROM t)
    SELECT source, task, pages, chars, greatest(1, most // 3) AS pages_per_group, CAST(ceil(pages / greatest(1, most // 3)) AS BIGINT) AS groups, greatest(CASE task WHEN 'keypoints' THEN 2 ELSE 1 END, 3 * least(greatest(1, most // 3), pages)) AS asks, 3 * pages AS requested,
        greatest(1, CAST(ceil(40.0 / most) AS BIGINT)) AS calls, least(6000, greatest(1200, CAST(ceil(CAST(chars AS DOUBLE) / greatest(1, CAST(ceil(40.0 / most) AS BIGINT))) AS BIGINT))) AS group_chars, greatest(5, least(30, pages)) AS sentences FROM c""")
def reading_plan(spark, d):
    """What a source's pages are asked for, at a rate for each page and for a total."""
    sizes = planning.prose(docs(spark, d).select("source", "doc_id", "text")).groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text") + 2).alias("chars"))
    task = F.get(F.array(*map(F.lit, ["mcq", "practice_qsn", "keypoints", "flashcards"])), F.length("source") % 4)
    sized = sizes.withColumn("task", task)
    return planning.count_plan(planning.rate_plan(sized, 3), 40).withColumn("sentences", planning.sentence_budget(F.col("pages")))


@query(r"""
    WITH i AS (SELECT conv_id, turn, regexp_replace(text, '[ \t\r\n]+', ' ', 'g') AS t FROM conversations), k AS (SELECT conv_id, turn, lower(trim(trim(split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 2)), '.?!,;:')) AS stem FROM i),
    f AS (SELECT conv_id // 10 AS key, stem, min((conv_id, turn)) AS at_ FROM k WHERE stem <> '' GROUP BY 1, 2)
    SELECT key, stem, CAST(row_number() OVER (PARTITION BY key ORDER BY at_) AS INT) AS place FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY at_) <= 12""")
def pooled_items(spark, d):
    """Items of several groups without repeated stems, the first twelve of each pool."""
    flat = F.regexp_replace("text", "[ \t\r\n]+", " ")
    stem = F.concat_ws(" ", F.split_part(flat, F.lit(" "), F.lit(1)), F.split_part(flat, F.lit(" "), F.lit(2)))
    items = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).alias("key"), "conv_id", "turn", stem.alias("stem"))
    return planning.pooled(items, "key", "conv_id", "turn", F.col("stem"), 12)


@query("""
    WITH RECURSIVE m AS (SELECT conv_id + 1000000 * (turn // 20) AS conv_id, list(CAST(length(text) % 9 AS INT) ORDER BY turn) AS made FROM conversations GROUP BY 1),
    f AS (SELECT conv_id, made, 1 AS i, 0 AS have, CAST([] AS INT[]) AS asks FROM m
        UNION ALL SELECT conv_id, made, i + 1, have + least(made[i], greatest(1, least(8, CAST(ceil((20 - have) / CAST(len(made) - i + 1 AS DOUBLE)) AS INT)))), list_append(asks, greatest(1, least(8, CAST(ceil((20 - have) / CAST(len(made) - i + 1 AS DOUBLE)) AS INT)))) FROM f WHERE i <= len(made) AND have < 20)
    SELECT conv_id, array_to_string(arg_max(asks, i), ',') AS asks FROM f GROUP BY 1""")
def remaining_shares(spark, d):
    """What each group is asked for when the ones before it fell short: twenty turns of a conversation are the groups."""
    made = table(spark, d, "conversations").groupBy((F.col("conv_id") + 1000000 * F.floor(F.col("turn") / 20)).alias("conv_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 9).alias("m")))), lambda x: x.m).alias("made"))
    return made.select("conv_id", F.array_join(F.transform(planning.shares(F.col("made"), 20, 8), lambda x: x.cast("string")), ",").alias("asks"))


@query("""
    WITH RECURSIVE s AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS n FROM documents GROUP BY 1),
    f AS (SELECT source, 0 AS rounds, n FROM s UNION ALL SELECT source, rounds + 1, CAST(ceil(n / 6000.0) AS BIGINT) * greatest(2, least(30, 6000 // 120 // 2)) * 120 FROM f WHERE n > 6000 AND CAST(ceil(n / 6000.0) AS BIGINT) * greatest(2, least(30, 6000 // 120 // 2)) * 120 < n AND rounds < 64)
    SELECT source, CAST(max(rounds) AS INT) AS rounds, arg_max(n, rounds) AS chars FROM f GROUP BY 1""")
def summary_folds(spark, d):
    """Rounds of folding that a source's summary takes to fit."""
    return planning.folds(docs(spark, d).select("source", F.length("text").alias("n0")), "source", "n0", 6000)


@query("SELECT doc_id, 'DOC-' || lpad(CAST(row_number() OVER (ORDER BY source, doc_id) AS VARCHAR), 3, '0') AS label FROM (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1)")
def corpus_numbers(spark, d):
    """The first document of each source, numbered over the corpus."""
    first = docs(spark, d).groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return logs.numbered(first, "source", "doc_id").select("doc_id", F.format_string("DOC-%03d", "number").alias("label"))


FILE_SQL = "['Penal-Code', 'Code of Criminal', 'Civil.Procedure', 'CONSTITUTION', 'evidence', 'Companies', 'Patent', 'Muslim-Marriage', 'consumer', 'Land', 'Labour', 'Arbitration', 'Appeal', 'Gazette', 'x'][CAST(p_partkey % 15 + 1 AS INT)] || '-' || replace(p_name, ' ', '-') || '.pdf'"
SUBJECT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{label}'" for p, label in reports.SUBJECTS) + f" ELSE '{reports.OTHER_SUBJECT}' END"


def named_files(spark, d):
    word = F.get(F.array(*map(F.lit, ["Penal-Code", "Code of Criminal", "Civil.Procedure", "CONSTITUTION", "evidence", "Companies", "Patent", "Muslim-Marriage", "consumer", "Land", "Labour", "Arbitration", "Appeal", "Gazette", "x"])), (F.col("p_partkey") % 15).cast("int"))
    return table(spark, d, "part").select("*", F.concat(word, F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".pdf")).alias("filename"))


@query(f"""WITH f AS (SELECT *, {FILE_SQL} AS filename FROM part) SELECT p_partkey, {SUBJECT_SQL.format('filename')} AS subject,
    coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled')[1:40] AS slug FROM f""")
def subject_rules(spark, d):
    return named_files(spark, d).select("p_partkey", reports.guessed(F.col("filename")).alias("subject"), tx.slug(F.col("p_name")).alias("slug"))


@query("""SELECT event_type, count(*) AS n, list_sort(list(length(props)))[count(*) // 2 + 1] AS p50, list_sort(list(length(props)))[CAST(least(count(*) - 1, floor(count(*) * 0.95)) AS INT) + 1] AS p95, max(length(props)) AS longest FROM events GROUP BY 1""")
def prop_lengths(spark, d):
    n = F.col("n")
    rows = table(spark, d, "events").select("event_type", F.length("props").alias("chars"))
    return logs.at_rank(rows, "event_type", "chars", {"p50": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * 0.95)), "longest": n - 1})


@query("SELECT doc_id, 'Page ' || doc_id || ': ' || text[1:50] AS block FROM documents")
def context_blocks(spark, d):
    return docs(spark, d).select("doc_id", rd.context_block(F.array(F.struct(F.col("doc_id").alias("page"), F.substring("text", 1, 50).alias("text")))).alias("block"))
