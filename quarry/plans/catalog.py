"""Registered queries over the given tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import text as tx
from quarry.functions import verdicts as vd
from quarry.operators import chunks, dataset, logs, packing, retrieval
from quarry.plans.registry import QUERIES, SQL, docs, query, table
from quarry.sources import readers
from quarry.sources.sinks import shared_folder


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_unique(spark, d):
    return dataset.exact_unique(docs(spark, d))


CHUNKS_SQL = """
    SELECT doc_id, i AS chunk_index, i * 850 AS start, substr(text, i * 850 + 1, 1000) AS chunk
    FROM documents, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1
        ELSE CAST(ceil((length(text) - 1000) / 850.0) AS BIGINT) + 1 END)) AS u(i)"""
ALNUM_SQL = "length(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"
#: Page cleaning after Unicode normalisation, which DuckDB lacks.
CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(translate(text, '“”‘’–—•●✓✔ ', concat('""', chr(39), chr(39), '------ ')), 'ﬁ', 'fi'), 'ﬂ', 'fl'),
    '(?m)^[\s\x0b\x1c-\x1f\x{85}]*\p{Nd}{1,4}[\s\x0b\x1c-\x1f\x{85}]*$', '', 'g'), '([A-Za-z])-[\s\x0b\x1c-\x1f\x{85}]*\n[\s\x0b\x1c-\x1f\x{85}]*([a-z])', '\1\2', 'g'),
    '([a-zA-Z]+)[\s\x0b\x1c-\x1f\x{85}]*\n[\s\x0b\x1c-\x1f\x{85}]*-[\s\x0b\x1c-\x1f\x{85}]*([a-zA-Z]+)', '\1\2', 'g'), '(?:^|\n)[ \t]*[-*][ \t]+', ' ', 'g'),
    '[\s\x0b\x1c-\x1f\x{85}\x{2028}\x{2029}]+', ' ', 'g'))"""


@query(f"SELECT doc_id, chunk_index, start, md5(chunk) AS chunk_md5, length(chunk) AS chars FROM ({CHUNKS_SQL})")
def sliding_chunks(spark, d):
    made = chunks.sliding(docs(spark, d))
    return made.select("doc_id", "chunk_index", "start", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("chars"))


@query(f"""
    WITH firsts AS (SELECT doc_id, lang, text FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1),
    cleaned AS (SELECT doc_id, lang, {CLEAN_SQL} AS text FROM firsts),
    cut AS (SELECT lang, substr(text, i * 850 + 1, 1000) AS chunk FROM cleaned,
        unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1
            ELSE CAST(ceil((length(text) - 1000) / 850.0) AS BIGINT) + 1 END)) AS u(i))
    SELECT lang, count(*) AS n_chunks, sum(length(chunk)) AS chars FROM cut
    WHERE {ALNUM_SQL.format('chunk')} >= 80 GROUP BY lang""")
def corpus_flow(spark, d):
    """Exact dedup, cleaning, chunking and filtering, counted by language."""
    first = docs(spark, d).groupBy(F.sha2("text", 256)).agg(F.min(F.struct("doc_id", "lang", "text")).alias("r"))
    cleaned = first.select("r.lang", tx.clean_page(F.col("r.text")).alias("text"))
    made = cleaned.select("lang", F.explode(chunks.windows_of(F.col("text"))).alias("chunk")).filter(tx.is_substantive(F.col("chunk")))
    return made.groupBy("lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("chars"))


@query(f"SELECT doc_id, md5({CLEAN_SQL}) AS cleaned_md5 FROM documents")
def clean_core(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.clean_page(F.col("text"))).alias("cleaned_md5"))


@query(r"""
    SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
        lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '' AND NOT regexp_full_match(x, '[- \t]*[0-9]{1,4}[- \t]*')), ' '),
        '[ \t]{2,}', ' ', 'g')) AS cleaned_md5 FROM documents""")
def clean_legacy(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.clean_lines(F.col("text"))).alias("cleaned_md5"))


@query(rf"""
    WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
    c AS (SELECT *, len(lines) AS n, len(list_filter(lines, lambda x: regexp_matches(x, '\. ?\. ?\.'))) AS led,
        len(list_filter(lines, lambda x: length(x) < 90 AND regexp_matches(x, '[ \t][0-9]{{1,4}}[ \t]*$'))) AS ended FROM l)
    SELECT doc_id, {ALNUM_SQL.format('text')} >= 80 AS substantive,
        len(regexp_extract_all(text, '(?:\.[ \t\r\n]*){{3,}}')) >= 4 AS contents,
        n >= 3 AND (led * 10 >= n * 3 OR ended * 10 >= n * 7) AS toc FROM c""")
def text_predicates(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", tx.is_substantive(t).alias("substantive"), tx.is_contents(t, 4).alias("contents"), tx.is_toc(t).alias("toc"))


@query("""
    WITH pages AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 6),
    l AS (SELECT DISTINCT source, doc_id, trim(x) AS line FROM documents, unnest(string_split(text, chr(10))) AS u(x)),
    f AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE line <> '' AND length(line) <= 90 GROUP BY 1, 2)
    SELECT source, line, n AS "on" FROM f JOIN pages USING (source) WHERE n >= greatest(3, CAST(floor(pages * 0.02) AS BIGINT))""")
def furniture_lines(spark, d):
    return chunks.repeated_lines(docs(spark, d), "source", "doc_id", share=0.02)


@query()
def html_text(spark, d):
    return readers.html_text(table(spark, d, "pages"))


SHORT = "length(line) < 40"


@query(f"""
    WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
    h AS (SELECT *, CASE WHEN {SHORT} THEN line END AS heading FROM l)
    SELECT doc_id, line_no, last_value(heading IGNORE NULLS) OVER w AS filled, heading IS NULL AND last_value(heading IGNORE NULLS) OVER w IS NOT NULL AS inherited
    FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def forward_fill(spark, d):
    rows = chunks.lines(docs(spark, d), "doc_id").withColumn("heading", F.when(F.length("line") < 40, F.col("line")))
    return chunks.forward_fill(rows, "doc_id", "line_no", "heading").select("doc_id", "line_no", "filled", "inherited")


@query(f"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
    u AS (SELECT *, sum(CAST({SHORT} AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS unit FROM l)
    SELECT doc_id, CAST(unit AS BIGINT) AS unit, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM u GROUP BY 1, 2""")
def structure_units(spark, d):
    return chunks.units(chunks.lines(docs(spark, d), "doc_id"), "doc_id", "line_no", F.length("line") < 40)


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2")
def term_freq(spark, d):
    return retrieval.term_frequencies(docs(spark, d), "doc_id")


@query("""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
    SELECT term, CAST(CAST(concat('0x', md5(term)) AS UHUGEINT) % 1000000 AS BIGINT) AS bucket FROM w""")
def feature_hash(spark, d):
    words = docs(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", tx.bucket_of(F.col("term")).alias("bucket"))


COSINE_SQL = """
    WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def vectors(spark, d):
    """The stated queries, every vector whose id is divisible by 50, and all vectors."""
    rows = table(spark, d, "embeddings")
    return rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows


@query(COSINE_SQL.format(where="") + " SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def cosine_topk(spark, d):
    return retrieval.cosine_top_k(*vectors(spark, d), k=20)


@query(COSINE_SQL.format(where="AND c.label IN (1, 3)") + " SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def cosine_topk_filtered(spark, d):
    queries, corpus = vectors(spark, d)
    return retrieval.cosine_top_k(queries, corpus.filter(F.col("label").isin(1, 3)), k=3)


@query(COSINE_SQL.format(where="") + """, t AS (SELECT * FROM r WHERE rank <= 20 AND (score >= 0.3 OR rank = 1))
    SELECT query_id, CASE WHEN max(score) >= 0.25 THEN 'grounded' ELSE 'general' END AS mode,
        CASE WHEN max(score) >= 0.25 THEN count(*) ELSE 0 END AS contexts, max(score) AS top_score FROM t GROUP BY 1""")  # fmt: skip
def retrieval_mode(spark, d):
    ranked = retrieval.cosine_top_k(*vectors(spark, d), k=20)
    return retrieval.modes(retrieval.passing(ranked, 0.3), "query_id")


@query(COSINE_SQL.format(where="") + """, b AS (SELECT query_id, label AS page, min(rank) AS best FROM r WHERE rank <= 20 GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, page) AS place FROM b)
    SELECT query_id, page, CAST(best AS INT) AS best, CAST(place AS INT) AS place FROM p WHERE place <= 3""")  # fmt: skip
def page_rank_dedup(spark, d):
    queries, corpus = vectors(spark, d)
    hits = retrieval.cosine_top_k(queries, corpus, k=20).join(corpus.select("vec_id", F.col("label").alias("page")), "vec_id")
    return dataset.ranked_pages(hits, "query_id", "page", 3)


SPARSE_SQL = """
    WITH dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2),
    qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 50 = 0) GROUP BY 1, 2),
    s AS (SELECT query_id, doc_id, CAST(sum(tf * qtf) AS BIGINT) AS score FROM dt JOIN qt USING (term) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def sparse_ranked(spark, d, k):
    queries = table(spark, d, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.top(retrieval.sparse_scores(queries, docs(spark, d)), "query_id", "score", "doc_id", k)


@query(SPARSE_SQL + " SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def sparse_topk(spark, d):
    return sparse_ranked(spark, d, 10)


HYBRID_SQL = COSINE_SQL.format(where="") + """, dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2),
    qt AS (SELECT doc_id AS query_id, term, tf AS qtf FROM dt WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
    sp AS (SELECT query_id, doc_id, CAST(sum(tf * qtf) AS BIGINT) AS score FROM dt JOIN qt USING (term) GROUP BY 1, 2),
    sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sp),
    f AS (SELECT query_id, doc_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 6) AS score
        FROM (SELECT query_id, vec_id AS doc_id, rank FROM r WHERE rank <= 20) a FULL JOIN (SELECT query_id, doc_id, rank FROM sr WHERE rank <= 20) b USING (query_id, doc_id)),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)"""


def hybrid(spark, d, k):
    """Dense and sparse lists of the same queries, fused: documents and vectors share their ids."""
    queries, corpus = vectors(spark, d)
    dense = retrieval.cosine_top_k(queries, corpus, 20).withColumnRenamed("vec_id", "doc_id")
    texts = docs(spark, d).join(queries.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "text")
    sparse = retrieval.sparse_top_k(texts, docs(spark, d).select("doc_id", "text"), 20)
    return retrieval.fuse(dense, sparse, "query_id", "doc_id", k)


@query(HYBRID_SQL + " SELECT query_id, doc_id, score, first_rank, second_rank, CAST(rank AS INT) AS rank FROM g JOIN (SELECT query_id, doc_id, CAST(a.rank AS INT) AS first_rank, CAST(b.rank AS INT) AS second_rank FROM (SELECT query_id, vec_id AS doc_id, rank FROM r WHERE rank <= 20) a FULL JOIN (SELECT * FROM sr WHERE rank <= 20) b USING (query_id, doc_id)) USING (query_id, doc_id) WHERE rank <= 10")
def hybrid_rrf(spark, d):
    return hybrid(spark, d, 10)


@query(HYBRID_SQL + """, c AS (SELECT g.query_id, g.doc_id, list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')) AS qs, list_distinct(regexp_extract_all(lower(x.text), '[a-z0-9]+')) AS ds
        FROM g JOIN documents q ON q.doc_id = g.query_id JOIN documents x ON x.doc_id = g.doc_id WHERE rank <= 20),
    o AS (SELECT query_id, doc_id, round(len(list_intersect(qs, ds)) / CAST(greatest(len(qs), 1) AS DOUBLE), 6) AS score FROM c),
    l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o)
    SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM l WHERE rank <= 3 AND (score >= 0.5 OR rank = 1)""")  # fmt: skip
def two_stage_retrieval(spark, d):
    root = shared_folder(spark, "two-stage")
    hybrid(spark, d, DEFAULTS.rerank_candidates).select("query_id", "doc_id").write.parquet(f"{root}/found")
    found = spark.read.parquet(f"{root}/found")
    wanted = found.select("doc_id").union(found.select("query_id")).distinct()
    few = F.broadcast(wanted) if wanted.count() <= retrieval.BROADCAST_TERMS else wanted
    docs(spark, d).select("doc_id", "text").join(few, "doc_id", "left_semi").write.parquet(f"{root}/texts")  # one read for queries and candidates
    texts = spark.read.parquet(f"{root}/texts")
    return retrieval.two_stage_by_words(found, texts)


@query("""
    WITH c AS (SELECT source, doc_id, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
    SELECT source, doc_id, CAST(CASE WHEN n <= 6000 - before THEN n ELSE 6000 - before END AS BIGINT) AS taken FROM c WHERE before < 6000 AND (n <= 6000 - before OR 6000 - before > 300)""")
def page_budget(spark, d):
    return chunks.page_budget(docs(spark, d), "source", "doc_id")


def packed_sql(most: int) -> str:
    full = f"open + r.n > 6000 OR held >= {most}"
    return f"""
        WITH RECURSIVE r AS (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
        f AS (SELECT source, i, 0 AS run, n + 2 AS open, 1 AS held FROM r WHERE i = 1
            UNION ALL SELECT r.source, r.i, CASE WHEN {full} THEN run + 1 ELSE run END, CASE WHEN {full} THEN r.n + 2 ELSE open + r.n + 2 END, CASE WHEN {full} THEN 1 ELSE held + 1 END FROM f JOIN r ON r.source = f.source AND r.i = f.i + 1)
        SELECT source, CAST(run AS BIGINT) AS run, count(*) AS rows, CAST(sum(n) AS BIGINT) AS chars FROM f JOIN r USING (source, i) GROUP BY 1, 2"""


@query(packed_sql(1 << 30))
def packed_groups(spark, d):
    """Each source's documents in runs that fit a prompt."""
    return packing.pack(docs(spark, d), "source", "doc_id", 6000)


@query(packed_sql(3))
def packed_triples(spark, d):
    """The same with three documents at most in a run."""
    return packing.pack(docs(spark, d), "source", "doc_id", 6000, 3)


@query("""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id FROM n WHERE list_contains(list_transform(range(7), lambda i: CAST(floor(i * n / 7.0) AS BIGINT)), pos)""")
def even_sample(spark, d):
    return chunks.even_sample(docs(spark, d).select("source", "doc_id"), "source", "doc_id", 7)


TEMPLATE_SQL = "CASE pair_type " + " ".join(f"WHEN '{k}' THEN '{{0}}'".format(v[0].replace("\n", "' || chr(10) || '")) for k, v in dataset.TEMPLATES.items()) + " END"
ANSWER_TEMPLATE_SQL = "CASE pair_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in dataset.TEMPLATES.items()) + " END"
FILLED_SQL = "md5(replace(replace(replace({0}, '%subject%', lang), '%heading%', heading), '%snippet%', snippet))"


@query(f"""
    WITH p AS (SELECT doc_id, lang, n, ['qa', 'summary', 'mcq'][n % 3 + 1] AS pair_type, CASE WHEN doc_id % 3 = 0 THEN 'H' || doc_id WHEN doc_id % 3 = 1 THEN 'Chapter ' || source ELSE 'the excerpt' END AS heading,
        replace(substr(text, 1, 280), chr(10), ' ') || CASE WHEN length(text) > 280 THEN '...' ELSE '' END AS snippet FROM documents, unnest(range(4)) AS u(n))
    SELECT doc_id || '-' || pair_type || '-' || n || '-' || substr(sha1(concat_ws('|', doc_id, pair_type, n)), 1, 10) AS pair_id, doc_id AS chunk_id, pair_type, CAST(n AS INT) AS n,
        {FILLED_SQL.format(TEMPLATE_SQL)} AS instruction_md5, {FILLED_SQL.format(ANSWER_TEMPLATE_SQL)} AS output_md5 FROM p""")
def mock_pairs(spark, d):
    i = F.col("doc_id")
    rows = docs(spark, d).select(i.alias("chunk_id"), F.col("lang").alias("subject_area"), F.when(i % 3 == 0, F.concat(F.lit("H"), i.cast("string"))).when(i % 3 == 1, "").alias("section_heading"), F.when(i % 3 == 1, F.concat(F.lit("Chapter "), "source")).alias("chapter"), "text")
    made = dataset.draft_pairs(rows, ["qa", "summary", "mcq"], 4)
    return made.select("pair_id", "chunk_id", "pair_type", "n", F.md5("instruction").alias("instruction_md5"), F.md5("output").alias("output_md5"))


@query("""
    WITH o AS (SELECT doc_id AS doc, lang AS subject, md5('42:' || doc_id) AS h, md5('42:' || lang) AS hs FROM documents), n AS (SELECT count(*) AS n FROM o), k AS (SELECT greatest(1, CAST(round_even(n * 0.15, 0) AS INT)) AS take FROM n),
    a AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY h, doc) > 1 AS later FROM o), b AS (SELECT *, row_number() OVER (ORDER BY later, CASE WHEN later THEN h ELSE hs END, doc) AS number FROM a),
    c AS (SELECT doc, subject, h, hs, row_number() OVER (PARTITION BY subject ORDER BY h, doc) > 1 AS later FROM b, k WHERE number > take), e AS (SELECT *, row_number() OVER (ORDER BY later, CASE WHEN later THEN h ELSE hs END, doc) AS number FROM c)
    SELECT doc, subject, 'test' AS split FROM b, k WHERE number <= take UNION ALL SELECT doc, subject, CASE WHEN number <= take THEN 'val' ELSE 'train' END FROM e, k""")
def document_split(spark, d):
    """Whole documents to splits, every subject once in test and val first."""
    return dataset.document_split(docs(spark, d).select(F.col("doc_id").alias("doc"), F.col("lang").alias("subject")))


LABELS = r"\b(?:section|sections|sec\.|s\.|article|articles|art\.|chapter|part|rule|order)[\t-\r ]+([0-9]{1,3}[a-z]{0,2})"
#: Answers that cite: a document and provisions by its id, one of them its section; excerpts that hold some of them.
ANSWER_SQL = "text || ' See Section ' || doc_id % 7 || 'A and article ' || doc_id % 5 || ', rule ' || doc_id % 11 || '.'"
EXCERPT_SQL = "CASE WHEN doc_id % 9 = 0 THEN chr(10) || doc_id % 5 || '. ' ELSE '' END || text || ' note ' || doc_id % 7 || 'a, of ' || doc_id % 11 || '. (1) x'"
GROUNDING_SQL = rf"""
    WITH p AS (SELECT doc_id, lang AS pair_type, {ANSWER_SQL} AS output, {EXCERPT_SQL} AS excerpt, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 5 AS VARCHAR) END AS section_id FROM documents),
    c AS (SELECT *, list_sort(list_filter(list_distinct(regexp_extract_all(lower(output), '{LABELS}', 1)), lambda x: NOT list_contains(list_concat(regexp_extract_all(lower(excerpt), '{LABELS}', 1),
        regexp_extract_all(lower(excerpt), '(?:^|\n)[\t-\r ]*([0-9]{{1,3}}[a-z]{{0,2}})[\t-\r ]*\.', 1), regexp_extract_all(lower(excerpt), '([0-9]{{1,3}}[a-z]{{0,2}})[\t-\r ]*\.[\t-\r ]*\([0-9a-z]', 1),
        regexp_extract_all(lower(excerpt), '\b([0-9]{{1,3}}[a-z]{{1,2}})\b', 1), [coalesce(section_id, '')]), x))) AS missing FROM p),
    r AS (SELECT doc_id, pair_type, output, array_to_string(missing, ',') AS unsupported, CASE WHEN length(regexp_replace(output, '^[\t-\r ]+|[\t-\r ]+$', '', 'g')) < 40 THEN 'answer too short' WHEN len(missing) > 0 THEN 'cites ' || array_to_string(missing, ',') || ' not in excerpt' END AS reason FROM c)"""


def checked_pairs(spark, d):
    i = F.col("doc_id")
    text = lambda x: x.cast("string")
    answer = F.concat("text", F.lit(" See Section "), text(i % 7), F.lit("A and article "), text(i % 5), F.lit(", rule "), text(i % 11), F.lit("."))
    excerpt = F.concat(F.when(i % 9 == 0, F.concat(F.lit("\n"), text(i % 5), F.lit(". "))).otherwise(""), "text", F.lit(" note "), text(i % 7), F.lit("a, of "), text(i % 11), F.lit(". (1) x"))
    rows = docs(spark, d)
    pairs_ = rows.select("doc_id", F.col("lang").alias("pair_type"), answer.alias("output"), F.when(i % 4 == 0, text(i % 5)).alias("section_id"))
    return dataset.check_pairs(pairs_, rows.select("doc_id", excerpt.alias("text")), "doc_id")


@query(GROUNDING_SQL + " SELECT doc_id, pair_type, unsupported, reason FROM r")
def grounding_check(spark, d):
    return checked_pairs(spark, d)


@query("""
    SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY 1""")
def sft_records(spark, d):
    made = dataset.to_sft(table(spark, d, "conversations"))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content)), "\n")
    return made.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.md5(text).alias("messages_md5"))


PAIRS_SQL = "WITH p AS (SELECT lang AS subject, source AS doc, source || '::' || CAST(doc_id % 5 AS VARCHAR) AS unit, doc_id FROM documents)"


def pairs(spark, d):
    unit = F.concat_ws("::", "source", F.pmod("doc_id", F.lit(5)).cast("string"))
    return docs(spark, d).select(F.col("lang").alias("subject"), F.col("source").alias("doc"), unit.alias("unit"), "doc_id")


@query(PAIRS_SQL + """, c AS (SELECT subject, doc, count(*) AS n FROM p GROUP BY 1, 2),
    k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n, doc) = 1 AND count(*) OVER (PARTITION BY subject) >= 2),
    l AS (SELECT p.subject, count(DISTINCT unit) AS units_left FROM p ANTI JOIN k ON k.subject = p.subject AND k.doc = p.doc GROUP BY 1)
    SELECT subject, doc, n, coalesce(units_left, 0) AS units_left, coalesce(units_left, 0) >= 3 AS held FROM k LEFT JOIN l USING (subject)""")  # fmt: skip
def strict_holdout(spark, d):
    return dataset.strict_holdout(pairs(spark, d))


def split_rows(spark, d):
    """Whole units by a hash of ids: doc_id div 10 is the unit."""
    place = F.pmod(F.floor(F.col("doc_id") / 10) * 37, F.lit(100))
    split = F.when(place < 70, "train").when(place < 85, "val").otherwise("test")
    return docs(spark, d).select(F.col("lang").alias("subject"), F.col("source").alias("doc"), F.floor(F.col("doc_id") / 10).alias("unit"), split.alias("split"))


SPLIT_SQL = "WITH s AS (SELECT lang AS subject, source AS doc, doc_id // 10 AS unit, CASE WHEN doc_id // 10 * 37 % 100 < 70 THEN 'train' WHEN doc_id // 10 * 37 % 100 < 85 THEN 'val' ELSE 'test' END AS split FROM documents)"


@query(SPLIT_SQL + " SELECT subject, " + ", ".join(f"count(*) FILTER (split = '{s}') AS pairs_{s}, count(DISTINCT doc) FILTER (split = '{s}') AS docs_{s}" for s in dataset.SPLITS)
    + ", concat_ws('|', " + ", ".join(f"CASE WHEN count(*) FILTER (split = '{s}') = 0 THEN '{s}' END" for s in dataset.SPLITS) + ") AS missing_in FROM s GROUP BY 1")
def balance_crosstab(spark, d):
    return dataset.crosstab(split_rows(spark, d))


@query(SPLIT_SQL + " SELECT count(*) AS leaks FROM (SELECT unit FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def split_disjoint(spark, d):
    return dataset.leaks(split_rows(spark, d), "unit").agg(F.count(F.lit(1)).alias("leaks"))


@query()
def stratified_split(spark, d):
    units = pairs(spark, d).groupBy("subject", "unit").agg(F.count(F.lit(1)).alias("n"))
    return dataset.stratified_assign(units)


@query("""
    WITH t AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS x, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS y, a.text FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
    m AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0) AS c FROM t)
    SELECT conv_id, turn, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (len(x) + len(y)) END, 6) AS f1, nullif(regexp_extract(upper(text), '\\b([ABCD])\\b', 1), '') AS letter FROM m""".replace("\\\\", "\\"))
def token_f1(spark, d):
    turns = table(spark, d, "conversations")
    gold = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    own = turns.join(gold, ["conv_id", "turn"])
    return own.select("conv_id", "turn", F.round(tx.token_f1(tx.tokens(F.col("text")), tx.tokens(F.col("gold"))), 6).alias("f1"), tx.answer_letter(F.col("text")).alias("letter"))


@query("""
    SELECT event_type, count(value) AS n, list_sort(list(value))[CAST(floor(0.95 * (count(value) - 1)) AS INT) + 1] AS p95,
        list_sort(list(value))[CAST(floor(count(value) / 2) AS INT) + 1] AS p50, list_sort(list(value))[least(count(value) - 1, CAST(floor(count(value) * 0.95) AS INT)) + 1] AS p95_length
    FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_ranks(spark, d):
    n = F.col("n")
    picks = {"p95": F.floor(F.lit(0.95) * (n - 1)), "p50": F.floor(n / 2), "p95_length": F.least(n - 1, F.floor(n * 0.95))}
    return logs.at_rank(table(spark, d, "events"), "event_type", "value", picks)


SCORE_SQL = "greatest(1, least(100, CAST(floor(value) AS INT)))"


def scores(spark, d):
    score = F.greatest(F.lit(1), F.least(F.lit(100), F.floor("value").cast("int")))
    return table(spark, d, "events").select(F.col("event_type").alias("task"), score.alias("score"), "user_id", "event_id", "ts")


@query(f"""
    WITH s AS (SELECT event_type AS task, {SCORE_SQL} AS score FROM events WHERE value IS NOT NULL)
    SELECT task, count(*) AS n, min(score) AS low, max(score) AS high, round(avg(score), 1) AS mean, count(DISTINCT score) AS distinct_scores,
        round(avg(CASE WHEN score >= 70 THEN 1.0 ELSE 0.0 END), 3) AS pass_rate, list_sort(list(score))[count(*) // 2 + 1] AS median FROM s GROUP BY 1""")
def judge_stats(spark, d):
    return logs.judge_stats(scores(spark, d))


@query("SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1")
def stage_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH a AS (SELECT user_id AS key, CASE WHEN event_type <> 'error' THEN {SCORE_SQL} END AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
    b AS (SELECT key, max(score) AS score, max(attempt) AS last FROM a GROUP BY 1), c AS (SELECT b.key, coalesce(min(a.attempt), any_value(last)) AS attempt, b.score FROM b LEFT JOIN a ON a.key = b.key AND a.score = b.score GROUP BY b.key, b.score),
    q AS (SELECT *, CASE key % 4 WHEN 0 THEN '' WHEN 1 THEN 'The judge failed to return a verdict' ELSE 'Name the section' END AS critique FROM c)
    SELECT key, attempt, score, CASE WHEN coalesce(score >= 70, FALSE) OR attempt >= 3 OR critique = '' OR contains(critique, 'failed to return a verdict') OR coalesce(score, 0) < 45 THEN 'persist' ELSE 'generate' END AS chat,
        CASE WHEN coalesce(score >= 70, FALSE) OR attempt >= 3 THEN 'persist' ELSE 'generate' END AS resource FROM q""")
def best_attempt(spark, d):
    from pyspark.sql import Window as W

    order = W.partitionBy("key").orderBy("ts", "event_id")
    rows = scores(spark, d).select(F.col("user_id").alias("key"), F.when(F.col("task") != "error", F.col("score")).alias("score"), "ts", "event_id")
    best = logs.best_attempts(rows.withColumn("attempt", F.row_number().over(order).cast("bigint")))
    critique = F.when(F.col("key") % 4 == 0, "").when(F.col("key") % 4 == 1, "The judge failed to return a verdict").otherwise("Name the section")
    passed, most = F.col("score") >= 70, 3
    chat = vd.chat_route(passed, F.col("attempt"), F.col("score"), F.lit(70), critique, most)
    return best.select("*", chat.alias("chat"), vd.resource_route(passed, F.col("attempt"), most).alias("resource"))


@query("""
    WITH i AS (SELECT p_brand AS set_id, p_name AS stem, [p_type, p_name, p_brand, CASE WHEN p_size % 7 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END] AS options, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS answer FROM part),
    k AS (SELECT *, list_transform(options, lambda x: lower(trim(trim(regexp_replace(x, '[ \t\r\n]+', ' ', 'g')), '.?!,;:'))) AS ks, lower(trim(trim(regexp_replace(answer, '[ \t\r\n]+', ' ', 'g')), '.?!,;:')) AS a FROM i),
    m AS (SELECT *, list_position(ks, a) AS slot, len(list_distinct(ks)) < 4 AS dup, options[list_position(list_transform(options, lambda x: length(x)), list_max(list_transform(options, lambda x: length(x))))] = answer AS longest FROM k)
    SELECT set_id, count(slot) AS n, count(slot) >= 4 AND count(DISTINCT slot) = 1 AS one_slot, count(slot) >= 4 AND bool_and(longest) AS always_longest,
        count(DISTINCT lower(trim(trim(regexp_replace(stem, '[ \t\r\n]+', ' ', 'g')), '.?!,;:'))) < count(*) AS duplicate_stems, CAST(sum(CAST(dup OR slot IS NULL AS INT)) AS BIGINT) AS faulty FROM m GROUP BY 1""")
def mcq_set_bias(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    options = F.array("p_type", "p_name", "p_brand", F.when(size % 7 == 0, F.col("p_brand")).otherwise(size.cast("string")))
    items = p.select(F.col("p_brand").alias("set_id"), F.col("p_name").alias("stem"), options.alias("options"), F.when(size % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("answer"))
    faulty = items.groupBy("set_id").agg(F.sum((F.size(vd.mcq_faults(F.col("stem"), F.col("options"), F.col("answer"))) > 0).cast("bigint")).alias("faulty"))
    return dataset.set_bias(items).join(faulty, "set_id")


@query("""
    SELECT conv_id, turn, role, length(text) AS chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""")
def history_last_n(spark, d):
    return logs.last_turns(table(spark, d, "conversations"), 2).select("conv_id", "turn", "role", F.length("text").alias("chars"))


@query(r"""
    WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, turn, before IS NOT NULL AND (len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '')) <= 4 OR regexp_matches(lower(text), '^(it|this|that|he|she|his|her|they|their|what about|why)\b')
        OR NOT list_has_any(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), regexp_extract_all(lower(before), '[\p{L}\p{N}_]+'))) AS follow_up FROM t WHERE role = 'user'""")
def follow_ups(spark, d):
    return logs.needs_rewrite(table(spark, d, "conversations"))


@query("SELECT user_id AS conv_id, count(*) AS turns, CAST(max(ts) AS VARCHAR)[1:19] AS last_activity FROM events GROUP BY 1 ORDER BY max(ts) DESC, conv_id LIMIT 20")
def list_sessions(spark, d):
    made = logs.sessions(table(spark, d, "events").withColumnRenamed("user_id", "conv_id"), "ts")
    return made.withColumn("last_activity", F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss"))


@query("""
    WITH l AS (SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200)
    SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM l JOIN customer USING (c_custkey)""")
def listing_join(spark, d):
    links = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return logs.linked(links, table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "o_totalprice", "o_orderkey", 200)


@query("""
    SELECT coalesce(o_orderpriority, 'all') AS task, count(*) AS total, CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS accepted, round(sum(CAST(o_orderstatus = 'F' AS INT)) / nullif(count(*), 0), 3) AS rate
    FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def acceptance_overview(spark, d):
    return logs.acceptance(table(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), (F.col("o_orderstatus") == "F").alias("accepted")))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins_merge(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return logs.latest_wins(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
    SELECT user_id, CAST(min(ts) AS VARCHAR)[1:19] AS added_at, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS event_type FROM events GROUP BY 1""")
def set_on_insert(spark, d):
    made = logs.set_on_insert(table(spark, d, "events"), ["user_id"], "ts", "event_id", "added_at", ["event_type"])
    return made.select("user_id", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("added_at"), "event_type")


@query("""
    SELECT user_id, arg_max(value, struct_pack(ts := ts, e := event_id)) FILTER (event_type = 'purchase') AS paid, arg_max(event_id, struct_pack(ts := ts, e := event_id)) FILTER (event_type = 'signup') AS signup FROM events GROUP BY 1""")
def null_safe_upsert(spark, d):
    kind = F.col("event_type")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(kind == "purchase", F.col("value")).alias("paid"), F.when(kind == "signup", F.col("event_id")).alias("signup"))
    return logs.keep_known(rows, ["user_id"], ["ts", "event_id"], ["paid", "signup"])


@query("""
    WITH left_ AS (SELECT DISTINCT l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity >= 3))
    SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM left_)""")
def refcount_delete(spark, d):
    pair = ["l_orderkey", "l_linenumber"]
    links = table(spark, d, "lineitem").select(*pair, "l_partkey", "l_quantity")
    return logs.orphans(links.drop("l_quantity"), links.filter("l_quantity >= 3"), pair, "l_partkey")


@query("""
    SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
    UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def cascading_delete(spark, d):
    gone = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("nation"))
    kept = logs.cascade({n: table(spark, d, n).withColumnRenamed(f"{n[0]}_nationkey", "nation") for n in ("customer", "supplier")}, gone, "nation")
    count = lambda n: kept[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("customer").unionByName(count("supplier"))


@query("""
    WITH e AS (SELECT max(CAST(ts AS DATE)) AS last FROM events), c AS (SELECT CAST(unnest(generate_series(last - 44, last, INTERVAL 1 DAY)) AS DATE) AS day FROM e)
    SELECT CAST(day AS VARCHAR) AS day, count(event_id) AS n FROM c LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY 1""")
def daily_activity(spark, d):
    return logs.daily(table(spark, d, "events"), "ts", 45).select(F.col("day").cast("string").alias("day"), "n")


JOBS_SQL = """
    SELECT job, status, transitions, done, CASE WHEN NOT done THEN coalesce(reply, told) END AS partial, CASE WHEN NOT done THEN message END AS progress, NOT done AND reply IS NOT NULL AS reply_ready, CASE WHEN status = 'error' THEN props END AS error
    FROM (SELECT user_id AS job, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS status, arg_max(props, struct_pack(ts := ts, e := event_id)) AS props, count(*) AS transitions, arg_max(event_type, struct_pack(ts := ts, e := event_id)) IN ('purchase', 'error') AS done,
        arg_max(props, struct_pack(ts := ts, e := event_id)) FILTER (event_type = 'click') AS told, arg_max(props, struct_pack(ts := ts, e := event_id)) FILTER (event_type = 'view') AS message,
        arg_min(props, struct_pack(ts := ts, e := event_id)) FILTER (event_type = 'click' AND event_id % 7 = 0) AS reply FROM events GROUP BY 1)"""


def job_events(spark, d):
    """Events as a job log: clicks bring partial text, of which some are complete replies, views a progress message."""
    kind, props = F.col("event_type"), F.col("props")
    reply = F.when((kind == "click") & (F.col("event_id") % 7 == 0), props).alias("reply")
    return table(spark, d, "events").select(F.col("user_id").alias("job"), kind.alias("status"), "ts", "event_id", F.when(kind == "click", props).alias("partial"), F.when(kind == "view", props).alias("progress"), reply, props.alias("error"))


@query(JOBS_SQL)
def job_state_fold(spark, d):
    return logs.fold_jobs(job_events(spark, d), ["purchase", "error"])


@query(JOBS_SQL)
def streaming_job_states(spark, d):
    from quarry.streaming.jobs import job_states

    return job_states(job_events(spark, d), ["purchase", "error"])


@query(f"WITH j AS ({JOBS_SQL}) SELECT job, CASE WHEN status IN ('view', 'click') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('view', 'click') THEN 'server restarted' ELSE error END AS error FROM j")
def fail_running(spark, d):
    return logs.fail_running(logs.fold_jobs(job_events(spark, d), ["purchase", "error"]), ["view", "click"], "server restarted").select("job", "status", "error")


@query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_parse_tolerant(spark, d):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("Reply: "), F.col("props"), F.lit(" done")))
    return table(spark, d, "events").select("event_id", tx.parse_reply(fenced, "k bigint")["k"].alias("k"))


@query("SELECT doc_id, text[1:200] AS preview FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def longest_first(spark, d):
    return logs.newest(docs(spark, d), {"lang": None}, "n_chars", "doc_id", 50).select("doc_id", F.substring("text", 1, 200).alias("preview"))


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2")
def streaming_daily(spark, d):
    from quarry.streaming.jobs import daily_counts

    return daily_counts(table(spark, d, "events"))
from quarry.plans import structure  # noqa: E402, F401  registers its queries
from quarry.plans import checks  # noqa: E402, F401
from quarry.plans import library  # noqa: E402, F401
from quarry.plans import reports  # noqa: E402, F401
from quarry.plans import output  # noqa: E402, F401
from quarry.plans import search  # noqa: E402, F401
