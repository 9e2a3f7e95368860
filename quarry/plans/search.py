"""Queries of indexed search, passages for topics, attempts and pooled sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import verdicts as vd
from quarry.operators import ann, dataset, evaluation, library, planning, postings, rerank, retrieval
from quarry.plans.catalog import COSINE_SQL, vectors
from quarry.plans.registry import docs, query, table
from quarry.sources import readers, sinks


@query()
def ann_topk(spark, d):
    """Approximate neighbours by a written index; the test measures recall against the exact ones."""
    queries, corpus = vectors(spark, d)
    return ann.search(queries, corpus, k=10, index=ann.Index.build(corpus) if corpus.take(1) else None)


@query(COSINE_SQL.format(where="") + """, b AS (SELECT query_id, label AS page, min(rank) AS best FROM r WHERE rank <= 12 GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, page) AS place FROM b)
    SELECT query_id, page, CAST(place AS INT) AS place, md5(text) AS text_md5 FROM p JOIN documents ON doc_id = page WHERE place <= 2""")
def topic_passages(spark, d):
    """A query's best pages, each by its best hit, with their text; two are kept."""
    queries, corpus = vectors(spark, d)
    labels = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("page"))
    best = dataset.ranked_pages(retrieval.cosine_top_k(queries, corpus, 12).join(labels, "vec_id"), "query_id", "page", 2)
    return best.join(docs(spark, d).select(F.col("doc_id").alias("page"), "text"), "page").select("query_id", "page", "place", F.md5("text").alias("text_md5"))


#: Tokens of replies: the words of each turn, 20 to 149 milliseconds after one another, and a pause of 450 after every ninth.
TOKENS_SQL = """t AS (SELECT conv_id * 1000 + turn AS key, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS n FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations)),
    k AS (SELECT key, pos, length(word) AS size, pos = n - 1 AS last, CAST(1700000000000000 + sum(1000 * (20 + (key * 31 + pos * 17) % 130 + CASE WHEN pos % 9 = 8 THEN 450 ELSE 0 END)) OVER (PARTITION BY key ORDER BY pos) AS BIGINT) AS told_at FROM t)"""


@query(f"""WITH RECURSIVE {TOKENS_SQL}, e AS (SELECT key, 1 AS seq, told_at, last FROM k WHERE pos = 0
    UNION ALL SELECT e.key, e.seq + 1, CASE WHEN min(k.told_at) FILTER (k.last) <= e.told_at + 200000 THEN min(k.told_at) FILTER (k.last) WHEN min(k.told_at) <= e.told_at + 200000 THEN e.told_at + 200000 ELSE min(k.told_at) END,
        coalesce(min(k.told_at) FILTER (k.last) <= greatest(e.told_at + 200000, min(k.told_at)), FALSE) FROM e JOIN k ON k.key = e.key AND k.told_at > e.told_at WHERE NOT e.last GROUP BY e.key, e.seq, e.told_at)
    SELECT e.key, CAST(e.seq AS BIGINT) AS seq, e.told_at, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars, e.last FROM e JOIN k ON k.key = e.key AND k.told_at <= e.told_at GROUP BY e.key, e.seq, e.told_at, e.last""")
def throttled_progress(spark, d):
    """Emissions of replies that come word by word: a fifth of a second apart at least, what waits told when that time is
    over, the whole reply at its last word."""
    from quarry.streaming.replies import emissions

    key = F.col("conv_id") * 1000 + F.col("turn")
    said = table(spark, d, "conversations").select(key.alias("key"), F.filter(F.split("text", " "), lambda x: x != "").alias("w"))
    gap = lambda pos: 1000 * (20 + (F.col("key") * 31 + pos * 17) % 130 + F.when(pos % 9 == 8, 450).otherwise(0))
    words = said.select("key", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    order = Window.partitionBy("key").orderBy("pos")
    at = (F.lit(1_700_000_000_000_000) + F.sum(gap(F.col("pos"))).over(order)).alias("at")
    return emissions(words.select("key", at, F.col("pos").alias("seq_no"), F.length("word").alias("size"), (F.col("pos") == F.col("n") - 1).alias("last"))).withColumnRenamed("at", "told_at")


@query("""WITH k AS (SELECT conv_id + 1000000 * (turn // 20) AS conv_id, turn, role FROM conversations), a AS (SELECT conv_id, string_agg(turn || '', ',' ORDER BY turn) AS trail, count(*) AS n FROM k WHERE role = 'assistant' GROUP BY 1)
    SELECT c.conv_id, coalesce(trail, '') AS trail, coalesce(n, 0) AS attempts FROM (SELECT DISTINCT conv_id FROM k) c LEFT JOIN a USING (conv_id)""")
def attempt_trails(spark, d):
    """Attempts of two lists, either of which may be missing, as one. Twenty turns at most are
    one trail."""
    rows = table(spark, d, "conversations").withColumn("conv_id", F.col("conv_id") + 1000000 * F.floor(F.col("turn") / 20))
    part = lambda cond, name: rows.filter(f"role = 'assistant' and {cond}").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias(name))
    both = rows.select("conv_id").distinct().join(part("turn < 4", "early"), "conv_id", "left").join(part("turn >= 4", "late"), "conv_id", "left")
    trail = dataset.appended(F.col("early"), F.col("late"))
    return both.select("conv_id", F.array_join(F.transform(trail, lambda t: t.cast("string")), ",").alias("trail"), F.size(trail).cast("bigint").alias("attempts"))


@query(r"""WITH p AS (SELECT *, p_partkey // 8 AS set_id FROM part), g AS (SELECT set_id, p_size % 3 AS grp, bool_and(p_retailprice > 905) AS ok FROM p GROUP BY 1, 2), s AS (SELECT set_id, count(DISTINCT lower(trim(trim(regexp_replace(p_type, '[ \t\r\n]+', ' ', 'g')), '.?!,;:'))) = count(*) AS distinct_ FROM p GROUP BY 1)
    SELECT g.set_id, count(*) AS groups, bool_and(ok) AS every_group, any_value(distinct_) AS pooled, bool_and(ok) AND any_value(distinct_) AS accepted FROM g JOIN s USING (set_id) GROUP BY 1""")
def pooled_acceptance(spark, d):
    """A pooled set is accepted if every group was and the pooled points pass their own check."""
    rows = table(spark, d, "part").withColumn("set_id", F.floor(F.col("p_partkey") / 8))
    groups = rows.groupBy("set_id", (F.col("p_size") % 3).alias("grp")).agg(F.bool_and(F.col("p_retailprice") > 905).alias("ok")).groupBy("set_id").agg(F.count(F.lit(1)).alias("groups"), F.bool_and("ok").alias("every_group"))
    pooled = rows.groupBy("set_id").agg((F.size(F.filter(vd.keypoint_faults(F.collect_list("p_type"), 0), lambda f: f == "duplicate key points")) == 0).alias("pooled"))  # eight points
    return groups.join(pooled, "set_id").withColumn("accepted", F.col("every_group") & F.col("pooled"))


@query("SELECT count(*) AS documents, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, (SELECT count(*) FROM conversations) AS turns, (SELECT count(*) FROM labels) AS labels FROM documents")
def overview_file(spark, d):
    """An overview of one row, written as a JSON document and read back."""
    n = F.count(F.lit(1))
    own = docs(spark, d).agg(n.alias("documents"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))
    for name, t in (("turns", "conversations"), ("labels", "labels")):
        own = own.crossJoin(table(spark, d, t).agg(n.alias(name)))  # one row each
    path = sinks.json_lines(own.coalesce(1), sinks.shared_folder(spark, "overview"))
    return readers.json_lines(spark, path, "documents bigint, sources bigint, chars bigint, turns bigint, labels bigint")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS filename, n_chars AS size, CASE WHEN n_chars > 2000 THEN 'Ready' ELSE 'Processing' END AS status FROM documents")
def document_listing(spark, d):
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("filename"), F.col("n_chars").alias("size"), F.when(F.col("n_chars") > 2000, "Ready").otherwise("Processing").alias("status"))


#: Hashed sparse vectors: of several words of a bucket, the first in the text counts.
HASHED_SQL = """WITH t AS (SELECT key, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM ({0})),
    p AS (SELECT key, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t), c AS (SELECT key, word, count(*) AS n, min(pos) AS pos FROM p GROUP BY 1, 2),
    b AS (SELECT key, CAST(CAST(concat('0x', md5(word)) AS UHUGEINT) % 1000000 AS BIGINT) AS bucket, n, pos FROM c)
    SELECT key, bucket, arg_min(n, pos) AS weight FROM b GROUP BY 1, 2"""


@query(f"""WITH v AS ({HASHED_SQL.format('SELECT doc_id AS key, text FROM documents')})
    SELECT doc_id, count(bucket) AS buckets, coalesce(sum(weight), 0)::BIGINT AS weights, md5(coalesce(string_agg(bucket || ':' || weight, ',' ORDER BY bucket), '')) AS vector_md5 FROM documents LEFT JOIN v ON key = doc_id GROUP BY 1""")
def sparse_vectors(spark, d):
    """The sparse part of each document's vector as it is stored beside the dense one."""
    rows = docs(spark, d).select("doc_id", "text")
    told = F.array_join(F.transform(F.arrays_zip("buckets", "weights"), lambda c: F.concat_ws(":", c.buckets.cast("string"), c.weights.cast("string"))), ",")
    sums = F.aggregate("weights", F.lit(0).cast("bigint"), lambda s, w: s + w)
    return postings.rows_of_vectors(rows, "doc_id").select("doc_id", F.size("buckets").cast("bigint").alias("buckets"), sums.alias("weights"), F.md5(told).alias("vector_md5"))


@query(f"""WITH v AS ({HASHED_SQL.format('SELECT doc_id AS key, text FROM documents')}), q AS ({HASHED_SQL.format('SELECT item_id AS key, text FROM benchmark')}),
    s AS (SELECT q.key AS query_id, v.key AS doc_id, CAST(sum(v.weight * q.weight) AS BIGINT) AS score FROM v JOIN q USING (bucket) GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s)
    SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def hashed_sparse_topk(spark, d):
    """Every benchmark item against all documents, by written postings with bounds."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return postings.Postings.build(docs(spark, d).select("doc_id", "text")).top_k(queries, 10)


@query()
def late_interaction_retrieval(spark, d):
    """Candidates of each benchmark item by hashed sparse search, reranked token by token; a test tells both routes by brute force."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = docs(spark, d).select("doc_id", "text")
    found = postings.Postings.build(rows).top_k(asked.select("query_id", F.col("query").alias("text")), DEFAULTS.rerank_candidates)
    near = found.select("query_id", "doc_id", (F.col("score") / F.max("score").over(Window.partitionBy("query_id"))).alias("vector_score"))  # twenty rows a query
    return rerank.reranked(near.join(rows, "doc_id").join(asked, "query_id"), rerank.late_interaction)


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, length(text) AS said FROM documents WHERE doc_id % 10 <> 9), r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id AS row_id, n_chars FROM documents WHERE doc_id % 11 <> 10)
    SELECT coalesce(p.position, r.position) AS position, doc_id, said, row_id, n_chars, doc_id IS NOT NULL AND row_id IS NOT NULL AS matched FROM p FULL JOIN r ON p.position = r.position""")
def zipped_predictions(spark, d):
    """A dump of predictions and the rows they were made for, zipped by position; the longer one's rest is reported."""
    root = sinks.shared_folder(spark, "zipped")
    dump = docs(spark, d).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    dump.filter("doc_id % 10 <> 9").select("doc_id", F.length("text").alias("said")).write.parquet(f"{root}/predictions")
    dump.filter("doc_id % 11 <> 10").select(F.col("doc_id").alias("row_id"), "n_chars").write.parquet(f"{root}/rows")
    both = evaluation.zipped(spark.read.parquet(f"{root}/predictions"), spark.read.parquet(f"{root}/rows"))
    return both.select("position", "prediction.doc_id", "prediction.said", "row.row_id", "row.n_chars", "matched")


def leading_sentences(requests):
    """An extractive generator: the first sentences of each prompt."""
    n = F.col("sentences").cast("int")
    said = F.array_join(F.slice(F.split("text", r"(?<=[.!?])\s+", n + 1), F.lit(1), n), " ")
    return requests.select("key", "run", said.alias("text"))


def notes(spark, d):
    return docs(spark, d).select(F.col("source").alias("key"), F.col("doc_id").alias("place"), "text")


@query()
def folded_summaries(spark, d):
    """Each source's documents, folded by leading sentences until they fit one prompt; a test folds by brute force."""
    return planning.fold(notes(spark, d), leading_sentences).select("key", "rounds", "notes", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


def first_sentences(requests):
    """A generator of items: the first `ask` sentences of a prompt, fewer where it has fewer; prompts with few are not accepted."""
    said = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")
    own = requests.select("key", "group", F.slice(said, F.lit(1), F.col("ask")).alias("items"), (F.size(said) >= F.col("ask")).alias("accepted"))
    return own.select("key", "group", "accepted", F.posexplode_outer("items").alias("place", "text"))


def pooled_by(spark, d, **how):
    items, documents = planning.pooled_items(planning.prose(notes(spark, d)), "mcq", first_sentences, **how)
    return planning.gated(items, documents, lambda rows: rows.filter(F.length("text") < 4).groupBy("key").agg(F.count(F.lit(1)).alias("n")))


@query()
def pooled_totals(spark, d):
    """Thirty items of each source, what one group lacks made up by the next; a test pools by brute force."""
    return pooled_by(spark, d, count=30)


@query()
def pooled_rates(spark, d):
    """Two items for each page of each source, all groups asked at once; a test pools by brute force."""
    return pooled_by(spark, d, per_page=2)


@query(COSINE_SQL.format(where="") + """ SELECT query_id, 'q' || query_id AS query, md5(string_agg(md5(text), ',' ORDER BY rank)) AS contexts_md5, count(*) AS n FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 2 GROUP BY 1""")
def judged_contexts(spark, d):
    """Of the three best documents of each query the two that a judge is shown."""
    hits = retrieval.cosine_top_k(*vectors(spark, d), 3).join(docs(spark, d).select(F.col("doc_id").alias("vec_id"), F.md5("text").alias("text")), "vec_id")
    asked = hits.select("query_id", F.lit("as it was").alias("query"), F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("standalone"), "rank", "text")
    return library.judged_contexts(asked).select("query_id", "query", F.md5(F.array_join("contexts", ",")).alias("contexts_md5"), F.size("contexts").cast("bigint").alias("n"))
