"""Queries of documents, links, sessions, turns, resources and jobs. Customers stand for documents, orders for links."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import render as rd
from quarry.operators import chunks, library, logs, retrieval
from quarry.plans.catalog import CHUNKS_SQL, COSINE_SQL, vectors
from quarry.plans.registry import docs, query, table

DOCUMENTS_SQL = "(SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS filename, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS INT) END AS n_chunks, c_nationkey AS n_pages, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS model, CASE WHEN c_custkey % 5 = 0 THEN 'Processing' ELSE 'Ready' END AS status FROM customer)"
LINKS_SQL = "(SELECT o_custkey AS doc_id, o_orderkey % 10 AS user_id, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, o_orderkey) AS filename, arg_max(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END, o_orderkey) FILTER (o_orderkey % 4 <> 0) AS subject FROM orders GROUP BY 1, 2)"


def documents(spark, d):
    i, c = F.col("c_custkey"), F.col
    rows = table(spark, d, "customer")
    return rows.select(
        i.alias("doc_id"), F.when(i % 9 == 0, "").otherwise(c("c_name")).alias("filename"), F.when(i % 4 != 0, i.cast("int")).alias("n_chunks"), c("c_nationkey").alias("n_pages"),
        F.when(i % 6 != 0, c("c_mktsegment")).alias("model"), F.when(i % 5 == 0, "Processing").otherwise("Ready").alias("status"),
        F.timestamp_seconds(F.lit(1_700_000_000) + i * 3600).alias("uploaded_at"),
    )


def links(spark, d):
    """One link for each user and document, the latest; its subject is the last one known."""
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (i % 10).alias("user_id"), i.alias("at"), F.when(i % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("filename"), F.when(i % 4 != 0, F.col("o_orderstatus")).alias("subject"))
    return logs.keep_known(rows, ["doc_id", "user_id"], ["at"], ["filename", "subject"])


@query(f"""SELECT d.doc_id, coalesce(nullif(l.filename, ''), d.filename, '') AS filename, coalesce(subject, 'General') AS subject, strftime(make_timestamp((1700000000 + d.doc_id * 3600) * 1000000), '%Y-%m-%dT%H:%M:%S') AS upload_date,
    n_pages AS page_count, coalesce(n_chunks, 0) AS chunk_count FROM {DOCUMENTS_SQL} d LEFT JOIN (SELECT * FROM {LINKS_SQL} WHERE user_id = 3) l ON l.doc_id = d.doc_id""")
def document_views(spark, d):
    """All documents as one user sees them."""
    return library.document_view(documents(spark, d), links(spark, d).filter("user_id = 3"))


@query(f"SELECT doc_id, filename FROM {DOCUMENTS_SQL} WHERE status = 'Ready' AND doc_id IN (SELECT doc_id FROM {LINKS_SQL} WHERE user_id = 3)")
def accessible_documents(spark, d):
    return library.accessible(documents(spark, d), links(spark, d), 3).select("doc_id", "filename")


@query(f"""SELECT user_id, count(*) AS links, count(DISTINCT doc_id) AS documents, count(*) FILTER (subject IS NULL) AS unfiled FROM {LINKS_SQL} GROUP BY 1""")
def link_counts(spark, d):
    return links(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("subject").isNull()).alias("unfiled"))


@query(f"""WITH s AS (SELECT * FROM {DOCUMENTS_SQL} WHERE status = 'Ready' AND model IS NOT NULL AND model <> 'BUILDING')
    SELECT (SELECT array_to_string(list_sort(list(DISTINCT model)), ',') FROM s) AS models, (SELECT count(*) FROM s) AS n, (SELECT string_agg(filename, ',' ORDER BY doc_id DESC) FROM (SELECT * FROM s ORDER BY doc_id DESC LIMIT 5)) AS filenames""")
def stale_models(spark, d):
    """Models other than the current one, and the newest files that have them."""
    return library.stale_models(documents(spark, d).withColumnRenamed("uploaded_at", "ingested_at"), "BUILDING")


@query(f"SELECT doc_id, model FROM {DOCUMENTS_SQL} WHERE status = 'Ready' AND model IS NOT NULL AND model <> 'BUILDING'")
def stale_documents(spark, d):
    return library.stale(documents(spark, d), "BUILDING").select("doc_id", "model")


REFERENCES = ["12", "Customer#000000007", "customer#00000014", "0001", "#", "", "no such file"]


@query(f"""WITH r AS (SELECT unnest([{', '.join(f"'{x}'" for x in REFERENCES)}]) AS reference),
    m AS (SELECT reference, doc_id, CASE WHEN CAST(doc_id AS VARCHAR) = reference THEN 0 WHEN filename = reference THEN 1 ELSE 2 END AS tier FROM r, {DOCUMENTS_SQL} WHERE CAST(doc_id AS VARCHAR) = reference OR filename = reference OR (reference <> '' AND contains(lower(filename), lower(reference)))),
    e AS (SELECT reference, tier, min(doc_id) AS doc_id, count(*) AS n FROM m GROUP BY 1, 2), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY reference ORDER BY tier) = 1)
    SELECT reference, CASE WHEN tier < 2 OR n = 1 THEN doc_id END AS doc_id, tier, coalesce(least(n, 5), 0) AS matches FROM r LEFT JOIN b USING (reference)""")
def resolved_references(spark, d):
    return library.resolved(documents(spark, d), REFERENCES)


@query("""WITH q AS (SELECT o_orderkey AS request_id, o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END AS first, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 6 END AS last FROM orders),
    b AS (SELECT *, first IS NULL AND last IS NULL AS every, greatest(1, coalesce(nullif(first, 0), 1)) AS low FROM q)
    SELECT request_id, l_linenumber AS page_number FROM b JOIN lineitem ON l_orderkey = doc_id WHERE every OR l_linenumber BETWEEN low AND greatest(low, coalesce(nullif(last, 0), low))""")
def page_ranges(spark, d):
    i = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(i.alias("request_id"), i.alias("doc_id"), F.when(i % 3 != 0, i % 4).alias("first"), F.when(i % 3 == 2, i % 6).alias("last"))
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"))
    return library.page_requests(pages, asked).select("request_id", "page_number")


@query("SELECT DISTINCT user_id AS c_custkey, c_name, c_custkey IS NOT NULL AS found FROM events LEFT JOIN customer ON c_custkey = user_id + 100")
def looked_up_names(spark, d):
    """Every user of the log once, with a name where there is one."""
    asked = table(spark, d, "events").select((F.col("user_id") + 100).alias("c_custkey"))
    found = library.looked_up(asked, table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    return found.withColumn("c_custkey", F.col("c_custkey") - 100)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def multi_get(spark, d):
    return library.multi_get(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS page_number, l_partkey AS chunk_index FROM lineitem)
    SELECT doc_id, coalesce(page_number, 0) AS page, chunk_index, CAST(row_number() OVER w AS INT) AS place FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY coalesce(page_number, 0), coalesce(chunk_index, 0)) QUALIFY row_number() OVER w <= 4""")
def reading_order(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("page_number"), F.col("l_partkey").alias("chunk_index"))
    return library.reading_order(rows, 4).select("doc_id", F.coalesce("page_number", F.lit(0)).alias("page"), "chunk_index", "place")


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT doc_id, md5(substr(string_agg(chunk, chr(10) || chr(10) ORDER BY chunk_index), 1, 15000)) AS text_md5 FROM c GROUP BY 1")
def document_texts(spark, d):
    made = chunks.sliding(docs(spark, d)).withColumn("page_number", F.lit(1))
    return library.document_text(made).select("doc_id", F.md5("text").alias("text_md5"))


RESOURCE_SQL = "(SELECT event_id AS id, user_id AS doc_id, event_type AS task, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS INT) END AS score, range(event_id % 3) AS attempts, CASE WHEN event_id % 2 = 0 THEN 7 END AS n_attempts, props, ts FROM events)"


def resources(spark, d):
    i, c = F.col("event_id"), F.col
    score = F.when(i % 5 != 0, F.floor("value").cast("int"))
    attempts = F.when(i % 3 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (i % 3).cast("int")))
    verdict = F.when(score.isNotNull(), F.struct(score.alias("score"), F.lit(70).alias("threshold"), c("props").alias("reasoning")))
    return table(spark, d, "events").select(
        i.alias("id"), c("user_id").alias("doc_id"), c("event_type").alias("task"), score.alias("score"), (score >= 70).alias("accepted"), F.lit(None).cast("int").alias("threshold"), verdict.alias("verdict"),
        attempts.alias("attempts"), F.when(i % 2 == 0, 7).alias("n_attempts"), c("ts").alias("created_at"), F.concat("event_type", F.lit(" "), "props").alias("source"),
    )


@query(f"""SELECT id, doc_id, task AS resource_type, coalesce(score >= 70, FALSE) AS accepted, score, 70 AS threshold, coalesce(n_attempts, len(attempts)) AS n_attempts, CASE WHEN score IS NOT NULL THEN props END AS reasoning,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM {RESOURCE_SQL}""")
def resource_views(spark, d):
    return library.resource_view(resources(spark, d))


@query(f"SELECT id, coalesce(n_attempts, len(attempts)) AS n_attempts, score AS verdict_score, len(attempts) AS trail, task || ' ' || props AS source_preview FROM {RESOURCE_SQL}")
def resource_details(spark, d):
    made = library.resource_detail(resources(spark, d))
    return made.select("id", "n_attempts", F.col("verdict.score").alias("verdict_score"), F.size("attempts").alias("trail"), "source_preview")


@query(f"SELECT id, task FROM {RESOURCE_SQL} WHERE task = 'purchase' AND score >= 70 ORDER BY ts DESC, id LIMIT 25")
def newest_resources(spark, d):
    """Accepted resources of one task, the newest 25."""
    return logs.newest(resources(spark, d), {"task": "purchase", "accepted": True, "doc_id": None}, "created_at", "id", 25).select("id", "task")


@query("SELECT event_id, c_name AS filename FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 5) LEFT JOIN customer ON c_custkey = user_id")
def recent_with_names(spark, d):
    """The five newest resources with their document's name, if it is there."""
    newest = logs.newest(table(spark, d, "events"), {}, "ts", "event_id", 5)
    return newest.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"), "left").select("event_id", F.col("c_name").alias("filename"))


@query("SELECT arg_max(event_id, (ts, event_id)) AS event_id, CAST(max(ts) AS VARCHAR)[1:19] AS ts FROM events")
def most_recent(spark, d):
    made = table(spark, d, "events").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return made.select(F.col("m.event_id").alias("event_id"), F.date_format("m.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def sessions(spark, d):
    i = F.col("conv_id")
    kinds = F.when(i % 3 == 0, F.array(F.lit("summary"), F.lit("chat"))).when(i % 3 == 1, F.array(F.lit("mcq"), F.lit("mcq")))
    first = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select(i.alias("session_id"), (i % 7).alias("doc_id"), F.when(i % 5 != 0, F.concat(F.lit("file-"), i.cast("string"))).alias("filename"), F.when(i % 2 == 0, F.substring("t", 1, 20)).alias("title"), kinds.alias("kinds"), F.timestamp_seconds(i * 60).alias("bound_at"), F.md5("t").alias("digest"))


@query("""WITH f AS (SELECT conv_id, arg_min(text, turn) AS t, count(*) AS n FROM conversations GROUP BY 1)
    SELECT conv_id AS session_id, conv_id % 7 AS doc_id, CASE WHEN conv_id % 5 <> 0 THEN 'file-' || conv_id END AS filename, coalesce(nullif(CASE WHEN conv_id % 2 = 0 THEN t[1:20] END, ''), CASE WHEN conv_id % 5 <> 0 THEN 'file-' || conv_id END) AS title,
        CASE conv_id % 3 WHEN 0 THEN 'chat,summary' WHEN 1 THEN 'mcq' ELSE '' END AS kinds, strftime(make_timestamp(conv_id * 60000000), '%Y-%m-%dT%H:%M:%S') AS created_at, n AS message_count, conv_id % 3 <> 1 AS may_chat FROM f""")
def session_views(spark, d):
    rows = sessions(spark, d)
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"))
    may = rows.select("session_id", library.kind_allowed(F.col("kinds"), F.lit("chat")).alias("may_chat"))
    return library.session_view(rows, turns).withColumn("kinds", F.array_join("kinds", ",")).join(may, "session_id")


@query("""WITH f AS (SELECT conv_id AS session_id, md5(arg_min(text, turn)) AS digest FROM conversations GROUP BY 1)
    SELECT u.session_id, b.digest IS NULL OR b.digest = u.digest AS free FROM f u LEFT JOIN (SELECT session_id + 1 AS session_id, digest FROM f WHERE session_id % 3 = 0 UNION ALL SELECT session_id, digest FROM f WHERE session_id % 3 = 0) b USING (session_id)""")
def free_sessions(spark, d):
    own = sessions(spark, d).select("session_id", "digest")
    third = own.filter("session_id % 3 = 0")
    return library.free_sessions(own, third.withColumn("session_id", F.col("session_id") + 1).unionByName(third)).select("session_id", "free")


@query("""SELECT conv_id AS session_id, turn, role, coalesce(text, '') AS content, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'pdf' ELSE 'general' END END AS mode, CASE WHEN role = 'assistant' THEN CAST(length(text) % 100 AS INT) END AS score,
    CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN conv_id || ',' || turn ELSE '' END AS pages FROM conversations""")
def turn_views(spark, d):
    c = F.col
    pages = F.when(c("turn") % 4 == 1, F.array("conv_id", "turn"))
    meta = F.when(c("role") == "assistant", F.struct(F.when(c("turn") % 4 == 1, "pdf").otherwise("general").alias("mode"), (F.length("text") % 100).alias("score"), F.lit(True).alias("accepted"), F.lit(1).alias("attempts"), pages.alias("pages")))
    rows = table(spark, d, "conversations").select(c("conv_id").alias("session_id"), "turn", "role", c("text").alias("content"), meta.alias("meta"))
    return library.turn_view(rows).select("session_id", "turn", "role", "content", "mode", "score", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations QUALIFY r <= 4)
    SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place, CASE role WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'user' END AS role, text AS content FROM r""")
def prompt_history(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    return library.prompt_history(rows, 2)


@query("SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'queued' END AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at, CASE WHEN event_id % 2 = 0 THEN strftime(ts + INTERVAL 5 SECOND, '%Y-%m-%dT%H:%M:%S') END AS started_at, NULL AS finished_at FROM events")
def job_views(spark, d):
    c, done = F.col, F.col("event_id") % 2 == 0
    jobs = table(spark, d, "events").select(c("event_id").alias("id"), c("event_type").alias("kind"), F.when(done, "done").otherwise("queued").alias("status"), c("ts").alias("created_at"), F.when(done, c("ts") + F.expr("INTERVAL 5 SECOND")).alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), c("props").alias("params"), c("value").alias("result"))
    return library.job_view(jobs, minimal=True)


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND CAST(json_extract(props, '$.k') AS BIGINT) = 3")
def pending_jobs(spark, d):
    """Jobs under way whose parameters name one document."""
    live = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    return live.filter(F.from_json("props", "k bigint")["k"] == 3).select("event_id")


@query(COSINE_SQL.format(where="") + " SELECT query_id, string_agg(vec_id || ':' || score::DECIMAL(9,6) || ':' || text[1:10], '|' ORDER BY rank) AS contexts FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 5 GROUP BY 1")
def contexts_with_scores(spark, d):
    queries, corpus = vectors(spark, d)
    hits = retrieval.cosine_top_k(queries, corpus, 5).withColumnRenamed("vec_id", "page")
    made = library.with_contexts(hits, docs(spark, d).select(F.col("doc_id").alias("page"), "text"))
    shown = F.transform("contexts", lambda c: F.concat_ws(":", c.page.cast("string"), c.score.cast("decimal(9,6)").cast("string"), F.substring(c.text, 1, 10)))
    return made.select("query_id", F.array_join(shown, "|").alias("contexts"))


@query("SELECT l_orderkey, count(*) AS questions, CAST(sum(CAST(l_quantity > 25 AS INT)) AS BIGINT) AS points, CAST(round(100.0 * sum(CAST(l_quantity > 25 AS INT)) / count(*)) AS INT) AS percent FROM lineitem GROUP BY 1")
def quiz_scores(spark, d):
    right = F.count_if(F.col("l_quantity") > 25)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("questions"), right.alias("points"), F.round(F.lit(100.0) * right / F.count(F.lit(1))).cast("int").alias("percent"))


@query("WITH m AS (SELECT max(CAST(ts AS DATE)) AS last FROM events) SELECT count(*) FILTER (CAST(ts AS DATE) > last - 7) AS week, count(*) FILTER (event_type = 'purchase') AS ready FROM events, m")
def week_total(spark, d):
    week = logs.daily(table(spark, d, "events"), "ts", 7).agg(F.sum("n").alias("week"))
    ready = table(spark, d, "events").agg(F.count_if(F.col("event_type") == "purchase").alias("ready"))
    return week.crossJoin(ready)  # one row each


@query("SELECT event_type AS stage, count(*) AS n FROM events WHERE user_id = 3 GROUP BY 1 ORDER BY n DESC, stage LIMIT 3")
def frequent_stages(spark, d):
    return table(spark, d, "events").filter("user_id = 3").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stage").limit(3)


@query("SELECT event_id, ((date_diff('microsecond', CAST('2024-01-01' AS TIMESTAMP), ts) + 5000) // 10000) / 100.0 AS seconds FROM events")
def elapsed(spark, d):
    return table(spark, d, "events").select("event_id", rd.elapsed_seconds(F.lit("2024-01-01").cast("timestamp"), F.col("ts")).alias("seconds"))
