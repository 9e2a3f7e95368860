"""Queries of writers, log appends, upserts and streams: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import logs, splitters
from quarry.plans.registry import docs, query, table
from quarry.plans.reports import SPLIT_SQL, records, split_pairs
from quarry.functions import tasks
from quarry.operators import chunks, library
from quarry.sources import readers, sinks


@query(f"WITH {SPLIT_SQL} SELECT pair_id, subject, doc, unit, split FROM s")
def split_files(spark, d):
    """Every split in JSON lines of its own folder, read back with the split from the folder's name."""
    path = sinks.json_lines(split_pairs(spark, d), sinks.shared_folder(spark, "splits"), by="split")
    return readers.json_lines(spark, path, "pair_id bigint, subject string, doc string, unit string, split string")


@query("SELECT doc_id, lang, NULL AS errors, n_chars FROM documents")
def parse_report_file(spark, d):
    """A report with fixed columns: one the rows lack, one they have too many."""
    path = sinks.csv_report(docs(spark, d), sinks.shared_folder(spark, "report"), ["doc_id", "lang", "errors", "n_chars"])
    return readers.manifest(spark, path, ["doc_id", "errors"]).select(F.col("doc_id").cast("bigint"), "lang", "errors", F.col("n_chars").cast("bigint"))


@query("SELECT event_type AS run, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def registry_file(spark, d):
    """Rows appended to a registry in two runs."""
    path, rows = sinks.shared_folder(spark, "registry"), table(spark, d, "events").select(F.col("event_type").alias("run"), "event_id", "props")
    for run in ("view", "click"):
        sinks.append_csv(rows.filter(F.col("run") == run), path, ["run", "event_id"])
    return readers.manifest(spark, path, ["run"]).groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("event_id").cast("bigint")).alias("ids"))


@query("SELECT source, CAST(sum(CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS BIGINT) AS lines_sum, count(*) AS n FROM documents, unnest(string_split(text, chr(10))) AS u(x) WHERE trim(x) <> '' GROUP BY 1")
def text_files(spark, d):
    """Texts in a folder for each source, read back by lines."""
    rows = docs(spark, d).select("source", "text")
    path = sinks.text_files(rows, sinks.shared_folder(spark, "texts"), "source")
    lines = spark.read.text(path).filter("trim(value) != ''")
    return lines.groupBy("source").agg(F.sum(F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("bigint")).alias("lines_sum"), F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id || '-' || turn AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'test' ELSE 'val' END AS split, 3 AS messages FROM conversations a
    WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)""")
def record_files(spark, d):
    """Chat records in JSON lines, with their nested messages."""
    path = sinks.json_lines(records(spark, d), sinks.shared_folder(spark, "records"))
    rows = readers.json_lines(spark, path, "pair_id string, split string, messages array<struct<role:string,content:string>>")
    return rows.select("pair_id", "split", F.size("messages").alias("messages"))


@query("SELECT event_id, event_type AS stage, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INT) END AS score, round(value / 7, 2) AS elapsed_s, props[1:6] AS error FROM events")
def evaluation_log(spark, d):
    """Attempts appended to the evaluation log in two batches, and read."""
    path, kind = sinks.shared_folder(spark, "evaluations"), F.col("event_type")
    rows = table(spark, d, "events").select("event_id", kind.alias("stage"), F.when(kind != "error", F.floor("value").cast("int")).alias("score"), (F.col("value") / 7).alias("elapsed_s"), F.substring("props", 1, 6).alias("error"))
    for part in (0, 1):
        sinks.append_log(sinks.evaluation_rows(rows.filter(F.col("event_id") % 2 == part)), path)
    return spark.read.parquet(path)


@query("SELECT event_id AS id, CAST(floor(value) AS INT) AS score, 70 AS threshold, CAST(event_id % 3 AS INT) AS n_attempts, props[1:1000] AS source_preview FROM events")
def resource_log(spark, d):
    i, score = F.col("event_id"), F.floor("value").cast("int")
    attempts = F.when(i % 3 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (i % 3).cast("int")))
    rows = table(spark, d, "events").select(i.alias("id"), F.struct(score.alias("score"), F.lit(70).alias("threshold")).alias("verdict"), attempts.alias("attempts"), F.col("props").alias("source"))
    path = sinks.append_log(sinks.resource_rows(rows), sinks.shared_folder(spark, "resources"))
    return spark.read.parquet(path).select("id", "score", "threshold", "n_attempts", "source_preview")


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def turn_log(spark, d):
    """Turns appended conversation by conversation parity, and read."""
    path, rows = sinks.shared_folder(spark, "turns"), table(spark, d, "conversations")
    for part in (0, 1):
        sinks.append_log(rows.filter(F.pmod("conv_id", F.lit(2)) == part), path)
    return spark.read.parquet(path).select("conv_id", "turn", "role", F.length("text").alias("chars"))


@query("""WITH n AS (SELECT sha256(text) AS sha, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT n.doc_id, sha FROM n WHERE sha NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""")
def insert_absent(spark, d):
    """Of the odd documents those whose content none of the even ones has, the first of each content."""
    rows = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))
    return logs.insert_absent(rows.filter("doc_id % 2 = 1"), rows.filter("doc_id % 2 = 0"), "sha", "doc_id").select("doc_id", "sha")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END, 0) AS page, coalesce(CASE WHEN l_partkey % 2 = 0 THEN l_partkey END, 0) AS idx, l_suppkey AS version, l_quantity FROM lineitem)
    SELECT doc_id, page, idx, arg_max(l_quantity, (version, l_quantity)) AS quantity FROM c GROUP BY 1, 2, 3""")
def chunk_upsert(spark, d):
    """Chunks by (document, page, index), missing parts of the key as 0, the latest version."""
    zero = lambda cond, c: F.coalesce(F.when(cond, F.col(c)), F.lit(0))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), zero(F.col("l_linenumber") % 3 != 0, "l_linenumber").alias("page"), zero(F.col("l_partkey") % 2 == 0, "l_partkey").alias("idx"), F.col("l_suppkey").alias("version"), F.col("l_quantity").alias("quantity"))
    return logs.latest_wins(rows, ["doc_id", "page", "idx"], ["version", "quantity"]).select("doc_id", "page", "idx", "quantity")


@query("SELECT count(*) AS left_, count(DISTINCT l_orderkey) AS documents FROM lineitem WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber <= 2)")
def deleted_pages(spark, d):
    """Pages left after a delete by document and page."""
    kept = table(spark, d, "lineitem").filter(~((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") <= 2)))
    return kept.agg(F.count(F.lit(1)).alias("left_"), F.count_distinct("l_orderkey").alias("documents"))


@query("""WITH t AS (SELECT conv_id AS key, turn, text, min(turn) FILTER (turn >= 6) OVER (PARTITION BY conv_id) AS stop FROM conversations)
    SELECT key, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(stop) IS NOT NULL AS done FROM t WHERE stop IS NULL OR turn <= stop GROUP BY 1""")
def streaming_token_texts(spark, d):
    """Replies that come token by token, frozen at their end."""
    from quarry.streaming.replies import token_texts

    started = F.lit(1_700_000_000_000_000)
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), (started + F.col("turn") * 1_000_000).alias("at"), F.col("turn").alias("seq_no"), F.length("text").alias("size"), (F.col("turn") >= 6).alias("last"))
    return token_texts(turns)


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, md5(arg_max(text, turn)) AS last_md5 FROM conversations GROUP BY 1")
def streaming_conversations(spark, d):
    from quarry.streaming.jobs import conversation_state

    made = conversation_state(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return made.select("conv_id", "turns", "last_turn", F.md5("last_text").alias("last_md5"))


@query("""WITH m AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT d.source, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS page, text, n FROM documents d JOIN m USING (source))
    SELECT source, page, md5(text) AS text_md5 FROM p WHERE page <= 8 UNION ALL SELECT source, 9, md5('[TRUNCATED]') FROM m WHERE n > 8""")
def capped_pages(spark, d):
    """The first pages of each source, and a page that says so where there were more."""
    from pyspark.sql import Window as W

    page = F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("bigint")
    return readers.capped(docs(spark, d).select("source", page.alias("page"), "text"), "source", "page", 8).select("source", "page", F.md5("text").alias("text_md5"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'not a PDF' WHEN p_size = 1 THEN 'empty' WHEN p_size > 40 THEN 'too large' WHEN p_partkey % 7 = 0 THEN 'page count' END AS reason FROM part""")
def upload_checks(spark, d):
    i, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(i % 5 == 0, "a.txt").otherwise("A.PDF")
    reason = readers.reject_reason(name, F.when(size == 1, 0).otherwise(size.cast("bigint") * (1 << 18)), F.when(i % 7 == 0, 301).otherwise(3))
    return table(spark, d, "part").select("p_partkey", reason.alias("reason"))


@query("SELECT 'documents.parquet' AS name UNION ALL SELECT 'embeddings.parquet'")
def listed_files(spark, d):
    """The folder's files of one kind, by name, without the skipped ones."""
    return readers.entries(spark, d, skip=("events", "pages"), suffixes=r"(documents|embeddings|events)\.parquet$").select("name").orderBy("name")


@query()
def page_html_chunks(spark, d):
    """Web pages as text, cut into chunks."""
    texts = readers.html_text(table(spark, d, "pages")).select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), "text")
    return splitters.page_chunks(texts).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query(f"WITH {SPLIT_SQL}, u AS (SELECT unit, min(split) AS split FROM s GROUP BY 1) SELECT unit, split, json_object(unit, split)::VARCHAR AS line FROM u")
def assignment_file(spark, d):
    """The assignment of units to splits as a document of its own, read back."""
    units = split_pairs(spark, d).groupBy("unit").agg(F.min("split").alias("split"))
    path = sinks.assignment(units, sinks.shared_folder(spark, "assignment"))
    told = spark.read.text(path).select(F.col("value").alias("line"), F.explode(F.from_json("value", "map<string,string>")).alias("unit", "split"))
    return told.select("unit", "split", "line")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def text_bucket_files(spark, d):
    """Texts in a fixed number of folders, read back."""
    path = sinks.text_buckets(docs(spark, d), sinks.shared_folder(spark, "texts"))
    return readers.json_lines(spark, path, "doc_id bigint, text string").select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT event_id AS pair_id, event_type AS pair_type, props AS prediction, round(value * 10, 1) AS latency_ms, user_id % 2 = 0 AS correct FROM events")
def predictions_dump(spark, d):
    """Predictions with what they were scored at, as JSON lines, read back."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("pair_id"), F.col("event_type").alias("pair_type"), F.col("props").alias("prediction"), F.round(F.col("value") * 10, 1).alias("latency_ms"), (F.col("user_id") % 2 == 0).alias("correct"))
    path = sinks.json_lines(rows, sinks.shared_folder(spark, "predictions"))
    return readers.json_lines(spark, path, "pair_id bigint, pair_type string, prediction string, latency_ms double, correct boolean")


@query("""SELECT user_id AS doc, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'Ready' WHEN 'error' THEN 'Failed' WHEN 'view' THEN 'Processing' ELSE 'Uploaded' END AS status,
        CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN repeat(arg_max(props, (ts, event_id)), 200)[1:1000] END AS error, arg_max(event_id % 90 + 1, (ts, event_id)) FILTER (event_type = 'purchase') AS n_pages,
        arg_max(event_id % 700, (ts, event_id)) FILTER (event_type = 'purchase') AS n_chunks, arg_max('model-' || event_id % 3, (ts, event_id)) FILTER (event_type = 'purchase') AS embedding_model, max(ts) FILTER (event_type = 'purchase') AS ingested_at FROM events GROUP BY 1""")
def document_status(spark, d):
    """Events as a log of a document's life: status, error cut at 1000 characters, and what its last ingestion stamped."""
    kind, i = F.col("event_type"), F.col("event_id")
    done = kind == "purchase"
    status = F.when(kind == "error", "Failed").when(kind == "view", "Processing").otherwise("Uploaded")
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("doc"), "ts", "event_id", status.alias("status"), F.when(kind == "error", F.repeat("props", 200)).alias("error"), F.when(done, i % 90 + 1).alias("n_pages"), F.when(done, i % 700).alias("n_chunks"), F.when(done, F.concat(F.lit("model-"), (i % 3).cast("string"))).alias("embedding_model"),
    )
    return library.document_states(rows)


@query(f"""WITH a AS (SELECT doc_id AS key, length(text) AS n, 0 AS origin FROM documents), b AS (SELECT conv_id * 1000 + turn AS key, length(text) AS n, 1 AS origin FROM conversations),
    c AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT origin, sum(CASE WHEN n = 0 THEN 0 WHEN n <= 1000 THEN 1 ELSE CAST(ceil((n - 1000) / 850.0) AS BIGINT) + 1 END)::BIGINT AS chunks, count(*) FILTER (n > 0) AS texts FROM c GROUP BY 1""")
def united_chunks(spark, d):
    """Chunks of documents and of conversations as one table."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    both = chunks.united(chunks.sliding(docs(spark, d)), chunks.sliding(turns))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("texts"))


@query(r"""SELECT p_partkey // 10 AS set_id, md5(string_agg(rn || '. ' || p_name || chr(10) || 'A) ' || p_type || chr(10) || 'B) ' || p_name || chr(10) || 'C) ' || p_brand || chr(10) || 'D) ' || p_size || chr(10) || 'Answer: ' || p_type, chr(10) || chr(10) ORDER BY rn)) AS text_md5, '' AS faults
    FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS rn FROM part) GROUP BY 1""")
def task_contract(spark, d):
    """Replies with question envelopes, unwrapped, checked and rendered by their task."""
    item = F.struct(F.col("p_name").alias("question"), F.array(F.col("p_type"), F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")).alias("options"), F.col("p_type").alias("answer"))
    sets = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("set_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))), lambda x: x.i).alias("questions"))  # ten items
    made = tasks.handled(sets.select("set_id", F.to_json(F.struct("questions")).alias("reply")), "mcq", ("set_id",))
    return made.select("set_id", F.md5("text").alias("text_md5"), F.array_join("faults", ";").alias("faults"))
