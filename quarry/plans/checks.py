"""Queries of item checks, verdicts, gates, prompts and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import render as rd
from quarry.functions import text as tx
from quarry.functions import verdicts as vd
from quarry.plans.registry import docs, query, table

NORM = "lower(trim(trim(regexp_replace(coalesce({0}, ''), '[ \\t\\r\\n]+', ' ', 'g')), '.?!,;:'))"

OPTIONS_SQL = """CASE p_partkey % 7 WHEN 0 THEN [p_name, p_type, p_brand] WHEN 1 THEN [p_name, ' ', p_type, p_brand] WHEN 2 THEN [p_name, p_name || '.', p_type, p_brand]
    WHEN 3 THEN [p_name, p_type, p_brand, 'None of these'] WHEN 4 THEN [p_name, p_type, p_brand, 'Both of the following hold'] ELSE [p_name, p_type, p_brand, CAST(p_size AS VARCHAR)] END"""


@query(f"""
    WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END AS question, {OPTIONS_SQL} AS options, CASE WHEN p_partkey % 5 = 0 THEN 'missing' ELSE p_type END AS answer FROM part),
    k AS (SELECT *, list_transform(options, lambda x: {NORM.format('x')}) AS ks FROM i)
    SELECT p_partkey, CASE WHEN len(ks) <> 4 THEN concat_ws(';', CASE WHEN trim(question) = '' THEN 'empty question' END, len(ks) || ' options') ELSE concat_ws(';', CASE WHEN trim(question) = '' THEN 'empty question' END,
        CASE WHEN list_contains(ks, '') THEN 'blank option' END, CASE WHEN len(list_distinct(ks)) < 4 THEN 'duplicate options' END, CASE WHEN NOT list_contains(ks, {NORM.format('answer')}) THEN 'answer not an option' END,
        CASE WHEN len(list_filter(options, lambda x: regexp_matches(x, '(?i)\\b(all|none|both)\\s+of\\s+the\\s+(above|these|following)\\b'))) > 0 THEN 'option about the others' END) END AS faults FROM k""")  # fmt: skip
def item_faults(spark, d):
    i, c = F.col("p_partkey"), F.col
    options = (
        F.when(i % 7 == 0, F.array("p_name", "p_type", "p_brand")).when(i % 7 == 1, F.array(c("p_name"), F.lit(" "), c("p_type"), c("p_brand")))
        .when(i % 7 == 2, F.array(c("p_name"), F.concat("p_name", F.lit(".")), c("p_type"), c("p_brand"))).when(i % 7 == 3, F.array(c("p_name"), c("p_type"), c("p_brand"), F.lit("None of these")))
        .when(i % 7 == 4, F.array(c("p_name"), c("p_type"), c("p_brand"), F.lit("Both of the following hold"))).otherwise(F.array(c("p_name"), c("p_type"), c("p_brand"), c("p_size").cast("string")))
    )
    question, answer = F.when(i % 11 == 0, "  ").otherwise(c("p_name")), F.when(i % 5 == 0, "missing").otherwise(c("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(vd.mcq_faults(question, options, answer), ";").alias("faults"))


PAIRS_SQL = f"WITH t AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS a FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'), s AS (SELECT conv_id + 1000000 * (turn // 20) AS conv_id, list(struct_pack(q := q, a := CASE WHEN turn % 3 = 0 THEN q || '.' WHEN turn % 5 = 0 THEN ' ' ELSE a END) ORDER BY turn) AS items FROM t GROUP BY 1)"


@query(PAIRS_SQL + f""",
    f AS (SELECT conv_id, CASE conv_id % 4
        WHEN 0 THEN list_filter(flatten(list_transform(items, lambda x: [CASE WHEN trim(coalesce(x.q, '')) = '' THEN 'empty question' END, CASE WHEN trim(coalesce(x.a, '')) = '' THEN 'question ' || trim(x.q)[1:40] || ' has an empty answer'
            WHEN {NORM.format('x.a')} = {NORM.format('x.q')} THEN 'question ' || trim(x.q)[1:40] || ' is restated by its answer' END])), lambda x: x IS NOT NULL)
        WHEN 1 THEN list_filter([CASE WHEN len(items) < 2 THEN 'only ' || len(items) || ' key point(s)' END, CASE WHEN len(list_filter(items, lambda x: trim(coalesce(x.a, '')) = '')) > 0 THEN 'empty key point' END,
            CASE WHEN len(list_distinct(list_transform(items, lambda x: {NORM.format('x.a')}))) < len(items) THEN 'duplicate key points' END], lambda x: x IS NOT NULL)
        WHEN 2 THEN list_filter([CASE WHEN length(trim(coalesce(items[1].a, ''))) = 0 THEN 'empty summary' WHEN length(trim(coalesce(items[1].a, ''))) < 80 THEN 'only ' || length(trim(coalesce(items[1].a, ''))) || ' characters' END], lambda x: x IS NOT NULL)
        ELSE [] END AS faults FROM s)
    SELECT conv_id, array_to_string(faults, ';') AS faults, CASE WHEN conv_id % 13 = 0 THEN 'parse' WHEN len(faults) > 0 THEN 'validator' WHEN conv_id % 2 = 1 THEN 'skipped' ELSE 'judge' END AS stage,
        CASE conv_id % 4 WHEN 0 THEN 'practice_qsn' WHEN 1 THEN 'keypoints' WHEN 2 THEN 'summary' WHEN 3 THEN CASE WHEN conv_id % 8 = 3 THEN 'chat_grounded' ELSE 'chat_general' END END AS rubric FROM f""")  # fmt: skip
def resource_checks(spark, d):
    """Structural faults by task, the gate that decides, and the rubric of the judge; twenty turns make a set."""
    turns = table(spark, d, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    c = F.col
    both = turns.filter("role = 'user'").join(later, ["conv_id", "turn"], "left")
    answer = F.when(c("turn") % 3 == 0, F.concat("text", F.lit("."))).when(c("turn") % 5 == 0, " ").otherwise(c("a"))
    items = both.groupBy((c("conv_id") + 1000000 * F.floor(c("turn") / 20)).alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct("turn", c("text").alias("question"), answer.alias("answer")))).alias("items"))
    task = F.get(F.array(*map(F.lit, ["practice_qsn", "keypoints", "summary", "chat_msg"])), (c("conv_id") % 4).cast("int"))
    content = F.struct(c("items").alias("items"), F.transform("items", lambda x: x.answer).alias("points"), F.get("items", 0)["answer"].alias("text"))
    made = items.select("conv_id", task.alias("task"), vd.task_faults(task, content).alias("faults"))
    stage = vd.stage(c("conv_id") % 13 == 0, c("faults"), c("conv_id") % 2 == 0)
    return made.select("conv_id", F.array_join("faults", ";").alias("faults"), stage.alias("stage"), vd.rubric(c("task"), c("conv_id") % 8 == 3).alias("rubric"))


REPLY_SQL = """CASE event_id % 6 WHEN 0 THEN '{"score": ' || value || ', "reasoning": " because ' || event_type || ' ", "regeneration_instruction": "Rewrite..."}'
    WHEN 1 THEN 'Verdict: {"score": "' || value || '", "reasoning": "", "regeneration_instruction": "Name the section that the answer cites."} end' WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'no json at all'
    WHEN 4 THEN '{"score": "high", "reasoning": "weak"}' ELSE '```json' || chr(10) || '{"score": -3, "reasoning": "x", "regeneration_instruction": "Fix"}' || chr(10) || '```' END"""


@query(f"""
    WITH e AS (SELECT event_id, event_type, value, {REPLY_SQL} AS reply, CASE event_type WHEN 'view' THEN 'General' WHEN 'click' THEN NULL ELSE 'pdf' END AS mode, CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'a reply' END AS said FROM events),
    v AS (SELECT *, CASE event_id % 6 WHEN 0 THEN greatest(1, least(100, CAST(trunc(value) AS INT))) WHEN 1 THEN greatest(1, least(100, CAST(trunc(value) AS INT))) ELSE 1 END AS score,
        CASE event_id % 6 WHEN 0 THEN 'because ' || event_type WHEN 1 THEN '' WHEN 4 THEN 'weak' WHEN 5 THEN 'x' ELSE 'Could not parse evaluator output: ' || reply END AS reasoning,
        CASE event_id % 6 WHEN 0 THEN 'Fix exactly this problem and change nothing else: because ' || event_type WHEN 1 THEN 'Name the section that the answer cites.' WHEN 4 THEN 'Fix exactly this problem and change nothing else: weak'
            WHEN 5 THEN 'Fix exactly this problem and change nothing else: x' ELSE 'Regenerate the content; the evaluator returned an unreadable verdict.' END AS instruction FROM e)
    SELECT event_id, CASE WHEN mode = 'General' AND trim(said) <> '' THEN NULL WHEN trim(said) = '' THEN 1 ELSE score END AS score, CASE WHEN mode = 'General' AND trim(said) <> '' THEN TRUE WHEN trim(said) = '' THEN FALSE ELSE score >= 70 END AS passed,
        coalesce(mode = 'General', FALSE) AND trim(said) <> '' AS gated, CASE WHEN mode = 'General' AND trim(said) <> '' THEN 'Not scored: answered from general knowledge (mode=general)' WHEN trim(said) = '' THEN 'empty reply' ELSE reasoning END AS reasoning,
        CASE WHEN mode = 'General' AND trim(said) <> '' THEN '' WHEN trim(said) = '' THEN 'Write a reply.' WHEN score >= 70 THEN '' ELSE instruction END AS instruction FROM v""")  # fmt: skip
def verdicts(spark, d):
    """Judges' replies read as verdicts, some turns gated, some failed unasked."""
    i, text, c = F.col("event_id"), lambda x: F.col(x).cast("string"), F.col
    reply = (
        F.when(i % 6 == 0, F.concat(F.lit('{"score": '), text("value"), F.lit(', "reasoning": " because '), "event_type", F.lit(' ", "regeneration_instruction": "Rewrite..."}')))
        .when(i % 6 == 1, F.concat(F.lit('Verdict: {"score": "'), text("value"), F.lit('", "reasoning": "", "regeneration_instruction": "Name the section that the answer cites."} end')))
        .when(i % 6 == 2, "[1, 2]").when(i % 6 == 3, "no json at all").when(i % 6 == 4, '{"score": "high", "reasoning": "weak"}')
        .otherwise('```json\n{"score": -3, "reasoning": "x", "regeneration_instruction": "Fix"}\n```')
    )
    mode = F.when(c("event_type") == "view", "General").when(c("event_type") == "click", None).otherwise("pdf")
    v = vd.judged(F.lit("chat_msg"), mode, F.when(i % 10 == 0, " ").otherwise("a reply"), reply, F.lit(70))
    return table(spark, d, "events").withColumn("v", v).select("event_id", "v.score", "v.passed", "v.gated", "v.reasoning", c("v.regeneration_instruction").alias("instruction"))


@query("""SELECT o_orderkey, lower(trim(o_orderstatus || '@Shop.ORG ')) AS email, coalesce(nullif(trim(regexp_replace(o_orderpriority || '/"x".pdf', '[^A-Za-z0-9._ -]', '_', 'g')), ''), 'document.pdf')[1:12] AS filename,
    CASE o_orderkey % 5 WHEN 0 THEN 'mcq' WHEN 1 THEN 'keypoints' WHEN 2 THEN 'summary' WHEN 3 THEN NULL ELSE 'practice_qsn' END AS task, CASE o_orderkey % 2 WHEN 0 THEN 'Working ' || o_orderpriority ELSE 'Done' END AS progress,
    CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'query: x' END AS prefixed, CASE o_orderkey % 4 WHEN 0 THEN 'assistant' WHEN 1 THEN 'user' WHEN 2 THEN 'system' ELSE 'user' END AS role,
    CASE o_orderkey % 3 WHEN 0 THEN 'chat and summary' WHEN 1 THEN 'mcq' ELSE '' END AS kinds, CASE WHEN o_orderkey % 2 = 0 THEN 'Your previous attempt was rejected.' || chr(10) || 'Problem: ' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'Previous attempt:' || chr(10) || 'old' ELSE '' END ELSE '' END AS revision,
    CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 24, '0') END AS object_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at FROM orders""")  # fmt: skip
def small_texts(spark, d):
    i, c = F.col("o_orderkey"), F.col
    pick = lambda n, *values: F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (i % n).cast("int"))
    kinds = F.when(i % 3 == 0, F.array(F.lit("summary"), F.lit("chat"), F.lit("chat"), F.lit("dance"))).when(i % 3 == 1, F.array(F.lit("mcq")))
    number = i.cast("string")
    return table(spark, d, "orders").select(
        i, rd.email_key(F.concat(F.lit("  "), "o_orderstatus", F.lit("@Shop.ORG "))).alias("email"), rd.safe_filename(F.concat("o_orderpriority", F.lit('/"x".pdf')), 12).alias("filename"),
        rd.task_name(pick(5, " MCQs", "Key Points", "summary", "song", "practice")).alias("task"),
        rd.progress_text(F.when(i % 2 == 0, F.concat(F.lit("[*] Working "), "o_orderpriority", F.lit(" (attempt 1/2)"))).otherwise("[+] Done")).alias("progress"),
        rd.prefixed(F.when(i % 3 == 0, "").otherwise("query:  "), F.when(i % 3 == 0, "x").otherwise("  x")).alias("prefixed"),
        rd.message_role(pick(4, "ai", "human", "system", "tool")).alias("role"), rd.kinds_sentence(rd.kinds_of(kinds)).alias("kinds"),
        rd.revision_block(F.when(i % 2 == 0, c("o_orderpriority")), F.when(i % 3 == 0, "old")).alias("revision"),
        rd.object_id(F.when(i % 2 == 0, F.lpad(number, 24, "0")).otherwise(number)).alias("object_id"), rd.iso(c("o_orderdate")).alias("created_at"),
    )


@query()
def point_ids(spark, d):
    """Name-based ids of chunks; DuckDB has no version 5 UUIDs, the test compares with the standard library."""
    return docs(spark, d).select("doc_id", rd.point_id(F.col("doc_id"), F.lit(1), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 10)).alias("point_id"))


@query("""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN 'The excerpt states no section number.' WHEN 1 THEN 'The excerpt continues section ' || doc_id % 9 || '.' ELSE 'The excerpt is section ' || doc_id % 9 || '.' END || chr(10) || '---SOURCE EXCERPT---' || chr(10)
        || CASE WHEN length(text) > 6000 THEN text[1:6000] || chr(10) || '[excerpt cut]' ELSE text END) AS prompt_md5, md5(regexp_replace(CASE WHEN length(text) > 6000 THEN text[1:6000] || chr(10) || '[excerpt cut]' ELSE text END, '^\\s+|\\s+$', '', 'g')) AS source_md5 FROM documents""")  # fmt: skip
def excerpt_prompts(spark, d):
    i = F.col("doc_id")
    prompt = rd.excerpt(F.col("text"), F.when(i % 3 != 0, (i % 9).cast("string")), i % 3 == 1)
    return docs(spark, d).select("doc_id", F.md5(prompt).alias("prompt_md5"), F.md5(rd.source_of(prompt)).alias("source_md5"))


@query("""
    WITH i AS (SELECT p_partkey // 10 AS set_id, list(struct_pack(q := p_name, o := [p_type, p_name, p_brand, p_size::VARCHAR], a := p_type) ORDER BY p_partkey) AS items FROM part GROUP BY 1)
    SELECT set_id, md5(array_to_string(list_transform(items, lambda x, i: i || '. ' || x.q || chr(10) || 'A) ' || x.o[1] || chr(10) || 'B) ' || x.o[2] || chr(10) || 'C) ' || x.o[3] || chr(10) || 'D) ' || x.o[4] || chr(10) || 'Answer: ' || x.a), chr(10) || chr(10))) AS exam_md5,
        md5(array_to_string(list_transform(items, lambda x, i: i || '. ' || x.q), chr(10))) AS points_md5, md5(array_to_string(list_transform(items, lambda x, i: 'Q' || i || ': ' || x.q || chr(10) || 'A: ' || x.a), chr(10) || chr(10))) AS pairs_md5 FROM i""")
def rendered_items(spark, d):
    items = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("question"), F.array(F.col("p_type"), F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")).alias("options"), F.col("p_type").alias("answer")))), lambda x: F.struct(x.question.alias("question"), x.options.alias("options"), x.answer.alias("answer")))
    made = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("set_id")).agg(items.alias("items"))  # ten items
    return made.select("set_id", F.md5(rd.exam_layout("items")).alias("exam_md5"), F.md5(rd.numbered_points(F.transform("items", lambda x: x.question))).alias("points_md5"), F.md5(rd.questions_and_answers("items")).alias("pairs_md5"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '|two' WHEN 1 THEN event_type WHEN 2 THEN '' ELSE '' END AS items, CASE event_id % 4 WHEN 1 THEN event_type WHEN 0 THEN '{"points": ["' || event_type || '", "two"]}' WHEN 2 THEN 'first|second|third' ELSE '{"other": 1}' END AS points FROM events""")
def unwrapped_replies(spark, d):
    i = F.col("event_id")
    reply = F.when(i % 4 == 0, F.concat(F.lit('{"points": ["'), "event_type", F.lit('", "two"]}'))).when(i % 4 == 1, F.concat(F.lit('["'), "event_type", F.lit('"]'))).when(i % 4 == 2, "- first\n\n2. second\n * third").otherwise('{"other": 1}')
    return table(spark, d, "events").select("event_id", F.array_join(rd.unwrapped(reply, "points"), "|").alias("items"), F.array_join(rd.points_of(reply), "|").alias("points"))


@query("SELECT event_id, greatest(1, least(100, CAST(trunc(value) AS INT))) AS score, round(1 / (1 + exp(-least(60, greatest(-60, value / 10 - 5)))), 6) AS sigmoid, round(2 * (value / 100) - 1, 6) AS cosine, greatest(2, least(30, CAST(floor(floor(value * 100 / 120) / 2) AS BIGINT))) AS sentences FROM events")
def score_arithmetic(spark, d):
    from quarry.operators.planning import fold_sentences
    from quarry.operators.retrieval import remapped

    v = F.col("value")
    return table(spark, d, "events").select("event_id", tx.clamp_score(v.cast("string")).alias("score"), F.round(tx.sigmoid(v / 10 - 5), 6).alias("sigmoid"), F.round(remapped(v / 100), 6).alias("cosine"), fold_sentences(v * 100).alias("sentences"))
