"""Registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import alignment, bpe, chat, decontam, dedup, language, licenses, ngram_join, pieces, pii, quality, runs, toxicity
from quarry.llm.common import documents

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=90)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{CONTROL_TEXT}'), (-7L, 1L, 'assistant', '{CONTROL_TEXT}') AS t(conv_id, turn, role, text)")
    return chat.report(turns.unionByName(more))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir).select("doc_id", "text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(documents(spark, sf_dir).select("doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spark, documents(spark, sf_dir).select("doc_id", "text", "source", "lang"), documents(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.planted(documents(spark, sf_dir)))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_bpe, op3_chat_formatting, op4_license_scan, op5_exact_dedup, op6_pii, op7_quality_classifier, op8_toxicity, op9_decontamination, op10_language_id, op11_periodic_runs, op12_sentencepiece, op13_alignment)}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ESCAPED = "length({0}) + 4 * (length({0}) - length(replace({0}, '&', ''))) + 3 * (length({0}) - length(replace({0}, '<', ''))) + 4 * (length({0}) - length(replace({0}, '[', '')))"

#: The template grams of the license scan, by the same rule as licenses.templates.
GRAMS = ", ".join(
    f"({k}, '{label}', {phrase}, {len(parts)}, {must}::INT[], {at}, '{parts[at]}', '{parts[at + 1]}')"
    for k, (label, text, phrase, must) in enumerate(licenses.listed())
    for parts in [text.split()]
    for at in range(len(parts) - 1)
)

SQL = {
    "op1_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS gram FROM w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 2) END)) AS u(i)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
        r AS (SELECT doc_id AS src, doc_id AS dst FROM documents UNION SELECT r.src, e.b FROM r JOIN e ON e.a = r.dst)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(dst) AS component_id FROM documents d JOIN r ON r.src = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1""",
    "op3_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, t, r, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
        p AS (SELECT *, row_number() OVER o - 1 AS place, (length(text) + 3) // 4 + 4 AS tokens, coalesce(sum((length(text) + 3) // 4 + 4) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            {ESCAPED.format('role')} + 1 + {ESCAPED.format('text')} + 8 AS size FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        s AS (SELECT conv_id, place AS s_place, tokens AS s_tokens, size AS s_size FROM p WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place) = 1),
        z AS (SELECT p.*, s_place, s_size, coalesce(s_tokens, 0) AS s_tokens, greatest(1, (1024 - coalesce(s_tokens, 0)) // 2) AS half FROM p LEFT JOIN s ON s.conv_id = p.conv_id),
        q AS (SELECT *, 2 * (before // half) + CAST(tokens > half AS INT) AS w FROM z),
        g AS (SELECT conv_id, w, min(place) AS first, any_value(s_place) AS s_place, any_value(s_size) AS s_size,
            1024 - sum(tokens) - CASE WHEN any_value(s_place) < min(place) THEN any_value(s_tokens) ELSE 0 END AS room FROM q GROUP BY 1, 2),
        n AS (SELECT g.conv_id, g.w, q.size, room, sum(q.tokens) OVER (PARTITION BY g.conv_id, g.w ORDER BY q.place DESC) AS upto FROM g JOIN q ON q.conv_id = g.conv_id AND q.place < g.first AND q.place >= g.first - 2
            WHERE q.s_place IS NULL OR q.place <> q.s_place),
        h AS (SELECT conv_id, sum(9 + size) AS told FROM n WHERE upto <= room GROUP BY 1),
        k AS (SELECT conv_id, sum(9 + s_size) AS kept FROM g WHERE s_place < first GROUP BY 1),
        t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, sum(8 + size) AS own FROM q GROUP BY 1)
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
            CAST(own + coalesce(told, 0) + coalesce(kept, 0) AS BIGINT) AS formatted_chars FROM t LEFT JOIN h USING (conv_id) LEFT JOIN k USING (conv_id)""",
    "op4_license_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        t AS (SELECT * FROM (VALUES {GRAMS}) AS v(template, label, phrase, size, must, at_, w1, w2)),
        g AS (SELECT r, x AS pos, w[x + 1] AS d1, w[x + 2] AS d2 FROM d, unnest(range(len(w) - 1)) AS u(x)),
        v AS (SELECT r, template, label, phrase, size, must, pos - at_ AS diagonal, list(DISTINCT at_) AS met, min(pos) AS f, max(pos) + 1 AS l FROM g JOIN t ON d1 = w1 AND d2 = w2 GROUP BY ALL),
        n AS (SELECT *, CASE WHEN f - lag(l) OVER o <= {licenses.DRIFT} AND abs(diagonal - lag(diagonal) OVER o) <= {licenses.DRIFT} THEN 0 ELSE 1 END AS fresh
            FROM v WHERE NOT phrase WINDOW o AS (PARTITION BY r, template ORDER BY f, diagonal)),
        y AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY f, diagonal ROWS UNBOUNDED PRECEDING) AS run FROM n),
        m AS (SELECT r, label, size, min(f) AS f, max(l) AS l, list_has_all(flatten(list(met)), must) AS whole, len(list_distinct(flatten(list(met)))) / CAST(size - 1 AS DOUBLE) AS cov FROM y GROUP BY r, template, label, size, must, run),
        z AS (SELECT r, label, TRUE AS phrase, f, 1.0::DOUBLE AS cov FROM v WHERE phrase AND len(met) = size - 1
            UNION ALL SELECT r, label, FALSE, f, cov FROM m WHERE whole AND cov >= {licenses.COVERAGE} AND l - f < {licenses.STRETCH} * size)
        SELECT any_value(doc_id) AS doc_id, any_value(len(w)) AS n_words, count(f) FILTER (phrase) AS n_base, min(f) FILTER (phrase) AS first_word, max(f) FILTER (phrase) AS last_word,
            coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(cov), 0.0) AS score
        FROM d LEFT JOIN z USING (r) GROUP BY r""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[x + 1 : x + least(10, len(w))], ' ') AS gram FROM b, unnest(range(len(w) - least(10, len(w)) + 1)) AS u(x) WHERE len(w) > 0),
        k AS (SELECT DISTINCT k FROM i),
        g AS (SELECT doc_id, x, k, array_to_string(w[x + 1 : x + k], ' ') AS gram FROM d, k, unnest(range(greatest(0, len(w) - k + 1))) AS u(x)),
        h AS (SELECT doc_id, x, g.k, item_id FROM g JOIN i ON g.k = i.k AND g.gram = i.gram),
        n AS (SELECT doc_id, count(DISTINCT at_) AS n_hit FROM (SELECT doc_id, unnest(range(x, x + k)) AS at_ FROM h) GROUP BY 1),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
