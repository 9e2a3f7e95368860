"""Documents, links, sessions, turns, resources and jobs: lookups, access and the rows that a client is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import render as rd


def falls_back(*values: Column) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def document_view(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Documents (doc_id, filename, uploaded_at, n_pages, n_chunks) with the user's link (doc_id, filename, subject), if any."""
    own = links.select("doc_id", F.col("filename").alias("own_name"), "subject")
    both = documents.join(own, "doc_id", "left")
    return both.select(
        "doc_id", falls_back(F.col("own_name"), F.col("filename")).alias("filename"), F.coalesce("subject", F.lit("General")).alias("subject"),
        rd.iso(F.col("uploaded_at")).alias("upload_date"), F.col("n_pages").alias("page_count"), F.coalesce("n_chunks", F.lit(0)).alias("chunk_count"),
    )


def resource_view(resources: DataFrame, threshold: int = 70) -> DataFrame:
    """Resources (id, doc_id, task, verdict, attempts, n_attempts, score, accepted, created_at), summarised."""
    return resources.select(
        "id", "doc_id", F.col("task").alias("resource_type"), F.coalesce("accepted", F.lit(False)).alias("accepted"), "score",
        F.coalesce("threshold", F.lit(threshold)).alias("threshold"), F.coalesce(F.col("n_attempts"), F.greatest(F.size("attempts"), F.lit(0))).alias("n_attempts"),
        F.col("verdict.reasoning").alias("reasoning"), rd.iso(F.col("created_at")).alias("created_at"),
    )


def resource_detail(resources: DataFrame, key: str = "id") -> DataFrame:
    """The summary with the verdict, the attempts and the preview; nothing is joined."""
    extra = resources.select(F.col(key), F.col("verdict"), F.coalesce("attempts", F.array().cast(resources.schema["attempts"].dataType)).alias("attempts"), falls_back(F.substring("source", 1, 1000)).alias("source_preview"))
    summary = resource_view(resources)
    return summary.join(extra, key)


def session_view(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions (session_id, doc_id, filename, title, kinds, bound_at) with their number of turns."""
    counts = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return sessions.join(counts, "session_id", "left").select(
        "session_id", "doc_id", "filename", F.coalesce(F.nullif("title", F.lit("")), F.nullif("filename", F.lit(""))).alias("title"),
        rd.kinds_of(F.col("kinds")).alias("kinds"), rd.iso(F.col("bound_at")).alias("created_at"), F.coalesce("n", F.lit(0)).alias("message_count"),
    )


def turn_view(turns: DataFrame) -> DataFrame:
    """Turns with what their meta says lifted up; a turn without pages has an empty list."""
    m = lambda name: F.col(f"meta.{name}").alias(name)
    return turns.select("session_id", "turn", "role", falls_back(F.col("content")).alias("content"), m("mode"), m("score"), m("accepted"), m("attempts"), F.coalesce("meta.pages", F.array().cast("array<bigint>")).alias("pages"))


def job_view(jobs: DataFrame, minimal: bool = False) -> DataFrame:
    """Jobs with ISO times; a minimal view leaves out parameters and result, which then are never read."""
    stamps = [rd.iso(F.col(c)).alias(c) for c in ("created_at", "started_at", "finished_at")]
    return jobs.select("id", "kind", "status", *stamps, *([] if minimal else ["params", "result"]))


def prompt_history(turns: DataFrame, n: int) -> DataFrame:
    """session_id, place, role, content: the last 2n turns, the oldest first."""
    last = turns.withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn")))).filter(F.col("r") <= 2 * n)
    place = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("r")))
    return last.select("session_id", place.alias("place"), rd.message_role(F.col("role")).alias("role"), "content")


def with_contexts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, contexts: (page, text, score) of a query's ranked hits, in order. hits: query_id, page, score, rank."""
    both = hits.join(texts.select("page", "text"), "page")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "page", "text", "score")))  # k hits at most
    return both.groupBy("query_id").agg(F.transform(ordered, lambda h: F.struct(h.page.alias("page"), h.text.alias("text"), h.score.alias("score"))).alias("contexts"))


def multi_get(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted; repeated and unknown keys give nothing more."""
    return rows.join(wanted.select(key), key, "left_semi")


def looked_up(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every wanted key once, with its row where there is one (found)."""
    return wanted.select(key).distinct().join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def page_requests(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, ...) of requests (request_id, doc_id, first, last): from `first`, or 1, to `last`; with
    `first` alone one page, with neither all pages. 0 counts as missing."""
    first, last = F.nullif("first", F.lit(0)), F.nullif("last", F.lit(0))
    low = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)))
    bounds = requests.select("request_id", "doc_id", (F.col("first").isNull() & F.col("last").isNull()).alias("all"), low.alias("low"), F.greatest(low, F.coalesce(last, low)).alias("high"))
    return pages.join(bounds, "doc_id").filter(F.col("all") | F.col("page_number").between(F.col("low"), F.col("high"))).drop("all", "low", "high")


def reading_order(chunks: DataFrame, limit: int) -> DataFrame:
    """The first chunks of each document by page and index, missing ones as 0, with their place."""
    order = W.partitionBy("doc_id").orderBy(F.coalesce("page_number", F.lit(0)), F.coalesce("chunk_index", F.lit(0)))
    return chunks.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def document_text(chunks: DataFrame, most: int = 15_000) -> DataFrame:
    """doc_id, text: a document's chunks in order with a blank line between, cut at `most` characters.

    Only chunks that begin before the cut are collected.
    """
    order = W.partitionBy("doc_id").orderBy("page_number", "chunk_index")
    before = F.coalesce(F.sum(F.length("chunk") + 2).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = chunks.withColumn("before", before).filter(F.col("before") < most)
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "chunk_index", "chunk")))
    return near.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(ordered, lambda c: c.chunk), "\n\n"), 1, most).alias("text"))


def stale(documents: DataFrame, current: str) -> DataFrame:
    """Ready documents embedded by another model, newest first; a document without a model isn't stale."""
    return documents.filter((F.col("status") == "Ready") & F.col("model").isNotNull() & (F.col("model") != current))


def stale_models(documents: DataFrame, current: str) -> DataFrame:
    """models (distinct, sorted) and the first five filenames, by the newest."""
    old = stale(documents, current)
    names = old.orderBy(F.desc("ingested_at"), "doc_id").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("ingested_at").cast("timestamp"))).alias("at"), "doc_id", "filename"))).alias("fs"))
    models = old.agg(F.array_sort(F.collect_set("model")).alias("models"), F.count(F.lit(1)).alias("n"))
    return models.crossJoin(names).select(F.array_join("models", ",").alias("models"), "n", F.array_join(F.transform("fs", lambda f: f.filename), ",").alias("filenames"))


#: References that one resolution may hold: they travel to every task as constants.
MOST_REFERENCES = 1000


def resolved(documents: DataFrame, references: list[str], cap: int = 5) -> DataFrame:
    """reference, doc_id, tier, matches: by id, else by exact name, else by a part of one name, in any case.

    A stated list of references meets all documents in one pass without a join. A part of several names resolves to
    none (doc_id null), matches (up to `cap`) says of how many; a reference without a document has tier null.
    """
    if len(references) > MOST_REFERENCES:
        raise ValueError(f"at most {MOST_REFERENCES} references at once")
    name, refs = F.col("filename"), F.array(*map(F.lit, references)) if references else F.array().cast("array<string>")
    tier = lambda r: F.when(F.col("doc_id").cast("string") == r, 0).when(name == r, 1).when((r != "") & F.lower(name).contains(F.lower(r)), 2)
    met = documents.select("doc_id", F.explode(F.filter(F.transform(refs, lambda r: F.struct(r.alias("reference"), tier(r).alias("tier"))), lambda x: x.tier.isNotNull())).alias("m")).select("doc_id", "m.*")
    each = met.groupBy("reference", "tier").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    best = each.groupBy("reference").agg(F.min(F.struct("tier", "doc_id", "n")).alias("b"))
    one = F.when((F.col("b.tier") < 2) | (F.col("b.n") == 1), F.col("b.doc_id"))
    asked = documents.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(references)], "reference string")
    return asked.join(best, "reference", "left").select("reference", one.alias("doc_id"), F.col("b.tier").alias("tier"), F.coalesce(F.least(F.col("b.n"), F.lit(cap)), F.lit(0)).alias("matches"))


def accessible(documents: DataFrame, links: DataFrame, user: str, doc: str = "doc_id") -> DataFrame:
    """Documents that are ready and in the user's library. links: user_id, doc_id."""
    return documents.filter(F.col("status") == "Ready").join(links.filter(F.col("user_id") == user).select(doc), doc, "left_semi")


def free_sessions(uploads: DataFrame, bound: DataFrame) -> DataFrame:
    """Uploads (session_id, digest) with free: no document is bound to the session, or one with the same digest."""
    return uploads.join(bound.select("session_id", F.col("digest").alias("held")), "session_id", "left").withColumn("free", F.col("held").isNull() | (F.col("held") == F.col("digest"))).drop("held")


def kind_allowed(kinds: Column, kind: Column) -> Column:
    """Whether a session may do this; a session without kinds may do all."""
    own = rd.kinds_of(kinds)
    return F.when(F.coalesce(F.size(kinds), F.lit(0)) <= 0, kind.isin(rd.KINDS)).otherwise(F.array_contains(own, kind))


def document_states(events: DataFrame, ready: str = "Ready") -> DataFrame:
    """doc, status, error, n_pages, n_chunks, embedding_model, ingested_at: the fold of a log of status changes and
    ingestions.

    events: doc, ts, event_id, status, error, n_pages, n_chunks, embedding_model; a row with n_pages is an ingestion, which
    makes the document ready, clears its error and stamps its fields; they stay through later changes until the next
    one. A change of status sets the error it comes with, cut at 1000 characters, or clears it.
    """
    ingested = F.col("n_pages").isNotNull()
    status, error = F.when(ingested, F.lit(ready)).otherwise(F.col("status")), F.when(~ingested, F.substring("error", 1, 1000))
    newest = F.max(F.struct("ts", "event_id", status.alias("status"), error.alias("error"))).alias("s")
    stamp = F.max(F.when(ingested, F.struct("ts", "event_id", "n_pages", "n_chunks", "embedding_model"))).alias("i")
    return events.groupBy("doc").agg(newest, stamp).select("doc", "s.status", "s.error", "i.n_pages", "i.n_chunks", "i.embedding_model", F.col("i.ts").alias("ingested_at"))


def judged_contexts(hits: DataFrame, most: int = 2) -> DataFrame:
    """What a judge is shown: of each query (query_id, query, standalone, rank, text) the first contexts, and the query as it
    was rewritten, where it was. A query without contexts is shown none."""
    shown = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "text"))))
    made = hits.groupBy("query_id").agg(F.max(F.coalesce(F.nullif("standalone", F.lit("")), "query")).alias("query"), shown.alias("c"))
    return made.select("query_id", "query", F.transform("c", lambda c: c.text).alias("contexts"))
