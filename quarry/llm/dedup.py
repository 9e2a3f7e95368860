"""Exact deduplication by stateful streaming.

Texts arrive as a stream of (digest, doc_id, locator) rows, in several micro-batches. A streaming aggregation keeps, for
each digest and without expiry, the row with the largest doc_id (the stable identifier) with its content locator (file
and row) and the number of rows, in a state store on disk (RocksDB) with checkpoints in the shared folder; a later batch
reads and updates the state that earlier ones left, and a restarted stream goes on from the checkpoint. Full bytes are
checked on hits: for every digest that more than one row has, the least and the greatest text are aggregated, partly
before the shuffle, so that a hot digest sends one text from each task. Where they differ, the digest's rows are grouped
by their whole text instead. Only DataFrame functions run; no text is written.

Null counts as empty text; very long texts are digested and compared whole. Texts are equal when identical after no
change. Repeated rows (same doc_id and text) count as rows of one group; of rows tied for the largest doc_id all have
kept = true, and `unique` keeps the last of them by locator. A null doc_id never stays before a number. An empty table
gives an empty table. Other columns of the input, whatever their names, are left alone (names that begin with two
underscores are the operator's).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, located

#: A digest with this share of all rows is hot; at most 1/HOT_SHARE digests are, so their list may be broadcast.
HOT_SHARE = 0.001
#: Hashes of digests (8 bytes each) and locators of dropped rows (about 150 bytes each) that may be broadcast.
BROADCAST_HASHES, BROADCAST_LOCATORS = 1_000_000, 200_000
#: Micro-batches that a table's arrivals are dealt over.
BATCHES = 2


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed_state(arrivals: DataFrame, ws: Workspace, batches: int = BATCHES, name: str = "state") -> DataFrame:
    """Runs the stream over a stored arrivals table (digest, doc_id, locator) to its end; returns digest, keep_id,
    keep_at (its locator) and group_size.

    Every micro-batch writes the keys it changed; a key's latest row is the one with the most rows behind it. Called
    again after files were added to the table, it goes on from the checkpoint; a repeated batch overwrites its own
    folder.
    """
    main = arrivals.sparkSession
    files = arrivals.inputFiles()
    spark = main.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "64")
    # Without this every state partition holds files of 4 MB from its first row on.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    spark.conf.set("spark.sql.shuffle.partitions", main.conf.get("spark.sql.shuffle.partitions"))
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(f"{ws.path}/arrivals")
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    out = f"{ws.path}/{name}"
    query = (
        state.writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .option("checkpointLocation", f"{ws.path}/{name}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    kept = "digest string, top struct<doc_id:bigint,locator:struct<file:string,row:bigint>>, group_size bigint"
    changed = main.read.schema(kept).parquet(out) if query.lastProgress or files else main.createDataFrame([], kept)
    latest = changed.groupBy("digest").agg(F.max(F.struct("group_size", "top")).alias("s"))
    return latest.select("digest", F.col("s.top.doc_id").alias("keep_id"), F.col("s.top.locator").alias("keep_at"), F.col("s.group_size").alias("group_size"))


def collisions(own: DataFrame, state: DataFrame, ws: Workspace) -> DataFrame:
    """Digests that stand for different texts, by full bytes. own: digest and text."""
    hits = state.filter("group_size > 1").select(F.xxhash64("digest").alias("__h"))
    wanted = F.broadcast(hits) if hits.count() <= BROADCAST_HASHES else hits
    texts = own.withColumn("__h", F.xxhash64("digest")).join(wanted, "__h", "left_semi")
    ends = texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return ws.save(ends.filter("low != high").select("digest"), "collisions")


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame]:
    """The rows with __locator; and doc_id, locator, text_sha256, keep_id, keep_at and group_size of every row.

    `digest` may be any function of the text.
    """
    ws = Workspace(docs.sparkSession, "dedup")
    rows = located(docs, ws)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), digest(text).alias("digest"), F.col("__locator").alias("locator"))
    sha = [] if digest is sha256 else [sha256(F.col("text")).alias("text_sha256")]
    arrivals = ws.save(own.select("digest", "doc_id", "locator", *sha), "arrivals")
    state = ws.save(keyed_state(arrivals.select("digest", "doc_id", "locator"), ws), "groups")
    ws.drop("state", "state-checkpoint")
    bad = collisions(own, state, ws)
    total = arrivals.count()
    hot = F.col("group_size") >= max(2, HOT_SHARE * total)
    named = arrivals if sha else arrivals.withColumn("text_sha256", F.col("digest"))
    clean = state if bad.isEmpty() else state.join(bad, "digest", "left_anti")
    often = F.broadcast(clean.filter(hot))
    shown = ["doc_id", "locator", "text_sha256", "keep_id", "keep_at", "group_size"]
    rare = named.join(F.broadcast(clean.filter(hot).select("digest")), "digest", "left_anti").join(clean.filter(~hot), "digest")
    made = named.join(often, "digest").select(*shown).unionByName(rare.select(*shown))
    if not bad.isEmpty():
        differ = own.join(bad, "digest", "left_semi")
        by_text = differ.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        by_text = by_text.select("digest", "text", F.col("top.doc_id").alias("keep_id"), F.col("top.locator").alias("keep_at"), "group_size")
        made = made.unionByName(differ.join(by_text, ["digest", "text"]).withColumn("text_sha256", sha256(F.col("text"))).select(*shown))
    return rows, made


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and locator (file, row) for every row."""
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return groups(docs, digest)[1].select("doc_id", "keep_id", "group_size", kept, "text_sha256", "locator")


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def unique(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row of each group of equal texts, with all columns: the one with the largest doc_id, found by its locator."""
    rows, members = groups(docs, digest)
    ws = Workspace(docs.sparkSession, "dropped")
    dropped = ws.save(members.filter("locator != keep_at").select(F.col("locator").alias("__locator")), "rows")
    few = dropped.count() <= BROADCAST_LOCATORS
    return rows.join(F.broadcast(dropped) if few else dropped, "__locator", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
