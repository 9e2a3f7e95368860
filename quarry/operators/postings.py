"""Sparse top-k search over hashed words, by written postings whose blocks are passed over where they can't matter.

A text's sparse vector has, for each bucket that one of its words falls into, the number of times that the word stands in
it; of several words of one bucket the first one in the text counts. Documents lie in blocks of about BLOCK_DOCS, those of
like length together; a row of the postings holds one bucket's documents of one block and the largest of their weights.
For a query, a block's documents score no more than the sum of weight times largest weight over the query's buckets. The
LEAD blocks of greatest bound are scored first; blocks whose bound lies below the k-th best score so far can't hold any
of the k best and aren't read further. Results are those of the full product, ties by document.

Queries are a stated set. Null and empty texts have no buckets and are found by no query; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import text as tx
from quarry.operators import retrieval
from quarry.sources.sinks import shared_folder

#: Documents of a block, about; blocks that are scored before bounds are held against a score; strata of length.
BLOCK_DOCS, LEAD, STRATA = 1024, 4, 4
#: Buckets that lie in one file.
STRETCH = 5000
#: Characters of words.
WORDS = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words in the order of their first places, and how often each stands in it."""
    for b in batches:
        words = b.column("words")
        coded = words.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        met, at, n = np.unique(retrieval.spread(words) * size + coded.indices.to_numpy(), return_index=True, return_counts=True)
        order = np.argsort(at)
        ends = pa.array(np.searchsorted(met, np.arange(len(words) + 1) * size).astype(np.int32))
        made = [pa.ListArray.from_arrays(ends, own) for own in (coded.dictionary.take(pa.array(met[order] % size)), pa.array(n[order]))]
        yield pa.RecordBatch.from_arrays([b.column(c) if c != "words" else made[0] for c in b.schema.names] + made[1:], names=[*b.schema.names, "weights"])


def first_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's buckets, ascending, with the weight of the first word of each."""
    for b in batches:
        buckets = b.column("buckets")
        text, bucket = retrieval.spread(buckets), buckets.flatten().to_numpy()
        order = np.lexsort((bucket, text))  # stable: equal ones in the order of words
        new = np.ones(len(order), bool)
        new[1:] = (text[order][1:] != text[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        kept = order[new]
        ends = pa.array(np.searchsorted(text[kept], np.arange(len(buckets) + 1)).astype(np.int32))
        made = {"buckets": pa.array(bucket[kept]), "weights": pa.array(b.column("weights").flatten().to_numpy()[kept])}
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, made[c]) if c in made else b.column(c) for c in b.schema.names], names=b.schema.names)


def rows_of_vectors(texts: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns to keep, and each text's buckets (ascending) and weights as arrays; a text is counted where it stands."""
    kept = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)
    counted = texts.select(*keep, words(F.col(text)).alias("words")).mapInArrow(distinct_words, f"{kept}, words array<string>, weights array<bigint>")
    hashed = counted.select(*keep, F.transform("words", lambda w: tx.bucket_of(w).cast("bigint")).alias("buckets"), "weights")
    return hashed.mapInArrow(first_of_buckets, f"{kept}, buckets array<bigint>, weights array<bigint>")


def cells(vectors: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, bucket, weight: a row for each bucket of each vector."""
    return vectors.select(*keep, F.explode(F.arrays_zip("buckets", "weights")).alias("c")).select(*keep, F.col("c.buckets").alias("bucket"), F.col("c.weights").alias("weight"))


def sparse_vectors(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, bucket, weight: the hashed term frequencies of each text. Keys must be unique."""
    return cells(rows_of_vectors(texts, key, text=text), key)


class Postings:
    """Postings in a folder: bucket, block, top (largest weight) and documents (doc_id, weight)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.rows = spark, path, spark.read.parquet(path)

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> Postings:
        """Writes the postings of doc_id, text, sorted by bucket; without a path below the shared folder."""
        spark = docs.sparkSession
        path = path or shared_folder(spark, "postings")
        # Blocks by length: a bound is tight where the documents of a block are alike.
        stratum = F.floor(F.log2(F.length("text") + 1) * STRATA)
        sizes = docs.groupBy(stratum.alias("stratum")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("parts"))  # 31 * STRATA rows at most
        placed = docs.select("doc_id", "text", stratum.alias("stratum")).join(F.broadcast(sizes), "stratum")  # null texts have no words
        block = F.concat_ws(":", "stratum", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("block")
        # Whole vectors are dealt by block, where lists form, and lists by stretches of buckets: hashes need no sampling of their range.
        dealt = rows_of_vectors(placed.select("doc_id", "text", block), "doc_id", "block").repartition("block")
        lists = cells(dealt, "doc_id", "block").groupBy("bucket", "block")
        made = lists.agg(F.max("weight").alias("top"), F.collect_list(F.struct("doc_id", "weight")).alias("documents"))  # the documents of a block
        made.repartition(F.floor(F.col("bucket") / STRETCH)).sortWithinPartitions("bucket", "block").write.parquet(path)
        return cls(spark, path)

    def bounds(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The queries' sparse vectors, and query_id, block, bound of every block that has one of a query's words."""
        out = shared_folder(self.spark, "bounds")
        sparse_vectors(queries, "query_id").withColumnRenamed("weight", "asked").write.parquet(f"{out}/queries")
        asked = self.spark.read.parquet(f"{out}/queries")
        met = self.rows.select("bucket", "block", "top").join(self.few(asked), "bucket")
        met.groupBy("query_id", "block").agg(F.sum(F.col("top") * F.col("asked")).alias("bound")).write.parquet(f"{out}/bounds")
        return asked, self.spark.read.parquet(f"{out}/bounds")

    @staticmethod
    def few(rows: DataFrame) -> DataFrame:
        """Broadcast behind a check of the number of rows."""
        return F.broadcast(rows) if rows.count() <= retrieval.BROADCAST_TERMS else rows

    def scores(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """query_id, doc_id, score: products of the queries with the documents of the chosen blocks alone."""
        wanted = asked.join(blocks.select("query_id", "block"), "query_id")
        met = self.rows.join(self.few(wanted), ["bucket", "block"]).select("query_id", "asked", F.explode("documents").alias("d"))
        return met.groupBy("query_id", F.col("d.doc_id").alias("doc_id")).agg(F.sum(F.col("asked") * F.col("d.weight")).alias("score"))

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The k best (query_id, doc_id, score, rank), and of each query the blocks met and scored."""
        out = shared_folder(self.spark, "sparse")
        asked, bounds = self.bounds(queries)
        lead = retrieval.top(bounds, "query_id", "bound", "block", max(LEAD, -(-4 * k // BLOCK_DOCS)))
        retrieval.top(self.scores(asked, lead), "query_id", "score", "doc_id", k).write.parquet(f"{out}/lead")
        first = self.spark.read.parquet(f"{out}/lead")
        least = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))  # none: the lead has fewer than k
        rest = bounds.join(lead.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        rest.select("query_id", "block").write.parquet(f"{out}/rest")
        rest = self.spark.read.parquet(f"{out}/rest")
        both = first.select("query_id", "doc_id", "score").unionByName(retrieval.top(self.scores(asked, rest), "query_id", "score", "doc_id", k).drop("rank"))
        scored = lead.select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"))
        met = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(scored, "query_id")
        return retrieval.top(both, "query_id", "score", "doc_id", k), met

    def top_k(self, queries: DataFrame, k: int = DEFAULTS.top_k) -> DataFrame:
        """query_id, doc_id, score, rank. queries: query_id, text."""
        return self.search(queries, k)[0]
