"""Approximate nearest neighbours by a written index of compressed vectors, and exact search where it fails.

Vectors (as directions) lie in lists around centroids; what a centroid leaves over is product-quantised: each stretch of
SUB dimensions becomes the number of the nearest of 256 codewords. Centroids and codewords are fitted on a bounded sample
of SAMPLE vectors, chosen by a hash of their id; every vector is indexed. The index is written once, sorted by list, and
opened by any later search. A search looks codes up in tables of the query's products with all codewords, keeps the
SHORT best of each task and query, and scores the best of them exactly: only those vectors are read whole. Tables of at
most TABLE_BYTES are broadcast; more queries take several passes over the codes. Queries are a stated set. A zero vector
has score 0.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.operators import retrieval
from quarry.sources.sinks import shared_folder

SAMPLE, MOST_LISTS, PARTS, SUB, CODEWORDS = 20_000, 4096, 1 << 20, 4, 256
#: Share of the lists that a query probes, and the fewest. Vectors without clusters take most of them; clustered ones few.
PROBED, FEWEST = 0.7, 8
#: Candidates that are scored exactly for each neighbour asked for.
SHORT = 15
TABLE_BYTES = 64 << 20


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(x: np.ndarray, made: np.ndarray) -> np.ndarray:
    return (x @ made.T - 0.5 * (made**2).sum(axis=1)).argmax(axis=1)


def means(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Centres of n groups by k-means from evenly spaced rows; an empty group keeps its centre."""
    made = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, made)
        counts, sums = np.bincount(own, minlength=len(made)), np.zeros_like(made)
        np.add.at(sums, own, x)
        made[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return made


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x dimensions
    codewords: np.ndarray  # stretches x codewords x SUB

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB))).astype(np.float32)

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Quantiser:
        x = cls.padded(unit(x))
        centroids = means(x, lists)
        rest = (x - centroids[nearest(x, centroids)]).reshape(len(x), -1, SUB)
        words = np.zeros((rest.shape[1], CODEWORDS, SUB), np.float32)
        for j in range(rest.shape[1]):
            own = means(rest[:, j], CODEWORDS)
            words[j, : len(own)] = own
        return cls(centroids, words)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        x = self.padded(unit(x))
        lists = nearest(x, self.centroids)
        rest = (x - self.centroids[lists]).reshape(len(x), -1, SUB)
        return lists, np.stack([nearest(rest[:, j], w) for j, w in enumerate(self.codewords)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of each query with all centroids, and with all codewords of each stretch."""
        q = self.padded(unit(q))
        return q @ self.centroids.T, np.einsum("qjd,jwd->qjw", q.reshape(len(q), -1, SUB), self.codewords).reshape(len(q), -1)


class Index:
    """An index in a folder: `vectors` (list, vec_id, code, embedding) and `model`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/model").collect()  # lists and codewords: MOST_LISTS + CODEWORDS * dimensions rows at most
        part = lambda kind: np.array([r.values for r in sorted((r for r in rows if r.kind == kind), key=lambda r: r.place)], np.float32)
        self.quantiser = Quantiser(part("centroid"), part("codeword").reshape(-1, CODEWORDS, SUB))
        self.vectors = spark.read.parquet(f"{path}/vectors")

    @classmethod
    def build(cls, corpus: DataFrame, path: str | None = None) -> Index:
        """Fits and writes an index of vec_id, embedding; without a path below the shared folder."""
        spark, n = corpus.sparkSession, corpus.count()
        path = path or shared_folder(spark, "index")
        share = -(-PARTS * 4 * SAMPLE // max(n, 1))  # thinned by hash before anything is ordered
        some = corpus.filter(F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)) < share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()  # bounded by SAMPLE
        if not some:
            raise ValueError("no vectors to index")
        own = Quantiser.fit(np.array([r.embedding for r in some], np.float64), int(min(MOST_LISTS, max(1, np.sqrt(n)))))
        told = spark.sparkContext.broadcast(own)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    lists, codes = told.value.encode(np.array(b.column("embedding").to_pylist(), np.float64))
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("embedding")], names=["list", "vec_id", "code", "embedding"])

        kinds = {c: corpus.schema[c].dataType.simpleString() for c in ("vec_id", "embedding")}
        coded = corpus.select("vec_id", "embedding").mapInArrow(encode, f"list int, vec_id {kinds['vec_id']}, code binary, embedding {kinds['embedding']}")
        coded.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id").write.parquet(f"{path}/vectors")
        model = [("centroid", i, v.tolist()) for i, v in enumerate(own.centroids)] + [("codeword", i, v.tolist()) for i, v in enumerate(own.codewords.reshape(-1, SUB))]
        spark.createDataFrame(model, "kind string, place int, values array<float>").coalesce(1).write.parquet(f"{path}/model")
        return cls(spark, path)

    def short_list(self, queries: DataFrame, short: int, probed: float = PROBED) -> DataFrame:
        """query_id, vec_id, list: the `short` best of each query by its tables."""
        own, n = self.quantiser, queries.count()
        size = 4 * (own.codewords.shape[0] * CODEWORDS + len(own.centroids))
        passes = max(1, -(-n * size // TABLE_BYTES))
        probes = min(len(own.centroids), max(FEWEST, int(np.ceil(len(own.centroids) * probed))))
        kind_q, kind_v = queries.schema["query_id"].dataType.simpleString(), self.vectors.schema["vec_id"].dataType.simpleString()
        type_q = {"bigint": pa.int64(), "int": pa.int32()}.get(kind_q, pa.string())
        parts = []
        for k in range(passes):
            asked = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).select("query_id", "embedding").collect()  # TABLE_BYTES of tables
            if not asked:
                continue
            near, tables = own.tables(np.array([r.embedding for r in asked], np.float64))
            open_lists = np.zeros(near.shape, bool)
            np.put_along_axis(open_lists, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            told = self.spark.sparkContext.broadcast(([r.query_id for r in asked], near, tables, open_lists))
            parts.append(self.vectors.select("list", "vec_id", "code").mapInArrow(self.scan(told, short, own.codewords.shape[0], type_q), f"query_id {kind_q}, vec_id {kind_v}, list int, near float"))
        if not parts:
            return self.spark.createDataFrame([], f"query_id {kind_q}, vec_id {kind_v}, list int")
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return retrieval.top(found, "query_id", "near", "vec_id", short).select("query_id", "vec_id", "list")

    @staticmethod
    def scan(told, short: int, stretches: int, type_q: pa.DataType):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, near, tables, open_lists = told.value
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.float32), np.zeros(0, object), np.zeros(0, np.int32))] * len(ids)
            kind = None
            for b in batches:
                if not b.num_rows:
                    continue
                kind = b.column("vec_id").type
                lists, vecs = b.column("list").to_numpy(), b.column("vec_id").to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, stretches)
                places = codes + (np.arange(stretches) * CODEWORDS)[None, :]
                for q in range(len(ids)):
                    rows = np.flatnonzero(open_lists[q, lists])
                    scores = near[q, lists[rows]] + tables[q][places[rows]].sum(axis=1)
                    scores, own, of = np.concatenate([held[q][0], scores]), np.concatenate([held[q][1], vecs[rows]]), np.concatenate([held[q][2], lists[rows]])
                    if len(scores) > short:
                        best = np.argpartition(-scores, short - 1)[:short]
                        scores, own, of = scores[best], own[best], of[best]
                    held[q] = (scores, own, of)
            for q, (scores, own, of) in enumerate(held):
                if len(scores):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(scores), type_q), pa.array(own.tolist(), kind), pa.array(of, pa.int32()), pa.array(scores, pa.float32())], names=["query_id", "vec_id", "list", "near"])

        return run

    def top_k(self, queries: DataFrame, k: int = DEFAULTS.top_k, short: int | None = None) -> DataFrame:
        """query_id, vec_id, score, rank. Written to the shared folder, so that what fails fails here."""
        out = shared_folder(self.spark, "neighbours")
        short = short or SHORT * k
        near = self.short_list(queries, short)
        near.write.parquet(f"{out}/short")
        near = self.spark.read.parquet(f"{out}/short")
        asked = queries.select("query_id", F.col("embedding").alias("q"))
        few = queries.count() * short <= retrieval.BROADCAST_TERMS
        read = self.vectors.select("list", "vec_id", F.col("embedding").alias("v")).join(F.broadcast(near) if few else near, ["list", "vec_id"])
        score = F.round(retrieval.dot(F.col("q"), F.col("v")) / (retrieval.norm(F.col("q")) * retrieval.norm(F.col("v"))), 6)
        pairs = read.join(asked, "query_id").select("query_id", "vec_id", score.alias("score"))
        retrieval.top(pairs, "query_id", "score", "vec_id", k).write.parquet(f"{out}/top")
        return self.spark.read.parquet(f"{out}/top")


def search(queries: DataFrame, corpus: DataFrame, k: int = DEFAULTS.top_k, index: Index | str | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: by the index (or the path of one), and exactly without one or where it fails."""
    if index is not None:
        try:
            return (Index(corpus.sparkSession, index) if isinstance(index, str) else index).top_k(queries, k)
        except (PySparkException, Py4JError, ValueError) as fault:
            logging.getLogger(__name__).warning("index search failed (%s); searching exactly", type(fault).__name__)
    return retrieval.cosine_top_k(queries, corpus, k)
