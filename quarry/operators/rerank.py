"""Reranking of retrieved candidates by a scorer that may be missing or fail, and a late-interaction scorer.

A scorer is a function from candidates (query_id, doc_id, query, text) to query_id, doc_id, logit. A null logit says that
scoring did not run; that is something else than a low score: where any candidate of a query has none, the query keeps the
order of its vector scores and their threshold. The column `basis` says which of the two decided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.operators import retrieval

Scorer = Callable[[DataFrame], DataFrame]

#: Of the late-interaction scorer: dimensions of a token's vector, characters of its n-grams, and the line from the mean best match to a logit.
DIMENSIONS, GRAM, SLOPE, CENTRE = 64, 3, 12.0, 0.5
#: Tokens of a text that are compared at once.
TOKENS_AT_ONCE = 4096


def probability(logit: Column) -> Column:
    """Logistic function, clamped where the exponential would overflow."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))


def reranked(candidates: DataFrame, scorer: Scorer | None, k: int = DEFAULTS.top_k, threshold: float = DEFAULTS.rerank_threshold, vector_threshold: float = DEFAULTS.relevance_threshold) -> DataFrame:
    """query_id, doc_id, score, rank, basis: the k best of each query that reach the threshold of their basis.

    candidates: query_id, doc_id, query, text, vector_score. By the scorer, the best one stays even below the threshold;
    by vector scores, a query without a score that reaches it has no rows. Ties by doc_id.
    """
    base = candidates.select("query_id", "doc_id", "vector_score")
    if scorer is None:
        scored = base.withColumn("logit", F.lit(None).cast("double"))
    else:
        scored = base.join(scorer(candidates.select("query_id", "doc_id", "query", "text")).select("query_id", "doc_id", "logit"), ["query_id", "doc_id"], "left")
    ran = scored.groupBy("query_id").agg((F.count(F.lit(1)) == F.count("logit")).alias("ran"))
    told = scored.join(ran, "query_id")
    own = told.select("query_id", "doc_id", F.round(F.when(F.col("ran"), probability(F.col("logit"))).otherwise(F.col("vector_score")), 6).alias("score"), F.when(F.col("ran"), "rerank").otherwise("vector").alias("basis"))
    kept = retrieval.top(own, "query_id", "score", "doc_id", k)
    reaches = F.when(F.col("basis") == "rerank", (F.col("score") >= threshold) | (F.col("rank") == 1)).otherwise(F.col("score") >= vector_threshold)
    return kept.filter(reaches).select("query_id", "doc_id", "score", "rank", "basis")


def lexical(pairs: DataFrame) -> DataFrame:
    """A scorer: the share of the query's distinct tokens that the text has, as a logit (at most 60 either way)."""
    share = retrieval.lexical_rerank(pairs).select("query_id", "doc_id", F.col("score").alias("s"))
    logit = F.when(F.col("s") <= 0, -60.0).when(F.col("s") >= 1, 60.0).otherwise(F.log(F.col("s") / (1 - F.col("s"))))
    return share.select("query_id", "doc_id", logit.alias("logit"))


def token_vector(token: str) -> np.ndarray:
    """A direction from the token's character n-grams, each a sign in one dimension: tokens of like spelling lie close."""
    marked, out = f"<{token}>", np.zeros(DIMENSIONS)
    for i in range(max(1, len(marked) - GRAM + 1)):
        h = xxhash.xxh64_intdigest(marked[i : i + GRAM].encode())
        out[h % DIMENSIONS] += 1.0 if h >> 63 else -1.0
    length = np.linalg.norm(out)
    return out / length if length else out


def mean_best_match(query: list[str], text: list[str], vectors: dict[str, np.ndarray]) -> float | None:
    """Mean over the query's distinct tokens of the best cosine with any of the text's; null where one of them has none."""
    if not query or not text:
        return None
    q = np.stack([vectors[t] for t in dict.fromkeys(query)])
    own = list(dict.fromkeys(text))
    best = np.full(len(q), -1.0)
    for i in range(0, len(own), TOKENS_AT_ONCE):
        best = np.maximum(best, (q @ np.stack([vectors[t] for t in own[i : i + TOKENS_AT_ONCE]]).T).max(axis=1))
    return float(best.mean())


class Vectors(dict):
    """Token vectors, made when first asked for; the table starts anew beyond a bound."""

    MOST = 200_000

    def __missing__(self, token: str) -> np.ndarray:
        if len(self) >= self.MOST:
            self.clear()
        made = self[token] = token_vector(token)
        return made


def late_interaction(pairs: DataFrame) -> DataFrame:
    """A scorer: every query token is held against all of the text's tokens, and its best match counts. A query or a text
    without tokens isn't scored."""
    from quarry.functions import text as tx

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    told = pairs.select("query_id", "doc_id", tx.tokens(F.col("query")).alias("q"), tx.tokens(F.col("text")).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for b in batches:
            made = [mean_best_match(q, d, vectors) for q, d in zip(b.column("q").to_pylist(), b.column("d").to_pylist(), strict=True)]
            logits = [None if m is None else SLOPE * (m - CENTRE) for m in made]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("doc_id"), pa.array(logits, pa.float64())], names=["query_id", "doc_id", "logit"])

    return told.mapInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, logit double")
