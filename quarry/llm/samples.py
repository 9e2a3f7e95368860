"""Bounded samples of labelled rows for fitting, and a few numpy models' parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(doc_id, n: int):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


#: Texts of more bytes are not taken into samples.
SAMPLE_BYTES = 256 << 10
#: Parts of a label's ids by their hash, of which only so many are ranked as hold MARGIN times the rows wanted.
PARTS, MARGIN = 1 << 20, 4


def firsts(labelled: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id and label of about MARGIN * most rows of each label, the first by a hash of doc_id; of smaller ones, all."""
    rows = labelled.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", column)
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("__rows"))
    share = F.ceil(F.lit(float(PARTS)) * MARGIN * most / F.col("__rows"))
    return rows.join(F.broadcast(counts), column).filter(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) < share).select("doc_id", column).distinct()


def labelled_texts(docs: DataFrame, labelled: DataFrame, column: str, most: int) -> list[tuple[int, object, str]]:
    """(doc_id, label, text) of at most `most` documents for each label, chosen by a hash of doc_id.

    `labelled` has doc_id and the label. Ids are thinned by their hash before they are ranked, so that the ranked rows
    of a label are about MARGIN * most at any size; the texts of the chosen ids alone come to the driver, whole, of
    rows with one doc_id the least, and none of more than SAMPLE_BYTES.
    """
    order = W.partitionBy(column).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)), F.xxhash64("doc_id"), "doc_id")
    ranked = firsts(labelled, column, most).withColumn("__n", F.row_number().over(order))
    ids = ranked.filter(F.col("__n") <= most).select("doc_id", F.col(column).alias("__label")).collect()  # bounded by most for each label
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r["__label"]) for r in ids], ranked.select("doc_id", F.col(column).alias("__label")).schema)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("__label").alias("label")).collect()
    return sorted((r.doc_id, r.label, r.text) for r in rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression by Adam over all rows; the last is the bias. y in 0 to 1; more columns, more models."""
    y = y.reshape(len(y), -1).astype(x.dtype)
    w = np.zeros((x.shape[1] + 1, y.shape[1]), x.dtype)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        error = sigmoid(x @ w[:-1] + w[-1]) - y
        g = np.vstack([x.T @ error / len(x) + decay * w[:-1], error.mean(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
