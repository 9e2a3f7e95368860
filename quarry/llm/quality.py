"""Quality classification with hierarchical empirical Bayes.

A logistic classifier over measures of the text gives each document's own evidence. Grouped aggregation turns it into
posteriors of paths and hosts: a host's mean is shrunk toward the global prior, a path's toward its host, each by a
strength estimated from the variance between groups (method of moments), so that sparse sites say little. A document's
own evidence is left out of the posterior that is added to it. Its log-odds are a weighted sum of its own and of its
path's posterior log-odds relative to the prior; the weights are fitted on labelled documents that the classifier has
not seen. It is accepted at half or more.

The table of documents has no URL: `of_documents` takes the source for the host, and a source's part in one language for
the path. Any two columns may be given instead.

Null and empty texts are scored by their measures (no words: rejected), very long ones whole. A null host or path is a
group of its own. Rows keep their identity: repeated rows are scored alike, and all of them count. Without labels
everything is accepted with score 0.5; an empty table gives an empty table. Columns that begin with two underscores are
the operator's; others, whatever their names, stay. Fitting takes at most `most` labelled documents of each label, of
which every third serves the weights; site statistics cover all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Workspace, slices
from quarry.llm.samples import labelled_texts, logistic, sigmoid

#: Sites with this share of all rows (at most 1/HOT_SHARE sites) are broadcast; the rest meet in a shuffle.
HOT_SHARE = 0.001
#: Sites that may be broadcast together (about 100 bytes each).
BROADCAST_SITES = 200_000
#: Weights of the document's own log-odds and of its site's where fewer than LEAST documents could fit them.
OWN_WEIGHT, SITE_WEIGHT, LEAST, RIDGE = 1.0, 0.25, 50, 5.0
SUMS = ("n", "s", "host_n", "host_s")
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
UPPER, DIGITS, MARKS, PLAIN = bytes(range(65, 91)), b"0123456789", b"!#$%&*+<=>@^_{|}~\\", b".,;:'\"?()-"


def measures(text: bytes) -> list[float]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, w = max(1, len(text)), max(1, len(words))
    count = lambda chars: len(text) - len(text.translate(None, chars))
    ends = sum(1 for x in words if x[-1] in MARKS)
    repeats = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    short = sum(1 for x in words if len(x) <= 3)
    return [
        np.log1p(len(words)), len(text) / w / 10, count(LETTERS) / n, count(UPPER) / n, count(DIGITS) / n, count(MARKS) / n * 5, count(PLAIN) / n * 5,
        ends / w, len(set(words)) / w, repeats / w, short / w, len(set(lines)) / max(1, len(lines)), len(lines) / w * 5, float(not words),
        min(1.0, count(MARKS) / w), min(1.0, max(map(len, words), default=0) / 100),
    ]


class Model:
    def __init__(self, rows: list[tuple[int, int, str]]):
        self.weights = None
        if len({y for _, y, _ in rows}) < 2:
            return
        x, y = np.array([measures(t.encode()) for _, _, t in rows]), np.array([float(y) for _, y, _ in rows])
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.weights = logistic(self.widen(x), y, steps=500)

    def widen(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([z, z * z / 4])

    def predict(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), 0.5)
        return sigmoid(self.widen(np.array([measures(t) for t in texts])) @ self.weights[:-1] + self.weights[-1])[:, 0]


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, rate: float) -> float:
    """Pseudo-count of the prior: how alike the groups are beyond the scatter that their sizes explain."""
    r = groups.filter("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - rate, 2)).alias("between"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r.k or r.k < 2 or r.n <= r.k:
        return 100.0
    within = r.within / (r.n - r.k)
    tau = (r.between - (r.k - 1) * within) / (r.n - r.nn / r.n)
    return float(np.clip(within / tau, 1.0, 1e6)) if tau > 0 else 1e6


def sites(scored: DataFrame, ws: Workspace) -> tuple[DataFrame, float, tuple[float, float], int]:
    """Sums of every path with those of its host (__host, __path, n, s, host_n, host_s), the global prior, the strengths
    of the priors of hosts and paths, and the number of rows."""
    sums = F.count(F.lit(1)).alias("n"), F.sum("__p").alias("s"), F.sum(F.col("__p") * F.col("__p")).alias("q")
    paths = ws.save(scored.select("__host", "__path", "__p").groupBy("__host", "__path").agg(*sums), "paths")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = total.s / total.n if total.n else 0.5
    both = paths.drop("q").join(hosts.select("__host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "__host")
    return both, prior, (strength(hosts, prior), strength(paths, prior)), total.n or 0


def posterior(p, n, s, host_n, host_s, prior: float, strengths: tuple[float, float]):
    """Posterior mean of a path without one of its documents, whose own evidence is p. Columns or numbers."""
    by_host, by_path = strengths
    host = (host_s - p + by_host * prior) / (host_n - 1 + by_host)
    return (s - p + by_path * host) / (n - 1 + by_path)


def weights(own: np.ndarray, site: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of both log-odds, neither negative, and the bias: a logistic fit by Newton steps, drawn to the defaults
    as by RIDGE documents."""
    default = np.array([OWN_WEIGHT, SITE_WEIGHT, 0.0])
    if len(y) < LEAST or len(set(y.tolist())) < 2:
        return tuple(default.tolist())
    x, w = np.stack([own, site, np.ones_like(own)], axis=1), default.copy()
    loss = lambda w: np.logaddexp(0, (1 - 2 * y) * (x @ w)).sum() + RIDGE / 2 * ((w - default) ** 2).sum()
    for _ in range(50):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + RIDGE * (w - default)
        step, size = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(3), slope), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return max(float(w[0]), 0.0), max(float(w[1]), 0.0), float(w[2])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fitted_weights(rows: DataFrame, by_path: DataFrame, left: list, model: Model, prior: float, strengths: tuple[float, float]) -> tuple[float, float, float]:
    """Weights from labelled documents (id, label, text) that the model has not seen; bounded by their number."""
    if not left:
        return OWN_WEIGHT, SITE_WEIGHT, 0.0
    ids = rows.sparkSession.createDataFrame([(i,) for i, _, _ in left], "doc_id bigint")
    places = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "__host", "__path").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("__host", "__path")).alias("at"))
    known = places.select("doc_id", "at.*").join(by_path, ["__host", "__path"]).collect()
    site = {r.doc_id: (r.n, r.s, r.host_n, r.host_s) for r in known}
    left = [x for x in left if x[0] in site]
    p = model.predict([t.encode() for _, _, t in left])
    mean = np.array([posterior(q, *site[i], prior, strengths) for q, (i, _, _) in zip(p, left, strict=True)])
    return weights(log_odds(p), log_odds(mean) - log_odds(np.array([prior])), np.array([float(y) for _, y, _ in left]))


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = 2000) -> DataFrame:
    """All columns of docs, with __own (the document's own probability), __score and __accepted."""
    spark = docs.sparkSession
    ws = Workspace(spark, "quality")
    sample = labelled_texts(docs, labels, "quality", most)
    fitted = Model([x for k, x in enumerate(sample) if k % 3])
    model = spark.sparkContext.broadcast(fitted)
    rows = docs.withColumns({"__host": F.coalesce(host.cast("string"), F.lit("")), "__path": F.coalesce(path.cast("string"), F.lit(""))})
    names = rows.columns

    def run(batches):
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.predict(texts), pa.float64())], names=[*names, "__p"])

    # Measured twice, for the sites and for the result, instead of writing a copy of all texts.
    with_p = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__p", T.DoubleType())]))
    by_path, prior, strengths, total = sites(with_p, ws)
    by_path = ws.save(by_path, "sites")
    a, b, c = fitted_weights(rows, by_path, sample[::3], fitted, prior, strengths)
    keys = ["__host", "__path"]
    by_path = by_path.select(*keys, *[F.col(x).alias(f"__{x}") for x in SUMS])
    if by_path.count() <= BROADCAST_SITES:
        joined = with_p.join(F.broadcast(by_path), keys)
    else:  # sites with many rows by broadcast, the rest in a shuffle
        hot = F.col("__n") >= max(1, HOT_SHARE * total)
        often = F.broadcast(by_path.filter(hot))
        joined = with_p.join(often, keys).unionByName(with_p.join(often, keys, "left_anti").join(by_path.filter(~hot), keys))
    mean = posterior(F.col("__p"), *[F.col(f"__{x}") for x in SUMS], prior, strengths)
    odds = a * logit(F.col("__p")) + b * (logit(mean) - logit(F.lit(prior))) + c
    score = F.when(F.lit(fitted.weights is None), 0.5).otherwise(1 / (1 + F.exp(-odds)))
    own = [F.col(f"`{x}`") for x in docs.columns]
    return joined.withColumn("__score", score).select(*own, F.col("__p").alias("__own"), "__score", (F.col("__score") >= 0.5).alias("__accepted"))


def of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Hosts are sources; a path is a source's part in one language."""
    return scored(docs, labels, F.col("source"), F.col("lang"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return of_documents(docs, labels).filter("__accepted").select(*[F.col(f"`{c}`") for c in docs.columns])


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return of_documents(docs, labels).select("doc_id", F.col("__own").alias("own_score"), F.col("__score").alias("score"), F.col("__accepted").cast("int").alias("predicted"))
