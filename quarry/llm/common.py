"""What the operators of this subpackage share: staged tables, text batches and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the licence and benchmark contracts: lower-case A-Z, then runs of a-z, 0-9 and non-ASCII characters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


class Workspace:
    """Intermediate Parquet tables in the folder that spark.checkpoint.dir names.

    A written table cuts lineage and survives lost executors. Where the setting is unset, a local master (tests) gets a
    temporary folder, and a cluster an error.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="quarry-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def located(df: DataFrame, ws: Workspace) -> DataFrame:
    """The rows with __locator (file, row): where in the stored files each stands, the same in every scan.

    A plain read of files (columns chosen, rows filtered) has it at no cost; other tables are written to `ws` first.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("__locator")
    node = df._jdf.queryExecution().analyzed()
    # Allowed: chosen columns and filtered rows of one relation, by expressions that give the same in every scan.
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().apply(0)
    if node.nodeName().startswith(("LogicalRelation", "Relation")) and node.deterministic():
        try:
            return df.select("*", place)
        except AnalysisException:
            pass
    return ws.save(df, "located").select("*", place)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows handled together by the functions below, so that very long texts don't add up.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that the texts of each come to `size` at most, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def map_text(df: DataFrame, fn: Callable[[list], dict], schema: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", as_bytes: bool = False, size: int = SLICE_BYTES) -> DataFrame:
    """One output row for each row: `keep` columns, and the columns that fn makes of a list of texts (null: empty).

    Runs as one Arrow map over the scan, with no shuffle.
    """
    kept = [df.schema[c] for c in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, size):
            column = batch.column(text)
            values = (column.cast(pa.binary()) if as_bytes else column).to_pylist()
            empty = b"" if as_bytes else ""
            made = fn([empty if v is None else v for v in values])
            arrays = [batch.column(c) for c in keep] + [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])

    return df.select(*keep, text).mapInArrow(run, ddl)


def lower_ascii(text):
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def hash_words(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def roll(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words."""
    n = len(hashes) - k + 1
    out = np.full(max(n, 0), np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k if n > 0 else 0):
            out = (out ^ hashes[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return out
