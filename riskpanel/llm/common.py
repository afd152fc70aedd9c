"""What the text operators share: tables, the shared folder, words, and Arrow output."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskpanel.session import ship_package

#: Characters that separate words, as a Java class: space and tab to carriage return. `bytes.split()` uses the same set.
SPACE = r"[\x20\x09-\x0D]"
CACHED = 50_000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that extra columns of any name cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named in spark.checkpoint.dir, removed when the session's JVM ends.

    Only a local master may fall back to a temporary folder, since executors elsewhere could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="riskpanel-llm-")
    folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def written(df: DataFrame, folder: str, name: str, compression: str = "snappy") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(docs: DataFrame, name: str) -> str:
    """`name`, with as many underscores as it takes to differ from all columns of `docs`."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id and text_key (hash of the text) are not in `found`; null ids are compared too."""
    id_name, key_name = unused(docs, "gone_id"), unused(docs, "gone_key")
    gone = found.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(id_name)) & (F.xxhash64(docs["text"]) == F.col(key_name))
    return docs.join(gone, same, "left_anti")


def looked_up(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` (a written table) left-joined with `found`, which has unique keys and in `n` how many of `total` rows hold each.

    Keys with more than a thousandth of all rows, so fewer than 1,000 of them, are broadcast and their rows stay where
    they are; only the rest is shuffled by the key.
    """
    often = found.filter(F.col("n") * 1000 > total)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(found.filter(F.col("n") * 1000 <= total), key, "left")
    return rows.join(F.broadcast(often), key).unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_array(text: Column, breaks: str = f"{SPACE}+") -> Column:
    """Words between `breaks`; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), breaks)
    return F.filter(parts, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: What a worker process keeps from one task to the next, by the work that needs it.
KEPT: dict[str, dict] = {}


def kept_for(work: str) -> dict:
    """What this worker keeps for `work`; it stays until a task of other work begins."""
    return KEPT.setdefault(work, {})


def forget_others(work: str | None) -> None:
    """Workers outlive their stages: whatever they keep for work other than this one goes, and its memory to the system."""
    others = [k for k in KEPT if k != work]
    for k in others:
        del KEPT[k]
    if others:
        gc.collect()
        pa.system_memory_pool().release_unused()


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str | None = None) -> DataFrame:
    """mapInArrow with this package at hand on the executors, and batches small enough for narrow ones.

    The session's bound on the bytes of an Arrow batch is lowered to BATCH_BYTES if it is above that: both the JVM and
    the Python worker hold whole batches outside the heap. Workers take memory from the system, which gets it back when a
    task ends; only what they keep for the work named by `keeps` stays for its next task.
    """
    spark = df.sparkSession
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (now := spark.conf.get(key).lower().removesuffix("b")).isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        forget_others(keeps)
        yield from work(batches)
        pa.system_memory_pool().release_unused()

    return df.mapInArrow(lean, schema)


def replaced(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one column's values exchanged."""
    arrays = [values if name == column else batch.column(i) for i, name in enumerate(batch.schema.names)]
    return pa.RecordBatch.from_arrays(arrays, batch.schema.names)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one at a time; null is empty."""
    for value in batch.column(column):
        yield value.as_py() or ""


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of the texts of a batch one at a time; null is empty."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


class Memo(dict):
    """Results of a function seen so far; emptied when full, so that memory stays bounded."""

    def __init__(self, work, longest: int = 64, size: int = CACHED):
        super().__init__()
        self.work, self.longest, self.size = work, longest, size

    def __missing__(self, key):
        value = self.work(key)
        if len(self) >= self.size:
            self.clear()
        if len(key) <= self.longest:
            self[key] = value
        return value
