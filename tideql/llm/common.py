"""What the operators share: reading tables, shared storage, word bytes, training rows."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte table that lower-cases A-Z only.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Rows of a few numbers each up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000
WHITE = r"[\x20\x09-\x0D]+"


@functools.lru_cache(1)
def keep_memory() -> None:
    """On an executor, once a process: up to 64 MB of freed memory stay with the process.
    Else glibc gives back a step's arrays after each step, and the kernel clears them again."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # not glibc: nothing to set
        return
    # malloc.h: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_TOP_PAD
    for option, size in ((-3, 32 << 20), (-1, 64 << 20), (-2, 16 << 20)):
        mallopt(option, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    spark.checkpoint.dir. Unset: a new temporary folder, in local mode only."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tideql-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and what is
    computed once is not computed again when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def fields(batch: pa.RecordBatch, *names: str):
    """Python lists of a batch's columns."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y): labelled documents to learn from, whose crc32 remainder
    by 3 is not 1. At most `max_rows` labelled ids take part, those with the
    smallest id hashes: a bounded sample, and the same one on every run.
    Ids that are labelled twice count with the smaller label, null labels and ids
    not at all; of rows alike in doc_id the one with the least hash of its text stays, and
    of those the least text."""
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder("doc_id", 3) != 1))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # at most max_rows pairs of numbers: a proven bound
    rows = texts.join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"), F.col("y"))).alias("s")).select("doc_id", "s.text", "s.y")
