"""Shared folders, sizes and small helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words, and what exact deduplication deletes.
BLANK = r"[\x20\x09-\x0D]"


#: Bytes of a row group of intermediate tables: a writer holds one in memory, and the default of 128 MB is much for texts.
ROW_GROUP_BYTES = 16 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; sets one only where it is unset.

    Without that setting only a local master gets a folder, since the executors of a cluster could not read it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", f"file://{top}")
    return f"{top.rstrip('/')}/millrace-{uuid.uuid4().hex}" if "://" in top else f"file://{top.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts the lineage and survives lost executors."""
    spark, path = session(df), shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete a folder when the driver ends: a result that reads it may be used until then."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)


#: Rows in a batch for Python: 10,000 whole texts, Spark's default, may take more memory than all else of a worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in smaller batches than by default, unless the session already asks for as small ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column of the table is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key() -> Column:
    """128 bits that tell rows apart by their id and whole text."""
    return F.struct(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64(F.lit(1), "text", "doc_id").alias("y"))


#: Rows of one key beyond which the key is joined by a broadcast of its own: at most rows / HOT_ROWS keys are.
HOT_ROWS = 100_000


def join_by_key(rows: DataFrame, side: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined to ``side``, which has one row a key and in ``count`` how many rows have it.

    Keys of more than ``HOT_ROWS`` rows are few, so they are broadcast and their rows stay where they are; all other keys
    are small enough for a task.
    """
    hot = side.where(F.col(count) > HOT_ROWS)
    if not hot.limit(1).count():
        return rows.join(side, key, "left")
    names = hot.select(key)
    rest = rows.join(F.broadcast(names), key, "left_anti").join(side.where(F.col(count) <= HOT_ROWS), key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    spark = session(df)
    with suppress(Exception):
        paths = {f.rpartition("/")[0] for f in df.inputFiles()}
        for path in paths:
            if "/millrace-" in path:
                jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished phases: it acts when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim_worker() -> None:
    """Give a Python worker's free memory back to the system: the worker lives on, and may wait while the JVM works."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def parts_for(df: DataFrame, total_bytes: int, target: int) -> int:
    """Partitions of about ``target`` bytes each, and at least the session's shuffle partitions."""
    least = int(session(df).conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total_bytes // target), 1)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text each, so that what Python holds of it stays small."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)
