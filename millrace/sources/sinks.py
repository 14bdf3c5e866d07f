"""Writers: JSON lines, tar shards and submission files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import fill_missing, with_default


def json_lines(rows: DataFrame, path: str, order: str | None = None) -> None:
    """One record a line; sorted by range if an order is asked for, so that files follow each other in it."""
    (rows.orderBy(order) if order else rows).write.json(path)


def tar_shards(rows: DataFrame, key: str, suffix: str, data: str, samples: int) -> DataFrame:
    """(shard, tar): samples packed into tar files of at most ``samples`` members each, within a task."""

    def pack(names: list[str], contents: list[bytes]) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, content in zip(names, contents, strict=True):
                info = tarfile.TarInfo(f"{name}.{suffix}")
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), samples):
                part = batch.slice(start, samples)
                names = part.column("k").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([names[0]]), pa.array([pack(names, part.column("d").to_pylist())])], ["shard", "tar"])

    side = rows.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("d")).where("k is not null")
    return side.mapInArrow(run, "shard string, tar binary")


def submission(predictions: DataFrame, questions: DataFrame, key: str, answer: str) -> DataFrame:
    """All predictions, and an empty answer for each question without one."""
    return fill_missing(predictions, questions, key, answer)


def submission_by_question(predictions: DataFrame, questions: DataFrame, key: str, answer: str, image: str) -> DataFrame:
    """One row a question with its image; predictions of other questions are left out."""
    return with_default(questions.select(key, image), predictions, key, answer, "").select(image, answer)


def text_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    """A line for each row, each with a line feed."""
    rows.select(F.col(column).cast("string").alias("value")).write.text(path)


def json_list(rows: DataFrame, path: str) -> None:
    """A list of records in one file, each on a line of its own: for reports that are small enough to be read whole.

    Records are written one after the other, never collected into a single value.
    """
    last = rows.count()
    numbered = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).coalesce(1)
    lines = numbered.select(F.concat(F.when(F.monotonically_increasing_id() == 0, "[").otherwise(""), F.col("j"), F.when(F.monotonically_increasing_id() == last - 1, "]").otherwise(",")).alias("value"))
    (lines if last else rows.sparkSession.createDataFrame([("[]",)], "value string")).write.text(path)


def csv_table(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def feature_cache(rows: DataFrame, path: str, key: str, vector: str) -> None:
    """(key, vector) with vectors of unit length, in ranges of the key."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(vector, lambda x: F.try_divide(x, length).cast("float"))
    rows.select(key, unit.alias(vector)).repartitionByRange(key).write.parquet(path)
