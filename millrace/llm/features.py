"""Sparse text features and the labelled sample that classifiers learn from."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows a classifier learns from, at most: the rows with the smallest digests of their ids. Their texts are whole.
SAMPLE_ROWS = 6_000

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that no classifier learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents that aren't held out, written once; texts are whole.

    The few chosen ids are broadcast, so the scan for their texts shuffles nothing. Rows without an id or a label are left
    out; of rows that share an id the smallest text is taken, of labels that do the largest.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))


#: Counts of a text's features.
Counts = Callable[[str], dict[str, int]]


def vocabulary(sampled: DataFrame, count: Counts, least: int, most: int) -> dict[str, int]:
    """Features of at least ``least`` sampled texts, the ``most`` frequent first: so many reach the driver, and no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(x for text in batch.column("text").to_pylist() for x in count(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["feature", "n"])

    found = sampled.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    kept = found.orderBy(F.desc("n"), "feature").limit(most).select("feature").toArrow()
    return {x: i for i, x in enumerate(kept.column("feature").to_pylist())}


class Rows:
    """Sparse rows of a sample in order of doc_id: of each, the known features, their counts and the label."""

    def __init__(self, sampled: DataFrame, count: Counts, where: dict[str, int]) -> None:
        names = {"doc_id": pa.int64(), "label": pa.int32(), "ids": pa.binary(), "counts": pa.binary()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc_id, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True):
                    own = {where[x]: n for x, n in count(text).items() if x in where}
                    out.append((doc_id, label, np.fromiter(own, np.int32, len(own)).tobytes(), np.fromiter(own.values(), np.int32, len(own)).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), names.values(), strict=True)], list(names))

        rows = sampled.mapInArrow(run, "doc_id long, label int, ids binary, counts binary").toArrow().sort_by("doc_id")
        self.labels = rows.column("label").to_numpy().astype(np.int64)
        self.ids = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows.column("ids").to_pylist()]
        self.counts = [np.frombuffer(x, np.int32) for x in rows.column("counts").to_pylist()]


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, and runs of symbols. Case stays: it tells shouting from speech."""
    return _TOKEN.findall(text)


def shape(token: str) -> str:
    """What kind of token it is, for the many that a vocabulary doesn't hold."""
    if not token[0].isalnum():
        return f"<{token[:3]}>"
    kind = "d" if token.isdigit() else "A" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "a"
    return f"<{kind}{min(len(token), 12)}>"


def repetition(found: list[str]) -> dict[str, int]:
    """Features of how a text repeats itself, with counts that weigh as much as the whole text."""
    n = len(found)
    if n < 8:
        return {}
    distinct = len(set(found))
    again = sum(map(str.__eq__, found, found[1:])) + sum(map(str.__eq__, found, found[2:]))
    return {f"<distinct {n.bit_length() // 2} {10 * distinct // n}>": n, f"<again {min(9, 20 * again // n)}>": n}
