"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. A fingerprint of each normalised text is written with the row's id; texts stay where they are.
2. Every partition sends its distinct fingerprints, sorted and Rice-coded, to the owners of their ranges (``Golomb`` with a
   power of two as its parameter). An owner answers each sender with a bitmap of the fingerprints that others hold too, and
   the sender reads it beside its own fingerprints.
3. The senders' suspects, fingerprints that occur more than once anywhere, select the texts to compare. Those texts are
   grouped by their bytes, which settles fingerprints that collide. Groups are combined before the shuffle, so a text that
   a third of all rows share crosses it once for each partition.
4. Rows get their group's keeper by a join on the digest; digests of very many rows are broadcast.

Nulls and ties: a null text is empty; empty texts are equal. Among equal texts the most code points, then the smallest id
stays, a null id last; of rows that repeat an id and a text a single one stays. Texts of any length are compared whole. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, join_by_key, materialize, release_shuffles, session

#: Bits of a fingerprint. Collisions cost a comparison each, never a wrong answer.
FINGERPRINT_BITS = 48
#: Distinct fingerprints an owner gets from all partitions, about.
OWNER_ROWS = 2_000_000
#: Suspects (8 bytes each) that are broadcast; beyond that many they select texts by a shuffled semi-join.
BROADCAST_SUSPECTS = 2_000_000


def rice_encode(values: np.ndarray) -> tuple[bytes, bytes, int]:
    """Gaps of sorted distinct values as unary quotients and fixed-width remainders: (unary, remainders, width)."""
    gaps = np.diff(values, prepend=np.zeros(1, values.dtype)).astype(np.int64)
    mean = int(gaps.mean()) if len(gaps) else 1
    width = max(0, mean.bit_length() - 1)
    quotients = gaps >> width
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes(), width


def rice_decode(unary: bytes, rest: bytes, width: int, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * width).reshape(n, width).astype(np.int64)
    return np.cumsum((quotients << width) + (bits << np.arange(width)).sum(axis=1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text_sha256, fp, sender, row) of each row, by whole normalised text.

    Sender and row number are those of the partition that reads the text; they hold once the table is written.
    """
    work = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    work = work.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.regexp_replace("text", BLANK + "+", "").alias("norm"))
    return work.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), _fingerprint().alias("fp"), F.spark_partition_id().alias("sender"), F.monotonically_increasing_id().alias("row"))


def _fingerprint():
    return F.shiftrightunsigned(F.xxhash64("norm"), 64 - FINGERPRINT_BITS)


def suspects(prints: DataFrame, rows: int) -> DataFrame:
    """The distinct values of ``fp`` (48-bit integers) that more than one row of ``prints`` has."""
    owners = max(1, -(-rows // OWNER_ROWS), int(session(prints).conf.get("spark.sql.shuffle.partitions")))
    span = -(-(1 << FINGERPRINT_BITS) // owners)
    sent, bitmaps = "owner int, sender int, n int, width int, unary binary, rest binary, known binary", "sender int, owner int, bits binary"

    def send(key: tuple, held: pa.Table) -> pa.Table:
        values, counts = np.unique(held.column("fp").to_numpy(), return_counts=True)
        cuts, out = np.searchsorted(values, np.arange(owners + 1) * span), []
        for owner in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[owner], cuts[owner + 1]
            unary, rest, width = rice_encode(values[a:b] - owner * span)
            out.append((owner, key[0].as_py(), int(b - a), width, unary, rest, np.packbits(counts[a:b] > 1).tobytes()))
        return pa.Table.from_batches(list(_rows(out, sent)))

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        lists = table.to_pylist()
        values = [rice_decode(x["unary"], x["rest"], x["width"], x["n"]) for x in lists]
        every, counts = np.unique(np.concatenate(values), return_counts=True)
        again, out = every[counts > 1], []
        for x, own in zip(lists, values, strict=True):
            # ``known`` has the fingerprints that the sender itself holds twice; the bitmap adds those others hold.
            twice = np.unpackbits(np.frombuffer(x["known"], np.uint8), count=x["n"]).astype(bool) | np.isin(own, again, assume_unique=True)
            if twice.any():
                out.append((x["sender"], key[0].as_py(), np.packbits(twice).tobytes()))
        return pa.Table.from_batches(list(_rows(out, bitmaps)) or [_none(bitmaps)])

    def settle(key: tuple, held: pa.Table, answers: pa.Table) -> pa.Table:
        values, found = np.unique(held.column("fp").to_numpy()), [np.empty(0, np.int64)]
        cuts = np.searchsorted(values, np.arange(owners + 1) * span)
        for owner, bits in zip(answers.column("owner").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            own = values[cuts[owner] : cuts[owner + 1]]
            found.append(own[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)])
        return pa.table({"fp": pa.array(np.concatenate(found), pa.int64())})

    own = prints.select("sender", "fp")
    answers = own.groupBy("sender").applyInArrow(send, sent).groupBy("owner").applyInArrow(answer, bitmaps)
    # A bitmap has no fingerprints in it: only its sender knows what each bit stands for.
    return own.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(settle, "fp long").distinct()


def _rows(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    if rows:  # none: nothing to send
        yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _none(schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([], kinds[k]) for _, k in fields], [n for n, _ in fields])


def dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = materialize(fingerprints(docs))
    twice = materialize(suspects(prints, prints.count()))
    release_shuffles(session(docs))
    few = twice.count() <= BROADCAST_SUSPECTS
    work = docs.select(F.regexp_replace(F.coalesce("text", F.lit("")), BLANK + "+", "").alias("norm")).withColumn("fp", _fingerprint())
    compared = work.join(F.broadcast(twice) if few else twice, "fp", "left_semi")
    groups = compared.groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialize(groups.select(F.sha2("norm", 256).alias("text_sha256"), "group_size"))
    release_shuffles(session(docs))
    alone = materialize(join_by_key(prints.select("doc_id", "n_chars", "row", "text_sha256"), groups, "text_sha256", "group_size"))
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("smallest"), F.bitwise_not("row").alias("first"))).alias("best")
    keepers = alone.where("group_size is not null").groupBy("text_sha256", "group_size").agg(best)
    keepers = keepers.select("text_sha256", F.col("group_size").alias("size"), F.bitwise_not("best.smallest").alias("keep"), F.bitwise_not("best.first").alias("keeper"))
    single = alone.where("group_size is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    several = join_by_key(alone.where("group_size is not null").drop("group_size"), keepers, "text_sha256", "size")
    return single.unionByName(several.select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keeper")).alias("kept"), "text_sha256"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM texts
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
