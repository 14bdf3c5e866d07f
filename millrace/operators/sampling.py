"""Sampling, partitioning and batching that give the same rows on any cluster: draws are digests of ids and seeds."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each key and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def bernoulli(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    return rows.where(draw(F.col(key), seed) < share)


def take_random(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement; a top-n of the draws, not a full sort."""
    return rows.orderBy(draw(F.col(key), seed), key).limit(n)


def one_per_group(rows: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """A random row of each group, by an aggregate that combines before the shuffle."""
    columns = [c for c in rows.columns if c != group]
    best = rows.groupBy(group).agg(F.min_by(F.struct(*columns), F.struct(draw(F.col(key), seed), F.col(key))).alias("r"))
    return best.select(group, *[F.col(f"r.{c}").alias(c) for c in columns])


def pinned(rows: DataFrame) -> DataFrame:
    """Rows computed once and kept in the checkpoint folder that the session names; a folder of our own only without one."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return rows.checkpoint()


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows with their place ``pos`` from 0.

    Rows are sorted by range; places are counted within each range and shifted by the sizes of the ranges before it, so no
    task sees all rows. Only one count for each range reaches the driver.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, order).sortWithinPartitions(order)
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = pinned(placed)  # the ranges are sampled, so a second run of the plan could cut them elsewhere
    sizes = dict(placed.groupBy("_part").count().collect())
    ahead, before = 0, []
    for p in range(n):
        before.append(ahead)
        ahead += sizes.get(p, 0)
    shift = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_part") + 1)
    return placed.withColumn("pos", F.col("_row") + shift).drop("_part", "_row")


def summed_before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of a whole-number ``value`` over all rows before them, for an ``order`` without ties.

    As in ``numbered``, sums are made within ranges and shifted by the totals of the ranges before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pinned(rows.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    ahead, before = 0, [0] * n
    totals = dict(placed.groupBy("_part").agg(F.sum(value)).collect())
    for p in range(n):
        before[p] = ahead
        ahead += totals.get(p) or 0
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_part") + 1)
    return placed.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)) + shift).drop("_part")


def round_robin(rows: DataFrame, order: str, ranks: int) -> DataFrame:
    return numbered(rows, order).withColumn("rank", F.pmod("pos", F.lit(ranks)).cast("int"))


def balanced_chunks(rows: DataFrame, order: str, chunks: int) -> DataFrame:
    """Contiguous chunks whose sizes differ by one at most, the larger first."""
    total = rows.count()
    small, larger = divmod(total, chunks)
    pos, edge = F.col("pos"), larger * (small + 1)
    chunk = F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(larger + F.floor((pos - edge) / max(small, 1)))
    return numbered(rows, order).withColumn("chunk", chunk.cast("int"))


def even_chunks(rows: DataFrame, order: str, chunks: int) -> DataFrame:
    """Contiguous chunks of the rounded-up size; the last may be short or missing."""
    size = max(1, -(-rows.count() // chunks))
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("pos") / size).cast("int"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Full batches in order; a last short one is dropped."""
    total = rows.count() // size * size
    return numbered(rows, order).where(F.col("pos") < total).withColumn("batch", F.floor(F.col("pos") / size))


def length_groups(rows: DataFrame, key: str, length: str, batch: int, world: int, seed: int = 0) -> DataFrame:
    """Random megabatches of world x batch rows, each in descending order of length, cut into batches.

    ``key`` orders ties. Only the sort within a megabatch, whose size is fixed, needs its rows together.
    """
    mixed = rows.withColumn("_d", draw(F.col(key), seed))
    placed = numbered(mixed, "_d").withColumn("megabatch", F.floor(F.col("pos") / (batch * world)))
    inside = F.row_number().over(Window.partitionBy("megabatch").orderBy(F.desc(length), key)) - 1
    return placed.withColumn("place", inside).withColumn("slot", F.floor(F.col("place") / batch).cast("int")).drop("_d", "pos")


def resample(shards: DataFrame, order: str, n: int, seed: int = 0) -> DataFrame:
    """n draws of shards with replacement: (draw, and the shard's columns)."""
    total = shards.count()
    picks = shards.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(draw(F.col("id"), seed) * total).alias("pos"))
    return picks.join(numbered(shards, order), "pos").drop("pos")
