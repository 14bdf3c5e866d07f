"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source, a target is set for each source, and a document is taken ``floor(rate)`` times plus once
more with a probability equal to the fraction, where ``rate`` is target by size of its source. The draw is a hash of the
document's id, its text and a seed, so runs agree on any cluster. Rows that repeat both are numbered, and draw apart.

Nulls and ties: a null text has no words, a null source is a source of its own (sorted last). Null ids draw by their texts,
and so do rows that share an id. A text of any length is one draw. An empty table gives no rows. Other columns pass through
``emit`` whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, session

#: Weights dealt to the sources in code-point order, again and again.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MAX_REPEATS = 3
#: Largest table of sources that is broadcast; beyond it the join is by source, salted.
BROADCAST_SOURCES = 100_000
SALTS = 64
#: Pairs of id and text that repeat, and are broadcast to number their rows; beyond that many the join is shuffled.
BROADCAST_REPEATS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) rows to (source, source_size, target): shares by weight, none above ``max_repeats`` times its size.

    Sharing the excess again and again ends at one level L with target = min(cap, L * weight). With the sources in order
    of cap / weight, the first whose share of what is left stays within its cap gives L. The windows see one row for each
    source, not for each document.
    """
    every = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, at = Window.orderBy(F.col("source").asc_nulls_last()), len(weights)
    named = every.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % at + 1))
    named = named.withColumn("cap", F.col("source_size") * max_repeats).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    named = named.withColumn("level", (F.col("total") - capped).cast("double") / left).withColumn("rank", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))
    level = F.min(fits).over(Window.partitionBy())["level"]
    return named.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def text_digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def numbered(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_nth``: how many rows with the same doc_id and digest come before it; the order among them is free.

    ``keys`` holds doc_id and digest of the same rows.

    Only rows that repeat both are counted: within each partition first, then over partitions, of which a window sees one
    row each. So no group of repeated rows comes together in one task.
    """
    key = ["doc_id", "digest"]
    again = materialize(keys.groupBy(*key).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")))
    many = again.count()
    if not many:
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    side = F.broadcast(again) if many <= BROADCAST_REPEATS else again
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    placed = rows.withColumn("_part", F.spark_partition_id())
    own = placed.join(side, same, "left_semi")
    counts = materialize(own.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n")))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("_part").alias("_of"), ahead.alias("_ahead"))
    within = own.withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.lit(0))) - 1)
    every = within.join(counts, same & (F.col("_part") == F.col("_of"))).withColumn("_nth", (F.col("_nth") + F.col("_ahead")).cast("long"))
    single = placed.join(side, same, "left_anti").withColumn("_nth", F.lit(0).cast("long"))
    return single.unionByName(every.select(*single.columns)).drop("_part")


def draw(doc_id: Column, digest: Column, nth: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a digest of the id, the text's digest and the row's number among such rows."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), digest, nth.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixing_plan(sized: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, rows: DataFrame | None = None) -> DataFrame:
    """Rows gain source_size, target and copies: those of ``sized`` (doc_id, source, size, digest), or ``rows`` of the same
    documents, which have doc_id, source and digest."""
    targets = materialize(source_targets(sized, weights, max_repeats).withColumnRenamed("source", "_source"))
    sized = numbered(sized if rows is None else rows, sized)
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("_source")), "left")
    else:
        salted = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        every = targets.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(every, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt2")), "left").drop("_salt", "_salt2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (draw(F.col("doc_id"), F.col("digest"), F.col("_nth"), seed) < rate - whole).cast("long")
    return joined.withColumn("copies", copies).drop("_source", "_nth")


def emit(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: each document as often as the plan takes it, with its own columns."""
    work = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col("doc_id"), F.col("source"), text_digest().alias("digest"))
    taken = mixing_plan(measured(docs), seed, weights, max_repeats, work).where("copies > 0")
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and digest, written once: counting words is the costly part."""
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_digest().alias("digest")))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    plan = mixing_plan(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, text) - 1 AS nth, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), every_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), named AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM every_source
), levels AS (
  SELECT *, row_number() OVER by_room AS rank,
         CAST(total - coalesce(sum(cap) OVER (by_room ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (by_room ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM named WINDOW by_room AS (ORDER BY cap / weight ASC, source ASC NULLS LAST)
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, rank) FROM levels WHERE level * weight <= cap) * weight) AS target
  FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || ':' || nth), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), taken AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CAST(draw < rate - floor(rate) AS BIGINT) AS copies FROM rated
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""
