"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, then exact comparison.

1. Windows. A window has the item's length, cut at the document's ends, and may begin at any word. One alike enough holds at
   least ``THRESHOLD`` times as many places with a shingle of the item as the item has shingles, whatever their order. The
   starts of all windows that do are ranges between those places, and every start in them is proposed.
2. SimHash. Each proposed window and each item gets a 64-bit fingerprint of its shingles, each weighing as often as it
   occurs. Fingerprints are cut into ``RADIUS + 1`` blocks; two within ``RADIUS`` bits agree on one block at least, so a
   join on (item, block, value) finds all of them.
3. Verification. Weighted Jaccard of the shingle multisets, exact, from the shared shingles: the sum of the smaller counts
   by the sum of the larger ones, at least ``THRESHOLD``.

At 0.75 the shingles of window and item differ in 11 of 64 bits on average (cosine 0.86); 20 is three deviations more.

Shingles are five words, lower-cased; an item of fewer words is one shingle. Nulls and ties: a null or empty text or item
matches nothing. Rows that repeat a document count once, and ``clean`` drops them all; texts of any length are read whole; of equally similar windows the first is given at which a shared
shingle has its place of the item, or else the first. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, materialize, session

SHINGLE = 5
THRESHOLD = 0.75
RADIUS = 20
#: Shingles of items (16 bytes and up each) that are broadcast; beyond that many the join is shuffled.
BROADCAST_SHINGLES = 1_000_000
#: Proposed windows whose documents are found by a broadcast.
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BLANK + "+"), "")


def shingle_hashes(ws: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, in order; none if there are fewer words."""
    none = F.array().cast("array<bigint>")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    # The outer lambda binds the words once; named twice in an expression, they would be split again for every run.
    return F.element_at(F.transform(F.array(ws), lambda w: F.when(F.size(w) >= k, runs(w)).otherwise(none)), 1)


def fingerprint(h: Column) -> Column:
    """SimHash of the grouped hashes ``h``: bit b is set where most of them have it set."""
    votes = [F.sum(F.getbit(h, F.lit(b)).cast("int") * 2 - 1) for b in range(64)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft((v > 0).cast("long"), b) for b, v in enumerate(votes)])


def blocks(fp: Column) -> Column:
    """``RADIUS + 1`` (block, value) pairs that cover the 64 bits."""
    cuts = [64 * b // (RADIUS + 1) for b in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftright(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))])


def _cut(docs: DataFrame, k: int) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row"), shingle_hashes(words(F.col("text")), k).alias("hs"))


def _proposed(shared: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """(key, len, k, lo, hi): disjoint ranges of the starts of all windows with enough places of shared shingles.

    A start after place ``i - 1`` and up to place ``i`` has ``least`` places within reach if place ``i + least - 1`` is.
    """
    least = F.greatest(F.ceil(threshold * (F.col("len") - F.col("k") + 1) - 1e-9).cast("int"), F.lit(1))
    placed = shared.groupBy(*key, "len", "k").agg(F.array_sort(F.collect_set("p")).alias("ps")).withColumn("least", least).where(F.size("ps") >= F.col("least"))
    before = lambda i: F.coalesce(F.get("ps", i - 1) + 1, -F.col("len"))
    last = lambda i: F.get("ps", i + F.col("least") - 1) - F.col("len") + F.col("k")
    ranges = F.transform("ps", lambda p, i: F.struct(F.greatest(last(i), before(i)).alias("lo"), p.alias("hi"), last(i).isNotNull().alias("enough")))
    found = placed.select(*key, "len", "k", F.explode(F.filter(ranges, lambda r: r["enough"] & (r["lo"] <= r["hi"]))).alias("r"))
    return found.select(*key, "len", "k", "r.lo", "r.hi")


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, item_id, start_word, similarity, distance): each document and item alike enough, at its best window.

    ``row`` is xxhash64 of the text, so that rows which share an id stay apart.
    """
    cut = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0).select("item_id", "ws", F.size("ws").alias("len"), F.least(F.size("ws"), F.lit(SHINGLE)).alias("k"))
    sizes = [r.k for r in cut.select("k").distinct().collect()]  # at most SHINGLE values
    none = "doc_id long, row long, item_id long, start_word int, similarity double, distance int"
    if not sizes:
        return session(docs).createDataFrame([], none)
    shingled = reduce(DataFrame.unionByName, [cut.where(F.col("k") == k).select("item_id", "len", "k", F.posexplode(shingle_hashes(F.col("ws"), k)).alias("q", "h")) for k in sizes])
    shingled = materialize(shingled)
    few = shingled.count() <= BROADCAST_SHINGLES
    prints = materialize(shingled.groupBy("item_id").agg(fingerprint(F.col("h")).alias("item_fp")))
    counts = shingled.groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("in_item"), F.collect_set("q").alias("qs"))
    texts = docs.select("doc_id", "text").where("text is not null")

    shared = []
    for k in sizes:
        own = shingled.where(F.col("k") == k).select("h", "item_id", "len").distinct()
        exploded = _cut(texts, k).select("doc_id", "row", F.posexplode("hs").alias("p", "h"))
        shared.append(exploded.join(F.broadcast(own) if few else own, "h").withColumn("k", F.lit(k)))
    shared = materialize(reduce(DataFrame.unionByName, shared).distinct())

    key = ["doc_id", "row", "item_id"]
    same = lambda a, b, names: reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])
    windows = materialize(_proposed(shared, key, threshold))
    few_windows = windows.count() <= BROADCAST_WINDOWS
    printed = []
    for k in sizes:
        own = windows.where(F.col("k") == k)
        wanted = own.groupBy("doc_id", "row").agg(F.collect_set(F.struct("item_id", "len", "lo", "hi")).alias("ws")).withColumnsRenamed({"doc_id": "_d", "row": "_r"})
        hit = texts.withColumn("row", F.xxhash64("text")).dropDuplicates(["doc_id", "row"]) if not few_windows else texts.withColumn("row", F.xxhash64("text"))
        wanted = F.broadcast(wanted) if few_windows else wanted
        hit = hit.join(wanted, hit["doc_id"].eqNullSafe(wanted["_d"]) & (hit["row"] == wanted["_r"]))
        hit = hit.dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "ws", shingle_hashes(words(F.col("text")), k).alias("hs"))
        one = hit.select("doc_id", "row", "hs", F.explode("ws").alias("w")).select("doc_id", "row", "hs", "w.item_id", "w.len", F.explode(F.sequence("w.lo", "w.hi")).alias("s"))
        one = one.select("doc_id", "row", "item_id", "len", "s", F.expr(f"slice(hs, greatest(s, 0) + 1, greatest(least(s + len - {k} + 1, size(hs)) - greatest(s, 0), 0))").alias("inside"))
        printed.append(one.select("doc_id", "row", "item_id", "len", "s", F.lit(k).alias("k"), F.size("inside").alias("n"), F.explode("inside").alias("h")))
    printed = materialize(reduce(DataFrame.unionByName, printed).groupBy(*key, "len", "s", "k", "n").agg(fingerprint(F.col("h")).alias("fp")))

    left = printed.withColumn("b", F.explode(blocks(F.col("fp")))).select("*", "b.block", "b.value").drop("b")
    right = prints.withColumn("b", F.explode(blocks(F.col("item_fp")))).select("item_id", "item_fp", "b.block", "b.value")
    near = left.join(right, ["item_id", "block", "value"]).select(*key, "len", "s", "k", "n", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance"))
    near = near.where(F.col("distance") <= RADIUS).distinct()

    # A window reaches over two stretches of its own length, so the join on stretches brings what it needs, and no more.
    spots = shared.select(*key, "h", "p", F.floor(F.col("p") / F.col("len")).alias("stretch")).distinct()
    first = F.floor(F.col("s") / F.col("len"))
    near = near.withColumn("stretch", F.explode(F.array(first, first + 1)))
    both = near.alias("a").join(spots.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.stretch") == F.col("b.stretch")))
    both = both.where((F.col("p") >= F.col("s")) & (F.col("p") <= F.col("s") + F.col("len") - F.col("k"))).select("a.doc_id", "a.row", "a.item_id", "s", "n", "distance", "len", "k", "h", "p").join(counts, ["item_id", "h"])
    in_place = F.max(F.array_contains("qs", F.col("p") - F.col("s"))).alias("in_place")
    tally = both.groupBy(*key, "s", "n", "distance", "len", "k", "h", "in_item").agg(F.count(F.lit(1)).alias("in_window"), in_place)
    overlap = tally.groupBy(*key, "s", "n", "distance", "len", "k").agg(F.sum(F.least("in_window", "in_item")).alias("both"), F.max("in_place").alias("in_place"))
    similarity = F.col("both") / (F.col("n") + F.col("len") - F.col("k") + 1 - F.col("both"))
    kept = overlap.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    best = F.min(F.struct((-F.col("similarity")).alias("less"), (~F.col("in_place")).alias("moved"), F.greatest("s", F.lit(0)).alias("start_word"), "distance")).alias("best")
    return kept.groupBy(*key).agg(best).select(*key, "best.start_word", (-F.col("best.less")).alias("similarity"), "best.distance")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that match no item, with their own columns."""
    found = materialize(matches(docs, items, threshold).select(F.col("doc_id").alias("_hit_id"), F.col("row").alias("_hit_row")).distinct())
    hit = F.broadcast(found) if found.count() <= BROADCAST_WINDOWS else found
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs["text"]) == hit["_hit_row"]), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "start_word")).alias("best"))
    return best.select("doc_id", "item_id", "best.start_word", F.round(-F.col("best.less"), 6).alias("similarity"))


SQL = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT item_id, ws, len(ws) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM benchmark) WHERE len(ws) > 0),
item_sizes AS (SELECT *, least(n, 5) AS k FROM item_words),
item_shingles AS (SELECT item_id, n, k, q, array_to_string(ws[q + 1 : q + k], chr(31)) AS shingle FROM (SELECT *, unnest(range(0, n - k + 1)) AS q FROM item_sizes)),
doc_shingles AS (SELECT doc_id, size, k, p, array_to_string(ws[p + 1 : p + k], chr(31)) AS shingle
  FROM (SELECT doc_id, ws, len(ws) AS size, k, unnest(range(0, len(ws) - k + 1)) AS p FROM doc_words, (SELECT DISTINCT k FROM item_sizes))),
shared AS (SELECT doc_id, size, item_id, n, i.k, p, q, shingle FROM doc_shingles d JOIN item_shingles i USING (k, shingle)),
places AS (SELECT DISTINCT doc_id, size, item_id, n, k, p, shingle FROM shared),
pairs AS (SELECT doc_id, size, item_id, n, k FROM places GROUP BY ALL HAVING count(*) >= 0.75 * (n - k + 1)),
windows AS (SELECT *, unnest(range(k - n, size - k + 1)) AS s FROM pairs),
in_window AS (SELECT w.doc_id, w.size, w.item_id, w.n, w.k, w.s, shingle, count(*) AS c
  FROM windows w JOIN places h ON w.doc_id = h.doc_id AND w.item_id = h.item_id AND h.p BETWEEN w.s AND w.s + w.n - w.k GROUP BY ALL),
in_item AS (SELECT item_id, shingle, count(*) AS c FROM item_shingles GROUP BY ALL),
overlap AS (SELECT doc_id, size, item_id, n, k, s, sum(least(w.c, i.c)) AS both_have FROM in_window w JOIN in_item i USING (item_id, shingle) GROUP BY ALL),
in_place AS (SELECT DISTINCT doc_id, item_id, p - q AS s, false AS moved FROM shared),
scored AS (SELECT doc_id, item_id, greatest(s, 0) AS start_word, coalesce(moved, true) AS moved,
  both_have / (least(s + n, size) - greatest(s, 0) - k + 1 + n - k + 1 - both_have) AS similarity FROM overlap LEFT JOIN in_place USING (doc_id, item_id, s))
SELECT doc_id, item_id, CAST(arg_min(start_word, (-similarity, moved, start_word)) AS INTEGER) AS start_word, round(max(similarity), 6) AS similarity
FROM scored WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""
