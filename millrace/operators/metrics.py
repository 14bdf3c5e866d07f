"""Benchmark metrics as grouped aggregates. Per-row scores are expressions; groups are reduced with partial aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.sampling import summed_before


def soft_accuracy(answer: Column, truths: Column) -> Column:
    """Mean over the truths of min(1, how many of the other truths equal the answer / 3), from the count of matches."""
    n, c = F.size(truths), F.size(F.filter(truths, lambda t: t == answer))
    one = lambda x: F.least(F.lit(1.0), x / 3)
    return (c * one(F.greatest(c - 1, F.lit(0))) + (n - c) * one(c)) / n


def by_every_grouping(scored: DataFrame, score: str, *groups: str) -> DataFrame:
    """Mean of ``score`` overall and for each group alone, in one pass: (level, key, n, accuracy in percent)."""
    pairs = [F.struct(F.lit("overall").alias("level"), F.lit("").alias("key"))]
    pairs += [F.struct(F.lit(g).alias("level"), F.col(g).cast("string").alias("key")) for g in groups]
    rows = scored.select(score, F.explode(F.array(*pairs)).alias("g")).select(score, "g.*")
    return rows.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(score), 2).alias("accuracy"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance by the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def anls(answer: Column, truths: Column, least: float = 0.5) -> Column:
    """Best similarity with a truth, 0 below ``least``; both sides trimmed and in lower case."""
    best = F.array_max(F.transform(truths, lambda t: similarity(F.lower(F.trim(answer)), F.lower(F.trim(t)))))
    return F.when(best >= least, best).otherwise(0.0)


def binary_report(rows: DataFrame, group: str, label: Column, answer: Column) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and share of yes for each group; null where a divisor is 0."""
    both = rows.select(group, label.cast("int").alias("y"), answer.cast("int").alias("p"))
    n = both.groupBy(group).agg(*[F.count_if((F.col("y") == y) & (F.col("p") == p)).alias(k) for k, y, p in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))])
    every = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return n.select(
        group, "tp", "fp", "tn", "fn",
        ratio(F.col("tp") + F.col("tn"), every).alias("accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        ratio(F.col("tp") + F.col("fp"), every).alias("yes_ratio"),
    )


def rollup_accuracy(rows: DataFrame, hierarchy: list[str], correct: Column) -> DataFrame:
    """Micro averages from the finest level up to all rows; a null level stands for all of it."""
    return rows.withColumn("_c", correct.cast("long")).rollup(*hierarchy).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("_c") / F.count(F.lit(1)), 6).alias("accuracy"))


def capability_scores(rows: DataFrame, capabilities: str, score: str, run: str) -> DataFrame:
    """Per capability: mean over runs of 100 x mean score, and the population deviation over runs."""
    runs = rows.select(F.explode(F.array_distinct(capabilities)).alias("capability"), score, run).groupBy("capability", run).agg((100 * F.avg(score)).alias("s"))
    return runs.groupBy("capability").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("s"), 4).alias("score"), F.round(F.stddev_pop("s"), 4).alias("deviation"))


def capability_set_scores(rows: DataFrame, capabilities: str, score: str) -> DataFrame:
    key = F.array_join(F.array_sort(F.array_distinct(capabilities)), "_")
    return rows.groupBy(key.alias("capabilities")).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(score), 4).alias("score"))


def judge_summary(rows: DataFrame, category: str, first: str, second: str) -> DataFrame:
    """Mean scores of two answers per category and for all, and the second in percent of the first."""
    mean = rows.rollup(category).agg(F.avg(first).alias("a"), F.avg(second).alias("b"), F.grouping(category).alias("g"))
    name = F.when(F.col("g") == 1, "all").otherwise(F.col(category))
    return mean.select(name.alias("category"), F.round(100 * F.try_divide(F.col("b"), F.col("a")), 1).alias("ratio"), F.round(10 * F.col("a"), 1).alias("first"), F.round(10 * F.col("b"), 1).alias("second"))


def trial_summary(rows: DataFrame, group: str, score: str) -> DataFrame:
    """Mean and population deviation over trials; missing scores are left out."""
    s = F.nanvl(F.col(score), F.lit(None).cast("double"))
    return rows.groupBy(group).agg(F.count(s).alias("trials"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("deviation"))


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney statistic with halves for ties.

    Rows are counted for each distinct score first; only those counts are put in order, by ranges of scores.
    """
    counts = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    won = summed_before(counts, score, "neg", "below").withColumn("won", 2 * F.col("pos") * F.col("below") + F.col("pos") * F.col("neg"))
    total = won.agg(F.sum("won").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return total.select(F.col("p").alias("n_pos"), F.col("q").alias("n_neg"), F.round(F.try_divide(F.col("w"), 2 * F.col("p") * F.col("q")), 6).alias("auc"))


def top_classes(scores: Column, k: int) -> Column:
    """The k best places of an array, from 0, with their softmax shares; ties keep their order."""
    best = F.slice(F.sort_array(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))), 1, k)
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(best, lambda b: F.struct(b["i"].cast("long").alias("place"), F.round(F.exp(-b["s"] - top) / total, 6).alias("share")))


def first_mode(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones, the one seen first."""
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_at"))
    return n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), "_at", value)).alias("b")).select(group, F.col(f"b.{value}").alias(value), (-F.col("b.m")).alias("n"))


def is_consistent(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Groups with whether each column has one value in them."""
    return rows.groupBy(group).agg(*[(F.min(c) == F.max(c)).alias(f"one_{c}") for c in columns])


def sequence_length(texts: Column, images: Column, per_image: int = 576) -> Column:
    """Words of all texts and a fixed number for each image; negative without images."""
    words = F.aggregate(texts, F.lit(0), lambda a, t: a + F.size(F.array_remove(F.split(t, r"\s+"), "")))
    return F.when(images > 0, words + per_image * images).otherwise(-words)


def lower_words(t: Column) -> Column:
    return F.array_remove(F.split(F.lower(t), r"\s+"), "")


def n_grams(words: Column, order: int) -> Column:
    """(n, g) of every run of 1 to ``order`` words."""

    def of_length(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(words, i, F.lit(n)), " ").alias("g")))

    return F.flatten(F.array(*map(of_length, range(1, order + 1))))


def bleu(pairs: DataFrame, key: str, prediction: str, reference: str, order: int = 4) -> DataFrame:
    """Corpus BLEU with one reference: clipped n-gram counts, geometric mean and brevity penalty. ``key`` is one row's."""
    rows = pairs.select(F.col(key).alias("row"), lower_words(F.col(prediction)).alias("p"), lower_words(F.col(reference)).alias("r"))

    def grams(side: str) -> DataFrame:
        return rows.select("row", F.explode(n_grams(F.col(side), order)).alias("x")).groupBy("row", "x.n", "x.g").agg(F.count(F.lit(1)).alias(f"c_{side}"))

    hit = grams("p").join(grams("r"), ["row", "n", "g"], "left").groupBy("n").agg(F.sum(F.least("c_p", F.coalesce("c_r", F.lit(0)))).alias("hit"), F.sum("c_p").alias("all"))
    length = rows.agg(F.sum(F.size("p")).alias("lp"), F.sum(F.size("r")).alias("lr"))
    mean = hit.agg(F.avg(F.log(F.col("hit") / F.col("all"))).alias("m"), F.count(F.lit(1)).alias("orders"))
    penalty = F.when(F.col("lp") > F.col("lr"), 1.0).otherwise(F.exp(1 - F.col("lr") / F.col("lp")))
    return mean.join(length).select(F.round(F.when(F.col("orders") == order, F.coalesce(penalty * F.exp("m"), F.lit(0.0))).otherwise(0.0), 6).alias("bleu"))


def cider(rows: DataFrame, key: str, candidate: str, references: str, order: int = 4, sigma: float = 6.0, words: Callable[[Column], Column] = lower_words, places: int = 6) -> DataFrame:
    """(key, cider) of each row's candidate against its array of references: TF-IDF cosines of n-grams with clipped counts
    and a penalty for a difference in length, mean over references and n, times 10. Null without references.

    A document of the inverse frequencies is a row's references together. n-grams meet their frequencies by sorting: their
    number is guessed far too small from the files, and they'd be broadcast.
    """
    sides = F.concat(F.array(F.col(candidate)), F.coalesce(F.col(references), F.array().cast("array<string>")))
    texts = rows.select(key, F.posexplode(sides).alias("side", "t")).select(key, "side", words(F.col("t")).alias("w"))
    grams = texts.select(key, "side", F.greatest(F.size("w") - 1, F.lit(0)).alias("length"), F.explode(n_grams(F.col("w"), order)).alias("x"))
    counts = grams.groupBy(key, "side", "length", "x.n", "x.g").agg(F.count(F.lit(1)).alias("tf"))
    frequency = counts.where("side > 0").select(key, "n", "g").distinct().groupBy("n", "g").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(max(rows.count(), 1)))) - F.log(F.coalesce("df", F.lit(1)).cast("double"))
    ours = lambda x, *by: F.max(F.when(F.col("side") == 0, F.col(x))).over(Window.partitionBy(key, *by))
    paired = counts.withColumn("our_tf", F.coalesce(ours("tf", "n", "g"), F.lit(0)))
    weighed = paired.join(frequency.hint("merge"), ["n", "g"], "left").select(key, "side", "length", "n", (F.col("tf") * idf).alias("weight"), (F.col("our_tf") * idf).alias("our_weight"))
    sums = weighed.groupBy(key, "n", "side", "length").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.sum(F.least("our_weight", "weight") * F.col("weight")).alias("dot"))
    near = sums.select("*", ours("norm", "n").alias("our_norm"), ours("length", "n").alias("our_length")).where("side > 0")
    gap = F.col("our_length") - F.col("length")
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("our_norm")), F.lit(0.0))
    total = near.groupBy(key).agg(F.sum(cosine * F.exp(-gap * gap / (2 * sigma**2))).alias("total"))
    sized = rows.select(key, F.coalesce(F.size(F.col(references)), F.lit(0)).alias("n"))
    return sized.join(total.hint("merge"), key, "left").select(key, F.when(F.col("n") > 0, F.round(10 * F.coalesce("total", F.lit(0.0)) / (order * F.col("n")), places)).alias("cider"))


def conditional_accuracy(answer: Column, truths: Column, normalise: Callable[[Column], Column]) -> Column:
    """Soft accuracy, of normalised texts if the truths differ among themselves."""
    differ = F.size(F.array_distinct(truths)) > 1
    return F.when(differ, soft_accuracy(normalise(answer), F.transform(truths, normalise))).otherwise(soft_accuracy(answer, truths))


def contained(answer: Column, truths: Column) -> Column:
    """1 if the answer is one of the truths."""
    return F.array_contains(truths, answer).cast("double")


def accuracy(rows: DataFrame, right: Column, subset: Column, *groups: str) -> DataFrame:
    """Rows, right ones and their share, of all rows and of a subset; null shares where there are none."""
    both = rows.select(*groups, right.alias("r"), subset.alias("s"))
    share = lambda a, b: F.round(F.try_divide(100 * F.col(a), F.col(b)), 4)
    n = both.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if("r").alias("n_right"), F.count_if("s").alias("n_subset"), F.count_if(F.col("r") & F.col("s")).alias("n_subset_right"))
    return n.select("*", share("n_right", "n").alias("acc"), share("n_subset_right", "n_subset").alias("subset_acc"))


def ensemble(rows: DataFrame, ours: Column, other: Column, third: Column | None = None) -> DataFrame:
    """Right or wrong answers of two or three sources, null where one failed: ours alone, ours where the other failed, the
    third before both, any of them, and how often the other and the third are missing."""
    third = F.lit(None).cast("boolean") if third is None else third
    both = rows.select(ours.alias("a"), other.alias("b"), third.alias("c"))
    yes = lambda *xs: F.count_if(F.coalesce(*xs, F.lit(False)))
    either = F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False)) | F.coalesce("c", F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("n"), yes("a").alias("ours"), yes("b", "a").alias("fallback"), yes("c", "b", "a").alias("requeried"), F.count_if(either).alias("upper_bound"), F.count_if(F.col("b").isNull()).alias("failed"), F.count_if(F.col("c").isNull()).alias("missing"))


def ensemble_mean(rows: DataFrame, key: str, choice: str, score: str) -> DataFrame:
    """Mean score of each choice over repetitions, and the best choice of each key."""
    mean = rows.groupBy(key, choice).agg(F.avg(score).alias("score"))
    return mean.groupBy(key).agg(F.max_by(choice, F.struct("score", choice)).alias(choice), F.max("score").alias("score"))


def sequence_score(scores: Column, mean: bool = True) -> Column:
    """Sum of token scores, by their number if asked for."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return total / F.size(scores) if mean else total


def count_samples(rows: DataFrame, batch: int) -> DataFrame:
    """Elements, and batches that they fill."""
    return rows.agg(F.count(F.lit(1)).alias("n_elements"), F.ceil(F.count(F.lit(1)) / batch).alias("n_batches"))


def throughput(rows: DataFrame, at: str, samples: str, world: int) -> DataFrame:
    """Samples a second between the first and the last report, and for each of ``world`` workers."""
    when = F.unix_micros(F.col(at).cast("timestamp"))
    span = F.max(when) - F.min(when)
    total = rows.agg(F.sum(samples).alias("samples"), (span / 1e6).alias("seconds"))
    return total.select("samples", "seconds", F.round(F.try_divide("samples", "seconds"), 6).alias("per_second"), F.round(F.try_divide(F.col("samples"), F.col("seconds") * world), 6).alias("per_worker"))
