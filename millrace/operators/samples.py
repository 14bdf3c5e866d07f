"""Shaping of training samples: validity, selection, turns, answers, interleaving with images, shuffles and resumption."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean_markers, without_first
from millrace.operators.arrange import END, END_OF_CHUNK, IGNORED, IMAGE
from millrace.operators.sampling import draw, numbered

# Selection.


def first_of(rows: DataFrame, *columns: str) -> Column:
    """The first of the named columns that is there and not null."""
    return F.coalesce(*[F.col(c) for c in columns if c in rows.columns], F.lit(None))


def valid_samples(rows: DataFrame, text: str = "txt", images: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """Rows with a text and one of the images."""
    return rows.where(F.col(text).isNotNull() & first_of(rows, *images).isNotNull())


def large_enough(content: Column, kilobytes: int = 10) -> Column:
    """More than ``kilobytes`` thousands of bytes, counted in whole thousands: 11,000 bytes and up for 10."""
    return F.floor(F.octet_length(content) / 1000) > kilobytes


def pick(values: Column, places: Column) -> Column:
    """The values at the places, in their order."""
    return F.transform(places, lambda i: F.get(values, i))


def unwrap(values: Column) -> Column:
    """The first element of each element."""
    return F.transform(values, lambda x: F.get(x, 0))


def of_split(rows: DataFrame, split: str, column: str = "split") -> DataFrame:
    return rows.where(F.col(column) == split)


def selected(rows: DataFrame, **choices: list | None) -> DataFrame:
    """Rows whose columns are among the choices; a choice of None, or of nothing, leaves its column free."""
    return reduce(lambda r, c: r.where(F.col(c[0]).isin(*c[1])), [(k, v) for k, v in choices.items() if v], rows)


def ignoring(rows: DataFrame, key: str, ignored: list) -> DataFrame:
    """Rows whose key is not to be ignored; null keys stay."""
    return rows.where(~F.coalesce(F.col(key).isin(*ignored), F.lit(False))) if ignored else rows


def of_category(answers: DataFrame, questions: DataFrame, key: str, category: str, value: str) -> DataFrame:
    """Answers whose question has the category."""
    return answers.join(questions.where(F.col(category) == value).select(key), key, "left_semi")


def checked(rows: DataFrame, parse: Callable[[Column], Column], column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose column parses, with what it gives, and the others as they are: a table of rejects."""
    tried = rows.withColumn("_parsed", parse(F.col(column)))
    return tried.where("_parsed is not null").withColumn(column, F.col("_parsed")).drop("_parsed"), tried.where("_parsed is null").drop("_parsed")


# Turns and answers.


def asks_for(turns: Column, prompt: str, at_least: int = 0, at_most: int | None = None) -> Column:
    """Whether the first turn ends with a task's prompt and the number of turns is within bounds."""
    n = F.size(turns)
    fits = (n > at_least) if at_most is None else (n > at_least) & (n <= at_most)
    return F.get(turns, 0)["text"].endswith(prompt) & fits


def from_human(turns: Column, human: str = "user") -> Column:
    """Turns without a first one that the human did not speak."""
    return F.when(F.get(turns, 0)["role"] != human, F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)


def alternates(turns: Column, human: str = "user") -> Column:
    """Whether human and assistant speak by turns, the human first."""
    return F.forall(F.transform(turns, lambda t, i: (t["role"] == human) == (i % 2 == 0)), lambda x: x)


def best_answer(answers: Column, which: str = "most") -> Column:
    """Of (answer, confidence): those with both, or else the first; the most frequent (the first of equals) or the first."""
    good = F.transform(F.filter(answers, lambda a: (a["confidence"] != "") & (a["answer"] != "")), lambda a: a["answer"])
    every = F.when(F.size(good) == 0, F.array(F.get(answers, 0)["answer"])).otherwise(good)
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    rate = lambda v: F.array_max(F.transform(v, lambda a, i: F.struct(F.size(F.filter(v, lambda b: b == a)).alias("n"), (-i).alias("i"), a.alias("a"))))["a"]
    chosen = bound(every, rate) if which == "most" else F.get(every, 0)
    return F.concat(F.upper(F.substring(chosen, 1, 1)), F.substring(chosen, F.lit(2), F.length(chosen)))


def effective_shots(shots: Column, text_only: int = 2) -> Column:
    """Shots asked for, or a number of text-only ones for none."""
    return F.when(shots > 0, shots).otherwise(F.lit(text_only))


# Interleaving.


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    return F.element_at(F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y))), 1)


def interleaved(sentences: Column, places: Column, end: str = END, chunks: bool = True) -> Column:
    """Sentences joined by spaces, an image before each at one of the places. With ``chunks`` an end of chunk stands before
    every image but the first, and at the end."""
    mark = END_OF_CHUNK + IMAGE if chunks else IMAGE
    joined = F.array_join(F.transform(sentences, lambda s, i: F.when(F.array_contains(places, i), F.concat(F.lit(mark), s)).otherwise(s)), " ")
    return F.concat(clean_markers(without_first(joined, END_OF_CHUNK) if chunks else joined), F.lit(END_OF_CHUNK + end if chunks else end))


def enough_images(text: Column, key: Column, least: int = 1, seed: int = 0) -> Column:
    """At least so many images; texts with a single one stay half of the time, and never if it ends them."""
    n = F.regexp_count(text, F.lit(IMAGE))
    return (n >= least) & ((n != 1) | ((draw(key, seed) > 0.5) & ~text.endswith(IMAGE)))


def plain_interleaved(texts: Column, valid: Column, end: str = END) -> Column:
    """Texts in order with an image for each valid null one, no ends of chunks, and a space between images in a row."""
    image_at = F.transform(texts, lambda t, i: F.when(t.isNull(), F.when(F.get(valid, i), IMAGE).otherwise("")).otherwise(t))
    joined = F.concat(F.array_join(F.filter(image_at, lambda p: p != ""), " "), F.lit(end))
    tight = F.replace(F.replace(joined, F.lit(f"{IMAGE} "), F.lit(IMAGE)), F.lit(f" {IMAGE}"), F.lit(IMAGE))
    return F.regexp_replace(tight, f"{IMAGE}(?={IMAGE})", f"{IMAGE} ")


def padded(values: Column, n: int, zero: Column) -> Column:
    """The first n values, with zeros up to n."""
    return F.concat(F.slice(values, 1, n), F.array_repeat(zero, F.greatest(F.lit(n) - F.size(values), F.lit(0))))


def image_tokens(text: Column, encode: Callable[[Column], Column], image_id: int = -200, start_id: int | None = None) -> Column:
    """Ids of the chunks between image marks with the image's id between them; a start id that all chunks have is kept once."""
    chunks = F.transform(F.split(text, IMAGE), encode)
    if start_id is not None:
        chunks = F.transform(chunks, lambda c, i: F.when((i > 0) & (F.get(c, 0) == start_id), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c))
    return F.flatten(F.transform(chunks, lambda c, i: F.when(i > 0, F.concat(F.array(F.lit(image_id).cast("bigint")), c)).otherwise(c)))


def mask_captions(ids: Column, image: int, pad: int) -> Column:
    """Labels of captions: images and padding don't count."""
    return F.transform(ids, lambda x: F.when(x.isin(image, pad), F.lit(IGNORED).cast("bigint")).otherwise(x))


def mask_turns(turns: Column, human: str = "user") -> Column:
    """Labels of turns (role, ids): only what the assistant says counts."""
    return F.flatten(F.transform(turns, lambda t: F.when(t["role"] == human, F.transform(t["ids"], lambda _: F.lit(IGNORED).cast("bigint"))).otherwise(t["ids"])))


def square(width: Column, height: Column) -> Column:
    """Side of the square around an image, and where the image begins in it."""
    side = F.greatest(width, height)
    return F.struct(side.alias("side"), F.floor((side - width) / 2).alias("left"), F.floor((side - height) / 2).alias("top"))


def patch_boxes(width: Column, height: Column, patch: int) -> Column:
    """Boxes of patches of an image, row by row; those at the edges may reach over it."""
    rows, columns = (F.sequence(F.lit(0), F.ceil(x / patch).cast("int") - 1) for x in (height, width))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: F.struct((c * patch).alias("left"), (r * patch).alias("top"), (c * patch + patch).alias("right"), (r * patch + patch).alias("bottom")))))


# Order and place.


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """Rows with a random ``pos`` that the seed and the epoch decide: a shuffle of the whole table, without one task for it."""
    return numbered(rows.withColumn("_draw", draw(F.col(key), seed + epoch)), "_draw").drop("_draw")


def buffer_shuffled(rows: DataFrame, key: str, order: str, buffer: int, seed: int, epoch: int = 0) -> DataFrame:
    """Rows shuffled within windows of ``buffer`` rows in their order: ``pos`` is the place after it."""
    placed = numbered(rows, order).withColumn("_window", F.floor(F.col("pos") / buffer))
    inside = F.row_number().over(Window.partitionBy("_window").orderBy(draw(F.col(key), seed + epoch), key)) - 1
    return placed.withColumn("pos", F.col("_window") * buffer + inside).drop("_window")


def whole_shards(shards: DataFrame, order: str, world: int) -> DataFrame:
    """The first shards, as many as share out evenly."""
    kept = shards.count() // world * world
    return numbered(shards, order).where(F.col("pos") < kept)


def rounded_epoch(samples: int, batch: int, world: int, workers: int, floor: bool = False) -> dict[str, int]:
    """Batches and samples of an epoch in which every worker has whole batches."""
    divide = (lambda a, b: a // b) if floor else (lambda a, b: -(-a // b))
    batches = divide(samples, batch * world)
    each = divide(batches, max(1, workers))
    return {"worker_batches": each, "batches": each * max(1, workers), "samples": each * max(1, workers) * batch * world}


def resumed(rows: DataFrame, order: str, steps: int, batch: int) -> DataFrame:
    """What is left after ``steps`` batches."""
    return numbered(rows, order).where(F.col("pos") >= steps * batch)


def wrapped(rows: DataFrame, order: str, start: int, n: int) -> DataFrame:
    """n rows from ``start`` on, beginning again at the end: (draw, and the row's columns)."""
    total = rows.count()
    picks = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.col("id") + start, F.lit(max(total, 1))).alias("pos"))
    return picks.join(numbered(rows, order), "pos").drop("pos")


def uncovered(ranges: DataFrame, start: str, stop: str, n: int) -> DataFrame:
    """Gaps and overlaps of half-open ranges over 0 to n: (stops, goes_on), where a range stops and where the next one starts.

    Ranges are few beside the rows they stand for; they are sorted in one window.
    """
    edges = ranges.select(F.col(start).cast("long").alias("a"), F.col(stop).cast("long").alias("z"))
    edges = edges.unionByName(ranges.sparkSession.createDataFrame([(0, 0), (n, n)], "a long, z long"))
    w = Window.orderBy("a", "z")
    return edges.select(F.col("z").alias("stops"), F.lead("a").over(w).alias("goes_on")).where("goes_on is not null and stops <> goes_on")


# Joins of samples.


def one_sample_each(neighbours: DataFrame, samples: DataFrame, image: str, sample: str, seed: int = 0) -> DataFrame:
    """For each (query, neighbour, rank) one random sample of the neighbour's image."""
    joined = neighbours.join(samples.withColumnRenamed(image, "neighbour"), "neighbour")
    best = joined.groupBy("query", "rank", "neighbour").agg(F.min_by(sample, F.struct(draw(F.concat_ws(":", "query", sample), seed), F.col(sample))).alias(sample))
    return best.select("query", "rank", "neighbour", sample)


def _by_name(files: DataFrame, name: str) -> DataFrame:
    return files.withColumn("_name", F.regexp_extract(name, r"([^/]+?)(?:\.[^./]*)?$", 1))


def with_bytes(rows: DataFrame, files: DataFrame, url: str, name: str = "name", data: str = "data") -> DataFrame:
    """Rows with the bytes of the file that is named by the SHA-256 of their address, once for every file of that name."""
    named = _by_name(files, name).select("_name", data)
    return rows.join(named, F.sha2(F.col(url), 256) == F.col("_name")).drop("_name")


def with_file(rows: DataFrame, files: DataFrame, url: str, name: str = "name") -> DataFrame:
    """Rows whose address some file is named by, each once, however many files and rows share it."""
    named = _by_name(files, name).select("_name").distinct()
    return rows.join(named, F.sha2(F.col(url), 256) == F.col("_name"), "left_semi")


def paired_batches(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The n-th batch of one stream beside the n-th of the other; the shorter one ends it."""
    a, b = numbered(left, left_order), numbered(right, right_order)
    return a.join(b, "pos")


# Sources of evaluation data.


def captions(annotations: DataFrame, train: bool, coco: bool) -> DataFrame:
    """(image_id, filename, caption) of ``images`` (split, filename, cocoid, sentences): the first sentence of each."""
    image = annotations.select(F.explode("images").alias("i")).select("i.*").where(F.col("split") == ("train" if train else "test"))
    name = F.col("cocoid").cast("string") if coco else F.substring_index("filename", ".", 1)
    return image.select(name.alias("image_id"), "filename", F.get("sentences", 0)["raw"].alias("caption"))


def image_name(dataset: str, split: str, image_id: Column) -> Column:
    """The file name of an image by the rule of its data set."""
    if dataset in ("vqav2", "ok_vqa"):
        return F.concat(F.lit(f"COCO_{split}_"), F.lpad(image_id.cast("string"), 12, "0"), F.lit(".jpg"))
    return image_id.cast("string") if dataset == "vizwiz" else F.concat(image_id.cast("string"), F.lit(".jpg"))


def questions_with_answers(questions: DataFrame, annotations: DataFrame, order: str) -> DataFrame:
    """Questions and annotations by their places."""
    a = numbered(questions, order)
    b = numbered(annotations.withColumnRenamed(order, "_order"), "_order").drop("_order")
    return a.join(b, "pos")


def with_ocr(questions: DataFrame, ocr: DataFrame) -> DataFrame:
    """Questions with their image's OCR tokens, found by its id, or else by its file name without ``.jpg``."""
    side = ocr.select(F.col("image_id").alias("_i"), F.col("tokens").alias("_t"))
    own = questions.join(side, questions["image_id"] == side["_i"], "left").drop("_i").withColumnRenamed("_t", "_own")
    both = own.join(side, F.regexp_replace("image", r"\.jpg$", "") == side["_i"], "left").drop("_i")
    asked = F.concat(F.upper(F.substring("question", 1, 1)), F.lower(F.substring(F.col("question"), F.lit(2), F.length("question"))))
    tokens = F.array_join(F.coalesce("_own", "_t", F.array().cast("array<string>")), ", ")
    return both.withColumn("prompt", F.concat(asked, F.lit("\nReference OCR token: "), tokens)).drop("_own", "_t")


def with_class_name(rows: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """Rows with the name of their class, by its place in the list."""
    return rows.withColumn("class_name", F.get(F.array(*map(F.lit, names)), F.col(label)))


def memes(rows: DataFrame) -> DataFrame:
    """(id, image, text, answer): labels as yes or no, images by their last path segment."""
    return rows.select("id", F.element_at(F.split("img", "/"), -1).alias("image"), "text", F.when(F.col("label") == 1, "yes").otherwise("no").alias("answer"))
