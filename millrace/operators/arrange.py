"""Arrangement of text and images into token text, label masks and prompts. Everything is row-local."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean_markers, without_first

IMAGE, END_OF_CHUNK, END = "<image>", "<|endofchunk|>", "</s>"
IGNORED = -100


def natural_text(texts: Column, valid: Column) -> Column:
    """Texts in order; a null text is an image, dropped if it isn't valid. The first end of chunk goes, two ends are added."""
    parts = F.transform(texts, lambda t, i: F.coalesce(t, F.when(F.get(valid, i), END_OF_CHUNK + IMAGE).otherwise("")))
    joined = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    return F.concat(clean_markers(without_first(joined, END_OF_CHUNK)), F.lit(END_OF_CHUNK + END))


def generated_text(text: Column, most_images: int) -> Column:
    """Numbered image marks become image tokens; with too many the text ends before the last one allowed."""
    marked = F.regexp_replace(text, r"_!_IMAGE[0-9]+_!_", END_OF_CHUNK + IMAGE)
    cleaned = clean_markers(without_first(marked, END_OF_CHUNK))
    return F.when(F.regexp_count(cleaned, F.lit(IMAGE)) > most_images, F.substring_index(cleaned, IMAGE, most_images)).otherwise(cleaned)


def caption_text(caption: Column) -> Column:
    return F.concat(F.lit(IMAGE), F.trim(caption), F.lit(END_OF_CHUNK + END))


def mask_labels(ids: Column, image: int, end: int, pad: int) -> Column:
    """Labels of interleaved ids: only what stands between an image and the next end of chunk counts, the end included."""
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    ignored = F.lit(IGNORED).cast("bigint")

    def masked(v: Column) -> Column:
        # Stretches up to the next image or end, so that no growing array is copied.
        marks = F.filter(F.transform(v, lambda x, i: F.when(x.isin(image, end), F.struct(i.alias("i"), (x == image).alias("on")))), lambda m: m.isNotNull())

        def stretches(ms: Column) -> Column:
            label = lambda on: lambda x: F.when((x == pad) | (x == image) | ~on, ignored).otherwise(x)
            upto = lambda j: F.coalesce(F.get(ms, j)["i"], F.size(v) - 1)
            head = F.transform(F.slice(v, F.lit(1), upto(F.lit(0)) + 1), label(F.lit(False)))
            rest = F.transform(ms, lambda m, j: F.transform(F.slice(v, m["i"] + 2, upto(j + 1) - m["i"]), label(m["on"])))
            return F.flatten(F.concat(F.array(head), rest))

        return bound(marks, stretches)

    return bound(ids, masked)


def chat_prompt(turns: Column, style: str, system: str = "") -> Column:
    """Render (role, text) turns. single: one separator; two: another after answers; chatml: role headers; plain: texts."""
    render = {
        "single": lambda t: F.concat(t["role"], F.lit(": "), t["text"], F.lit("###")),
        "two": lambda t: F.concat(t["role"], F.lit(": "), t["text"], F.when(t["role"] == "assistant", END).otherwise(" ")),
        "chatml": lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")),
        "llama_2": lambda t: F.when(t["role"] == "user", F.concat(F.lit("[INST] "), t["text"], F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), t["text"], F.lit(" " + END))),
        "plain": lambda t: F.concat(t["text"], F.lit("\n")),
    }[style]
    return F.concat(F.lit(system), F.array_join(F.transform(turns, render), ""))


def fewshot_prompt(shots: Column, question: Column) -> Column:
    """Demonstrations (q, a) before the question; without any, the question has no image token."""
    shown = F.transform(shots, lambda s: F.concat(F.lit("<image>Question:"), s["q"], F.lit(" Short answer:"), s["a"], F.lit(END_OF_CHUNK)))
    query = F.concat(F.lit("Question:"), question, F.lit(" Short answer:"))
    return F.when(F.size(shots) > 0, F.concat(F.array_join(shown, ""), F.lit(IMAGE), query)).otherwise(query)


def conversation_pairs(turns: Column) -> Column:
    """Turns two by two, as (question, answer); a last question without an answer is left out."""
    pairs = F.transform(turns, lambda t, i: F.when((i % 2 == 0) & (i + 1 < F.size(turns)), F.struct(t["text"].alias("question"), F.get(turns, i + 1)["text"].alias("answer"))))
    return F.filter(pairs, lambda p: p.isNotNull())


def images_first(text: Column) -> Column:
    """All image tokens at the front, one a line."""
    n = F.regexp_count(text, F.lit(IMAGE))
    return F.concat(F.repeat(F.lit(IMAGE + "\n"), n), F.trim(F.replace(text, F.lit(IMAGE), F.lit(""))))


def rotations(options: Column) -> Column:
    """The options once for each place they can begin at."""
    return F.transform(options, lambda _, i: F.concat(F.slice(options, i + 1, F.size(options) - i), F.slice(options, F.lit(1), i)))


def best_resolution(width: Column, height: Column, choices: list[tuple[int, int]]) -> Column:
    """The choice that keeps the most pixels of the picture; of equal ones the least waste, then the first."""
    options = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(-i).alias("i")) for i, (w, h) in enumerate(choices)])

    def rate(c: Column) -> Column:
        scale = F.least(c["w"] / width, c["h"] / height)
        kept = F.least(F.floor(width * scale) * F.floor(height * scale), (width * height).cast("long"))
        return F.struct(kept.alias("kept"), (kept - c["w"] * c["h"]).alias("waste"), c["i"].alias("i"), c["w"].alias("w"), c["h"].alias("h"))

    best = F.array_max(F.transform(options, rate))
    return F.struct(best["w"].alias("w"), best["h"].alias("h"))


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total weight, each row and column at most once: shortest augmenting paths."""
    turned = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if turned else weights).astype(float)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        reach, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[column]:
            done[column] = True
            slack = cost[owner[column] - 1] - u[owner[column]] - v[1:]
            nearer = ~done[1:] & (slack < reach[1:])
            reach[1:][nearer], came[1:][nearer] = slack[nearer], column
            target = int(np.argmin(np.where(done[1:], np.inf, reach[1:]))) + 1
            step = reach[target]
            u[owner[done]] += step
            v[done] -= step
            reach[~done] -= step
            column = target
        while column:
            owner[column], column = owner[came[column]], came[column]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def assignment(rows: DataFrame, key: str, matrix: str, least: float = float("-inf")) -> DataFrame:
    """(key, row, column, weight) of the best one-to-one assignment of each row's matrix; pairs below ``least`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.array(m or [[]], float)
                if w.size:
                    out += [(k, i, j, float(w[i, j])) for i, j in assign(w) if w[i, j] >= least]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], [key, "row", "column", "weight"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, matrix).mapInArrow(run, f"`{key}` {kind}, row int, column int, weight double")
