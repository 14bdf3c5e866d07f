"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades of severity are 0 for a clean text and 1 to 3 for a toxic one, by thirds of how often the sample's toxic texts use
the vocabulary that sets them apart. One weight vector serves every threshold: P(grade > j) = logistic(w . x - t_j) with
ordered thresholds t_j. Features are words and their first letters, as log counts over the whole text; the weights shrink
towards zero and most are exactly zero. The score is the expected severity, the sum of P(grade > j).

The grades above 0 are no labels: the labels only tell toxic from clean, so the grades rank texts by how much of that
vocabulary they hold.

Nulls and ties: a null text is empty and has the sample's base rates. Ids or labels that are null teach nothing; of a
repeated id one text and the larger label teach; without any toxic label the severity is 0. Repeated rows score alike; long
texts are read whole, in training too. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, small_batches, text_slices
from .features import SAMPLE_ROWS, Rows, held_out, sample, vocabulary

#: Grades above 0.
GRADES = 3
VOCABULARY = 60_000
#: Features that get a weight, those whose presence tells most first.
SELECTED = 4_000
RIDGE, LASSO, STEPS = 1e-4, 5e-5, 800

_WORD = re.compile(r"[^\W\d_]+")


def _expand(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k]]


def _features(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for f in _expand(word):
            found[f] = found.get(f, 0) + n
    return found


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, sampled: DataFrame, grades: int = GRADES) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.where: dict[str, int] = {}
        self.weights, self.thresholds = np.zeros(0), np.full(grades, 30.0)
        every = vocabulary(sampled, _features, 3, VOCABULARY)
        found = Rows(sampled, _features, every)
        toxic = found.labels
        if not toxic.any() or not every:
            return
        has = np.zeros((2, len(every)))
        for ids, y in zip(found.ids, toxic, strict=True):
            has[int(y), ids] += 1
        rate = (has + 0.5) / (np.array([[(toxic == 0).sum()], [(toxic == 1).sum()]]) + 1)
        tells = (rate[1] - rate[0]) * np.log(rate[1] / rate[0])
        chosen = np.argsort(-tells, kind="stable")[:SELECTED]
        names = list(every)
        self.where = {names[i]: k for k, i in enumerate(chosen)}
        place = np.full(len(every), -1)
        place[chosen] = np.arange(len(chosen))
        lexicon = (np.log(rate[1] / rate[0]) > 2.5) & (has[1] >= 3)
        hits = np.array([c[lexicon[i]].sum() for i, c in zip(found.ids, found.counts, strict=True)], float)
        cuts = np.quantile(hits[toxic == 1], np.arange(1, grades) / grades)
        grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, hits, side="left"), 0)
        rows, ids, n = np.repeat(np.arange(len(toxic)), [len(x) for x in found.ids]), np.concatenate(found.ids), np.concatenate(found.counts)
        some = place[ids] >= 0
        self._fit(rows[some], place[ids[some]], np.log1p(n[some]), grade, len(toxic), grades)

    def _fit(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, grade: np.ndarray, n: int, grades: int) -> None:
        """Accelerated proximal gradient steps on the cumulative logistic loss; thresholds are kept in order."""
        above = grade[:, None] > np.arange(grades)[None, :]
        base = np.clip(above.mean(axis=0), 1e-6, 1 - 1e-6)
        w, t = np.zeros(len(self.where)), np.log((1 - base) / base)
        w0, t0 = w, t
        size = float(np.bincount(rows, weights=values**2, minlength=n).mean()) * grades / 4 + grades
        rate = 2.0 / size
        for step in range(STEPS):
            push = step / (step + 3)
            wp, tp = w + push * (w - w0), t + push * (t - t0)
            eta = np.bincount(rows, weights=values * wp[ids], minlength=n)
            wrong = _logistic(eta[:, None] - tp[None, :]) - above
            gw = np.bincount(ids, weights=values * wrong.sum(axis=1)[rows], minlength=len(w)) / n + RIDGE * wp
            gt = -wrong.sum(axis=0) / n
            w0, t0 = w, t
            w = wp - rate * gw
            w = np.sign(w) * np.maximum(np.abs(w) - rate * LASSO, 0)
            t = np.maximum.accumulate(tp - rate * gt)
        self.weights, self.thresholds = w, t
        self.where = {f: i for f, i in self.where.items() if w[i] != 0}

    def _of(self, word: str) -> tuple[int, ...]:
        if (hit := self.known.get(word)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            hit = self.known[word] = tuple(self.where[x] for x in _expand(word) if x in self.where)
        return hit

    def exceeds(self, texts: list[str]) -> np.ndarray:
        """P(grade > j) for each text and threshold."""
        eta = np.zeros(len(texts))
        for r, text in enumerate(texts):
            found: dict[int, int] = {}
            for word, n in Counter(_WORD.findall(text.lower())).items():
                for f in self._of(word):
                    found[f] = found.get(f, 0) + n
            eta[r] = sum(self.weights[f] * np.log1p(n) for f, n in found.items())
        return _logistic(eta[:, None] - self.thresholds[None, :])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return Model(sample(docs, labels, "toxic", rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxic_probability, expected_severity and grade, the most likely one, of each row."""
    small_batches(session(docs))
    shared = session(docs).sparkContext.broadcast(model)
    names = ["doc_id", "toxic_probability", "expected_severity", "grade"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows in text_slices(batch):
                p = model.exceeds([x or "" for x in rows.column("text").to_pylist()])
                at = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(at.argmax(axis=1), pa.int32())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, toxic_probability double, expected_severity double, grade int")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_severity", "toxic_probability", "grade", (F.col("toxic_probability") >= 0.5).alias("toxic"))
