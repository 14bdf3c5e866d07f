"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts is reduced to latent vectors (frequent tokens and token shapes, log counts by inverse
document frequency, truncated SVD). The vectors and their labels, a fixed number, are broadcast. Every document is
projected, its cosines with all labelled vectors are computed in blocks, and its nearest neighbours vote with the
``SHARPNESS``-th power of their similarity as weight. Votes are smoothed by the sample's share of good texts, which is also the score of a text without
any known feature.

Nulls and ties: a null text is empty; an empty text scores the sample's share. Labels or ids that are null teach nothing;
of a repeated id one text and the larger label teach. Without any labels every score is 0.5. Equally near neighbours beyond
the last place are dropped in no stated order. Repeated rows score alike; long texts are read whole, in training too. An
empty table gives no rows. Other columns are not read, and ``keep_good`` hands them on whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, small_batches, text_slices, trim_worker, unused
from .features import SAMPLE_ROWS, Rows, held_out, repetition, sample, shape, tokens, vocabulary

DIMENSIONS = 48
NEIGHBOURS = 25
#: Cosines of texts in one language differ little; this power tells near neighbours from those that are only related.
SHARPNESS = 4
VOCABULARY = 6_000
#: Rows whose cosines are held at once: BLOCK x SAMPLE_ROWS floats.
BLOCK = 256


#: Stands for the number of tokens among a text's features.
_SIZE = "<size>"


def _features(text: str) -> dict[str, int]:
    """Counts of tokens, of their shapes and of how the text repeats itself."""
    own = tokens(text)
    found = Counter(own)
    for x, n in list(found.items()):
        found[shape(x)] += n
    found.update(repetition(own))
    found[_SIZE] = len(own)
    return found


def _damped(counts: np.ndarray, size: int) -> np.ndarray:
    return np.log1p(counts.astype(np.float32) * np.float32(1000 / max(size, 1)))


class Model:
    """The projection, the labelled vectors and the vote."""

    def __init__(self, sampled: DataFrame, dimensions: int = DIMENSIONS, seed: int = 1) -> None:
        self.known: dict[str, int] = {}
        size = sampled.count()
        self.where = vocabulary(sampled, _features, max(2, size // 400), VOCABULARY)
        size_at = self.where.setdefault(_SIZE, len(self.where))
        found = Rows(sampled, _features, self.where)
        labels = found.labels
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        rows = []
        for ids, counts in zip(found.ids, found.counts, strict=True):
            own = ids != size_at
            rows.append((ids[own], _damped(counts[own], int(counts[~own].sum()))))
        n, v = len(rows), len(self.where)
        seen = np.zeros(v)
        for ids, _ in rows:
            seen[ids] += 1
        self.idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 0.1
        self.basis = np.eye(v, min(v, dimensions), dtype=np.float32)
        if n and v:
            # Randomised range finding: the basis of the features' leading right singular vectors.
            rng = np.random.default_rng(seed)
            wide = rng.standard_normal((v, min(v, n, dimensions + 10))).astype(np.float32)
            for _ in range(4):
                left, _ = np.linalg.qr(self._times(rows, wide))
                wide, _ = np.linalg.qr(self._back(rows, left))
            small = self._times(rows, wide)
            _, _, turn = np.linalg.svd(small, full_matrices=False)
            self.basis = np.ascontiguousarray((wide @ turn.T)[:, :dimensions], dtype=np.float32)
        self.vectors = self._unit(np.array([self._project(x) for x in rows], np.float32).reshape(n, self.basis.shape[1]))

    def _counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Known features and their log counts; a token is looked up once and remembered as its features."""
        own = tokens(text)
        found: dict[int, int] = {self.where[x]: c for x, c in repetition(own).items() if x in self.where}
        for x, c in Counter(own).items():
            for f in self._of(x):
                found[f] = found.get(f, 0) + c
        n = len(own)
        ids = np.fromiter(found, np.int64, len(found))
        return ids, _damped(np.fromiter(found.values(), np.float32, len(found)), n)

    def _of(self, token: str) -> tuple[int, ...]:
        if (hit := self.known.get(token)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            hit = self.known[token] = tuple(self.where[x] for x in (token, shape(token)) if x in self.where)
        return hit

    def _weights(self, row: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        w = row[1] * self.idf[row[0]]
        return w / max(float(np.linalg.norm(w)), 1e-9)

    def _times(self, rows: list, m: np.ndarray) -> np.ndarray:
        return np.array([self._weights(r) @ m[r[0]] for r in rows], np.float32)

    def _back(self, rows: list, m: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.where), m.shape[1]), np.float32)
        for r, x in zip(rows, m, strict=True):
            out[r[0]] += self._weights(r)[:, None] * x
        return out

    def _project(self, row: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self._weights(row) @ self.basis[row[0]]

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(texts), BLOCK):
            rows = [self._counts(x) for x in texts[start : start + BLOCK]]
            some = np.array([len(r[0]) > 0 for r in rows])
            if not some.any():
                continue
            vectors = self._unit(np.array([self._project(r) for r, s in zip(rows, some, strict=True) if s], np.float32))
            cosine = vectors @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) ** SHARPNESS
            votes = (weight * self.labels[near]).sum(axis=1) + self.share
            out[start : start + BLOCK][some] = votes / (weight.sum(axis=1) + 1)
        return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return Model(sample(docs, labels, "quality", rows))


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``name``, which it has not; the other columns stay."""
    small_batches(session(docs))
    shared = session(docs).sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows in text_slices(batch):
                found = model.score([x or "" for x in rows.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found)], [*rows.schema.names, name])
        model.known.clear()
        trim_worker()

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``, with their own columns."""
    name = unused(docs.columns, "_quality")
    return score(docs, train(docs, labels), name).where(F.col(name) >= least).drop(name)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
