"""Classifiers by held-out accuracy, and the pipeline by its parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def auc(label: np.ndarray, score: np.ndarray) -> float:
    below = (score[label == 1][:, None] > score[label == 0][None, :]).mean()
    return float(below + 0.5 * (score[label == 1][:, None] == score[label == 0][None, :]).mean())


@pytest.mark.parametrize(("query", "label", "score", "least"), [(quality.op5_quality, "quality", "score", 0.97), (toxicity.op4_toxicity, "toxic", "expected_severity", 0.95)])
def test_held_out(spark, query, label, score, least):
    found = query(spark, MIDDLE).where("held_out").select("doc_id", score).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").toPandas()
    assert len(found) > 1000
    assert auc(found[label].to_numpy(), found[score].to_numpy()) > least


def test_ordinal_thresholds(spark):
    rng = np.random.default_rng(6)
    texts, labels = [], []
    for _ in range(300):
        toxic = rng.random() < 0.4
        words = [f"word{i}" for i in rng.integers(0, 40, 30)] + ["vile"] * int(toxic * rng.integers(1, 9))
        texts.append(" ".join(words)), labels.append(int(toxic))
    model = toxicity.Model(spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int").join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id"))
    p = model.exceeds(["word1 word2", "vile word1", "vile " * 8, ""])
    assert (np.diff(model.thresholds) >= 0).all() and (np.diff(p, axis=1) <= 1e-12).all()
    severity = p.sum(axis=1)
    assert severity[0] < severity[1] < severity[2] and np.isfinite(severity).all()


def test_without_labels_or_text(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.quality_score for r in quality.score(docs, quality.train(docs, labels)).collect()} == {0.5}
    assert max(r.expected_severity for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()) < 1e-6
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == 0


def test_ordinal_gradient(spark):
    """At the fitted weights no small step lowers the penalised cumulative-link loss, taken straight from its definition."""
    rng = np.random.default_rng(8)
    n, m, grades = 200, 6, 3
    x = rng.random((n, m)) * (rng.random((n, m)) < 0.6)
    grade = np.clip((x @ np.array([2.0, -1, 0, 1, 0, 0]) + rng.normal(size=n)).round().astype(int), 0, grades)
    model = toxicity.Model.__new__(toxicity.Model)
    model.where = {str(i): i for i in range(m)}
    rows, ids = np.nonzero(x)
    model._fit(rows, ids, x[rows, ids], grade, n, grades)

    def loss(w, t):
        eta = (x @ w)[:, None] - t[None, :]
        above = grade[:, None] > np.arange(grades)
        return np.where(above, np.log1p(np.exp(-eta)), np.log1p(np.exp(eta))).sum() / n + toxicity.RIDGE / 2 * (w**2).sum() + toxicity.LASSO * np.abs(w).sum()

    best = loss(model.weights, model.thresholds)
    for i in range(m):
        for step in (0.05, -0.05):
            assert loss(model.weights + step * np.eye(m)[i], model.thresholds) > best - 1e-6
    for j in range(grades):
        for step in (0.05, -0.05):
            assert loss(model.weights, model.thresholds + step * np.eye(grades)[j]) > best - 1e-6


def test_vote_is_the_nearest_neighbours(spark):
    """Scores against a plain vote: all cosines, sorted, one text at a time; ties, repeats and long texts among them."""
    rng = np.random.default_rng(9)
    words = lambda lo, hi, n: " ".join(f"w{i}" for i in rng.integers(lo, hi, n))
    texts = [words(0, 40, 30) if i % 2 else words(30, 70, 30) for i in range(80)] + [words(0, 40, 60_000), ""]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.s for r in quality.score(docs, model, "s").collect()}
    for d, text in enumerate(texts):
        ids, counts = model._counts(text)
        if not len(ids):
            assert got[d] == model.share
            continue
        v = model._project((ids, counts))
        cosines = model.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cosines)[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[near], 0) ** quality.SHARPNESS
        assert abs(got[d] - ((weight * model.labels[near]).sum() + model.share) / (weight.sum() + 1)) < 1e-4
    kept = quality.keep_good(docs.withColumn("_quality", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "quality_score", "_quality"] and 0 < kept.count() < 83


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_an_empty_table(spark, stage):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    found = c.STAGES[stage][1](spark, docs, SMALL)
    assert found.count() == 0 and (stage == 4 or found.columns == docs.columns)


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in c.STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= kept
        kept = now
    last = c.STAGES[-1][1](spark, docs, SMALL).toPandas().sort_values("start")
    assert len(last) == docs.count() and set(last.doc_id) == kept
    assert (last.start.to_numpy() == np.cumsum(last.n_tokens) - last.n_tokens).all()
    again = c.run(spark, SMALL).toPandas().sort_values("start")
    assert (again.ids_crc32.to_numpy() == last.ids_crc32.to_numpy()).all()
