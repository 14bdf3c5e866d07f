"""Readers and writers over files."""

from __future__ import annotations

import base64
import json

import pytest

from millrace.operators import samples as X
from millrace.sources import readers as R
from millrace.sources import sinks as K


def test_json_by_suffix(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n{"x": 4}\n')
    assert sorted(r.x for r in R.json_by_suffix(spark, str(tmp_path / "a.json")).collect()) == [1, 2]
    assert sorted(r.x for r in R.json_by_suffix(spark, str(tmp_path / "b.jsonl"), "x long").collect()) == [3, 4]
    with pytest.raises(ValueError):
        R.json_by_suffix(spark, "c.txt")


def test_lines_with_their_files(spark, tmp_path):
    for folder, n in (("CC-MAIN-1", 2), ("CC-MAIN-2", 1), ("other", 1)):
        (tmp_path / folder).mkdir()
        for i in range(n):
            (tmp_path / folder / f"{i}.jsonl").write_text('{"a": 1}\n\n{}\n{"a": 2}\n')
    (tmp_path / "CC-MAIN-1" / "x.txt").write_text("no")
    assert R.shards(spark, str(tmp_path), "CC-MAIN-*").count() == 3
    got = R.samples_of_lines(spark, f"{tmp_path}/CC-MAIN-*/*.jsonl").collect()
    assert len(got) == 9 and len({r.url for r in got}) == 3
    assert R.text_with_retry(spark, f"{tmp_path}/other", tries=1).count() == 2
    with pytest.raises(Exception):
        R.text_with_retry(spark, f"{tmp_path}/nowhere", tries=2, pause=0)


def test_braces_and_sizes(spark):
    assert R.expand_braces("s/{08..10}-{a,b}.tar") == [f"s/{i}-{x}.tar" for i in ("08", "09", "10") for x in "ab"]
    sizes = spark.createDataFrame([("00.tar", 5), ("02.tar", 7), ("09.tar", 100)], "name string, size long")
    assert R.dataset_size(spark, "s/{00..02}.tar", sizes) == (12, 3)
    assert R.dataset_size(spark, "s/{00..02}.tar", None, 9) == (9, 3) and R.dataset_size(spark, "x.tar", None) == (None, 1)


def test_tables(spark, tmp_path):
    for name in ("law", "art"):
        (tmp_path / f"{name}.csv").write_text("".join(f'"{name} {i}, with ""quotes""",A,B\n' for i in range(4)))
    rows = R.headerless_csv(spark, f"{tmp_path}/*.csv", ["question", "a", "b"], first=2).collect()
    assert sorted(r.question for r in rows) == [f'{n} {i}, with "quotes"' for n in ("art", "law") for i in range(2)]
    (tmp_path / "t.tsv").write_text("index\timage\n1\t" + base64.b64encode(b"xy").decode() + "\n2\t***\n")
    got = {r["index"]: r.image for r in R.decoded_images(R.tsv(spark, str(tmp_path / "t.tsv"))).collect()}
    assert bytes(got["1"]) == b"xy" and got["2"] is None


def test_keyed_lines(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text('{"k": 1, "v": "a"}\n\n{"k": 2, "v": "b"}\n{"k": 1, "v": "c"}\n')
    assert {r.k: r.v for r in R.keyed_lines(spark, str(tmp_path / "k.jsonl"), "k long, v string", "k").collect()} == {1: "c", 2: "b"}


def test_context_images(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": base64.b64encode(b"1").decode()}))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.png").write_bytes(b"2")
    assert [(r.name, bytes(r.data)) for r in R.context_images(spark, str(tmp_path / "m.json")).collect()] == [("a", b"1")]
    assert [(r.name, bytes(r.data)) for r in R.context_images(spark, str(tmp_path / "d")).collect()] == [("b.png", b"2")]


def test_read_shards(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"shard_{i}.jsonl").write_text("".join(f'{{"n": {10 * i + j}}}\n' for j in range(4)))
    rows = R.read_shards(spark, f"{tmp_path}/*.jsonl", 10).collect()
    assert {r["index"]: json.loads(r.json)["n"] for r in rows} == {10 * i + j: 10 * i + j for i in range(3) for j in range(4)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "k long, v array<double>")
    K.json_list(rows, str(tmp_path / "l"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "l").glob("part-*")))
    assert [r["k"] for r in json.loads(text)] == [1, 2, 3] and json.loads(text)[2]["v"] is None
    K.json_list(rows.limit(0), str(tmp_path / "e"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "e").glob("part-*"))) == []
    K.csv_table(rows.select("k"), str(tmp_path / "c"))
    assert sorted(r.k for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["1", "2", "3"]
    K.text_lines(rows, str(tmp_path / "t"), "k")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1", "2", "3"]
    K.feature_cache(rows, str(tmp_path / "f"), "k", "v")
    got = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    assert [round(x, 6) for x in got[1]] == [0.6, 0.8] and got[2] == [None, None] and got[3] is None


def test_evaluation_sources(spark):
    images = [("train", "a.b.jpg", 7, ["first", "second"]), ("test", "c.jpg", 8, ["other"])]
    data = spark.createDataFrame([([{"split": s, "filename": f, "cocoid": c, "sentences": [{"raw": x} for x in r]} for s, f, c, r in images],)], "images array<struct<split:string,filename:string,cocoid:long,sentences:array<struct<raw:string>>>>")
    assert [tuple(r) for r in X.captions(data, True, True).collect()] == [("7", "a.b.jpg", "first")]
    assert [tuple(r) for r in X.captions(data, False, False).collect()] == [("c", "c.jpg", "other")]
    questions = spark.createDataFrame([(1, "x", "a.jpg", "wHAT is it?"), (2, "y", "b.jpg", "who?"), (3, "z", "c.jpg", "why?")], "question_id long, image_id string, image string, question string")
    ocr = spark.createDataFrame([("x", ["A", "B"]), ("b", ["C"])], "image_id string, tokens array<string>")
    got = {r.question_id: r.prompt for r in X.with_ocr(questions, ocr).collect()}
    assert got == {1: "What is it?\nReference OCR token: A, B", 2: "Who?\nReference OCR token: C", 3: "Why?\nReference OCR token: "}
    memes = spark.createDataFrame([(1, "img/d/1.png", "t", 1), (2, "2.png", "u", 0)], "id long, img string, text string, label int")
    assert [(r.image, r.answer) for r in X.memes(memes).orderBy("id").collect()] == [("1.png", "yes"), ("2.png", "no")]
    both = X.questions_with_answers(questions.select("question_id"), spark.createDataFrame([(9, "n"), (8, "m")], "question_id long, answer string"), "question_id")
    assert sorted((r.question_id, r.answer) for r in both.collect()) == [(1, "m"), (2, "n")]


def test_epochs():
    assert X.rounded_epoch(1000, 32, 4, 3) == {"worker_batches": 3, "batches": 9, "samples": 1152}
    assert X.rounded_epoch(1000, 32, 4, 3, floor=True) == {"worker_batches": 2, "batches": 6, "samples": 768}


def test_interleaved_against_a_plain_version(spark):
    from pyspark.sql import functions as F

    cases = [(["a", "b", "c"], [1]), (["a", "b"], [0, 1]), (["a"], []), ([], [])]
    df = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(cases)], "k long, s array<string>, p array<int>")
    got = {r.k: r.t for r in df.select("k", X.interleaved(F.col("s"), F.col("p")).alias("t")).collect()}
    for i, (s, p) in enumerate(cases):
        t = " ".join(f"<|endofchunk|><image>{x}" if j in p else x for j, x in enumerate(s)).replace("<|endofchunk|>", "", 1)
        t = t.replace(" <|endofchunk|>", "<|endofchunk|>").replace("<image> ", "<image>").replace(" <image>", "<image>")
        assert got[i] == t + "<|endofchunk|></s>"
