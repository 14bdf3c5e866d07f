"""Operators that SQL can't express, and the edges of the others."""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import math
import re
import tarfile
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import arrange, joins, metrics, paragraphs, prompts, sampling
from millrace.plans import evaluation, shaping
from millrace.plans import paragraphs as plans
from millrace.plans import samples as samples_plans
from millrace.sources import readers
from millrace.streaming import ingest


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_assignment_is_best():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        w = rng.random((n, m))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum(w[i, j] if n <= m else w[j, i] for i, j in zip(small, p, strict=False)) for p in itertools.permutations(large, len(small)))
        pairs = arrange.assign(w)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert abs(sum(w[i, j] for i, j in pairs) - best) < 1e-9


def test_scalars(spark):
    assert column(spark, "7,8\nwhy", lambda t: T.judge_scores(t)) == [7.0, 8.0]
    assert column(spark, "7 8 9", lambda t: T.judge_scores(t)) == [-1.0, -1.0]
    assert column(spark, "two dont a cat", T.plain_answer) == "2 don't cat"
    assert column(spark, "a-b , c 1.5.", T.clear_punctuation) == "a b  c 1.5"
    assert column(spark, "x <|im_end|>", T.clean_tail) == "x"
    assert column(spark, "a/b/checkpoint-7/", T.model_name) == "b_checkpoint-7"
    assert column(spark, "first\nsecond\nthird", lambda t: T.trim_hanging_lines(t, 1)) == "second\nthird"
    assert column(spark, None, T.plain_answer) is None


def test_paragraph_edges(spark):
    assert column(spark, "", paragraphs.mostly_numerical) is True
    assert column(spark, "Hello.\nWorld\nagain", lambda t: paragraphs.join_lines(t)) == "Hello.\nWorldagain"
    assert column(spark, "and then. It ends.", lambda t: paragraphs.trim_incomplete(t)) == "and then. It ends."
    assert column(spark, "a" + "_" * 15 + "b" + "_" * 20 + "c", paragraphs.underline_segments) == ["a", "c", "b"]
    docs = spark.createDataFrame([(1, "x"), (2, None), (3, "word " * 40 + "ends here.")], "doc_id long, text string")
    assert [r.doc_id for r in paragraphs.cascade(docs).collect()] == [3]


def test_shards_hold_every_document(spark, tmp_path):
    spark.range(25, 1500, 3).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(d // 37 for d in range(25, 1500, 3))
    got = {r.shard: (r.n, r.places) for r in evaluation.shard_ranges(spark, str(tmp_path)).collect()}
    assert got == {s: (n, sum(d % 37 for d in range(25, 1500, 3) if d // 37 == s)) for s, n in want.items()}


def test_trim_over_all_paragraphs(spark, tmp_path):
    gap = r"""((?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)(?:"|')?\s)"""

    def trim(t: str, last: bool) -> str:
        parts = re.split(gap, t)
        done = [i for i, s in enumerate(parts) if s == "" or s[-1] in ".!?”\""]
        return "" if not done else "".join(parts[: done[-1] + 1] if last else parts[done[0] :])

    def brute(ps: list[str]) -> list[str]:
        ps = list(ps)
        for last in (False, True):
            for i in reversed(range(len(ps))) if last else range(len(ps)):
                ps[i] = trim(ps[i], last)
                if ps[i]:
                    break
        return ps

    texts = ["no end\nnor here\nIt ends. And\tgoes! on", "One.\nTwo and\nthree", "nothing\nat all", "", "\n\nA. b\n\n", 'He said "x." Next one. cut', "Mr. X came.\n\nlast e.g. this one", "a\nAll. Of it.  \nb"]
    spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ps = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", paragraphs.trim_paragraphs(F.split("text", "\n")).alias("ps"))
    want = {i: brute(t.split("\n")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ps for r in ps.collect()} == want
    got = {r.doc_id: r.n_chars for r in plans.queries()["f04_trim_incomplete"](spark, str(tmp_path)).collect()}
    assert got == {i: len("\n".join(x)) for i, x in want.items()}


def test_labels_over_the_whole_length(spark, tmp_path):
    sizes = {0: 0, 3: 5, 7: 61, 8: 1000, 12: 20_000}
    spark.createDataFrame(list(sizes.items()), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, n in sizes.items():
        on, out = False, []
        for x in ((i * 7 + d) % 11 for i in range(n + 1)):
            out.append(x if on and x not in (0, 3) else -100)
            on = x == 3 or (on and x != 5)
        want[d] = out
    assert {r.doc_id: [int(x) for x in r.labels.split(",")] for r in shaping.label_mask(spark, str(tmp_path)).collect()} == want


def test_bleu(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat")], "k long, p string, r string")
    assert metrics.bleu(rows, "k", "p", "r").first().bleu == 1.0
    # 5 of 6 words, 3 of 5 pairs, 2 of 4 triples and 1 of 3 fours are right, and both sides are six words long
    rows = spark.createDataFrame([(1, "the cat sat on a mat", "the cat sat on the mat")], "k long, p string, r string")
    assert metrics.bleu(rows, "k", "p", "r").first().bleu == pytest.approx((5 / 6 * 3 / 5 * 2 / 4 * 1 / 3) ** 0.25, abs=1e-6)


def test_every_full_stop_goes(spark):
    assert column(spark, "a. b.\n" * 40 + "1.5 c..d..", T.clear_punctuation) == "a b\n" * 40 + "1.5 c.d"


def test_eval_answer_as_its_twin(spark, duck):
    texts = ["two. cats. " * 40, "\u00a0The A\x0bB \u0130\u03a3.\u3000", "c..d.. 1.5, dont", None, ""]
    want = duck.execute(samples_plans.oracles()["c20_eval_answer"].replace("FROM conversations", "FROM (SELECT 1 AS conv_id, 1 AS turn, unnest($1) AS text)"), [texts]).fetchall()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.eval_answer(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [r[2] for r in want]
    assert got[0].x == " ".join(["2 cats"] * 40)


def test_files_by_digest_keeps_each_page_once(spark, duck, tmp_path):
    rows = [(1, "u", "one"), (2, "u", "twoé"), (3, "u", "three!"), (4, "v", None), (6, "w", "lone"), (7, None, "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, samples_plans.files_by_digest(spark, str(tmp_path)).collect()))
    want = duck.execute(samples_plans.oracles()["j14_files_by_digest"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert got == sorted(want) == [(1, 3), (2, 5), (3, 6), (4, None)]


def test_cider_broadcasts_no_grams(spark, tmp_path):
    # A small file of long texts: the planner takes its n-grams for as small as the file.
    rows = [(k, t, "user", f"word{k} and more ") for k in range(4) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("conv_id", "turn", "role", "repeat(text, 500) AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    found = samples_plans.cider(spark, str(tmp_path))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 4


def test_cider_against_plain_version(spark):
    rows = [(1, "a cat sits", ["a cat sits here", "the cat"]), (2, "a dog runs fast", ["a dog runs fast"]), (3, "nothing alike", ["something else entirely"]), (4, "x", []), (5, None, ["a b"]), (6, "a b", None)]
    got = {r.k: r.cider for r in metrics.cider(spark.createDataFrame(rows, "k long, c string, rs array<string>"), "k", "c", "rs").collect()}
    grams = lambda t: Counter((n, tuple(t.split()[i : i + n])) for n in range(1, 5) for i in range(len(t.split()) - n + 1))
    df = Counter(g for _, _, rs in rows for g in {g for r in rs or [] for g in grams(r)})

    def vector(t: str, n: int) -> dict:
        return {g: c * (math.log(len(rows)) - math.log(max(1, df[g]))) for g, c in grams(t).items() if g[0] == n}

    for k, c, rs in rows:
        if not rs:
            assert got[k] is None
            continue
        total = 0.0
        for r in rs:
            gap = max(len((c or "").split()) - 1, 0) - max(len(r.split()) - 1, 0)
            for n in range(1, 5):
                a, b = vector(c or "", n), vector(r, n)
                norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                total += sum(min(a[g], b[g]) * b[g] for g in a.keys() & b.keys()) / norm * math.exp(-gap * gap / 72) if norm else 0.0
        assert got[k] == pytest.approx(10 * total / 4 / len(rs), abs=1e-5)


def test_prompts_of_every_style(spark):
    rows = spark.createDataFrame([([("U", "one\n\ntwo"), ("B", "yes"), ("U", "and"), ("B", None)],)], "t array<struct<role string, text string>>")
    make = lambda style, message="m": rows.select(prompts.prompt(F.col("t"), prompts.Template(style, style, ("P", "R"), "|", "^", message, "<{system_message}>"))).first()[0]
    one = "one\n\ntwo"
    want = {
        "add_colon_single": f"<m>|U: {one}|B: yes|U: and|B:", "add_colon_two": f"<m>|U: {one}|B: yes^U: and|B:", "add_colon_space_single": f"<m>|U: {one}|B: yes|U: and|B: ",
        "no_colon_single": f"<m>U{one}|Byes|Uand|B", "no_colon_two": f"<m>U{one}|Byes^Uand|B", "add_new_line_single": f"<m>|U\n{one}|B\nyes|U\nand|B\n",
        "llama2": f"<m>{one} R yes^P and|R", "chatglm": f"<m>|[Round 0]|U：{one}|B：yes|[Round 1]|U：and|B：", "chatml": f"<m>|\nU\n{one}|\nB\nyes|\nU\nand|\nB\n",
        "chatintern": f"<m>U:{one}|\nB:yes^\nU:and|\nB:", "dolly": f"<m>U:\n{one}|B:\nyes^\n\nU:\nand|B:\n", "rwkv": "<m>U: one\ntwo\n\nB: yes\n\nU: and\n\nB:",
        "phoenix": f"<m>U: <s>{one}</s>B: <s>yes</s>U: <s>and</s>B: <s>", "robin": f"<m>|U:\n{one}|B:\nyes|U:\nand|B:\n", "falcon_chat": f"<m>|U: {one}|B: yes|U: and|B:",
        "chatglm3": f"<m>U\n {one}B\n yesU\n andB", "husky": f"m|U: {one}|B: yes^U: and|B:", "husky_n": f"m|U: \n{one}|B: \nyes^U: \nand|B: \n",
        "internlm2_chat": f"mU{one}|Byes^Uand|B", "mpt": f"<m>|U{one}|Byes|Uand|B",
    }
    assert set(want) == set(prompts.STYLES)
    for style, text in want.items():
        assert make(style) == text, style
    assert make("falcon_chat", "").startswith("U: ") and make("chatglm3", "").startswith("U\n") and make("llama2", "").startswith("[INST] one")


def test_templates_are_registered_once():
    prompts.register(prompts.Template("own", "mpt"), override=True)
    with pytest.raises(ValueError, match="registered"):
        prompts.register(prompts.Template("own", "robin"))
    assert prompts.template("own", "hello").message == "hello" and prompts.template("own").message == ""
    with pytest.raises(ValueError, match="no style"):
        prompts.Template("x", "y")


def test_few_shot_without_images(spark):
    rows = spark.createDataFrame([([("q1", " a1 ", 1)], "q", 1)], "d array<struct<question string, answer string, patches int>>, q string, n int")
    args = F.col("d"), F.col("q"), F.col("n"), "Short:"
    turns = rows.select(prompts.few_shot_turns(*args, ("U", "B"), per_patch=1, images=False)).first()[0]
    assert [(t.role, t.text) for t in turns] == [("U", "q1\nShort:"), ("B", " a1 "), ("U", "<img><IMG_CONTEXT></img>\nq\nShort:"), ("B", None)]
    turns = rows.select(prompts.few_shot_turns(*args, ("U", "B"), style="single", task=prompts.CAPTION, per_patch=1, images=False)).first()[0]
    assert turns[0].text == f"Here are some caption examples:\nExample 1:\nCaption: a1\n{prompts.REFER}<img><IMG_CONTEXT></img>\n{prompts.ASK_CAPTION}" and turns[1].text is None


def test_answer_stems(spark):
    words = {"riding a bikes": "ride a bike", "running": "run", "making": "make", "eating": "eat", "king": "king", "string": "string", "ladies": "lady", "boxes": "box", "glass": "glass", "bus": "bus", "police": "police", "surfing, and": "surf"}
    rows = spark.createDataFrame(list(words.items()), "t string, want string").select("t", "want", T.open_answer(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == {r.t: r.want for r in rows}


def test_auc_of_many_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(bool(rng.random() < 0.4), float(rng.integers(0, 60))) for _ in range(400)]
    got = metrics.roc_auc(spark.createDataFrame(rows, "y boolean, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert got.auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg), abs=1e-6)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    got = {(r.query_id, r["rank"]): r.id for r in joins.top_k(df, df, 3).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    for q in range(60):
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(-s[q], kind="stable")[:3].tolist()


def test_numbered_is_dense(spark):
    rows = sampling.numbered(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(6), "k").orderBy("k").collect()
    assert [r.pos for r in rows] == list(range(1000))


def test_resample_is_deterministic(spark):
    shards = spark.range(5).withColumnRenamed("id", "shard")
    once, again = ([(r.draw, r.shard) for r in sampling.resample(shards, "shard", 20, seed=3).orderBy("draw").collect()] for _ in range(2))
    assert once == again and len(once) == 20


def test_repair(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ('{"a": 1}]]',), ("{",), ("  ",), ('{"a": ' + "x" * 40,)], "value string")
    got = {r.value: (r.json, r.lost) for r in readers.repair_json(lines).collect()}
    assert got == {'{"a": 1}': ('{"a": 1}', 0), '{"a": 1}]]': ('{"a": 1}', 2), '{"a": ' + "x" * 40: (None, 0)}


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name in ("x.jpg", "x.TXT", "y.txt", "y.txt", "noext"):
            info = tarfile.TarInfo(name)
            info.size = 1
            t.addfile(info, io.BytesIO(b"1"))
    (tmp_path / "bad.tar").write_bytes(b"no archive")
    got = readers.group_by_key(readers.tar_members(spark, str(tmp_path / "*.tar"))).orderBy("sample").collect()
    assert [(r.key, sorted(r.parts)) for r in got] == [("x", ["jpg", "txt"]), ("y", ["txt"]), ("y", ["txt"])]
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("l.jsonl", "1\n2\n")
    assert [r.value for r in readers.zipped_lines(spark, str(tmp_path / "l.zip")).orderBy("line").collect()] == ["1", "2"]


def test_main_body():
    page = "<html><head><title>t</title></head><body><nav>menu menu menu menu menu</nav><p>This paragraph is long enough to stay.</p><p><a>a link that is long enough to go</a></p><script>var x</script></body></html>"
    assert readers.main_body(page) == "This paragraph is long enough to stay."
    assert readers.main_body(None) == ""


def test_page_documents(spark):
    page = "<html><head><title>The  title</title></head><body><p>This paragraph is long enough to stay.</p><img src='/a.png'><nav><img src='n.png'></nav></body></html>"
    rows = spark.createDataFrame([(1, page, "http://x.org/b/"), (2, None, None), (3, "<p></p>", None)], "page_id long, html string, url string")
    got = {r.page_id: r.document for r in readers.page_documents(rows, "page_id").collect()}
    text = "This paragraph is long enough to stay."
    assert got[2] is None and got[3] is None
    assert got[1].asDict() == {"id": "1", "title": "The title", "text": text, "media": ["http://x.org/a.png"], "fingerprint": hashlib.sha256(f"The title {text}".encode()).hexdigest()}


def test_page_that_takes_too_long():
    assert readers.page_document("<p>word " * 200_000, "1", seconds=0.001) is None
    assert readers.page_document("<p>a paragraph long enough to stay</p>", "1")["text"] == "a paragraph long enough to stay"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: ingest.filter_new_files(spark, str(source), "id long", lambda s: s.where("id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    for batch in ([1, 2], [3, 4]):
        (source / f"{batch[0]}.json").write_text("\n".join(json.dumps({"id": i}) for i in batch))
        run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4]


def test_sinks(spark, tmp_path):
    from millrace.sources import sinks

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(7)], "id long, text string").coalesce(1)
    shards = sinks.tar_shards(rows, "id", "txt", "text", 3).collect()
    names = [m.name for s in shards for m in tarfile.open(fileobj=io.BytesIO(bytes(s.tar)))]
    assert sorted(names) == [f"{i}.txt" for i in range(7)] and len(shards) == 3
    sinks.json_lines(rows, str(tmp_path / "out"), "id")
    assert spark.read.json(str(tmp_path / "out")).count() == 7
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "q long, image string")
    predictions = spark.createDataFrame([(2, "yes"), (3, "no")], "q long, answer string")
    assert {(r.q, r.answer) for r in sinks.submission(predictions, questions, "q", "answer").collect()} == {(1, ""), (2, "yes"), (3, "no")}
    assert {(r.image, r.answer) for r in sinks.submission_by_question(predictions, questions, "q", "answer", "image").collect()} == {("a", ""), ("b", "yes")}
