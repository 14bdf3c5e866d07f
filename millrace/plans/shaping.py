"""Queries of shaping, arrangement, sampling, set and window operators, sources and streams, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import arrange as A
from millrace.operators import sampling as S
from millrace.sources import readers as R
from millrace.sources.readers import spread
from millrace.streaming import ingest as I


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark, sf_dir: str) -> DataFrame:
    """(conv_id, turns): a conversation is one row; its length is bounded by the format."""
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


_TURNS = "t AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id)".replace("{{", "{").replace("}}", "}")


def _lines(spark, sf_dir: str) -> DataFrame:
    """Documents as interleaved rows: every third line is an image, valid if its place is even."""
    ps = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ps"))
    return ps.select("doc_id", F.transform("ps", lambda p, i: F.when(i % 3 != 1, p)).alias("texts"), F.transform("ps", lambda _, i: i % 2 == 0).alias("valid"))


def _md5(t: str) -> str:
    return f"CAST(CAST('0x' || substr(md5('0:' || {t}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


def natural_text(spark, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", F.md5(A.natural_text(F.col("texts"), F.col("valid")).cast("binary")).alias("digest"))


def generated(spark, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit(". "), F.lit(". _!_IMAGE1_!_ "))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", A.generated_text(text, 3).alias("out"))


def label_mask(spark, sf_dir: str) -> DataFrame:
    ids = F.transform(F.sequence(F.lit(0), F.col("n_chars")), lambda i: F.pmod(i * 7 + F.col("doc_id"), F.lit(11)))
    masked = spread(_table(spark, sf_dir, "documents").select("doc_id", "n_chars")).select("doc_id", A.mask_labels(ids, 3, 5, 0).alias("m"))
    return masked.select("doc_id", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("labels"))


def chat(spark, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    return rows.select("conv_id", *[F.md5(A.chat_prompt(F.col("turns"), s).cast("binary")).alias(s) for s in ("single", "two", "chatml", "llama_2", "plain")])


def fewshot(spark, sf_dir: str) -> DataFrame:
    pairs = _turns(spark, sf_dir).select("conv_id", A.conversation_pairs(F.col("turns")).alias("p"))
    shots = F.transform(F.slice("p", 1, 2), lambda x: F.struct(x["question"].alias("q"), x["answer"].alias("a")))
    return pairs.select("conv_id", F.md5(A.fewshot_prompt(shots, F.lit("What?")).cast("binary")).alias("digest"))


def pairs(spark, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", F.explode(A.conversation_pairs(F.col("turns"))).alias("p")).select("conv_id", "p.question", "p.answer")


def rotations(spark, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(A.rotations(F.split("p_type", " "))).alias("round", "o"))
    return rows.select("p_partkey", F.col("round").cast("long").alias("round"), F.array_join("o", "|").alias("options"))


def image_front(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", A.images_first(F.replace(F.col("text"), F.lit(", "), F.lit(" <image> "))).alias("out"))


def resolution(spark, sf_dir: str) -> DataFrame:
    best = A.best_resolution(F.col("p_size") * 20, (F.col("p_partkey") % 700 + 100).cast("int"), [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)])
    return _table(spark, sf_dir, "part").select("p_partkey", best.alias("b")).select("p_partkey", "b.w", "b.h")


_CHOICES = "(VALUES (0, 336, 672), (1, 672, 336), (2, 672, 672), (3, 1008, 336), (4, 336, 1008)) c(i, w, h)"


def assignment(spark, sf_dir: str) -> DataFrame:
    """Total weight of the best assignment between the first and second half of each vector, 4 by 5."""
    v = _table(spark, sf_dir, "embeddings")
    m = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(4), F.lit(8)), lambda j: (F.get("embedding", i) * F.get("embedding", j)).cast("double")))
    return A.assignment(v.select("vec_id", m.alias("m")), "vec_id", "m").groupBy("vec_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("weight"), 5).alias("weight"))


def array_check(spark, sf_dir: str) -> DataFrame:
    """Interleaved rows whose images and texts exclude each other at every place."""
    rows = _lines(spark, sf_dir).withColumn("images", F.transform("texts", lambda t: F.when(t.isNull(), "x")))
    aligned = (F.size("images") == F.size("texts")) & F.forall(F.arrays_zip("images", "texts"), lambda z: z["images"].isNull() != z["texts"].isNull())
    return rows.groupBy(aligned.alias("aligned")).agg(F.count(F.lit(1)).alias("n"))


def image_cap(spark, sf_dir: str) -> DataFrame:
    """Only the first three valid images of a document stay valid."""
    rows = _lines(spark, sf_dir).select("doc_id", F.transform("valid", lambda v, i: v & (F.size(F.filter(F.slice("valid", F.lit(1), i + 1), lambda x: x)) <= 3)).alias("v"))
    return rows.select("doc_id", F.size(F.filter("v", lambda x: x)).cast("long").alias("kept"), F.array_position("v", False).alias("first_off"))


def hash_sample(spark, sf_dir: str) -> DataFrame:
    return S.bernoulli(_table(spark, sf_dir, "events"), "event_id", 0.1).select("event_id")


def one_per_group(spark, sf_dir: str) -> DataFrame:
    return S.one_per_group(_table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


def round_robin(spark, sf_dir: str) -> DataFrame:
    return S.round_robin(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7).select("o_orderkey", F.col("pos"), F.col("rank").cast("long").alias("rank"))


def chunks(spark, sf_dir: str) -> DataFrame:
    return S.balanced_chunks(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7).select("doc_id", F.col("chunk").cast("long").alias("chunk"))


def batches(spark, sf_dir: str) -> DataFrame:
    return S.batches(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32).select("doc_id", F.col("batch").cast("long").alias("batch"))


def length_groups(spark, sf_dir: str) -> DataFrame:
    found = S.length_groups(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 8, 4)
    return found.select("doc_id", F.col("megabatch").cast("long").alias("megabatch"), F.col("place").cast("long").alias("place"), F.col("slot").cast("long").alias("slot"))


def union_all(spark, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("supplier"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("supplier").agg(F.count(F.lit(1)).alias("n"))


def except_filter(spark, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    used = (F.size("turns") > 4) & F.get("turns", 0)["text"].contains(" ")
    return turns.where(~used).select("conv_id")


def last_wins(spark, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def main_bodies(spark, sf_dir: str) -> DataFrame:
    return R.extract_pages(_table(spark, sf_dir, "pages")).select("page_id", F.length("body").cast("long").alias("n_chars"), T.token_count(F.col("body")).cast("long").alias("n_tokens"))


def repaired(spark, sf_dir: str) -> DataFrame:
    """Event properties with junk at the end of every third line."""
    lines = _table(spark, sf_dir, "events").select("event_id", F.concat("props", F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("}"), (F.col("event_id") % 5 + 1).cast("int"))).otherwise("")).alias("value"))
    return R.repair_json(lines).select("event_id", "json", "lost")


def grouped_members(spark, sf_dir: str) -> DataFrame:
    """Events as members of archives of forty, two to a stem."""
    n = F.col("event_id")
    name = F.concat(F.lit("a.b/s"), F.floor(n / 2).cast("string"), F.when(n % 2 == 0, ".jpg").otherwise(".TXT"))
    rows = _table(spark, sf_dir, "events").select(F.floor(n / 40).cast("string").alias("path"), n.cast("int").alias("pos"), name.alias("name"), F.lit("x").cast("binary").alias("data"))
    return R.group_by_key(rows).select("path", F.col("sample").cast("long").alias("sample"), "key", F.size("parts").cast("long").alias("n_parts"))


def windows(spark, sf_dir: str) -> DataFrame:
    counted = I.counts_by_window(_table(spark, sf_dir, "events"), "ts", "1 hour", "1 day", "event_type")
    return counted.groupBy("event_type").agg(F.count(F.lit(1)).alias("hours"), F.sum("n").alias("n"))


def not_done(spark, sf_dir: str) -> DataFrame:
    return I.not_done(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def live(spark, sf_dir: str) -> DataFrame:
    return I.live_workers(_table(spark, sf_dir, "events"), "user_id", "ts", 30 * 3600).select("user_id")


def heads_before(spark, sf_dir: str) -> DataFrame:
    """The type of the user's event before and after each, and whether a purchase came already."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = F.max((F.col("event_type") == "purchase").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _table(spark, sf_dir, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), seen.cast("long").alias("seen"))


def queries() -> dict:
    return {
        "a01_assignment_weight": assignment, "a04_natural_text": natural_text, "a06_generated_markers": generated, "a11_label_mask": label_mask,
        "a07_caption_text": lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", A.caption_text(F.col("text")).alias("out")),
        "a14_chat_prompt": chat, "a16_fewshot_prompt": fewshot, "a19_resolution": resolution,
        "p04_parallel_array_check": array_check, "p05_image_cap": image_cap, "p10_pair_explode": pairs, "p11_option_rotation": rotations, "p12_image_front": image_front,
        "r03_round_robin": round_robin, "r04_chunks": chunks, "r09_hash_sample": hash_sample, "r11_length_groups": length_groups, "r12_batches": batches, "r17_one_per_group": one_per_group,
        "u01_union": union_all, "u02_except_filter": except_filter, "u03_last_wins": last_wins,
        "s03_json_repair": repaired, "s08_group_by_key": grouped_members, "s27_html_mainbody": main_bodies,
        "x04_not_done": not_done, "x05_live_workers": live, "x07_window_counts": windows, "w01_neighbours": heads_before,
    }


def oracles() -> dict:
    lines = "x AS (SELECT doc_id, unnest(range(0, len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))"
    parts = f"{lines}, y AS (SELECT doc_id, i, CASE WHEN i % 3 <> 1 THEN p WHEN i % 2 = 0 THEN '<|endofchunk|><image>' ELSE '' END AS p FROM x), j AS (SELECT doc_id, coalesce(string_agg(p, ' ' ORDER BY i) FILTER (p <> ''), '') AS t FROM y GROUP BY doc_id)"
    first = "CASE WHEN contains(t, '<|endofchunk|>') THEN substr(t, 1, position('<|endofchunk|>' IN t) - 1) || substr(t, position('<|endofchunk|>' IN t) + 14) ELSE t END"
    clean = "replace(replace(replace({}, ' <|endofchunk|>', '<|endofchunk|>'), '<image> ', '<image>'), ' <image>', '<image>')".format(first)
    turn = lambda f: f"array_to_string(list_transform(turns, lambda t: {f}), '')"
    styles = {
        "single": "t.role || ': ' || t.text || '###'",
        "two": "t.role || ': ' || t.text || CASE WHEN t.role = 'assistant' THEN '</s>' ELSE ' ' END",
        "chatml": "'<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)",
        "llama_2": "CASE WHEN t.role = 'user' THEN '[INST] ' || t.text || ' [/INST]' ELSE ' ' || t.text || ' </s>' END",
        "plain": "t.text || chr(10)",
    }
    paired = f"{_TURNS}, p AS (SELECT conv_id, unnest(range(0, len(turns) // 2)) AS i, turns FROM t), q AS (SELECT conv_id, i, turns[2 * i + 1].text AS question, turns[2 * i + 2].text AS answer FROM p)"
    mask = r"WITH d AS (SELECT doc_id, unnest(range(0, n_chars + 1)) AS i FROM documents), x AS (SELECT doc_id, i, (i * 7 + doc_id) % 11 AS x FROM d), e AS (SELECT *, last_value(CASE WHEN x IN (3, 5) THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM x), m AS (SELECT doc_id, i, CASE WHEN last = 3 AND x NOT IN (0, 3) THEN x ELSE -100 END AS label FROM e)"
    return {
        "a04_natural_text": f"WITH {parts} SELECT doc_id, md5({clean} || '<|endofchunk|></s>') AS digest FROM j",
        "a06_generated_markers": f"WITH j AS (SELECT conv_id, turn, replace(text, '. ', '. <|endofchunk|><image> ') AS t FROM conversations), c AS (SELECT conv_id, turn, {clean} AS c FROM j) SELECT conv_id, turn, CASE WHEN len(string_split(c, '<image>')) - 1 > 3 THEN array_to_string(string_split(c, '<image>')[1:3], '<image>') ELSE c END AS out FROM c",
        "a07_caption_text": "SELECT conv_id, turn, '<image>' || trim(text) || '<|endofchunk|></s>' AS out FROM conversations",
        "a11_label_mask": f"{mask} SELECT doc_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY i) AS labels FROM m GROUP BY doc_id",
        "a14_chat_prompt": f"WITH {_TURNS} SELECT conv_id, {', '.join(f'md5({turn(f)}) AS {k}' for k, f in styles.items())} FROM t",
        "a16_fewshot_prompt": f"WITH {paired}, s AS (SELECT conv_id, string_agg('<image>Question:' || question || ' Short answer:' || answer || '<|endofchunk|>', '' ORDER BY i) FILTER (i < 2) AS s FROM q GROUP BY conv_id) SELECT conv_id, md5(CASE WHEN s IS NULL THEN '' ELSE s || '<image>' END || 'Question:What? Short answer:') AS digest FROM t LEFT JOIN s USING (conv_id)",
        "a19_resolution": f"WITH p AS (SELECT p_partkey, p_size * 20 AS pw, p_partkey % 700 + 100 AS ph FROM part), r AS (SELECT p_partkey, i, w, h, least(floor(pw * least(w / pw, h / ph)) * floor(ph * least(w / pw, h / ph)), pw * ph) AS kept FROM p, {_CHOICES}), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY kept DESC, w * h - kept, i) AS n FROM r) SELECT p_partkey, w, h FROM k WHERE n = 1",
        "p04_parallel_array_check": "SELECT true AS aligned, count(*) AS n FROM documents",
        "p05_image_cap": "WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, CAST(least((n + 1) // 2, 3) AS BIGINT) AS kept, CAST(CASE WHEN n < 2 THEN 0 ELSE 2 END AS BIGINT) AS first_off FROM d",
        "p10_pair_explode": f"WITH {paired} SELECT conv_id, question, answer FROM q",
        "p11_option_rotation": "WITH o AS (SELECT p_partkey, string_split(p_type, ' ') AS o FROM part), r AS (SELECT p_partkey, o, unnest(range(0, len(o))) AS round FROM o) SELECT p_partkey, round, array_to_string(list_concat(o[round + 1:], o[1:round]), '|') AS options FROM r",
        "p12_image_front": "WITH t AS (SELECT conv_id, turn, replace(text, ', ', ' <image> ') AS t FROM conversations) SELECT conv_id, turn, repeat('<image>' || chr(10), len(string_split(t, '<image>')) - 1) || trim(replace(t, '<image>', '')) AS out FROM t",
        "r03_round_robin": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS rank FROM orders",
        "r04_chunks": "SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS chunk FROM documents",
        "r09_hash_sample": f"SELECT event_id FROM events WHERE {_md5('CAST(event_id AS VARCHAR)')} < 0.1",
        "r11_length_groups": f"WITH m AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY {_md5('CAST(doc_id AS VARCHAR)')}) - 1) // 32 AS megabatch FROM documents), p AS (SELECT doc_id, megabatch, row_number() OVER (PARTITION BY megabatch ORDER BY n_chars DESC, doc_id) - 1 AS place FROM m) SELECT doc_id, megabatch, place, place // 8 AS slot FROM p",
        "r12_batches": "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS c FROM documents) SELECT doc_id, pos // 32 AS batch FROM n WHERE pos < c // 32 * 32",
        "r17_one_per_group": f"SELECT user_id, arg_min(event_id, ({_md5('CAST(event_id AS VARCHAR)')}, event_id)) AS event_id FROM events GROUP BY user_id",
        "u01_union": "SELECT NULL::INT AS supplier, count(*) AS n FROM customer UNION ALL SELECT 1, count(*) FROM supplier",
        "u02_except_filter": f"WITH {_TURNS} SELECT conv_id FROM t WHERE NOT (len(turns) > 4 AND contains(turns[1].text, ' '))",
        "u03_last_wins": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
        "s03_json_repair": "SELECT event_id, props AS json, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 5 + 1 ELSE 0 END AS INT) AS lost FROM events",
        "s08_group_by_key": "WITH m AS (SELECT event_id // 40 AS a, event_id // 2 AS k, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(a AS VARCHAR) AS path, row_number() OVER (PARTITION BY a ORDER BY k) AS sample, 'a.b/s' || k AS key, n AS n_parts FROM m",
        "x04_not_done": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "x05_live_workers": "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id FROM l WHERE floor(epoch((SELECT max(last) FROM l))) - floor(epoch(last)) <= 30 * 3600",
        "x07_window_counts": "SELECT event_type, count(DISTINCT date_trunc('hour', ts)) AS hours, count(*) AS n FROM events GROUP BY event_type",
        "w01_neighbours": "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, CAST(max(CAST(event_type = 'purchase' AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    }
