"""Queries of scalar functions, joins and metrics over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import lexicons as L
from millrace.functions import text as T
from millrace.operators import joins as J
from millrace.operators import metrics as M


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(function, kind: str = "string"):
    """A scalar over the turns of conversations."""

    def query(spark, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "conversations").select("conv_id", "turn", function(F.col("text")).cast(kind).alias("out"))

    return query


def _turns_sql(expression: str) -> str:
    return f"SELECT conv_id, turn, {expression} AS out FROM conversations"


def _punctuation_sql(t: str) -> str:
    out = t
    for p in L.PUNCTUATION:
        q = p.replace("'", "''")
        touches = rf"contains({t}, '{q} ') OR contains({t}, ' {q}') OR regexp_matches({t}, '[0-9],[0-9]')"
        out = f"replace({out}, '{q}', CASE WHEN {touches} THEN '' ELSE ' ' END)"
    return rf"regexp_replace(regexp_replace({out}, '\.([^0-9.])', '\1', 'g'), '\.+$', '')"


def _map_sql(m: dict) -> str:
    return "map {" + ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in m.items()) + "}"


_PLAIN = rf"""array_to_string(list_transform(list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''),
  lambda w: coalesce({_map_sql(L.NUMBER_WORDS)}[w], w)), lambda w: w NOT IN ('a', 'an', 'the')), lambda w: coalesce({_map_sql(L.CONTRACTIONS)}[w], w)), ' ')"""


def _questions(spark, sf_dir: str) -> DataFrame:
    """Ten consecutive events are one question: their types are the truths, the first one's type is the answer."""
    events = _table(spark, sf_dir, "events").withColumn("q", F.floor(F.col("event_id") / 10))
    groups = events.groupBy("q").agg(F.array_sort(F.collect_list("event_type")).alias("truths"), F.min_by("event_type", "event_id").alias("answer"), F.min("user_id").alias("u"))
    return groups.where(F.size("truths") == 10).withColumn("question_type", F.pmod("u", F.lit(4))).withColumn("answer_type", F.substring("answer", 1, 1))


_QUESTIONS = "q AS (SELECT event_id // 10 AS q, list(event_type) AS truths, arg_min(event_type, event_id) AS answer, min(user_id) AS u FROM events GROUP BY 1 HAVING count(*) = 10)"
_SOFT = "(c * least(1.0, greatest(c - 1, 0) / 3) + (10 - c) * least(1.0, c / 3)) / 10"
_SCORED = f"{_QUESTIONS}, s AS (SELECT q, u % 4 AS question_type, substr(answer, 1, 1) AS answer_type, {_SOFT} AS score FROM (SELECT *, len(list_filter(truths, lambda t: t = answer)) AS c FROM q))"


def vqa_accuracy(spark, sf_dir: str) -> DataFrame:
    plain = lambda t: T.plain_answer(T.clear_punctuation(t))
    scored = _questions(spark, sf_dir).withColumn("score", M.soft_accuracy(plain(F.col("answer")), F.transform("truths", plain)))
    return M.by_every_grouping(scored, "score", "question_type", "answer_type")


def textvqa_soft(spark, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("q", F.round(M.soft_accuracy(F.col("answer"), F.col("truths")), 6).alias("score"))


def anls(spark, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(M.anls(F.col("p_name"), F.array("p_type", "p_brand", F.concat(F.col("p_name"), F.lit(" x")))), 6).alias("anls"))


_SIM = "CASE WHEN greatest(length(a), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein(a, {b}) / greatest(length(a), length({b})) END"


def _labelled(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")


def pope(spark, sf_dir: str) -> DataFrame:
    return M.binary_report(_labelled(spark, sf_dir), "lang", F.col("toxic"), F.length("text") % 3 == 0)


def rollup(spark, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").join(J.small(_table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return M.rollup_accuracy(rows, ["n_regionkey", "n_nationkey"], F.col("s_acctbal") > 0)


def capabilities(spark, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("caps"), (F.col("p_size") / 50).alias("score"), F.pmod("p_partkey", F.lit(5)).alias("run"))
    return M.capability_scores(part, "caps", "score", "run")


def judge(spark, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.floor("l_quantity").alias("a"), F.col("l_linenumber").alias("b"))
    return M.judge_summary(rows, "l_returnflag", "a", "b")


def trials(spark, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_type", F.floor("value").cast("double").alias("v"))
    return M.trial_summary(rows, "event_type", "v")


def auc(spark, sf_dir: str) -> DataFrame:
    return M.roc_auc(_labelled(spark, sf_dir), "quality", "n_chars")


def top_classes(spark, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    best = v.select("vec_id", F.explode(M.top_classes(F.col("v"), 3)).alias("b"))
    return best.select("vec_id", "b.place", F.round("b.share", 3).alias("share"))


def mode(spark, sf_dir: str) -> DataFrame:
    return M.first_mode(_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


def lengths(spark, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("texts"))
    return turns.select("conv_id", M.sequence_length(F.col("texts"), F.pmod("conv_id", F.lit(3))).cast("long").alias("length"))


def pred_ann(spark, sf_dir: str) -> DataFrame:
    """Predictions (labels) driven by their ids, with annotations (documents)."""
    return _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


def composite(spark, sf_dir: str) -> DataFrame:
    left = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.lower("l_returnflag").alias("f"))
    right = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lower("o_orderstatus").alias("s"))
    return left.join(right, (left["k"] == right["k"]) & (left["f"] == right["s"])).groupBy("f").agg(F.count(F.lit(1)).alias("n"))


def left_default(spark, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("answer"))
    joined = J.with_default(_table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, "doc_id", "answer", "FAILED")
    return joined.groupBy("lang", "answer").agg(F.count(F.lit(1)).alias("n"))


def two_sources(spark, sf_dir: str) -> DataFrame:
    """Ours where the other failed; an upper bound where either is right."""
    both = _labelled(spark, sf_dir).select((F.col("quality") == 1).alias("ours"), F.when(F.length("text") % 5 > 0, F.col("toxic") == 0).alias("other"))
    final = F.coalesce("other", "ours")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(final).alias("right"), F.count_if(F.col("ours") | F.coalesce("other", F.lit(False))).alias("upper_bound"), F.count_if(F.col("other").isNull()).alias("failed"))


def rule_default(spark, sf_dir: str) -> DataFrame:
    """Orders with the rule of their priority, or the default rule."""
    rules = spark.createDataFrame([("1-URGENT", "now"), ("2-HIGH", "soon"), ("default", "later")], "priority string, rule string")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    named = orders.join(F.broadcast(rules), F.col("o_orderpriority") == F.col("priority"), "left")
    return named.groupBy(F.coalesce("rule", F.lit("later")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def knn(spark, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    found = J.top_k(rows.where(F.pmod("vec_id", F.lit(20)) == 0), rows, 5, exclude_self=False)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


def self_knn(spark, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    found = J.top_k(rows, rows, 2)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


_KNN = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.e, d.e) / q.n / d.n, 6) AS similarity FROM u q, u d WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
SELECT query_id, rank, round(similarity, 4) AS similarity FROM r WHERE rank <= {k}"""


def missing(spark, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("answer"))
    return J.fill_missing(labels, _table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "answer")


def shard_ranges(spark, sf_dir: str) -> DataFrame:
    """Shards of 37 ids each, from the smallest to the largest id of the table."""
    ids = _table(spark, sf_dir, "documents").agg(F.floor(F.min("doc_id") / 37).alias("a"), F.floor(F.max("doc_id") / 37).alias("b"))
    shards = ids.select(F.explode(F.sequence("a", "b")).alias("shard")).select("shard", (F.col("shard") * 37).alias("start"), (F.col("shard") * 37 + 36).alias("stop"))
    found = J.in_range(_table(spark, sf_dir, "documents").select("doc_id"), shards, "doc_id", "start", "stop")
    return found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id") - F.col("start")).alias("places"))


def zip_positions(spark, sf_dir: str) -> DataFrame:
    left = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    right = _table(spark, sf_dir, "benchmark").select("item_id")
    return J.zip_positions(left, right, "doc_id", "item_id").select("doc_id", "toxic", "item_id")


def bleu(spark, sf_dir: str) -> DataFrame:
    """Every turn against itself with its sentences run together."""
    rows = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text", F.replace("text", F.lit(". "), F.lit(" the ")).alias("r"))
    return M.bleu(rows, "k", "text", "r")


def queries() -> dict:
    return {
        "c02_strip": _turns(T.strip_special),
        "c04_words": _turns(lambda t: F.array_join(T.plain_words(t), " ")),
        "c06_flagged_ratio": _turns(lambda t: F.round(T.flagged_ratio(t), 6), "double"),
        "c12_sha256_url": lambda s, d: _table(s, d, "pages").select("page_id", T.sha256_name(F.col("url")).alias("name")),
        "c13_signature": _turns(lambda t: T.request_signature(F.lit("app"), t, F.lit("salt"), F.lit("secret"))),
        "c15_caption_cut": _turns(T.caption_answer),
        "c16_vqa_cut": _turns(T.short_answer),
        "c18_punct": _turns(T.clear_punctuation),
        "c19_digit_article": _turns(T.plain_answer),
        "c21_tokens": _turns(T.simple_tokens),
        "c23_score_parse": lambda s, d: _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(T.judge_scores(F.concat(F.floor("l_quantity").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, ",").otherwise(" "), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 4, " x").otherwise(""))), lambda x: x.cast("int").cast("string")), "/").alias("scores")),
        "c24_letter_parse": lambda s, d: _table(s, d, "part").select("p_partkey", T.letter_answer(F.when(F.col("p_size") % 4 == 0, F.lit("B")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("C. "), "p_name")).when(F.col("p_size") % 4 == 2, F.concat("p_name", F.lit(" The answer is D."))).otherwise(F.col("p_name"))).alias("answer")),
        "c26_yes_no": _turns(T.yes_no),
        "m01_vqa_acc": vqa_accuracy, "m03_textvqa_soft": textvqa_soft, "m05_anls": anls, "m08_pope": pope, "m12_mmlu_rollup": rollup, "m13_capability": capabilities,
        "m14_judge_summary": judge, "m15_trials": trials, "m17_auc": auc, "m18_topk_conf": top_classes, "m21_mode": mode, "m26_lengths": lengths,
        "m06_bleu": bleu,
        "j01_pred_ann": pred_ann, "j03_positional": zip_positions, "j04_composite_key": composite, "j05_left_default": left_default, "j06_two_source": two_sources, "j08_rule_default": rule_default,
        "j10_knn_topk": knn, "j11_self_knn": self_knn, "j13_fill_missing": missing, "j15_shard_range": shard_ranges,
    }


def oracles() -> dict:
    chars = L.SPECIAL_CHARACTERS.replace("'", "''")
    words = rf"list_filter(list_transform(regexp_split_to_array(text, '[ \n\t]'), lambda w: trim(lower(w), '{chars}')), lambda w: w <> '')"
    flagged = "[" + ", ".join(f"'{w}'" for w in L.FLAGGED_WORDS) + "]"
    return {
        "c02_strip": _turns_sql(f"trim(text, '{chars}')"),
        "c04_words": _turns_sql(f"array_to_string({words}, ' ')"),
        "c06_flagged_ratio": _turns_sql(f"round(coalesce(len(list_filter({words}, lambda w: list_contains({flagged}, w))) / nullif(len({words}), 0), 0.0), 6)"),
        "c12_sha256_url": "SELECT page_id, sha256(url) AS name FROM pages",
        "c13_signature": _turns_sql("md5('app' || text || 'salt' || 'secret')"),
        "c15_caption_cut": _turns_sql("replace(string_split(text, 'Output')[1], chr(34), '')"),
        "c16_vqa_cut": _turns_sql("string_split(regexp_split_to_array(text, 'Question|Answer|Short')[1], ', ')[1]"),
        "c18_punct": _turns_sql(_punctuation_sql("text")),
        "c19_digit_article": _turns_sql(_PLAIN),
        "c21_tokens": _turns_sql("trim(replace(replace(replace(lower(text), ',', ''), '?', ''), '''s', ' ''s'))"),
        "c23_score_parse": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN '-1/-1' ELSE CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR) || '/' || l_linenumber END AS scores FROM lineitem",
        "c24_letter_parse": "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE 'FAILED' END AS answer FROM part",
        "c26_yes_no": _turns_sql("CASE WHEN list_has_any(string_split(replace(string_split(text, '.')[1], ',', ''), ' '), ['No', 'not', 'no']) THEN 'no' ELSE 'yes' END"),
        "m01_vqa_acc": f"WITH {_SCORED}, g AS (SELECT 'overall' AS level, '' AS key, score FROM s UNION ALL SELECT 'question_type', CAST(question_type AS VARCHAR), score FROM s UNION ALL SELECT 'answer_type', answer_type, score FROM s) SELECT level, key, count(*) AS n, round(100 * avg(score), 2) AS accuracy FROM g GROUP BY ALL",
        "m03_textvqa_soft": f"WITH {_SCORED} SELECT q, round(score, 6) AS score FROM s",
        "m06_bleu": r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(lower(replace(text, '. ', ' the ')), '\s+'), lambda x: x <> '') AS r FROM conversations),
          o AS (SELECT unnest(range(1, 5)) AS n),
          gp AS (SELECT conv_id, turn, n, array_to_string(p[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT conv_id, turn, n, p, unnest(range(1, len(p) - n + 2)) AS i FROM w, o) GROUP BY ALL),
          gr AS (SELECT conv_id, turn, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT conv_id, turn, n, r, unnest(range(1, len(r) - n + 2)) AS i FROM w, o) GROUP BY ALL),
          h AS (SELECT n, sum(least(gp.c, coalesce(gr.c, 0))) AS hit, sum(gp.c) AS every FROM gp LEFT JOIN gr USING (conv_id, turn, n, g) GROUP BY n),
          l AS (SELECT sum(len(p)) AS lp, sum(len(r)) AS lr FROM w)
          SELECT round(CASE WHEN count(*) = 4 THEN CASE WHEN lp > lr THEN 1.0 ELSE exp(1 - lr / lp) END * exp(avg(ln(hit / every))) ELSE 0.0 END, 6) AS bleu FROM h, l GROUP BY lp, lr""",
        "m05_anls": f"SELECT p_partkey, round(CASE WHEN best >= 0.5 THEN best ELSE 0.0 END, 6) AS anls FROM (SELECT p_partkey, greatest({', '.join(_SIM.format(b=b) for b in ('t1', 't2', 't3'))}) AS best FROM (SELECT p_partkey, lower(trim(p_name)) AS a, lower(trim(p_type)) AS t1, lower(trim(p_brand)) AS t2, lower(trim(p_name || ' x')) AS t3 FROM part))",
        "m08_pope": "WITH x AS (SELECT lang, toxic = 1 AS y, length(text) % 3 = 0 AS p FROM documents JOIN labels USING (doc_id)), n AS (SELECT lang, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn FROM x GROUP BY lang) SELECT *, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + fp) / nullif(tp + fp + tn + fn, 0), 6) AS yes_ratio FROM n",
        "m12_mmlu_rollup": "SELECT n_regionkey, n_nationkey, count(*) AS n, round(count(*) FILTER (s_acctbal > 0) / count(*), 6) AS accuracy FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)",
        "m13_capability": "WITH r AS (SELECT capability, run, 100 * avg(score) AS s FROM (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS capability, p_size / 50 AS score, p_partkey % 5 AS run FROM part) GROUP BY ALL) SELECT capability, count(*) AS runs, round(avg(s), 4) AS score, round(stddev_pop(s), 4) AS deviation FROM r GROUP BY capability",
        "m14_judge_summary": "WITH m AS (SELECT l_returnflag, avg(floor(l_quantity)) AS a, avg(l_linenumber) AS b, grouping(l_returnflag) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag)) SELECT CASE WHEN g = 1 THEN 'all' ELSE l_returnflag END AS category, round(100 * b / a, 1) AS ratio, round(10 * a, 1) AS first, round(10 * b, 1) AS second FROM m",
        "m15_trials": "SELECT event_type, count(value) AS trials, round(avg(floor(value)), 6) AS mean, round(stddev_pop(floor(value)), 6) AS deviation FROM events GROUP BY event_type",
        "m17_auc": "WITH x AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM x), t AS (SELECT CAST(sum(y) AS BIGINT) AS p, CAST(count(*) - sum(y) AS BIGINT) AS q, sum(k) FILTER (y = 1) AS w FROM r) SELECT p AS n_pos, q AS n_neg, round((w - p * (p + 1) / 2) / (p * q), 6) AS auc FROM t",
        "m18_topk_conf": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), x AS (SELECT vec_id, unnest(range(0, len(e))) AS place, unnest(e) AS x, list_sum(list_transform(e, lambda y: exp(y))) AS z FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) AS k FROM x) SELECT vec_id, place, round(round(exp(x) / z, 6), 3) AS share FROM r WHERE k <= 3",
        "m21_mode": "WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS a FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, a) AS k FROM n) SELECT user_id, event_type, n FROM r WHERE k = 1",
        "m26_lengths": r"WITH w AS (SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS w FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN conv_id % 3 > 0 THEN w + 576 * (conv_id % 3) ELSE -w END AS length FROM w",
        "j01_pred_ann": "SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM labels JOIN documents USING (doc_id) GROUP BY lang",
        "j03_positional": "WITH a AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM labels), b AS (SELECT *, row_number() OVER (ORDER BY item_id) AS k FROM benchmark) SELECT doc_id, toxic, item_id FROM a JOIN b USING (k)",
        "j04_composite_key": "SELECT lower(l_returnflag) AS f, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND lower(l_returnflag) = lower(o_orderstatus) GROUP BY 1",
        "j05_left_default": "SELECT lang, coalesce(CAST(quality AS VARCHAR), 'FAILED') AS answer, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
        "j06_two_source": "WITH b AS (SELECT quality = 1 AS ours, CASE WHEN length(text) % 5 > 0 THEN toxic = 0 END AS other FROM documents JOIN labels USING (doc_id)) SELECT count(*) AS n, count(*) FILTER (coalesce(other, ours)) AS right, count(*) FILTER (ours OR coalesce(other, false)) AS upper_bound, count(*) FILTER (other IS NULL) AS failed FROM b",
        "j08_rule_default": "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' ELSE 'later' END AS rule, count(*) AS n FROM orders GROUP BY 1",
        "j10_knn_topk": _KNN.format(where="q.vec_id % 20 = 0", k=5),
        "j11_self_knn": _KNN.format(where="q.vec_id <> d.vec_id", k=2),
        "j13_fill_missing": "SELECT doc_id, coalesce(CAST(toxic AS VARCHAR), '') AS answer FROM documents FULL JOIN labels USING (doc_id)",
        "j15_shard_range": "SELECT shard, count(*) AS n, CAST(sum(doc_id - shard * 37) AS BIGINT) AS places FROM documents JOIN (SELECT unnest(range((SELECT min(doc_id) // 37 FROM documents), (SELECT max(doc_id) // 37 + 1 FROM documents))) AS shard) ON doc_id BETWEEN shard * 37 AND shard * 37 + 36 GROUP BY shard",
    }
