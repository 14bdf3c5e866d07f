"""Queries over the lines of ``documents``, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import lexicons as L
from millrace.functions import text as T
from millrace.functions import tokenize as TK
from millrace.operators import paragraphs as P
from millrace.operators import tree as TR
from millrace.sources.readers import spread


def _docs(spark, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _pattern(patterns) -> str:
    return "'" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "'"


TOKENS = r"len(regexp_extract_all(p, '\S+'))"
PARTS = "len(string_split(p, ' '))"
_CHARS = L.SPECIAL_CHARACTERS.replace("'", "''")
_WORDS = rf"list_filter(list_transform(regexp_split_to_array(@, '[ \n\t]'), lambda w: trim(lower(w), '{_CHARS}')), lambda w: w <> '')"
_RATIO = "coalesce(len(list_filter({w}, lambda w: list_contains({f}, w))) / nullif(len({w}), 0), 0.0)"


def _ratio(t: str) -> str:
    return _RATIO.replace('{w}', _WORDS.replace('@', t)).replace('{f}', _quoted(L.FLAGGED_WORDS))


def _contains(t: str, words) -> str:
    return f"len(list_filter({_quoted(words)}, lambda k: contains({t}, k))) > 0"


#: DuckDB conditions on a paragraph p, by the name of the rule.
CONDITIONS = {
    "f05_download_links": "regexp_matches(p, '(?i)For details on the|the link is')",
    "f06_source_refs": r"regexp_matches(p, '(?i)\ASpecial thanks|Published\s*by|All\s*photo\s*credits\s*and\s*copyright') OR regexp_matches(p, '\(cf\..*?\)\z') OR regexp_matches(p, '\([\p{L}\p{N}_\s&,]+\s*,\s*[0-9]{4,}\)\z')",
    "f07_uppercase": r"len(regexp_replace(p, '[^\p{Lu}]', '', 'g')) / nullif(len(regexp_replace(p, '[ \t\n\r\v\f]', '', 'g')), 0) > 0.8",
    "f08_numerical": r"p = '' OR len(regexp_replace(p, '[^\p{Nd}]', '', 'g')) / len(p) > 0.8",
    "f09_social_counter": f"len(list_filter({_quoted(L.COUNTER_ENDS)}, lambda k: ends_with(lower(p), k))) > 0",
    "f10_one_word": f"{TOKENS} = 1",
    "f11_short_pattern": f"{TOKENS} <= 10 AND {_contains('lower(p)', L.CALLS_TO_ACTION)}",
    "f12_flagged_ratio": f"{_ratio('p')} >= 0.02",
    "f14_header_footer": f"{_contains('p', L.HEADER_FOOTER_KEYWORDS)} OR len(p) < 10",
    "f19_advertisement": "lower(p) = 'advertisement'",
    "f20_short": f"{TOKENS} <= 2",
    "f21_too_short": f"{TOKENS} <= 4",
    "f22_aberrant_item": "starts_with(p, 'Things to do')",
    "f26_contact_time": f"{PARTS} < 10 AND regexp_matches(p, {_pattern(L.CONTACTS)})",
    "f28_social_media": rf"regexp_matches(lower(p), '^[^\n]*(?:{'|'.join(L.SOCIAL_ENDS)}) *:? *$') OR {_contains('lower(p)', L.SOCIAL_PHRASES)}",
    "f29_phone_author_time": rf"({PARTS} < 80 AND regexp_matches(p, {_pattern(L.PHONES)})) OR ({PARTS} < 20 AND regexp_matches(p, {_pattern(L.TIMES)})) OR ({PARTS} < 10 AND (starts_with(lower(trim(p)), 'by ') OR regexp_matches(p, {_pattern(L.AUTHORS)})))",
}
LINES = "SELECT doc_id, lang, unnest(range(0, len(ps))) AS idx, unnest(ps) AS p FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ps FROM documents)"


def _rule(name: str):
    return lambda spark, sf_dir: P.dropped_by(_docs(spark, sf_dir), P.RULES[name])


def para_split(spark, sf_dir: str) -> DataFrame:
    rows = P.paragraphs(_docs(spark, sf_dir)).select("doc_id", F.posexplode("paras").alias("idx", "p"))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), T.token_count(F.col("p")).cast("long").alias("n_tokens"), F.length("p").cast("long").alias("n_chars"))


def _rest(name: str, rewrite):
    """Paragraphs and characters that a whole-document filter leaves."""

    def query(spark, sf_dir: str) -> DataFrame:
        kept = P.paragraphs(_docs(spark, sf_dir)).withColumn("paras", rewrite(F.col("paras")))
        return kept.select("doc_id", F.size("paras").cast("long").alias("n_paras"), F.length(F.array_join("paras", "\n")).cast("long").alias("n_chars"))

    return query


def heads_discard(spark, sf_dir: str) -> DataFrame:
    """Of headings that follow each other with the same rank, the earlier goes: (page_id, idx) of those that go."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    tags = F.regexp_extract_all(F.lower("html"), F.lit("<(h[1-6]|p|li|td|img)[ >]"), 1)
    pairs = pages.select("page_id", tags.alias("tags"))
    hits = F.transform("tags", lambda t, i: F.when(t.startswith("h") & (t == F.get("tags", i + 1)), i))
    return pairs.select("page_id", F.explode(F.filter(hits, lambda i: i.isNotNull())).alias("idx")).select("page_id", F.col("idx").cast("long").alias("idx"))


def _gate(condition):
    def query(spark, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).where(condition()).select("doc_id")

    return query


def gate_images(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    images = F.regexp_count(F.lower("html"), F.lit("<img[ >]"))
    words = T.token_count(F.regexp_replace("html", "<[^>]*>", " "))
    return pages.where(P.gate_images(images, words)).select("page_id", images.cast("long").alias("images"))


def cascade_keep_by_lang(spark, sf_dir: str) -> DataFrame:
    kept = P.cascade(_docs(spark, sf_dir))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


def drop_audit(spark, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("p"))
    return rows.groupBy(F.coalesce(P.first_rule(F.col("p")), F.lit("kept")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def _trees(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "lang", TR.from_lines(F.col("text")).alias("xml"))


def tree_nodes(spark, sf_dir: str) -> DataFrame:
    return TR.nodes(_trees(spark, sf_dir), "doc_id").select("doc_id", "idx", "parent", "tag", "text")


def tree_text(spark, sf_dir: str) -> DataFrame:
    rows = TR.mapped(_trees(spark, sf_dir), "xml", lambda x: TR.to_text(TR.parse(x, blank=False)))
    return rows.select("doc_id", F.md5(F.col("xml").cast("binary")).alias("digest"))


def tree_xml(spark, sf_dir: str) -> DataFrame:
    """Documents read into fields and written again."""
    rows = TR.mapped(_trees(spark, sf_dir), "xml", lambda x: TR.to_xml(TR.document(x)))
    return rows.select("doc_id", F.length("xml").cast("long").alias("n_chars"), F.regexp_count("xml", F.lit("<p[>/]")).cast("long").alias("n_paras"))


def tree_cascade(spark, sf_dir: str) -> DataFrame:
    """All filters and gates, three times over: documents and characters kept by language."""
    kept = TR.cascade(_trees(spark, sf_dir)).where("xml is not null")
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("xml")).alias("n_chars"))


#: Snippets that each filter is meant for, and one that all leave alone.
SNIPPETS = {
    "f03": '<p title="[Video]x">a [Video]b</p>', "f05": "<p>For details on the plan, write to us.</p>", "f06": "<p>Published by the press of a town</p>", "f07": "<p>ALL OF THIS IS LOUD</p>",
    "f08": "<p>12345 678</p>", "f09": "<p>12 followers</p>", "f10": "<p>Alone</p>", "f11": "<p>Please sign in here</p>", "f12": "<p>anal words</p>", "f14": "<p>Watch on YouTube or elsewhere</p>",
    "f15": '<head rend="h2">a</head><head rend="h2">b</head>', "f16": "<p>The house was sold. Read more »</p>", "f18": "<graphic/>", "f19": "<p>Advertisement</p>", "f20": "<p>two words</p>",
    "f21": "<p>no more than four</p>", "f22": "<item>Things to do in winter</item>", "f24": "<p>[1] A book.</p>", "f25": "<p>Sponsored By</p>", "f26": "<p>published on a day</p>", "f27": "<p>(in brackets)</p>",
    "f28": "<p>Share :</p>", "f29": "<p>Call 202-358-1726 now</p>",
}


def tree_snippets(spark, sf_dir: str) -> DataFrame:
    """Every document with the snippet of one filter at its end, before and after that filter: elements that it drops."""
    names = sorted(SNIPPETS)
    at = F.pmod("doc_id", F.lit(len(names))).cast("int")
    snippet = F.element_at(F.array(*[F.lit(SNIPPETS[n]) for n in names]), at + 1)
    short = F.lit("<doc><main><p>This paragraph is long enough to stay whatever the filters ask of it, for it tells of nothing else.</p>")
    rows = _docs(spark, sf_dir).select(F.element_at(F.array(*map(F.lit, names)), at + 1).alias("filter"), F.concat(short, snippet, F.lit("</main><comments/></doc>")).alias("xml"))
    tagged = rows.select("filter", F.concat("filter", F.lit("|"), "xml").alias("xml"))
    done = TR.mapped(tagged, "xml", lambda x: str(x.count("<p") + x.count("<head") + x.count("<graphic") + x.count("<item") - (y := TR.serialise(TR.FILTERS[x[:3]](TR.parse(x[4:])))).count("<p") - y.count("<head") - y.count("<graphic") - y.count("<item")))
    return done.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("xml").cast("long")).alias("dropped"))


def tokenized(spark, sf_dir: str) -> DataFrame:
    """Words by the treebank's rules: how many, and how many of them are marks."""
    rows = TK.tokenized(_docs(spark, sf_dir))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size(F.filter("words", lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_marks"))


def queries() -> dict:
    found = {name: _rule(name) for name in P.RULES}
    found |= {
        "para_split": para_split,
        "t01_tree_nodes": tree_nodes,
        "t04_tree_xml": tree_xml,
        "t06_tree_text": tree_text,
        "g7_tree_cascade": tree_cascade,
        "f23_tree_snippets": tree_snippets,
        "c01_treebank_words": tokenized,
        "f15_adjacent_heads": heads_discard,
        "f25_reference_tail": _rest("f25", P.reference_tail),
        "f27_last_bracket": _rest("f27", P.last_bracket),
        "f24_square_brackets": _rest("f24", P.square_brackets),
        "f02_underline_split": _rest("f02", lambda ps: F.flatten(F.transform(ps, P.underline_segments))),
        "g1_words": _gate(lambda: P.gate_words(F.col("text"))),
        "g2_alpha": _gate(lambda: P.gate_alphabetic(F.col("text"))),
        "g3_stopwords": _gate(lambda: P.gate_stop_words(F.col("text"))),
        "g4_flagged": _gate(lambda: P.gate_flagged(F.col("text"))),
        "g5_img_ratio": gate_images,
        "g6_para_lengths": _gate(lambda: P.gate_paragraph_lengths(F.split("text", "\n"))),
        "cascade_keep_by_lang": cascade_keep_by_lang,
        "cascade_audit": drop_audit,
        "f04_trim_incomplete": lambda s, d: _docs(s, d).select("doc_id", F.length(F.array_join(P.trim_paragraphs(F.split("text", "\n")), "\n")).cast("long").alias("n_chars")),
        "f01_join_lines": lambda s, d: _docs(s, d).select("doc_id", F.length(P.join_lines(F.col("text"))).cast("long").alias("n_chars")),
    }
    return found


def oracles() -> dict:
    lines = f"WITH lines AS ({LINES})"
    found = {name: f"{lines} SELECT doc_id, idx FROM lines WHERE {c}" for name, c in CONDITIONS.items()}
    arrays = "SELECT doc_id, lang, string_split(text, chr(10)) AS ps FROM documents"
    rest = "SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_paras, CAST(len(array_to_string(ps, chr(10))) AS BIGINT) AS n_chars FROM rest"
    counts = r"list_transform(ps, lambda p: len(regexp_extract_all(p, '\S+')))"
    alone = f"SELECT *, CASE {' '.join(f'WHEN {CONDITIONS[n]} THEN {chr(39)}{n}{chr(39)}' for n in P.CASCADE)} END AS rule FROM lines"
    short = "coalesce(list_max(c), 0) < 35 AND (len(c) = 0 OR list_sum(c) / len(c) < 12)"
    valid = r"regexp_replace(text, '[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g')"
    ps = f"string_split(replace({valid}, chr(13), chr(10)), chr(10))"
    escaped = f"replace(replace(replace({valid}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    snippets = ", ".join(f"({i}, '{n}', {0 if n in ('f03',) else 1})" for i, n in enumerate(sorted(SNIPPETS)))
    found |= {
        "t01_tree_nodes": f"WITH d AS (SELECT doc_id, {ps} AS ps FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, 0 AS idx, NULL AS parent, 'doc' AS tag, NULL AS text FROM d UNION ALL SELECT doc_id, 1, 0, 'main', NULL FROM d UNION ALL SELECT doc_id, 2 + unnest(range(0, len(ps))), 1, 'p', CASE WHEN trim(unnest(ps)) = '' THEN NULL ELSE unnest(ps) END FROM d UNION ALL SELECT doc_id, 2 + len(ps), 0, 'comments', NULL FROM d) SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(parent AS BIGINT) AS parent, tag, text FROM n",
        "f23_tree_snippets": f"WITH f AS (SELECT * FROM (VALUES {snippets}) v(i, filter, drops)) SELECT filter, count(*) AS n, CAST(sum(drops) AS BIGINT) AS dropped FROM documents JOIN f ON doc_id % {len(SNIPPETS)} = i GROUP BY filter",
        "para_split": rf"{lines} SELECT doc_id, idx, CAST({TOKENS} AS BIGINT) AS n_tokens, CAST(len(p) AS BIGINT) AS n_chars FROM lines",
        "f15_adjacent_heads": "WITH t AS (SELECT page_id, regexp_extract_all(lower(html), '<(h[1-6]|p|li|td|img)[ >]', 1) AS tags FROM pages), x AS (SELECT page_id, tags, unnest(range(0, len(tags))) AS idx FROM t) SELECT page_id, idx FROM x WHERE starts_with(tags[idx + 1], 'h') AND tags[idx + 1] = tags[idx + 2]",
        "f25_reference_tail": f"WITH a AS ({arrays}), h AS (SELECT *, list_min(list_filter(range(0, len(ps)), lambda i: i >= CASE WHEN len(ps) > 20 THEN floor(len(ps) * 3 / 4) ELSE 0 END AND len(string_split(ps[i + 1], ' ')) < 10 AND contains(lower(ps[i + 1]), 'reference'))) AS cut FROM a), rest AS (SELECT doc_id, list_filter(CASE WHEN cut IS NULL THEN ps ELSE ps[1:cut] END, lambda p: NOT contains(lower(p), 'sponsore')) AS ps FROM h) {rest}",
        "f27_last_bracket": f"WITH a AS ({arrays}), rest AS (SELECT doc_id, CASE WHEN starts_with(ps[-1], '(') AND ends_with(ps[-1], ')') THEN ps[1:len(ps) - 1] ELSE ps END AS ps FROM a) {rest}",
        "f24_square_brackets": rf"WITH a AS ({arrays}), h AS (SELECT *, list_max(list_filter(range(1, len(ps) + 1), lambda i: regexp_matches(ps[i], '\A\[[0-9]{{1,2}}\]\s.*\.'))) AS last FROM a), rest AS (SELECT doc_id, CASE WHEN last > len(ps) - 5 THEN list_transform(list_filter(ps, lambda p: NOT regexp_matches(p, '\A\[[0-9]{{1,2}}\]\s.*\.')), lambda p: regexp_replace(p, '\s\[[0-9]{{1,2}}\]', '', 'g')) ELSE ps END AS ps FROM h) {rest}",
        "f02_underline_split": f"WITH a AS ({arrays}), parts AS (SELECT doc_id, list_transform(ps, lambda p: CASE WHEN regexp_matches(p, '_{{15,}}') THEN list_filter(regexp_split_to_array(p, '_{{15,}}'), lambda x: x <> '') ELSE [p] END) AS qs FROM a), rest AS (SELECT doc_id, flatten(list_transform(qs, lambda q: list_concat(q[1:1], list_reverse(q[2:])))) AS ps FROM parts) {rest}",
        "g1_words": r"SELECT doc_id FROM (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n, len(regexp_replace(text, '\s', '', 'g')) AS c FROM documents) WHERE n BETWEEN 50 AND 100000 AND c / n BETWEEN 3 AND 10",
        "g2_alpha": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^\s\p{L}]*\p{L}\S*')) / nullif(len(regexp_extract_all(text, '\S+')), 0) > 0.8",
        "g3_stopwords": rf"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: list_contains({_quoted(L.STOP_WORDS)}, w))) >= 2",
        "g4_flagged": f"SELECT doc_id FROM documents WHERE {_ratio('text')} <= 0.02",
        "g5_img_ratio": r"SELECT page_id, images FROM (SELECT page_id, CAST(len(regexp_extract_all(lower(html), '<img[ >]')) AS BIGINT) AS images, len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\S+')) AS words FROM pages) WHERE NOT (images > 2 AND words / greatest(images, 1) < 50)",
        "g6_para_lengths": f"SELECT doc_id FROM (SELECT doc_id, {counts} AS c FROM ({arrays})) WHERE NOT ({short})",
        "cascade_keep_by_lang": rf"{lines}, alone AS ({alone}), kept AS (SELECT doc_id, lang, list(p ORDER BY idx) AS ps FROM alone WHERE rule IS NULL GROUP BY doc_id, lang), texts AS (SELECT lang, {counts} AS c, array_to_string(ps, chr(10)) AS t FROM kept) SELECT lang, count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_chars FROM texts WHERE NOT ({short}) AND t <> '' GROUP BY lang",
        "cascade_audit": f"{lines}, alone AS ({alone}) SELECT coalesce(rule, 'kept') AS rule, count(*) AS n FROM alone GROUP BY 1",
    }
    return found
