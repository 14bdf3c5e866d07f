"""Paragraph filters and document gates.

A document is one row with an array of paragraphs, so every filter and the whole cascade stay within the row: nothing is
shuffled. Filters that depend on a paragraph's place use its index in the array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import lexicons as L
from millrace.functions import text as T

Rule = Callable[[Column], Column]


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def download_link(p: Column) -> Column:
    return p.rlike("(?i)" + _any(L.DOWNLOADS))


def source_reference(p: Column) -> Column:
    """Thanks, publishers and credits; or citations in brackets that end the paragraph."""
    certain = p.rlike(r"(?i)\ASpecial thanks|Published\s*by|All\s*photo\s*credits\s*and\s*copyright")
    return certain | p.rlike(r"\(cf\..*?\)\z") | p.rlike(r"\([\p{L}\p{N}_\s&,]+\s*,\s*[0-9]{4,}\)\z")


def mostly_uppercase(p: Column, most: float = 0.8) -> Column:
    visible = F.length(F.translate(p, " \t\n\r\x0b\x0c", ""))
    return F.try_divide(F.length(F.regexp_replace(p, r"[^\p{Lu}]", "")), visible) > most


def mostly_numerical(p: Column, most: float = 0.8) -> Column:
    return (p == "") | (F.try_divide(F.length(F.regexp_replace(p, r"[^\p{Nd}]", "")), F.length(p)) > most)


def social_counter(p: Column) -> Column:
    return F.lower(p).rlike(f"(?:{T.escaped(L.COUNTER_ENDS)})\\z")


def one_word(p: Column) -> Column:
    return T.token_count(p) == 1


def call_to_action(p: Column, most: int = 10) -> Column:
    return (T.token_count(p) <= most) & F.lower(p).rlike(T.escaped(L.CALLS_TO_ACTION))


def flagged(p: Column, least: float = 0.02) -> Column:
    return T.flagged_ratio(p) >= least


def header_or_footer(p: Column, least: int = 10) -> Column:
    return p.rlike(T.escaped(L.HEADER_FOOTER_KEYWORDS)) | (F.length(p) < least)


def two_words_or_fewer(p: Column) -> Column:
    return T.token_count(p) <= 2


def too_short(p: Column, most: int = 4) -> Column:
    return T.token_count(p) <= most


def contact_or_time(p: Column) -> Column:
    return (T.part_count(p) < 10) & p.rlike(_any(L.CONTACTS))


def social_line(p: Column) -> Column:
    return F.lower(p).rlike(f"(?d)\\A.*(?:{_any(L.SOCIAL_ENDS)}) *:? *\\z|{_any(L.SOCIAL_PHRASES)}")


def phone_author_time(p: Column) -> Column:
    n = T.part_count(p)
    author = F.lower(F.trim(p)).startswith("by ") | p.rlike(_any(L.AUTHORS))
    return ((n < 80) & p.rlike(_any(L.PHONES))) | ((n < 20) & p.rlike(_any(L.TIMES))) | ((n < 10) & author)


def advertisement(p: Column) -> Column:
    return F.lower(p) == "advertisement"


def things_to_do(p: Column) -> Column:
    return p.startswith("Things to do")


#: Filters that look at one paragraph alone, in the order of the cascade.
RULES: dict[str, Rule] = {
    "f05_download_links": download_link,
    "f06_source_refs": source_reference,
    "f07_uppercase": mostly_uppercase,
    "f08_numerical": mostly_numerical,
    "f09_social_counter": social_counter,
    "f10_one_word": one_word,
    "f11_short_pattern": call_to_action,
    "f12_flagged_ratio": flagged,
    "f14_header_footer": header_or_footer,
    "f19_advertisement": advertisement,
    "f20_short": two_words_or_fewer,
    "f21_too_short": too_short,
    "f22_aberrant_item": things_to_do,
    "f26_contact_time": contact_or_time,
    "f28_social_media": social_line,
    "f29_phone_author_time": phone_author_time,
}


def paragraphs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``paras``: the lines of the text."""
    return docs.withColumn("paras", F.split("text", "\n"))


def dropped_by(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, idx) of the paragraphs that a rule removes."""
    rows = paragraphs(docs).select("doc_id", F.posexplode("paras").alias("idx", "p"))
    return rows.where(rule(F.col("p"))).select("doc_id", F.col("idx").cast("long").alias("idx"))


def join_lines(paras: Column) -> Column:
    """Delete line feeds that no sentence ends before."""
    return F.regexp_replace(paras, r"(?<![.!?:;)'\"][ \t\n\r\x0b\x0c]{0,200})\n", "")


def underline_segments(p: Column) -> Column:
    """A paragraph as its segments between runs of 15 underscores or more: the first, then the others backwards."""
    parts = F.array_remove(F.split(p, "_{15,}"), "")
    turned = F.concat(F.slice(parts, 1, 1), F.reverse(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))))
    return F.when(p.rlike("_{15,}"), turned).otherwise(F.array(p))


def reference_tail(paras: Column) -> Column:
    """Keep what stands before a short paragraph with "reference" in the last quarter (anywhere in short documents)."""
    start = F.when(F.size(paras) > 20, F.floor(F.size(paras) * 3 / 4)).otherwise(F.lit(0))
    hits = F.transform(paras, lambda p, i: (i >= start) & (T.part_count(p) < 10) & F.lower(p).contains("reference"))
    at = F.array_position(hits, F.lit(True))
    kept = F.when(at == 0, paras).otherwise(F.slice(paras, F.lit(1), (at - 1).cast("int")))
    return F.filter(kept, lambda p: ~F.lower(p).contains("sponsore"))


def last_bracket(paras: Column) -> Column:
    """Without a last paragraph in brackets."""
    last = F.try_element_at(paras, F.lit(-1))
    hit = last.startswith("(") & last.endswith(")")
    return F.when(hit, F.slice(paras, F.lit(1), F.size(paras) - 1)).otherwise(paras)


def square_brackets(paras: Column) -> Column:
    """Without numbered references, if the last of them is among the last five paragraphs; their marks go as well."""
    is_ref = lambda p: p.rlike(r"\A\[[0-9]{1,2}\]\s.*\.")
    hits = F.transform(paras, is_ref)
    from_end = F.array_position(F.reverse(hits), F.lit(True))
    cleaned = F.transform(F.filter(paras, lambda p: ~is_ref(p)), lambda p: F.regexp_replace(p, r"\s\[[0-9]{1,2}\]", ""))
    return F.when((from_end > 0) & (from_end <= 5), cleaned).otherwise(paras)


#: What stands between sentences; a closing quote belongs to it.
SENTENCE_GAP = r"""(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)(?:"|')?\s"""


def _bound(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def trim_incomplete(p: Column, last: bool = False) -> Column:
    """Drop sentences from the front (the back if ``last``) until one is complete; nothing is left if none is."""

    def trim(parts: Column, gaps: Column) -> Column:
        done = F.transform(parts, lambda s: (s == "") | s.rlike("[.!?”\"]\\z"))
        at = F.array_position(F.reverse(done) if last else done, F.lit(True)).cast("int")
        pieces = F.transform(parts, lambda s, i: F.concat(F.coalesce(F.get(gaps, i - 1), F.lit("")), s) if last else F.concat(s, F.coalesce(F.get(gaps, i), F.lit(""))))
        kept = F.slice(pieces, F.lit(1), F.size(parts) - at + 1) if last else F.slice(pieces, at, F.size(parts))
        return F.when(at == 0, "").otherwise(F.array_join(kept, ""))

    return _bound(F.split(p, SENTENCE_GAP), lambda parts: _bound(F.regexp_extract_all(p, F.lit(SENTENCE_GAP), 0), lambda gaps: trim(parts, gaps)))


def trim_paragraphs(paras: Column) -> Column:
    """Trim from the front until a paragraph has something complete, then from the back; what has nothing gets empty."""

    def walk(ps: Column, last: bool) -> Column:
        def keep(cut: Column) -> Column:
            full = F.transform(cut, lambda t: t != "")
            at = F.array_position(F.reverse(full) if last else full, F.lit(True)).cast("int")
            place = F.when(at == 0, -1 if last else F.size(cut)).otherwise(F.size(cut) - at if last else at - 1)
            beyond = lambda i, n: i > n if last else i < n
            return _bound(place, lambda n: F.transform(ps, lambda p, i: F.when(beyond(i, n), "").when(i == n, F.get(cut, i)).otherwise(p)))

        return _bound(F.transform(ps, lambda p: trim_incomplete(p, last)), keep)

    return _bound(walk(paras, False), lambda ps: walk(ps, True))


# Document gates: conditions under which a document stays. Words are runs of visible characters.


def gate_words(t: Column, least: int = 50, most: int = 100_000) -> Column:
    n = T.token_count(t)
    mean = F.try_divide(F.length(F.regexp_replace(t, r"\s", "")), n)
    return n.between(least, most) & mean.between(3, 10)


def gate_alphabetic(t: Column, least: float = 0.8) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(t, F.lit(r"[^\s\p{L}]*\p{L}\S*")), T.token_count(t)) > least, F.lit(False))


def gate_stop_words(t: Column, least: int = 2) -> Column:
    return F.size(F.filter(F.split(t, r"\s+"), lambda w: w.isin(*L.STOP_WORDS))) >= least


def gate_flagged(t: Column, most: float = 0.02) -> Column:
    return T.flagged_ratio(t) <= most


def gate_images(images: Column, words: Column) -> Column:
    return ~((images > 2) & (words / F.greatest(images, F.lit(1)) < 50))


def gate_paragraph_lengths(paras: Column) -> Column:
    counts = F.transform(paras, T.token_count)
    mean = F.try_divide(F.aggregate(counts, F.lit(0), lambda a, n: a + n), F.size(counts))
    return ~((F.coalesce(F.array_max(counts), F.lit(0)) < 35) & ((F.size(counts) == 0) | (mean < 12)))


#: Rules of the cascade in documents of lines; each looks at one paragraph, so one pass applies them all.
CASCADE = ("f09_social_counter", "f10_one_word", "f11_short_pattern", "f14_header_footer", "f21_too_short")


def first_rule(p: Column, names: tuple[str, ...] = CASCADE) -> Column:
    """The name of the first rule that removes the paragraph, or null: an audit of the cascade."""
    hit = F.when(RULES[names[0]](p), names[0])
    for name in names[1:]:
        hit = hit.when(RULES[name](p), name)
    return hit


def cascade(docs: DataFrame, names: tuple[str, ...] = CASCADE, passes: int = 3) -> DataFrame:
    """Rewrite the text with the paragraphs that every rule keeps and drop documents that a gate rejects.

    Rules that look at a paragraph alone remove in one pass all that they ever remove, so further passes change nothing.
    """
    del passes
    kept = docs.withColumn("paras", F.filter(F.split("text", "\n"), lambda p: first_rule(p, names).isNull()))
    kept = kept.where(gate_paragraph_lengths(F.col("paras"))).withColumn("text", F.array_join("paras", "\n")).drop("paras")
    return kept.where(F.col("text") != "")
