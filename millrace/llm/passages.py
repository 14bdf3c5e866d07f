"""Substring deduplication of repeated passages of words, located by Aho-Corasick automata.

A word is removed if a window of 50 words that covers it also starts in a document with a smaller id. Phrases that repeat
whole are settled by the dictionary of ``repeats``, which tells them apart by 96 bits of hash. For the others, an owner of triggers is a shard: it confirms which
passages recur among the phrases sent to it, compiles them into automata over word numbers, and streams the phrases
through these to locate every occurrence. A passage counts where its document is larger than the smallest one that the
automaton found it in, so among these a hash alone never removes a word.

Nulls and ties: a null or empty text has no words. Rows with equal ids never remove each other's words; a null id counts
as the largest. A text of any length is cut as a whole, in a slice of its own. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import LENGTH, Text, _mix, _sums, cut_repeats

#: Passages in one automaton; a shard compiles as many automata as it needs, one after the other.
AUTOMATON_PASSAGES = 20_000


def candidates(trigger: np.ndarray, doc: np.ndarray, words: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first window, last window) of stretches of windows that seem to start in one smaller document's phrase."""
    sizes = np.array([len(x) for x in words], np.int64)
    first = np.cumsum(sizes) - sizes
    every = np.concatenate([np.array(x, np.uint64) for x in words])
    sums, down = _sums(_mix(every + np.uint64(1)))
    counts = sizes - LENGTH + 1
    phrase = np.repeat(np.arange(len(words)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = first[phrase] + at
    window = _mix((sums[place + LENGTH] - sums[place]) * down[place]) ^ trigger[phrase]
    order = np.lexsort((at, phrase, doc[phrase], window))
    new = np.concatenate([[True], window[order][1:] != window[order][:-1]])
    source = np.empty(len(order), np.int64)
    source[order] = order[new][np.cumsum(new) - 1]
    again = doc[phrase] > doc[phrase[source]]
    shift = at - at[source]
    goes_on = np.concatenate([[False], again[:-1] & (phrase[1:] == phrase[:-1]) & (phrase[source][1:] == phrase[source][:-1]) & (shift[1:] == shift[:-1])])
    starts = np.flatnonzero(again & ~goes_on)
    ends = np.flatnonzero(again & ~np.concatenate([goes_on[1:] & again[1:], [False]]))
    return phrase[starts], at[starts], at[ends]


def locate(trigger: np.ndarray, doc: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Confirm recurring passages, compile them, and find every occurrence in a larger document."""
    numbers: dict[bytes, int] = {}
    words = [tuple([numbers.setdefault(w, len(numbers)) for w in x.split()]) for x in content]
    phrase, lo, hi = candidates(trigger, doc, words)
    passages = sorted({words[p][a : z + LENGTH] for p, a, z in zip(phrase.tolist(), lo.tolist(), hi.tolist(), strict=True)})
    found: list[tuple[int, int, int]] = []
    for start in range(0, len(passages), AUTOMATON_PASSAGES):
        shard = passages[start : start + AUTOMATON_PASSAGES]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, x in enumerate(shard):
            automaton.add_word(x, k)
        automaton.make_automaton()
        hits = [(k, p, end) for p, x in enumerate(words) for end, k in automaton.iter(x)]
        smallest: dict[int, int] = {}
        for k, p, _ in hits:
            smallest[k] = min(smallest.get(k, doc[p]), doc[p])
        found += [(p, end + 1 - len(shard[k]), end + 1 - LENGTH) for k, p, end in hits if doc[p] > smallest[k]]
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def cut(text: Text, gone: np.ndarray) -> list[pa.Array]:
    """Counts of words and of removed words, and the digest of the kept words with one space between them."""
    n = np.diff(text.bounds)
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[text.bounds[1:]] - before[text.bounds[:-1]]
    kept = ~gone
    change = np.zeros(len(text.bytes) + 1, np.int8)
    change[text.starts[kept]] = 1
    change[text.ends[kept] + 1] -= 1  # the byte after a word becomes the space after it
    out = text.bytes.copy()
    out[text.ends] = 0x20
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    out = out[inside].tobytes()
    sizes = (text.ends - text.starts + 1) * kept
    ends = np.concatenate([[0], np.cumsum(sizes)])
    spans = zip(ends[text.bounds[:-1]].tolist(), ends[text.bounds[1:]].tolist(), strict=True)
    digests = [hashlib.sha256(out[a : max(a, z - 1)]).hexdigest() for a, z in spans]
    return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]


def dedup(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs, True, locate, cut, "n_words long, n_removed long, kept_sha256 string")


def op9_passages(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
