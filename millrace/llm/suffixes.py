"""Suffix-array deduplication of repeated bytes by prefix-free parsing.

A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller id. Rolling-hash triggers
parse the documents into phrases (``repeats``). Equal phrases collapse in a dictionary, so highly repetitive text is
sorted once; the parse, which document has which phrase where, carries the answer to all of its occurrences. Of dictionary
phrases that share a trigger but differ, the owner sorts all suffixes up to the 50 bytes that matter: its part of a suffix
array of the dictionary. Neighbours that agree in 50 bytes are one string, and its smallest document keeps it. Every string
of 50 bytes holds its trigger, so no string is spread over owners.

Nulls and ties: a null or empty text has no bytes. Rows with equal ids never remove each other's bytes; a null id counts as
the largest. A text of any length is cut as a whole, in a slice of its own. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import LENGTH, Text, cut_repeats

#: Suffixes sorted at once; phrases of one trigger are always sorted together.
SORTED_SUFFIXES = 3_000_000


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as big-endian numbers, so that their order is that of the strings."""
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    out = np.zeros(len(data) + LENGTH, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def repeated_suffixes(doc: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, window, window) of the suffixes that agree with a smaller document's in ``LENGTH`` bytes."""
    sizes = np.array([len(x) for x in content], np.int64)
    first = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    phrase = np.repeat(np.arange(len(content)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = first[phrase] + at
    words = _words_at(np.frombuffer(b"".join(content), np.uint8))
    keys = [words[place + k] for k in range(0, LENGTH - 7, 8)]
    if LENGTH % 8:
        keys.append(words[place + LENGTH // 8 * 8] >> np.uint64(8 * (8 - LENGTH % 8)))
    order = np.lexsort((doc[phrase], *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    smallest = doc[phrase[order]][new][np.cumsum(new) - 1]
    again = order[doc[phrase[order]] > smallest]
    return phrase[again], at[again], at[again]


def sort_suffixes(trigger: np.ndarray, doc: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort the suffixes of whole groups of triggers, as many groups at a time as memory allows."""
    order = np.argsort(trigger, kind="stable")
    counts = np.cumsum([len(content[i]) - LENGTH + 1 for i in order])
    ends = np.flatnonzero(np.concatenate([trigger[order][1:] != trigger[order][:-1], [True]])) + 1
    found, start, done = [], 0, 0
    for k, end in enumerate(ends):
        if k + 1 == len(ends) or counts[ends[k + 1] - 1] - done > SORTED_SUFFIXES:
            part = order[start:end]
            phrase, lo, hi = repeated_suffixes(doc[part], [content[i] for i in part])
            found.append((part[phrase], lo, hi))
            start, done = end, counts[end - 1]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cut(text: Text, gone: np.ndarray) -> list[pa.Array]:
    """Counts of bytes, removed bytes and removed runs, and the digest of what remains."""
    keep = ~gone
    keep[text.last] = False  # the line feed after each document
    begins = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])
    kept = np.concatenate([[0], np.cumsum(keep)])
    out = text.bytes[keep].tobytes()
    digests = [hashlib.sha256(out[a:z]).hexdigest() for a, z in zip(kept[text.first].tolist(), kept[text.last].tolist(), strict=True)]
    n = text.last - text.first
    return [pa.array(n, pa.int64()), pa.array(n - (kept[text.last] - kept[text.first]), pa.int64()), pa.array(begins[text.last] - begins[text.first], pa.int64()), pa.array(digests, pa.string())]


def dedup(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs, False, sort_suffixes, cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
