"""Windows that repeat across documents, found by phrases that rolling-hash triggers cut.

A window is ``LENGTH`` consecutive units (bytes, or words) of one document. Its trigger is the leftmost of its grams of
``GRAM`` units with the smallest rolling hash, so equal windows have equal triggers wherever they stand. The windows of one
trigger are consecutive; the units that they cover are a phrase. A document is parsed into its phrases in order, and two
phrases with the same content hold the same windows at the same places.

1. ``parse``: each task cuts its documents into phrases and sends (trigger, phrase digest, document) to the owner of the
   trigger. A task first settles phrases it holds itself: only its smallest document speaks for one, so a phrase of a third
   of all documents reaches its owner once a task.
2. ``dictionary``: an owner sorts its phrases. A phrase that a smaller document has too is settled as repeated. A phrase
   whose trigger also stands in other phrases may share some of its windows, and is asked for.
3. ``collect``: the documents meet the answers bucket by bucket and send the content of the phrases asked for.
4. ``settle``: owners compare windows of different phrases with the same trigger, exactly, by the caller's method.
5. ``finish``: the documents meet all repeated windows and are cut.

Phrases are told apart by 48 bits of XXH3 over their bytes beside 48 bits of their trigger, 96 in all: at 100 TB the chance
that any two different ones agree is below one in a thousand. The rolling hashes only decide where texts are cut. Rows are
addressed by their bucket and a 64-bit digest of id and text; the bucket comes from another digest, so an address gains
bits as the table grows. A null id counts as larger than any other.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release_shuffles, session, small_batches, text_slices

LENGTH = 50
GRAM = 25
#: Phrases an owner sorts at once, about, and phrases a task holds before it sends them.
OWNER_PHRASES = 2_000_000
HELD_PHRASES = 1_500_000
#: Bytes of text in a bucket of documents.
BUCKET_BYTES = 16 << 20
NULL_ID = (1 << 63) - 1
#: Bytes of text that a worker cuts at once: each takes some 100 bytes of arrays meanwhile.
SLICE_BYTES = 1 << 20
#: Words of more bytes get their number from their bytes: sums modulo 2^64 agree for some regular strings of 1,024 and more.
LONG_WORD = 32

_ODD = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes.maketrans(bytes(range(ord("A"), ord("Z") + 1)), bytes(range(ord("a"), ord("z") + 1)))
_SYMBOLS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sums(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any run follows by a difference and a product."""
    up, down = _powers(len(u) + 1)
    sums = np.zeros(len(u) + 1, np.uint64)
    np.cumsum(u * up[:-1], out=sums[1:])
    return sums, down


class Text:
    """The texts of some documents end to end, each followed by a line feed, and their units."""

    def __init__(self, texts: list[str | None], words: bool, lower: bool = False) -> None:
        data = [(x or "").encode() for x in texts]
        if lower:
            data = [x.translate(_LOWER) for x in data]
        self.raw = b"\n".join([*data, b""])
        self.bytes = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(x) for x in data], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.last = self.first + sizes
        self.words = words
        if words:
            blank = _BLANK[self.bytes]
            self.starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
            self.ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
            sums, down = _sums(_SYMBOLS[self.bytes])
            sizes = self.ends - self.starts
            self.units = _mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + sizes.astype(np.uint64))
            for i in np.flatnonzero(sizes > LONG_WORD).tolist():
                self.units[i] = xxhash.xxh3_64_intdigest(self.raw[self.starts[i] : self.ends[i]])
            plain, kept = self.bytes.copy(), ~blank
            plain[self.ends], kept[self.ends] = 0x20, True  # the byte after a word becomes the space after it
            self.spaced, self.at = plain[kept].tobytes(), np.concatenate([[0], np.cumsum(sizes + 1)])
            self.bounds = np.searchsorted(self.starts, np.concatenate([self.first, [len(self.bytes)]]))
        else:
            self.units = _SYMBOLS[self.bytes]
            self.bounds = np.concatenate([self.first, [len(self.bytes)]])

    def spans(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The bytes of units a to b - 1, for each pair; words with one space between them."""
        if self.words:
            data, pairs = self.spaced, zip(self.at[a].tolist(), (self.at[b] - 1).tolist(), strict=True)
        else:
            data, pairs = self.raw, zip(a.tolist(), b.tolist(), strict=True)
        return [data[x:y] for x, y in pairs]

    def length(self) -> np.ndarray:
        """Units of each document."""
        return np.diff(self.bounds) - (0 if self.words else 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        x, reach = np.minimum(x[:-reach], x[reach:]), reach * 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


def phrases(text: Text, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, trigger hash, phrase digest) of each phrase; windows count over all units."""
    u, sizes = text.units, text.length()
    none = np.empty(0, np.int64)
    if len(u) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, down = _sums(u)
    grams = _mix((sums[gram:] - sums[: len(sums) - gram]) * down[: len(sums) - gram])
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 31) - 1)
    at = (sliding_min((grams & ~low) | place, length - gram + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), np.diff(text.bounds))[: len(at)]
    inside = np.arange(len(at)) + length <= text.bounds[doc] + sizes[doc]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]) & inside
    s = np.flatnonzero(new)
    stops = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    digest = np.fromiter(map(xxhash.xxh3_64_intdigest, text.spans(s, stops + length)), np.uint64, len(s))
    return doc[s], s, stops, grams[at[s]], digest


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    return pickle.dumps(arrays, 5)


def _six(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower six bytes of each number."""
    return x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint16)


def _eight(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_SENT = pa.schema([("owner", pa.int32()), ("kind", pa.int32()), ("b", pa.int32()), ("payload", pa.binary())])
_SENT_SQL = "owner int, kind int, b int, payload binary"


def keyed(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(rk, doc, doc_id, text, b) of each row, the number of buckets, and the bytes of text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = int(session(docs).conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-size // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64(F.lit(1), "text", "doc_id"), F.lit(buckets)).cast("int").alias("b")
    return docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "doc_id", "text", bucket), buckets, size


def _by_bucket(b: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(b, kind="stable")
    b, columns = b[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(b)], strict=True):
        if z > a:
            yield int(b[a]), [c[a:z] for c in columns]


def parse(work: DataFrame, words: bool, owners: int) -> DataFrame:
    """Step 1: phrases for their owners (kind 0) and what a task settles alone for the buckets (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for rows in text_slices(batch, most=SLICE_BYTES):
                text = Text(rows.column("text").to_pylist(), words)
                doc, _, _, trigger, digest = phrases(text)
                n = np.bincount(doc, minlength=len(rows))
                ordinal = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                held.append([trigger, digest, *(rows.column(c).to_numpy()[doc] for c in ("doc", "rk", "b")), ordinal])
                size += len(doc)
                if size >= HELD_PHRASES:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def send(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        trigger, digest, doc, rk, b, ordinal = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ordinal, b, rk, doc, digest, trigger))
        trigger, digest, doc, rk, b, ordinal = (x[order] for x in (trigger, digest, doc, rk, b, ordinal))
        first = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (digest[1:] != digest[:-1])])
        group = np.cumsum(first) - 1
        smallest = doc[first][group]
        once = np.concatenate([[True], ~((group[1:] == group[:-1]) & (rk[1:] == rk[:-1]) & (b[1:] == b[:-1]))])
        known = doc > smallest
        rows = []
        owner = (trigger % np.uint64(owners)).astype(np.int64)
        keep = ~known & once
        by_row = np.lexsort((ordinal[keep], b[keep], rk[keep], doc[keep]))
        for to, (a, e, d, r, q, o) in _by_bucket(owner[keep][by_row], *(x[keep][by_row] for x in (trigger, digest, doc, rk, b, ordinal))):
            fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (q[1:] != q[:-1])])
            places = o.astype(np.uint16 if o.max() < 1 << 16 else np.uint32)
            rows.append((to, 0, 0, _pack(*_six(a), *_six(e), d[fresh], r[fresh], q[fresh], np.packbits(fresh), places)))
        some = known & once
        for q, (r, o) in _by_bucket(b[some], rk[some], ordinal[some].astype(np.int32)):
            rows.append((q % owners, 1, q, _pack(r, o, np.ones(len(r), np.uint8))))
        yield _batch(rows, _SENT)

    return work.select("rk", "doc", "b", "text").mapInArrow(run, _SENT_SQL)


def dictionary(sent: DataFrame) -> DataFrame:
    """Step 2: (b, payload): rows, ordinals and flags; 1 for a repeated phrase, 2 for one whose content is asked for."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out, parts = [], []
        for kind, b, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "b", "payload")), strict=True):
            if kind:
                out.append((0, 1, b, payload))
            else:
                *sixes, d, r, q, fresh, places = pickle.loads(payload)
                at = np.cumsum(np.unpackbits(fresh, count=len(places)), dtype=np.int64) - 1
                parts.append((_eight(*sixes[:2]), _eight(*sixes[2:]), d[at], r[at], q[at], places))
        if parts:
            a, e, d, r, q, o = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((d, e, a))
            a, e, d, r, q, o = (x[order] for x in (a, e, d, r, q, o))
            next_a = np.concatenate([[True], a[1:] != a[:-1]])
            next_e = next_a | np.concatenate([[True], e[1:] != e[:-1]])
            smallest = d[next_e][np.cumsum(next_e) - 1]
            of_a = np.cumsum(next_a) - 1
            several = np.bincount(of_a[next_e])[of_a] > 1
            flag = np.where(d > smallest, 1, np.where(several, 2, 0)).astype(np.uint8)
            some = flag > 0
            for b, (rr, oo, ff) in _by_bucket(q[some], r[some], o[some].astype(np.int32), flag[some]):
                out.append((0, 1, b, _pack(rr, oo, ff)))
        return pa.Table.from_batches([_batch(out, _SENT)])

    return sent.groupBy("owner").applyInArrow(run, _SENT_SQL).select("b", "payload")


def _answers(table: pa.Table, width: int) -> list[np.ndarray]:
    """What the payloads hold, in order of rows."""
    parts = [pickle.loads(x) for x in table.column("payload").to_pylist()]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * width
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _hits(rk: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``rk``: pairs (row, place in the sorted ``known``) of all that agree."""
    lo, hi = np.searchsorted(known, rk, "left"), np.searchsorted(known, rk, "right")
    n = hi - lo
    row = np.repeat(np.arange(len(rk)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def collect(work: DataFrame, flags: DataFrame, words: bool, owners: int) -> DataFrame:
    """Step 3: (owner, kind, b, payload): content for the owners (kind 0), repeated windows for the buckets (kind 1)."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        known, ordinals, flag = _answers(answers, 3)
        b = key[0].as_py()
        for batch in docs.combine_chunks().to_batches() if len(known) else []:
            for rows in text_slices(batch, most=SLICE_BYTES):
                rk, ids = rows.column("rk").to_numpy(), rows.column("doc").to_numpy()
                row, place = _hits(rk, known)
                if not len(row):
                    continue
                text = Text(rows.column("text").to_pylist(), words)
                doc, s, e, trigger, digest = phrases(text)
                start = np.searchsorted(doc, np.arange(len(rows)))
                marks = np.zeros(len(doc), np.uint8)
                marks[start[row] + ordinals[place]] = flag[place]
                # A row was asked about the first phrase of its kind; the answer holds for all of that kind in it.
                _, kind = np.unique(_mix(trigger ^ _mix(digest + doc.astype(np.uint64) * np.uint64(_ODD))), return_inverse=True)
                of_kind = np.zeros(kind.max(initial=-1) + 1, np.uint8)
                np.maximum.at(of_kind, kind, marks)
                marks = of_kind[kind]
                base = text.bounds[:-1]
                if (got := marks == 1).any():
                    out.append((0, 1, b, _pack(rk[doc[got]], (s - base[doc])[got], (e - base[doc])[got])))
                if (got := np.flatnonzero(marks == 2)).size:
                    to = (trigger[got] % np.uint64(owners)).astype(np.int64)
                    for owner, (i,) in _by_bucket(to, got):
                        content = text.spans(s[i], e[i] + LENGTH)
                        sizes = np.array([len(x) for x in content], np.int32)
                        out.append((owner, 0, b, _pack(trigger[i], ids[doc[i]], rk[doc[i]], (s - base[doc])[i], sizes, b"".join(content))))
        return pa.Table.from_batches([_batch(out, _SENT)])

    return work.select("rk", "doc", "text", "b").groupBy("b").cogroup(flags.groupBy("b")).applyInArrow(run, _SENT_SQL)


#: Gets (trigger, document, contents) of phrases; returns (phrase, first window, last window) of repeated ones.
Settler = Callable[[np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def settle(sent: DataFrame, settler: Settler) -> DataFrame:
    """Step 4: (b, payload) of windows that a smaller document has in another phrase."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts, content = [], []
        for b, payload in zip(table.column("b").to_pylist(), table.column("payload").to_pylist(), strict=True):
            *columns, sizes, data = pickle.loads(payload)
            parts.append([*columns, np.full(len(sizes), b, np.int32)])
            ends = np.cumsum(sizes).tolist()
            content += [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        trigger, doc, rk, start, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        phrase, lo, hi = settler(trigger, doc, content)
        rk, start = rk[phrase], start[phrase]
        return pa.Table.from_batches([_batch([(0, 1, b, _pack(*x)) for b, x in _by_bucket(bucket[phrase], rk, start + lo, start + hi)], _SENT)])

    return sent.where("kind = 0").groupBy("owner").applyInArrow(run, _SENT_SQL).select("b", "payload")


#: Gets the texts, and for each document the units to remove as a mask over all units; returns columns of the result.
Finisher = Callable[[Text, np.ndarray], list[pa.Array]]


def finish(work: DataFrame, covers: DataFrame, words: bool, finisher: Finisher, schema: str) -> DataFrame:
    """Step 5: doc_id and the finisher's columns of every row."""
    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")]]

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        known, lo, hi = _answers(answers, 3)
        out = []
        for batch in docs.combine_chunks().to_batches():
            for rows in text_slices(batch, most=SLICE_BYTES):
                text = Text(rows.column("text").to_pylist(), words)
                row, place = _hits(rows.column("rk").to_numpy(), known)
                change = np.zeros(len(text.units) + 1, np.int64)
                np.add.at(change, text.bounds[row] + lo[place], 1)
                np.add.at(change, text.bounds[row] + hi[place] + LENGTH, -1)
                out.append(pa.RecordBatch.from_arrays([rows.column("doc_id"), *finisher(text, np.cumsum(change[:-1]) > 0)], names))
        return pa.Table.from_batches(out) if out else pa.table({})

    side = work.select("rk", "doc_id", "text", "b").groupBy("b")
    return side.cogroup(covers.groupBy("b")).applyInArrow(run, f"doc_id long, {schema}")


def cut_repeats(docs: DataFrame, words: bool, settler: Settler, finisher: Finisher, schema: str) -> DataFrame:
    """All five steps; ``schema`` names the finisher's columns."""
    spark = session(docs)
    small_batches(spark)
    work, buckets, size = keyed(docs)
    per_unit = 8 if words else 1
    found = -(-2 * size // (per_unit * (LENGTH - GRAM + 2)))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found // OWNER_PHRASES))
    flags = materialize(dictionary(parse(work, words, owners)))
    release_shuffles(spark)
    sent = materialize(collect(work, flags, words, owners))
    release_shuffles(spark)
    discard(flags)
    more = settle(sent, settler)
    covers = materialize(sent.where("kind = 1").select("b", "payload").unionByName(more))
    release_shuffles(spark)
    discard(sent)
    return finish(work, covers, words, finisher, schema)
