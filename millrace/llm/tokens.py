"""Token ids in a compressed binary format: canonical, length-limited Huffman codes in independent blocks.

The file format is a folder with two Parquet tables, so that any store Spark can reach holds it and its committer guards
it against lost executors:

* ``codebook``: one row for each id that occurs (id, length). Canonical codes follow from the lengths alone.
* ``blocks``: one row for each block, in ascending order of documents. A block holds whole documents: their ids, counts
  of ids and places in the stream, the ids as one bit stream of 32-bit words, and checkpoints: the number of bits of every
  run of ``CHECKPOINT`` ids. A block is decoded alone; its runs are decoded side by side, one table look-up an id.

Nulls and ties: a null text is empty and has the end id only. Documents are ordered by id, null ids last; rows that share
an id follow each other in the order of their digest. A text of any length is one document of one block, so a task holds the
ids of the longest. An empty table gives an empty folder of blocks. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_on_exit, discard, materialize, release_shuffles, session, shared_folder, small_batches, text_slices, trim_worker
from .repeats import _SYMBOLS, _mix, _sums

#: Ids between two checkpoints of the bit stream.
CHECKPOINT = 64
#: Ids after which a block is closed, at the end of a document.
BLOCK_IDS = 1 << 18
#: Longest code; grows only for a vocabulary that needs more.
MAX_BITS = 16
#: Pieces encoded in one call.
STRETCH = 2_000
#: Id appended to each document.
END_ID = 0
#: Pieces of text whose ids a worker remembers, and the longest of them in bytes: some 30 MB. When full, it keeps what was
#: asked for again. What is remembered never changes a result.
MEMO_PIECES = 700_000
MEMO_BYTES = 64
#: Bytes of text in each range of documents.
RANGE_BYTES = 24 << 20

# Bytes that may stand beside a space where a text is cut: visible ASCII, or the first byte of a character that is no white
# space whatever follows. Unicode's white space begins with the bytes C2, E1, E2 and E3.
_LEAD = np.zeros(256, bool)
_LEAD[0x21:0x7F] = True
_LEAD[0xC3:0xF5] = True
_LEAD[[0xE1, 0xE2, 0xE3]] = False


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Level:
    """Pieces and their ids, found by a 64-bit hash and told apart by their bytes."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray, firsts: np.ndarray, counts: np.ndarray, ids: np.ndarray, used: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.used = hashes[order], used[order]
        self.starts, self.sizes, self.firsts, self.counts = (x.astype(np.int32)[order] for x in (starts, sizes, firsts, counts))
        self.raw, self.ids = raw, ids

    def find(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked, place) of the pieces that are here, byte for byte."""
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        asked = np.flatnonzero((self.hashes[place] == hashes) & (self.sizes[place] == sizes))
        place = place[asked]
        same = _equal(raw, starts[asked], self.raw, self.starts[place], sizes[asked])
        asked, place = asked[same], place[same]
        self.used[place] = True
        return asked, place

    def merge(self, other: Level) -> Level:
        both = [np.concatenate([getattr(self, k), getattr(other, k) + shift]) for k, shift in (("starts", len(self.raw)), ("firsts", len(self.ids)))]
        join = lambda k: np.concatenate([getattr(self, k), getattr(other, k)])
        return Level(join("hashes"), both[0], join("sizes"), join("raw"), both[1], join("counts"), join("ids"), join("used"))

    def again(self) -> Level:
        """Only the pieces that were asked for after they came in."""
        some = self.used
        sizes, counts = self.sizes[some], self.counts[some]
        return Level(self.hashes[some], np.cumsum(sizes) - sizes, sizes, self.raw[_runs(self.starts[some], sizes)], np.cumsum(counts) - counts, counts, self.ids[_runs(self.firsts[some], counts)], np.zeros(len(sizes), bool))


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, where: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` bytes of ``a`` from ``at`` on are those of ``b`` from ``where`` on."""
    wrong = np.concatenate([[0], np.cumsum(a[_runs(at, sizes)] != b[_runs(where, sizes)])])
    ends = np.cumsum(sizes)
    return wrong[ends] == wrong[ends - sizes]


class Encoder:
    """Whole texts to ids, byte for byte as the tokenizers library encodes them.

    With the byte-level pre-tokenizer a text may be cut before a single space between two other characters without any
    change of its ids, so pieces are encoded once each and remembered. Any other tokenizer gets the whole text.
    """

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = t = Tokenizer.from_file(path)
        pre, added = t.pre_tokenizer, t.get_added_tokens_decoder()
        self.splits = (
            isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space and t.normalizer is None
            and not any(" " in x.content or x.lstrip or x.rstrip or x.single_word for x in added.values())
        )
        self.levels: list[Level] = []
        if self.splits:
            size = self.tokenizer.get_vocab_size()
            self.bytes_of = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)])  # one character stands for each byte
            for i, x in added.items():
                self.bytes_of[i] = len(x.content.encode())

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin at a cut, from one run over all of them, and how many each has."""
        # The library keeps many bytes for each character of a text while it encodes it, so the run goes in stretches.
        runs = [b"".join(pieces[i : i + STRETCH]).decode() for i in range(0, len(pieces), STRETCH)]
        ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids, "<u4") for x in runs] or [np.empty(0, "<u4")])
        cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(x) for x in pieces]), side="right")
        return ids, np.diff(cuts, prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        data = [x.encode() for x in texts]
        whole = b"".join(data)
        if not self.splits or not whole:
            return self._ids(texts)
        raw, ends = np.frombuffer(whole, np.uint8), np.cumsum([len(x) for x in data])
        heads = np.concatenate([[0], ends[:-1]])
        begins = np.zeros(len(raw) + 1, bool)
        begins[heads] = True
        space = np.flatnonzero(raw[1:-1] == 0x20) + 1
        before, two = raw[space - 1], raw[np.maximum(space - 2, 0)]
        good = _LEAD[raw[space + 1]] & ((before < 0x7F) & _LEAD[before] | (before >= 0x80) & (two >= 0xC3) & (two < 0xE0))
        # A character of three bytes before the space: its first byte decides, and those of four bytes are no white space.
        three = raw[np.maximum(space - 3, 0)]
        good |= _LEAD[raw[space + 1]] & (before >= 0x80) & (two >= 0x80) & (two < 0xC0) & (three >= 0x80) & ((three < 0xC0) | _LEAD[three])
        cuts = space[good]
        cuts = cuts[~begins[cuts] & ~begins[cuts + 1]]
        begins[cuts] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        sizes = np.diff(starts, append=len(raw))
        sums, down = _sums(_SYMBOLS[raw])
        hashes = _mix((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64))
        order = np.argsort(hashes)
        new = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])
        first, number = order[new], np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        if (sizes != sizes[first][number]).any() or (raw != raw[np.arange(len(raw)) + np.repeat(starts[first][number] - starts, sizes)]).any():
            return self._ids(texts)  # two pieces of one hash
        begins[heads] = False
        ids, begin, count = self._look_up(whole, raw, hashes[first], starts[first], sizes[first], begins[starts[first]])
        ids = ids[_runs(begin[number], count[number])]
        total = np.concatenate([[0], np.cumsum(count[number])])
        at = np.searchsorted(starts, np.concatenate([heads, [len(raw)]]))
        at[np.concatenate([heads, [len(raw)]]) >= len(raw)] = len(starts)
        marks = total[at].tolist()
        return [ids[a:z].tobytes() for a, z in zip(marks, marks[1:], strict=False)]

    def _look_up(self, whole: bytes, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, count): the ids of distinct pieces, remembered or encoded now."""
        parts, seen = [], 0
        begin, count, todo = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.arange(len(starts))
        for level in self.levels:
            asked, place = level.find(hashes[todo], starts[todo], sizes[todo], raw)
            n = level.counts[place]
            parts.append(level.ids[_runs(level.firsts[place], n)])
            begin[todo[asked]], count[todo[asked]] = seen + np.cumsum(n) - n, n
            seen += int(n.sum())
            todo = np.delete(todo, asked)
        pick = lambda some: [whole[a:z] for a, z in zip(starts[some].tolist(), (starts[some] + sizes[some]).tolist(), strict=True)]
        alone, run = todo[~cut[todo]], todo[cut[todo]]
        todo = np.concatenate([alone, run])
        single = self._ids([x.decode() for x in pick(alone)])
        ids, n = self._pieces(pick(run))
        ids = np.concatenate([np.frombuffer(b"".join(single), "<u4"), ids])
        n = np.concatenate([np.array([len(x) // 4 for x in single], np.int64), n])
        parts.append(ids)
        begin[todo], count[todo] = seen + np.cumsum(n) - n, n
        keep = sizes[todo] <= MEMO_BYTES
        if keep.any():
            own, kept = todo[keep], sizes[todo][keep]
            firsts = np.cumsum(n[keep]) - n[keep]
            self._remember(Level(hashes[own], np.cumsum(kept) - kept, kept, raw[_runs(starts[own], kept)], firsts, n[keep], ids[_runs((np.cumsum(n) - n)[keep], n[keep])], np.zeros(len(own), bool)))
        return np.concatenate(parts), begin, count

    def _remember(self, level: Level) -> None:
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2].hashes) < 2 * len(self.levels[-1].hashes):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merge(last)
        if sum(len(x.hashes) for x in self.levels) > MEMO_PIECES:
            kept = [x.again() for x in self.levels if x.used.any()]
            self.levels = kept if sum(len(x.hashes) for x in kept) <= MEMO_PIECES // 2 else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths under a limit, by package-merge; 0 for ids that don't occur.

    A level merges the leaves with pairs of the level below it. Of the last level the cheapest 2n - 2 items are taken;
    at each level the leaves taken are a prefix of the leaves in order of weight, so lengths are counts of prefixes.
    """
    found = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(found) <= 1:
        lengths[found] = 1
        return lengths
    max_bits = max(max_bits, int(len(found) - 1).bit_length() + (len(found) > 1 << 15))
    order = found[np.argsort(counts[found], kind="stable")]
    leaves = counts[order].astype(np.float64)
    below, levels = np.empty(0), []
    for _ in range(max_bits):
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(leaves))
        below = both[rank]
    take, depth = 2 * len(found) - 2, np.zeros(len(found), np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes, order = np.zeros(len(lengths), np.uint32), np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths[order[-1]])
        sizes = np.uint64(1) << (top - lengths[order].astype(np.int64)).astype(np.uint64)
        starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes)[:-1]])
        codes[order] = starts >> (top - lengths[order].astype(np.int64)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for each value of the next ``top`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    top = int(lengths.max(initial=1))
    repeats = 1 << (top - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    n = int(repeats.sum())
    ids[:n], bits[:n] = np.repeat(order, repeats), np.repeat(lengths[order], repeats)
    return ids, bits, top


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The bit stream in 32-bit words, and the bits of each run of ``CHECKPOINT`` ids."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ids) else 0
    word, room = starts >> 5, 64 - (starts & 31) - n
    both = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    size = total // 32 + 3
    high = np.bincount(word, weights=(both >> np.uint64(32)).astype(np.float64), minlength=size)
    low = np.bincount(word + 1, weights=(both & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
    marks = np.concatenate([starts[::CHECKPOINT], [total]]) if len(ids) else np.zeros(1, np.int64)
    return (high + low).astype("<u4").tobytes(), np.diff(marks).astype("<u2").tobytes()


def unpack(stream: bytes, runs: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block: all runs advance together, an id at a time."""
    ids, bits, top = table
    words, sizes = np.frombuffer(stream, "<u4").astype(np.uint64), np.frombuffer(runs, "<u2").astype(np.int64)
    at = np.cumsum(sizes) - sizes
    out = np.zeros((CHECKPOINT, len(sizes)), np.uint32)
    wide = (words[:-1] << np.uint64(32)) | words[1:]
    shift = 64 - top
    for step in range(CHECKPOINT):
        if step and step >= n - (len(sizes) - 1) * CHECKPOINT:
            at = at[: len(sizes) - 1]
        window = ((wide[at >> 5] << (at & 31).astype(np.uint64)) >> np.uint64(shift)).astype(np.int64)
        out[step, : len(at)] = ids[window]
        at = at + bits[window]
    return out.T.ravel()[:n]


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, width, part, ahead): each row a whole document, its range of ids and the ids ahead of it in its range."""
    size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, int(session(docs).conf.get("spark.sql.shuffle.partitions")), -(-size[1] // RANGE_BYTES))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ahead = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in text_slices(batch, most=1 << 20):
                out = []
                for data in enc.encode(rows.column("text").to_pylist()):
                    ids = np.frombuffer(data + end, "<u4")
                    narrow = ids.max() < 1 << 16
                    out.append((ids.astype("<u2").tobytes() if narrow else ids.tobytes(), 2 if narrow else 4, part, ahead))
                    ahead += len(ids)
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], ["doc_id", "ids", "width", "part", "ahead"])
        trim_worker()

    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "doc_id long, ids binary, width int, part int, ahead long")


def _wide(ids: list[bytes], widths: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2" if w == 2 else "<u4").astype(np.uint32) for x, w in zip(ids, widths, strict=True)]


def count_ids(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs, summed in the partitions first; as many rows as the vocabulary reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            here = np.bincount(np.concatenate(_wide(batch.column("ids").to_pylist(), batch.column("width").to_pylist()) or [np.empty(0, np.uint32)]))
            if len(here) > len(total):
                total, here = here.copy(), total
            total[: len(here)] += here
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = encoded.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    counts[ids] = n
    return counts


BLOCKS = "part int, ahead long, n_ids long, doc_ids binary, null_ids binary, counts binary, runs binary, stream binary"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, max_bits: int = MAX_BITS) -> None:
    """Encode ``docs`` and write the two tables below ``folder``."""
    spark = session(docs)
    encoded = materialize(encode_documents(docs, tokenizer, end_id))
    release_shuffles(spark)
    lengths = code_lengths(count_ids(encoded), max_bits)
    book = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(book, pa.int64()), "length": pa.array(lengths[book].astype(np.int32))})).coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value, canonical_codes(shared.value)
        held: list[tuple[int | None, np.ndarray]] = []
        size, part, first, following = 0, None, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            stream, runs = pack(ids, lengths, codes)
            keys = [k for k, _ in held]
            row = [part, first, len(ids), np.array([k or 0 for k in keys], "<i8").tobytes(), np.packbits([k is None for k in keys]).tobytes(), np.array([len(x) for _, x in held], "<i8").tobytes(), runs, stream]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "part", "ahead")]
            ids = _wide(batch.column("ids").to_pylist(), batch.column("width").to_pylist())
            for key, at, ahead, own in zip(*columns, ids, strict=True):
                if held and (size >= BLOCK_IDS or (at, ahead) != (part, following)):
                    yield close()
                    held, size = [], 0
                if not held:
                    part, first = at, ahead
                held.append((key, own))
                size += len(own)
                following = ahead + len(own)
        if held:
            yield close()
        trim_worker()

    encoded.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    delete_on_exit(spark, folder)
    discard(encoded)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the blocks: (doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers)."""
    book = spark.read.parquet(f"{folder}/codebook").toArrow()
    ids = book.column("id").to_numpy()
    lengths = np.zeros(int(ids.max(initial=0)) + 1, np.uint8)
    lengths[ids] = book.column("length").to_numpy()
    blocks = spark.read.parquet(f"{folder}/blocks")
    # The place of a range in the stream: one row for each range of RANGE_BYTES reaches the driver.
    heads = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")
    before = dict(zip(heads.part.tolist(), (heads.n.cumsum() - heads.n).tolist(), strict=True))
    shared = spark.sparkContext.broadcast((lengths, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, before = shared.value
        table = decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["counts"], "<i8")
                nulls = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=len(keys)).astype(bool)
                ids = unpack(row["stream"], row["runs"], row["n_ids"], table).astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                out = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=nulls), pa.array(starts + before[row["part"]] + row["ahead"]), pa.array(counts), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
        trim_worker()

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """Replace the ids by the unsigned CRC-32 of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in batch.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files into a new shared folder and digest what they hold."""
    folder = shared_folder(session(docs))
    small_batches(session(docs))
    write_tokens(docs, folder, tokenizer)
    return digests(read_tokens(session(docs), folder))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
