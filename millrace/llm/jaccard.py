"""N-gram Jaccard join by signature trees, and the components of its links.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two documents link at a Jaccard similarity of 0.75.
Two shingles of one hash matter only where both stand in two documents compared, a chance of 1 in 10^13 for sets of 1,000.

1. ``sketch``: each document is reduced to the digest and size of its set, a bitmap of it (a power of two
   of bits, above one and a half times the size) and its prefix: the smallest hashes, so many that two sets which link share one of them.
2. Documents with one digest (128 bits) are a class. Classes get numbers of their own, so rows that share an id, or have
   none, stay apart. Classes are joined, copies never are.
3. ``recurring``: owners of hashes find the prefix hashes that classes of fitting sizes share.
4. ``meet``: classes that share such a hash meet in a signature tree. Its nodes hold OR-combined bitmaps and size ranges; the
   dual traversal drops node pairs and then pairs whose largest possible overlap is too small. What survives is joined to a
   forest of candidates, at most one link a class and hash, never all pairs of a group.
5. The candidates' components are found by label steps, and the sets of each are read once. ``resolve`` runs the same dual
   traversal and compares the survivors exactly; documents already in one component aren't compared again.

A component of more than ``BLOCK`` classes is dealt out in blocks: every block is resolved alone, then with the first one,
which joins most of what is alike; only pairs of blocks in which some are still apart are compared after that. No task holds
more than two blocks, and no pair is lost.

Nulls and ties: a document without words has size 0, links with nothing and is its own component. With fewer than five words
the whole sequence is one shingle. Rows that repeat an id each have their own text's component, whose number is the smallest
id in it. ``one_of_each`` keeps a single row of a component, also of rows that repeat an id and a text. A null id is larger
than any other and is returned as null. Texts of any length are read whole, some at a time. An empty table gives no rows.
Other columns are not read, and ``one_of_each`` hands them on whatever they are called.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_key, materialize, release_shuffles, row_key, session, small_batches, text_slices, trim_worker, unused
from .repeats import NULL_ID, Text, _batch, _by_bucket, _mix, _sums

SHINGLE = 5
#: The least similarity, as a fraction: 75 / 100.
UP, DOWN = 75, 100
#: Bits of a bitmap: a power of two, 1.5 to 3 times the size of the set, from BITS_LEAST to BITS_MOST. With fewer, sets that
#: merely share a shingle pass often enough to join into one large component of candidates.
BITS_LEAST, BITS_MOST = 128, 16384
#: Documents in a leaf of a signature tree, and nodes below an inner node.
LEAF, FANOUT = 64, 8
#: Classes in a block, and the most that a task of ``resolve`` holds is two blocks.
BLOCK = 1024
#: Classes of a hash that meet in one tree.
MEET_BLOCK = 4096
#: Groups of at most so many classes are compared pair by pair; larger ones get a tree.
FEW = 12
#: Prefix hashes an owner sorts at once, about.
OWNER_HASHES = 2_000_000
#: Prefix hashes behind each task of ``meet``. A class's bitmap goes to every task that one of its hashes belongs to, so a
#: few large tasks send less than many small ones.
MEET_HASHES = 4_000_000
#: Links whose components one task finds at once (16 bytes each); more are joined by rounds of steps over all tasks, each of
#: which costs five shuffles however few the links are.
TASK_LINKS = 1_000_000
#: Candidates whose texts are found by a broadcast of their ids.
BROADCAST_CANDIDATES = 500_000


def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap at which sets of sizes a and b link: 100 * o >= 75 * (a + b - o)."""
    return -(-UP * (a + b) // (UP + DOWN))


def prefix_length(n: int) -> int:
    """A set shares at least ceil(0.75 n) hashes with any that it links to, so one of the first n - ceil(0.75 n) + 1."""
    return n + (UP * -n) // DOWN + 1 if n else 0


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of each text, A-Z in lower case."""
    text = Text(texts, words=True, lower=True)
    n, u = text.length(), text.units
    sums, down = _sums(u)
    at = np.arange(max(len(u) - SHINGLE + 1, 0))
    grams = _mix((sums[at + SHINGLE] - sums[at]) * down[at])
    out = []
    for a, k in zip(text.bounds[:-1].tolist(), n.tolist(), strict=True):
        if k >= SHINGLE:
            out.append(np.unique(grams[a : a + k - SHINGLE + 1]))
        elif k:
            out.append(_mix((sums[a + k : a + k + 1] - sums[a : a + 1]) * down[a : a + 1] + np.uint64(k)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bits_for(n: int) -> int:
    return min(BITS_MOST, max(BITS_LEAST, 1 << (3 * n // 2).bit_length()))


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The set as a bitmap of 64-bit words; half the bits is the OR of both halves, so bitmaps of other sizes compare."""
    place = (hashes % np.uint64(bits)).astype(np.int64)
    flags = np.zeros(bits, np.uint8)
    flags[place] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


class Node:
    """Sets ``lo`` to ``hi`` in order of size: OR of their bitmaps, range of sizes, and most elements of one set beyond its bits."""

    def __init__(self, lo: int, hi: int, any_of: np.ndarray, least: int, most: int, extra: int, below: list[Node], table: np.ndarray | None) -> None:
        self.lo, self.hi, self.any_of, self.least, self.most, self.extra, self.below, self.table = lo, hi, any_of, least, most, extra, below, table

    def may_link(self, other: Node) -> bool:
        """Whether any set here could link to any of ``other``: their sizes fit and their common bits leave enough overlap.

        Shared elements stand on common bits. A set has at most ``extra`` elements more than bits.
        """
        if min(self.most, other.most) * DOWN < max(self.least, other.least) * UP:
            return False
        narrow = min(len(self.any_of), len(other.any_of))
        common = int(np.bitwise_count(fold(self.any_of, narrow) & fold(other.any_of, narrow)).sum())
        extra = min(x.extra for x in (self, other) if len(x.any_of) == narrow)
        low, high = sorted((self.least, other.least))
        return common + extra >= -(-UP * (low + high) // (UP + DOWN))


class Tree:
    """A signature tree over sets in order of size: leaves of ``LEAF`` sets, under inner nodes of ``FANOUT`` nodes each."""

    def __init__(self, sizes: np.ndarray, maps: list[np.ndarray]) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        widths = np.array([len(maps[i]) for i in self.order])
        # A root for each width of bitmap: folded to the narrowest of all sizes, those of large sets would be full.
        cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(sizes)]
        self.roots = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            level = [self._leaf(a, min(a + LEAF, hi), maps) for a in range(lo, hi, LEAF)]
            while len(level) > 1:
                level = [self._inner(level[k : k + FANOUT]) for k in range(0, len(level), FANOUT)]
            self.roots += level

    def _leaf(self, a: int, z: int, maps: list[np.ndarray]) -> Node:
        table = np.array([maps[i] for i in self.order[a:z]])
        extra = int((self.sizes[a:z] - np.bitwise_count(table).sum(axis=1, dtype=np.int64)).max())
        return Node(a, z, np.bitwise_or.reduce(table, axis=0), int(self.sizes[a]), int(self.sizes[z - 1]), extra, [], table)

    @staticmethod
    def _inner(below: list[Node]) -> Node:
        any_of = np.bitwise_or.reduce([x.any_of for x in below])
        return Node(below[0].lo, below[-1].hi, any_of, below[0].least, below[-1].most, max(x.extra for x in below), below, None)

    def pairs(self, label: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal: batches of pairs (as places in the input) whose largest possible overlap is enough.

        ``label`` tells which places are joined already; what is wholly joined is passed over, as are such pairs.
        """
        todo = [(x, y) for k, x in enumerate(self.roots) for y in self.roots[k:]][::-1]
        while todo:
            x, y = todo.pop()
            if x is not y and not x.may_link(y):
                continue
            if x.below and x is y:
                todo += [(p, q) for k, p in enumerate(x.below) for q in x.below[k:]][::-1]
            elif x.below and (not y.below or x.hi - x.lo >= y.hi - y.lo):
                todo += [(p, y) for p in x.below][::-1]
            elif y.below:
                todo += [(x, q) for q in y.below][::-1]
            else:
                yield from self._leaves(x, y, label)

    def _leaves(self, x: Node, y: Node, label: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A bit that one set has and another (or all of a node's sets) has not stands for an element they don't share."""
        of_x, of_y = label(self.order[x.lo : x.hi]), label(self.order[y.lo : y.hi])
        if (of_x == of_x[0]).all() and (of_y == of_x[0]).all():
            return
        narrow = min(x.table.shape[1], y.table.shape[1])
        narrowed = lambda t: t if t.shape[1] == narrow else np.array([fold(m, narrow) for m in t])
        mine, theirs, size, sizes = narrowed(x.table), narrowed(y.table), self.sizes[x.lo : x.hi], self.sizes[y.lo : y.hi]
        lost = np.bitwise_count(mine & ~fold(y.any_of, narrow)[None, :]).sum(axis=1, dtype=np.int64)
        some = np.flatnonzero(size - lost >= need(size, np.maximum(np.full_like(size, y.least), size)))
        if not len(some):
            return
        shared = np.bitwise_count(mine[some][:, None, :] & theirs[None, :, :]).sum(axis=2, dtype=np.int64)
        mine_n, theirs_n = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (mine[some], theirs))
        most = np.minimum(size[some][:, None] - (mine_n[:, None] - shared), sizes[None, :] - (theirs_n[None, :] - shared))
        i, j = np.nonzero((most >= need(size[some][:, None], sizes[None, :])) & (of_x[some][:, None] != of_y[None, :]))
        i, j = some[i] + x.lo, j + y.lo
        once = i < j
        if once.any():
            yield self.order[i[once]], self.order[j[once]]


class Union:
    """Disjoint sets of 0 to n - 1; the smallest member is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def labels(self, some: np.ndarray) -> np.ndarray:
        return np.array([self.find(x) for x in some.tolist()], np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """Step 1: rk (128-bit digest of id and text), doc, n, digest, bitmap and prefix of each row."""
    work = docs.select(row_key().alias("rk"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text")
    names = ["rk", "doc", "n", "digest", "bitmap", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for rows in text_slices(batch):
                sets = shingle_sets(rows.column("text").to_pylist())
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in sets]
                maps = [bitmap(s, bits_for(len(s))).tobytes() for s in sets]
                prefixes = [s[: prefix_length(len(s))].tobytes() for s in sets]
                found = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, maps, prefixes))]
                yield pa.RecordBatch.from_arrays([rows.column("rk"), rows.column("doc"), *found], names)
        trim_worker()

    return work.mapInArrow(run, "rk struct<x: long, y: long>, doc long, n long, digest binary, bitmap binary, prefix binary")


_SENT = pa.schema([("owner", pa.int32()), ("payload", pa.binary())])


def recurring(classes: DataFrame, owners: int, buckets: int) -> DataFrame:
    """Step 3: (b, payload): class ids, the prefix hashes they share with a class of fitting size, and each hash's blocks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            if not prefixes:
                continue
            lengths = np.array([len(x) for x in prefixes])
            row, every = np.repeat(np.arange(len(prefixes)), lengths), np.concatenate(prefixes)
            doc, n = batch.column("doc").to_numpy(), batch.column("n").to_numpy()
            rows = []
            for owner, (h, r) in _by_bucket((every >> np.uint64(1)).astype(np.int64) % owners, every, row):
                fresh = np.concatenate([[True], r[1:] != r[:-1]])
                rows.append((owner, pickle.dumps((h, doc[r[fresh]], n[r[fresh]], fresh), 5)))
            yield _batch(rows, _SENT)
        trim_worker()

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        parts = []
        for x in table.column("payload").to_pylist():
            h, doc, n, fresh = pickle.loads(x)
            at = np.cumsum(fresh) - 1
            parts.append((h, doc[at], n[at]))
        h, doc, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((n, h))
        h, doc, n = h[order], doc[order], n[order]
        # In order of size, a set fits some other if it fits the next or the one before.
        fits = (h[1:] == h[:-1]) & (n[:-1] * DOWN >= n[1:] * UP)
        some = np.concatenate([fits, [False]]) | np.concatenate([[False], fits])
        h, doc = h[some], doc[some]
        first = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        counts = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]
        out = [(b, pickle.dumps(tuple(x), 5)) for b, x in _by_bucket(doc % buckets, doc, h, -(-counts // MEET_BLOCK))]
        trim_worker()
        return pa.Table.from_batches([_batch(out, _SENT)])

    return classes.select("doc", "n", "prefix").mapInArrow(send, "owner int, payload binary").groupBy("owner").applyInArrow(answer, "owner int, payload binary").withColumnRenamed("owner", "b")


def place(classes: DataFrame, answers: DataFrame, owners: int, buckets: int) -> DataFrame:
    """(owner, payload): recurring hashes with their classes; a class's bitmap goes once to each owner that needs it.

    A hash of more than ``MEET_BLOCK`` classes is dealt out by pairs of blocks, each class to all pairs of its block, so that no
    hash is too large for a task.
    """

    def run(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        parts = [pickle.loads(x) for x in found.column("payload").to_pylist()]
        if not parts or not len(own):
            return pa.Table.from_batches([_batch([], _SENT)])
        doc, h, blocks = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, n, maps = own.column("doc").to_numpy(), own.column("n").to_numpy(), own.column("bitmap").to_pylist()
        order = np.argsort(ids, kind="stable")
        at = order[np.searchsorted(ids[order], doc)]
        mine = (_mix(doc.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        h, at, mine, blocks = (np.repeat(x, blocks) for x in (h, at, mine, blocks))
        salt = np.minimum(mine, other) * blocks + np.maximum(mine, other)
        to = (_mix(h + salt.astype(np.uint64)) % np.uint64(owners)).astype(np.int64)
        out = []
        for owner, (hh, ss, aa) in _by_bucket(to, h, salt, at):
            some, number = np.unique(aa, return_inverse=True)
            out.append((owner, pickle.dumps((hh, ss.astype(np.int32), number.astype(np.int32), ids[some], n[some], [maps[i] for i in some]), 5)))
        return pa.Table.from_batches([_batch(out, _SENT)])

    left = classes.select("doc", "n", "bitmap", F.pmod("doc", F.lit(buckets)).cast("int").alias("b")).groupBy("b")
    return left.cogroup(answers.groupBy("b")).applyInArrow(run, "owner int, payload binary")


def meet(placed: DataFrame) -> DataFrame:
    """Step 4: (a, b) links of candidates, a forest for each task; a task gets many hashes."""
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts, seen, rows = [pickle.loads(x) for x in table.column("payload").to_pylist()], 0, []
        for x in parts:
            rows.append(x[2].astype(np.int64) + seen)
            seen += len(x[3])
        h, salt, doc, n = (np.concatenate([x[k] for x in parts]) for k in (0, 1, 3, 4))
        maps = [m for x in parts for m in x[5]]
        # Classes that share many hashes meet many times here; one union for the task keeps a single link of each pair.
        names, heads, number = np.unique(doc, return_index=True, return_inverse=True)
        own = [np.frombuffer(maps[i], np.uint64) for i in heads]
        sizes, number, joined, out = n[heads], number[np.concatenate(rows)], Union(len(names)), []
        order = np.lexsort((number, salt, h))
        h, salt, number = h[order], salt[order], number[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(h) != 0) | (np.diff(salt) != 0)]))
        counts = np.diff(np.concatenate([starts, [len(h)]]))
        codes = []
        for step in range(1, FEW):
            # In groups of at most FEW, every member meets the one ``step`` places on.
            at = np.flatnonzero(np.repeat(counts <= FEW, counts))
            group = np.repeat(np.arange(len(starts)), counts)
            at = at[at + step < len(h)]
            at = at[group[at] == group[at + step]]
            codes.append(np.unique(number[at] * len(names) + number[at + step]))
        code = np.unique(np.concatenate(codes))
        for i, j in may_link(code // len(names), code % len(names), sizes, own):
            if joined.join(i, j):
                out.append((names[i], names[j]))
        for a, k in zip(starts[counts > FEW].tolist(), counts[counts > FEW].tolist(), strict=True):
            part = np.unique(number[a : a + k])
            if len({joined.find(x) for x in part.tolist()}) < 2:
                continue
            for i, j in Tree(sizes[part], [own[x] for x in part]).pairs(lambda some, part=part: joined.labels(part[some])):
                for x, y in zip(part[i].tolist(), part[j].tolist(), strict=True):
                    if joined.join(x, y):
                        out.append((names[x], names[y]))
        del parts, maps, own
        trim_worker()
        return pa.Table.from_batches([_batch(out, links)])

    return placed.groupBy("owner").applyInArrow(run, "a long, b long")


def may_link(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """The pairs whose sizes fit and whose bitmaps leave enough overlap possible."""
    fits = np.minimum(sizes[i], sizes[j]) * DOWN >= np.maximum(sizes[i], sizes[j]) * UP
    i, j = i[fits], j[fits]
    widths = np.array([len(m) for m in maps])
    narrow = np.minimum(widths[i], widths[j])
    for width in np.unique(narrow).tolist():
        x, y = i[narrow == width], j[narrow == width]
        some = np.unique(np.concatenate([x, y]))
        table = np.array([fold(maps[k], width) for k in some.tolist()])
        for a in range(0, len(x), 1 << 14):
            p, q = x[a : a + (1 << 14)], y[a : a + (1 << 14)]
            u, v = table[np.searchsorted(some, p)], table[np.searchsorted(some, q)]
            most = np.minimum(sizes[p] - np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64), sizes[q] - np.bitwise_count(v & ~u).sum(axis=1, dtype=np.int64))
            good = most >= need(sizes[p], sizes[q])
            yield from zip(p[good].tolist(), q[good].tolist(), strict=True)


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest node of each one's component: roots hang on smaller ones until none is linked."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return names, names[root]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, up := root[root]):
            root = up


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
        if parts:
            found = least_members(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, label long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the links (a, b), by alternating star steps beyond ``TASK_LINKS``.

    A step hangs every node's larger neighbours, then its smaller ones, on the smallest; each writes its links to the shared
    folder. Links never exceed those given, and the number of rounds grows with the logarithm of the longest path.
    """
    given = materialize(links.where("a <> b"))
    if given.count() <= TASK_LINKS:
        return _at_once(given)
    edges, seen = materialize(given.distinct()), None
    discard(given)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        discard(large)
        discard(edges)
        edges, before = small, seen
        # The links are distinct, so their number and two sums of digests tell whether a round changed any.
        digest = lambda k: F.sum(F.shiftright(F.xxhash64("a", "b", F.lit(k)), 24))
        seen = tuple(edges.agg(F.count(F.lit(1)), digest(1), digest(2)).first())
        if seen == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _exact(sets: list[np.ndarray], i: int, j: int) -> bool:
    a, b = sets[i], sets[j]
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    overlap = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return DOWN * overlap >= UP * (len(a) + len(b) - overlap)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def resolve(sets: DataFrame, keys: list[str], owners: int) -> DataFrame:
    """(a, b): a forest of exact links within each group of ``keys``; rows have doc, label (what is joined already) and set.

    A task gets many groups and takes one after the other.
    """

    def links_of(doc: np.ndarray, label: np.ndarray, own: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        joined, first = Union(len(doc)), {}
        for i, x in enumerate(label.tolist()):
            joined.join(i, first.setdefault(x, i))
        left = len(first)
        if left < 2:
            return
        for i, j in Tree(np.array([len(x) for x in own]), [bitmap(x, bits_for(len(x))) for x in own]).pairs(joined.labels):
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if joined.find(x) != joined.find(y) and _exact(own, x, y):
                    joined.join(x, y)
                    left -= 1
                    yield doc[x], doc[y]
            if left == 1:
                return

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in keys]
        doc, label, own = table.column("doc").to_numpy(), table.column("label").to_numpy(), table.column("set").combine_chunks()
        order = np.lexsort((doc, *columns))
        cuts = np.flatnonzero(np.any([np.diff(c[order]) != 0 for c in columns], axis=0)) + 1
        out = [x for part in np.split(order, cuts) for x in links_of(doc[part], label[part], [np.frombuffer(own[i].as_buffer(), np.uint64) for i in part])]
        trim_worker()
        return pa.Table.from_batches([_batch(out, _LINKS)])

    dealt = sets.withColumn("owner", F.pmod(F.xxhash64(*keys), F.lit(owners)).cast("int"))
    return dealt.select("owner", *keys, "doc", "label", "set").groupBy("owner").applyInArrow(run, "a long, b long")


def with_sets(docs: DataFrame, members: DataFrame, repeats: bool) -> DataFrame:
    """members (rk, doc, group, label) with the set of each, read from its text; of rows that repeat id and text, from one."""
    few = members.count() <= BROADCAST_CANDIDATES
    work = docs.select(row_key().alias("rk"), "text")
    side = members.select("rk", "doc", "group", "label")
    work = work.join(F.broadcast(side) if few else side, "rk")
    work = work.dropDuplicates(["doc"]) if repeats else work
    schema = pa.schema([("doc", pa.int64()), ("group", pa.int64()), ("label", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                sets = [s.tobytes() for s in shingle_sets(rows.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc", "group", "label")), pa.array(sets, pa.binary())], schema=schema)
        trim_worker()

    return work.mapInArrow(run, "doc long, group long, label long, set binary")


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the label of the component that the links give them."""
    named = materialize(components(links)).withColumnRenamed("node", "doc")
    joined = members.drop("label").join(named, "doc", "left")
    return joined.withColumn("label", F.coalesce("label", "doc"))


def _blocked(table: DataFrame) -> DataFrame:
    return table.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))


def _across(sets: DataFrame, named: DataFrame, links: DataFrame, chosen: str, owners: int) -> DataFrame:
    """Links and those found between the pairs (p, q) of blocks that ``chosen`` names and in which some are still apart."""
    held = materialize(named.groupBy("group", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    x, y = held.alias("x"), held.alias("y")
    pairs = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.block") < F.col("y.block"))).where(chosen)
    pairs = pairs.where("least(x.lo, y.lo) < greatest(x.hi, y.hi)").select(F.col("x.group").alias("group"), F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    dealt = named.join(pairs.withColumn("block", F.explode(F.array("p", "q"))), ["group", "block"]).join(sets.select("doc", "set"), "doc")
    return materialize(links.union(resolve(dealt.select("doc", "label", "set", "group", "p", "q"), ["group", "p", "q"], 4 * owners)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """rk, doc, n (size of the set), label (one for each component; null without words) and component (its smallest id)."""
    spark = session(docs)
    small_batches(spark)
    rows = materialize(sketch(docs))
    classes = rows.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc", "rk", "n", "bitmap", "prefix")).alias("c"), F.count(F.lit(1)).alias("copies"))
    # The numbers are written, so they stay what they are; ``doc`` is a class's number from here on, ``least`` its smallest id.
    classes = materialize(classes.select("digest", "copies", F.col("c.doc").alias("least"), "c.rk", "c.n", "c.bitmap", "c.prefix", F.monotonically_increasing_id().alias("doc")))
    sketches, rows = rows, materialize(rows.select("rk", "doc", "n", "digest"))
    release_shuffles(spark)
    discard(sketches)
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)).alias("bytes")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners, buckets = max(parts, -(-size.bytes // (8 * OWNER_HASHES))), max(parts, -(-size.n // 50_000))
    answers = materialize(recurring(classes, owners, buckets))
    release_shuffles(spark)
    meetings = max(spark.sparkContext.defaultParallelism, -(-size.bytes // (8 * MEET_HASHES)))
    candidates = materialize(components(meet(place(classes, answers, meetings, buckets))))
    release_shuffles(spark)
    discard(answers)
    members = classes.select("rk", "doc").join(candidates.select(F.col("node").alias("doc"), F.col("label").alias("group")), "doc").withColumn("label", F.col("doc"))
    members = materialize(members)
    large = materialize(members.groupBy("group").count().where(F.col("count") > BLOCK).select("group", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    some_large = large.count()
    few = F.broadcast(large) if some_large <= 100_000 else large
    again = rows.groupBy("rk").agg(F.count(F.lit(1)).alias("times")).where("times > 1").limit(1).count()
    sets = materialize(with_sets(docs, members, again > 0))
    release_shuffles(spark)
    block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    links = materialize(resolve(sets.join(few, "group", "left").withColumn("block", block), ["group", "block"], 2 * owners))
    if some_large:
        inside = _blocked(sets.join(few, "group").select("doc", "group", "label", "blocks"))
        for chosen in ("x.block = 0", "true"):
            links = _across(sets, materialize(_relabelled(inside, links)), links, chosen, owners)
    release_shuffles(spark)
    named = materialize(components(links)).select(F.col("node").alias("doc"), "label")
    known = materialize(classes.select("digest", "copies", "doc", "least").join(named, "doc", "left").withColumn("label", F.coalesce("label", "doc")))
    smallest = known.groupBy("label").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("classes"))
    heads = join_by_key(known.select("digest", "copies", "label"), smallest, "label", "classes").select("digest", "copies", "label", "component")
    found = join_by_key(rows.where("n > 0"), heads, "digest", "copies").select("rk", "doc", "n", "label", "component")
    return found.unionByName(rows.where("n = 0").select("rk", "doc", "n", F.lit(None).cast("long").alias("label"), F.col("doc").alias("component")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest id, with its own columns.

    Documents without words are no copies of each other and stay. The rows that go are broadcast if they are few.
    """
    found = materialize(near_duplicates(docs).where("n > 0").groupBy("label", "doc", "rk").agg(F.count(F.lit(1)).alias("times")))
    kept = found.groupBy("label").agg(F.min(F.struct("doc", "rk", "times")).alias("k"), F.count(F.lit(1)).alias("texts"))
    gone = materialize(join_by_key(found.select("label", "rk"), kept.select("label", "texts", F.col("k.rk").alias("keeper")), "label", "texts").where("rk <> keeper").select("rk"))
    again = materialize(kept.where("k.times > 1").select("k.rk"))
    key = unused(docs.columns, "_row")
    left = docs.withColumn(key, row_key())
    side = lambda t: (F.broadcast(t) if t.count() <= BROADCAST_CANDIDATES else t).withColumnRenamed("rk", key)
    left = left.join(side(gone), key, "left_anti")
    if again.limit(1).count():
        left = left.join(side(again), key, "left_anti").unionByName(left.join(side(again), key, "left_semi").dropDuplicates([key]))
    return left.drop(key)


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))
