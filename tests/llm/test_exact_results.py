"""Operators with exact results against brute force, on edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact, jaccard, licenses, mixing, passages, repeats, suffixes, tokens

from .conftest import WORD

WORDS = re.compile(WORD)


def covered(sequences: dict, length: int = 50) -> dict:
    seen: dict = {}
    for d, w in sequences.items():
        for i in range(len(w) - length + 1):
            k = w[i : i + length]
            seen[k] = min(seen.get(k, d), d)
    out = {}
    for d, w in sequences.items():
        gone = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if seen[w[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out[d] = gone
    return out


def test_passages(edge_docs, edge_rows):
    words = {r[0]: tuple(WORDS.findall(r[1] or "")) for r in edge_rows}
    gone = covered(words)
    assert sum(map(sum, gone.values())) > 500
    want = {d: (len(w), sum(gone[d]), hashlib.sha256(" ".join(x for x, g in zip(w, gone[d], strict=True) if not g).encode()).hexdigest()) for d, w in words.items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.dedup(edge_docs).collect()} == want


def test_suffixes(edge_docs, edge_rows):
    data = {r[0]: (r[1] or "").encode() for r in edge_rows}
    gone = covered(data)
    want = {d: (len(b), sum(gone[d]), len(re.findall(b"\1+", bytes(gone[d]))), hashlib.sha256(bytes(x for x, g in zip(b, gone[d], strict=True) if not g)).hexdigest()) for d, b in data.items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(edge_docs).collect()} == want


def components(sets: dict) -> dict:
    where, up = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            where[x].append(d)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for e, k in Counter(e for x in s for e in where[x] if e > d).items():
            if 100 * k >= 75 * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_components_of_few_links_need_no_shuffle(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(9)
    found = jaccard.components(links)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = node
                todo += near[x]
    assert sorted(map(tuple, found.collect())) == sorted(want.items())
    monkeypatch.setattr(jaccard, "TASK_LINKS", 0)
    assert sorted(map(tuple, jaccard.components(links).collect())) == sorted(want.items())
    monkeypatch.undo()
    assert jaccard.components(links.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 4])
def test_jaccard(edge_docs, edge_rows, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MEET_BLOCK", block)
    sets = {}
    for r in edge_rows:
        w = WORDS.findall(lower(r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    want = components(sets)
    assert len(set(want.values())) < len(want)
    assert {r.doc: (r.n, r.component) for r in jaccard.near_duplicates(edge_docs).collect()} == {d: (len(sets[d]), want[d]) for d in sets}
    assert {r.doc_id for r in jaccard.one_of_each(edge_docs).collect()} == {d for d in sets if want[d] == d}


def test_prefixes_meet():
    """Two sets that link share a hash of their prefixes, whatever their order."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = set(rng.choice(10_000, n, replace=False).tolist())
        b = set(list(a)[: max(1, n - int(rng.integers(0, 8)))]) | set(rng.choice(10_000, int(rng.integers(0, 6))).tolist())
        if 100 * len(a & b) >= 75 * len(a | b):
            assert {*sorted(a)[: jaccard.prefix_length(len(a))]} & {*sorted(b)[: jaccard.prefix_length(len(b))]}


def test_exact_dedup(edge_docs, edge_rows):
    groups = defaultdict(list)
    for r in edge_rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    want = {}
    for text, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        want |= {r[0]: (keep, len(rows), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()) for r in rows}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.dedup(edge_docs).collect()} == want


def test_rice_codes():
    rng = np.random.default_rng(4)
    for n in (1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 40, n))
        assert (exact.rice_decode(*exact.rice_encode(values), len(values)) == values).all()


def test_tokens(edge_docs, edge_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    start = 0
    want = {}
    for r in sorted(edge_rows):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want[r[0]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.write_and_read(edge_docs).collect()} == want


def test_pieces_change_no_ids():
    e = tokens.Encoder(tokens.default_tokenizer())
    texts = [" a  b\n c", "", "   ", "it's  'll don't<|endoftext|> y", "a\x1c b 　 c\xa0 d  e", "a\tb  c ", "\n\n x", " x", "a\n b", "a \n b", "x   y z"] * 2
    assert e.encode(texts) == e._ids(texts) == e.encode(texts)


def test_huffman():
    rng = np.random.default_rng(5)
    for n in (1, 2, 300, 40_000):
        ids = (rng.zipf(1.2, 5000) % n).astype(np.uint32)
        counts = np.bincount(ids, minlength=n) + (n > 1000)
        lengths = tokens.code_lengths(counts)
        found = lengths[lengths > 0].astype(float)
        assert lengths.max() <= 17 and (2.0**-found).sum() <= 1
        stream, runs = tokens.pack(ids, lengths, tokens.canonical_codes(lengths))
        assert (tokens.unpack(stream, runs, len(ids), tokens.decode_table(lengths)) == ids).all()


def test_mixing(edge_docs, edge_rows):
    plan = {r.doc_id: r for r in mixing.mixing_plan(mixing.measured(edge_docs)).collect()}
    sizes = {r[0]: len(WORDS.findall(r[1] or "")) for r in edge_rows}
    assert {d: r.size for d, r in plan.items()} == sizes
    by = defaultdict(int)
    for r in edge_rows:
        by[r[3]] += sizes[r[0]]
    targets = {r.source: r.target for r in plan.values()}
    assert abs(sum(targets.values()) - sum(by.values())) < 1e-6
    assert all(t <= 3 * by[s] + 1e-9 for s, t in targets.items())
    level = {s: t / (1 + i % 3) for i, (s, t) in enumerate(sorted(targets.items(), key=lambda x: (x[0] is None, x[0]))) if t < 3 * by[s] - 1e-9}
    assert max(level.values()) - min(level.values()) < 1e-6
    emitted = Counter(r.doc_id for r in mixing.emit(edge_docs).collect())
    assert emitted == Counter({d: r.copies for d, r in plan.items() if r.copies})


def test_decontaminate(spark, edge_docs, edge_rows):
    item = " ".join(edge_rows[-12][1].split()[:60])
    items = spark.createDataFrame([(1, item), (2, "a"), (3, None), (4, ""), (5, "nowhere to be found in here")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(edge_docs, items).collect()}

    def similar(w: list[str], i: list[str]) -> bool:
        k = min(5, len(i))
        grams = lambda x: Counter(tuple(x[p : p + k]) for p in range(len(x) - k + 1))
        want, doc = grams(i), [tuple(w[p : p + k]) for p in range(len(w) - k + 1)]
        starts = {p - q for p, g in enumerate(doc) for q in range(len(i) - k + 1) if g == tuple(i[q : q + k])}
        return any(4 * (have := grams(w[max(s, 0) : max(s + len(i), 0)]), (have & want).total())[1] >= 3 * (have | want).total() for s in starts)

    lists = {r.item_id: [x.lower() for x in WORDS.findall(r.text or "")] for r in items.collect()}
    want = {(r[0], i) for r in edge_rows for i, x in lists.items() if x and similar([y.lower() for y in WORDS.findall(r[1] or "")], x)}
    assert found == want and len({d for d, i in found if i == 1}) >= 25
    assert {r.doc_id for r in decontaminate.clean(edge_docs, items).collect()} == {r[0] for r in edge_rows} - {d for d, _ in want}


def test_decontaminate_windows_begin_anywhere(spark):
    """Parts of an item in another order: the alike window begins where no shared shingle has its place of the item."""
    rng = random.Random(11)
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    item, short = [f"i{j}" for j in range(80)], [f"s{j % 7}" for j in range(30)]
    bodies = [
        filler(200) + item[40:] + item[:40] + filler(200), filler(50) + item[54:] + item[27:54] + item[:27] + filler(9), item[40:] + item[:40], filler(30) + item[:70] + filler(30),
        item[12:], item[:66], filler(20) + short[20:] + short[:20] + filler(20), filler(9) + item[20:40] + item[:20] + item[60:] + item[40:60] + filler(9), filler(9) + item[::-1], short * 3,
        filler(10) + item + filler(30) + item[40:] + item[:40],
    ]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(bodies)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    grams = lambda x: Counter(tuple(x[p : p + 5]) for p in range(len(x) - 4))
    want = {}
    for d, w in enumerate(bodies):
        for i, x in ((1, item), (2, short)):
            alike = [((have := grams(w[max(s, 0) : s + len(x)])) & grams(x)).total() / (have | grams(x)).total() for s in range(5 - len(x), len(w) - 4)]
            placed = {p - q for p in range(len(w) - 4) for q in range(len(x) - 4) if w[p : p + 5] == x[q : q + 5]}
            best = max(range(len(alike)), key=lambda j: (alike[j], j + 5 - len(x) in placed, -max(j + 5 - len(x), 0)))
            if alike[best] >= 0.75:
                want[d, i] = (max(best + 5 - len(x), 0), round(alike[best], 9))
    assert {(0, 1), (1, 1), (2, 1), (9, 2)} <= set(want)
    assert {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 9)) for r in decontaminate.matches(docs, items).collect()} == want


def test_licenses(spark):
    text = licenses.KNOWN["MIT"]
    varied = "Copyright (c) 2020 Someone\n" + text.replace("sublicense", "sub-license").replace('"', "“").upper() + "\n"
    rows = [(1, varied), (2, text + " and more"), (3, None), (4, ""), (5, licenses.KNOWN["0BSD"])]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: None, 5: "0BSD"}


@pytest.mark.parametrize("operator", [passages.dedup, suffixes.dedup, jaccard.near_duplicates, exact.dedup, tokens.write_and_read, licenses.scan, mixing.emit])
def test_empty_table(no_docs, operator):
    assert operator(no_docs).count() == 0


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, long + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    got = sorted((r.doc_id or 99, r.n_removed) for r in passages.dedup(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 80), (99, 0), (99, 80)]
    assert [r.keep_id for r in exact.dedup(docs).where("doc_id is null").orderBy("group_size").collect()] == [None, 1]
    assert [r.kept for r in exact.dedup(docs).where("doc_id = 1").orderBy("kept").collect()] == [False, True]
    assert jaccard.one_of_each(docs).count() == 2 and jaccard.one_of_each(docs).columns == docs.columns
    assert jaccard.near_duplicates(docs).where(F.col("doc") != repeats.NULL_ID).select("component").distinct().count() == 1
    assert tokens.write_and_read(docs).count() == 5


def morse(n: int, swap: bool) -> str:
    """A word on which sums modulo 2^64 of any odd base agree with those of its complement."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_are_told_apart_by_their_bytes(spark, n):
    start = [f"w{i}" for i in range(49)]
    docs = spark.createDataFrame([(1, " ".join([*start, morse(n, False)])), (2, " ".join([*start, morse(n, True)])), (3, " ".join(["x"] * 4 + [morse(n, False)])), (4, " ".join(["x"] * 4 + [morse(n, True)]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in passages.dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc: r.component for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("shared", [8, None])
def test_rows_that_share_an_id_keep_their_links(spark, shared):
    a, other = [f"a{i}" for i in range(60)], [f"z{i}" for i in range(60)]
    docs = spark.createDataFrame([(7, " ".join(a)), (shared, " ".join([*a[:58], "q", "r"])), (shared, " ".join(other))], "doc_id long, text string")
    assert {r.text[:2] for r in jaccard.one_of_each(docs).collect()} == {"a0", "z0"}
    assert sorted(r.component for r in jaccard.near_duplicates(docs).collect()) == sorted([7, 7, 8 if shared else repeats.NULL_ID])


def test_copies_in_one_group_keep_one_row(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "ab"), (2, "c"), (None, "c"), (None, None), (None, " ")], "doc_id long, text string")
    got = exact.dedup(docs).groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    assert all(r.kept == 1 for r in got) and sorted(r.n for r in got) == [2, 2, 3]


def test_signature_tree_loses_no_pair():
    """Every pair that links survives the dual traversal of a tree with inner nodes; most others do not."""
    rng = np.random.default_rng(12)
    sets = []
    for _ in range(120):
        base = rng.integers(0, 1 << 63, int(rng.integers(3, 300)), dtype=np.uint64)
        for _ in range(int(rng.integers(1, 9))):
            keep = base[rng.random(len(base)) > rng.random() * 0.2]
            sets.append(np.unique(np.concatenate([keep if len(keep) else base[:1], rng.integers(0, 1 << 63, len(base) // 12, dtype=np.uint64)])))
    sizes, maps = np.array([len(s) for s in sets]), [jaccard.bitmap(s, jaccard.bits_for(len(s))) for s in sets]
    tree = jaccard.Tree(sizes, maps)
    assert any(x.below for x in tree.roots)
    found = {tuple(sorted(p)) for i, j in tree.pairs(lambda some: some) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard._exact(sets, i, j)}
    assert want <= found and len(want) > 100 and len(found) < len(sets) ** 2 / 20


def test_repeated_rows_draw_apart(spark):
    """Many rows of one id and text: their source still comes near its target, and reruns agree."""
    docs = spark.createDataFrame([(None, "one two three four", "hot", "x")] * 400 + [(i, f"w{i} x y z", "cold", "y") for i in range(100)], "doc_id long, text string, source string, digest string").repartition(7)
    took = lambda: {r.source: r.n for r in mixing.emit(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    first = took()
    # 2,000 words in shares of 1 and 2: 667 for the cold source, 1,333 for the hot one, of 4 words a row.
    assert abs(first["hot"] - 333) < 30 and abs(first["cold"] - 167) < 20 and took() == first
    assert mixing.emit(docs).columns == docs.columns


def test_license_variants(spark):
    got = {r.doc_id: r.license_id for r in licenses.license_variants(spark, "").collect()}
    names = [k for k, _ in licenses.known_texts()]
    assert got == {100 * i + k: (name if k < 5 else None) for i, name in enumerate(names) for k in range(6)}
