from __future__ import annotations

import random

import pytest

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, exact and near copies, shared passages and a hot group."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [some(rng.randint(40, 120)) for _ in range(4)]
    rows, n = [], 0
    for _ in range(10):
        base = some(rng.randint(3, 150))
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                words += rng.choice(shared)[rng.randrange(8) :] + some(rng.randint(0, 15))
            rows.append((n, rng.choice([" ", "  ", "\n "]).join(words), "en", f"s{n % 5}", 0))
            n += 1
    rows += [(n + i, " ".join(shared[0]), "en", "hot", 0) for i in range(25)]
    n += 25
    for text in (None, "", " \t\n", "a", "A", "a b", "Ünïcödé \x1c text", "x " * 4000, "xy" * 300, "😀 " * 60):
        rows.append((n, text, None, None, None))
        n += 1
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
