from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, nulls, blanks, ties and long texts, as (doc_id, text)."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    passage, base, rows = text(60), [text(120) for _ in range(6)], []
    for b in base:
        for edits in (0, 0, 1, 2, 4, 9):
            t = list(b)
            for _ in range(edits):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
    rows += [" ".join(text(30) + passage + text(rng.randint(5, 80))) for _ in range(12)]
    rows += [" ".join(text(rng.randint(1, 60))) for _ in range(20)]
    rows += [None, "", " \t\n ", "a", "a b", "A B", "one two three", "One  two\nthree", "é É ü", "x " * 3000, " ".join(text(4000))]
    rows += [(rows[3] or "").upper(), rows[3].replace(" ", "\n"), "the the the the " * 30]
    rng.shuffle(rows)
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with repeated rows and columns whose names the operators use too."""
    rows = [(i, t, f"s{i % 3}", i % 2, "clash") for i, t in corpus] + [(*corpus[0], "s0", 0, "clash"), (*corpus[0], "s0", 0, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, k string").withColumnRenamed("k", "_text").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("doc_id < 0")
