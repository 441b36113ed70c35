"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from threadloom.llm import search

DOCS = "doc_id long, text string, n int, score string, rank int, term string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    held = [(d, Counter(terms(t))) for d, t, *_ in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for key, text in items:
        scores = []
        for d, c, n in held:
            m = 50 + (50 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(key, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def corpus(n=900):
    rng = random.Random(11)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}é" for k in range(400)]
    docs = []
    for k in range(n):
        words = [rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.choice([0, 1, 4, 30, 200]))]
        text = rng.choice([" ", "-", "\x00", "_", "\u00a0"]).join(w.upper() if rng.random() < 0.2 else w for w in words)
        docs.append((k if rng.random() < 0.97 else None, text if rng.random() < 0.97 else None, 1, "s", 2, "t"))
    docs += [(5, docs[5][1], 0, None, None, None)] * 3 + [(n + k, docs[7][1], 0, None, None, None) for k in range(120)]
    docs.append((10_000, "c1 r5é " * 150_000, 0, None, None, None))
    items = [(k, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.choice([1, 3, 12, 40])))) for k in range(25)]
    return docs, [*items, (3, "r1é r2é"), (None, "c1 C1 nowhere"), (40, None), (41, "!?"), (42, "nowhere")]


@pytest.mark.parametrize("top, postings, block", [(50, search.SHARD_POSTINGS, 100), (3, 500, 7), (10_000, 4_000, 100)])
def test_against_scores_of_all_documents(spark, monkeypatch, top, postings, block):
    monkeypatch.setattr(search, "RANGE", 16)
    docs, items = corpus()
    found = search.rank(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id int, text string"), top=top, shard_postings=postings, block_queries=block)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, top)


def test_documents_are_skipped():
    """Most documents aren't scored once the heap is full, and the heap is the right one."""
    import numpy as np

    rng = np.random.default_rng(1)
    n = 20_000
    per_doc = np.full(n, 3)
    term = np.sort(np.stack([rng.integers(0, 5, n), 5 + rng.integers(0, 50, n), 55 + rng.integers(0, 500, n)], 1), 1).ravel()
    shard = search.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 3), per_doc, term, np.ones(3 * n, np.int64), 1000 + 10 * np.arange(555), (n, 3 * n))
    scored = []

    class Watched(search.Heap):
        def add(self, score, doc, none):
            scored.append(len(score))
            super().add(score, doc, none)

    query, heap = np.array([0, 1, 7, 8, 100, 101, 102]), Watched(10)
    shard.search(query, heap)
    full = np.zeros(n, np.int64)
    for t in query:
        full[shard.own[shard.start[t] : shard.start[t + 1]]] += shard.impact[shard.start[t] : shard.start[t + 1]]
    best = np.lexsort((np.arange(n), -full))[:10]
    assert heap.doc.tolist() == best.tolist() and heap.score.tolist() == full[best].tolist()
    assert sum(scored) < (full > 0).sum() / 10


def test_no_documents_or_queries(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert search.rank(docs, items).count() == 0
    assert search.rank(spark.createDataFrame([(1, "", 1, "", 1, ""), (2, None, 1, "", 1, "")], DOCS), items).count() == 0
    assert search.rank(spark.createDataFrame([(1, "a", 1, "", 1, "")], DOCS), items.limit(0)).count() == 0
