import random
import re

import numpy as np
import pytest

from threadloom.llm import jaccard


def brute(rows):
    """Set size, component and number of linked other sets of each id, by all pairs on sets of word tuples."""
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}
    linked = {i: set() for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 4 >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    p, q = sorted((root(i), root(j)))
                    comp[q] = p
                    if a != b:
                        linked[i].add(b)
                        linked[j].add(a)
    return {i: (len(sets[i]), root(i), len(linked[i])) for i in ids}


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 6)))
    passage = [word() for _ in range(60)]
    out = [None, "", " \t\n", "One", "one", "one two three", "One TWO three", "Éa b c d e", "éa b c d e", "\x85 b c d e f"]
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([5, 8, 30, 60, 70, 90, 130, 400]))]
        if rnd.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        out.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            t = list(base)
            for _ in range(rnd.randrange(0, 1 + max(1, len(t) // 25))):
                k = rnd.randrange(len(t))
                t[k : k + 1] = rnd.choice([[], [word()], [word(), t[k]]])
            if rnd.random() < 0.3:
                t = t[: rnd.randrange(len(t) * 7 // 10, len(t) + 1)]
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small, monkeypatch):
    """Also with cells and led groups so small that every block is split, and texts found by a join."""
    if small:
        monkeypatch.setattr(jaccard, "CELL", 100)
        monkeypatch.setattr(jaccard, "LED", 1)
        monkeypatch.setattr(jaccard, "ROUNDS", 1)
    for seed in range(1 if small else 2):
        rows = list(enumerate(corpus(seed)))
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, id string, n long").repartition(3)
        found = jaccard.near_duplicates(docs, broadcast_texts=-1 if small else jaccard.BROADCAST_TEXTS)
        assert {r.id: (r.n_shingles, r.component_id, r.n_links) for r in found.collect()} == brute(rows)


def test_sketches_bound_the_difference():
    rnd = random.Random(5)
    some = lambda n: [rnd.randrange(1 << 64) for _ in range(n)]
    for _ in range(200):
        a = np.unique(np.array(some(rnd.randrange(1, 900)), np.uint64))
        keep = [x for x in a.tolist() if rnd.random() < 0.93] or a.tolist()
        b = np.unique(np.array(keep + some(len(a) // 12), np.uint64))
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        for band in range(6):
            x, y = jaccard.folded([a, b], band)
            assert int(jaccard.hamming(x, y[None])[0]) <= differ
        wide = [jaccard.wide_sketch(s) for s in (a, b)]
        assert len(set(wide[0].tolist()) ^ set(wide[1].tolist())) <= differ
        if not jaccard.links(a, b):
            continue
        limit = min(jaccard.max_distance(len(a)), jaccard.max_distance(len(b)))
        assert differ <= limit
        for band in set(jaccard.bands_of(len(a))) & set(jaccard.bands_of(len(b))):
            one, two = (set(jaccard.block_keys(w, band).tolist()) for w in wide)
            assert len(one - two) <= limit and len(two - one) <= limit
        assert set(jaccard.bands_of(len(a))) & set(jaccard.bands_of(len(b)))


def test_bits_cancel():
    flipped_twice = np.array([5 << 16, (5 << 16) + 1, 9 << 16], np.uint64)
    assert jaccard.wide_sketch(flipped_twice).tolist() == [9]
    assert len(jaccard.block_keys(jaccard.wide_sketch(flipped_twice[:2]), 1)) == 0


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "zz"), (9, "A b C d e f"), (4, None)], "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (None, None), (9, 3), (4, 4)], key=str)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_rows_are_kept_by_id_and_text(spark):
    prose = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [
        (3, prose[0], "a"), (5, prose[0] + " more", "b"), (5, prose[1], "c"), (None, prose[0], "d"), (None, prose[2], "e"), (None, prose[2] + " end", "f"),
        (8, prose[1], "g"), (8, prose[1], "g"), (5, prose[1], "z"), (None, None, "h"), (None, None, "h"), (7, " ", "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(3)
    kept = sorted(((r.doc_id, r.text, r.component) for r in jaccard.keep_first(docs).collect()), key=str)
    assert [k[:2] for k in kept] == sorted([(3, prose[0]), (5, prose[1]), (None, None), (None, None), (7, " "), *[x[:2] for x in kept if x[2] in "ef"]], key=str)
    assert sum(x[2] in "ef" for x in kept) == 1 and jaccard.keep_first(docs.limit(0)).columns == docs.columns


def test_any_id_and_very_long_texts(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(50_000)}" for _ in range(60_000)]
    rows = [("b", " ".join(long)), ("a", " ".join(long[:50_000])), ("c", " ".join(long[:40_000])), ("d", "x " * 200_000), ("e", "x " * 100_000)]
    out = {r.id: (r.component_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out == {"a": ("a", 2), "b": ("a", 1), "c": ("a", 1), "d": ("d", 0), "e": ("d", 0)}


def test_a_group_that_drifts_apart(spark):
    """Near copies of one text that mostly don't link with one another: every link is found and no table of pairs is made."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rnd.randrange(1, 4)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()} == brute(rows)


def test_what_a_crowd_moves(spark, monkeypatch):
    """Classes of a large component go as differences from its core: counts stay exact, and what goes to pairs of cells is a small part of the sets."""
    monkeypatch.setattr(jaccard, "CELL", 4_000)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rnd.randrange(1, 4)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(t if i % 7 else t[: rnd.randrange(290, 390)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    moved, real = [], jaccard.differences

    def differences(crowds, sets):
        out = real(crowds, sets)
        moved.append((sum(len(r.d) // 8 for r in out.select("d").collect()), crowds.agg({"n": "sum"}).first()[0]))
        return out

    monkeypatch.setattr(jaccard, "differences", differences)
    assert {r.id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()} == brute(rows)
    assert len(moved) == 1 and moved[0][0] * 8 < moved[0][1]
