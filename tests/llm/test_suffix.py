import random
from collections import Counter
from hashlib import sha256

import pytest

from threadloom.llm import suffix


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if counts[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield len(r), len(r) - len(kept), spans, sha256(kept).hexdigest()


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(90)
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 1000, "ab" * 300, passage, passage]
    for _ in range(30):
        t = prose(rnd.randrange(5, 200))
        texts.append(t)
        if rnd.random() < 0.4:
            cut = rnd.randrange(len(passage) // 2)
            texts.append(prose(20) + passage[cut : cut + rnd.choice([199, 200, 201, 260, 400])] + prose(20))
        if rnd.random() < 0.4:
            at = rnd.randrange(len(t))
            texts.append(t[:at] + "#" + t[at:])
        if rnd.random() < 0.3:
            texts.append(t + t)
    return texts


@pytest.mark.parametrize("bits", [suffix.FILTER_BITS, 64])
def test_against_brute_force(spark, bits, monkeypatch):
    """Also with filters so small that they let everything through."""
    monkeypatch.setattr(suffix, "FILTER_BITS", bits)
    for seed in range(2):
        texts = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(3)
        want = list(brute(texts))
        got = {r.doc_id: tuple(r)[1:] for r in suffix.report(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_remove_keeps_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "é" * 150, "k"), (3, "a" + "é" * 150, "k"), (None, "short", None)], "doc_id long, text string, entry string")
    out = {r.doc_id: r for r in suffix.remove(docs).collect()}
    assert out[1].text is None and out[2].text == "" and out[3].text == "a" and out[None].text == "short" and out[1].entry == "k"
    assert suffix.report(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(7)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    noise = lambda n: "".join(rnd.choice("ijklmnop ") for _ in range(n))
    rows = [(1, noise(1_500_000) + passage + noise(1_500_000)), (2, noise(300) + passage), (3, "z" * 1_000_000), (4, noise(100_000))]
    out = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (5000, 1), 2: (5000, 1), 3: (1_000_000, 1), 4: (0, 0)}
