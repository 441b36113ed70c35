"""BPE against the library, and severity regression on held-out rows."""

import random
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import bpe, toxicity


def test_bpe_like_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.WordBpe(bpe.read_vocabulary(path))
    library.no_truncation()
    library.no_padding()
    rnd = random.Random(1)
    texts = ["", "  ", "don't WE'LL 123", "ΟΔΟΣ Σ's", "İSTANBUL é", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "x" * 3000, "a b\x85c"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x180)])) for _ in range(rnd.randrange(80))) for _ in range(300)]
    # code points from all over, those assigned lately too
    every = [c for c in range(0x80, 0x34000) if not 0xD800 <= c <= 0xDFFF]
    texts += ["a" + "".join(map(chr, rnd.sample(every, 4))) + "b1" for _ in range(1500)] + ["a" + chr(c) + "b" + chr(c) + "1" for c in (0x558, 0x88F, 0x1C89, 0xA7CB, 0x10D50, 0x11DE0, 0x12550, 0x2B73A, 0x323B0, 0x3FC3F)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == want.ids and own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for i, t in enumerate(texts):
        ids = own.encode(t)
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
    both = bpe.decode(bpe.encode(docs)).withColumn("h", F.sha2("text", 256)).collect()
    assert {r.doc_id: r.h for r in both} == {r.doc_id: r.decoded_sha256 for r in out.values()}


def test_bpe_edges(spark):
    import json

    spec = json.loads(bpe.read_vocabulary())
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 50_000, "content": "[SEP]"})
    spec["model"]["unk_token"] = "<unk>"
    gone = spec["model"]["vocab"].pop("q</w>")
    spec["model"]["vocab"]["<unk>"] = gone
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if (m[1] if isinstance(m, list) else m.split(" ")[1]) != "q</w>"]
    own = bpe.WordBpe(json.dumps(spec))
    assert own.encode("a[SEP]q") == [*own.encode("a"), 50_000, gone]
    docs = spark.createDataFrame([(None, "long word " * 100_000, [1]), (1, "x", None), (1, "x", None)], "doc_id long, text string, ids array<int>")
    out = bpe.digests(docs).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out if r.doc_id) == [(1, 1), (1, 1)] and max(r.n_tokens for r in out) == 200_000
    assert bpe.digests(docs.limit(0)).count() == 0 and bpe.encode(docs).columns == ["doc_id", "ids"]


def test_heap_equals_scan():
    own = bpe.WordBpe(bpe.read_vocabulary())
    rnd = random.Random(2)
    for _ in range(300):
        names = [own.symbols[b] for b in "".join(rnd.choice("theinrangl") for _ in range(rnd.randrange(1, 60))).encode()]
        names[-1] += own.end
        ids = [own.vocab[n] for n in names]
        assert own._scan(list(ids)) == own._heap(list(ids))


def test_severity(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{c}{d}" for c in "abcdefgh" for d in "xyzuv"]
    bad = ["scum", "vile", "crook"]
    rows = []
    for i in range(600):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 60))]
        y = int(rnd.random() < 0.3)
        for _ in range(rnd.randrange(1, 6) * y):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (700, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(900, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(bad) <= set(model.weights)
    assert list(model.ordinal.thresholds) == sorted(model.ordinal.thresholds) and len(model.ordinal.thresholds) == toxicity.GRADES
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(out[i].toxic, y) for i, _, y in rows if i % 2 == 0]
    assert np.mean([int(a) == b for a, b in held]) > 0.97 and not out[700].toxic and not out[None].toxic
    some = [(out[i].expected_severity, sum(w in bad for w in t.split())) for i, t, y in rows if y]
    assert np.corrcoef(*zip(*some))[0, 1] > 0.7
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert none.weights == {} and not any(r.toxic or r.severity for r in toxicity.score(docs, none).collect())


def test_word_pairs_tell_where_words_do_not(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(500):
        words = [rnd.choice("abcdefghij") + rnd.choice("klmno") for _ in range(40)]
        y = int(rnd.random() < 0.4)
        # both words are everywhere; side by side only in texts labelled 1
        words[5], words[25] = "get", "lost"
        if y:
            words[6] = "lost"
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, toxic int"))
    assert "get lost" in model.weights
    out = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    assert np.mean([out[i] == bool(y) for i, _, y in rows if i % 2 == 0]) > 0.97


def test_given_grades_and_edges(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        g = rnd.choice([0, 0, 0, 1, 2, 3])
        words = [rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(30)] + ["vile"] * (2 ** g - 1)
        rnd.shuffle(words)
        rows.append((i, " ".join(words), g))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in rows] + [(None, "vile " * 200_000, "clash", 1), (5, rows[5][1], "clash", 1)], "doc_id long, text string, severity string, _y int")
    labels = spark.createDataFrame([(i, g, "x") for i, _, g in rows if i % 2], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 602 and len(model.ordinal.thresholds) == 3
    by = {r.doc_id: r for r in out}
    held = [(by[i].severity, g) for i, _, g in rows if i % 2 == 0]
    assert np.mean([a == g for a, g in held]) > 0.8 and by[None].severity == 3
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels).weights == {} == toxicity.train(docs, labels.limit(0)).weights
