"""The pipeline, stage by stage, against plain Python over whole texts."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import md5, sha256

import corpus_pipeline as c
from threadloom.llm import bpe, mixing, quality

from .test_jaccard import brute as linked
from .test_native import plain_quality

WORD = re.compile("[^ \\t-\\r]+")
BOILERPLATE = re.compile(quality.BOILERPLATE)
MARKS = {"|", ">", "\u00bb", "\u2022", "\u00b7", "/", "::", "->"}


def plain_clean(text):
    """(kept, cleaned text) by the line rules."""
    n, chars, _, _, repeats = plain_quality(text)
    keep, lost = [], 0
    for line in (text or "").split("\n"):
        w = WORD.findall(line)
        marks = sum(x in MARKS for x in re.split("[ \\t]", line))
        bad = w and (
            (line.rstrip(" \t\x0b\x0c\r")[-1] not in quality.CLOSING and len(w) < 4)
            or 100 * sum(x in "#*$%&|<>" for x in line) > 50 * len(w)
            or 100 * line.count("!") > 50 * len(w)
            or (marks >= 3 and 100 * marks > 15 * len(w))
            or BOILERPLATE.search(line.lower())
        )
        if bad:
            lost += sum(map(len, w))
        else:
            keep.append(line)
    return not (n < 10 or 100 * repeats > 20 * n) and 100 * lost <= 30 * chars, "\n".join(keep)


def plain_first(rows):
    """One row of each component: rows count by id and text, least id first, null last."""
    texts = sorted({r[1] for r in rows}, key=str)
    comp = linked(list(enumerate(texts)))
    groups = defaultdict(list)
    for r in rows:
        groups[comp[texts.index(r[1])][1]].append(r)
    return groups


def plain_cut(texts):
    """Texts without the bytes that a 200-byte string found twice covers."""
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    for t, r in zip(texts, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if counts[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        yield t if not any(gone) else bytes(x for x, g in zip(r, gone) if not g).decode("utf-8", "ignore")


def plain_mix(rows):
    """(id, text, source) of each copy, by the schedule's inverse found by bisection."""
    size = Counter()
    for i, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    free, goal, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(size.values())
    while True:
        level = left / sum(free.values()) if free else 0
        full = [s for s in free if level * free[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            goal[s] = 2.0 * size[s]
            left -= goal[s]
            del free[s]
    goal |= {s: level * w for s, w in free.items()}
    out = []
    for k, s in enumerate(names):
        a, b = mixing.SCHEDULES[k % 3]
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (md5(str(r[0] if r[0] is not None else (r[1] or "")).encode()).hexdigest(), str(r[0]), len(WORD.findall(r[1] or ""))))
        at = 0
        for epoch in range(2):
            for i, t, _ in own:
                n = len(WORD.findall(t or ""))
                take = max(0, min(n, math.floor(goal[s] + 1e-9) - at))
                if take:
                    share, lo, hi = at / goal[s], 0.0, 1.0
                    for _ in range(60):
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if (a * mid + (b - a) * mid * mid / 2) / ((a + b) / 2) < share else (lo, mid)
                    whole = t if take == n else re.match("(?:[^ \\t-\\r]+[ \\t-\\r]*){%d}" % take, t[re.search("[^ \\t-\\r]", t).start() :])[0]
                    out.append((lo, i, whole, s))
                at += n
    return out


def corpus(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    shared = prose(80)
    texts = [prose(rnd.randrange(20, 120)) for _ in range(40)]
    texts += [texts[0], texts[1] + " end.", prose(40) + "\n" + shared, prose(40) + "\n" + shared, "short", None, "a b " * 50, prose(60) + "\nHome | News | About", "We use cookies " * 5 + prose(30)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, 0) for i, t in enumerate(texts)]
    # repeated and null ids: a near copy and a unique text of id 5, an exact copy and a unique one without id, a row twice
    rows += [(5, texts[3] + " more.", "en", "s1", 0), (5, prose(50), "de", "s1", 0), (None, texts[4], "en", "s2", 0), (None, prose(70), "en", None, 0), rows[7], (None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows, shared


def test_against_plain_python(spark, tmp_path):
    rows, _ = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs.collect()]
    at = docs
    for name, stage in c.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        at = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen.append(at.collect())
        if name != c.STAGES[-1][0]:
            assert at.columns == list(c.COLUMNS)
    key = lambda r: str(tuple(r))
    cleaned = [(r.doc_id, plain_clean(r.text)[1], r.lang, r.source) for r in seen[0] if plain_clean(r.text)[0]]
    assert sorted(map(str, cleaned)) == sorted(str(tuple(r)[:4]) for r in seen[1]) and all(r.n_chars == len(r.text) for r in seen[1])

    groups = plain_first([tuple(r) for r in seen[1]])
    kept = defaultdict(list)
    for r in seen[2]:
        kept[next(k for k, g in groups.items() if tuple(r) in g)].append(tuple(r))
    assert set(kept) == set(groups) and all(len(v) == 1 for v in kept.values())
    for k, g in groups.items():
        ids = [r[0] for r in g if r[0] is not None]
        assert kept[k][0][0] == (min(ids) if ids else None)

    before = sorted(seen[2], key=key)
    want = [(r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(before, plain_cut([r.text for r in before]))]
    assert sorted(map(str, want)) == sorted(map(key, seen[3]))

    mixed = plain_mix([(r.doc_id, r.text, r.source) for r in seen[3]])
    assert Counter((i, t, s) for _, i, t, s in mixed) == Counter((r.doc_id, r.text, r.source) for r in seen[4])
    order = [r.doc_id for r in c.mixture(spark, spark.createDataFrame(seen[3], schema), "").collect()]
    assert order == [m[1] for m in sorted(mixed, key=lambda m: (round(m[0], 9), m[1] if m[1] is not None else -1))]

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    ids = [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in seen[4]]
    want = [(i, len(x), sha256(" ".join(map(str, x)).encode()).hexdigest(), sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids]
    assert sorted(map(str, want)) == sorted(map(key, seen[5]))
    assert sorted(map(key, c.run(spark, str(tmp_path)).collect())) == sorted(map(key, seen[5]))


def test_stages_on_odd_tables(spark):
    rows, _ = corpus(6)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows[:12], schema)
    for name, stage in c.STAGES:
        clash = docs.selectExpr("*", "1 as size", "2 as bucket", "'x' as node", "3 as kept", "4 as _q_kept")
        out = stage(spark, clash, "")
        assert out.columns == stage(spark, docs.limit(0), "").columns and stage(spark, docs.limit(0), "").count() == 0, name
        if name != c.STAGES[-1][0]:
            assert out.columns == list(c.COLUMNS) and out.count() > 0
