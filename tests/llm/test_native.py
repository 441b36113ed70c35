"""Chat formatting, mixing, quality rules and licence scans on small tables and against plain Python."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat, licenses, mixing, quality


def test_chat_reads_back(spark):
    rows = [
        (1, 2, "assistant", "b<|im_end|>\n"), (1, 1, "user", "a & <|im_start|>&lt;|"), (1, 3, "assistant", None), (1, 3, "assistant", "<|im_turn|>"), (1, None, "system", "first\n\nx"),
        (2, 1, "ro\nle<|", "<"), (2, 1, "ro\nle<|", "<"), (None, 0, None, None), (None, 1, "assistant", "|im_end|>"), (3, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_chats(df).withColumn("read", chat.parse_chats(F.col("formatted"))).collect()}
    for conv in (1, 2, 3, None):
        want = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in out[conv].read] == [(r, x) for _, _, r, x in want]
        assert "".join(s.piece for s in out[conv].segments) == out[conv].formatted and out[conv].n_turns == len(want)
    assert [s.piece for s in out[1].segments if s.loss] == ["b&lt;|im_end|>\n", "", "&lt;|im_turn|>"]
    assert out[1].formatted.count("<|im_start|>") == 3
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chat_is_linear(spark):
    rows = spark.range(30000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("x y "), 20).alias("text"))
    r = chat.format_chats(rows).withColumn("read", chat.parse_chats(F.col("formatted"))).select("n_turns", F.size("read").alias("n")).first()
    assert tuple(r) == (30000, 30000)


def test_mix_targets_and_caps(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randrange(0, 40)) if i % 9 else None, rnd.choice(["a", "a", "a", "b", "c", "d", None]), 1) for i in range(300)] + [(None, "x y", "b", 1), (7, "q q q", "a", 1), (7, "q q q", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(4)
    docs = docs.withColumns({"size": F.lit(-1), "bucket": F.lit("b"), "source_size": F.lit("c")})
    out = mixing.mix(docs, keep=("size", "bucket", "source_size", "target", "text"), broadcast_buckets=-1).collect()
    assert all(tuple(r.kept)[:3] == (-1, "b", "c") and r.size == len((r.kept.text or "").split()) for r in out)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, out))
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    names = sorted(s for s in size if s is not None) + [None]
    goal, free, left = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(size.values())
    while True:
        level = left / sum(free.values())
        full = [s for s in free if level * free[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            goal[s] = 2.0 * size[s]
            left -= goal[s]
            del free[s]
    goal |= {s: level * w for s, w in free.items()}
    taken, targets = Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[r.source_size, round(r.target, 6)] += r.taken
        targets[r.source_size] = r.target
    assert sorted(targets.values()) == [r for r in sorted(goal.values())] or all(abs(a - b) < 1e-6 for a, b in zip(sorted(targets.values()), sorted(goal.values())))
    assert all(0 <= t - n < 1 for (_, t), n in taken.items())
    order = [r.position for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert order == sorted(order) and mixing.mix(docs.limit(0)).count() == 0


def test_demand_follows_schedule(spark):
    df = spark.createDataFrame([(p, y / 20) for p in range(3) for y in range(21)], "place int, share double")
    for r in df.withColumn("t", mixing.demand_inverse(F.col("place"), F.col("share"))).collect():
        a, b = mixing.SCHEDULES[r.place]
        area = a * r.t + (b - a) * r.t**2 / 2
        assert abs(area / ((a + b) / 2) - r.share) < 1e-9


def plain_quality(t):
    t = t or ""
    w = re.findall("[^ \t-\r]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 500, "é é x", "one\ntwo\none\n\n", "a\x85b c\x1fd"]
    texts += ["".join(rnd.choice(["a ", "b ", "c ", "\n", "d. ", "| "]) for _ in range(rnd.randrange(1, 120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    for r in quality.assess(docs).collect():
        assert (r._q_n_words, r._q_word_chars, r._q_n_symbols, r._q_n_dup_lines, r._q_n_repeat_words) == plain_quality(texts[r.doc_id]), repr(texts[r.doc_id])
    assert quality.assess(docs.limit(0)).count() == 0


@pytest.mark.parametrize("said", ["We use cookies", "Read our PRIVACY policy", "Terms of Service", "Skip to content", "Share this post", "Read more \u00bb"])
def test_quality_boilerplate_in_lines_of_any_length(spark, said):
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [prose + f" {said} " + " ".join(f"more{i}" for i in range(60)) + ".", prose + " " + " ".join(f"more{i}" for i in range(60)) + "."]
    assert all(len(t) > 600 for t in texts)
    out = {r.doc_id: r for r in quality.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (out[0]._q_kept, out[0]._q_clean_text) == (False, "")
    assert (out[1]._q_kept, out[1]._q_clean_text) == (True, texts[1])


def test_quality_verdicts(spark):
    prose = "The quick brown fox jumps over the lazy dog near a river bank today."
    texts = [prose, prose + "\nHome | News | About | Contact", prose + "\n" + "BUY!! NOW!! " * 12, "word*** other$$$ more### " * 8 + "x", prose + "\nAll rights reserved."]
    out = {r.doc_id: r for r in quality.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i]._q_kept for i in range(5)] == [True, True, False, False, True]
    assert out[0]._q_clean_text == out[1]._q_clean_text == prose and out[4]._q_clean_text == prose


def test_licences(spark):
    mit = licenses.LICENSES["MIT"][0]
    docs = [
        (1, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE")), (2, mit + " extra"), (3, None), (4, "text\n  Released under the MIT Licence!\n"),
        (5, "# " + licenses.LICENSES["ISC"][1].replace("\n", "\n# ")), (5, "")]
    out = [(r.doc_id, r.license_id, r.notices) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "license_id").collect()]
    assert sorted(out, key=str) == sorted([(1, "MIT", []), (2, None, []), (3, None, []), (4, None, ["MIT"]), (5, "ISC", []), (5, None, [])], key=str)
    assert sha256(b"").hexdigest() in {r.canonical_sha256 for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_license_notices_of_every_kind(spark):
    # the four wordings that occur in documents, then others
    said = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 3.0": "CC-BY-NC-3.0", "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "Licensed under the GNU Affero General Public License v3": "AGPL-3.0",
        "Licensed under the Mozilla Public License, v. 2.0": "MPL-2.0", "Released under the Unlicense": "Unlicense", "Licensed under CC BY-NC": "",
    }
    docs = spark.createDataFrame([(i, f"text\n{line}\nmore") for i, line in enumerate(said)], "doc_id long, text string")
    assert [",".join(r.notices) for r in licenses.scan(docs).orderBy("doc_id").collect()] == list(said.values())
    lines = [(name, t) for name, every in licenses.NOTICES.items() for t in every]
    known = spark.createDataFrame(lines, "name string, t string").select("name", licenses._whole(licenses._canonical_lines(F.col("t"))).alias("k")).collect()
    assert all(licenses.NOTICE_STEM in r.k for r in known)
    assert len({r.k for r in known}) == len({(r.name, r.k) for r in known})


@pytest.mark.parametrize("width", [40, 60, 72, 80, 100])
def test_whole_licences_at_every_wrap_width(spark, width):
    """Texts wrapped anywhere keep their digest: body lines that begin with "copyright" stay."""
    import textwrap

    rows = []
    for name, every in licenses.LICENSES.items():
        for k, t in enumerate(every):
            for w in range(width - 6, width + 7):
                wrapped = "\n\n".join(textwrap.fill(p, w, break_long_words=False, break_on_hyphens=False) for p in t.split("\n\n"))
                rows.append((name, f"Copyright (c) 2019-2024 A. Person\n\n{wrapped}\n"))
    out = licenses.scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [r for r in out if r.license_id != r.name] == []


def test_copyright_lines(spark):
    gone = ["Copyright (c) 2020 X", "Copyright 1999, 2001 X", "# Copyright \u00a9 X", "(c) 2020 X", "\u00a9 X", "Copyright [yyyy] [name of copyright owner]", "Copyright <YEAR> <HOLDER>", "Portions Copyright 2003 X", "Copyright The Authors 2021", "(C) Copyright 2010 X", "Copyright Foo Bar, 2019-2021", "Copyright Foo Inc.", "Copyright Foo, Ltd. and others", "Copyright J. R. Doe, Some Place, 2020"]
    stay = ["copyright holders be liable for any claim", "(c) You must retain, in the source form,", "copyright notice, this list of conditions", "copyright license to reproduce, prepare"]
    rows = [(line, True) for line in gone] + [(line, False) for line in stay]
    found = spark.createDataFrame(rows, "line string, gone boolean").select("line", "gone", licenses._whole(licenses._canonical_lines(F.concat(F.lit("a\n"), "line", F.lit("\nb")))).alias("c")).collect()
    assert [r.line for r in found if (r.c == "a b") != r.gone] == []


def test_long_licences_by_digest(spark):
    import os

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no published texts here")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl", "GFDL-1.3": "GFDL-1.3"}
    rows = [(name, open(f"{folder}/{f}", encoding="utf-8").read()) for f, name in files.items() if os.path.exists(f"{folder}/{f}")]
    rows += [(name, t.replace("\n", "\r\n") + "\n\n") for name, t in rows]
    assert [(r.name, r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "name string, text string")).collect() if r.name != r.license_id] == []


def test_licence_edges(spark):
    rows = [(None, "x", None, "n", 1), (7, "x", "own licence text of a company", "n", 2), (7, "x", "own licence text of a company", "n", 2), (8, "x", "long " * 300_000, "n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, license_id string, text string, notices string, known_sha256 int")
    more = spark.createDataFrame([("B", "Own license text, of a company!"), ("A", "own license text of a company"), ("C", None)], "license_id string, text string")
    out = licenses.scan(docs, more=more).orderBy("known_sha256").collect()
    assert [(r.in_license_id, r.in_notices, r.license_id, r.notices) for r in out] == [("x", "n", "C", []), ("x", "n", "A", []), ("x", "n", "A", []), ("x", "n", None, [])]
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs).where("license_id is not null").count() == 0


def test_op5_reads_the_training_order(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * rnd.randrange(0, 30)) if i % 9 else None, rnd.choice(["a", "a", "b", "c", None])) for i in range(200)] + [(None, "x y", "b"), (7, "q q q", "a"), (7, "q q q", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = [(r.doc_id, r.size, r.source_size, r.target, r.taken, r.positions[0] if r.positions else None) for r in mixing.mix(docs).collect()]
    assert sorted(map(str, plain)) == sorted(str(tuple(r)) for r in mixing.op5_mixing(spark, str(tmp_path)).collect())
    order = mixing.training_order
    monkeypatch.setattr(mixing, "training_order", lambda mixed: order(mixed).where("epoch = 0"))
    assert all(r.taken <= r.size for r in mixing.op5_mixing(spark, str(tmp_path)).collect()) and any(r[4] > r[1] for r in plain)


def test_mixing_of_very_long_and_null_rows(spark):
    rows = [(None, "w " * 200_000, "a"), (None, None, None), (None, None, None), (None, "x y", "a"), (3, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    out = sorted((r.size, r.taken) for r in mixing.mix(docs).collect())
    assert [s for s, _ in out] == [0, 0, 0, 2, 200_000] and sum(t for _, t in out) == int(1.5 * 200_002)


def test_quality_of_null_ids_and_all_languages(spark):
    prose = " ".join(f"mot{i}" for i in range(40)) + "."
    said = ["Alle Rechte vorbehalten.", "Tous droits r\u00e9serv\u00e9s.", "Pol\u00edtica de privacidad y m\u00e1s.", "Wir verwenden Cookies auf dieser Seite."]
    docs = spark.createDataFrame([(None, f"{prose}\n{x}", 1) for x in said] + [(None, prose, 1), (None, None, 1)], "doc_id long, text string, _q_kept int")
    out = quality.assess(docs).collect()
    assert [r._q_clean_text for r in out] == [prose] * 5 + [""] and [r._q_kept for r in out] == [True] * 5 + [False]
