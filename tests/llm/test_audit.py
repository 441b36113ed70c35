"""The audit of filters against plain Python over all orders."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from threadloom.llm import audit

DOCS = "doc_id long, text string, source string, part string, good int, digest string"
LABELS = "doc_id long, quality int, toxic int"


def fails(docs):
    first = {}
    for key, text, *_ in docs:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    for key, text, source, *_ in docs:
        words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", text or "") if w]
        yield key, source or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text or "") > 2 * len(text or ""),
            "D": any(c in "#$%&*|" for c in text or ""), "E": key is not None and key > first[text or ""],
        }


def brute(docs, labels, filters="ABCDE"):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    rows, out, removed_by = list(fails(docs)), {}, {}
    for part in {p for _, p, _ in rows}:
        own = [(k, f) for k, p, f in rows if p == part]
        for order in map("".join, permutations(filters)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                out[part, order, step] = [
                    len(left), len(gone), sum(x[1][f] for x in own) - len(gone), sum([g for g in filters if x[1][g]] == [f] for x in own),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                ]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
    return sorted((*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def corpus():
    rng = random.Random(3)
    few = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(160):
        n = rng.choice([0, 5, 150, 199, 200, 230, 700])
        words = [rng.choice(few) if rng.random() < 0.6 else f"x{rng.random()}" for _ in range(n)]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.2:
            words.append(rng.choice(["#", "a|b", "é&"]))
        docs.append((k if rng.random() < 0.95 else None, rng.choice([" ", "\t\n", "  "]).join(words), rng.choice(["s0", "s1", None, "", "long name"]), "clash", 7, "x"))
    docs += [(200 + k, rng.choice(docs)[1], "s0", "clash", 1, "x") for k in range(60)] + [(500 + k, None, "s2", None, None, None) for k in range(4)] + [docs[0], docs[0]]
    docs.append((999, "Long " * 200_000, "s1", None, None, None))
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 260, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    return docs, labels


@pytest.mark.parametrize("heavy", [audit.HEAVY, 20])
def test_every_order_against_plain_python(spark, monkeypatch, heavy):
    """``heavy``: texts go by broadcast, or, with few copies, by the join."""
    monkeypatch.setattr(audit, "HEAVY", heavy)
    docs, labels = corpus()
    found = audit.audit(audit.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)), "ABCDE")
    assert sorted(map(tuple, found.collect())) == brute(docs, labels)


def test_states_run_once_and_are_released(spark):
    rows = spark.createDataFrame([("p", True, False, False, False, False), ("p", False, True, False, False, False), ("p", False, False, True, False, False)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    counts = audit.walk(rows, "ABC")
    assert sorted(r.state for r in counts.select('state').collect()) == ['', 'A', 'AB', 'AC', 'B', 'BC', 'C']  # no row where none is left: A, B and C
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_other_filters_and_few_rows(spark):
    kind = "part string, X boolean, Y boolean, good boolean, toxic boolean"
    found = audit.audit(spark.createDataFrame([("p", True, True, True, False), ("p", False, True, False, False), ("q", False, False, False, True)], kind), "XY")
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}
    assert rows["p", "XY", 1] == (1, 1, 0, 0, 1, 0, 1) and rows["p", "XY", 2] == (0, 1, 1, 1, 0, 0, 3)
    assert rows["p", "YX", 2] == (0, 0, 1, 0, 0, 0, 1) and rows["q", "YX", 2] == (1, 0, 0, 0, 0, 0, 0) and len(rows) == 8
    with pytest.raises(ValueError):
        audit.audit(spark.createDataFrame([], kind), "XX")


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(audit.judged(docs, labels), "ABCDE").count() == 0
    one = audit.audit(audit.judged(spark.createDataFrame([(1, None, None, "c", 1, "d")], DOCS), labels), "ABCDE")
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120
