"""What the Python workers hold: nothing of another operator's, and no more than a few MB of rows at once."""

import numpy as np

from threadloom.llm import bpe, common


def test_workers_let_go_of_other_operators_tables(spark):
    docs = spark.range(64).selectExpr("id as doc_id", "'some words of text' as text").repartition(4)
    assert bpe.digests(docs).where("n_tokens > 0").count() == 64

    def run(rows):
        yield (sum(map(len, common.KEPT.values())),)
        yield from ((0,) for _ in rows)

    assert common.map_rows(docs, run, "kept bigint").agg({"kept": "sum"}).first()[0] == 0


def test_numbers_in_lists_weigh_what_they_take(spark):
    assert common.weight(list(range(1000))) == 40_000 and common.weight(np.zeros(1000, np.int64)) == 8_000
    assert common.weight("abc") == common.weight(b"abc") == 3 and common.weight(None) == common.weight(7) == 0
    same = [[], [1, 2], [3, 4], [-5]]

    def run(rows):
        for i, in rows:
            yield i, np.array(same[i], np.int64)

    assert sorted(map(tuple, common.map_rows(spark.range(4), run, "i bigint, a array<bigint>").collect())) == list(enumerate(same))
