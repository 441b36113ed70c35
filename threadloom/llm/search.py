"""Ranked lexical search: the best documents for each of a set of queries, by WAND over shards of documents.

A task turns its documents, a run of ``SHARD_POSTINGS`` postings after the other, into a shard: posting lists by term in
document order, the impact of every posting, and each term's maximum impact in the shard. Per query the shard is gone through
a range of documents at a time. Terms whose maximum impacts together stay below the heap's threshold (its least score once
it is full) can't lift a document over it alone: their lists propose nothing. The lists of the other terms propose documents, and
those are pivots whose terms' maximum impacts together reach the threshold; all others are skipped unscored. Pivots get
their exact score and go into the heap, which raises the threshold for the next range. Ranges are arrays, so a pivot isn't
chosen by moving one cursor at a time, but by adding maximum impacts at the places of the lists.

A task keeps one heap a query over all its shards, and puts it out at its end: at most ``top`` rows a query and task. Heaps are merged by
rank, first within groups of tasks, then over these. The statistics (documents, words, documents of a term) are counted over
all documents first, from the same postings, which are written once.

Scores are whole numbers of 64 bits; as a query's terms count once, equal scores are common, and go by ascending id, null last. Queries come in
blocks of bounded size; each block's terms, all that is broadcast, is bounded with it. A null text has no terms; documents without terms
count nowhere and are never found, queries without terms find nothing, and an empty table gives no rows. Rows of equal ids are each a
document; rows of equal query ids are each a query. A text's length is bounded by Spark's row only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.shipping import ship

from .common import cut, discard, map_rows, tables

TOP = 50
#: Postings of a shard: about 60 MB.
SHARD_POSTINGS = 1 << 21
#: Documents of a shard's first range; each further range has twice as many.
RANGE = 256
#: Queries and characters of a block.
BLOCK_QUERIES, BLOCK_CHARS = 5_000, 1 << 26
#: Groups of tasks whose heaps are merged first.
GROUPS = 32

#: All bytes but 0-9, A-Z, a-z and those of characters beyond ASCII become blanks, A-Z lower case.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_FOLD).split(b" ")


def counted(text: str | None) -> tuple[Counter, int]:
    """How often each term occurs, and the number of terms with repeats."""
    found = Counter(terms(text))
    del found[b""]
    return found, found.total()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, term, tf) for each document with terms: its length, and which terms of the vocabulary it holds how often."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(rows):
        place = known.value.get
        for key, body in rows:
            found, n = counted(body)
            if n:
                own = sorted((t, k) for w, k in found.items() if (t := place(w)) is not None)
                yield key, n, [t for t, _ in own], [k for _, k in own]

    ready = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return map_rows(ready, run, "doc_id bigint, n bigint, term array<int>, tf array<int>", flush_rows=1024)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Heap:
    """The best documents so far of one query, in order, and the score that the next one must reach."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)
        self.threshold = 1

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = np.r_[self.score, score], np.r_[self.doc, doc], np.r_[self.none, none]
        order = np.lexsort((doc, none, -score))[: self.top]
        self.score, self.doc, self.none = score[order], doc[order], none[order]
        if len(self.score) == self.top:
            self.threshold = max(1, int(self.score[-1]))


class Shard:
    """Posting lists of a run of documents: ``start[t] : start[t + 1]`` are the places of term ``t``."""

    def __init__(self, doc: np.ndarray, none: np.ndarray, n: np.ndarray, per_doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, stats: tuple[int, int]):
        n_docs, n_words = stats
        self.doc, self.none = doc, none
        own = np.repeat(np.arange(len(doc)), per_doc)
        order = np.argsort(term, kind="stable")
        self.own, term, tf = own[order], term[order], tf[order].astype(np.int64)
        length = 50 + (50 * n * n_docs) // n_words
        self.impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[self.own]))
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, self.start[held])

    def search(self, query: np.ndarray, heap: Heap) -> None:
        """Puts the documents of this shard that belong there into the heap of ``query``, its terms."""
        own = query[self.most[query] > 0]
        own = own[np.argsort(self.most[own], kind="stable")]
        most = self.most[own]
        reach = np.cumsum(most)  # what the first lists can give together
        if not len(own) or reach[-1] < heap.threshold:
            return
        lists = [(self.own[self.start[t] : self.start[t + 1]], self.impact[self.start[t] : self.start[t + 1]]) for t in own.tolist()]
        low, width = 0, RANGE
        while low < len(self.doc):
            high = min(len(self.doc), low + width)
            quiet = int(np.searchsorted(reach, heap.threshold))  # lists below can't reach the threshold together
            if quiet == len(own):
                return
            self._range(lists, most.tolist(), quiet, int(reach[quiet - 1]) if quiet else 0, low, high, heap)
            low, width = high, 2 * width

    def _range(self, lists, most: list[int], quiet: int, rest: int, low: int, high: int, heap: Heap) -> None:
        parts = [(p[a:b], s[a:b]) for p, s in lists for a, b in (np.searchsorted(p, (low, high)),)]
        bound, score = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
        for (p, s), u in zip(parts[quiet:], most[quiet:]):
            bound[p - low] += u
            score[p - low] += s
        pivots = np.flatnonzero((bound > 0) & (bound + rest >= heap.threshold))
        # the quiet lists, largest first, are only looked at where a pivot needs them; what they turn out to give replaces their bound
        exact = score[pivots]
        left = rest
        for (p, s), u in zip(parts[:quiet][::-1], most[:quiet][::-1]):
            if not len(pivots):
                return
            left -= u
            if len(p):
                at = np.minimum(np.searchsorted(p, pivots + low), len(p) - 1)
                exact += np.where(p[at] == pivots + low, s[at], 0)
            stay = exact + left >= heap.threshold
            pivots, exact = pivots[stay], exact[stay]
        good = exact >= heap.threshold
        if good.any():
            at = pivots[good] + low
            heap.add(exact[good], self.doc[at], self.none[at])


def _heaps(index: DataFrame, queries: list[np.ndarray], weight: np.ndarray, stats: tuple[int, int], top: int, shard_postings: int) -> DataFrame:
    """(query, doc_id, score): the heaps of every task."""
    import pyarrow as pa

    ship(index.sparkSession)
    sent = index.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches):
        queries, weight = sent.value
        heaps = [Heap(top) for _ in queries]
        held: list[tuple] = []
        size = 0

        def search() -> None:
            shard = Shard(*(np.concatenate(c) for c in zip(*held)), weight, stats)
            held.clear()
            for q, h in zip(queries, heaps):
                shard.search(q, h)

        for whole in batches:
            step = max(1, min(whole.num_rows, whole.num_rows * (1 << 24) // max(1, whole.nbytes)))
            for first in range(0, whole.num_rows, step):
                b = whole.slice(first, step)
                key, n, term, tf = b.columns
                doc = key.fill_null(0).to_numpy(zero_copy_only=False)
                per_doc = np.array(term.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                held.append((np.array(doc), np.array(key.is_null().to_numpy(zero_copy_only=False)), np.array(n), per_doc, np.array(term.flatten()), np.array(tf.flatten())))
                size += int(per_doc.sum()) + len(per_doc)
                if size >= shard_postings:
                    search()
                    size = 0
        if held:
            search()
        for q, h in enumerate(heaps):
            if len(h.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h.score), q, np.int32)), pa.array(h.doc, pa.int64(), mask=h.none), pa.array(h.score)], names=["query", "doc_id", "score"]
                )

    return index.mapInArrow(run, "query int, doc_id bigint, score bigint")


def _block(docs: DataFrame, block: list[tuple], id_type: str, doc_id: str, text: str, top: int, shard_postings: int) -> DataFrame | None:
    spark = docs.sparkSession
    wanted = [sorted(counted(body)[0]) for _, body in block]
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*wanted)))}
    index = cut(postings(docs, vocabulary, doc_id, text))
    n_docs, n_words = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        discard(index)
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for t, k in index.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():
        df[t] = k
    queries = [np.array([vocabulary[w] for w in own], np.int64) for own in wanted]
    found = _heaps(index, queries, weights(df, n_docs), (n_docs, n_words), top, shard_postings).withColumn("group", F.spark_partition_id() % GROUPS)

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    ranked = best(best(found, "query", "group").drop("rank"), "query").drop("group")
    names = spark.createDataFrame([(k, key) for k, (key, _) in enumerate(block)], f"query int, item_id {id_type}")
    ranked = cut(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    discard(index)
    return ranked


def rank(
    docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query: str = "text",
    top: int = TOP, shard_postings: int = SHARD_POSTINGS, block_queries: int = BLOCK_QUERIES, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each query with a score above 0. ``doc_id`` is a whole number."""
    kind = queries.schema[query_id].dataType.simpleString()
    out: list[DataFrame] = []
    block: list[tuple] = []
    chars = 0

    def close() -> None:
        nonlocal chars
        if block and (found := _block(docs, block, kind, doc_id, text, top, shard_postings)) is not None:
            out.append(found)
        block.clear()
        chars = 0

    for key, body in queries.select(F.col(f"`{query_id}`"), F.col(f"`{query}`")).toLocalIterator():
        block.append((key, body))
        chars += len(body or "")
        if len(block) >= block_queries or chars >= block_chars:
            close()
    close()
    if not out:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(tables(spark, sf_dir, "documents").select("doc_id", "text"), tables(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL
), sizes AS (SELECT doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), stats AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM sizes
), items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL
), held AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term
), weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), stats
), impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))) AS impact FROM held JOIN sizes USING (doc_id) JOIN weighed USING (term), stats
), scored AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM items JOIN impacts USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
