"""Toxicity as severity: a cumulative-link (proportional-odds) regression on sparse counts of words and word pairs.

Grades 0..K are ordered; P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all grades and ascending
thresholds t_1 < ... < t_K. The expected severity is the sum of these K probabilities.

Training takes at most ``MAX_LABELLED`` labelled rows, those of least hash of their id: a documented bound. Features are all
words and pairs of neighbouring words that tell the labels apart (in at least ``MIN_TOXIC`` texts labelled toxic, and found there
more or less often than chance explains, |z| of at least ``MIN_Z``), however many these are. A feature's value is log(1 + its
count in the whole text).

Labels of more than two grades are taken as they are. Labels of 0 and 1 are graded: 0 for 0; a text labelled 1 gets a grade from 1 to
``GRADES`` by how many words it holds that tell the labels apart, with cuts at equal shares of the texts labelled 1. The rows
are in two halves (by the id's hash), and a text is graded by the words of the other half, so that no row has a say
in its own grade. From what the halves' models say of each other's rows comes the probability from which a text is
flagged as well: halfway between the neighbours where the F1 score is greatest.

Every document is scored, whole. Null and empty texts score as texts without features. Labels that are null, or
of ids without a text, count for nothing; without any text labelled above 0, or without any labelled 0, all scores are 0.
Repeated label or document rows count repeatedly; ids may be null; other columns don't matter; empty tables give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

MAX_LABELLED = 20_000
MIN_Z, MIN_TOXIC = 4.0, 3
GRADES = 3
PENALTY = 1e-3
STEPS = 400

WORD = re.compile(r"[^\W\d_]+")


def word_list(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(words: list[str]) -> list[str]:
    """The words and the pairs of neighbouring ones."""
    return words + list(map(" ".join, zip(words, words[1:])))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Weights shared by all grades, and the ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a row for each score."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds)

    @classmethod
    def fit(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int) -> Ordinal:
        """Full-batch Adam on the cumulative log likelihood: deterministic, no random start.

        Thresholds are a first one plus sums of exponentials, so they ascend whatever the steps.
        """
        n = max(1, len(grades))
        w, base, gaps = np.zeros(n_features), 2.0, np.zeros(n_grades - 1)
        moments = [np.zeros(n_features + n_grades) for _ in range(2)]
        for step in range(1, STEPS + 1):
            thresholds = base + np.r_[0.0, np.cumsum(np.exp(gaps))]
            score = np.bincount(rows, values * w[columns], minlength=len(grades)) if len(rows) else np.zeros(len(grades))
            edge = np.c_[np.ones(len(grades)), _sigmoid(score[:, None] - thresholds), np.zeros(len(grades))]
            at = np.arange(len(grades))
            upper, lower = edge[at, grades], edge[at, grades + 1]
            p = np.maximum(upper - lower, 1e-12)
            # the slope of each edge in its argument is q (1 - q); the outer edges are fixed
            slope = edge * (1 - edge)
            d_upper, d_lower = slope[at, grades] / p, slope[at, grades + 1] / p
            d_score = d_upper - d_lower
            d_thresholds = np.zeros(n_grades)
            for k in range(1, n_grades + 1):
                d_thresholds[k - 1] = -(d_upper[grades == k].sum() - d_lower[grades == k - 1].sum())
            g_w = (np.bincount(columns, values * d_score[rows], minlength=n_features) if len(rows) else np.zeros(n_features)) / n - PENALTY * w
            g_gaps = np.array([d_thresholds[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, n_grades)]) / n - PENALTY * gaps
            gradient = np.r_[g_w, d_thresholds.sum() / n, g_gaps]
            moments[0] = 0.9 * moments[0] + 0.1 * gradient
            moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
            move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
            w, base, gaps = w + move[:n_features], base + move[n_features], gaps + move[n_features + 1 :]
        return cls(w, base + np.r_[0.0, np.cumsum(np.exp(gaps))])


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    chosen = cut(chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(MAX_LABELLED))
    # at most MAX_LABELLED small rows, whatever the input
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")


def telling(labelled: DataFrame) -> DataFrame:
    """(gram, z0, z1, z): of each feature in one half or all of the labelled rows, how far its share of toxic texts is from chance;
    null where it is in too few toxic texts. ``labelled``: (_half, _y, _t)."""

    def run(rows):
        for half, y, text in rows:
            yield from ((gram, half, int(y > 0)) for gram in set(grams(word_list(text))))
            yield "", half, int(y > 0)

    pairs = map_rows(labelled.select("_half", "_y", "_t"), run, "gram string, half int, toxic int")
    count = lambda c: F.count_if(c)
    counts = cut(pairs.groupBy("gram").agg(*[count((F.col("half") == h) & (F.col("toxic") == 1)).alias(f"t{h}") for h in (0, 1)], *[count(F.col("half") == h).alias(f"n{h}") for h in (0, 1)]))
    total = counts.where("gram = ''").first()
    sums = {h: (total[f"t{h}"], total[f"n{h}"]) for h in (0, 1)} if total else {0: (0, 0), 1: (0, 0)}

    def z(t, n, toxic, every):
        if not toxic or toxic == every:
            return F.lit(None).cast("double")
        rate = toxic / every
        return F.when(t >= MIN_TOXIC, (t - n * rate) / F.sqrt(n * rate * (1 - rate)))

    own = [z(F.col(f"t{h}"), F.col(f"n{h}"), *sums[h]).alias(f"z{h}") for h in (0, 1)]
    both = z(F.col("t0") + F.col("t1"), F.col("n0") + F.col("n1"), sums[0][0] + sums[1][0], sums[0][1] + sums[1][1]).alias("z")
    return counts.where("gram <> ''").select("gram", *own, both)


def _separator(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability that best tells rows labelled above 0 from the others: halfway between neighbours."""
    order = np.argsort(-p, kind="stable")
    p, toxic = p[order], toxic[order]
    gain = 2 * np.cumsum(toxic) / (np.arange(1, len(p) + 1) + toxic.sum())
    ends = np.flatnonzero(np.r_[p[1:] != p[:-1], True])
    best = ends[np.argmax(gain[ends])]
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2)


@dataclass
class Model:
    """Weights by feature, thresholds of the grades, and the probability of grade 1 or above from which a text is flagged."""

    weights: dict[str, float]
    ordinal: Ordinal
    flag_at: float

    def probabilities(self, text: str | None) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(self.ordinal.thresholds))
        counts: dict[str, int] = {}
        for gram in filter(self.weights.__contains__, grams(word_list(text))):
            counts[gram] = counts.get(gram, 0) + 1
        total = sum(self.weights[gram] * np.log1p(n) for gram, n in sorted(counts.items()))
        return self.ordinal.at_least(np.array([total]))[0]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    labelled = _labelled(docs, labels, doc_id, text, label)
    labelled = cut(labelled.withColumn("_half", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)).cast("int")))
    some = " or ".join(f"abs({c}) >= {MIN_Z}" for c in ("z0", "z1", "z"))
    chosen = telling(labelled).where(some).collect()  # words that tell labels of a bounded sample apart
    place = {r.gram: i for i, r in enumerate(sorted(chosen, key=lambda r: r.gram))}
    z = np.array([[r.z0 or 0, r.z1 or 0, r.z or 0] for r in sorted(chosen, key=lambda r: r.gram)]).reshape(-1, 3)

    def run(rows):
        for half, y, body in rows:
            at, times = np.unique(np.array([place[g] for g in grams(word_list(body)) if g in place], np.int64), return_counts=True)
            yield half, int(y), at.tolist(), times.tolist()

    # a bounded number of rows, each at most a count a feature however long its text
    found = map_rows(labelled.select("_half", "_y", "_t"), run, "half int, y int, at array<int>, times array<bigint>").collect()
    labels_ = np.array([r["y"] for r in found], np.int64)
    half = np.array([r["half"] for r in found], np.int64)
    toxic = (labels_ > 0).astype(np.int64)
    if not len(place) or not toxic.any() or toxic.all():
        return Model({}, Ordinal(np.zeros(0), np.full(GRADES, np.inf)), 1.0)
    rows = np.repeat(np.arange(len(found)), [len(r["at"] or ()) for r in found])
    columns = np.concatenate([np.array(r["at"] or (), np.int64) for r in found])
    times = np.concatenate([np.array(r["times"] or (), np.int64) for r in found])
    if labels_.max() > 1:
        grades = labels_
    else:
        # graded by what the other half knows
        marks = z[columns, 1 - half[rows]] >= MIN_Z
        held = np.bincount(rows, times * marks, minlength=len(found))
        grades = np.where(toxic == 1, 1 + np.searchsorted(np.quantile(held[toxic == 1], np.arange(1, GRADES) / GRADES), held, "left"), 0)
    k = int(grades.max())

    def fit(which: np.ndarray, known: np.ndarray) -> Ordinal:
        """On the rows ``which``, with the features that ``known`` tells."""
        keep = which[rows] & known[columns]
        new = np.cumsum(which) - 1
        return Ordinal.fit(new[rows[keep]], columns[keep], np.log1p(times[keep]), grades[which], len(place), k)

    p = np.zeros(len(found))
    for h in (0, 1):
        if len(set(toxic[half == h].tolist())) == 2:
            model = fit(half == h, np.abs(z[:, h]) >= MIN_Z)
            score = np.bincount(rows, np.log1p(times) * model.weights[columns], minlength=len(found))
            p[half != h] = model.at_least(score[half != h])[:, 0]
    known = np.abs(z[:, 2]) >= MIN_Z
    model = fit(np.ones(len(found), bool), known)
    weights = {g: float(model.weights[i]) for g, i in place.items() if known[i]}
    return Model(weights, model, _separator(p, toxic))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_severity, severity, p_toxic, toxic), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        model = shared.value
        for key, body in rows:
            p = model.probabilities(body)
            flagged = bool(model.weights) and bool(p[0] >= model.flag_at)
            yield key, round(float(p.sum()), 6), max(int(flagged), int((p >= 0.5).sum())), round(float(p[0]), 6), flagged

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_rows(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), run, f"`{doc_id}` {kind}, expected_severity double, severity int, p_toxic double, toxic boolean")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import tables

    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, tables(spark, sf_dir, "labels")))
