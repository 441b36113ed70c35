"""Mixing sources to target weights along a curriculum whose source weights change over training.

Each source has a weight schedule over training time 0..1, piecewise linear between equally spaced
knots. Its integral, scaled to the source's target, is the source's cumulative demand in words. The
documents of a source stand in a fixed pseudo-random order; a copy that begins after ``offset`` words
of its source is due when the cumulative demand reaches ``offset``, so inverting the demand gives its
training position, and a range sort by position gives the training order.

Prefix sums over a source never pass through one task: documents fall into hash buckets, bucket sums
are prefix-summed per source (a table of sources x buckets), and only documents of one bucket of one
source meet in a window. A source with a third of all rows is spread over all its buckets, and so are rows
without id, by their texts; rows equal in id and text share a bucket. Only tables of one row a source, or a source and
bucket, are ever put in one order or sent to all workers; the latter up to ``BROADCAST_BUCKETS`` rows, else joined.

Null texts have size 0; a null source is a source of its own, last. Rows with equal digests, ids and sizes are
interchangeable. An empty table gives no rows. A total size of 0 gives targets of 0. Columns of the input, by
whatever names, only come back inside the struct ``kept``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

CYCLE = (5, 2, 1)
SHARE_NUM, SHARE_DEN = 3, 2  # words shared out, as a multiple of all sizes
MAX_EPOCHS = 2
#: Relative weight at equally spaced knots over training time, by the source's place in the cycle.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Hex digits of a row's digest that name a bucket.
BUCKET_DIGITS = 3
BROADCAST_BUCKETS = 500_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, place, target) from (src, source_size), one row a source.

    Water filling: a source capped at ``MAX_EPOCHS`` times its size gives its excess to the others by
    weight. With sources in order of cap / weight, the level is the first quotient of what is left
    and the weight that is left that does not pass the next source's cap. Quotients only fall from there on, so
    the first is the greatest of those that pass no cap.
    """
    by_name = Window.orderBy(F.col("src").isNull(), F.col("src"))
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(float(x)) for x in CYCLE])
    s = sizes.withColumn("place", (F.row_number().over(by_name) - 1) % len(CYCLE))
    s = s.withColumn("weight", F.get(cycle, F.col("place"))).withColumn("cap", (MAX_EPOCHS * F.col("source_size")).cast("double"))
    s = s.withColumn("wanted", F.sum("source_size").over(every) * SHARE_NUM / F.lit(float(SHARE_DEN)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("ratio", "weight", F.col("src").isNull(), "src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("settled", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    target = F.least(F.coalesce(F.col("settled"), F.col("ratio")) * F.col("weight"), F.col("cap"))
    return s.select("src", "source_size", F.col("place").cast("int").alias("place"), target.alias("target"))


def demand_inverse(place: Column, share: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """Training time at which a source has asked for ``share`` (0..1) of its target."""
    found = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        parts = len(knots) - 1
        areas = [(a + b) / 2.0 / parts for a, b in zip(knots, knots[1:])]
        total = sum(areas)
        time = F.lit(1.0)
        for i in reversed(range(parts)):
            a, slope = float(knots[i]), (knots[i + 1] - knots[i]) * float(parts)
            want = share * F.lit(total) - F.lit(sum(areas[:i]))
            # the area after time x of this part is a x + slope x^2 / 2
            x = want / a if slope == 0 else (F.sqrt(F.lit(a * a) + F.lit(2.0 * slope) * want) - F.lit(a)) / F.lit(slope)
            time = F.when(share * F.lit(total) <= F.lit(sum(areas[: i + 1])), F.lit(i / parts) + x).otherwise(time)
        found = F.when(place == k, time).otherwise(found)
    return found


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = (), broadcast_buckets: int = BROADCAST_BUCKETS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, positions), one row per document, and ``kept``, a struct of the
    columns ``keep``, if there are any. ``positions`` are the training times of its copies (``array<double>``, empty if it has none).

    A document's place in its source comes from the MD5 of its id (of its text, if it has no id). The copies of epoch e cover the words
    from e times the source's size on; the mix takes the words whose offset lies below the target, so
    only the last document of a source is cut, and the words taken differ from the target by less than one.
    """
    key, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    rows = docs.select(
        key.alias("doc_id"), F.col(f"`{source}`").alias("src"), F.size(words(body)).cast("long").alias("size"),
        F.md5(F.coalesce(key.cast("string"), body, F.lit(""))).alias("h"), *kept,
    ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = source_targets(sums.groupBy("src").agg(F.sum("bucket_size").alias("source_size")))
    order = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "bucket", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)).alias("bucket_start"))
    placed = cut(starts.alias("b").join(goal.alias("g"), F.expr("b.src <=> g.src")).select(
        F.col("b.src").alias("p_src"), F.col("bucket").alias("p_bucket"), "bucket_start", "source_size", "place", "target"
    ))
    if placed.count() <= broadcast_buckets:
        placed = F.broadcast(placed)
    within = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(placed, F.expr("src <=> p_src and bucket = p_bucket"))
    start = F.col("bucket_start") + F.col("before")
    words_taken = F.floor("target").cast("long")
    offsets = [start + e * F.col("source_size") for e in range(MAX_EPOCHS)]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), words_taken - o)) for o in offsets]
    times = F.array(*[F.when(t > 0, demand_inverse(F.col("place"), o / F.col("target"))) for o, t in zip(offsets, takes)])
    return rows.select(
        "doc_id", "size", "source_size", "target", sum(takes, F.lit(0)).cast("long").alias("taken"), F.array_compact(times).alias("positions"), *(["kept"] if keep else [])
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by position: ``epoch`` 0.. and the ``copy_words`` it contributes."""
    copies = mixed.select("*", F.posexplode("positions").alias("epoch", "position")).drop("positions")
    share = F.greatest(F.lit(0), F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    return copies.withColumn("copy_words", share).orderBy("position", "doc_id", "epoch")


def in_order(mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position), one row per row of ``mixed``, read back from the copies in training order.

    ``taken`` is the sum of what a row's copies contribute, ``position`` that of its first one (null without copies).
    """
    rows = cut(mixed.withColumn("row", F.monotonically_increasing_id()))
    copies = cut(training_order(rows).select("row", "position", "copy_words"))
    found = copies.groupBy("row").agg(F.sum("copy_words").alias("words"), F.min("position").alias("position"))
    return rows.join(found, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0).cast("long")).alias("taken"), "position")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """One row per document: the words the mix takes of it and when its first copy is due."""
    from .common import tables

    return in_order(mix(tables(spark, sf_dir, "documents").select("doc_id", "text", "source")))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS place FROM d GROUP BY source
), c AS (
  SELECT *, [5.0, 2.0, 1.0][place + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap,
    (sum(source_size) OVER () * 3)::DOUBLE / 2.0::DOUBLE AS wanted FROM s
), r AS (
  SELECT *, cap / weight AS ratio FROM c
), l AS (
  SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY ratio, weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ratio, weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT *, least(coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), ratio) * weight, cap) AS target FROM l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS first, greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS second,
    start / target AS y FROM o
)
SELECT doc_id, size, source_size, target, (first + second)::BIGINT AS taken,
  CASE WHEN first > 0 THEN CASE place
    WHEN 0 THEN 0.0::DOUBLE + (sqrt(2.25::DOUBLE + -2.0::DOUBLE * (y * 1.0::DOUBLE - 0.0::DOUBLE)) - 1.5::DOUBLE) / -1.0::DOUBLE
    WHEN 1 THEN 0.0::DOUBLE + (y * 1.0::DOUBLE - 0.0::DOUBLE) / 1.0::DOUBLE
    ELSE 0.0::DOUBLE + (sqrt(0.25::DOUBLE + 2.0::DOUBLE * (y * 1.0::DOUBLE - 0.0::DOUBLE)) - 0.5::DOUBLE) / 1.0::DOUBLE END END AS position
FROM k
"""
