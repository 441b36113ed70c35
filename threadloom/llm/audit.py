"""Filter interaction audit: what each of several filters removes, in every order of them.

The orders form a permutation trie; states of it that hold the same filters hold the same rows, whatever the order, so each
unordered prefix is run once and remembered. The walk is depth-first: the survivors of a state are a persisted DataFrame,
from which the removals along all edges out of it are counted and the next states' survivors are filtered; a state is
released when all below it is done, so no more of them are held at once than there are filters.

Every row counts, repeated ones too. A null text is empty, a null part is the empty string. A null id has no label and
is no earlier copy, nor a later one, of anything. An empty table gives no parts, hence no rows. Texts may be of any length: what is
kept of a row are its part and one boolean a filter. Labels of an id that stands in several rows of ``labels`` hold if one of them has them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scratch import fresh

from .common import cut, discard, tables, words

#: Texts with more than one in so many rows of the table go by broadcast: at most this many of them, of 32 bytes.
HEAVY = 10_000
#: Orders grow as the factorial of the filters.
MOST_FILTERS = 8
COUNTS = "part string, state string, n bigint, edges array<struct<filter:string,removed:bigint,good_lost:bigint,toxic_lost:bigint>>"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that look at one text: A too short, B repetitive, C capitals, D symbols. True where the text fails."""
    whole = F.coalesce(text, F.lit(""))
    found = words(text)
    n = F.size(found)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * n,
        "C": 100 * (F.length(whole) - F.length(F.translate(whole, capitals, ""))) > 2 * F.length(whole),
        "D": whole.rlike("[#$%&*|]"),
    }


def mark_copies(rows: DataFrame, digest: str, doc_id: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether a smaller id has the same digest.

    Digests of a large share of the rows are few by definition and go by broadcast, so no task gets all rows of one text.
    """
    total = rows.count()
    first = cut(rows.groupBy(digest).agg(F.min(doc_id).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    heavy = F.broadcast(first.where(F.col("_n") * HEAVY > total).drop("_n"))
    light = first.where(F.col("_n") * HEAVY <= total).drop("_n")
    fails = F.coalesce(F.col(doc_id) > F.col("_first"), F.lit(False)).alias(name)
    many = rows.join(heavy, digest)
    few = rows.join(heavy, digest, "left_anti").join(light, digest, "left")
    return many.select(*rows.columns, fails).union(few.select(*rows.columns, fails))


def _counts(survivors: DataFrame, state: str, rest: list[str]) -> DataFrame:
    """(part, state, n, edges): rows that are left, and per filter not yet applied the removals, good and toxic ones among them."""

    def lost(f: str) -> list[Column]:
        return [F.count_if(F.col(f)), F.count_if(F.col(f) & F.col("good")), F.count_if(F.col(f) & F.col("toxic"))]

    names = ("removed", "good_lost", "toxic_lost")
    sums = [c.alias(f"{f}_{k}") for f in rest for c, k in zip(lost(f), names)]
    edges = [F.struct(F.lit(f).alias("filter"), *[F.col(f"{f}_{k}").alias(k) for k in names]) for f in rest]
    none = COUNTS.rpartition(" ")[2]
    found = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *sums)
    return found.select("part", F.lit(state).alias("state"), "n", (F.array(*edges) if edges else F.array()).cast(none).alias("edges"))


def walk(rows: DataFrame, filters: str) -> DataFrame:
    """The counts of every unordered prefix, each written when its survivors are at hand; ``rows``: part, good, toxic, one boolean a filter."""
    spark, base = rows.sparkSession, fresh(rows.sparkSession, "audit")
    seen: dict[frozenset, str] = {}

    def visit(state: frozenset, survivors: DataFrame) -> None:
        rest = [f for f in filters if f not in state]
        seen[state] = f"{base}/state-{''.join(sorted(state))}"
        counts = _counts(survivors, "".join(sorted(state)), rest).coalesce(1)
        counts.write.parquet(seen[state])
        for f in rest:
            below = state | {f}
            if below in seen:
                continue
            left = survivors.where(~F.col(f)).drop(f).persist(StorageLevel.MEMORY_AND_DISK)
            visit(below, left)
            left.unpersist()

    top = cut(rows)
    top.persist(StorageLevel.MEMORY_AND_DISK)
    visit(frozenset(), top)
    top.unpersist()
    discard(top)
    return spark.read.schema(COUNTS).parquet(*seen.values())


def orders(spark: SparkSession, filters: str) -> DataFrame:
    """(filter_order, step, filter, before, after): every step of every order; as many rows as filters * their factorial."""
    rows = [("".join(p), k + 1, f, "".join(sorted(p[:k])), "".join(sorted(p[: k + 1]))) for p in permutations(filters) for k, f in enumerate(p)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before string, after string")


def audit(rows: DataFrame, filters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders of ``filters``.

    ``rows`` holds a string ``part``, booleans ``good`` and ``toxic``, and per filter, named by one letter, a boolean that is true where the
    row fails; booleans aren't null. A part without survivors still has all its rows, as zeros.
    """
    if len(filters) > MOST_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"at most {MOST_FILTERS} different filters")
    spark, found = rows.sparkSession, walk(rows, filters)
    parts = found.where("state = ''").select("part")
    zero = [F.lit(0).cast("long").alias(k) for k in ("removed", "good_lost", "toxic_lost")]
    steps = orders(spark, filters)
    # each part has every edge and every state, at zero where nothing was left
    pairs = sorted({(r.before, r.filter) for r in steps.select("before", "filter").distinct().collect()})
    every = parts.select("part", F.explode(F.array(*[F.lit(f"{b}/{f}") for b, f in pairs])).alias("edge"))
    every = every.select("part", F.substring_index("edge", "/", 1).alias("before"), F.substring_index("edge", "/", -1).alias("filter"), *zero)
    real = found.select("part", F.col("state").alias("before"), F.inline("edges"))
    edges = real.unionByName(every).groupBy("part", "before", "filter").agg(*[F.sum(k).alias(k) for k in ("removed", "good_lost", "toxic_lost")])
    n = len(filters)
    done = F.length("before")
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), done + 1)
    by_filter = edges.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * times).cast("long").alias("shapley"), F.sum(F.when(done == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(done == n - 1, F.col("removed"))).alias("unique_fails"),
    )
    left = found.select("part", F.col("state").alias("after"), F.col("n").alias("kept"))
    out = edges.join(F.broadcast(steps), ["before", "filter"]).join(left, ["part", "after"], "left").join(by_filter, ["part", "filter"])
    return out.select(
        "part", "filter_order", "step", F.coalesce("kept", F.lit(0)).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What ``audit`` takes, for the five filters A to E over documents; E: an identical text has a smaller id."""
    whole = F.col(f"`{text}`")
    sight = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(whole, F.lit("")), 256)).alias("digest"), *[c.alias(f) for f, c in text_failures(whole).items()],
    )
    rows = mark_copies(cut(sight), "digest", "id", "E").drop("digest")
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(known, "id", "left")
    return rows.select("part", *"ABCDE", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(judged(docs, tables(spark, sf_dir, "labels")), "ABCDE")


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r]+')"
OP13_SQL = f"""
WITH sight AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, {_WORDS} AS words FROM documents
), firsts AS (SELECT body, min(doc_id) AS first FROM sight GROUP BY body
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN sight.doc_id > first THEN 'E' ELSE '' END AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM sight JOIN firsts USING (body) LEFT JOIN known ON sight.doc_id = known.doc_id
), cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails
), orders (filter_order) AS (VALUES {_ORDERS}
), steps AS (
  SELECT filter_order, s::INTEGER AS step, substr(filter_order, s, 1) AS f, substr(filter_order, 1, s - 1) AS before FROM orders, range(1, 6) AS t(s)
), met AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS sole,
    length(translate(fails, before, '')) = length(fails) AS here
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN here AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND NOT here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN sole THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
