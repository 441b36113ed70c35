"""Values carried along the lines of a file, whole files at a time or, where a file comes in ranges, range by range.

Rows hold ``path`` and ``line_index``. Without a ``segment`` column a file is one window. With one (numbers that ascend along the file) each
segment is a window of its own, and what goes in from the segments before it comes from a table of one row a segment: no task
gets a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("path", "segment")


def segmented(rows: DataFrame) -> bool:
    return "segment" in rows.columns


def _own(rows: DataFrame, *order: str) -> Window:
    keys = KEY if segmented(rows) else KEY[:1]
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before() -> Window:
    return Window.partitionBy("path").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, values: dict[str, Column], order: tuple[str, ...] = ("line_index",)) -> DataFrame:
    """``rows`` with, per name, the last value that isn't null among the row and those before it in its file."""
    own = _own(rows, *order)
    if not segmented(rows):
        return rows.withColumns({k: F.last_value(v, True).over(own) for k, v in values.items()})
    rows = rows.withColumns({f"_set_{k}": v for k, v in values.items()})
    last = [F.max_by(f"_set_{k}", F.when(F.col(f"_set_{k}").isNotNull(), F.struct(*order))).alias(k) for k in values]
    bases = rows.groupBy(*KEY).agg(*last).select(*KEY, *[F.last_value(k, True).over(_before()).alias(f"_base_{k}") for k in values])
    out = rows.join(bases, list(KEY), "left")
    out = out.withColumns({k: F.coalesce(F.last_value(f"_set_{k}", True).over(own), F.col(f"_base_{k}")) for k in values})
    return out.drop(*[f"_{p}_{k}" for p in ("set", "base") for k in values])


def counted(rows: DataFrame, name: str, hit: Column) -> DataFrame:
    """``rows`` with the number of hits among the row and those before it in its file."""
    own = _own(rows, "line_index")
    if not segmented(rows):
        return rows.withColumn(name, F.sum(hit.cast("long")).over(own))
    bases = rows.groupBy(*KEY).agg(F.count_if(hit).alias("n")).select(*KEY, F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("_base"))
    return rows.join(bases, list(KEY), "left").withColumn(name, F.sum(hit.cast("long")).over(own) + F.col("_base")).drop("_base")


def first_of_file(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with the first value of their file that isn't null."""
    if not segmented(rows):
        whole = Window.partitionBy("path").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return rows.withColumn(name, F.first_value(value, True).over(whole))
    whole = Window.partitionBy("path").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_value", value)
    first = rows.groupBy(*KEY).agg(F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("line_index"))).alias("f"))
    return rows.join(first.select(*KEY, F.first_value("f", True).over(whole).alias(name)), list(KEY), "left").drop("_value")


def previous(rows: DataFrame, name: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``value`` of the row before in the file, null for a file's first row; ``value`` isn't null."""
    if not segmented(rows):
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy("path").orderBy(*order)))
    own = Window.partitionBy(*KEY).orderBy(*order)
    last = rows.groupBy(*KEY).agg(F.max_by(value, F.struct(*order)).alias("l"))
    bases = last.select(*KEY, F.last_value("l", True).over(_before()).alias("_base"))
    return rows.join(bases, list(KEY), "left").withColumn(name, F.coalesce(F.lag(value).over(own), F.col("_base"))).drop("_base")
