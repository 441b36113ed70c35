"""Hashes over the ordered lines of a group, of any size: the hash runs along the rows, no group is collected."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.shipping import ship


def _running(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group columns, digest, lines) for each run of equal groups in a partition sorted by group."""
        group, state, lines, names = None, None, 0, None

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([g], t) for g, t in zip(group, names)], pa.array(["sha256:" + state.hexdigest()]), pa.array([lines], pa.int64())], names=[*[f"g{i}" for i in range(n)], "digest", "lines"])

        for batch in batches:
            names = [batch.schema.field(i).type for i in range(n)]
            columns = [batch.column(i).to_pylist() for i in range(n)]
            for *own, line in zip(*columns, batch.column(n)):
                if group != own:
                    if group is not None:
                        yield row()
                    group, state, lines = own, hashlib.sha256(), 0
                state.update(line.as_py().encode() if line.is_valid else b"")
                lines += 1
        if group is not None:
            yield row()

    return run


def streamed_digest(rows: DataFrame, group: tuple[str, ...], key: tuple[str, ...], line: Column) -> DataFrame:
    """(group, digest, lines): ``sha256:`` and the hash of a group's lines in key order, one after the other; null lines are empty.

    The same as ``ids.ordered_digest``, but a group may exceed what a row holds: its rows are sorted on disk if need be and pass
    through one task, which keeps one hash. A hash of a sequence can't be split, so one group is one task's time.
    """
    ship(rows.sparkSession)
    ordered = rows.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], line.alias("line"))
    own = [f"g{i}" for i in range(len(group))]
    sorted_rows = ordered.repartition(*own).sortWithinPartitions(*own, *[f"k{i}" for i in range(len(key))])
    types = {f.name: f.dataType.simpleString() for f in ordered.schema}
    schema = ", ".join(f"{g} {types[g]}" for g in own) + ", digest string, lines bigint"
    out = sorted_rows.select(*own, "line").mapInArrow(_running(len(own)), schema)
    return out.select(*[F.col(g).alias(c) for g, c in zip(own, group)], "digest", "lines")
