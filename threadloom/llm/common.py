"""What the training-data operators share: the shared scratch folder, cutting lineage, words."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scratch import shared_dir
from threadloom.functions.shipping import ship

#: A word is a run of characters outside this set (space, tab, LF, VT, FF, CR).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``cut`` wrote for these frames. Only for frames that nothing evaluated later rests on."""
    for df in frames:
        remove_folder(df.sparkSession, df._cut_path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of ``text``; none where it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker keeps from task to task, a dict for each operator that has something to keep.
KEPT: dict[str, dict] = {}


def let_go(keeps: str | None = None) -> None:
    """Empties what other operators than ``keeps`` have left in this worker: it serves the stages of all of them in turn."""
    if any(held for name, held in KEPT.items() if name != keeps):
        for name, held in KEPT.items():
            if name != keeps:
                held.clear()
        gc.collect()


def weight(value) -> int:
    """Bytes of a value that add up in the worker, about; a number in a list is an object of its own."""
    if isinstance(value, (bytes, str)):
        return len(value)
    return 40 * len(value) if isinstance(value, list) else getattr(value, "nbytes", 0)


def map_rows(df: DataFrame, fn, schema: str, flush_bytes: int = 1 << 22, flush_rows: int = 4096, keeps: str | None = None) -> DataFrame:
    """``fn`` takes an iterator of the rows of a partition as tuples and yields tuples of ``schema``; arrays may be numpy's.

    Batches cross as Arrow; output leaves in pieces of about ``flush_bytes``, and input is turned into
    Python objects a slice at a time, so a run of very long texts doesn't add up in the worker. ``keeps``: see ``let_go``.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def rows(batches):
        for batch in batches:
            step = max(1, min(batch.num_rows, batch.num_rows * (1 << 22) // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield from zip(*[c.to_pylist() for c in batch.slice(at, step).columns])

    def run(batches):
        let_go(keeps)
        out, held = [], 0
        for row in fn(rows(batches)):
            out.append(row)
            held += sum(map(weight, row))
            if held >= flush_bytes or len(out) >= flush_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    ship(df.sparkSession)
    return df.mapInArrow(run, kind)
