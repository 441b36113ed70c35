"""Gets this package to the Python workers of a cluster that doesn't have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application: they needn't have it installed."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped or not package.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="threadloom-ship-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / f"{package.name}.zip", "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(folder / f"{package.name}.zip"))
    _shipped.add(sc.applicationId)
