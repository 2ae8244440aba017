"""Getting this package to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless workers find it by their path anyway."""
    context = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == ROOT for p in known) or getattr(context, "_trackloom_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp())
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file while it runs
    path = os.path.join(folder, "trackloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((ROOT / "trackloom").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    context.addPyFile(path)
    context._trackloom_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
