"""Puts this package within reach of the Python workers when their path lacks it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Once per context: send the package to the executors, unless they start in its folder or have it on PYTHONPATH."""
    context = spark.sparkContext
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(context, "_orgatlas_shipped", False) or str(ROOT) in map(os.path.realpath, filter(None, paths)):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / "orgatlas.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for source in sorted((ROOT / "orgatlas").rglob("*.py")):
            packed.write(source, source.relative_to(ROOT))
    context.addPyFile(str(target))
    context._orgatlas_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
