"""Sessions for this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def share_code(spark: SparkSession) -> SparkSession:
    """Lets this session's Python workers import the package from where the driver has it.

    For a package that runs from a source folder; where it is installed on the executors
    (or sent with --py-files) this changes nothing.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *paths])
    return spark
