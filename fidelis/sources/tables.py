"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table in any format that Spark reads: parquet, orc, csv, json and others."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] = (), mode: str = "error") -> None:
    """Writes a result; `by` splits it into folders by column values."""
    df.write.format(kind).mode(mode).partitionBy(*by).save(path)
