"""Reading and writing files; folders are named as Spark names them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """With a header. Without a schema, types are inferred by one more scan."""
    reader = spark.read.options(header=True, **options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, **options) -> None:
    df.write.options(header=True, **options).csv(path)
