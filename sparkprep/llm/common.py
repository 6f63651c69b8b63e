"""Shared helpers: the scratch folder that all executors see, and small column expressions."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import shared_dir

#: ASCII white space, as the contracts' word pattern has it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and lost executors lose nothing."""
    path = f"{_tables(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more, and has Spark drop the shuffle files of plans that are gone.

    What was made of them must be written by now, as lost tasks could not read them again. Spark frees shuffle files when the driver's
    collector finds their plans unused, which without this call may be long after.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    for t in tables:
        path(t._scratch).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(t._scratch), True)
    spark._jvm.System.gc()


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables"


def clear(spark: SparkSession) -> None:
    """Deletes the tables that ``cut`` wrote in this application; for when no frame that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(_tables(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path(f"{_tables(spark)}/{spark.sparkContext.applicationId}"), True)
    if files.exists(path(_tables(spark))) and not list(files.listStatus(path(_tables(spark)))):
        files.delete(path(_tables(spark)), False)


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package however the driver found it; clusters use --py-files."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if (root := str(Path(__file__).resolve().parents[2])) not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(names: Iterable[str], others: Iterable[str]) -> list[str]:
    """The names that Spark wouldn't take for one of the others: it doesn't tell upper from lower case."""
    taken = {c.lower() for c in others}
    return [c for c in names if c.lower() not in taken]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
