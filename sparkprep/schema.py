"""What a column is, from the schema alone, and which columns a call means."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ColumnNotFoundError

log = logging.getLogger("sparkprep")
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_numeric(t: T.DataType) -> bool:
    """Numbers; booleans are none."""
    return isinstance(t, T.NumericType)


def is_number_like(t: T.DataType) -> bool:
    """Numbers and booleans."""
    return isinstance(t, (T.NumericType, T.BooleanType))


def is_string(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_whole(t: T.DataType) -> bool:
    return isinstance(t, WHOLE)


def check_frame(df) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")
    return df


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns: a missing value is one thing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(quoted(c), F.lit(None)) for c in floats}) if floats else df


def quoted(column: str) -> Column:
    return F.col(f"`{column.replace('`', '``')}`")


def number(df: DataFrame, column: str) -> Column:
    """The column as double; booleans are 0 and 1."""
    c = quoted(column)
    return (c.cast("int") if isinstance(kind(df, column), T.BooleanType) else c).cast("double")


def validate_columns(df: DataFrame, columns: str | list[str], raise_on_missing: bool = False) -> list[str]:
    """The columns that exist, in the given order; others are logged, or the first one raised."""
    columns = [columns] if isinstance(columns, str) else columns
    if not isinstance(columns, list):
        raise TypeError("columns must be a name or a list of names")
    missing = [c for c in columns if c not in df.columns]
    if missing and raise_on_missing:
        raise ColumnNotFoundError(missing[0], df.columns)
    for c in missing:
        log.warning("no column %r; it is skipped", c)
    return [c for c in columns if c in df.columns]


def _chosen(df: DataFrame, columns: list[str] | None, fits, what: str) -> list[str]:
    if columns is None:
        return [f.name for f in df.schema if fits(f.dataType)]
    out = []
    for c in validate_columns(df, columns):
        if fits(kind(df, c)):
            out.append(c)
        else:
            log.warning("column %r is not %s; it is skipped", c, what)
    return out


def get_numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return _chosen(df, columns, is_numeric, "numeric")


def validate_numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return _chosen(df, columns, is_number_like, "numeric")


def get_string_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return _chosen(df, columns, is_string, "text")


def get_feature_columns(df: DataFrame, exclude: str | list[str] | None = None, numeric_only: bool = True) -> list[str]:
    exclude = [exclude] if isinstance(exclude, str) else list(exclude or [])
    validate_columns(df, exclude)
    return [f.name for f in df.schema if f.name not in exclude and (is_numeric(f.dataType) or not numeric_only)]
