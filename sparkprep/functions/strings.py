"""Text functions with Unicode classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..errors import InvalidMethodError


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@pandas_udf(T.StringType())
def title(c: pd.Series) -> pd.Series:
    """A capital after every sign that isn't a letter, which initcap doesn't give."""
    return c.str.title()


OPERATIONS = {
    "strip": strip,
    "lower": F.lower,
    "upper": F.upper,
    "title": title,
    "remove_punctuation": lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""),
    "remove_digits": lambda c: F.regexp_replace(c, r"\p{Nd}+", ""),
    "remove_extra_spaces": lambda c: F.regexp_replace(c, r"(?U)\s+", " "),
}


def clean(c: Column, operations: list[str]) -> Column:
    for name in operations:
        if name not in OPERATIONS:
            raise InvalidMethodError(name, list(OPERATIONS))
        c = OPERATIONS[name](c)
    return c
