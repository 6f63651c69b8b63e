"""Feature creation. Fitted numbers are plain data: saved as JSON, and applied to other frames by ``transform``."""

from __future__ import annotations

import itertools
import json
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConstantColumnError, EmptyDataFrameError, InvalidMethodError, InvalidStrategyError, TransformerNotFittedError, ValidationError
from ..functions import dates
from ..plans.fused import aggregate, exact_quantiles, moments
from ..schema import is_time, kind, number, quoted, validate_columns, validate_numeric_columns
from .base import FeatureEngineeringBase

log = logging.getLogger(__name__)
SCALERS = ["standard", "minmax", "robust"]
PARTS = ["year", "month", "day", "dayofweek", "hour", "minute", "quarter"]
MANY = 100  # dummy columns above which a warning is logged
LABELS = 1_000_000  # different values that an encoder holds
MAP_AT_MOST = 1000  # labels that become a literal map; more are joined


def _labels(df: DataFrame, column: str) -> list[str]:
    """The sorted different values as text, without nulls. A fitted encoder holds them all, so there may be ``LABELS`` at most."""
    rows = df.select(quoted(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
    got = [r["v"] for r in rows.limit(LABELS + 1).collect()]
    if len(got) > LABELS:
        raise ValidationError(f"{column!r} has more than {LABELS} different values; an encoder can't hold them")
    return sorted(got)


class FeatureEngineer(FeatureEngineeringBase):
    def __init__(self, df: DataFrame, order_by=None):
        super().__init__(df, order_by)
        self.encoders: dict[str, dict] = {}
        self.scalers: dict[str, dict] = {}

    # -- encoders

    def encode_categorical_label(self, columns: list[str], inplace: bool = False):
        """Ranks of the values as text, from 0; nulls stay null."""
        df = self.df
        for c in validate_columns(df, columns):
            fitted = {"kind": "label", "column": c, "classes": _labels(df, c)}
            self.encoders[f"{c}_label"] = fitted
            df = apply(df, fitted)
        return self._done(df, inplace)

    def encode_categorical_onehot(self, columns: list[str], drop_first: bool = False, prefix: str | None = None, dummy_na: bool = False, inplace: bool = False):
        """Columns {prefix}_{value} of 0 and 1 at the end, in place of the source."""
        df = self.df
        for c in validate_columns(df, columns):
            labels = _labels(df, c)
            if len(labels) > MANY:
                log.warning("%d new columns for %r", len(labels), c)
            fitted = {"kind": "onehot", "column": c, "prefix": prefix or c, "classes": labels[1:] if drop_first else labels, "nulls": dummy_na}
            self.encoders[f"{c}_onehot"] = fitted
            df = apply(df, fitted)
        return self._done(df, inplace)

    def encode_categorical_ordinal(self, column: str, categories: list, inplace: bool = False):
        """The place in the list as double; -1 for anything else, null included."""
        if not isinstance(categories, list):
            raise TypeError("categories must be a list")
        if not categories:
            raise ValueError("categories is empty")
        if not validate_columns(self.df, column):
            return self._done(self.df, inplace)
        fitted = {"kind": "ordinal", "column": column, "classes": [str(c) for c in categories]}
        self.encoders[f"{column}_ordinal"] = fitted
        return self._done(apply(self.df, fitted), inplace)

    def scale_features(self, columns: list[str], method: str = "standard", inplace: bool = False):
        """(x - center) / scale: mean and population deviation, least and range, or median and quartile range."""
        if method not in SCALERS:
            raise InvalidMethodError(method, SCALERS)
        names = validate_numeric_columns(self.df, columns)
        if not names:
            return self._done(self.df, inplace)
        got = moments(self.df, names, (0.25, 0.5, 0.75) if method == "robust" else (), parts=["count", "mean", "var_pop", "min", "max"])
        if not any(m["count"] for m in got.values()) and self.df.isEmpty():
            raise EmptyDataFrameError
        fitted = {"kind": "scale", "columns": {}}
        for c, m in got.items():
            if not m["count"]:
                center, scale = 0.0, 1.0
            elif method == "standard":
                center, scale = m["mean"], m["var_pop"] ** 0.5
            elif method == "minmax":
                center, scale = m["min"], m["max"] - m["min"]
            else:
                center, scale = m["q"][1], m["q"][2] - m["q"][0]
            fitted["columns"][c] = [float(center), float(scale) or 1.0]
        self.scalers[f"{method}_scaler"] = fitted
        return self._done(apply(self.df, fitted), inplace)

    # -- arithmetic

    def create_polynomial_features(self, columns: list[str], degree: int = 2, interaction_only: bool = False, inplace: bool = False):
        if degree not in (2, 3):
            raise ValueError("degree is 2 or 3")
        names = validate_numeric_columns(self.df, columns)
        x = {c: number(self.df, c) for c in names}
        new: dict[str, Column] = {}
        if not interaction_only:
            for c in names:
                new[f"{c}_squared"] = x[c] * x[c]
                if degree == 3:
                    new[f"{c}_cubed"] = x[c] * x[c] * x[c]
        if degree == 2:
            new |= {f"{a}_x_{b}": x[a] * x[b] for a, b in itertools.combinations(names, 2)}
        elif interaction_only:
            if len(names) < 3:
                log.warning("products of three need three columns")
            new |= {f"{a}_x_{b}_x_{c}": x[a] * x[b] * x[c] for a, b, c in itertools.combinations(names, 3)}
        return self._done(self.df.withColumns(new), inplace)

    def create_log_transform(self, columns: list[str], inplace: bool = False):
        """ln(x), shifted by |min| + 1 where the least value isn't above 0."""
        names = validate_numeric_columns(self.df, columns)
        least = aggregate(self.df, {(c,): F.min(number(self.df, c)) for c in names}) if names else {}
        shift = {c: abs(v) + 1 if (v := least[c,]) is not None and v <= 0 else 0.0 for c in names}
        return self._done(self.df.withColumns({f"{c}_log": F.log(number(self.df, c) + shift[c]) for c in names}), inplace)

    def create_sqrt_transform(self, columns: list[str], inplace: bool = False):
        names = validate_numeric_columns(self.df, columns)
        least = aggregate(self.df, {(c,): F.min(number(self.df, c)) for c in names}) if names else {}
        for c in names:
            if least[c,] is not None and least[c,] < 0:
                log.warning("column %r has negative values; it is skipped", c)
        return self._done(self.df.withColumns({f"{c}_sqrt": F.sqrt(number(self.df, c)) for c in names if least[c,] is None or least[c,] >= 0}), inplace)

    def create_ratio_features(self, numerator: str, denominator: str, name: str | None = None, epsilon: float = 1e-8, inplace: bool = False):
        if len(validate_columns(self.df, [numerator, denominator])) < 2:
            return self._done(self.df, inplace)
        n, d = number(self.df, numerator), number(self.df, denominator) + epsilon
        unlimited = F.when(n > 0, float("inf")).when(n < 0, float("-inf"))
        value = F.when(d == 0, unlimited).otherwise(F.try_divide(n, d))
        return self._done(self.df.withColumn(name or f"{numerator}_to_{denominator}_ratio", value), inplace)

    def create_flag_features(self, column: str, condition, flag_name: str | None = None, inplace: bool = False):
        """condition: a value to equal, or a function from Column to a condition. Null gives 0."""
        if not validate_columns(self.df, column):
            return self._done(self.df, inplace)
        met = condition(quoted(column)) if callable(condition) else quoted(column) == F.lit(condition)
        return self._done(self.df.withColumn(flag_name or f"{column}_flag", F.coalesce(met.cast("int"), F.lit(0))), inplace)

    # -- bins

    def create_binning(self, column: str, bins=5, labels: list | None = None, strategy: str = "quantile", inplace: bool = False):
        """{column}_binned: intervals closed on the right; the first one has its lower end in quantile bins.

        bins: a number, or the edges, in which case the strategy doesn't count.
        """
        if strategy not in ("quantile", "uniform"):
            raise InvalidStrategyError(strategy, ["quantile", "uniform"])
        if not validate_columns(self.df, column):
            return self._done(self.df, inplace)
        x, lowest = number(self.df, column), False
        if isinstance(bins, (list, tuple)):
            edges = [float(b) for b in bins]
        elif strategy == "quantile":
            got = exact_quantiles(self.df, {column: x}, [i / bins for i in range(bins + 1)])[column, None]
            edges, lowest = sorted({q for q in got if q is not None}), True
            if len(edges) < 2:
                raise ConstantColumnError(column)
        else:
            low, high = self.df.agg(F.min(x), F.max(x)).first()
            if low is None:
                return self._done(self.df.withColumn(f"{column}_binned", F.lit(None).cast("string")), inplace)
            if low == high:
                pad = 0.001 * abs(low) or 0.001
                low, high = low - pad, high + pad
                edges = [low + (high - low) * i / bins for i in range(bins + 1)]
            else:
                edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
                edges[0] -= 0.001 * (high - low)
        if labels is not None and len(labels) != len(edges) - 1:
            raise ValueError(f"{len(edges) - 1} bins need as many labels, not {len(labels)}")
        names = list(labels) if labels is not None else [f"({a:.6g}, {b:.6g}]" for a, b in itertools.pairwise(edges)]
        fitted = {"kind": "bins", "column": column, "edges": edges, "labels": names, "lowest": lowest}
        self.encoders[f"{column}_binned"] = fitted
        return self._done(apply(self.df, fitted), inplace)

    # -- dates

    def create_datetime_features(self, column: str, features: list[str] | None = None, inplace: bool = False):
        """A column of text is parsed in place; if a value can't be, nothing changes. Unknown features are ignored."""
        if not validate_columns(self.df, column):
            return self._done(self.df, inplace)
        df = self.df
        if not is_time(kind(df, column)):
            parsed = F.try_to_timestamp(quoted(column).cast("string"))
            if df.filter(quoted(column).isNotNull() & parsed.isNull()).limit(1).count():
                log.error("column %r can't be read as times", column)
                return self._done(df, inplace)
            df = df.withColumn(column, parsed)
        wanted = [f for f in features or PARTS if f in dates.PARTS]
        return self._done(df.withColumns({f"{column}_{f}": dates.PARTS[f](quoted(column)) for f in wanted}), inplace)

    # -- groups

    def create_aggregations(self, group_by: str | list[str], agg_column: str, agg_funcs: list[str] | None = None, inplace: bool = False):
        """{agg_column}_{groups}_{func} on each row; null for a null group.

        Sums by group are map-side combined and joined back, so a hot group is one row on the side that is built.
        """
        groups = validate_columns(self.df, group_by)
        if not groups or not validate_numeric_columns(self.df, [agg_column]):
            return self._done(self.df, inplace)
        x = number(self.df, agg_column)
        stem = f"{agg_column}_{'_'.join(groups)}"
        known, ordered = {}, {}
        for f in agg_funcs or ["mean", "sum", "std", "min", "max"]:
            if f in AGGREGATES:
                known[f"{stem}_{f}"] = AGGREGATES[f](x)
            elif f in RUNNING:
                ordered[f"{stem}_{f}"] = RUNNING[f]
            else:
                log.warning("no aggregate %r; it is skipped", f)
        df = self.df
        if ordered:
            w = Window.partitionBy(*map(quoted, groups))
            some = ~_any_null(groups)
            for name, make in ordered.items():
                order = w.orderBy(x.asc_nulls_last()) if name.endswith("_rank") else w.orderBy(*self._ordered())
                df = df.withColumn(name, F.when(some, make(x, order, w)))
        if known:
            sums = df.groupBy(*map(quoted, groups)).agg(*(v.alias(k) for k, v in known.items()))
            df = df.join(sums, groups, "left").select(*map(quoted, [*df.columns, *known]))
        return self._done(df, inplace)

    # -- saving

    def fitted(self) -> dict:
        return {"encoders": self.encoders, "scalers": self.scalers}

    def save_transformers(self, filepath: str) -> None:
        if not self.encoders and not self.scalers:
            raise TransformerNotFittedError
        with open(filepath, "w", encoding="utf-8") as f:
            json.dump(self.fitted(), f, indent=1)

    def load_transformers(self, filepath: str) -> None:
        with open(filepath, encoding="utf-8") as f:
            found = json.load(f)
        self.encoders, self.scalers = found["encoders"], found["scalers"]

    def transform(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Another frame, streaming ones too, through what has been fitted here."""
        every = self.encoders | self.scalers
        for name in names or list(every):
            df = apply(df, every[name])
        return df


def _any_null(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | quoted(c).isNull()
    return out


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "median": lambda x: F.percentile(x, 0.5),
    "count": F.count,
    "size": lambda x: F.count(F.lit(1)),
    "nunique": F.count_distinct,
}
RUNNING: dict[str, Callable] = {
    "first": lambda x, o, w: F.first(x, True).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    "last": lambda x, o, w: F.last(x, True).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    "cumsum": lambda x, o, w: F.when(x.isNotNull(), F.sum(x).over(o.rowsBetween(Window.unboundedPreceding, 0))),
    "cumcount": lambda x, o, w: F.row_number().over(o) - 1,
    "rank": lambda x, o, w: F.when(x.isNotNull(), F.rank().over(o) + (F.count(x).over(o.rangeBetween(0, 0)) - 1) / F.lit(2.0)),
}


def apply(df: DataFrame, fitted: dict) -> DataFrame:
    """``df`` through one fitted transformer: projections with literals only."""
    how = fitted["kind"]
    if how == "scale":
        return df.withColumns({c: (number(df, c) - m) / s for c, (m, s) in fitted["columns"].items()})
    column = fitted["column"]
    text = quoted(column).cast("string")
    if how == "label":
        places = [(v, i) for i, v in enumerate(fitted["classes"])]
        if len(places) > MAP_AT_MOST and not df.isStreaming:
            table = df.sparkSession.createDataFrame(places, "_value string, _place int")
            joined = df.withColumn("_value", text).join(table, "_value", "left")
            return joined.withColumn(column, F.col("_place")).select(*map(quoted, df.columns))
        if not places:
            return df.withColumn(column, F.lit(None).cast("int"))
        return df.withColumn(column, F.create_map(*(F.lit(x) for p in places for x in p))[text])
    if how == "ordinal":
        value = F.lit(-1.0)
        for i, v in enumerate(fitted["classes"]):
            value = F.when(text == v, float(i)).otherwise(value)
        return df.withColumn(column, value)
    if how == "onehot":
        new = {f"{fitted['prefix']}_{v}": text.eqNullSafe(v).cast("int") for v in fitted["classes"]}
        if fitted["nulls"]:
            new[f"{fitted['prefix']}_nan"] = quoted(column).isNull().cast("int")
        return df.withColumns(new).drop(column)
    if how == "bins":
        x, edges = number(df, column), fitted["edges"]
        value = F.lit(None).cast("string")
        for i in range(len(edges) - 2, -1, -1):
            above = x >= edges[i] if i == 0 and fitted["lowest"] else x > edges[i]
            value = F.when(above & (x <= edges[i + 1]), F.lit(str(fitted["labels"][i]))).otherwise(value)
        return df.withColumn(f"{column}_binned", value)
    raise ValueError(f"no transformer of kind {how!r}")


