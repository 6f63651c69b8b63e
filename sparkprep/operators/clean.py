"""Cleaning: missing values, duplicates, outliers, types, columns, rows and text, with a history of what was done.

A method that fits anything runs one job and returns a lazy frame with the fitted numbers as literals. History holds frames,
not counts: rows are counted when a summary asks for them.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidMethodError, InvalidStrategyError, ValidationError
from ..functions import strings
from ..plans.fused import aggregate, bucket_count, dealt, distinct_counts, draw, exact_quantiles, quantile_bounds
from ..schema import get_string_columns, is_numeric, is_time, kind, number, quoted, validate_columns, validate_numeric_columns
from .base import FeatureEngineeringBase
from .profile import DataAnalyzer

log = logging.getLogger(__name__)
#: Share of removed rows above which a summary warns.
MANY_ROWS = 0.3
STRATEGIES = ["drop", "fill_value", "mean", "median", "mode", "forward_fill", "backward_fill", "interpolate"]
FILLS = ["linear", "nearest", "pad", "zero"]
HISTORY_FORMATS = ["text", "markdown", "json"]


@dataclass
class Operation:
    method: str
    parameters: dict
    before: DataFrame
    after: DataFrame
    at: str = field(default_factory=lambda: datetime.now().isoformat(timespec="seconds"))
    _rows: dict = field(default_factory=dict)

    def shape(self, which: str) -> tuple[int, int]:
        df = getattr(self, which)
        if which not in self._rows:
            self._rows[which] = df.count()
        return self._rows[which], len(df.columns)

    def as_dict(self) -> dict:
        before, after = self.shape("before"), self.shape("after")
        return {
            "timestamp": self.at,
            "method": self.method,
            "parameters": self.parameters,
            "shape_before": before,
            "shape_after": after,
            "rows_changed": after[0] - before[0],
            "columns_changed": after[1] - before[1],
        }


def _list(columns, what: str = "columns") -> list[str]:
    if not isinstance(columns, list):
        raise TypeError(f"{what} must be a list")
    return columns


class DataPreprocessor(FeatureEngineeringBase):
    def __init__(self, df: DataFrame, order_by: str | list[str] | None = None):
        super().__init__(df, order_by)
        self._history: list[Operation] = []

    def _logged(self, method: str, parameters: dict, df: DataFrame, inplace: bool):
        if not inplace:
            return df
        self._history.append(Operation(method, parameters, self.df, df))
        self.df = df
        return self

    # -- missing values

    def handle_missing_values(self, strategy: str = "drop", columns: list[str] | None = None, fill_value=None, method: str = "linear", inplace: bool = False, order_by=None):
        if strategy not in STRATEGIES:
            raise InvalidStrategyError(strategy, STRATEGIES)
        df = self.df
        names = df.columns if columns is None else validate_columns(df, columns)
        if not names:
            return self._done(df, inplace)
        if strategy == "drop":
            out = df.dropna(subset=names)
        elif strategy == "fill_value":
            if fill_value is None:
                raise ValueError("fill_value is needed")
            out = df.withColumns({c: _filled(df, c, fill_value) for c in names})
        elif strategy in ("mean", "median"):
            names = [c for c in names if is_numeric(kind(df, c))]
            x = {c: number(df, c) for c in names}
            if strategy == "mean":
                got = aggregate(df, {(c,): F.avg(v) for c, v in x.items()}) if names else {}
            else:
                got = {(c,): q[0] for (c, _), q in exact_quantiles(df, x, [0.5]).items()} if names else {}
            out = df.withColumns({c: F.coalesce(number(df, c), F.lit(got[c,])) for c in names if got[c,] is not None})
        elif strategy == "mode":
            got = aggregate(df, {(c,): F.mode(quoted(c), True) for c in names})
            out = df.withColumns({c: F.coalesce(quoted(c), F.lit(got[c,]).cast(kind(df, c))) for c in names if got[c,] is not None})
        elif strategy == "interpolate":
            out = self._interpolated(names, method, order_by)
        else:
            sides = self._neighbours(names, order_by)
            side = "before" if strategy == "forward_fill" else "after"
            out = sides.withColumns({c: F.col(f"_{side}{i}") for i, c in enumerate(names)}).select(*map(quoted, df.columns))
        return self._logged("handle_missing_values", {"strategy": strategy, "columns": names}, out, inplace)

    def _interpolated(self, names: list[str], method: str, order_by) -> DataFrame:
        """By position, not by the distance of keys; leading nulls stay, trailing ones take the last value."""
        if method not in FILLS:
            raise InvalidMethodError(method, FILLS)
        df = self.df
        names = [c for c in names if is_numeric(kind(df, c))]
        rows = self._neighbours(names, order_by)
        new = {}
        for i, c in enumerate(names):
            v, nxt = F.col(f"_before{i}").cast("double"), F.col(f"_after{i}").cast("double")
            p, q, at = F.col(f"_before_at{i}"), F.col(f"_after_at{i}"), F.col("_at")
            if method == "linear":
                between = v + (nxt - v) * (at - p) / (q - p)
            elif method == "nearest":
                between = F.when(at - p <= q - at, v).otherwise(nxt)
            else:
                between = v
            new[c] = F.when(number(df, c).isNotNull(), number(df, c)).when(q.isNull(), v).when(v.isNotNull(), between)
        return rows.withColumns(new).select(*map(quoted, df.columns))

    def _neighbours(self, names: list[str], order_by) -> DataFrame:
        """The frame with _at (the row's place) and, for each column i, _before{i}, _after{i}: the values at or next to the row,
        and where they are.

        Rows are dealt to ranges of the first order column by approximate quantiles, and each range is a window of its own; what
        carries over from one range to the next is a row for each range. So no task sees all rows, unless the column is text.
        """
        df, order = self.df, self._ordered(order_by)
        if not names:
            return df
        first = ([order_by] if isinstance(order_by, str) else list(order_by or self.order_by))[0]
        key, t = quoted(first), kind(df, first)
        if is_numeric(t) or is_time(t):
            bounds = quantile_bounds(df, key, min(256, 4 * bucket_count(self.spark)))  # hashed to partitions, several even out
            rows = dealt(df, "_bucket", key, bounds).withColumn("_bucket", F.when(key.isNull(), len(bounds) + 1).otherwise(F.col("_bucket")))
        else:
            log.warning("rows ordered by %r, which is no number or time, are handled in one task", first)
            rows = df.withColumn("_bucket", F.lit(0))
        w = Window.partitionBy("_bucket").orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        pairs = [F.when(quoted(c).isNotNull(), F.struct(F.col("_row").alias("r"), quoted(c).alias("v"))) for c in names]
        # Only a range's rows up to the first known value of each column and from the last one on are sorted for what carries over.
        known = [F.when(quoted(c).isNotNull(), key) for c in names]
        ranges = rows.groupBy("_bucket").agg(F.count("*").alias("_n"), F.array_max(F.array(*map(F.min, known))).alias("_head"), F.array_min(F.array(*map(F.max, known))).alias("_tail"))
        ends = rows.join(F.broadcast(ranges), "_bucket").filter(F.col("_head").isNull() | key.isNull() | (key <= F.col("_head")) | (key >= F.col("_tail")))
        sums = ends.withColumn("_row", F.row_number().over(w)).groupBy("_bucket").agg(
            F.first("_n").alias("_n"),
            (F.first("_n") - F.count("*")).alias("_left"),
            *(F.max_by(p, F.when(p.isNotNull(), F.col("_row"))).alias(f"_last{i}") for i, p in enumerate(pairs)),
            *(F.min_by(p, F.when(p.isNotNull(), F.col("_row"))).alias(f"_first{i}") for i, p in enumerate(pairs)),
        )
        # a row for each range
        above = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        below = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_start", F.coalesce(F.sum("_n").over(above), F.lit(0)))
        place = {"last": F.col("_start") + F.col("_left"), "first": F.col("_start")}  # a last value comes after the rows left out
        sums = sums.withColumns({f"_{k}{i}": F.when(F.col(f"_{k}{i}").isNotNull(), F.struct((F.col(f"_{k}{i}.r") + x).alias("r"), F.col(f"_{k}{i}.v").alias("v"))) for k, x in place.items() for i in range(len(names))})
        carried = {f"_c{i}": F.last(f"_last{i}", True).over(above) for i in range(len(names))} | {f"_d{i}": F.last(f"_first{i}", True).over(below) for i in range(len(names))}
        sums = sums.select("_bucket", "_start", *(v.alias(k) for k, v in carried.items()))
        # The next value by lead in the window that the rows are sorted for: one sort, and one pass where a frame up to an unbounded following end takes many.
        rows = rows.withColumn("_row", F.row_number().over(w)).withColumns({f"_p{i}": p for i, p in enumerate(pairs)})
        rows = rows.withColumns({f"_b{i}": F.last(f"_p{i}", True).over(upto) for i in range(len(names))} | {f"_a{i}": F.coalesce(F.col(f"_p{i}"), F.expr(f"lead(_p{i}) IGNORE NULLS").over(w)) for i in range(len(names))})
        rows = rows.join(F.broadcast(sums), "_bucket").withColumn("_at", F.col("_row") + F.col("_start"))  # 258 ranges at most
        new = {}
        for i in range(len(names)):
            for name, own, far in (("before", f"_b{i}", f"_c{i}"), ("after", f"_a{i}", f"_d{i}")):
                new[f"_{name}{i}"] = F.coalesce(F.col(f"{own}.v"), F.col(f"{far}.v"))
                new[f"_{name}_at{i}"] = F.coalesce(F.col(f"{own}.r") + F.col("_start"), F.col(f"{far}.r"))
        return rows.withColumns(new)

    def create_missing_indicators(self, columns: list[str], suffix: str = "_was_missing", inplace: bool = False):
        names = validate_columns(self.df, columns)
        out = self.df.withColumns({c + suffix: quoted(c).isNull().cast("int") for c in names})
        return self._logged("create_missing_indicators", {"columns": names, "suffix": suffix}, out, inplace)

    # -- rows

    def remove_duplicates(self, subset: list[str] | None = None, keep="first", inplace: bool = False, order_by=None):
        """Without an order, ``first`` keeps any one of equal rows. Nulls are equal."""
        if keep not in ("first", "last", False):
            raise ValueError("keep is 'first', 'last' or False")
        df = self.df
        names = (validate_columns(df, subset) if subset else []) or df.columns
        # Aggregates, which tasks combine before the shuffle, rather than windows: a hot key is a row of each task.
        whole = F.struct(*map(quoted, df.columns))
        groups = df.groupBy(*(quoted(c).alias(f"_g{i}") for i, c in enumerate(names)))
        order = [order_by] if isinstance(order_by, str) else order_by or self.order_by
        if keep is False:
            out = groups.agg(F.first(whole).alias("_row"), F.count("*").alias("_n")).filter("_n = 1").select("_row.*")
        elif not order:
            if keep == "last":
                self._ordered(order_by)
            out = df.dropDuplicates(names)
        elif keep == "first":
            place = F.struct(*(x for c in order for x in (quoted(c).isNull(), quoted(c))))
            out = groups.agg(F.min_by(whole, place).alias("_row")).select("_row.*")
        else:
            place = F.struct(*(x for c in order for x in (quoted(c).isNotNull(), quoted(c))))
            out = groups.agg(F.max_by(whole, place).alias("_row")).select("_row.*")
        return self._logged("remove_duplicates", {"subset": subset, "keep": keep}, out, inplace)

    def filter_rows(self, condition, inplace: bool = False):
        """condition: a Column, SQL text, or a function of the frame that gives a Column. Nulls drop the row."""
        made = condition(self.df) if callable(condition) and not isinstance(condition, Column) else condition
        if not isinstance(made, (Column, str)):
            raise TypeError("a condition is a Column, SQL text, or a function that gives a Column")
        return self._logged("filter_rows", {"condition": str(made)}, self.df.filter(made), inplace)

    def sample_data(self, n: int | None = None, frac: float | None = None, random_state: int | None = None, inplace: bool = False):
        """Exactly n rows, or the rounded share of them, without replacement; one row if neither is given.

        With a seed and a unique ``order_by`` the rows are drawn by a hash of both, so they are the same whatever the partitions.
        """
        if n is not None and frac is not None:
            raise ValueError("give n or frac, not both")
        if n is not None and n <= 0 or frac is not None and not 0 < frac <= 1:
            raise ValueError("n is above 0 and frac in (0, 1]")
        total = self.df.count()
        k = round(frac * total) if frac is not None else n or 1
        if k > total:
            raise ValidationError(f"{k} rows of {total} can't be sampled")
        out = draw(self.df, k, total, random_state, self.order_by if random_state is not None else [])
        return self._logged("sample_data", {"n": n, "frac": frac, "random_state": random_state}, out, inplace)

    # -- outliers

    def handle_outliers(self, columns: list[str], method: str = "iqr", action: str = "remove", multiplier: float = 1.5, threshold: float = 3.0, replace_with: str = "median", inplace: bool = False):
        """Bounds come from one job over the input, so the columns don't affect each other. cap and replace give doubles."""
        if method not in ("iqr", "zscore"):
            raise InvalidMethodError(method, ["iqr", "zscore"])
        if action not in ("remove", "cap", "replace"):
            raise InvalidMethodError(action, ["remove", "cap", "replace"])
        if replace_with not in ("median", "mean", "nan"):
            raise ValidationError("replace_with is 'median', 'mean' or 'nan'")
        if multiplier <= 0 or threshold <= 0:
            raise ValueError("multiplier and threshold are above 0")
        df = self.df
        names = validate_numeric_columns(df, _list(columns))
        analyzer = DataAnalyzer(df)
        flags = analyzer.outlier_flags(names, method, multiplier if method == "iqr" else threshold, action == "replace" and replace_with == "median")
        if action == "remove":
            if not flags:
                return self._logged("handle_outliers", {"columns": names}, df, inplace)
            bad = reduce(lambda a, b: a | b, (f.flag for f in flags.values()))
            out = df.filter(~F.coalesce(bad, F.lit(False)))
        else:
            new = {}
            for c, f in flags.items():
                x = number(df, c)
                if action == "cap":
                    value = F.when(x < f.low, f.low).when(x > f.high, f.high).otherwise(x)
                else:
                    other = {"median": f.median, "mean": f.mean, "nan": None}[replace_with]
                    value = F.when(f.flag, F.lit(other).cast("double")).otherwise(x)
                new[c] = value
            out = df.withColumns(new)
        return self._logged("handle_outliers", {"columns": names, "method": method, "action": action}, out, inplace)

    def clip_values(self, column: str, lower: float | None = None, upper: float | None = None, inplace: bool = False):
        if lower is not None and upper is not None and lower >= upper:
            raise ValueError("lower must be below upper")
        if not validate_columns(self.df, column):
            return self._done(self.df, inplace)
        whole = all(b is None or float(b).is_integer() for b in (lower, upper)) and is_numeric(kind(self.df, column))
        x = quoted(column) if whole else number(self.df, column)
        value = x
        if upper is not None:
            value = F.when(x > upper, F.lit(upper)).otherwise(value)
        if lower is not None:
            value = F.when(x < lower, F.lit(lower)).otherwise(value)
        out = self.df.withColumn(column, value.cast(kind(self.df, column)) if whole else value)
        return self._logged("clip_values", {"column": column, "lower": lower, "upper": upper}, out, inplace)

    # -- columns

    def drop_columns(self, columns: list[str], inplace: bool = False):
        names = validate_columns(self.df, _list(columns))
        return self._logged("drop_columns", {"columns": names}, self.df.drop(*names), inplace)

    def rename_columns(self, rename_map: dict[str, str], inplace: bool = False):
        if not isinstance(rename_map, dict):
            raise TypeError("rename_map must be a dict")
        return self._logged("rename_columns", {"rename_map": rename_map}, self.df.withColumnsRenamed(rename_map), inplace)

    def reorder_columns(self, column_order: list[str], inplace: bool = False):
        first = validate_columns(self.df, _list(column_order, "column_order"))
        out = self.df.select(*map(quoted, first + [c for c in self.df.columns if c not in first]))
        return self._logged("reorder_columns", {"column_order": column_order}, out, inplace)

    def convert_dtypes(self, dtype_map: dict[str, str], inplace: bool = False):
        """A column with a value that can't be converted is left as it is. One job tests them all."""
        df = self.df
        names = validate_columns(df, list(dtype_map))
        made = {c: _converted(df, c, dtype_map[c]) for c in names}
        lost = aggregate(df, {(c,): F.sum((quoted(c).isNotNull() & made[c].isNull()).cast("int")) for c in names}) if names else {}
        for c in names:
            if lost[c,]:
                log.error("%d values of %r can't become %s; it is left as it is", lost[c,], c, dtype_map[c])
        out = df.withColumns({c: made[c] for c in names if not lost[c,]})
        return self._logged("convert_dtypes", {"dtype_map": dtype_map}, out, inplace)

    def apply_custom_function(self, column: str, func: Callable, new_column: str | None = None, inplace: bool = False, return_type=None):
        """func: from Column to Column; or from a value to a value, if return_type is given (a vectorised Python function then)."""
        if not callable(func):
            raise TypeError("func must be callable")
        if not validate_columns(self.df, column):
            return self._done(self.df, inplace)
        if return_type is None:
            value = func(quoted(column))
            if not isinstance(value, Column):
                raise TypeError("func must give a Column, or return_type be given")
        else:
            value = F.pandas_udf(lambda s: s.map(func, na_action="ignore"), return_type)(quoted(column))
        out = self.df.withColumn(new_column or column, value)
        return self._logged("apply_custom_function", {"column": column, "new_column": new_column}, out, inplace)

    def reset_index_clean(self, inplace: bool = False):
        """Frames have no index: nothing to do."""
        return self._logged("reset_index_clean", {}, self.df, inplace)

    def remove_constant_columns(self, inplace: bool = False):
        """Columns with one value or none: least and greatest agree, so no distinct count is needed."""
        df = self.df
        fit = [c for c in df.columns if not isinstance(kind(df, c), (T.MapType, T.ArrayType, T.StructType))]
        got = aggregate(df, {(c, k): f(quoted(c)) for c in fit for k, f in (("min", F.min), ("max", F.max))})
        names = [c for c in fit if got[c, "min"] == got[c, "max"]]
        return self._logged("remove_constant_columns", {"removed": names}, df.drop(*names), inplace)

    def remove_high_cardinality_columns(self, threshold: float = 0.95, inplace: bool = False, approximate: bool = False):
        if not 0 < threshold <= 1:
            raise ValueError("threshold is in (0, 1]")
        n = self.df.count()
        counts = distinct_counts(self.df, self.df.columns, approximate) if n else {}
        names = [c for c, k in counts.items() if k / n >= threshold]
        return self._logged("remove_high_cardinality_columns", {"removed": names}, self.df.drop(*names), inplace)

    # -- text

    def clean_string_columns(self, columns: list[str], operations: list[str] | None = None, inplace: bool = False):
        operations = ["strip", "lower"] if operations is None else _list(operations, "operations")
        for name in operations:
            if name not in strings.OPERATIONS:
                raise InvalidMethodError(name, list(strings.OPERATIONS))
        names = get_string_columns(self.df, _list(columns))
        out = self.df.withColumns({c: strings.clean(quoted(c), operations) for c in names})
        return self._logged("clean_string_columns", {"columns": names, "operations": operations}, out, inplace)

    def handle_whitespace_variants(self, columns: list[str], inplace: bool = False):
        names = get_string_columns(self.df, _list(columns))
        out = self.df.withColumns({c: strings.clean(quoted(c), ["strip", "remove_extra_spaces"]) for c in names})
        return self._logged("handle_whitespace_variants", {"columns": names}, out, inplace)

    def extract_string_length(self, columns: list[str], suffix: str = "_length", inplace: bool = False):
        names = get_string_columns(self.df, _list(columns))
        out = self.df.withColumns({c + suffix: F.length(quoted(c)) for c in names})
        return self._logged("extract_string_length", {"columns": names}, out, inplace)

    # -- checks

    def detect_infinite_values(self, columns: list[str] | None = None) -> dict[str, int]:
        names = [c for c in validate_numeric_columns(self.df, columns) if isinstance(kind(self.df, c), (T.DoubleType, T.FloatType))]
        got = aggregate(self.df, {(c,): F.sum((F.abs(quoted(c)) == float("inf")).cast("int")) for c in names}) if names else {}
        return {c: got[c,] for c in names if got[c,]}

    def validate_data_quality(self) -> dict:
        df = self.df
        n = df.count()
        missing = aggregate(df, {(c,): F.count(F.when(quoted(c).isNull(), 1)) for c in df.columns})
        unique = distinct_counts(df, df.columns)
        found = {
            "shape": (n, len(df.columns)),
            "missing_values": {c: {"count": missing[c,], "percent": 100 * missing[c,] / n if n else 0.0} for c in df.columns if missing[c,]},
            "duplicate_rows": DataAnalyzer(df).duplicate_rows(),
            "constant_columns": [c for c in df.columns if unique[c] <= 1],
            "high_cardinality_columns": [c for c in df.columns if n > 10 and unique[c] / n > 0.95],
            "infinite_values": self.detect_infinite_values(),
        }
        said = {
            "missing_values": "columns with missing values",
            "duplicate_rows": "duplicate rows",
            "constant_columns": "constant columns",
            "high_cardinality_columns": "columns of very many values",
            "infinite_values": "columns with infinite values",
        }
        size = lambda v: v if isinstance(v, int) else len(v)
        return found | {"issues_found": [f"{size(found[k])} {text}" for k, text in said.items() if size(found[k])]}

    # -- history

    def history(self) -> list[dict]:
        return [op.as_dict() for op in self._history]

    def get_preprocessing_summary(self) -> str:
        if not self._history:
            return "No operations yet."
        lines = ["Preprocessing", "=" * 13]
        for i, op in enumerate(self.history(), 1):
            (r0, c0), (r1, c1) = op["shape_before"], op["shape_after"]
            lines.append(f"{i}. {op['timestamp']} {op['method']}: {r0} x {c0} -> {r1} x {c1}")
            lines += [f"     {k} = {v}" for k, v in op["parameters"].items()]
            if r0 and (r0 - r1) / r0 > MANY_ROWS:
                lines.append(f"     warning: {100 * (r0 - r1) / r0:.1f}% of the rows were removed")
        return "\n".join(lines)

    def export_summary(self, filepath: str, format: str = "text") -> None:  # noqa: A002
        if format not in HISTORY_FORMATS:
            raise ValueError(f"format is one of {HISTORY_FORMATS}")
        if not self._history:
            raise ValidationError("there is no history to export")
        if format == "json":
            text = json.dumps(self.history(), indent=2, default=str)
        elif format == "markdown":
            rows = [f"| {i} | {o['method']} | {o['parameters']} | {o['shape_before']} | {o['shape_after']} |" for i, o in enumerate(self.history(), 1)]
            text = "\n".join(["# Preprocessing", "", "| # | method | parameters | before | after |", "|-|-|-|-|-|", *rows])
        else:
            text = self.get_preprocessing_summary()
        with open(filepath, "w", encoding="utf-8") as f:
            f.write(text + "\n")


def _filled(df: DataFrame, c: str, value) -> Column:
    """Nulls replaced; a value of another type widens the column rather than being cast to it."""
    t = kind(df, c)
    if isinstance(value, bool) or isinstance(value, str) or not is_numeric(t):
        same = isinstance(value, str) == isinstance(t, T.StringType)
        return F.coalesce(quoted(c), F.lit(value)) if same else F.coalesce(quoted(c).cast("string"), F.lit(str(value)))
    whole = isinstance(value, int) or float(value).is_integer()
    if whole or isinstance(t, (T.DoubleType, T.FloatType)):
        return F.coalesce(quoted(c), F.lit(value).cast(t))
    return F.coalesce(quoted(c).cast("double"), F.lit(float(value)))


_TYPES = {"int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double", "float32": "float", "str": "string", "object": "string", "bool": "boolean", "category": "string"}


def _converted(df: DataFrame, c: str, to: str) -> Column:
    if to == "datetime":
        return F.try_to_timestamp(quoted(c).cast("string"))
    return quoted(c).try_cast(_TYPES.get(str(to), str(to)))


