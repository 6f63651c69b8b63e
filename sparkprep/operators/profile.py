"""Profiles of a frame without a target."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidMethodError
from ..functions import statistics as st
from ..plans import fused
from ..plans.fused import aggregate, distinct_counts, moments, small
from ..schema import get_numeric_columns, get_string_columns, is_whole, kind, number, quoted
from .base import FeatureEngineeringBase

log = logging.getLogger(__name__)


@dataclass
class Outliers:
    """The bounds of a column and the condition of being outside; null values are never outliers."""

    flag: Column
    low: float
    high: float
    mean: float
    median: float | None
    count: int = 0


class DataAnalyzer(FeatureEngineeringBase):
    def duplicate_rows(self) -> int:
        """Rows beyond the first of each group of equal ones."""
        rows = self.df.groupBy(*map(quoted, self.df.columns)).agg(F.count("*").alias("_n"))
        return rows.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]

    def estimated_mb(self) -> float:
        """The optimizer's estimate of the frame's size."""
        stats = self.df._jdf.queryExecution().optimizedPlan().stats()
        return float(str(stats.sizeInBytes())) / 1e6

    def get_basic_info(self) -> dict:
        return {
            "shape": (self.df.count(), len(self.df.columns)),
            "columns": self.df.columns,
            "dtypes": dict(self.df.dtypes),
            "memory_usage_mb": self.estimated_mb(),
            "duplicates": self.duplicate_rows(),
        }

    def check_normality(self, column: str, method: str = "shapiro", alpha: float = 0.05) -> dict:
        """As ``statistics.check_normality``: all rows by their moments or ranks, but for Shapiro's test, which is made for 5000."""
        if method not in st.NORMALITY:
            raise ValueError(f"method is one of {st.NORMALITY}")
        if method == "shapiro":
            n, x = self.df.agg(F.count(number(self.df, column))).first()[0], fused.sample(self.df, column, st.SHAPIRO_ROWS)
            return st.check_normality(x, method, alpha) | {"n": n}
        x = number(self.df, column)
        n, mean, std, g1, g2 = self.df.agg(F.count(x), F.avg(x), F.stddev_samp(x), F.skewness(x), F.kurtosis(x)).first()
        if n < (8 if method == "normaltest" else 3):
            return st.check_normality([], method, alpha) | {"n": n}
        extra = {}
        if method == "normaltest":
            stat, p = st.normaltest_from(n, g1, g2) if std else (math.nan, 1.0)
        else:
            stat, p, extra["critical_value"] = st.anderson_from(n, fused.anderson_sum(self.df, column, mean, std)) if std else (math.nan, 1.0, math.nan)
        return {"is_normal": bool(p > alpha), "statistic": stat, "p_value": p, "method": method, "n": n} | extra

    def get_missing_summary(self) -> DataFrame:
        """(column, missing_count, missing_percent) of columns that miss any, most first."""
        names = self.df.columns
        got = aggregate(self.df, {(c,): F.count(F.when(quoted(c).isNull(), 1)) for c in names} | {("rows",) * 2: F.count("*")})
        n = got[("rows",) * 2]
        rows = [(c, got[c,], 100.0 * got[c,] / n) for c in names if got[c,]]
        return small(self.spark, sorted(rows, key=lambda r: (-r[2], r[0])), "column string, missing_count long, missing_percent double")

    def get_numeric_summary(self, percentiles: list[float] | None = None, approximate: bool = False) -> DataFrame:
        """count, mean, std, min, percentiles (the median always) and max of each numeric column."""
        shares = sorted({*(percentiles or [0.25, 0.5, 0.75]), 0.5})
        got = moments(self.df, get_numeric_columns(self.df), shares, approximate)
        labels = [f"p{100 * s:g}".replace(".", "_") for s in shares]
        rows = [(c, m["count"], m["mean"], m["std"], m["min"], *m["q"], m["max"]) for c, m in got.items()]
        return small(self.spark, rows, "column string, count long, mean double, std double, min double, " + "".join(f"{x} double, " for x in labels) + "max double")

    def get_categorical_summary(self, max_unique: int = 50) -> DataFrame:
        """(column, unique_count, top_value, top_frequency, top_percent); of equally frequent values the least; of all rows."""
        names = get_string_columns(self.df)
        n = self.df.count()
        if not names:
            return small(self.spark, [], _CATEGORICAL)
        counts = fused.value_counts(self.df, names).filter("value IS NOT NULL")
        top = counts.groupBy("name").agg(F.count("*").alias("u"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("v"), F.max("n").alias("k"))
        got = {r["name"]: r for r in top.collect()}
        rows = []
        for c in names:
            if c not in got:
                rows.append((c, 0, None, 0, 0.0))
            elif got[c]["u"] <= max_unique:
                rows.append((c, got[c]["u"], got[c]["v"], got[c]["k"], 100.0 * got[c]["k"] / n))
        return small(self.spark, rows, _CATEGORICAL)

    # -- outliers

    def outlier_flags(self, columns: list[str] | None, method: str, width: float, medians: bool = False) -> dict[str, Outliers]:
        """medians: whether they are wanted where the method doesn't take quartiles anyway."""
        names = get_numeric_columns(self.df) if columns is None else columns
        out = {}
        shares = [0.25, 0.5, 0.75] if method == "iqr" else [0.5] if medians else []
        for c, m in moments(self.df, names, shares, parts=["mean", "std"]).items() if names else ():
            x = number(self.df, c)
            if method == "iqr":
                if m["q"][0] is None:
                    continue
                spread = m["q"][2] - m["q"][0]
                low, high = m["q"][0] - width * spread, m["q"][2] + width * spread
                flag = (x < low) | (x > high)
            else:
                if not m["std"] or math.isnan(m["std"]):
                    log.warning("column %r doesn't vary; it has no outliers", c)
                    continue
                low, high = m["mean"] - width * m["std"], m["mean"] + width * m["std"]
                flag = F.abs((x - m["mean"]) / m["std"]) > width
            out[c] = Outliers(flag, low, high, m["mean"], m["q"][len(shares) // 2] if shares else None)
        return out

    def _detected(self, columns, method: str, width: float) -> dict[str, Outliers]:
        found = self.outlier_flags(columns if columns is None else get_numeric_columns(self.df, columns), method, width)
        got = aggregate(self.df, {(c,): F.count(F.when(o.flag, 1)) for c, o in found.items()}) if found else {}
        for c, o in found.items():
            o.count = got[c,]
        return {c: o for c, o in found.items() if o.count}

    def detect_outliers_iqr(self, columns: list[str] | None = None, multiplier: float = 1.5) -> dict[str, Outliers]:
        """The columns that have any; their ``flag`` is a condition for ``filter``."""
        return self._detected(columns, "iqr", multiplier)

    def detect_outliers_zscore(self, columns: list[str] | None = None, threshold: float = 3.0) -> dict[str, Outliers]:
        return self._detected(columns, "zscore", threshold)

    # -- correlation

    def correlations(self, method: str = "pearson", columns: list[str] | None = None) -> dict[tuple[str, str], float | None]:
        if method not in fused.CORRELATIONS:
            raise InvalidMethodError(method, list(fused.CORRELATIONS))
        names = get_numeric_columns(self.df, columns)
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        return {p: r for p, (r, _) in fused.CORRELATIONS[method](self.df, pairs).items()} if pairs else {}

    def get_correlation_matrix(self, method: str = "pearson", min_correlation: float = 0.0, columns: list[str] | None = None) -> DataFrame:
        """(feature1, feature2, correlation) of all ordered pairs, a column with itself too; null below the least, or undefined."""
        upper = self.correlations(method, columns)
        names = get_numeric_columns(self.df, columns)
        varies = {c for p, r in upper.items() if r is not None for c in p}
        rows = []
        for a in names if len(names) > 1 else ():
            for b in names:
                r = (1.0 if a in varies else None) if a == b else upper.get((a, b), upper.get((b, a)))
                rows.append((a, b, r if r is not None and abs(r) >= min_correlation else None))
        return small(self.spark, rows, "feature1 string, feature2 string, correlation double")

    def get_high_correlations(self, threshold: float = 0.7, method: str = "pearson", columns: list[str] | None = None) -> DataFrame:
        rows = [(a, b, r) for (a, b), r in self.correlations(method, columns).items() if r is not None and abs(r) >= threshold]
        return small(self.spark, sorted(rows, key=lambda r: -abs(r[2])), "feature1 string, feature2 string, correlation double")

    def calculate_vif(self, columns: list[str] | None = None) -> DataFrame:
        """(feature, VIF), largest first: the diagonal of the inverse correlation matrix of mean-filled columns."""
        names = get_numeric_columns(self.df, columns)
        got = moments(self.df, names, (), parts=["mean", "std"]) if len(names) > 1 else {}
        names = [c for c in names if c in got and got[c]["std"]]
        if len(names) < 2:
            return small(self.spark, [], "feature string, VIF double")
        filled = {c: F.coalesce(number(self.df, c), F.lit(got[c]["mean"])) - got[c]["mean"] for c in names}
        products = aggregate(self.df, {(a, b): F.avg(filled[a] * filled[b]) for i, a in enumerate(names) for b in names[i:]})
        cov = np.array([[products.get((a, b), products.get((b, a))) for b in names] for a in names], float)
        sd = np.sqrt(np.diag(cov))
        with np.errstate(all="ignore"):
            corr = cov / np.outer(sd, sd)
            singular = np.linalg.matrix_rank(corr) < len(names)
            vif = np.diag(np.linalg.pinv(corr) if singular else np.linalg.inv(corr))
        if singular:  # a column that the others give exactly
            residual = [np.linalg.lstsq(np.delete(np.delete(corr, i, 0), i, 1), np.delete(corr[:, i], i), rcond=None)[0] @ np.delete(corr[:, i], i) for i in range(len(names))]
            vif = [math.inf if 1 - r < 1e-10 else 1 / (1 - r) for r in residual]
        return small(self.spark, sorted(((c, float(v)) for c, v in zip(names, vif, strict=True)), key=lambda r: -r[1]), "feature string, VIF double")

    # -- cardinality

    def get_cardinality_info(self, approximate: bool = False) -> DataFrame:
        """(column, unique_count, cardinality_ratio, dtype), most first; the ratio is null without rows."""
        n = self.df.count()
        types = dict(self.df.dtypes)
        rows = [(c, k, k / n if n else None, types[c]) for c, k in distinct_counts(self.df, self.df.columns, approximate).items()]
        return small(self.spark, sorted(rows, key=lambda r: (-r[1], r[0])), "column string, unique_count long, cardinality_ratio double, dtype string")

    def detect_misclassified_categorical(self, max_unique: int = 10, min_unique_ratio: float = 0.05) -> DataFrame:
        """(column, unique_count, total_count, unique_ratio, suggestion) of numeric columns that look like classes."""
        names = get_numeric_columns(self.df)
        unique = distinct_counts(self.df, names)
        counts = aggregate(self.df, {(c,): F.count(quoted(c)) for c in names}) if names else {}
        rows = []
        for c in names:
            n, k = counts[c,], unique[c]
            if not n:
                continue
            ratio = k / n
            if k == 2:
                why = "binary"
            elif k <= max_unique:
                why = "few values"
            elif ratio < min_unique_ratio:
                why = "few values for so many rows"
            elif is_whole(kind(self.df, c)) and k <= 20:
                why = "whole numbers of few values"
            else:
                continue
            rows.append((c, k, n, ratio, why))
        return small(self.spark, sorted(rows, key=lambda r: (r[1], r[0])), "column string, unique_count long, total_count long, unique_ratio double, suggestion string")

    def suggest_binning(self, max_bins: int = 10, min_unique: int = 20) -> DataFrame:
        """(column, unique_count, skewness, outlier_percent, strategy, n_bins, priority) of columns that binning would suit."""
        names = get_numeric_columns(self.df)
        unique = distinct_counts(self.df, names)
        stats = moments(self.df, names, (), parts=["count", "g1", "g2"]) if names else {}
        names = [c for c in names if stats[c]["count"] >= 10 and unique[c] >= min_unique]
        flags = self.outlier_flags(names, "iqr", 1.5)
        outside = aggregate(self.df, {(c,): F.count(F.when(o.flag, 1)) for c, o in flags.items()}) if flags else {}
        rows = []
        for c in names:
            skew, share = stats[c]["skew"], 100.0 * outside.get((c,), 0) / stats[c]["count"]
            twentieth = min(max_bins, max(5, unique[c] // 20))
            if abs(skew) > 1:
                strategy, bins, priority = "quantile", twentieth, 3 if abs(skew) > 2 else 2
            elif share > 5:
                strategy, bins, priority = "quantile", min(max_bins, max(4, unique[c] // 30)), 3
            else:
                strategy, bins, priority = "uniform", twentieth, 1
            rows.append((c, unique[c], skew, share, strategy, bins, priority))
        return small(self.spark, sorted(rows, key=lambda r: (-r[6], r[0])), "column string, unique_count long, skewness double, outlier_percent double, strategy string, n_bins int, priority int")

    # -- pictures' data

    def histogram(self, column: str, bins: int = 30) -> DataFrame:
        """(bin, low, high, n): equal widths between least and greatest; the last bin has its upper end."""
        m = moments(self.df, [column], (), parts=["count", "min", "max"])[column]
        if not m["count"]:
            return small(self.spark, [], "bin int, low double, high double, n long")
        low, width = m["min"], (m["max"] - m["min"]) / bins or 1.0
        x = number(self.df, column)
        index = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
        return self.df.filter(x.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n")).select(
            "bin", (F.col("bin") * width + low).alias("low"), ((F.col("bin") + 1) * width + low).alias("high"), "n"
        )

    def plot_missing_values(self, show: bool = True):
        from .plots import bars

        rows = self.get_missing_summary().collect()
        return bars([r["column"] for r in rows], [r["missing_percent"] for r in rows], "Missing values (%)", show) if rows else None

    def plot_correlation_heatmap(self, method: str = "pearson", show: bool = True):
        from .plots import heatmap

        names = get_numeric_columns(self.df)
        rows = self.get_correlation_matrix(method).collect()
        return heatmap(names, {(r[0], r[1]): r[2] for r in rows}, "Correlation", show) if rows else None

    def plot_distributions(self, columns: list[str] | None = None, show: bool = True):
        from .plots import histograms

        names = get_numeric_columns(self.df, columns)
        return histograms({c: self.histogram(c).orderBy("bin").collect() for c in names}, show) if names else None


_CATEGORICAL = "column string, unique_count long, top_value string, top_frequency long, top_percent double"


def quick_analysis(df: DataFrame) -> str:
    """Prints and returns an overview of the frame."""
    a = DataAnalyzer(df)
    info = a.get_basic_info()
    parts = [f"{info['shape'][0]} rows x {info['shape'][1]} columns, about {info['memory_usage_mb']:.1f} MB, {info['duplicates']} duplicate rows"]
    for name, table in (
        ("Missing values", a.get_missing_summary()),
        ("Numbers", a.get_numeric_summary()),
        ("Texts", a.get_categorical_summary()),
        ("Cardinality", a.get_cardinality_info()),
        ("Correlations of 0.7 or more", a.get_high_correlations()),
        ("Numbers that look like classes", a.detect_misclassified_categorical()),
        ("Binning", a.suggest_binning()),
    ):
        rows = table.collect()
        parts.append(f"\n{name}\n" + "\n".join("  " + ", ".join(f"{k}={v:.4g}" if isinstance(v, float) else f"{k}={v}" for k, v in r.asDict().items()) for r in rows) if rows else f"\n{name}: none")
    text = "\n".join(parts)
    print(text)
    return text
