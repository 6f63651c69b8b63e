"""Analyses of features against a target.

Tests are computed from sums that Spark makes in one pass for all numeric features (by class) and one for all others (counts of
pairs of values); distributions' tails are computed on the driver, from a number for each feature.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, InvalidMethodError
from ..functions import statistics as st
from ..plans import fused, neighbours
from ..plans.fused import aggregate, distinct_counts, moments, small
from ..plans.scratch import cut
from ..schema import get_feature_columns, is_numeric, kind, number, quoted, validate_columns
from .base import FeatureEngineeringBase
from .profile import DataAnalyzer
from .report import ReportingMixin
from .suggest import SuggestionsMixin

log = logging.getLogger(__name__)
TASKS = ["classification", "regression"]
LEAST_ROWS = 10
RELATION = "feature string, test_type string, statistic double, pvalue double, effect_size double, effect_size_type string, effect_size_interpretation string, assumptions_met boolean, warnings string"


class TargetAnalyzer(ReportingMixin, SuggestionsMixin, FeatureEngineeringBase):
    def __init__(self, df: DataFrame, target_column: str, task: str = "auto", order_by=None):
        super().__init__(df, order_by)
        if target_column not in self.df.columns:
            raise ColumnNotFoundError(target_column, self.df.columns)
        if task not in (*TASKS, "auto"):
            raise ValueError(f"task is 'auto' or one of {TASKS}")
        self.target_column = target_column
        self._cache: dict = {}
        self.task = self._detect_task() if task == "auto" else task

    @property
    def _y(self):
        return quoted(self.target_column)

    def _numeric_features(self, columns: list[str] | None = None) -> list[str]:
        names = get_feature_columns(self.df, self.target_column)
        return names if columns is None else [c for c in validate_columns(self.df, columns) if c in names]

    def _detect_task(self) -> str:
        t = kind(self.df, self.target_column)
        if not is_numeric(t):
            return "classification"
        n, unique = self.df.agg(F.count(self._y), F.count_distinct(self._y)).first()
        return "classification" if not n or unique <= 20 or unique / n < 0.05 else "regression"

    # -- the target

    def get_task_info(self) -> dict:
        n, known, unique = self.df.agg(F.count("*"), F.count(self._y), F.count_distinct(self._y)).first()
        info = {
            "task": self.task,
            "target_column": self.target_column,
            "target_dtype": kind(self.df, self.target_column).simpleString(),
            "unique_values": unique,
            "missing_count": n - known,
            "missing_percent": 100 * (n - known) / n if n else 0.0,
        }
        if self.task == "classification":
            info["classes"] = sorted(r["class"] for r in self._classes())
        return info

    def _classes(self) -> list:
        if "classes" not in self._cache:
            counts = self.df.filter(self._y.isNotNull()).groupBy(self._y.alias("class")).agg(F.count("*").alias("count"))
            self._cache["classes"] = counts.orderBy(F.desc("count"), "class").collect()
        return self._cache["classes"]

    def analyze_class_distribution(self) -> DataFrame:
        """(class, count, percentage, imbalance_ratio): the ratio is the largest class's count over the class's."""
        total, most = F.sum("count").over(Window.partitionBy()), F.max("count").over(Window.partitionBy())  # over rows of classes
        counts = self.df.filter(self._y.isNotNull()).groupBy(self._y.alias("class")).agg(F.count("*").alias("count"))
        return counts.select("class", "count", (100.0 * F.col("count") / total).alias("percentage"), (most / F.col("count")).alias("imbalance_ratio")).orderBy(F.desc("count"), "class")

    def get_class_imbalance_info(self) -> dict:
        rows = self._classes()
        if not rows:
            return {"is_balanced": True, "imbalance_ratio": math.nan, "severity": "none", "majority_class": None, "minority_class": None}
        low = min(rows, key=lambda r: (r["count"], str(r["class"])))
        ratio = rows[0]["count"] / low["count"]
        severity = "severe" if ratio > 3 else "moderate" if ratio > 1.5 else "none"
        return {"is_balanced": ratio <= 1.5, "imbalance_ratio": ratio, "severity": severity, "majority_class": rows[0]["class"], "minority_class": low["class"]}

    def analyze_target_distribution(self) -> dict:
        if self.task != "regression":
            log.warning("the target is a class")
            return {}
        if "target" not in self._cache:
            m = moments(self.df, [self.target_column])[self.target_column]
            q25, median, q75 = m["q"]
            spread = q75 - q25
            y = number(self.df, self.target_column)
            outside = self.df.filter((y < q25 - 1.5 * spread) | (y > q75 + 1.5 * spread)).count()
            sample = self._sample(y)
            w, p = st.shapiro(sample) if len(sample) >= 3 else (math.nan, math.nan)
            self._cache["target"] = {
                "count": m["count"], "mean": m["mean"], "median": median, "std": m["std"], "min": m["min"], "max": m["max"],
                "range": m["max"] - m["min"], "q25": q25, "q75": q75, "iqr": spread, "skewness": m["skew"], "kurtosis": m["kurtosis"],
                "has_outliers": outside > 0, "outlier_count": outside, "shapiro_stat": w, "shapiro_statistic": w, "shapiro_pvalue": p, "is_normal": bool(p > 0.05),
            }
        return self._cache["target"]

    def _sample(self, x, rows: int = st.SHAPIRO_ROWS) -> np.ndarray:
        """At most as many random rows as the test is made for."""
        return fused.sample(self.df.select(x.alias("x")), "x", rows)

    # -- statistics by class

    def analyze_class_wise_statistics(self, feature_columns: list[str] | None = None, confidence_level: float = 0.95, include_ci: bool = False, approximate: bool = False) -> DataFrame:
        """(feature, class, count, mean, median, std, min, max) of all features, from one groupBy and the medians' brackets.

        approximate: medians by sketches alone; then everything is one lazy groupBy, without intervals.

        include_ci adds t intervals of the mean, and percentile bootstrap intervals of the median.
        """
        names = self._numeric_features(feature_columns)
        x = {c: number(self.df, c) for c in names}
        known = self.df.filter(self._y.isNotNull())
        exact = {} if approximate or not names else fused.exact_quantiles(known, x, [0.5], self._y)
        middle = (lambda c: F.percentile_approx(x[c], 0.5, fused.SKETCH)) if approximate else (lambda c: _of_class(self._y, {g: q[0] for (k, g), q in exact.items() if k == c}))
        stats = {"count": F.count, "mean": F.avg, "median": None, "std": F.stddev_samp, "min": F.min, "max": F.max}
        wide = known.groupBy(self._y.cast("string").alias("class"))
        wide = wide.agg(*(F.struct(*((f(x[c]) if f else middle(c)).alias(k) for k, f in stats.items())).alias(f"s{i}") for i, c in enumerate(names)))
        rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s")) for i, c in enumerate(names)))
        out = wide.select("class", F.inline(rows)).select("feature", "class", "s.*").filter("count > 0")
        return self._with_intervals(out, names, confidence_level) if include_ci else out

    def _with_intervals(self, stats: DataFrame, names: list[str], confidence: float) -> DataFrame:
        def draw(key, rows: pd.DataFrame) -> pd.DataFrame:
            got = st.bootstrap_ci(np.sort(rows["x"].to_numpy()), np.median, 1000, confidence, 42)
            return pd.DataFrame({"feature": [key[0]], "class": [key[1]], "median_ci_lower": [got["ci_lower"]], "median_ci_upper": [got["ci_upper"]]})

        long = self.df.filter(self._y.isNotNull()).select(
            self._y.cast("string").alias("class"),
            F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), number(self.df, c).alias("x")) for c in names))),
        ).filter("x IS NOT NULL")
        # The bootstrap draws from a class's values, so one task holds them; the interval of the mean needs none.
        drawn = long.groupBy("feature", "class").applyInPandas(draw, "feature string, class string, median_ci_lower double, median_ci_upper double")
        means = [(r["feature"], r["class"], *st.mean_ci_from(r["count"], r["mean"], r["std"] or 0.0, confidence)) for r in stats.collect()]
        return stats.join(small(self.spark, means, "feature string, class string, mean_ci_lower double, mean_ci_upper double"), ["feature", "class"]).join(drawn, ["feature", "class"], "left")

    def _by_class(self, names: list[str], group: str) -> dict[str, list[tuple[int, float, float]]]:
        """(n, mean, population variance) of each numeric column in each group; groups of one row or none are left out."""
        if not names:
            return {}
        g = quoted(group)
        aggs = [f(number(self.df, c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
        rows = self.df.filter(g.isNotNull()).groupBy(g).agg(*aggs).collect()
        return {c: [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in rows if r[f"n{i}"] >= 2] for i, c in enumerate(names)}

    def _anova_by(self, group: str) -> tuple[float, float, float, int]:
        """F, p, eta squared and the number of groups of the target by a column of any number of values, summed in Spark."""
        y = number(self.df, self.target_column)
        rows = self.df.select(quoted(group).alias("g"), y.alias("y")).filter("g IS NOT NULL AND y IS NOT NULL")
        by = rows.groupBy("g").agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).filter("n > 1")
        n, m = F.col("n"), F.col("m")
        got = by.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(n * F.col("v")).alias("within"), (F.sum(n * m) / F.sum("n")).alias("mean"))
        r = got.first()
        if r["k"] < 2:
            return math.nan, math.nan, math.nan, r["k"]
        between = by.agg(F.sum(n * (m - F.lit(r["mean"])) ** 2)).first()[0]
        return *st.anova_from(r["k"], r["n"], between, r["within"]), r["k"]

    def _tables(self, names: list[str]) -> dict[str, dict]:
        """What chi-square takes of the contingency table of each column and the target; only totals leave Spark.

        With rows r and classes c of n in all, chi-square is n * (sum over rows of (sum of cell**2 / c) / r) - n. A table of two by two, which
        takes a correction, comes whole.
        """
        if not names:
            return {}
        long = fused.unpivoted(self.df.filter(self._y.isNotNull()), names, [self.target_column]).filter("value IS NOT NULL")
        cells = cut(long.groupBy("name", "value", self._y.cast("string").alias("class")).agg(F.count("*").alias("n")), "cells")
        totals = cells.groupBy("name", "class").agg(F.sum("n").alias("c"))  # a row for each class
        by_row = cells.join(totals, ["name", "class"]).groupBy("name", "value").agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n") / F.col("c")).alias("s"))
        every = totals.groupBy("name").agg(F.collect_list(F.col("c").cast("double")).alias("cs"), F.sum("c").alias("all"))
        below = F.size(F.filter("cs", lambda c: c * F.col("r") / F.col("all") < st.LEAST_EXPECTED))
        got = by_row.join(every, "name").groupBy("name").agg(
            F.count("*").alias("rows"), F.first(F.size("cs")).alias("classes"), F.first("all").alias("n"), F.sum(F.col("s") / F.col("r")).alias("s"),
            F.min(F.col("r") * F.array_min("cs") / F.col("all")).alias("least"), F.sum(below).alias("below"),
        )
        out = {r["name"]: {"shape": (r["rows"], r["classes"]), "n": r["n"], "chi2": max(0.0, r["n"] * r["s"] - r["n"]), "least": r["least"], "below": r["below"]} for r in got.collect()}
        square = [c for c, t in out.items() if t["shape"] == (2, 2)]
        rows = cells.filter(F.col("name").isin(square)).toPandas() if square else pd.DataFrame({"name": []})
        for c, t in rows.groupby("name"):
            out[c]["chi2"] = st.chi_square(t.pivot(index="value", columns="class", values="n").fillna(0).to_numpy())[0]
        return out

    def kruskal(self, column: str) -> tuple[float, float]:
        rows = self.df.select(number(self.df, column).alias("x"), self._y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
        rank = fused.ranks(rows, "x")
        cells = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
        sums = cells.join(rank.select(F.col("value").alias("x"), "rank"), "x").groupBy("y").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r")).collect()
        ties = rank.agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n"))).first()[0] or 0.0
        return st.kruskal([(r["n"], r["r"]) for r in sums], ties)

    def levene(self, column: str) -> tuple[float, float]:
        """Around the classes' medians."""
        rows = self.df.select(number(self.df, column).alias("x"), self._y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
        medians = fused.exact_quantiles(rows, {"x": F.col("x")}, [0.5], F.col("y"))
        rows = rows.join(small(self.spark, [(g, q[0]) for (_, g), q in medians.items()], "g string, m double"), F.col("y").cast("string") == F.col("g"))
        away = rows.groupBy("y").agg(F.count("x").alias("n"), F.avg(F.abs(F.col("x") - F.col("m"))).alias("a"), F.var_pop(F.abs(F.col("x") - F.col("m"))).alias("v"))
        return st.anova([(r["n"], r["a"], r["v"]) for r in away.collect()])[:2]

    def _non_normal(self, names: list[str], alpha: float) -> dict[str, bool]:
        """Whether any class's values differ from normal, by skewness and kurtosis, which are sums over all rows."""
        aggs = [f(number(self.df, c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("n", F.count), ("a", F.skewness), ("b", F.kurtosis))]
        rows = self.df.filter(self._y.isNotNull()).groupBy(self._y).agg(*aggs).collect() if names else []
        out = {}
        for i, c in enumerate(names):
            ps = [st.normaltest_from(r[f"n{i}"], r[f"a{i}"], r[f"b{i}"])[1] if r[f"n{i}"] >= 8 and r[f"a{i}"] is not None else 0.0 for r in rows if r[f"n{i}"] >= 2]
            out[c] = any(p <= alpha for p in ps)
        return out

    def analyze_feature_target_relationship(self, feature_columns: list[str] | None = None, correct_multiple_tests: bool = True, alpha: float = 0.05, report_effect_sizes: bool = True, check_assumptions: bool = False) -> DataFrame:
        """A test for each feature, by p: ANOVA, Kruskal-Wallis, chi-square or Pearson's r, whichever the kinds call for."""
        every = get_feature_columns(self.df, self.target_column, numeric_only=False)
        names = every if feature_columns is None else [c for c in validate_columns(self.df, feature_columns) if c in every]
        plain = lambda c: not isinstance(kind(self.df, c), (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        names = [c for c in names if plain(c)]
        counts = aggregate(self.df, {(c,): F.count(quoted(c)) for c in names} | {(): F.count_distinct(self._y)})
        extra = ", pvalue_corrected double, significant_raw boolean, significant_corrected boolean"
        if counts[()] < 2:
            return small(self.spark, [], RELATION + ", significant boolean")
        names = [c for c in names if counts[c,] >= LEAST_ROWS]
        numeric = [c for c in names if is_numeric(kind(self.df, c))]
        other = [c for c in names if c not in numeric]
        rows: list[list] = []
        if self.task == "classification":
            groups = self._by_class(numeric, self.target_column)
            odd = self._non_normal(numeric, alpha) if check_assumptions else {}
            for c in numeric:
                if len(groups[c]) < 2:
                    continue
                if odd.get(c):
                    h, p = self.kruskal(c)
                    rows.append([c, "kruskal", h, p, None, None, None, False, "values are not normal within classes"])
                    continue
                f, p, eta = st.anova(groups[c])
                rows.append([c, "anova", f, p, eta, "eta_squared", st._size(eta, [0.01, 0.06, 0.14]) if eta == eta else None, True if check_assumptions else None, ""])
            for c, t in self._tables(other).items():
                if min(t["shape"]) < 2:
                    continue
                (r, k), stat = t["shape"], t["chi2"]
                p, v = st.tails.chi2_sf(stat, (r - 1) * (k - 1)), st.cramers_v_from(stat, t["n"], t["shape"])
                valid = st.expected_frequencies_from(t["shape"], t["least"], t["below"])
                rows.append([c, "chi_square", stat, p, v["cramers_v"], "cramers_v", v["interpretation"], valid["valid"] if check_assumptions else None, "" if valid["valid"] else valid["recommendation"]])
        else:
            for (c, _), (r, n) in fused.pearsons(self.df, [(c, self.target_column) for c in numeric]).items():
                if r is not None and n >= 3:
                    size = "small" if abs(r) < 0.3 else "medium" if abs(r) < 0.5 else "large"
                    rows.append([c, "pearson", r, st.correlation_p(r, n), r, "pearson_r", size, None, ""])
            for c in other:
                f, p, eta, groups = self._anova_by(c)
                if groups > 1:
                    rows.append([c, "anova", f, p, eta, "eta_squared", st._size(eta, [0.01, 0.06, 0.14]) if eta == eta else None, None, ""])
        rows = [r for r in rows if r[3] == r[3]]
        if not report_effect_sizes:
            rows = [[*r[:4], None, None, None, *r[7:]] for r in rows]
        if correct_multiple_tests and len(rows) > 1:
            fixed = st.apply_multiple_testing_correction([r[3] for r in rows], "fdr_bh", alpha)
            rows = [[*r, float(q), r[3] < alpha, bool(s)] for r, q, s in zip(rows, fixed["corrected_pvalues"], fixed["reject"], strict=True)]
        else:
            rows, extra = [[*r, r[3] < alpha] for r in rows], ", significant boolean"
        fine = [tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows]
        return small(self.spark, sorted(fine, key=lambda r: (r[3], r[0])), RELATION + extra)

    def analyze_feature_correlations(self, feature_columns: list[str] | None = None, method: str = "pearson", include_ci: bool = False, check_linearity: bool = False, confidence_level: float = 0.95) -> DataFrame:
        """(feature, correlation, abs_correlation, pvalue, significant, n, ...) with a numeric target, strongest first."""
        schema = "feature string, correlation double, abs_correlation double, pvalue double, significant boolean, n long, ci_lower double, ci_upper double, linearity_warning boolean"
        if self.task != "regression" or method not in fused.CORRELATIONS:
            log.warning("correlations need a numeric target and one of the methods %s", list(fused.CORRELATIONS))
            return small(self.spark, [], schema)
        pairs = [(c, self.target_column) for c in self._numeric_features(feature_columns)]
        got = fused.CORRELATIONS[method](self.df, pairs)
        ranked = fused.spearmans(self.df, pairs) if check_linearity and method == "pearson" else {}
        rows = []
        for p in pairs:
            r, n = got[p]
            if r is None or n < 3:
                continue
            ci = st.calculate_correlation_ci(r, n, confidence_level) if include_ci else {}
            bent = abs(abs(r) - abs(ranked[p][0])) > 0.2 if p in ranked and ranked[p][0] is not None else None
            pvalue = st.correlation_p(r, n)
            rows.append((p[0], r, abs(r), pvalue, pvalue < 0.05, n, ci.get("ci_lower"), ci.get("ci_upper"), bent))
        return small(self.spark, sorted(rows, key=lambda x: (-x[2], x[0])), schema)

    # -- information

    def analyze_mutual_information(self, feature_columns: list[str] | None = None, estimator: str = "binned", bins: int = 10, sample_rows: int = 20_000) -> DataFrame:
        """(feature, mi, normalized_mi or relative_mi), most first. Null features count as 0.

        ``binned``: the plug-in estimate over quantile bins of all rows. ``knn``: nearest neighbours (k = 3); over all rows for
        classes, and over at most ``sample_rows`` random rows for a numeric target, which is open.
        """
        if estimator not in ("binned", "knn"):
            raise InvalidMethodError(estimator, ["binned", "knn"])
        names = self._numeric_features(feature_columns)
        rows = self.df.filter(self._y.isNotNull())
        missing = aggregate(rows, {(c,): F.count(F.when(quoted(c).isNull(), 1)) for c in names} | {(): F.count("*")})
        scaled = "normalized_mi" if self.task == "classification" else "relative_mi"
        schema = f"feature string, mi double, {scaled} double"
        if missing[()] < LEAST_ROWS or not names:
            return small(self.spark, [], schema)
        for c in names:
            if missing[c,]:
                log.warning("%d nulls of %r count as 0", missing[c,], c)
        filled = rows.select(*(F.coalesce(number(self.df, c), F.lit(0.0)).alias(c) for c in names), (self._y.cast("string") if self.task == "classification" else number(self.df, self.target_column)).alias("_y"))
        mi = self._binned(filled, names, bins) if estimator == "binned" else self._neighbours(filled, names, sample_rows)
        most = math.log(max(2, filled.select("_y").distinct().count())) if self.task == "classification" else max(mi.values()) or 1.0
        return small(self.spark, sorted(((c, v, v / most) for c, v in mi.items()), key=lambda r: (-r[1], r[0])), schema)

    def _binned(self, rows: DataFrame, names: list[str], bins: int) -> dict[str, float]:
        shares = [i / bins for i in range(1, bins)]
        bounded = names + ([] if self.task == "classification" else ["_y"])
        got = {(c,): q for (c, _), q in fused.exact_quantiles(rows, {c: quoted(c) for c in bounded}, shares).items()}

        def index(c):
            return sum(((quoted(c) > b).cast("int") for b in sorted(set(got[c,]))), F.lit(0))

        y = F.col("_y") if self.task == "classification" else index("_y").cast("string")
        cells = rows.select(y.alias("y"), F.inline(F.array(*(F.struct(F.lit(c).alias("name"), index(c).alias("x")) for c in names))))
        table = cells.groupBy("name", "x", "y").agg(F.count("*").alias("n")).toPandas()
        out = {}
        for c, t in table.groupby("name"):
            p = t["n"] / t["n"].sum()
            px, py = p.groupby(t["x"]).transform("sum"), p.groupby(t["y"]).transform("sum")
            out[c] = max(0.0, float((p * np.log(p / (px * py))).sum()))
        return out

    def _neighbours(self, rows: DataFrame, names: list[str], most: int, k: int = 3) -> dict[str, float]:
        if self.task == "regression":
            sample = rows.withColumn("_r", F.rand(42)).orderBy("_r").limit(most).toPandas()
            return {c: max(0.0, _ksg(_jittered(sample[c].to_numpy(dtype=float), i), sample["_y"].to_numpy(), k)) for i, c in enumerate(names)}
        stats = aggregate(rows, {(c, "std"): F.stddev_pop(quoted(c)) for c in names} | {(c, "size"): F.avg(F.abs(quoted(c))) for c in names})
        scale = {c: stats[c, "std"] or 1.0 for c in names}
        noise = lambda c, i: 1e-10 * max(1.0, stats[c, "size"] / scale[c]) * F.randn(42 + i)
        noisy = (rows.select(F.col("_y").alias("y"), *((quoted(c) / scale[c] + noise(c, i)).alias(f"x{i}") for i, c in enumerate(names))))
        noisy = cut(noisy, "noisy")  # the noise must be the same whenever it is read
        return {c: max(0.0, neighbours.ross(noisy.select(F.col(f"x{i}").alias("x"), "y"), k)) for i, c in enumerate(names)}

    # -- quality

    def calculate_vif(self, feature_columns: list[str] | None = None) -> DataFrame:
        return DataAnalyzer(self.df).calculate_vif(self._numeric_features(feature_columns))

    def analyze_residuals(self, predictions: str) -> dict:
        """predictions: the column that holds them."""
        if self.task != "regression":
            log.warning("residuals need a numeric target")
            return {}
        if predictions not in self.df.columns:
            raise ColumnNotFoundError(predictions, self.df.columns)
        y = number(self.df, self.target_column)
        e = y - number(self.df, predictions)
        both = F.when(e.isNotNull(), y)
        got = self.df.agg(F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop(both) * F.count(both)).alias("sst")).first().asDict()
        sse, sst = got.pop("sse"), got.pop("sst")
        w, p = st.shapiro(self._sample(e))
        return {f"residual_{k}" if k in ("mean", "std", "min", "max") else k: v for k, v in got.items()} | {"r2": 1 - sse / sst if sst else math.nan, "shapiro_stat": w, "shapiro_statistic": w, "shapiro_pvalue": p}

    def analyze_data_quality(self) -> dict:
        names = [c for c in self.df.columns if c != self.target_column]
        got = aggregate(self.df, {(c,): F.count(F.when(quoted(c).isNull(), 1)) for c in self.df.columns} | {(): F.count("*")})
        n = got[()]
        unique = distinct_counts(self.df, names)
        percent = lambda c: 100 * got[c,] / n if n else 0.0
        leaks = []
        if self.task == "regression":
            for r in self.analyze_feature_correlations().collect():
                if r["abs_correlation"] > 0.99:
                    leaks.append({"feature": r["feature"], "severity": "high", "reason": f"correlation {r['correlation']:.4f}"})
        else:
            for r in self.analyze_feature_target_relationship(correct_multiple_tests=False).collect():
                if r["pvalue"] < 1e-10 and (r["effect_size"] or 0) >= 0.8:
                    leaks.append({"feature": r["feature"], "severity": "medium", "reason": f"p {r['pvalue']:.3g}, effect {r['effect_size']:.3f}"})
        return {
            "missing_values": {c: {"count": got[c,], "percent": percent(c)} for c in names if got[c,]},
            "target_missing": {"count": got[self.target_column,], "percent": percent(self.target_column)},
            "leakage_suspects": leaks,
            "constant_features": [c for c in names if unique[c] == 1],
        }


def _of_class(y, values: dict):
    """The value of the row's class, as an aggregate."""
    pairs = [F.lit(v) for g, q in values.items() for v in (g, q)]
    return F.first(F.create_map(*pairs)[y.cast("string")]) if pairs else F.lit(None).cast("double")


def _jittered(x: np.ndarray, seed: int) -> np.ndarray:
    """Scaled, with noise that breaks ties."""
    scale = x.std() or 1.0
    x = x / scale
    return x + 1e-10 * max(1.0, np.abs(x).mean()) * np.random.default_rng(42 + seed).standard_normal(len(x))


def _ksg(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Between two numbers."""
    y = _jittered(np.asarray(y, float), 999)
    radius = np.empty(len(x))
    for at in range(0, len(x), 500):
        away = np.maximum(np.abs(x[at : at + 500, None] - x), np.abs(y[at : at + 500, None] - y))
        radius[at : at + 500] = np.partition(away, k, axis=1)[:, k]
    radius = np.nextafter(radius, 0)
    count = lambda v: np.searchsorted(s := np.sort(v), v + radius, "right") - np.searchsorted(s, v - radius, "left")
    return float(neighbours.digamma(np.array([len(x), k])).sum() - neighbours.digamma(count(x)).mean() - neighbours.digamma(count(y)).mean())


def _drawn(name: str):
    def plot(self, *a, **kw):
        from . import plots

        return getattr(plots, name)(self, *a, **kw)

    plot.__name__ = name
    return plot


for _name in ("plot_class_distribution", "plot_target_distribution", "plot_feature_by_class", "plot_feature_vs_target", "plot_residuals"):
    setattr(TargetAnalyzer, _name, _drawn(_name))
