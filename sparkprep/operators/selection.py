"""Feature selection. The target is never selected; scores cover the numeric features."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DATA_FAULTS, ColumnNotFoundError, DataTypeError, InvalidMethodError
from ..functions import statistics as st
from ..plans.fused import CORRELATIONS, aggregate, moments, small
from ..schema import get_feature_columns, is_numeric, kind, number, quoted
from .base import FeatureEngineeringBase
from .target import TargetAnalyzer

log = logging.getLogger(__name__)
SCORES = ["f_classif", "f_regression", "mutual_info_classif", "mutual_info_regression", "chi2"]


class FeatureSelector(FeatureEngineeringBase):
    def __init__(self, df: DataFrame, target_column: str | None = None, order_by=None):
        super().__init__(df, order_by)
        self.target_column = target_column
        self.selected_features: list[str] = []
        self.feature_scores: dict[str, dict[str, float]] = {}

    def _features(self, exclude: list[str] | None = None, numeric_only: bool = True) -> list[str]:
        gone = [*(exclude or []), *([self.target_column] if self.target_column else [])]
        return get_feature_columns(self.df, gone, numeric_only)

    def _kept(self, names: list[str]) -> list[str]:
        self.selected_features = list(names)
        return list(names)

    def _best(self, kind_: str, scores: dict[str, float], k: int, by_score: bool = True) -> list[str]:
        self.feature_scores[kind_] = scores
        best = sorted(scores, key=lambda c: -scores[c])[:k]
        return self._kept(best if by_score else [c for c in scores if c in best])

    def _need_target(self) -> str:
        if not self.target_column:
            raise ValueError("a target is needed")
        if self.target_column not in self.df.columns:
            raise ColumnNotFoundError(self.target_column, self.df.columns)
        return self.target_column

    def select_by_variance(self, threshold: float = 0.0, exclude: list[str] | None = None) -> list[str]:
        """Population variance above the threshold; the score kept is the sample variance."""
        names = self._features(exclude)
        got = moments(self.df, names, (), parts=["var_pop", "var_samp"]) if names else {}
        self.feature_scores["variance"] = {c: got[c]["var_samp"] or 0.0 for c in names}
        kept = [c for c in names if (got[c]["var_pop"] or 0.0) > threshold]
        if names and not kept:
            raise ValueError(f"no feature has a variance above {threshold}")
        return self._kept(kept)

    def select_by_correlation(self, threshold: float = 0.7, method: str = "pearson") -> list[str]:
        """A feature goes if any earlier one, kept or not, correlates with it by more than the threshold."""
        if method not in CORRELATIONS:
            raise InvalidMethodError(method, list(CORRELATIONS))
        names = self._features()
        if len(names) < 2:
            return names
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        gone = {b for (_, b), (r, _) in CORRELATIONS[method](self.df, pairs).items() if r is not None and abs(r) > threshold}
        return self._kept([c for c in names if c not in gone])

    def select_by_target_correlation(self, k: int = 10, method: str = "pearson") -> list[str]:
        y = self._need_target()
        if not is_numeric(kind(self.df, y)):
            raise DataTypeError("the target must be numeric", y, "numeric", kind(self.df, y).simpleString())
        got = CORRELATIONS[method](self.df, [(c, y) for c in self._features()])
        return self._best("target_correlation", {c: abs(r) if r is not None else 0.0 for (c, _), (r, _) in got.items()}, k)

    def select_by_statistical_test(self, k: int = 10, task: str = "classification", score_func: str | Callable | None = None) -> list[str]:
        """The k best, in column order. A callable gets (frame, features, target) and gives a score for each feature."""
        y = self._need_target()
        name = score_func or ("f_classif" if task == "classification" else "f_regression")
        if not callable(name) and name not in SCORES:
            raise InvalidMethodError(str(name), SCORES)
        features = self._features()
        try:
            scores = dict(name(self.df, features, y)) if callable(name) else self._scores(name, features, y)
        except DATA_FAULTS as e:  # a test that can't be made selects nothing
            log.error("the test failed: %s", e)
            return []
        return self._best("custom" if callable(name) else name, scores, k, by_score=False)

    def _scores(self, name: str, features: list[str], y: str) -> dict[str, float]:
        rows = self.df.select(*map(quoted, [*features, y])).dropna()
        if name == "f_classif":
            groups = TargetAnalyzer(rows, y, "classification")._by_class(features, y)
            return {c: st.anova(groups[c])[0] for c in features}
        if name == "f_regression":
            n = rows.count()
            got = CORRELATIONS["pearson"](rows, [(c, y) for c in features])
            return {c: float("inf") if r * r >= 1 else r * r / (1 - r * r) * (n - 2) for (c, _), (r, _) in ((p, (v[0] or 0.0, v[1])) for p, v in got.items())}
        if name == "chi2":
            if any(v < 0 for v in aggregate(rows, {(c,): F.min(number(rows, c)) for c in features}).values()):
                raise ValueError("chi2 needs values of 0 or more")
            classes = rows.groupBy(quoted(y)).agg(F.count("*").alias("n"), *(F.sum(number(rows, c)).alias(f"s{i}") for i, c in enumerate(features))).collect()
            total = sum(r["n"] for r in classes)
            out = {}
            for i, c in enumerate(features):
                whole = sum(r[f"s{i}"] for r in classes)
                out[c] = sum((r[f"s{i}"] - whole * r["n"] / total) ** 2 / (whole * r["n"] / total) for r in classes) if whole else 0.0
            return out
        task = "classification" if name == "mutual_info_classif" else "regression"
        mi = TargetAnalyzer(rows, y, task).analyze_mutual_information(features, "knn").collect()
        return {c: next(r["mi"] for r in mi if r["feature"] == c) for c in features}

    def select_by_importance(self, k: int = 10, task: str = "classification", n_estimators: int = 100, random_state: int = 42) -> list[str]:
        """By the impurity importances of a random forest."""
        y, features = self._need_target(), self._features()
        try:
            rows = self.df.select(*(number(self.df, c).alias(f"f{i}") for i, c in enumerate(features)), quoted(y).alias("label")).dropna()
            rows = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(rows)
            if task == "classification":
                rows = StringIndexer(inputCol="label", outputCol="index").fit(rows).transform(rows)
                forest = RandomForestClassifier(labelCol="index", numTrees=n_estimators, seed=random_state)
            else:
                rows = rows.withColumn("index", F.col("label").cast("double"))
                forest = RandomForestRegressor(labelCol="index", numTrees=n_estimators, seed=random_state)
            found = forest.fit(rows.select("features", "index")).featureImportances.toArray().tolist()
        except DATA_FAULTS as e:  # a forest that can't grow selects nothing
            log.error("the forest failed: %s", e)
            return []
        return self._best("importance", dict(zip(features, found, strict=True)), k)

    def select_by_missing_values(self, threshold: float = 0.5) -> list[str]:
        names = self._features(numeric_only=False)
        got = aggregate(self.df, {(c,): F.avg(quoted(c).isNull().cast("double")) for c in names}) if names else {}
        return self._kept([c for c in names if (got[c,] or 0.0) <= threshold])

    def get_feature_importance_df(self, sort: bool = True) -> DataFrame:
        """(feature, score, score_type) of the kind of score that was added last."""
        schema = "feature string, score double, score_type string"
        if not self.feature_scores:
            return small(self.spark, [], schema)
        last = list(self.feature_scores)[-1]
        rows = [(c, float(s), last) for c, s in self.feature_scores[last].items()]
        return small(self.spark, sorted(rows, key=lambda r: -r[1]) if sort else rows, schema)

    def apply_selection(self, selected_features: list[str] | None = None, keep_target: bool = True) -> DataFrame:
        names = selected_features if selected_features is not None else self.selected_features
        if not names:
            return self.df
        names = [c for c in names if c in self.df.columns]
        if keep_target and self.target_column in self.df.columns and self.target_column not in names:
            names.append(self.target_column)
        return self.df.select(*map(quoted, names))

    def get_selected_features(self) -> list[str]:
        return list(self.selected_features)


def select_features_auto(df: DataFrame, target_column: str, task: str = "classification", max_features: int = 20, variance_threshold: float = 0.01, correlation_threshold: float = 0.9) -> tuple[DataFrame, FeatureSelector]:
    """By variance, then correlation, then a forest; the frame and the selector of the last step."""
    first = FeatureSelector(df, target_column)
    first.select_by_variance(variance_threshold)
    second = FeatureSelector(first.apply_selection(), target_column)
    second.select_by_correlation(correlation_threshold)
    third = FeatureSelector(second.apply_selection(), target_column)
    third.select_by_importance(max_features, task)
    return third.apply_selection(), third
