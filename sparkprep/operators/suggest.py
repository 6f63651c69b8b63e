"""Advice from the numbers of the other analyses: plain rules over a row for each column."""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from ..errors import DATA_FAULTS
from ..plans.fused import aggregate, corrected, distinct_counts, pair_moments, pearson
from ..schema import get_feature_columns, is_numeric, kind, number, quoted

log = logging.getLogger(__name__)
RANK = {"high": 0, "medium": 1, "low": 2}
#: Kind of advice: (text, category, effort).
ADVICE = {
    "unskew_right": ("Apply log or sqrt transformation", "transformations", "low"),
    "unskew_left": ("Apply square or exponential transformation", "transformations", "low"),
    "polynomial": ("Create polynomial features (squared, cubed)", "transformations", "medium"),
    "scale": ("Apply StandardScaler or MinMaxScaler", "scaling", "low"),
    "onehot": ("One-hot encode", "encoding", "minimal"),
    "target_or_ordinal": ("Target encode or ordinal encode", "encoding", "medium"),
    "target_or_rare": ("Target encode or group rare categories", "encoding", "medium"),
    "interaction": ("Create interaction terms (multiplication, ratios)", "interactions", "medium"),
    "bin": ("Bin into categorical groups", "binning", "medium"),
    "indicator": ("Create missing indicator flag", "missing_values", "minimal"),
}
#: Fixed values, as the results must match: part of a model's name: (speed, memory, interpretability).
MODELS = {
    "Random Forest": ("fast", "moderate", "medium"),
    "XGBoost": ("moderate", "moderate", "low"),
    "LightGBM": ("fast", "low", "low"),
    "Logistic Regression": ("fast", "low", "high"),
    "Linear Regression": ("fast", "low", "high"),
    "Ridge": ("fast", "low", "high"),
    "Lasso": ("fast", "low", "high"),
    "SVM": ("slow", "high", "low"),
    "Neural Network": ("slow", "high", "low"),
    "Huber": ("fast", "low", "high"),
}
OTHER_MODEL = ("moderate", "moderate", "medium")
STEEPER = 1.2  # how much better the square must correlate


class SuggestionsMixin:
    def _numbers(self, names: list[str]) -> dict[str, dict]:
        """Moments of each numeric feature, and how it and its square go with a numeric target, in one job."""
        wanted = {}
        for c in names:
            x = number(self.df, c)
            wanted |= {(c, "n"): F.count(x), (c, "g1"): F.skewness(x), (c, "min"): F.min(x), (c, "max"): F.max(x)}
            if self.task == "regression":
                y = number(self.df, self.target_column)
                wanted |= {(c, power, k): v for power, z in ((1, x), (2, x * x)) for k, v in pair_moments(z, y).items()}
                wanted[c, "targets"] = F.count(F.when(x.isNotNull(), y))
        got = aggregate(self.df, wanted) if wanted else {}
        out = {}
        for c in names:
            m = {k: got[c, k] for k in ("n", "min", "max")}
            m["skew"] = corrected(m["n"], got[c, "g1"], None)[0] or 0.0
            if self.task == "regression":
                # A missing target leaves the correlation undefined, and with it the rules after this one.
                whole = got[c, "targets"] == m["n"]
                for power, name in ((1, "r"), (2, "r_squared")):
                    m[name] = pearson({k: got[c, power, k] for k in ("n", "cov", "sx", "sy")}) if whole else None
            out[c] = m
        return out

    def suggest_feature_engineering(self, grouped: bool = False):
        """A list of suggestions by priority; grouped: with a summary, quick wins and categories."""
        features = get_feature_columns(self.df, self.target_column, numeric_only=False)
        numeric = [c for c in features if is_numeric(kind(self.df, c))]
        found: list[dict] = []

        def add(feature: str, advice: str, reason: str, priority: str) -> None:
            text, category, effort = ADVICE[advice]
            found.append({"feature": feature, "suggestion": text, "reason": reason, "priority": priority, "effort": effort, "category": category})

        for c, m in self._numbers(numeric).items():
            if m["n"] < 10:
                continue
            if abs(m["skew"]) > 1:
                add(c, "unskew_right" if m["skew"] > 0 else "unskew_left", f"skewness {m['skew']:.2f}", "high" if abs(m["skew"]) > 2 else "medium")
            if self.task == "regression" and m["n"] > 20:
                if m["r"] is None or m["r_squared"] is None:
                    continue
                if abs(m["r_squared"]) > abs(m["r"]) * STEEPER:
                    add(c, "polynomial", f"its square correlates with {abs(m['r_squared']):.3f}, itself with {abs(m['r']):.3f}", "high")
            if m["max"] - m["min"] > 100:
                add(c, "scale", f"values from {m['min']:.1f} to {m['max']:.1f}", "medium")
        for c, k in distinct_counts(self.df, [c for c in features if c not in numeric]).items():
            if k:
                add(c, "onehot" if k <= 5 else "target_or_ordinal" if k <= 15 else "target_or_rare", f"{k} different values", "medium" if 5 < k <= 15 else "high")
        if self.task == "regression" and len(numeric) >= 2:
            top = [r["feature"] for r in self.analyze_feature_correlations().limit(2).collect()]
            if len(top) == 2:
                add(", ".join(top), "interaction", "they correlate with the target most", "medium")
        if self.task == "classification" and numeric:
            for r in [r for r in self.analyze_feature_target_relationship().collect() if r["test_type"] == "anova" and r["pvalue"] > 0.05][:3]:
                add(r["feature"], "bin", f"means hardly differ between classes (p {r['pvalue']:.2f})", "low")
        missing = aggregate(self.df, {(c,): F.avg(quoted(c).isNull().cast("double")) for c in features}) if features else {}
        for c in features:
            share = 100 * (missing[c,] or 0)
            if share > 5:
                add(c, "indicator", f"{share:.1f}% missing", "medium" if share > 20 else "low")
        found.sort(key=lambda s: RANK[s["priority"]])
        if not grouped:
            return found
        wins = [s for s in found if s["effort"] in ("minimal", "low") and s["priority"] != "low"]
        count = lambda p: sum(s["priority"] == p for s in found)
        return {
            "summary": {"total_suggestions": len(found), "quick_wins": len(wins)} | {f"{p}_priority": count(p) for p in RANK},
            "quick_wins": wins[:5],
            "by_category": {k: [s for s in found if s["category"] == k] for k in dict.fromkeys(s["category"] for s in found)},
            "all_suggestions": found,
        }

    def recommend_models(self, detailed: bool = False):
        """Models that suit the size, the number of features, the balance of classes and the target's outliers."""
        n, features = self.df.count(), len(self.df.columns) - 1
        small, large, wide = n < 1000, n > 50_000, features > 50
        rows: list[tuple[str, str, str]] = []
        if self.task == "classification":
            balance = self.get_class_imbalance_info()
            if balance["severity"] != "none":
                rows += [("Random Forest with class_weight='balanced'", "copes with unequal classes", "high")]
                rows += [("XGBoost with scale_pos_weight", f"copes with classes of {balance['imbalance_ratio']:.1f} to 1", "high")]
            else:
                rows += [("Random Forest", "a sturdy start for equal classes", "high")]
            if not wide or n > 10 * features:
                rows += [(f"Logistic Regression (penalty={'l1 or l2' if wide else 'l2'})", "fast and easy to read", "medium")]
            if small:
                rows += [("Support Vector Machine (SVM)", "works on few rows", "medium")]
            if large and not wide:
                rows += [("Neural Network (MLP)", f"{n} rows are enough for it", "medium")]
            rows += [("LightGBM", "fast, takes classes as they are", "high" if large else "medium")]
        else:
            rows += [("Random Forest Regressor", "a sturdy start", "high"), ("XGBoost Regressor", "finds complex patterns", "high")]
            if self.analyze_target_distribution().get("has_outliers"):
                rows += [("Huber Regressor", "outliers of the target move it little", "medium")]
            elif wide:
                rows += [("Ridge or Lasso Regression", f"keeps {features} features in check", "medium")]
            else:
                rows += [("Linear Regression", "simple and easy to read", "medium")]
            rows += [("LightGBM Regressor", "fast and accurate", "high" if large else "medium")]
            if large:
                rows += [("Neural Network (MLP Regressor)", f"{n} rows are enough for it", "low")]
        if small:
            rows += [("Cross-Validation with multiple models", f"{n} rows: compare several", "high")]
        out = []
        for model, reason, priority in rows:
            speed, memory, clear = next((v for k, v in MODELS.items() if k in model), OTHER_MODEL)
            out.append({"model": model, "reason": reason, "priority": priority, "speed": speed, "memory": memory, "interpretability": clear})
        out.sort(key=lambda r: RANK[r["priority"]])
        if not detailed:
            return out
        short = lambda r: r["model"].split(" with ")[0].split(" (")[0]
        return {
            "summary": {"task": self.task, "n_samples": n, "n_features": features, "dataset_size": "small" if small else "large" if large else "medium", "recommended": out[0]["model"], "total_recommendations": len(out)},
            "comparison": [{"model": short(r)} | {k: r[k] for k in ("speed", "memory", "interpretability", "priority")} for r in out[:5]],
            "recommendations": out,
        }

    def generate_recommendations(self, quality: dict | None = None, mi_df=None, vif_df=None) -> list[str]:
        q = quality or self.analyze_data_quality()
        out = []
        if many := [c for c, m in q["missing_values"].items() if m["percent"] > 50]:
            out.append(f"{len(many)} features miss more than half of their values ({', '.join(many[:3])}): drop or impute them.")
        if q["target_missing"]["percent"]:
            out.append(f"The target misses {q['target_missing']['percent']:.1f}%: those rows can't be learned from.")
        if fixed := q["constant_features"]:
            out.append(f"{len(fixed)} features never change ({', '.join(fixed[:3])}): drop them.")
        if leaks := [s for s in q["leakage_suspects"] if s["severity"] == "high"]:
            out.append(f"{len(leaks)} features may leak the target: look at {', '.join(s['feature'] for s in leaks[:3])}.")
        if self.task == "classification":
            balance = self.get_class_imbalance_info()
            if balance["severity"] != "none":
                out.append(f"Classes are unequal ({balance['severity']}, {balance['imbalance_ratio']:.1f} to 1): weigh or resample them.")
        else:
            d = self.analyze_target_distribution()
            if not d["is_normal"] and abs(d["skewness"] or 0) > 1:
                out.append("The target is skewed: take its logarithm, or a robust regression.")
        try:
            scaled, least = ("normalized_mi", 0.01) if self.task == "classification" else ("relative_mi", 0.1)
            low = (mi_df if mi_df is not None else self.analyze_mutual_information()).filter(F.col(scaled) < least).count()
            if low:
                out.append(f"{low} features tell little about the target" + (" compared with the best one" if scaled == "relative_mi" else "") + ": select features.")
            high = [r["feature"] for r in (vif_df if vif_df is not None else self.calculate_vif()).filter("VIF > 10").collect()]
            if high:
                out.append(f"{len(high)} features follow from others (VIF above 10): think of dropping {', '.join(high[:3])}.")
        except DATA_FAULTS as e:  # advice is given without these two
            log.debug("no advice from mutual information or VIF: %s", e)
        return out or ["No major issues."]
