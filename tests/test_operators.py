"""The tabular operators on literal frames, errors included."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep.functions import statistics as st
from sparkprep.functions import tails
from sparkprep.plans.neighbours import digamma, ross
from sparkprep.queries import tabular
from sparkprep.streaming.score import score


@pytest.fixture(scope="module")
def f2(spark):
    rows = [(1, 10, "A", 1.0), (2, 20, "B", None), (3, 30, "A", 3.0), (4, 40, "C", float("nan")), (5, 50, "B", 5.0)]
    return spark.createDataFrame(rows, "numeric1 long, numeric2 long, categorical string, with_nulls double")


def column(df, name, by="numeric1"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_nan_is_missing(f2):
    assert sp.DataAnalyzer(f2).get_missing_summary().collect()[0]["missing_count"] == 2
    with pytest.raises(TypeError):
        sp.DataPreprocessor([1])


@pytest.mark.parametrize(
    ("strategy", "want"),
    [("mean", [1, 3, 3, 3, 5]), ("median", [1, 3, 3, 3, 5]), ("mode", [1, 1, 3, 1, 5]), ("forward_fill", [1, 1, 3, 3, 5]), ("backward_fill", [1, 3, 3, 5, 5]), ("interpolate", [1, 2, 3, 4, 5])],
)
def test_imputation(f2, strategy, want):
    p = sp.DataPreprocessor(f2, order_by="numeric1")
    assert column(p.handle_missing_values(strategy, ["with_nulls"]), "with_nulls") == want
    assert p.handle_missing_values(strategy, ["with_nulls"], inplace=True) is p and len(p.history()) == 1


def test_interpolation_at_the_ends(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "numeric1 int, v double")
    assert column(sp.DataPreprocessor(df, "numeric1").handle_missing_values("interpolate", ["v"]), "v") == [None, 1, 2, 3, 3]


def test_errors(f2):
    p = sp.DataPreprocessor(f2)
    with pytest.raises(sp.InvalidStrategyError) as e:
        p.handle_missing_values("guess")
    assert e.value.strategy == "guess" and "mean" in e.value.valid_strategies and not isinstance(e.value, ValueError)
    for call, error in (
        (lambda: p.handle_missing_values("fill_value"), ValueError),
        (lambda: p.handle_missing_values("forward_fill"), sp.ValidationError),
        (lambda: p.handle_outliers("numeric1"), TypeError),
        (lambda: p.handle_outliers(["numeric1"], method="x"), sp.InvalidMethodError),
        (lambda: p.handle_outliers(["numeric1"], multiplier=0), ValueError),
        (lambda: p.clip_values("numeric1", 3, 1), ValueError),
        (lambda: p.filter_rows(5), TypeError),
        (lambda: p.sample_data(n=1, frac=0.1), ValueError),
        (lambda: p.sample_data(n=99), sp.ValidationError),
        (lambda: p.clean_string_columns(["categorical"], ["sing"]), sp.InvalidMethodError),
        (lambda: p.drop_columns("numeric1"), TypeError),
        (lambda: p.export_summary("/tmp/x", "json"), sp.ValidationError),
        (lambda: sp.FeatureEngineer(f2).save_transformers("/tmp/x"), sp.TransformerNotFittedError),
        (lambda: sp.FeatureEngineer(f2).create_polynomial_features(["numeric1"], 4), ValueError),
        (lambda: sp.FeatureEngineer(f2.limit(0)).scale_features(["numeric1"]), sp.EmptyDataFrameError),
        (lambda: sp.FeatureEngineer(f2.withColumn("c", F.lit(5))).create_binning("c"), sp.ConstantColumnError),
        (lambda: sp.TargetAnalyzer(f2, "nowhere"), sp.ColumnNotFoundError),
        (lambda: sp.FeatureSelector(f2).select_by_target_correlation(), ValueError),
        (lambda: sp.FeatureSelector(f2, "categorical").select_by_target_correlation(), sp.DataTypeError),
    ):
        with pytest.raises(error):
            call()


def test_rows_and_columns(f2, spark):
    p = sp.DataPreprocessor(f2, order_by="numeric1")
    assert p.sample_data(n=3, random_state=1).count() == 3
    assert column(p.remove_duplicates(["categorical"], "last"), "numeric1") == [3, 4, 5]
    assert column(p.clip_values("with_nulls", 2, 4), "with_nulls") == [2, None, 3, None, 4]
    assert p.handle_missing_values("fill_value", ["numeric1"], fill_value=2.5).schema["numeric1"].dataType.simpleString() == "double"
    wide = f2.withColumn("one", F.lit(1)).withColumn("none", F.lit(None).cast("int"))
    assert sp.DataPreprocessor(wide).remove_constant_columns().columns == f2.columns
    assert sp.DataPreprocessor(f2).remove_high_cardinality_columns(1.0).columns == ["categorical", "with_nulls"]
    strings = spark.createDataFrame([("1",), ("x",)], "s string")
    assert sp.DataPreprocessor(strings).convert_dtypes({"s": "int"}).dtypes == [("s", "string")]
    title = spark.createDataFrame([("o'neil hello-world a1b",)], "s string")
    assert sp.DataPreprocessor(title).clean_string_columns(["s"], ["title"]).first()[0] == "O'Neil Hello-World A1B"


def test_outliers(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 100]], "numeric1 long")
    p = sp.DataPreprocessor(df)
    assert column(p.handle_outliers(["numeric1"]), "numeric1") == [1, 2, 3, 4, 5]
    assert max(column(p.handle_outliers(["numeric1"], action="cap"), "numeric1")) == 8.5
    assert column(p.handle_outliers(["numeric1"], action="replace"), "numeric1") == [1, 2, 3, 3.5, 4, 5]
    assert sp.DataAnalyzer(spark.createDataFrame([(5,)] * 5, "c int")).detect_outliers_zscore() == {}


def test_history(f2, tmp_path):
    p = sp.DataPreprocessor(f2).drop_columns(["numeric2"], inplace=True).filter_rows("numeric1 > 3", inplace=True)
    assert "60.0%" in p.get_preprocessing_summary()
    for kind in ("text", "markdown", "json"):
        p.export_summary(str(tmp_path / kind), kind)
    assert json.loads((tmp_path / "json").read_text())[1]["rows_changed"] == -3


def test_encoders_round_trip(f2, spark, tmp_path):
    f = sp.FeatureEngineer(f2)
    f.encode_categorical_label(["categorical"])
    f.scale_features(["numeric1", "numeric2"], "minmax")
    f.save_transformers(str(tmp_path / "t.json"))
    g = sp.FeatureEngineer(f2)
    g.load_transformers(str(tmp_path / "t.json"))
    new = spark.createDataFrame([(3, 10, "C"), (1, 50, "Z")], "numeric1 long, numeric2 long, categorical string")
    got = g.transform(new).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.0, 2), (0.0, 1.0, None)]


def test_streaming_score(f2, spark, tmp_path):
    f = sp.FeatureEngineer(f2)
    f.encode_categorical_onehot(["categorical"], drop_first=True)
    f.scale_features(["numeric1"])
    f2.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f2.schema).parquet(str(tmp_path / "in"))
    q = score(stream, f.fitted()).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("scored").count() == 5 and "categorical_C" in spark.table("scored").columns


def test_features(f2):
    f = sp.FeatureEngineer(f2, order_by="numeric1")
    assert column(f.scale_features(["numeric1"]), "numeric2", "numeric2") == [10, 20, 30, 40, 50]
    assert column(f.scale_features(["numeric1"]), "numeric1")[0] == pytest.approx(-math.sqrt(2))
    got = f.create_aggregations("categorical", "numeric1", ["mean", "nunique", "cumsum", "median", "bogus"])
    assert column(got, "numeric1_categorical_mean") == [2, 3.5, 2, 4, 3.5]
    assert column(got, "numeric1_categorical_cumsum") == [1, 2, 4, 4, 7]
    assert column(f.create_ratio_features("numeric1", "numeric2", epsilon=-10.0), "numeric1_to_numeric2_ratio")[0] == math.inf
    assert column(f.create_flag_features("categorical", "A"), "categorical_flag") == [1, 0, 1, 0, 0]
    assert [c for c in f.create_polynomial_features(["numeric1", "numeric2", "with_nulls"], 3, True).columns if "_x_" in c] == ["numeric1_x_numeric2_x_with_nulls"]


def test_ranks_and_correlations(spark):
    r = np.random.default_rng(3)
    x, y = r.integers(0, 30, 400), r.normal(size=400)
    z = x * 2 + r.normal(size=400)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(x, y, z, strict=True)], "x int, y double, z double").withColumn("k", F.lit(1.0))
    a = sp.DataAnalyzer(df)
    for method in ("pearson", "spearman", "kendall"):
        got = a.correlations(method)
        want = df.toPandas().corr(method) if method == "pearson" else None
        assert got["x", "k"] is None and got["x", "z"] > 0.9
        if want is not None:
            assert got["x", "y"] == pytest.approx(want.loc["x", "y"])
    ranked = df.toPandas()[["x", "y", "z"]].rank().corr()
    assert a.correlations("spearman")["x", "z"] == pytest.approx(ranked.loc["x", "z"])
    assert a.get_correlation_matrix().filter("correlation IS NULL").count() == 7


def test_vif(spark):
    r = np.random.default_rng(4)
    x = r.normal(100, 20, (300, 3))
    x[:, 2] = 0.9 * x[:, 0] + 0.1 * x[:, 2]
    got = {v["feature"]: v["VIF"] for v in sp.DataAnalyzer(spark.createDataFrame(x.tolist(), "a double, b double, c double")).calculate_vif().collect()}
    for i, c in enumerate("abc"):
        other = np.column_stack([np.ones(300), np.delete(x, i, 1)])
        fit = other @ np.linalg.lstsq(other, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fit) ** 2).sum() / ((x[:, i] - x[:, i].mean()) ** 2).sum()
        assert got[c] == pytest.approx(1 / (1 - r2), rel=1e-6)
    twice = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "a double, b double")
    assert all(v["VIF"] > 1e8 for v in sp.DataAnalyzer(twice).calculate_vif().collect())


def test_empty(spark):
    df = spark.createDataFrame([], "a int, b string")
    a = sp.DataAnalyzer(df)
    assert a.get_basic_info()["shape"] == (0, 2) and a.get_cardinality_info().collect()[0]["cardinality_ratio"] is None
    assert sp.DataPreprocessor(df).validate_data_quality()["shape"] == (0, 2)
    assert sp.quick_analysis(df)


def test_selection(spark):
    r = np.random.default_rng(5)
    rows = [(float(a), float(a + 0.01 * b), float(c), 5.0, int(a + 0.1 * b > 0)) for a, b, c in r.normal(size=(200, 3))]
    df = spark.createDataFrame(rows, "f1 double, f1_dup double, f2 double, constant double, target int")
    s = sp.FeatureSelector(df, "target")
    assert s.select_by_variance() == ["f1", "f1_dup", "f2"]
    assert s.select_by_correlation(0.9) == ["f1", "f2", "constant"]
    assert s.select_by_target_correlation(1)[0] in ("f1", "f1_dup")
    assert s.select_by_statistical_test(2) == ["f1", "f1_dup"]
    assert s.select_by_statistical_test(1, score_func=lambda d, f, y: {c: float(c == "f2") for c in f}) == ["f2"]
    with pytest.raises(sp.InvalidMethodError):
        s.select_by_statistical_test(1, score_func="x")
    assert s.select_by_statistical_test(1, score_func="chi2") == []  # negative values
    assert set(s.select_by_importance(2, n_estimators=5)) == {"f1", "f1_dup"}
    assert s.apply_selection().columns[-1] == "target"


def test_target(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = [(float(a), float(b), "ABC"[i % 3], ["low", "high"][int(a > 0.5)]) for i, (a, b) in enumerate(r.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "f1 double, f2 double, f3 string, target string")
    t = sp.TargetAnalyzer(df, "target")
    assert t.task == "classification"
    got = {x["feature"]: x for x in t.analyze_feature_target_relationship(check_assumptions=True).collect()}
    assert got["f1"]["pvalue"] < 1e-10 and got["f3"]["test_type"] == "chi_square" and got["f2"]["pvalue"] > 1e-4
    for estimator in ("binned", "knn"):
        mi = t.analyze_mutual_information(estimator=estimator).collect()
        assert mi[0]["feature"] == "f1" and mi[0]["mi"] > 5 * max(mi[1]["mi"], 1e-3)
    assert t.get_class_imbalance_info()["severity"] == "moderate" and "SUMMARY" in t.generate_summary_report()
    for kind in ("html", "markdown", "json"):
        t.export_report(str(tmp_path / kind), kind)
    assert "f1" in (tmp_path / "html").read_text() and json.loads((tmp_path / "json").read_text())["task_info"]["task"] == "classification"
    assert {s["category"] for s in t.suggest_feature_engineering()} & {"encoding", "binning"}
    assert t.recommend_models(detailed=True)["summary"]["dataset_size"] == "small"
    reg = sp.TargetAnalyzer(df.withColumn("y", F.col("f1") * 3 + F.col("f2") * 0.1).drop("target"), "y")
    assert reg.task == "regression" and reg.analyze_feature_correlations(check_linearity=True).first()["feature"] == "f1"
    assert reg.analyze_data_quality()["leakage_suspects"][0]["feature"] == "f1" and reg.generate_recommendations()
    assert reg.analyze_mutual_information(estimator="knn").first()["feature"] == "f1"


def test_normality_of_all_rows(spark):
    r = np.random.default_rng(3)
    x = np.round(np.concatenate([r.normal(size=2000), r.exponential(3, size=6000)]), 2)  # ties, and only the first rows are normal
    a = sp.DataAnalyzer(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "i long, x double"))
    for m in ("normaltest", "anderson"):
        got, want = a.check_normality("x", m), st.check_normality(x, m)
        assert got["n"] == len(x) and not got["is_normal"]
        assert got["statistic"] == pytest.approx(want["statistic"], rel=1e-9) and got["p_value"] == pytest.approx(want["p_value"])
    assert not a.check_normality("x")["is_normal"] and a.check_normality("x")["n"] == len(x)


def test_normality_query_reads_all_orders(spark, tmp_path):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=2000), r.exponential(3, size=4000)])
    spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {g["method"]: g for g in tabular.QUERIES["normality"](spark, str(tmp_path)).collect()}
    assert not any(g["is_normal"] for g in got.values())
    assert got["anderson"]["statistic"] == pytest.approx(st.check_normality(x, "anderson")["statistic"], rel=1e-9)


def test_shapiro_sample_of_rows_not_of_values(spark):
    df = spark.range(0, 60_000, numPartitions=4).select((F.col("id") % 5).cast("double").alias("y"), F.lit(2.0).alias("p"))
    t = sp.TargetAnalyzer(df, "y", "regression")
    x = t._sample(F.col("y"))
    assert len(x) == 5000 and (np.abs(np.bincount(x.astype(int)) - 1000) < 150).all()
    assert (np.sort(x) == np.sort(sp.TargetAnalyzer(df.repartition(7), "y", "regression")._sample(F.col("y")))).all()
    got = t.analyze_target_distribution()
    assert got["shapiro_statistic"] < 0.95 and not got["is_normal"]
    assert t.analyze_residuals("p")["shapiro_statistic"] == pytest.approx(got["shapiro_statistic"])


def brute_ross(x, y, k):
    """By the matrix of distances."""
    keep = np.isin(y, [c for c in np.unique(y) if (y == c).sum() > 1])
    x, y = x[keep], y[keep]
    away, n = np.abs(x[:, None] - x), np.array([(y == c).sum() for c in y])
    used = np.minimum(k, n - 1)
    kth = np.array([np.partition(a[y == c], m)[m] for a, c, m in zip(away, y, used, strict=True)])  # the first one is the row itself
    m = np.where(kth > 0, (away < kth[:, None]).sum(1), (away == 0).sum(1))
    return float(digamma(np.array([len(x)]))[0] + (digamma(used) - digamma(n) - digamma(m)).mean())


@pytest.mark.parametrize("seed", [0, 1])
def test_neighbours_of_all_rows(spark, seed):
    r = np.random.default_rng(seed)
    y = r.choice(list("abcd"), 6000, p=[0.6, 0.39, 0.008, 0.002])
    x = r.normal(size=6000) + (y == "b") + 5 * (y == "d")
    x[:1500] = 1e-10 * r.normal(size=1500)  # a value that is hot but for the noise
    x[1500:1600] = 2.0  # and one without noise
    y[7] = "alone"
    points = spark.createDataFrame([(float(a), str(b)) for a, b in zip(x, y, strict=True)], "x double, y string")
    assert ross(points, 3) == pytest.approx(brute_ross(x, y, 3), abs=1e-5)


def test_knn_takes_all_rows(spark):
    # Half of the rows are one row; the feature tells the class of each other row.
    df = spark.range(0, 60_000, numPartitions=4).select(
        F.when(F.col("id") % 2 == 0, 0.0).otherwise((F.col("id") % 4 - 2) * (1 + F.rand(1))).alias("f"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 4).cast("string")).alias("t"),
    )
    mi = sp.TargetAnalyzer(df, "t", "classification").analyze_mutual_information(estimator="knn").first()["mi"]
    assert mi == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(4), abs=0.01)


# -- statistics without Spark


def test_tails_against_known_values():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.f_sf(4.0, 2, 30) == pytest.approx(0.0288446, rel=1e-5)
    assert tails.t_sf2(2.228138851964939, 10) == pytest.approx(0.05)
    assert tails.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert tails.t_ppf(0.975, 10) == pytest.approx(2.228138851964939)
    assert 0 < tails.f_sf(500, 2, 1000) < 1e-100


def test_statistics():
    r = np.random.default_rng(1)
    assert st.check_normality(r.normal(size=300))["is_normal"] and not st.check_normality(r.exponential(size=300))["is_normal"]
    for m in st.NORMALITY:
        assert not st.check_normality(r.exponential(size=500), m)["is_normal"]
    assert st.shapiro([2.0, 4.0, 4.5, 7.0, 11.0, 13.0, 17.0])[0] == pytest.approx(0.937, abs=0.02)
    assert st.cramers_v([[10, 15], [20, 25]])["cramers_v"] == pytest.approx(0.0, abs=0.06)
    assert st.chi_square([[10, 15], [20, 25]])[2] == 1
    q = st.apply_multiple_testing_correction([0.01, 0.04, 0.03, 0.50])["corrected_pvalues"]
    assert q.tolist() == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    with pytest.raises(sp.InsufficientDataError):
        st.apply_multiple_testing_correction([])
    assert st.pearson_r_to_d(1) == math.inf and math.isnan(st.calculate_correlation_ci(1.0, 50)["ci_lower"])
    ci = st.calculate_mean_ci([1, 2, 3, 4, 5])
    assert (ci["ci_lower"], ci["ci_upper"]) == pytest.approx((1.0367568385224, 4.9632431614775))
    assert st.bootstrap_ci([1, 2, 3, 4, 5], np.median)["ci_lower"] <= 3
    assert not st.check_homogeneity_of_variance([r.normal(size=100), r.normal(0, 5, 100)])["equal_variances"]
    assert st.cohens_d([1, 1], [1, 1])["interpretation"] == "undefined"
    assert st.eta_squared(f_statistic=4.0, df_between=2, df_within=30)["interpretation"] == "large"
    assert st.validate_sample_size([[1] * 40, [1] * 20], "ttest")["sufficient"] is False
    assert st.check_chi2_expected_frequencies([[1, 2], [3, 4]])["recommendation"].startswith("use Fisher")
