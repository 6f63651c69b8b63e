"""Plans against plain versions: quantiles, ranks, tau, sums of tables, and samples."""

import bisect
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprep.errors import DATA_FAULTS
from sparkprep.functions import statistics as st
from sparkprep.operators import plots
from sparkprep.operators.clean import DataPreprocessor
from sparkprep.operators.profile import DataAnalyzer
from sparkprep.operators.target import TargetAnalyzer
from sparkprep.plans import fused

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark, n=60_000, seed=1):
    """Skewed numbers, few values, one hot value, and nulls, in three groups."""
    r = np.random.default_rng(seed)
    hot = np.where(r.random(n) < 0.4, 7.0, r.normal(7, 3, n))
    x = [None if i % 11 == 0 else float(v) for i, v in enumerate(r.lognormal(0, 2, n))]
    rows = list(zip(range(n), x, hot.tolist(), r.integers(0, 5, n).tolist(), r.choice(["a", "b", "c"], n, p=[0.98, 0.015, 0.005]).tolist(), strict=True))
    return spark.createDataFrame(rows, "id long, x double, hot double, few long, g string").repartition(7)


def test_exact_quantiles(spark):
    df = frame(spark)
    p = df.toPandas()
    cols = ["x", "hot", "few"]
    got = fused.exact_quantiles(df, {c: F.col(c) for c in cols}, SHARES)
    for c in cols:
        assert got[c, None] == pytest.approx(np.quantile(p[c].dropna(), SHARES), rel=1e-12)
    by = fused.exact_quantiles(df, {c: F.col(c) for c in cols}, [0.5, 0.9], F.col("g"))
    for g, part in p.groupby("g"):
        for c in cols:
            assert by[c, g] == pytest.approx(np.quantile(part[c].dropna(), [0.5, 0.9]), rel=1e-12)
    none = fused.exact_quantiles(df.filter("id < 0"), {"x": F.col("x")}, [0.5])
    assert none["x", None] == [None]


def test_quantiles_bracketed_again(spark, monkeypatch):
    monkeypatch.setattr(fused, "SKETCH", 100)
    monkeypatch.setattr(fused, "INSIDE", 199)
    df = frame(spark, 20_000, 2)
    x = df.select("x").dropna().toPandas()["x"]
    assert fused.exact_quantiles(df, {"x": F.col("x")}, [0.3, 0.8])["x", None] == pytest.approx(np.quantile(x, [0.3, 0.8]), rel=1e-9)


def plain_tau(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))


@pytest.mark.parametrize("seed", [1, 2])
def test_tau(spark, seed):
    r = np.random.default_rng(seed)
    n = 1500
    x = np.where(r.random(n) < 0.35, 3, r.integers(-40, 40, n)).astype(float)
    y = x * (seed - 1) + r.normal(0, 9, n).round()
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    (tau, m), = fused.kendalls(df, [("x", "y")]).values()
    assert m == n and tau == pytest.approx(plain_tau(x, y), abs=1e-12)
    assert fused.kendalls(df.withColumn("c", F.lit(1.0)), [("x", "c")])["x", "c"] == (None, n)
    assert fused.kendalls(df.filter("x > 1e9"), [("x", "y")])["x", "y"] == (None, 0)


def test_spearman_with_and_without_nulls(spark):
    df = frame(spark, 3000, 3)
    p = df.toPandas()
    got = fused.spearmans(df, [("x", "hot"), ("hot", "few"), ("x", "few"), ("id", "hot")])
    for (a, b), (r, n) in got.items():
        both = p[[a, b]].dropna()
        want = np.corrcoef(both[a].rank(), both[b].rank())[0, 1]
        assert n == len(both) and r == pytest.approx(want, abs=1e-9)


def test_sums_of_tables(spark):
    r = random.Random(4)
    rows = [(r.choice("pqrstuvwxyz"), r.choice("ab"), r.choice(["k", "l", "m", None])) for _ in range(800)] + [("only", "a", "k")]
    df = spark.createDataFrame(rows, "many string, two string, y string")
    t = TargetAnalyzer(df, "y", "classification")
    p = df.toPandas().dropna()
    got = t._tables(["many", "two"])
    for c in ("many", "two"):
        table = p.groupby([c, "y"]).size().unstack(fill_value=0).to_numpy()
        e = st.expected(table)
        assert got[c]["chi2"] == pytest.approx(st.chi_square(table)[0]) and got[c]["shape"] == table.shape
        assert got[c]["least"] == pytest.approx(e.min()) and got[c]["below"] == (e < 5).sum()
    square = TargetAnalyzer(df.filter("y <> 'm'"), "y", "classification")._tables(["two"])["two"]
    table = p[p["y"] != "m"].groupby(["two", "y"]).size().unstack(fill_value=0).to_numpy()
    assert square["chi2"] == pytest.approx(st.chi_square(table)[0])  # with the correction


def test_anova_by_any_number_of_groups(spark):
    r = np.random.default_rng(5)
    rows = [(f"g{i % 50}" if i % 9 else None, float(v)) for i, v in enumerate(r.normal(0, 1, 2000))] + [("alone", 3.0)]
    df = spark.createDataFrame(rows, "g string, y double")
    f, p, eta, k = TargetAnalyzer(df, "y", "regression")._anova_by("g")
    groups = [x["y"].to_numpy() for _, x in df.toPandas().dropna().groupby("g") if len(x) > 1]
    want = st.anova([(len(x), x.mean(), x.var()) for x in groups])
    assert (f, p, eta) == pytest.approx(want) and k == len(groups)


def test_sample_is_the_same_whatever_the_partitions(spark):
    df = spark.range(5000).withColumn("v", F.lit(1))
    one, two = ({r["id"] for r in DataPreprocessor(df.repartition(n), "id").sample_data(n=300, random_state=5).collect()} for n in (2, 9))
    assert one == two and len(one) == 300
    assert DataPreprocessor(df).sample_data(frac=0.5).count() == 2500 and DataPreprocessor(df, "id").sample_data(n=5000, random_state=1).count() == 5000


def test_sizes_of_associations():
    for classes, cuts in ((2, [0.1, 0.3, 0.5]), (3, [0.07, 0.21, 0.35]), (4, [0.06, 0.17, 0.29]), (9, [0.06, 0.17, 0.29])):
        for v, size in ((cuts[0] - 0.01, "negligible"), (cuts[0] + 0.01, "small"), (cuts[1] + 0.01, "medium"), (cuts[2] + 0.01, "large")):
            n = 10_000
            assert st.cramers_v_from(v * v * n * (classes - 1), n, (classes, classes + 2))["interpretation"] == size
    got = st.cramers_v([[10, 15], [20, 25]], bias_correction=True)
    assert {"description", "chi2_statistic", "pvalue", "cramers_v_uncorrected"} <= set(got)
    assert math.isnan(st.cramers_v_from(1.0, 2, (2, 2), True)["cramers_v"])


def test_lost_executors_are_no_faults_of_data():
    from py4j.protocol import Py4JJavaError

    assert not issubclass(Py4JJavaError, DATA_FAULTS) and not issubclass(MemoryError, DATA_FAULTS)


def test_data_of_plots(spark):
    df = frame(spark, 4000, 6)
    t = TargetAnalyzer(df.select("hot", "g"), "g", "classification")
    rows = {r["class"]: r for r in plots.feature_by_class_data(t, "hot").collect()}
    p = df.toPandas()
    assert rows["a"]["median"] == pytest.approx(p[p["g"] == "a"]["hot"].median())
    bins = plots.class_histograms_data(t, "hot").collect()
    assert sum(r["n"] for r in bins) == 4000
    qq = plots.qq_data(df, "hot", 9)
    assert [y for _, y in qq] == pytest.approx(np.quantile(p["hot"], [(i + 0.5) / 9 for i in range(9)]))
    points, _, _ = plots.feature_vs_target_data(TargetAnalyzer(df.select("hot", "few"), "hot", "regression"), "few", 50)
    assert points.count() == 50
    assert DataAnalyzer(df).get_numeric_summary().count() == 4


def gaps(spark, n=30_000, seed=3):
    """(frame, its values in order): nulls at both ends, over more rows than a range has, and here and there; rows in no order."""
    r = np.random.default_rng(seed)
    x = r.normal(0, 100, n)
    x[r.random(n) < 0.3] = np.nan
    x[:40] = x[-40:] = x[n // 3 : n // 3 + 9_000] = np.nan
    rows = [(int(i), None if math.isnan(x[i]) else float(x[i])) for i in r.permutation(n)]
    return spark.createDataFrame(rows, "id long, x double").repartition(5), x


def filled(df, strategy):
    """The values in order; no frame of a window may end at the last row, as Spark goes over all of its rows for each row."""
    out = DataPreprocessor(df, order_by="id").handle_missing_values(strategy, ["x"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    return [r["x"] for r in out.orderBy("id").collect()]


def test_backward_fill_in_one_pass(spark):
    df, x = gaps(spark)
    got = filled(df, "backward_fill")
    want = pd.Series(x).bfill()
    assert [v is None for v in got] == want.isna().tolist()
    assert [v for v in got if v is not None] == want.dropna().tolist()


def test_interpolation_in_one_pass(spark):
    df, x = gaps(spark, seed=4)
    got = filled(df, "interpolate")
    want = pd.Series(x).interpolate()
    assert [v is None for v in got] == want.isna().tolist()
    assert [v for v in got if v is not None] == pytest.approx(want.dropna().tolist(), rel=1e-9, abs=1e-9)


def test_interpolation_sorts_rows_once(spark, tmp_path):
    """By the given order only; a second time only the ends of ranges and ranges without values, for what carries over."""
    df, x = gaps(spark, seed=5)
    df.withColumn("more", F.lit("m")).write.parquet(str(tmp_path / "x"))
    out = DataPreprocessor(spark.read.parquet(str(tmp_path / "x")), order_by="id").handle_missing_values("interpolate", ["x"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "- Sort [_bucket" in line and "_row" in line]
    sc, none = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, none, None)
        return {(t.stageId(), t.attemptId()): t.shuffleWriteRecords() for t in map(stages.apply, range(stages.size()))}

    before = shuffled()
    assert len(out.collect()) == len(x)
    assert sum(n for k, n in shuffled().items() if k not in before) < 1.5 * len(x)


@pytest.mark.parametrize("strategy", ["forward_fill", "backward_fill", "interpolate"])
def test_fills_by_two_keys(spark, strategy):
    """Equal and null first keys, several columns that are known in other places, one never known, more than 64 ranges."""
    r = np.random.default_rng(6)
    n = 4000
    p = pd.DataFrame({"a": r.integers(0, 300, n).astype(float), "b": r.permutation(n), "x": r.normal(0, 9, n), "y": r.normal(0, 9, n), "z": np.nan})
    p.loc[r.random(n) < 0.1, "a"] = np.nan
    p.loc[r.random(n) < 0.97, "x"] = np.nan
    p.loc[(p["a"] < 100) | (r.random(n) < 0.5), "y"] = np.nan
    rows = [tuple(None if v != v else v for v in t) for t in p.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, "a double, b long, x double, y double, z double").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    try:
        out = DataPreprocessor(df, order_by=["a", "b"]).handle_missing_values(strategy, ["x", "y", "z"])
        got = {t["b"]: t for t in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = p.sort_values(["a", "b"], na_position="last")
    for c in ("x", "y", "z"):
        full = {"forward_fill": want[c].ffill, "backward_fill": want[c].bfill, "interpolate": want[c].interpolate}[strategy]()
        values = [got[b][c] for b in want["b"]]
        assert [v is None for v in values] == full.isna().tolist()
        assert [v for v in values if v is not None] == pytest.approx(full.dropna().tolist(), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 64, 65, 80, 81, 255])
def test_rows_are_dealt_by_bounds(spark, n):
    r = np.random.default_rng(n)
    bounds = sorted(r.choice(5000, n, replace=False).tolist())
    df = spark.createDataFrame([(i,) for i in range(-5, 5005)] + [(None,)], "k long")
    for t in fused.dealt(df, "at", F.col("k"), bounds).collect():
        assert t["at"] == (0 if t["k"] is None else bisect.bisect_left(bounds, t["k"]))
