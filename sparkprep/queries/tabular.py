"""A query for each operator, with its SQL. Nulls, duplicates and infinities are put in alike on both sides.

``QUERIES`` maps a name to a function of (spark, folder); ``ORACLES`` to SQL. ``query`` registers both.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..operators.clean import DataPreprocessor
from ..operators.features import FeatureEngineer
from ..operators.profile import DataAnalyzer
from ..operators.selection import FeatureSelector, select_features_auto
from ..operators.target import TargetAnalyzer
from ..plans.fused import pearsons, small
from ..plans.scratch import shared_dir
from ..sources.files import read_csv, read_parquet, write_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Columns with missing values, in both languages.
LINE = "l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS qty, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status"
EVENT = "event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value"
ORDER = "o_orderkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load(spark: SparkSession, sf: str, table: str, columns: str = "*") -> DataFrame:
    df = read_parquet(spark, f"{sf}/{table}.parquet")
    return df if columns == "*" else df.selectExpr(*(c.strip() for c in columns.split(", ")))


def long(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """Rounded numbers for comparison."""
    return df.select(*keep, *(F.round(c, 4).alias(c) for c in columns))


def each(columns: list[str], template: str) -> str:
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in columns)


# -- class-wise statistics, profiles


@query(
    "class_wise_stats",
    each(
        NUMBERS,
        "SELECT '{c}' AS feature, l_returnflag AS class, count({c}) AS count, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM lineitem GROUP BY l_returnflag",
    ),
)
def class_wise_stats(spark, sf):
    df = load(spark, sf, "lineitem").select("l_returnflag", *NUMBERS)
    got = TargetAnalyzer(df, "l_returnflag", "classification").analyze_class_wise_statistics(NUMBERS)
    return long(got, ["feature", "class", "count"], ["mean", "median", "std", "min", "max"])


@query("missing_summary", f"WITH t AS (SELECT {LINE} FROM lineitem) SELECT 'qty' AS \"column\", count(*) - count(qty) AS missing_count, round(100.0 * (count(*) - count(qty)) / count(*), 4) AS missing_percent FROM t")
def missing_summary(spark, sf):
    return long(DataAnalyzer(load(spark, sf, "lineitem", LINE)).get_missing_summary(), ["column", "missing_count"], ["missing_percent"])


_SUMMARY = "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM t"


@query("numeric_summary", f"WITH t AS (SELECT {LINE} FROM lineitem) " + each(["qty", "price", "discount", "tax"], _SUMMARY))
def numeric_summary(spark, sf):
    df = load(spark, sf, "lineitem", LINE).select("qty", "price", "discount", "tax")
    return long(DataAnalyzer(df).get_numeric_summary(), ["column", "count"], ["mean", "std", "min", "p25", "p50", "p75", "max"])


_TOP = "SELECT '{c}' AS \"column\", count(*) AS unique_count, arg_min(v, (-n, v)) AS top_value, CAST(max(n) AS BIGINT) AS top_frequency, round(100.0 * max(n) / (SELECT count(*) FROM t), 4) AS top_percent FROM (SELECT {c} AS v, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})"


@query("categorical_summary", f"WITH t AS (SELECT {ORDER} FROM orders) " + each(["o_orderstatus", "priority"], _TOP))
def categorical_summary(spark, sf):
    return long(DataAnalyzer(load(spark, sf, "orders", ORDER)).get_categorical_summary(), ["column", "unique_count", "top_value", "top_frequency"], ["top_percent"])


@query("cardinality", each(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*), 4) AS cardinality_ratio FROM customer"))
def cardinality(spark, sf):
    return long(DataAnalyzer(load(spark, sf, "customer")).get_cardinality_info(), ["column", "unique_count"], ["cardinality_ratio"])


@query("basic_info", "SELECT count(*) AS n_rows, 2 AS n_columns, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) AS BIGINT) AS duplicates FROM customer")
def basic_info(spark, sf):
    i = DataAnalyzer(load(spark, sf, "customer").select("c_nationkey", "c_mktsegment")).get_basic_info()
    return small(spark, [(i["shape"][0], i["shape"][1], i["duplicates"])], "n_rows long, n_columns int, duplicates long")


_IQR = "SELECT '{c}' AS \"column\", round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n FROM t, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t) GROUP BY q1, q3 HAVING n > 0"


def _outliers(spark, found):
    return small(spark, [(c, round(o.low, 4), round(o.high, 4), o.count) for c, o in found.items()], "column string, low double, high double, n long")


@query("outliers_iqr", f"WITH t AS (SELECT {EVENT} FROM events) " + each(["value", "user_id"], _IQR))
def outliers_iqr(spark, sf):
    return _outliers(spark, DataAnalyzer(load(spark, sf, "events", EVENT)).detect_outliers_iqr(["value", "user_id"]))


@query("outliers_zscore", f"WITH t AS (SELECT {EVENT} FROM events) SELECT 'value' AS \"column\", round(m - 3 * s, 4) AS low, round(m + 3 * s, 4) AS high, count(*) FILTER (WHERE abs((value - m) / s) > 3) AS n FROM t, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM t) GROUP BY m, s")
def outliers_zscore(spark, sf):
    return _outliers(spark, DataAnalyzer(load(spark, sf, "events", EVENT)).detect_outliers_zscore(["value"]))


_PAIRS = [("qty", "price"), ("qty", "discount"), ("qty", "tax"), ("price", "discount"), ("price", "tax"), ("discount", "tax")]


def _matrix(pair: str) -> str:
    both = [f"SELECT '{x}' AS feature1, '{y}' AS feature2, {pair.format(a=a, b=b)}" for a, b in _PAIRS for x, y in ((a, b), (b, a))]
    return "\nUNION ALL\n".join(both + [f"SELECT '{c}', '{c}', 1.0" for c in ("qty", "price", "discount", "tax")])


@query("corr_pearson", f"WITH t AS (SELECT {LINE} FROM lineitem) " + _matrix("round(corr({a}, {b}), 4) AS correlation FROM t"))
def corr_pearson(spark, sf):
    df = load(spark, sf, "lineitem", LINE).select("qty", "price", "discount", "tax")
    return long(DataAnalyzer(df).get_correlation_matrix(), ["feature1", "feature2"], ["correlation"])


_RANKS = "(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS rb FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query("corr_spearman", f"WITH t AS (SELECT {LINE} FROM lineitem) " + _matrix("round(corr(ra, rb), 4) AS correlation FROM " + _RANKS))
def corr_spearman(spark, sf):
    df = load(spark, sf, "lineitem", LINE).select("qty", "price", "discount", "tax")
    return long(DataAnalyzer(df).get_correlation_matrix("spearman"), ["feature1", "feature2"], ["correlation"])


@query(
    "corr_kendall",
    "WITH c AS (SELECT l_discount AS x, l_tax AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), p AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b), t AS (SELECT sum(n) AS n FROM c), "
    "tx AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(n) AS m FROM c GROUP BY x)), ty AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(n) AS m FROM c GROUP BY y)) "
    "SELECT 'l_discount' AS feature1, 'l_tax' AS feature2, round(s / sqrt((n * (n - 1) / 2 - tx.v) * (n * (n - 1) / 2 - ty.v)), 4) AS correlation FROM p, t, tx, ty",
)
def corr_kendall(spark, sf):
    got = DataAnalyzer(load(spark, sf, "lineitem")).correlations("kendall", ["l_discount", "l_tax"])
    return small(spark, [(a, b, round(r, 4)) for (a, b), r in got.items()], "feature1 string, feature2 string, correlation double")


@query("high_correlations", "WITH t AS (SELECT l_quantity AS a, l_quantity * 2 + l_tax AS b, l_tax AS c FROM lineitem) SELECT * FROM (SELECT 'a' AS feature1, 'b' AS feature2, round(corr(a, b), 4) AS correlation FROM t UNION ALL SELECT 'a', 'c', round(corr(a, c), 4) FROM t UNION ALL SELECT 'b', 'c', round(corr(b, c), 4) FROM t) WHERE abs(correlation) >= 0.7")
def high_correlations(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_quantity AS a", "l_quantity * 2 + l_tax AS b", "l_tax AS c")
    return long(DataAnalyzer(df).get_high_correlations(0.7), ["feature1", "feature2"], ["correlation"])


@query("vif", f"WITH t AS (SELECT {LINE} FROM lineitem), f AS (SELECT coalesce(qty, (SELECT avg(qty) FROM t)) AS qty, price FROM t), v AS (SELECT round(1 / (1 - corr(qty, price) * corr(qty, price)), 4) AS vif FROM f) SELECT 'qty' AS feature, vif FROM v UNION ALL SELECT 'price', vif FROM v")
def vif(spark, sf):
    got = DataAnalyzer(load(spark, sf, "lineitem", LINE)).calculate_vif(["qty", "price"])
    return got.select("feature", F.round("VIF", 4).alias("vif"))


@query("misclassified", each(["l_linenumber", "l_quantity", "l_discount", "l_tax"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, count({c}) AS total_count, round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio FROM lineitem HAVING count(DISTINCT {c}) <= 10 OR count(DISTINCT {c}) / count({c}) < 0.05"))
def misclassified(spark, sf):
    df = load(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax")
    return DataAnalyzer(df).detect_misclassified_categorical().select("column", "unique_count", "total_count", F.round("unique_ratio", 6).alias("unique_ratio"))


@query("suggest_binning", "WITH t AS (SELECT value AS v FROM events), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, skewness(v) AS s, count(DISTINCT v) AS u, count(v) AS n FROM t) SELECT 'value' AS \"column\", u AS unique_count, round(s, 4) AS skewness, round(100.0 * (SELECT count(*) FROM t, q WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) / n, 4) AS outlier_percent, CASE WHEN abs(s) > 1 THEN 'quantile' END AS strategy, CAST(least(10, greatest(5, u // 20)) AS INTEGER) AS n_bins, CASE WHEN abs(s) > 2 THEN 3 ELSE 2 END AS priority FROM q")
def suggest_binning(spark, sf):
    got = DataAnalyzer(load(spark, sf, "events").select("value")).suggest_binning()
    return got.select("column", "unique_count", F.round("skewness", 4).alias("skewness"), F.round("outlier_percent", 4).alias("outlier_percent"), "strategy", "n_bins", "priority")


@query("histogram", "WITH r AS (SELECT min(value) AS a, (max(value) - min(value)) / 30 AS w FROM events) SELECT CAST(least(floor((value - a) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM events, r GROUP BY 1")
def histogram(spark, sf):
    return DataAnalyzer(load(spark, sf, "events")).histogram("value").select("bin", "n")


# -- missing values


def _imputed(name: str, sql: str, **kw):
    @query(name, sql)
    def run(spark, sf):
        got = DataPreprocessor(load(spark, sf, "events", EVENT), order_by="event_id").handle_missing_values(columns=["value"], **kw)
        return got.select("event_id", F.round("value", 4).alias("value"))


_E = f"WITH t AS (SELECT {EVENT} FROM events) "
_imputed("impute_drop", _E + "SELECT event_id, round(value, 4) AS value FROM t WHERE value IS NOT NULL", strategy="drop")
_imputed("impute_fill_value", _E + "SELECT event_id, round(coalesce(value, -1.5), 4) AS value FROM t", strategy="fill_value", fill_value=-1.5)
_imputed("impute_mean", _E + "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM t)), 4) AS value FROM t", strategy="mean")
_imputed("impute_median", _E + "SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM t)), 4) AS value FROM t", strategy="median")
_imputed("impute_ffill", _E + "SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id), 4) AS value FROM t", strategy="forward_fill")
_imputed("impute_bfill", _E + "SELECT event_id, round(first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS value FROM t", strategy="backward_fill")
_imputed(
    "impute_interpolate",
    _E + ", n AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM t), w AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS v, first_value(value IGNORE NULLS) OVER b AS x, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS p, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS q FROM n WINDOW a AS (ORDER BY i), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN q IS NULL THEN v WHEN v IS NOT NULL THEN v + (x - v) * (i - p) / (q - p) END, 4) AS value FROM w",
    strategy="interpolate",
)


@query("impute_mode", f"WITH t AS (SELECT {ORDER} FROM orders) SELECT o_orderkey, coalesce(priority, (SELECT arg_min(priority, (-n, priority)) FROM (SELECT priority, count(*) AS n FROM t WHERE priority IS NOT NULL GROUP BY priority))) AS priority FROM t")
def impute_mode(spark, sf):
    return DataPreprocessor(load(spark, sf, "orders", ORDER)).handle_missing_values("mode", ["priority"]).select("o_orderkey", "priority")


@query("missing_indicators", _E + "SELECT event_id, CAST(value IS NULL AS INTEGER) AS value_was_missing FROM t")
def missing_indicators(spark, sf):
    return DataPreprocessor(load(spark, sf, "events", EVENT)).create_missing_indicators(["value"]).select("event_id", "value_was_missing")


# -- rows


def _first(order: str) -> str:
    return f"SELECT c_custkey, c_nationkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey {order}) AS r FROM customer) WHERE r = 1"


def _deduplicated(name: str, sql: str, keep):
    @query(name, sql)
    def run(spark, sf):
        df = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        return DataPreprocessor(df, order_by="c_custkey").remove_duplicates(["c_nationkey", "c_mktsegment"], keep)


_deduplicated("dedup_first", _first("ASC"), "first")
_deduplicated("dedup_last", _first("DESC"), "last")


@query("dedup_none", "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1")
def dedup_none(spark, sf):
    return DataPreprocessor(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")).remove_duplicates(keep=False)


@query("dedup_subset", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def dedup_subset(spark, sf):
    return DataPreprocessor(load(spark, sf, "customer").select("c_nationkey", "c_mktsegment")).remove_duplicates()


@query("filter_rows", _E + "SELECT event_id, value FROM t WHERE value > 100")
def filter_rows(spark, sf):
    return DataPreprocessor(load(spark, sf, "events", EVENT)).filter_rows(lambda d: d["value"] > 100).select("event_id", "value")


@query("sample", "SELECT * EXCLUDE (u) FROM (SELECT *, substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 13) AS u FROM orders ORDER BY u LIMIT (SELECT CAST(round_even(0.1 * count(*), 0) AS BIGINT) FROM orders))")
def sample(spark, sf):
    return DataPreprocessor(load(spark, sf, "orders"), "o_orderkey").sample_data(frac=0.1, random_state=42)


# -- outliers and clipping

_B = _E + ", b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c, quantile_cont(value, 0.5) AS med, avg(value) AS m, stddev_samp(value) AS s FROM t) "
_LOW, _HIGH = "(a - 1.5 * (c - a))", "(c + 1.5 * (c - a))"
_ZLOW, _ZHIGH = "(m - 2 * s)", "(m + 2 * s)"


def _handled(name: str, sql: str, **kw):
    @query(name, _B + sql)
    def run(spark, sf):
        got = DataPreprocessor(load(spark, sf, "events", EVENT)).handle_outliers(["value"], threshold=2.0, **kw)
        return got.select("event_id", F.round("value", 4).alias("value"))


for _m, _lo, _hi, _is in (("iqr", _LOW, _HIGH, f"(value < {_LOW} OR value > {_HIGH})"), ("zscore", _ZLOW, _ZHIGH, "(abs((value - m) / s) > 2)")):
    _handled(f"outlier_remove_{_m}", f"SELECT event_id, round(value, 4) AS value FROM t, b WHERE NOT coalesce({_is}, false)", method=_m, action="remove")
    _handled(f"outlier_cap_{_m}", f"SELECT event_id, round(CASE WHEN value < {_lo} THEN {_lo} WHEN value > {_hi} THEN {_hi} ELSE value END, 4) AS value FROM t, b", method=_m, action="cap")
    _handled(f"outlier_replace_{_m}", f"SELECT event_id, round(CASE WHEN {_is} THEN med ELSE value END, 4) AS value FROM t, b", method=_m, action="replace")


_WIDE = {c: f"CASE WHEN l_linenumber % {i + 2} = 0 THEN NULL ELSE {c} END" for i, c in enumerate(NUMBERS)}


@query("impute_mean_wide", "WITH t AS (SELECT l_orderkey, " + ", ".join(f"{x} AS {c}" for c, x in _WIDE.items()) + " FROM lineitem) SELECT l_orderkey, " + ", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM t)), 4) AS {c}" for c in _WIDE) + " FROM t")
def impute_mean_wide(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_orderkey", *(f"{x} AS {c}" for c, x in _WIDE.items()))
    return long(DataPreprocessor(df).handle_missing_values("mean", NUMBERS), ["l_orderkey"], NUMBERS)


@query(
    "outlier_remove_wide",
    "WITH b AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_c" for c in NUMBERS) + " FROM lineitem) SELECT l_orderkey, " + ", ".join(NUMBERS) + " FROM lineitem, b WHERE "
    + " AND ".join(f"{c} BETWEEN {c}_a - 1.5 * ({c}_c - {c}_a) AND {c}_c + 1.5 * ({c}_c - {c}_a)" for c in NUMBERS),
)
def outlier_remove_wide(spark, sf):
    return DataPreprocessor(load(spark, sf, "lineitem").select("l_orderkey", *NUMBERS)).handle_outliers(NUMBERS, action="remove")


@query("clip", _E + "SELECT event_id, round(CASE WHEN value < 10.5 THEN 10.5 WHEN value > 200.5 THEN 200.5 ELSE value END, 4) AS value FROM t")
def clip(spark, sf):
    return DataPreprocessor(load(spark, sf, "events", EVENT)).clip_values("value", 10.5, 200.5).select("event_id", F.round("value", 4).alias("value"))


# -- columns


@query("drop_columns", "SELECT c_custkey, c_nationkey FROM customer")
def drop_columns(spark, sf):
    return DataPreprocessor(load(spark, sf, "customer")).drop_columns(["c_name", "c_acctbal", "c_mktsegment", "nowhere"])


@query("rename_columns", "SELECT c_custkey AS id, c_nationkey AS nation FROM customer")
def rename_columns(spark, sf):
    return DataPreprocessor(load(spark, sf, "customer").select("c_custkey", "c_nationkey")).rename_columns({"c_custkey": "id", "c_nationkey": "nation", "x": "y"})


@query("reorder_columns", "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def reorder_columns(spark, sf):
    return DataPreprocessor(load(spark, sf, "customer")).reorder_columns(["c_mktsegment"])


@query("convert_dtypes", "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(c_custkey AS VARCHAR) AS text, c_name FROM customer")
def convert_dtypes(spark, sf):
    df = load(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey", "c_custkey AS text", "c_name")
    return DataPreprocessor(df).convert_dtypes({"c_nationkey": "float", "text": "str", "c_name": "int"})


@query("drop_constant", "SELECT l_orderkey, l_quantity FROM lineitem")
def drop_constant(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_quantity", "l_tax * 0 AS zero", "CAST(NULL AS STRING) AS none")
    return DataPreprocessor(df).remove_constant_columns()


@query("drop_high_cardinality", "SELECT c_nationkey, c_mktsegment FROM customer")
def drop_high_cardinality(spark, sf):
    return DataPreprocessor(load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).remove_high_cardinality_columns()


@query("custom_function", "SELECT c_custkey, round(abs(c_acctbal) * 2, 4) AS twice FROM customer")
def custom_function(spark, sf):
    got = DataPreprocessor(load(spark, sf, "customer")).apply_custom_function("c_acctbal", lambda c: F.abs(c) * 2, "twice")
    return got.select("c_custkey", F.round("twice", 4).alias("twice"))


@query("custom_python_function", "SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) AS short FROM customer")
def custom_python_function(spark, sf):
    return DataPreprocessor(load(spark, sf, "customer")).apply_custom_function("c_mktsegment", lambda s: s[:3].upper(), "short", return_type="string").select("c_custkey", "short")


@query("reset_index", "SELECT r_regionkey, r_name FROM region")
def reset_index(spark, sf):
    return DataPreprocessor(load(spark, sf, "region")).reset_index_clean()


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf):
    path = f"{shared_dir(spark)}/nation-{os.urandom(8).hex()}"
    write_csv(load(spark, sf, "nation"), path)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


# -- text

_TEXT = "concat('  ', upper(c_mktsegment), ' ', CAST(c_custkey AS VARCHAR), '-x  y  ')"
_OPS = {
    "strip": "trim(s)",
    "lower": "lower(s)",
    "upper": "upper(s)",
    "remove_punctuation": r"regexp_replace(s, '[^\p{L}\p{N}_\s]', '', 'g')",
    "remove_digits": r"regexp_replace(s, '\p{Nd}+', '', 'g')",
    "remove_extra_spaces": r"regexp_replace(s, '\s+', ' ', 'g')",
}


def _texts(spark, sf):
    return load(spark, sf, "customer").selectExpr("c_custkey", "concat('  ', upper(c_mktsegment), ' ', CAST(c_custkey AS STRING), '-x  y  ') AS s")


for _op, _sql in _OPS.items():
    query(f"clean_strings_{_op}", f"SELECT c_custkey, {_sql} AS s FROM (SELECT c_custkey, {_TEXT} AS s FROM customer)")(lambda spark, sf, op=_op: DataPreprocessor(_texts(spark, sf)).clean_string_columns(["s"], [op]))


@query(
    "clean_strings_title",
    rf"SELECT c_custkey, array_to_string(list_transform(generate_series(1, len(s)), lambda i: CASE WHEN i > 1 AND regexp_matches(s[i - 1], '\p{{L}}') THEN lower(s[i]) ELSE upper(s[i]) END), '') AS s FROM (SELECT c_custkey, {_TEXT} AS s FROM customer)",
)
def clean_strings_title(spark, sf):
    return DataPreprocessor(_texts(spark, sf)).clean_string_columns(["s"], ["title"])


@query("clean_strings_default", f"SELECT c_custkey, lower(trim(s)) AS s FROM (SELECT c_custkey, {_TEXT} AS s FROM customer)")
def clean_strings_default(spark, sf):
    return DataPreprocessor(_texts(spark, sf)).clean_string_columns(["s"])


@query("whitespace_variants", rf"SELECT c_custkey, regexp_replace(trim(s), '\s+', ' ', 'g') AS s FROM (SELECT c_custkey, {_TEXT} AS s FROM customer)")
def whitespace_variants(spark, sf):
    return DataPreprocessor(_texts(spark, sf)).handle_whitespace_variants(["s"])


@query("string_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length FROM documents")
def string_length(spark, sf):
    return DataPreprocessor(load(spark, sf, "documents").select("doc_id", "text")).extract_string_length(["text"]).select("doc_id", "text_length")


# -- quality

_INF = "event_id, CASE WHEN event_id % 100 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind, 5 AS five"


@query("infinite_values", f"SELECT 'value' AS \"column\", count(*) AS n FROM (SELECT {_INF} FROM events) WHERE isinf(value)")
def infinite_values(spark, sf):
    return small(spark, DataPreprocessor(load(spark, sf, "events", _INF)).detect_infinite_values().items(), "column string, n long")


@query("data_quality", f"WITH t AS (SELECT {_INF} FROM events) SELECT 'missing' AS issue, 'kind' AS \"column\", CAST(count(*) - count(kind) AS BIGINT) AS n FROM t UNION ALL SELECT 'constant', 'five', 1 UNION ALL SELECT 'cardinality', 'event_id', 1 UNION ALL SELECT 'infinite', 'value', count(*) FROM t WHERE isinf(value)")
def data_quality(spark, sf):
    q = DataPreprocessor(load(spark, sf, "events", _INF)).validate_data_quality()
    rows = [("missing", c, m["count"]) for c, m in q["missing_values"].items()]
    rows += [("constant", c, 1) for c in q["constant_columns"]] + [("cardinality", c, 1) for c in q["high_cardinality_columns"] if c != "value"]
    return small(spark, rows + [("infinite", c, n) for c, n in q["infinite_values"].items()], "issue string, column string, n long")


# -- features


@query("label_encode", f"WITH t AS (SELECT {ORDER} FROM orders) SELECT o_orderkey, CASE WHEN priority IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY priority NULLS LAST) - 1 AS INTEGER) END AS priority FROM t")
def label_encode(spark, sf):
    return FeatureEngineer(load(spark, sf, "orders", ORDER)).encode_categorical_label(["priority"]).select("o_orderkey", "priority")


@query("onehot", f"WITH t AS (SELECT {ORDER} FROM orders) SELECT o_orderkey, " + ", ".join(f"coalesce(CAST(priority = '{p}' AS INTEGER), 0) AS \"p_{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + ", CAST(priority IS NULL AS INTEGER) AS p_nan FROM t")
def onehot(spark, sf):
    return FeatureEngineer(load(spark, sf, "orders", ORDER).select("o_orderkey", "priority")).encode_categorical_onehot(["priority"], prefix="p", dummy_na=True)


@query("ordinal_encode", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 0.0 WHEN 'BUILDING' THEN 1.0 ELSE -1.0 END::DOUBLE AS c_mktsegment FROM customer")
def ordinal_encode(spark, sf):
    return FeatureEngineer(load(spark, sf, "customer")).encode_categorical_ordinal("c_mktsegment", ["MACHINERY", "BUILDING"]).select("c_custkey", "c_mktsegment")


def _scaled(method: str, expr: str):
    @query(f"scale_{method}", _E + f"SELECT event_id, round({expr}, 4) AS value FROM t, (SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM t)")
    def run(spark, sf):
        return FeatureEngineer(load(spark, sf, "events", EVENT)).scale_features(["value"], method).select("event_id", F.round("value", 4).alias("value"))


_scaled("standard", "(value - m) / s")
_scaled("minmax", "(value - lo) / (hi - lo)")
_scaled("robust", "(value - b) / (c - a)")


def _polynomial(name: str, columns: dict[str, str], **kw):
    @query(name, "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({v}, 4) AS {k}" for k, v in columns.items()) + " FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem)")
    def run(spark, sf):
        df = load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS q", "l_discount AS d", "l_tax AS t")
        got = FeatureEngineer(df).create_polynomial_features(["q", "d", "t"], **kw)
        return long(got, ["l_orderkey", "l_linenumber"], list(columns))


_SQ, _X = {"q_squared": "q * q", "d_squared": "d * d", "t_squared": "t * t"}, {"q_x_d": "q * d", "q_x_t": "q * t", "d_x_t": "d * t"}
_polynomial("poly2", _SQ | _X)
_polynomial("poly2_interactions", _X, interaction_only=True)
_polynomial("poly3", _SQ | {"q_cubed": "q * q * q", "d_cubed": "d * d * d", "t_cubed": "t * t * t"}, degree=3)
_polynomial("poly3_interactions", {"q_x_d_x_t": "q * d * t"}, degree=3, interaction_only=True)


def _binned(name: str, sql: str, **kw):
    @query(name, sql)
    def run(spark, sf):
        df = load(spark, sf, "events", EVENT)
        return FeatureEngineer(df).create_binning("value", **kw).select("event_id", "value_binned")


_L = ["b0", "b1", "b2", "b3"]


def _between(edges: list[str], lowest: bool) -> str:
    whens = [f"WHEN value {'>=' if i == 0 and lowest else '>'} {a} AND value <= {b} THEN 'b{i}'" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return "CASE " + " ".join(whens) + " END AS value_binned"


_binned("bin_quantile", _E + f"SELECT event_id, {_between(['q[1]', 'q[2]', 'q[3]', 'q[4]', 'q[5]'], True)} FROM t, (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM t)", bins=4, labels=_L)
_binned("bin_uniform", _E + f"SELECT event_id, {_between(['lo - 0.001 * (hi - lo)', 'lo + (hi - lo) * 1 / 4', 'lo + (hi - lo) * 2 / 4', 'lo + (hi - lo) * 3 / 4', 'hi'], False)} FROM t, (SELECT min(value) AS lo, max(value) AS hi FROM t)", bins=4, labels=_L, strategy="uniform")
_binned("bin_edges", _E + f"SELECT event_id, {_between(['0', '10', '50', '100', '1000'], False)} FROM t", bins=[0, 10, 50, 100, 1000], labels=_L)


@query("log", "SELECT c_custkey, round(ln(c_acctbal + abs((SELECT min(c_acctbal) FROM customer)) + 1), 4) AS c_acctbal_log FROM customer")
def log_transform(spark, sf):
    return FeatureEngineer(load(spark, sf, "customer")).create_log_transform(["c_acctbal"]).select("c_custkey", F.round("c_acctbal_log", 4).alias("c_acctbal_log"))


@query("sqrt", _E + "SELECT event_id, round(sqrt(value), 4) AS value_sqrt FROM t")
def sqrt_transform(spark, sf):
    return FeatureEngineer(load(spark, sf, "events", EVENT)).create_sqrt_transform(["value"]).select("event_id", F.round("value_sqrt", 4).alias("value_sqrt"))


_DATES = {
    "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "dayofweek": "isodow(ts) - 1", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)", "quarter": "quarter(ts)",
    "dayofyear": "dayofyear(ts)", "weekofyear": "weekofyear(ts)", "is_weekend": "isodow(ts) >= 6", "is_month_start": "day(ts) = 1", "is_month_end": "CAST(ts AS DATE) = last_day(ts)",
}


@query("datetime_features", "SELECT event_id, " + ", ".join(f"CAST({v} AS INTEGER) AS ts_{k}" for k, v in _DATES.items()) + " FROM events")
def datetime_features(spark, sf):
    return FeatureEngineer(load(spark, sf, "events")).create_datetime_features("ts", list(_DATES)).select("event_id", *(f"ts_{k}" for k in _DATES))


_W = "OVER (PARTITION BY kind)"


@query("aggregations", f"SELECT event_id, CASE WHEN kind IS NOT NULL THEN round(avg(value) {_W}, 4) END AS value_kind_mean, CASE WHEN kind IS NOT NULL THEN round(sum(value) {_W}, 2) END AS value_kind_sum, CASE WHEN kind IS NOT NULL THEN round(stddev_samp(value) {_W}, 4) END AS value_kind_std, CASE WHEN kind IS NOT NULL THEN min(value) {_W} END AS value_kind_min, CASE WHEN kind IS NOT NULL THEN max(value) {_W} END AS value_kind_max FROM (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind FROM events)")
def aggregations(spark, sf):
    df = load(spark, sf, "events").selectExpr("event_id", "value", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind")
    got = FeatureEngineer(df).create_aggregations("kind", "value")
    return got.select("event_id", F.round("value_kind_mean", 4).alias("value_kind_mean"), F.round("value_kind_sum", 2).alias("value_kind_sum"), F.round("value_kind_std", 4).alias("value_kind_std"), "value_kind_min", "value_kind_max")


@query("ratio", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / (l_quantity + 1e-8), 4) AS unit FROM lineitem")
def ratio(spark, sf):
    got = FeatureEngineer(load(spark, sf, "lineitem")).create_ratio_features("l_extendedprice", "l_quantity", "unit")
    return got.select("l_orderkey", "l_linenumber", F.round("unit", 4).alias("unit"))


@query("flag", f"WITH t AS (SELECT {ORDER} FROM orders) SELECT o_orderkey, CAST(coalesce(priority = '5-LOW', false) AS INTEGER) AS priority_flag FROM t")
def flag(spark, sf):
    return FeatureEngineer(load(spark, sf, "orders", ORDER)).create_flag_features("priority", "5-LOW").select("o_orderkey", "priority_flag")


# -- selection


def _names(spark, names):
    return small(spark, [(n,) for n in names], "feature string")


def _selectable(spark, sf):
    return load(spark, sf, "lineitem").selectExpr("l_quantity AS q", "l_quantity * 3 + l_tax AS q3", "l_discount AS d", "l_tax AS t", "l_extendedprice AS p", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y")


_S = "WITH t AS (SELECT l_quantity AS q, l_quantity * 3 + l_tax AS q3, l_discount AS d, l_tax AS t, l_extendedprice AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem) "


@query("select_variance", _S + "SELECT f AS feature FROM (SELECT 'q' AS f, var_pop(q) AS v FROM t UNION ALL SELECT 'q3', var_pop(q3) FROM t UNION ALL SELECT 'd', var_pop(d) FROM t UNION ALL SELECT 't', var_pop(t) FROM t UNION ALL SELECT 'p', var_pop(p) FROM t) WHERE v > 0.01")
def select_variance(spark, sf):
    return _names(spark, FeatureSelector(_selectable(spark, sf), "y").select_by_variance(0.01))


@query("select_correlation", _S + "SELECT unnest(['q', 'd', 't'] || CASE WHEN (SELECT abs(corr(q, p)) FROM t) > 0.7 THEN [] ELSE ['p'] END) AS feature")
def select_correlation(spark, sf):
    return _names(spark, FeatureSelector(_selectable(spark, sf), "y").select_by_correlation(0.7))


@query("select_target_correlation", _S + "SELECT f AS feature FROM (SELECT 'q' AS f, corr(q, y) AS v FROM t UNION ALL SELECT 'q3', corr(q3, y) FROM t UNION ALL SELECT 'd', corr(d, y) FROM t UNION ALL SELECT 't', corr(t, y) FROM t UNION ALL SELECT 'p', corr(p, y) FROM t) ORDER BY abs(v) DESC LIMIT 2")
def select_target_correlation(spark, sf):
    return _names(spark, FeatureSelector(_selectable(spark, sf), "y").select_by_target_correlation(2))


def _anova_sql(c: str, group: str, rel: str) -> str:
    return f"(SELECT (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {rel}) AS g FROM {rel} GROUP BY {group}))"


def _scores(spark, selector, kind):
    return small(spark, [(c, round(s, 4)) for c, s in selector.feature_scores[kind].items()], "feature string, score double")


@query("select_f_classif", _S + each(["q", "q3", "d", "t", "p"], "SELECT '{c}' AS feature, round(" + _anova_sql("{c}", "y", "t") + ", 4) AS score"))
def select_f_classif(spark, sf):
    s = FeatureSelector(_selectable(spark, sf), "y")
    s.select_by_statistical_test(2)
    return _scores(spark, s, "f_classif")


@query("select_f_regression", _S + each(["q", "q3", "d", "t", "y"], "SELECT '{c}' AS feature, round(corr({c}, p) ** 2 / (1 - corr({c}, p) ** 2) * (count(*) - 2), 2) AS score FROM t"))
def select_f_regression(spark, sf):
    s = FeatureSelector(_selectable(spark, sf), "p")
    s.select_by_statistical_test(2, "regression")
    return small(spark, [(c, round(v, 2)) for c, v in s.feature_scores["f_regression"].items()], "feature string, score double")


@query("select_chi2", _S + each(["q", "d", "t"], "SELECT '{c}' AS feature, round(sum((s - e) * (s - e) / e), 4) AS score FROM (SELECT sum({c}) AS s, (SELECT sum({c}) FROM t) * count(*) / (SELECT count(*) FROM t) AS e FROM t GROUP BY y)"))
def select_chi2(spark, sf):
    s = FeatureSelector(_selectable(spark, sf).select("q", "d", "t", "y"), "y")
    s.select_by_statistical_test(2, score_func="chi2")
    return _scores(spark, s, "chi2")


@query("select_missing", "SELECT unnest(['event_id', 'value']) AS feature")
def select_missing(spark, sf):
    df = load(spark, sf, "events", EVENT).selectExpr("event_id", "value", "CASE WHEN event_id % 3 < 2 THEN NULL ELSE event_type END AS rare")
    return _names(spark, FeatureSelector(df).select_by_missing_values(0.5))


@query("select_importance")
def select_importance(spark, sf):
    s = FeatureSelector(_selectable(spark, sf), "y")
    s.select_by_importance(3, n_estimators=10)
    return s.get_feature_importance_df()


@query("select_auto")
def select_auto(spark, sf):
    df, selector = select_features_auto(_selectable(spark, sf), "y", max_features=3)
    return selector.get_feature_importance_df()


@query("apply_selection", _S + "SELECT q, d, y FROM t")
def apply_selection(spark, sf):
    return FeatureSelector(_selectable(spark, sf), "y").apply_selection(["q", "d", "nowhere"])


# -- the target


@query("class_distribution", "SELECT o_orderstatus AS class, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percentage, round(max(count(*)) OVER () / count(*), 4) AS imbalance_ratio FROM orders GROUP BY o_orderstatus")
def class_distribution(spark, sf):
    got = TargetAnalyzer(load(spark, sf, "orders").select("o_orderstatus", "o_totalprice"), "o_orderstatus").analyze_class_distribution()
    return long(got, ["class", "count"], ["percentage", "imbalance_ratio"])


@query("class_imbalance", "WITH c AS (SELECT toxic AS k, count(*) AS n FROM labels GROUP BY toxic) SELECT round(max(n) / min(n), 4) AS imbalance_ratio, CASE WHEN max(n) / min(n) > 3 THEN 'severe' WHEN max(n) / min(n) > 1.5 THEN 'moderate' ELSE 'none' END AS severity, arg_max(k, n) AS majority, arg_min(k, n) AS minority FROM c")
def class_imbalance(spark, sf):
    i = TargetAnalyzer(load(spark, sf, "labels"), "toxic").get_class_imbalance_info()
    return small(spark, [(round(i["imbalance_ratio"], 4), i["severity"], i["majority_class"], i["minority_class"])], "imbalance_ratio double, severity string, majority int, minority int")


@query("task_info", "SELECT 'classification' AS task, count(DISTINCT o_orderstatus) AS unique_values, count(*) - count(o_orderstatus) AS missing_count FROM orders")
def task_info(spark, sf):
    i = TargetAnalyzer(load(spark, sf, "orders"), "o_orderstatus").get_task_info()
    return small(spark, [(i["task"], i["unique_values"], i["missing_count"])], "task string, unique_values long, missing_count long")


_TARGET = ["count", "mean", "median", "std", "min", "max", "range", "q25", "q75", "iqr", "skewness", "kurtosis", "outlier_count"]


@query("target_distribution", "WITH t AS (SELECT o_totalprice AS y FROM orders), m AS (SELECT count(y) AS count, avg(y) AS mean, quantile_cont(y, 0.5) AS median, stddev_samp(y) AS std, min(y) AS min, max(y) AS max, max(y) - min(y) AS range, quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.75) AS q75, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, skewness(y) AS skewness, kurtosis(y) AS kurtosis FROM t) SELECT " + ", ".join(f"round(CAST({k} AS DOUBLE), 4) AS {k}" for k in _TARGET[:-1]) + ", CAST((SELECT count(*) FROM t, m WHERE y < q25 - 1.5 * iqr OR y > q75 + 1.5 * iqr) AS DOUBLE) AS outlier_count FROM m")
def target_distribution(spark, sf):
    d = TargetAnalyzer(load(spark, sf, "orders").select("o_totalprice"), "o_totalprice", "regression").analyze_target_distribution()
    return small(spark, [tuple(round(float(d[k]), 4) for k in _TARGET)], ", ".join(f"{k} double" for k in _TARGET))


def _related(spark, sf, **kw):
    df = load(spark, sf, "lineitem", LINE).select("qty", "price", "discount", "status", "flag")
    return TargetAnalyzer(df, "flag", "classification").analyze_feature_target_relationship(**kw)


_T = f"WITH t AS (SELECT {LINE} FROM lineitem) "


@query("anova", _T + each(["qty", "price", "discount"], "SELECT '{c}' AS feature, round(" + _anova_sql("{c}", "flag", "t") + ", 4) AS f, round((SELECT sum(n * (m - g) * (m - g)) / (sum(n * (m - g) * (m - g)) + sum(n * v)) FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM t) AS g FROM t GROUP BY flag)), 6) AS eta_squared"))
def anova(spark, sf):
    return _related(spark, sf).filter("test_type = 'anova'").select("feature", F.round("statistic", 4).alias("f"), F.round("effect_size", 6).alias("eta_squared"))


_CHI = "c AS (SELECT status, flag, count(*) AS n FROM t GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY status) * sum(n) OVER (PARTITION BY flag) / sum(n) OVER () AS x FROM c)"


@query("chi_square", _T + ", " + _CHI + " SELECT 'status' AS feature, round(sum((n - x) * (n - x) / x), 4) AS chi2, round(sqrt(sum((n - x) * (n - x) / x) / sum(n)), 6) AS cramers_v FROM e")
def chi_square(spark, sf):
    return _related(spark, sf).filter("test_type = 'chi_square'").select("feature", F.round("statistic", 4).alias("chi2"), F.round("effect_size", 6).alias("cramers_v"))


@query("feature_target_relationship")
def feature_target_relationship(spark, sf):
    return _related(spark, sf, check_assumptions=True)


_KW = "r AS (SELECT flag, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0::DOUBLE AS k FROM t WHERE qty IS NOT NULL), g AS (SELECT count(*)::DOUBLE AS n, sum(k) AS s FROM r GROUP BY flag), z AS (SELECT sum(m * m * m - m) AS v FROM (SELECT count(*)::DOUBLE AS m FROM t WHERE qty IS NOT NULL GROUP BY qty))"


@query("kruskal", _T + ", " + _KW + " SELECT round((12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - max(z.v) / (sum(n) ** 3 - sum(n))), 3) AS h FROM g, z")
def kruskal(spark, sf):
    h, _ = TargetAnalyzer(load(spark, sf, "lineitem", LINE), "flag", "classification").kruskal("qty")
    return small(spark, [(round(h, 3),)], "h double")


@query("levene", _T + ", d AS (SELECT flag, abs(price - quantile_cont(price, 0.5) OVER (PARTITION BY flag)) AS a FROM t) SELECT round(" + _anova_sql("a", "flag", "d") + ", 4) AS w")
def levene(spark, sf):
    w, _ = TargetAnalyzer(load(spark, sf, "lineitem", LINE), "flag", "classification").levene("price")
    return small(spark, [(round(w, 4),)], "w double")


_AB = "(SELECT avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS mb, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS va, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS vb, count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag = 'N') AS nb FROM lineitem)"


@query("cohens_d", f"SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM {_AB}")
def cohens_d(spark, sf):
    r = load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("m"), F.var_samp("l_extendedprice").alias("v")).collect()
    g = {x["l_returnflag"]: (x["n"], x["m"], x["v"]) for x in r}
    return small(spark, [(round(st.cohens_d_from(g["A"], g["N"])["cohens_d"], 6),)], "d double")


@query("mean_ci", "SELECT round(avg(value) - 1.9602012636 * stddev_samp(value) / sqrt(count(*)), 2) AS low, round(avg(value) + 1.9602012636 * stddev_samp(value) / sqrt(count(*)), 2) AS high FROM events")
def mean_ci(spark, sf):
    r = load(spark, sf, "events").agg(F.count("value"), F.avg("value"), F.stddev_samp("value")).first()
    low, high = st.mean_ci_from(*r)
    return small(spark, [(round(low, 2), round(high, 2))], "low double, high double")


_P = [0.01, 0.04, 0.03, 0.5, 0.002, 0.04]
_PV = "(SELECT unnest(" + str(_P) + ") AS p, generate_subscripts(" + str(_P) + ", 1) AS i)"


def _corrected(name: str, method: str, sql: str):
    @query(name, sql)
    def run(spark, sf):
        got = st.apply_multiple_testing_correction(_P, method)
        return small(spark, [(i + 1, round(float(q), 6), bool(r)) for i, (q, r) in enumerate(zip(got["corrected_pvalues"], got["reject"], strict=True))], "i long, p double, reject boolean")


_corrected("fdr_bh", "fdr_bh", f"SELECT i, round(q, 6) AS p, q <= 0.05 AS reject FROM (SELECT i, least(1, min(p * 6 / r) OVER (ORDER BY p DESC, r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS q FROM (SELECT i, p::DOUBLE AS p, row_number() OVER (ORDER BY p, i) AS r FROM {_PV}))")
_corrected("fdr_by", "fdr_by", f"SELECT i, round(q, 6) AS p, q <= 0.05 AS reject FROM (SELECT i, least(1, min(p * 6 * 2.45 / r) OVER (ORDER BY p DESC, r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS q FROM (SELECT i, p::DOUBLE AS p, row_number() OVER (ORDER BY p, i) AS r FROM {_PV}))")
_corrected("bonferroni", "bonferroni", f"SELECT i, round(least(1, p * 6)::DOUBLE, 6) AS p, p * 6 <= 0.05 AS reject FROM {_PV}")
_corrected("holm", "holm", f"SELECT i, round(q, 6) AS p, q <= 0.05 AS reject FROM (SELECT i, least(1, max(p * (7 - r)) OVER (ORDER BY r))::DOUBLE AS q FROM (SELECT i, p::DOUBLE AS p, row_number() OVER (ORDER BY p, i) AS r FROM {_PV}))")


@query("feature_target_correlation", "SELECT * FROM (" + each(["l_quantity", "l_discount", "l_tax"], "SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 4) AS correlation, count(*) AS n FROM lineitem") + ")")
def feature_target_correlation(spark, sf):
    df = load(spark, sf, "lineitem").select(*NUMBERS)
    got = TargetAnalyzer(df, "l_extendedprice", "regression").analyze_feature_correlations(include_ci=True)
    return got.select("feature", F.round("correlation", 4).alias("correlation"), "n")


def _mi(c: str) -> str:
    return f"(SELECT sum(p * ln(p / (px * py))) FROM (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM (SELECT len(list_filter(list_distinct(q), lambda b: {c} > b)) AS x, flag AS y, count(*)::DOUBLE AS n FROM f, (SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM f) GROUP BY ALL)))"


@query("mi_binned", _T + ", f AS (SELECT coalesce(qty, 0) AS qty, price, discount, flag FROM t) " + each(["qty", "price", "discount"], "SELECT '{c}' AS feature, round(greatest(0, " + _mi("{c}") + "), 6) AS mi"))
def mi_binned(spark, sf):
    df = load(spark, sf, "lineitem", LINE).select("qty", "price", "discount", "flag")
    return TargetAnalyzer(df, "flag", "classification").analyze_mutual_information().select("feature", F.round("mi", 6).alias("mi"))


@query("mi_knn")
def mi_knn(spark, sf):
    df = load(spark, sf, "lineitem", LINE).select("qty", "price", "discount", "flag")
    return TargetAnalyzer(df, "flag", "classification").analyze_mutual_information(estimator="knn")


@query("residuals", "SELECT round(avg(e), 4) AS mean, round(stddev_samp(e), 4) AS std, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem)")
def residuals(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_extendedprice AS y", "l_quantity * 1500 AS p")
    r = TargetAnalyzer(df, "y", "regression").analyze_residuals("p")
    return small(spark, [(round(r["residual_mean"], 4), round(r["residual_std"], 4), round(r["mae"], 4), round(r["rmse"], 4), round(r["r2"], 6))], "mean double, std double, mae double, rmse double, r2 double")


@query("target_quality", _T + "SELECT 'missing' AS issue, 'qty' AS feature, CAST(count(*) - count(qty) AS BIGINT) AS n FROM t UNION ALL SELECT 'constant', 'zero', 1 UNION ALL SELECT 'leak', 'price_too', 1")
def target_quality(spark, sf):
    df = load(spark, sf, "lineitem", LINE).selectExpr("qty", "discount", "price", "price * 2 + tax AS price_too", "tax * 0 AS zero")
    q = TargetAnalyzer(df, "price", "regression").analyze_data_quality()
    rows = [("missing", c, m["count"]) for c, m in q["missing_values"].items()] + [("constant", c, 1) for c in q["constant_features"]]
    return small(spark, rows + [("leak", s["feature"], 1) for s in q["leakage_suspects"]], "issue string, feature string, n long")


# -- single tests and sizes


def _groups(spark, sf):
    """(n, mean, sample variance) of prices by flag."""
    g = load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("m"), F.var_samp("l_extendedprice").alias("v"))
    return [(r["n"], r["m"], r["v"]) for r in g.orderBy("l_returnflag").collect()]


_G = "WITH g AS (SELECT count(*)::DOUBLE AS n, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag), s AS (SELECT sum(n) AS n, count(*)::DOUBLE AS k, sum((n - 1) * v) AS w, sum((n - 1) * ln(v)) AS l, sum(1 / (n - 1)) AS c FROM g)"


@query("bartlett", _G + ", t AS (SELECT ((n - k) * ln(w / (n - k)) - l) / (1 + (c - 1 / (n - k)) / (3 * (k - 1))) AS t FROM s) SELECT round(t, 6) AS t, round(exp(-t / 2), 6) AS p FROM t")
def bartlett(spark, sf):
    t, p = st.bartlett([(n, v) for n, _, v in _groups(spark, sf)])
    return small(spark, [(round(t, 6), round(p, 6))], "t double, p double")


_R = "(SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem)"


@query("correlation_ci", f"SELECT round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM {_R}")
def correlation_ci(spark, sf):
    ((r, n),) = pearsons(load(spark, sf, "lineitem"), [("l_quantity", "l_extendedprice")]).values()
    got = st.calculate_correlation_ci(r, n)
    return small(spark, [(round(r, 6), round(got["ci_lower"], 6), round(got["ci_upper"], 6))], "r double, low double, high double")


@query("pearson_to_d", f"SELECT round(2 * r / sqrt(1 - r * r), 6) AS d FROM {_R}")
def pearson_to_d(spark, sf):
    ((r, _),) = pearsons(load(spark, sf, "lineitem"), [("l_quantity", "l_extendedprice")]).values()
    return small(spark, [(round(st.pearson_r_to_d(r), 6),)], "d double")


def _cells(spark, sf):
    t = load(spark, sf, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0).orderBy("l_linestatus").collect()
    return [list(r)[1:] for r in t]


_X = "WITH c AS (SELECT l_linestatus AS a, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag AS b, count(*)::DOUBLE AS m FROM lineitem GROUP BY 1), e AS (SELECT a, b, n * m / (SELECT count(*) FROM lineitem) AS e FROM c, d)"


@query("expected_frequencies", _X + " SELECT round(min(e), 4) AS least, round(100.0 * avg(CASE WHEN e < 5 THEN 1 ELSE 0 END), 4) AS percent_below, avg(CASE WHEN e < 5 THEN 1 ELSE 0 END) < 0.2 AS valid FROM e")
def expected_frequencies(spark, sf):
    got = st.check_chi2_expected_frequencies(_cells(spark, sf))
    return small(spark, [(round(got["min_expected"], 4), round(got["percent_below"], 4), bool(got["valid"]))], "least double, percent_below double, valid boolean")


@query("cramers_v_corrected", _X + ", o AS (SELECT l_linestatus AS a, l_returnflag AS b, count(*) AS o FROM lineitem GROUP BY ALL), z AS (SELECT sum((coalesce(o, 0) - e) ** 2 / e) AS x, sum(coalesce(o, 0))::DOUBLE AS n FROM e LEFT JOIN o USING (a, b)) SELECT round(sqrt(greatest(0, x / n - 2 / (n - 1)) / (least(2 - 1 / (n - 1), 3 - 4 / (n - 1)) - 1)), 6) AS v, round(sqrt(x / n), 6) AS uncorrected FROM z")
def cramers_v_corrected(spark, sf):
    got = st.cramers_v(_cells(spark, sf), bias_correction=True)
    return small(spark, [(round(got["cramers_v"], 6), round(got["cramers_v_uncorrected"], 6))], "v double, uncorrected double")


@query("sample_size", "SELECT bool_and(n >= 30) AS ttest, sum(n) >= 30 * count(*) AS chi2 FROM (SELECT count(*) AS n FROM labels GROUP BY toxic, quality)")
def sample_size(spark, sf):
    groups = [r["v"] for r in load(spark, sf, "labels").groupBy("toxic", "quality").agg(F.collect_list(F.lit(1.0)).alias("v")).collect()]
    return small(spark, [tuple(bool(st.validate_sample_size(groups, t)["sufficient"]) for t in ("ttest", "chi2"))], "ttest boolean, chi2 boolean")


_K2 = (
    "WITH t AS (SELECT n_chars::DOUBLE AS x FROM documents), m AS (SELECT count(x)::DOUBLE AS n, avg(x) AS u FROM t), k AS (SELECT max(n) AS n, avg((x - u) ** 3) / avg((x - u) ** 2) ** 1.5 AS g1, avg((x - u) ** 4) / avg((x - u) ** 2) ** 2 AS b2 FROM t, m), "
    "a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, "
    "(b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS z, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS c FROM k), "
    "b AS (SELECT *, 6 + 8 / c * (2 / c + sqrt(1 + 4 / (c * c))) AS a FROM a), d AS (SELECT *, 1 + z * sqrt(2 / (a - 4)) AS d FROM b), "
    "e AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * a) - sign(d) * (abs((1 - 2 / a) / d)) ** (1.0::DOUBLE / 3)) / sqrt(2 / (9 * a)) AS z2 FROM d) "
    "SELECT round(z1 * z1 + z2 * z2, 2) AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p FROM e"
)


@query("normaltest", _K2)
def normaltest(spark, sf):
    got = DataAnalyzer(load(spark, sf, "documents").select("n_chars")).check_normality("n_chars", "normaltest")
    return small(spark, [(round(float(got["statistic"]), 2), round(float(got["p_value"]), 6))], "k2 double, p double")


@query("select_callable", _S + each(["q", "q3", "d", "t", "p"], "SELECT '{c}' AS feature, round(max({c}) - min({c}), 4) AS score FROM t"))
def select_callable(spark, sf):
    def widths(df, features, target):
        r = df.agg(*((F.max(c) - F.min(c)).alias(c) for c in features)).first()
        return {c: r[c] for c in features}

    s = FeatureSelector(_selectable(spark, sf), "y")
    s.select_by_statistical_test(2, score_func=widths)
    return _scores(spark, s, "custom")


@query("target_vif", "SELECT unnest(['l_discount', 'l_tax']) AS feature, round(1 / (1 - (SELECT corr(l_discount, l_tax) FROM lineitem) ** 2), 6) AS vif")
def target_vif(spark, sf):
    df = load(spark, sf, "lineitem").select("l_discount", "l_tax", "l_returnflag")
    return TargetAnalyzer(df, "l_returnflag").calculate_vif().select("feature", F.round("VIF", 6).alias("vif"))


@query("flag_callable", "SELECT event_id, CAST(CASE WHEN value > 100 THEN 1 ELSE 0 END AS INTEGER) AS large FROM events")
def flag_callable(spark, sf):
    return FeatureEngineer(load(spark, sf, "events").select("event_id", "value")).create_flag_features("value", lambda v: v > 100, "large").select("event_id", "large")


# -- texts for people: rows only


def _target(spark, sf):
    return TargetAnalyzer(load(spark, sf, "orders").selectExpr("o_totalprice", "o_orderstatus", "length(o_orderpriority) AS len", "month(o_orderdate) AS month"), "o_orderstatus")


@query("full_report")
def full_report(spark, sf):
    return small(spark, [(k, str(v)) for k, v in _target(spark, sf).generate_full_report().items()], "section string, content string")


@query("summary_report")
def summary_report(spark, sf):
    return small(spark, enumerate(_target(spark, sf).generate_summary_report().split("\n")), "line int, text string")


def _suggested(c: str) -> str:
    """What the rules say of a numeric feature without nulls; with three classes the tail of F has a closed form."""
    f = "(sum(n * (m - g) * (m - g)) / 2) / (sum(n * v) / (sum(n) - 3))"
    p = f"(SELECT (1 + 2 * {f} / (sum(n) - 3)) ** (-(sum(n) - 3) / 2.0::DOUBLE) FROM (SELECT count(*)::DOUBLE AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM t) AS g FROM t GROUP BY o_orderstatus))"
    return (
        f"SELECT '{c}' AS feature, CASE WHEN k > 0 THEN 'Apply log or sqrt transformation' ELSE 'Apply square or exponential transformation' END AS suggestion, CASE WHEN abs(k) > 2 THEN 'high' ELSE 'medium' END AS priority, 'transformations' AS category FROM (SELECT skewness({c}) AS k FROM t) WHERE abs(k) > 1 "
        f"UNION ALL SELECT '{c}', 'Apply StandardScaler or MinMaxScaler', 'medium', 'scaling' FROM t HAVING max({c}) - min({c}) > 100 "
        f"UNION ALL SELECT '{c}', 'Bin into categorical groups', 'low', 'binning' WHERE {p} > 0.05"
    )


@query("suggest_features", "WITH t AS (SELECT o_totalprice, o_orderstatus, length(o_orderpriority) AS len, month(o_orderdate) AS month FROM orders) " + " UNION ALL ".join(map(_suggested, ["o_totalprice", "len", "month"])))
def suggest_features(spark, sf):
    rows = _target(spark, sf).suggest_feature_engineering()
    return small(spark, [(s["feature"], s["suggestion"], s["priority"], s["category"]) for s in rows], "feature string, suggestion string, priority string, category string")


@query(
    "recommend_models",
    "WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus), s AS (SELECT max(n) / min(n) AS r, sum(n) AS n FROM c) "
    "SELECT CASE WHEN r > 1.5 THEN 'Random Forest with class_weight=''balanced''' ELSE 'Random Forest' END AS model, 'high' AS priority FROM s "
    "UNION ALL SELECT 'XGBoost with scale_pos_weight', 'high' FROM s WHERE r > 1.5 UNION ALL SELECT 'Logistic Regression (penalty=l2)', 'medium' "
    "UNION ALL SELECT 'Support Vector Machine (SVM)', 'medium' FROM s WHERE n < 1000 UNION ALL SELECT 'Neural Network (MLP)', 'medium' FROM s WHERE n > 50000 "
    "UNION ALL SELECT 'LightGBM', CASE WHEN n > 50000 THEN 'high' ELSE 'medium' END FROM s UNION ALL SELECT 'Cross-Validation with multiple models', 'high' FROM s WHERE n < 1000",
)
def recommend_models(spark, sf):
    return small(spark, [(r["model"], r["priority"]) for r in _target(spark, sf).recommend_models()], "model string, priority string")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    df = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("n_chars", "toxic")
    return TargetAnalyzer(df, "toxic", "classification").analyze_class_wise_statistics(include_ci=True)


@query("normality")
def normality(spark, sf):
    orders = DataAnalyzer(load(spark, sf, "orders").select("o_totalprice"))
    got = [orders.check_normality("o_totalprice", m) for m in st.NORMALITY]
    return small(spark, [(g["method"], float(g["statistic"]), float(g["p_value"]), g["is_normal"]) for g in got], "method string, statistic double, p double, is_normal boolean")
