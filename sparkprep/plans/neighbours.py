"""Nearest neighbours of numbers within classes, over all rows: by ranges of values, with what crosses a range's ends settled by the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fused import bucket_count, bucket_of, quantile_bounds

EDGES = "bucket int, y string, x double"
PART = "done double, low double, high double"


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def interval(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends of what is nearer to each of the sorted values than its k-th nearest other one; the value itself if that is equal.

    On that neighbour's side the end is next to the neighbour, as adding the distance may round to it.
    """
    near, low, high = np.full(len(s), np.inf), s.copy(), s.copy()
    for below in range(k + 1):  # the window of k + 1 values that starts so many places below
        lo, hi = np.arange(len(s)) - below, np.arange(len(s)) - below + k
        ok = (lo >= 0) & (hi < len(s))
        a, b = s[np.clip(lo, 0, None)], s[np.clip(hi, None, len(s) - 1)]
        width = np.maximum(s - a, b - s)
        ok &= width < near
        near, low, high = np.where(ok, width, near), np.where(ok, np.where(s - a == width, a, s - width), low), np.where(ok, np.where(b - s == width, b, s + width), high)
    tied = near == 0
    return np.where(tied, s, np.nextafter(low, np.inf)), np.where(tied, s, np.nextafter(high, -np.inf))


def ross(points: DataFrame, k: int) -> float:
    """Ross's estimate of the mutual information of x (double) and y (string), neither null; ``points`` must be the same whenever it is read.

    Ranges by approximate quantiles hold the points. Each range tells the first and last k points of each class, which give the
    ranges above and below it exact distances to the k-th neighbour. A point's interval leaves its range only if it is one of
    k + 1 points of its class on a side of a bound, so those are few; all points are counted against them in one more scan.
    """
    sizes = {r["y"]: r["count"] for r in points.groupBy("y").count().collect()}
    alone = [y for y, n in sizes.items() if n < 2]
    if alone:
        points = points.join(points.groupBy("y").count().filter("count > 1").select("y"), "y", "left_semi")
        sizes = {y: n for y, n in sizes.items() if n > 1}
    total = sum(sizes.values())
    if not total:
        return 0.0
    bounds = quantile_bounds(points, F.col("x"), bucket_count(points.sparkSession))
    dealt = points.select(bucket_of(F.col("x"), bounds).cast("int").alias("bucket"), "x", "y")
    ends = np.array([-np.inf, *bounds, np.inf])

    def edge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x", kind="stable")
        group = rows.groupby("y")
        first, last = group.cumcount(), group.cumcount(ascending=False)
        return rows[(first < k) | (last < k)][["bucket", "y", "x"]]

    # 2k points of each class and range at most.
    edges = points.sparkSession.sparkContext.broadcast(dealt.groupBy("bucket").applyInPandas(edge, EDGES).toPandas().sort_values("x", kind="stable"))

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        at, near = int(rows["bucket"].iloc[0]), edges.value
        below = {y: g.to_numpy() for y, g in near[near["bucket"] < at].groupby("y").tail(k).groupby("y")["x"]}
        above = {y: g.to_numpy() for y, g in near[near["bucket"] > at].groupby("y").head(k).groupby("y")["x"]}
        low, high = [], []
        for y, g in rows.groupby("y")["x"]:
            x, before = np.sort(g.to_numpy()), below.get(y, np.empty(0))
            ends_of = interval(np.concatenate([before, x, above.get(y, np.empty(0))]), min(k, sizes[y] - 1))
            for some, end in zip((low, high), ends_of, strict=True):
                some.append(end[len(before) : len(before) + len(x)])
        low, high, s = np.concatenate(low), np.concatenate(high), np.sort(rows["x"].to_numpy())
        inside = (low > ends[at]) & (high <= ends[at + 1])
        m = np.searchsorted(s, high[inside], "right") - np.searchsorted(s, low[inside], "left")
        out = pd.DataFrame({"done": np.nan, "low": low[~inside], "high": high[~inside]})
        return pd.concat([pd.DataFrame({"done": [float(digamma(m).sum())], "low": [np.nan], "high": [np.nan]}), out])

    got = dealt.groupBy("bucket").applyInPandas(measure, PART).toPandas()
    crossing = got[got["low"].notna()]
    shared = points.sparkSession.sparkContext.broadcast((np.sort(crossing["low"].to_numpy()), np.sort(crossing["high"].to_numpy())))

    def count(batches):
        low, high = shared.value
        under, upto = np.zeros(len(low) + 1, np.int64), np.zeros(len(high) + 1, np.int64)
        for b in batches:  # a point is under the bounds after its place, and at most those from its place on
            under += np.bincount(np.searchsorted(low, b["x"], "right"), minlength=len(low) + 1)
            upto += np.bincount(np.searchsorted(high, b["x"], "left"), minlength=len(high) + 1)
        yield pd.DataFrame({"place": np.arange(len(low)), "under": under[:-1], "upto": upto[:-1]})

    done = got["done"].sum()
    if len(crossing):
        n = points.select("x").mapInPandas(count, "place long, under long, upto long").groupBy("place").agg(F.sum("under").alias("under"), F.sum("upto").alias("upto")).toPandas().sort_values("place")
        low, high = shared.value
        under = n["under"].to_numpy().cumsum()[np.searchsorted(low, crossing["low"])]
        upto = n["upto"].to_numpy().cumsum()[np.searchsorted(high, crossing["high"])]
        done += digamma(upto - under).sum()
    n = np.array(list(sizes.values()))
    used = np.minimum(k, n - 1)
    return float(digamma(np.array([total]))[0] + ((digamma(used) - digamma(n)) * n).sum() / total - done / total)
