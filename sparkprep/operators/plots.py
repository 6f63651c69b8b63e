"""Pictures of summed-up data. matplotlib is needed only to draw; every picture's data is a frame of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..plans.fused import draw, exact_quantiles, pearsons, small
from ..schema import number, quoted
from .profile import DataAnalyzer


def _pyplot():
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise ImportError("drawing needs matplotlib; the *_data functions don't") from e
    return plt


def _shown(plt, figure, show: bool):
    if show:
        plt.show()
    return figure


def bars(names, values, title, show):
    plt = _pyplot()
    figure, ax = plt.subplots()
    ax.bar(list(map(str, names)), values)
    ax.set_title(title)
    return _shown(plt, figure, show)


def heatmap(names, cells, title, show):
    plt = _pyplot()
    figure, ax = plt.subplots()
    grid = [[float("nan") if cells.get((a, b)) is None else cells[a, b] for b in names] for a in names]
    figure.colorbar(ax.imshow(grid, vmin=-1, vmax=1, cmap="coolwarm"))
    ax.set_xticks(range(len(names)), names, rotation=90)
    ax.set_yticks(range(len(names)), names)
    ax.set_title(title)
    return _shown(plt, figure, show)


def histograms(data, show):
    plt = _pyplot()
    down = -(-len(data) // 3)
    figure, axes = plt.subplots(down, min(3, len(data)), squeeze=False)
    for ax, (name, rows) in zip(axes.flat, data.items(), strict=False):
        ax.bar([r["low"] for r in rows], [r["n"] for r in rows], width=[r["high"] - r["low"] for r in rows], align="edge")
        ax.set_title(name)
    return _shown(plt, figure, show)


def feature_by_class_data(analyzer, feature: str) -> DataFrame:
    """(class, min, q25, median, q75, max): what a box plot takes."""
    x = number(analyzer.df, feature)
    known = analyzer.df.filter(analyzer._y.isNotNull())
    got = exact_quantiles(known, {feature: x}, [0.0, 0.25, 0.5, 0.75, 1.0], analyzer._y)
    return small(known.sparkSession, [(g, *q) for (_, g), q in got.items()], "class string, min double, q25 double, median double, q75 double, max double")


def feature_vs_target_data(analyzer, feature: str, rows: int = 1000) -> tuple[DataFrame, float, float]:
    """(random points x, y; slope; intercept of the line through all rows)."""
    x, y = number(analyzer.df, feature), number(analyzer.df, analyzer.target_column)
    line = analyzer.df.agg(F.regr_slope(y, x), F.regr_intercept(y, x)).first()
    every = analyzer.df.select(x.alias("x"), y.alias("y")).dropna()
    points = draw(every, rows, every.count(), 42)
    return points, line[0], line[1]


def plot_class_distribution(analyzer, show: bool = True):
    if analyzer.task != "classification":
        return None
    rows = analyzer._classes()
    return bars([r["class"] for r in rows], [r["count"] for r in rows], "Classes", show)


def qq_data(df: DataFrame, column: str, points: int = 99) -> list[tuple[float, float]]:
    """(normal quantile, quantile of the column) at evenly spaced shares."""
    shares = [(i + 0.5) / points for i in range(points)]
    got = exact_quantiles(df, {column: number(df, column)}, shares)[column, None]
    return [(tails.normal_ppf(s), q) for s, q in zip(shares, got, strict=True) if q is not None]


def _qq(ax, points: list[tuple[float, float]], mean: float, std: float) -> None:
    ax.scatter(*zip(*points, strict=True), s=6)
    ends = [points[0][0], points[-1][0]]
    ax.plot(ends, [mean + std * e for e in ends])
    ax.set_title("Q-Q")


def plot_target_distribution(analyzer, figsize: tuple = (12, 5), show: bool = True):
    """A histogram with mean and median, and the quantiles against those of a normal distribution."""
    if analyzer.task != "regression":
        return None
    plt = _pyplot()
    figure, (left, right) = plt.subplots(1, 2, figsize=figsize)
    d, c = analyzer.analyze_target_distribution(), analyzer.target_column
    rows = DataAnalyzer(analyzer.df).histogram(c).orderBy("bin").collect()
    left.bar([r["low"] for r in rows], [r["n"] for r in rows], width=[r["high"] - r["low"] for r in rows], align="edge")
    left.axvline(d["mean"], linestyle="--", label="mean")
    left.axvline(d["median"], linestyle=":", label="median")
    left.legend()
    _qq(right, qq_data(analyzer.df, c), d["mean"], d["std"])
    return _shown(plt, figure, show)


def class_histograms_data(analyzer, feature: str, bins: int = 30) -> DataFrame:
    """(class, bin, low, high, n): the same bins for all classes."""
    x = number(analyzer.df, feature)
    known = analyzer.df.filter(analyzer._y.isNotNull() & x.isNotNull())
    low, high = known.agg(F.min(x), F.max(x)).first()
    width = ((high - low) / bins or 1.0) if low is not None else 1.0
    index = F.least(F.floor((x - F.lit(low)) / width), F.lit(bins - 1)).cast("int")
    return known.groupBy(analyzer._y.cast("string").alias("class"), index.alias("bin")).agg(F.count("*").alias("n")).select(
        "class", "bin", (F.col("bin") * width + F.lit(low)).alias("low"), ((F.col("bin") + 1) * width + F.lit(low)).alias("high"), "n"
    )


def plot_feature_by_class(analyzer, feature: str, plot_type: str = "box", figsize: tuple = (10, 6), show: bool = True):
    """box: quartiles; violin: the classes' histograms, mirrored; hist: one over another."""
    if plot_type not in ("box", "violin", "hist"):
        raise ValueError("plot_type is 'box', 'violin' or 'hist'")
    if analyzer.task != "classification":
        return None
    plt = _pyplot()
    figure, ax = plt.subplots(figsize=figsize)
    if plot_type == "box":
        rows = feature_by_class_data(analyzer, feature).collect()
        ax.bxp([{"label": str(r["class"]), "whislo": r["min"], "q1": r["q25"], "med": r["median"], "q3": r["q75"], "whishi": r["max"]} for r in rows], showfliers=False)
        return _shown(plt, figure, show)
    by: dict[str, list] = {}
    for r in class_histograms_data(analyzer, feature).orderBy("class", "bin").collect():
        by.setdefault(r["class"], []).append(r)
    for i, (name, rows) in enumerate(by.items()):
        low, size, n = ([r[k] for r in rows] for k in ("low", "high", "n"))
        size = [b - a for a, b in zip(low, size, strict=True)]
        if plot_type == "hist":
            ax.bar(low, n, width=size, align="edge", alpha=0.5, label=name)
        else:
            share = [0.4 * v / max(n) for v in n]
            ax.barh(low, [2 * v for v in share], left=[i - v for v in share], height=size, align="edge")
    if plot_type == "hist":
        ax.legend()
    else:
        ax.set_xticks(range(len(by)), list(by))
    return _shown(plt, figure, show)


def plot_feature_vs_target(analyzer, features: list[str] | None = None, max_features: int = 6, figsize: tuple = (15, 10), show: bool = True):
    """The given features, or those that correlate most, each with the line through all rows."""
    if analyzer.task != "regression":
        return None
    if features is None:
        got = pearsons(analyzer.df, [(c, analyzer.target_column) for c in analyzer._numeric_features()])
        features = [c for c, _ in sorted(got, key=lambda p: -abs(got[p][0] or 0))]
    features = features[:max_features]
    plt = _pyplot()
    across = min(3, max(1, len(features)))
    figure, axes = plt.subplots(-(-max(1, len(features)) // across), across, figsize=figsize, squeeze=False)
    for ax, feature in zip(axes.flat, features, strict=False):
        points, slope, start = feature_vs_target_data(analyzer, feature)
        p = points.toPandas()
        ax.scatter(p["x"], p["y"], s=4)
        if slope is not None:
            ax.plot(p["x"], slope * p["x"] + start)
        ax.set_title(feature)
    return _shown(plt, figure, show)


def plot_residuals(analyzer, predictions: str, figsize: tuple = (12, 5), show: bool = True):
    """Random residuals against the predictions, and the quantiles of all residuals against those of a normal distribution."""
    if analyzer.task != "regression":
        return None
    plt = _pyplot()
    figure, (left, right) = plt.subplots(1, 2, figsize=figsize)
    e = (number(analyzer.df, analyzer.target_column) - number(analyzer.df, predictions)).alias("e")
    every = analyzer.df.select(quoted(predictions).alias("p"), e).dropna()
    n, mean, std = every.agg(F.count("e"), F.avg("e"), F.stddev_samp("e")).first()
    p = draw(every, 1000, n, 42).toPandas()
    left.scatter(p["p"], p["e"], s=4)
    left.axhline(0)
    _qq(right, qq_data(every, "e"), mean, std)
    return _shown(plt, figure, show)
