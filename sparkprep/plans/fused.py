"""One job for many statistics: aggregates are collected by name, run together, and come back as a dict."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import kind, number, quoted
from .scratch import cut

#: Aggregates in one job; more are split over several, as generated code has a limit.
AT_ONCE = 600


def aggregate(df: DataFrame, wanted: dict[tuple, Column]) -> dict[tuple, object]:
    """The values of ``wanted``, from as few scans as there are parts of ``AT_ONCE``."""
    out: dict[tuple, object] = {}
    names = list(wanted)
    for at in range(0, len(names), AT_ONCE):
        part = names[at : at + AT_ONCE]
        row = df.agg(*(wanted[n].alias(f"a{i}") for i, n in enumerate(part))).first()
        out |= {n: row[i] for i, n in enumerate(part)}
    return out


def small(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A frame of a few rows that the driver has: a row for each column, class or pair."""
    return spark.createDataFrame(list(rows), schema)


SKETCH = 10_000  # the accuracy of sketches: ranks are right to one in so many
INSIDE = 200_000  # values that a quantile is picked from on the driver


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], by: Column | None = None) -> dict[tuple, list[float | None]]:
    """Linearly interpolated quantiles by (column, group), exact however many values there are; the groups of ``by`` are few.

    No task holds all distinct values. Sketches of bounded size bracket each quantile; one more scan counts what lies below the brackets
    and brings the few values inside them. Where those would be too many, the rows inside are bracketed again.
    """
    group = F.lit(None).cast("string") if by is None else by.cast("string")
    edge = [s for share in shares for s in (max(0.0, share - 2 / SKETCH), min(1.0, share + 2 / SKETCH))]
    rows = df.select(group.alias("g"), *(x.alias(f"x{i}") for i, x in enumerate(columns.values())))
    names = list(columns)
    sketch = [a for i in range(len(names)) for a in (F.count(f"x{i}").alias(f"n{i}"), F.min(f"x{i}").alias(f"l{i}"), F.max(f"x{i}").alias(f"h{i}"), F.percentile_approx(f"x{i}", edge, SKETCH).alias(f"q{i}"))]
    found = (rows.groupBy("g") if by is not None else rows).agg(*sketch).collect()
    out: dict[tuple, list] = {}
    wanted, parts = {}, {}
    for r in found:
        g = r["g"] if by is not None else None
        for i, c in enumerate(names):
            out[c, g] = [None] * len(shares)
            for k, share in enumerate(shares):
                if not (n := r[f"n{i}"]):
                    continue
                # The margin of shares is a rank or more only where there are many; and the sketch's ends may miss the least and greatest value.
                some = n < 2 * SKETCH
                low = r[f"l{i}"] if some or edge[2 * k] <= 2 / SKETCH else r[f"q{i}"][2 * k]
                high = r[f"h{i}"] if some or edge[2 * k + 1] >= 1 - 2 / SKETCH else r[f"q{i}"][2 * k + 1]
                parts[g, i, k] = (share * (n - 1), low, high)
    at = {}
    for g in dict.fromkeys(key[0] for key in parts):
        own = F.lit(True) if g is None else F.col("g") == g
        for (h, i, k), (_, low, high) in parts.items():
            if h == g:
                x = F.col(f"x{i}")
                inside = own & (x > low) & (x < high)
                wanted |= {(g, i, k, "below"): F.count(F.when(own & (x < low), 1)), (g, i, k, "low"): F.count(F.when(own & (x == low), 1))}
                wanted |= {(g, i, k, "in"): F.count(F.when(inside, 1)), (g, i, k, "high"): F.count(F.when(own & (x == high), 1))}
                at[g, i, k] = inside
    counts = aggregate(rows, wanted) if wanted else {}
    few = {key: F.collect_list(F.when(at[key], F.col(f"x{key[1]}"))) for key in parts if 0 < counts[*key, "in"] <= INSIDE and parts[key][1] < parts[key][2]}
    values = aggregate(rows.filter(reduce(Column.__or__, (at[key] for key in few))), few) if few else {}

    def pick(key: tuple, rank: int) -> float:
        """The value of so many before it."""
        _, low, high = parts[key]
        rank -= counts[*key, "below"]
        if rank < 0:
            raise ArithmeticError("a sketch's error was above its bound")
        if rank < counts[*key, "low"]:
            return low
        rank -= counts[*key, "low"]
        if rank < counts[*key, "in"]:
            if key in values:
                return sorted(values[key])[rank]
            # Bracketed again, among the rows inside.
            m = counts[*key, "in"]
            return exact_quantiles(rows.filter(at[key]), {"x": F.col(f"x{key[1]}")}, [rank / max(1, m - 1)])["x", None][0]
        if rank - counts[*key, "in"] >= counts[*key, "high"]:
            raise ArithmeticError("a sketch's error was above its bound")
        return high

    for (g, i, k), (place, _, _) in parts.items():
        low, up = math.floor(place + 1e-9), place - math.floor(place + 1e-9)
        first = pick((g, i, k), low)
        out[names[i], g][k] = float(first if up <= 1e-9 else first + (pick((g, i, k), low + 1) - first) * up)
    return out


def percentiles(c: Column, shares: list[float], approximate: bool = False) -> Column:
    """Linearly interpolated; ``approximate`` keeps a bounded sketch instead of all distinct values."""
    return F.percentile_approx(c, shares, SKETCH) if approximate else F.percentile(c, F.array(*map(F.lit, shares)))


PARTS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "var_pop": F.var_pop, "var_samp": F.var_samp, "min": F.min, "max": F.max, "g1": F.skewness, "g2": F.kurtosis}


def moments(df: DataFrame, columns: list[str], shares: list[float] = (0.25, 0.5, 0.75), approximate: bool = False, parts: list[str] = tuple(PARTS)) -> dict[str, dict]:
    """count, mean, std, variances, min, max, skew, kurtosis (bias-corrected) and percentiles of each column; only ``parts`` of them.

    Percentiles are exact, from three jobs of bounded memory, unless ``approximate``; no shares, no such jobs.
    """
    wanted = {(c, k): PARTS[k](number(df, c)) for c in columns for k in parts}
    if approximate and shares:
        wanted |= {(c, "q"): percentiles(number(df, c), list(shares), True) for c in columns}
    got = aggregate(df, wanted)
    exact = exact_quantiles(df, {c: number(df, c) for c in columns}, list(shares)) if shares and not approximate and columns else {}
    out = {}
    for c in columns:
        m = {k: got[c, k] for k in parts if k not in ("g1", "g2")}
        if "g1" in parts:
            m["skew"], m["kurtosis"] = corrected(m["count"], got[c, "g1"], got[c, "g2"])
        q = exact.get((c, None), got.get((c, "q")))
        m["q"] = list(q) if q is not None else [None] * len(shares)
        out[c] = m
    return out


def corrected(n: int, g1: float | None, g2: float | None) -> tuple[float | None, float | None]:
    """Sample skewness and excess kurtosis from the population's; a constant has 0."""
    skew = None if n < 3 else (g1 or 0.0) * (n * (n - 1)) ** 0.5 / (n - 2)
    tail = None if n < 4 else 0.0 if g2 is None else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return skew, tail


def unpivoted(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., name, value): a row for each column of each row, values as strings; nulls stay."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("value")) for c in columns))
    return df.select(*map(quoted, keep), F.inline(pairs))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n) of all columns, summed by task before the one shuffle."""
    return unpivoted(df, columns).groupBy("name", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, int]:
    """Different values of each column, without nulls."""
    if not columns:
        return {}
    if approximate:
        return {k[0]: v for k, v in aggregate(df, {(c,): F.approx_count_distinct(quoted(c)) for c in columns}).items()}
    rows = value_counts(df, columns).groupBy("name").agg(F.count("value").alias("n")).collect()
    return {c: 0 for c in columns} | {r["name"]: r["n"] for r in rows}


def bucket_of(c: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below the value, as a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c > F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def dealt(df: DataFrame, name: str, c: Column, bounds: list) -> DataFrame:
    """The frame with ``bucket_of`` as a column. Many bounds are a tree over blocks of them and, as a step of its own, a tree over
    one block by place: the code of one tree over all is more than the JVM compiles, and takes several times as long."""
    if len(bounds) <= 64:
        return df.withColumn(name, bucket_of(c, bounds))
    step = math.isqrt(len(bounds)) + 1
    at = F.array(*map(F.lit, bounds))
    first = F.col(name) * step

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return first + lo
        mid = (lo + hi) // 2
        return F.when(c > F.get(at, first + mid), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return df.withColumn(name, bucket_of(c, bounds[step - 1 :: step])).withColumn(name, tree(0, step - 1))


def bucket_count(spark: SparkSession) -> int:
    """As many ranges as shuffle partitions, as far as one expression holds them."""
    return max(2, min(256, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def quantile_bounds(df: DataFrame, c: Column, buckets: int) -> list:
    got = df.agg(F.percentile_approx(c, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0]
    return sorted(set(got or []))


def ranks(df: DataFrame, column: str, bounds: list | None = None) -> DataFrame:
    """(value, n, rank) of each different value: the average rank of its rows among all that aren't null.

    Values are dealt to ranges by approximate quantiles (or the given bounds), and ranked within each; so no task sees all.
    """
    x = number(df, column)
    counts = df.select(x.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    bounds = quantile_bounds(df, x, bucket_count(df.sparkSession)) if bounds is None else bounds
    counts = counts.withColumn("bucket", bucket_of(F.col("value"), bounds))
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("m"))
    below = sums.select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("below"))  # a row for each bucket
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("value"))
    return counts.join(below, "bucket").select("value", "n", (F.col("below") + upto - (F.col("n") - 1) / F.lit(2.0)).alias("rank"))


def sample(df: DataFrame, column: str, rows: int, seed: int = 42):
    """The values of so many random rows that aren't null, or of all if there are no more.

    Places in sorted order are drawn, and each value gives as many rows as its places were hit; so every row is as likely as any
    other, however often its value occurs, and the partitions don't matter.
    """
    x = df.select(number(df, column).alias("x")).filter("x IS NOT NULL")
    n = x.count()
    if n <= rows:
        return x.toPandas()["x"].to_numpy(dtype=float)
    at = np.sort(np.random.default_rng(seed).choice(n, rows, replace=False))

    def hit(batches):
        for b in batches:
            low = b["rank"] - (b["n"] + 1) / 2  # the first place of the value, from 0
            times = np.searchsorted(at, low + b["n"]) - np.searchsorted(at, low)
            yield b[["value"]].loc[b.index.repeat(times)]

    return ranks(x, "x").mapInPandas(hit, "value double").toPandas()["value"].to_numpy(dtype=float)


def draw(df: DataFrame, rows: int, total: int, seed: int | None = None, keys: list[str] = ()) -> DataFrame:
    """So many random rows of ``total``, or all if there are no more, without sorting the rest.

    keys: columns whose values, unique together, decide with the seed; without them, rows are drawn as Spark deals them.
    """
    if keys:
        text = F.concat_ws("|", F.lit(str(seed)), *(quoted(c).cast("string") for c in keys))
        u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / 16.0**13
    else:
        u = F.rand(seed)
    drawn = df.withColumn("_u", u)
    share = (rows + 10 * rows**0.5 + 100) / max(1, total)
    near = drawn.filter(F.col("_u") < share)
    if share >= 1 or near.count() < rows:
        near = drawn
    return near.orderBy("_u", *map(quoted, keys)).limit(rows).drop("_u")


def anderson_sum(df: DataFrame, column: str, mean: float, std: float) -> float:
    """What ``statistics.anderson_from`` takes, from the values' counts and ranks: the sum of (2i - 1) ln F + (2(n - i) + 1) ln(1 - F)."""
    from ..functions.statistics import log_tails

    n = df.agg(F.count(number(df, column))).first()[0]

    def parts(batches):
        for b in batches:
            low, high = log_tails((b["value"].to_numpy(dtype=float) - mean) / std)
            b["s"] = b["n"] * ((2 * b["rank"] - 1) * low + (2 * (n - b["rank"]) + 1) * high)
            yield b[["s"]].sum().to_frame().T

    return ranks(df, column).mapInPandas(parts, "s double").agg(F.sum("s")).first()[0]


def pair_moments(x: Column, y: Column) -> dict[str, Column]:
    """What Pearson's r takes, over the rows that have both."""
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    return {"n": F.count(u), "cov": F.covar_pop(u, v), "sx": F.stddev_pop(u), "sy": F.stddev_pop(v)}


def pearson(m: dict) -> float | None:
    """None for a constant column or no rows."""
    if not m["sx"] or not m["sy"]:
        return None
    return max(-1.0, min(1.0, m["cov"] / (m["sx"] * m["sy"])))


def pearsons(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[float | None, int]]:
    """(r, rows) of each pair, in one job."""
    wanted = {(a, b, k): c for a, b in pairs for k, c in pair_moments(number(df, a), number(df, b)).items()}
    got = aggregate(df, wanted)
    out = {}
    for a, b in pairs:
        m = {k: got[a, b, k] for k in ("n", "cov", "sx", "sy")}
        out[a, b] = pearson(m), m["n"]
    return out


PAIRS_AT_ONCE = 12


def spearmans(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[float | None, int]]:
    """Pearson's r of the ranks among the rows that have both.

    One job finds the ranges and nulls of all columns. Columns without nulls are ranked once each, and one job takes the moments of all their
    pairs; the ranks of a column with nulls depend on its partner, so those pairs are ranked by themselves, ``PAIRS_AT_ONCE`` a job.
    """
    names = sorted({c for p in pairs for c in p})
    buckets = bucket_count(df.sparkSession)
    shares = [i / buckets for i in range(1, buckets)]
    found = {(c, "bounds"): F.percentile_approx(number(df, c), shares, 100 * buckets) for c in names} | {(c, "n"): F.count(number(df, c)) for c in names}
    got = aggregate(df, found | {(): F.count("*")}) if names else {}
    bounds = {c: sorted(set(got[c, "bounds"] or [])) for c in names}
    whole = [c for c in names if got[c, "n"] == got[()]]
    out = {}
    if easy := [(a, b) for a, b in pairs if a in whole and b in whole]:
        at = {c: i for i, c in enumerate(dict.fromkeys(c for p in easy for c in p))}
        rows = df.select(*(number(df, c).cast("double").alias(f"x{i}") for c, i in at.items()))
        for c, i in at.items():
            rank = ranks(rows, f"x{i}", bounds[c]).select(F.col("value").alias(f"x{i}"), F.col("rank").alias(f"r{i}"))
            rows = rows.join(rank, f"x{i}")
        sums = aggregate(rows, {(a, b, k): v for a, b in easy for k, v in pair_moments(F.col(f"r{at[a]}"), F.col(f"r{at[b]}")).items()})
        for a, b in easy:
            m = {k: sums[a, b, k] for k in ("n", "cov", "sx", "sy")}
            out[a, b] = pearson(m), m["n"]
    rest = [p for p in pairs if p not in out]
    for start in range(0, len(rest), PAIRS_AT_ONCE):
        sums = [_rank_sums(df, a, b, bounds).withColumn("pair", F.lit(start + i)) for i, (a, b) in enumerate(rest[start : start + PAIRS_AT_ONCE])]
        for r in reduce(DataFrame.unionAll, sums).collect():
            out[rest[r["pair"]]] = _from_sums(r)
    return {p: out[p] for p in pairs}


def _rank_sums(df: DataFrame, a: str, b: str, bounds: dict[str, list]) -> DataFrame:
    rows = df.select(number(df, a).alias("x"), number(df, b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    cells = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    rx = ranks(rows, "x", bounds[a]).select(F.col("value").alias("x"), F.col("rank").alias("rx"))
    ry = ranks(rows, "y", bounds[b]).select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    s = lambda e: F.sum(F.col("n") * e)
    x, y = F.col("rx"), F.col("ry")
    return cells.join(rx, "x").join(ry, "y").agg(F.sum("n").alias("n"), s(x).alias("x"), s(y).alias("y"), s(x * x).alias("xx"), s(y * y).alias("yy"), s(x * y).alias("xy"))


def _from_sums(m) -> tuple[float | None, int]:
    n = m["n"] or 0
    if not n:
        return None, 0
    vx, vy = m["xx"] / n - (m["x"] / n) ** 2, m["yy"] / n - (m["y"] / n) ** 2
    if vx <= 1e-12 * max(1, m["xx"] / n) or vy <= 1e-12 * max(1, m["yy"] / n):
        return None, n
    return max(-1.0, min(1.0, (m["xy"] / n - m["x"] * m["y"] / n / n) / (vx * vy) ** 0.5)), n


def kendalls(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[float | None, int]]:
    """Kendall's tau-b, exact, from the cells of a pair: the different pairs of values with their counts.

    Both axes are dealt to ranges. Two cells are concordant or not by their ranges of x and y where both differ, which sums over ranges tell.
    Two cells in one range of x are compared in the task of that range, and two of one range of y, but not of x, in the task of
    that one. So a task holds the cells of a range, or those of one value that many rows share, which need no comparison.
    """
    return {(a, b): _kendall(df, a, b) for a, b in pairs}


def _own_ranges(rows: DataFrame, column: str, buckets: int) -> list[float]:
    """Bounds of ranges of about equally many rows; a value of more than that has a range to itself."""
    got = rows.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    return sorted({*got, *(math.nextafter(a, -math.inf) for a, b in zip(got, got[1:], strict=False) if a == b)})


def _kendall(df: DataFrame, a: str, b: str) -> tuple[float | None, int]:
    rows = df.select(number(df, a).cast("double").alias("x"), number(df, b).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    cells = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    cut_x, cut_y = (_own_ranges(rows, c, bucket_count(df.sparkSession)) for c in ("x", "y"))
    cells = cut(cells.withColumns({"p": bucket_of(F.col("x"), cut_x), "q": bucket_of(F.col("y"), cut_y)}), "kendall")
    n = cells.agg(F.sum("n")).first()[0] or 0
    ties = [cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0.0 for c in ("x", "y")]
    sums = {(r["p"], r["q"]): r["n"] for r in cells.groupBy("p", "q").agg(F.sum("n").alias("n")).collect()}
    grid = np.zeros((len(cut_x) + 1, len(cut_y) + 1))
    for at, m in sums.items():
        grid[at] = m
    far = np.zeros_like(grid)  # of each range: rows below in both, less those below in x and above in y
    upto = np.cumsum(np.cumsum(grid, 0), 1)
    far[1:] = upto[:-1] - upto[:-1, -1:]
    far[1:, 1:] += upto[:-1, :-1]
    score = float((grid * far).sum())
    # A range of a single value on its axis has ties only.
    for own, other, skip in (("p", "x", None), ("q", "y", "p")):
        mixed = cells.groupBy(own).agg(F.min(other).alias("lo"), F.max(other).alias("hi")).filter("lo < hi").select(own)
        near = cells.join(mixed, own).select(F.col(own).alias("range"), F.col("x" if skip is None else "p").cast("double").alias("x"), "y", "n")
        got = near.groupBy("range").applyInPandas(_near, "score double").agg(F.sum("score")).first()[0]
        score += got or 0.0
    total = n * (n - 1) / 2
    below = ((total - ties[0]) * (total - ties[1])) ** 0.5
    return (score / below if below else None), n


def _near(cells):
    """Concordant less discordant pairs of rows, of cells that differ in x and in y, by merging."""
    import pandas as pd

    cells = cells.sort_values(["x", "y"])
    x, y, n = cells["x"].to_numpy(), np.unique(cells["y"], return_inverse=True)[1], cells["n"].to_numpy(dtype=float)
    group = np.unique(x, return_inverse=True)[1]
    score, width, top = 0.0, 1, int(group.max(initial=0)) + 1
    wide = int(y.max(initial=0)) + 2
    while width < top:
        # In each two neighbouring blocks of ``width`` values of x, rows of the second one meet those of the first.
        block = group // width
        first = block % 2 == 0
        key = (block // 2) * wide + y
        order = np.argsort(key[first], kind="stable")
        keys, sums = key[first][order], np.append(0.0, np.cumsum(n[first][order]))
        later = key[~first]
        base = (block[~first] // 2) * wide
        start, end = (sums[np.searchsorted(keys, b)] for b in (base, base + wide))
        low, upto = sums[np.searchsorted(keys, later)], sums[np.searchsorted(keys, later, "right")]
        score += float((n[~first] * ((low - start) - (end - upto))).sum())
        width *= 2
    return pd.DataFrame({"score": [score]})


CORRELATIONS = {"pearson": pearsons, "spearman": spearmans, "kendall": kendalls}


def is_boolean(df: DataFrame, column: str) -> bool:
    return kind(df, column).typeName() == "boolean"
