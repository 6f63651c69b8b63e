"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its weight's share of the budget, at most ``cap`` times its own size; what exceeds that is shared
out again by weight. A source takes all its documents floor(target / size) times; for the rest of the target, documents
whose hash lies below a threshold are taken once more. The threshold is found without sorting: sizes are summed by
(source, leading hash bits), the bucket where the running sum crosses the rest is refined by the next bits, twice, and
the leaf is included if that comes nearer to the target. Histograms have at most 2**BITS rows for each source and level.

Sizes are counted once and written to the shared folder (id, source, size and hash: a small part of the text). Sums are
map-side combined, so a source that holds a third of all rows is no hot key; only its histogram meets in one task.

Null and empty texts have size 0 and are never taken; very long ones are counted whole. A null source is the last one. Repeated rows and
rows with equal ids share a hash and go together. There is a row for each source in one task, so sources must be a list of
some thousands, not of hosts.
A table without words gives targets of 0. Empty tables give empty results; other columns are ignored
by ``mix`` and pass ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

BITS, LEVELS = 12, 3


def hash_of(key: Column) -> Column:
    """36 bits of the key's MD5, which every SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sources: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """sources: (source, source_size), a row each. Adds target.

    With ratio = cap * size / weight ascending, the capped sources are the first k, where k is the least number for which
    the rest's common level (budget - capped sizes) / (rest's weights) is at most the next ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    kind = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (kind + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns(
        {
            "rest": share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
            "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = rows.withColumn("level", F.col("rest") / F.col("left"))
    free = F.col("level") * F.col("weight") <= F.col("most")
    # The first free source in this order has the most weight left.
    level = level.withColumn("common", F.max(F.when(free, F.struct("left", "level"))).over(every).getField("level"))
    return level.select(
        "source", "source_size", F.coalesce(F.least(F.col("most"), F.col("common") * F.col("weight")), "most").alias("target")
    )


def plan(sized: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, copies, below): a document is taken ``copies`` times, and once more if hash < below."""
    space = 1 << BITS * LEVELS
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    state = targets(sources, weights, share, cap)
    state = state.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    state = state.withColumns(
        {"need": F.col("target") - F.col("copies") * F.col("source_size"), "start": F.lit(0).cast("long"), "under": F.lit(0).cast("long")}
    )
    state = cut(state, "mix-plan")
    for level in range(1, LEVELS + 1):
        width = space >> BITS * level  # of a bucket at this level
        inside = sized.join(state.select("source", "start"), sized["source"].eqNullSafe(state["source"])).select(
            sized["source"], F.col("start"), "hash", "size"
        )
        inside = inside.filter((F.col("hash") >= F.col("start")) & (F.col("hash") < F.col("start") + width * (1 << BITS)))
        hist = inside.groupBy("source", F.floor(F.col("hash") / width).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "of")
        crossed = (
            hist.join(state, hist["of"].eqNullSafe(state["source"]))
            .filter(F.col("under") + F.col("upto") > F.col("need"))
            .groupBy("of")
            .agg(F.min(F.struct("bucket", "upto", "n")).alias("b"))
        )
        state = state.join(crossed, crossed["of"].eqNullSafe(state["source"]), "left").select(
            "source",
            "source_size",
            "target",
            "copies",
            "need",
            # Without a crossing (no words) nothing lies below.
            F.coalesce(F.col("b.bucket") * width, F.col("start")).alias("start"),
            (F.col("under") + F.coalesce(F.col("b.upto") - F.col("b.n"), F.lit(0))).alias("under"),
            F.coalesce(F.col("b.n"), F.lit(0)).alias("leaf"),
        )
        state = cut(state, "mix-plan")
    nearer = F.col("under") + F.col("leaf") - F.col("need") < F.col("need") - F.col("under")
    return state.select(
        "source", "source_size", "target", "copies", (F.col("start") + F.when(nearer, 1).otherwise(0)).alias("below")
    )


def sized(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with size (words) and hash."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"size": size, "hash": hash_of(F.col(id_column))})


def chosen(docs: DataFrame, weights: list[int], share: float = 1.5, cap: float = 2.0, id_column: str = "doc_id", sizes: DataFrame | None = None) -> DataFrame:
    """The columns of ``docs`` with size, source_size, target and copies: how often the mix takes the document.

    sizes: (source, size, hash) of the same documents, to be read instead of their texts to find the thresholds.
    """
    counted = cut(sized(docs, id_column).select("source", "size", "hash"), "sizes") if sizes is None else sizes
    found = cut(plan(counted, weights, share, cap), "mix").withColumnRenamed("source", "of")
    rows = sized(docs, id_column) if sizes is None else docs
    rows = rows.drop("source_size", "target", "copies", "below", "of")
    # Copies never exceed the cap: at the cap nothing is needed beyond whole copies.
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0))
    return rows.join(found, rows["source"].eqNullSafe(F.col("of"))).withColumn("copies", copies).drop("hash", "below", "of")


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, cap: float = 2.0, id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (words)."""
    sizes = cut(sized(docs, id_column).select(id_column, "source", "size", "hash"), "sizes")
    return chosen(sizes, weights, share, cap, id_column, sizes).withColumn("taken", F.col("copies") * F.col("size"))


def take(docs: DataFrame, weights: list[int], share: float = 1.5, cap: float = 2.0, id_column: str = "doc_id") -> DataFrame:
    """The mix itself: ``docs`` with each document as often as it is taken. Only the plan is joined; texts aren't shuffled."""
    packed = docs.select(id_column, "source", "text", F.struct(*docs.columns).alias("row"))
    rows = chosen(packed, weights, share, cap, id_column).filter("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
