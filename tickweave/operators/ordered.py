"""Order-dependent steps that work on (asset, chunk) and carry state over chunk borders.

A plain window over an asset puts the asset into one task.  Here windows run
within chunks, what crosses a border is a row per (asset, chunk), and a window
over those few rows passes it on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.sources.ticks import Ticks


def _order():
    return F.struct("t", "seq")


def ranked(ticks: Ticks, *keys: str) -> DataFrame:
    """Adds rn, the 1-based place of a tick among its asset's."""
    df = ticks.df.withColumn("chunk", ticks.chunk_of(F.col("t")))
    inside = df.withColumn("rn", F.row_number().over(Window.partitionBy("asset", "chunk").orderBy("t", "seq")))
    if ticks.chunk is None:
        return inside.drop("chunk")
    counts = df.groupBy("asset", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("asset", "chunk", (F.sum("n").over(Window.partitionBy("asset").orderBy("chunk")) - F.col("n")).alias("before"))
    return inside.join(before, ["asset", "chunk"]).withColumn("rn", (F.col("rn") + F.col("before")).cast("int")).drop("chunk", "before")


def previous(ticks: Ticks) -> DataFrame:
    """Adds p_t and p_value, time and value of the asset's tick before; null for the first."""
    df = ticks.df.withColumn("chunk", ticks.chunk_of(F.col("t")))
    w = Window.partitionBy("asset", "chunk").orderBy("t", "seq")
    inside = df.withColumn("p_t", F.lag("t").over(w)).withColumn("p_value", F.lag("value").over(w))
    if ticks.chunk is None:
        return inside.drop("chunk")
    ends = df.groupBy("asset", "chunk").agg(F.max_by(F.struct("t", "value"), _order()).alias("end"))
    carry = ends.select("asset", "chunk", F.lag("end").over(Window.partitionBy("asset").orderBy("chunk")).alias("end"))
    joined = inside.join(carry, ["asset", "chunk"])
    return joined.withColumn("p_value", F.when(F.col("p_t").isNull(), F.col("end.value")).otherwise(F.col("p_value"))).withColumn("p_t", F.coalesce("p_t", "end.t")).drop("chunk", "end")


def as_of(ticks: Ticks, grid: DataFrame, value: Column | None = None, *, strict: bool = False, fill_first: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Backward as-of join: rows (asset, k, t) of ``grid`` get the latest value at or before t (``strict``: before t).

    Times before the first tick get the first value, or null without
    ``fill_first``.  ``carry`` names columns of the grid that are kept.  Ticks
    and grid rows are merged by one sort, not by a range join.
    """
    value = F.col("value") if value is None else value
    kinds = dict(grid.dtypes)
    side = ticks.df.select("asset", "t", "seq", value.alias("value"), F.lit(1 if strict else 0).alias("late"), F.lit(False).alias("is_grid"), F.lit(None).cast("long").alias("k"), *[F.lit(None).cast(kinds[c]).alias(c) for c in carry])
    asked = grid.select("asset", F.col("t").cast("double").alias("t"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(dict(side.dtypes)["value"]).alias("value"), F.lit(0 if strict else 1).alias("late"), F.lit(True).alias("is_grid"), F.col("k").cast("long").alias("k"), *carry)
    merged = side.unionByName(asked).withColumn("chunk", ticks.chunk_of(F.col("t")))
    boxed = F.when(~F.col("is_grid"), F.struct("value"))
    inside = merged.withColumn("found", F.last(boxed, ignorenulls=True).over(Window.partitionBy("asset", "chunk").orderBy("t", "late", "seq")))
    real = F.when(~F.col("is_grid"), _order())
    ends = merged.groupBy("asset", "chunk").agg(F.max_by(boxed, real).alias("end"), F.min_by(boxed, real).alias("start"))
    w = Window.partitionBy("asset").orderBy("chunk")
    borders = [F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("end")]
    if fill_first:
        borders.append(F.first("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("start"))
    joined = inside.where("is_grid").join(ends.select("asset", "chunk", *borders), ["asset", "chunk"])
    latest = F.coalesce("found", "end", "start") if fill_first else F.coalesce("found", "end")
    return joined.select("asset", "k", "t", latest["value"].alias("value"), *carry)


def with_halo(df: DataFrame, place: Column, length: int, *, before: int = 0, after: int = 0) -> DataFrame:
    """Rows by part of ``length`` places (from 0), each part with rows of its neighbours that are not its own.

    Adds part and own.  ``before`` and ``after`` are how many places of the
    parts around are added, at most ``length``.
    """
    base = df.withColumn("part", F.floor(place / length).cast("long")).withColumn("own", F.lit(True))
    inside, out = F.pmod(place, F.lit(length)), base
    if before:
        out = out.unionByName(base.where(inside >= length - before).withColumn("part", F.col("part") + 1).withColumn("own", F.lit(False)))
    if after:
        out = out.unionByName(base.where((inside < after) & (F.col("part") > 0)).withColumn("part", F.col("part") - 1).withColumn("own", F.lit(False)))
    return out


def running_sum(df: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Adds running sums, by name, to a table with a column part: sums within parts, and what is before a part from a row per part."""
    w = Window.partitionBy(*keys, "part").orderBy(order)
    inside = df.withColumns({name: F.sum(value).over(w) for name, value in values.items()})
    totals = df.groupBy(*keys, "part").agg(*[F.sum(value).alias(name) for name, value in values.items()])
    w = Window.partitionBy(*keys).orderBy("part") if keys else Window.orderBy("part")
    before = totals.select(*keys, "part", *[(F.sum(name).over(w) - F.col(name)).alias(f"_before_{name}") for name in values])
    joined = inside.join(F.broadcast(before), [*keys, "part"])
    return joined.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in values}).drop(*[f"_before_{name}" for name in values])
