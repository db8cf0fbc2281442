"""Volatility and microstructure noise per asset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators import sampling
from tickweave.operators.ordered import as_of, previous, ranked, with_halo
from tickweave.sources.ticks import Ticks

NAN = float("nan")
#: Fewest values for a two-scales estimate.
MIN_VALUES = 10
#: Ranks of a key that one task takes at least.
PART_RANKS = 100_000
#: Noise below this gives no useful spacing; the fallback spacing is used.
TINY_NOISE, FALLBACK_SPACING = 1e-7, 20.0


def volatility_of_returns(returns: DataFrame) -> DataFrame:
    """(asset, volatility): root of the mean squared return."""
    return returns.groupBy("asset").agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("volatility"))


def grid_volatility(ticks: Ticks, grid: DataFrame) -> DataFrame:
    """Volatility per unit of time from values sampled on (asset, k, t)."""
    sampled = as_of(ticks, grid)
    r = sampling.returns(sampled)
    steps = sampled.groupBy("asset").agg(((F.max("t") - F.min("t")) / (F.count("*") - 1)).alias("step"))
    return volatility_of_returns(r).join(steps, "asset").select("asset", (F.col("volatility") / F.sqrt("step")).alias("volatility"))


def default_num_grids(ticks: Ticks) -> float:
    least = sampling.tick_counts(ticks).agg(F.min("number_of_ticks").alias("n")).first()["n"] or 0
    return max(math.floor(least / 100), 3)


def two_scales_of(df: DataFrame, keys: list[str], num_grids: float, value: Column | None = None) -> DataFrame:
    """keys, volatility, noise, n from rows (keys, rn, t, value) ranked by rn from 1."""
    value = F.col("value") if value is None else value
    found = two_scales_many(df.select(*keys, "rn", "t", value.alias("value")), keys, num_grids, ["value"])
    return found.select(*keys, F.col("volatility_value").alias("volatility"), F.col("noise_value").alias("noise"), "n")


def two_scales_many(df: DataFrame, keys: list[str], num_grids: float, names: list[str]) -> DataFrame:
    """keys, n, and volatility_x, noise_x of each value column x of rows (keys, rn, t, x, ...) ranked by rn from 1.

    Squared changes over every K-th value are averaged over the K sub-samples,
    and the change-by-change estimate corrects for noise.  Ranks are cut into
    parts, each with the K ranks before it, so that tasks share a large key.
    """
    most = max(2, math.floor(num_grids))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))
    sizes = sizes.withColumn("grids", F.least(F.floor(F.col("n") / 4), F.lit(most)).cast("int"))
    used = sizes.where(f"n >= {MIN_VALUES} and span > 0").select(*keys, "grids")
    rows = with_halo(df.join(F.broadcast(used), keys), F.col("rn") - 1, max(PART_RANKS, 4 * most), before=most)  # a row per key
    rows = rows.withColumn("sub", F.pmod(F.col("rn") - 1, F.col("grids")))
    every, sparse = Window.partitionBy(*keys, "part").orderBy("rn"), Window.partitionBy(*keys, "part", "sub").orderBy("rn")
    for x in names:
        rows = rows.withColumn(f"f_{x}", F.col(x) - F.lag(x).over(every)).withColumn(f"s_{x}", F.col(x) - F.lag(x).over(sparse))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    subs = rows.where("own").groupBy(*keys, "sub").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), *[square(f"{kind}_{x}").alias(f"{kind}_{x}") for x in names for kind in ("f", "s")]
    )
    root = lambda sums, lo, hi: F.sqrt(sums / (hi - lo))
    per = subs.groupBy(*keys).agg(
        *[F.avg(root(F.col(f"s_{x}"), F.col("lo"), F.col("hi"))).alias(f"sparse_{x}") for x in names],
        *[root(F.sum(f"f_{x}"), F.min("lo"), F.max("hi")).alias(f"full_{x}") for x in names],
    )
    out = sizes.join(per, keys, "left")
    for x in names:
        sparse_v, full = F.col(f"sparse_{x}"), F.col(f"full_{x}")
        pure = (sparse_v - full / F.col("grids")) / (1 - 1 / F.col("grids"))
        out = out.withColumn(f"volatility_{x}", pure).withColumn(f"noise_{x}", (full**2 - F.col(f"volatility_{x}") ** 2) * F.col("span") / (2 * F.col("n")))
    known = [F.coalesce(f"{what}_{x}", F.lit(NAN)).alias(f"{what}_{x}") for x in names for what in ("volatility", "noise")]
    return out.select(*keys, *known, "n")


def two_scales_volatility(ticks: Ticks, assets: list[str] | None = None, num_grids: float | None = None) -> DataFrame:
    """(asset, volatility, noise): two-scales estimates, noise variance at least 0, NaN with under 10 ticks."""
    grids = default_num_grids(ticks) if num_grids is None else num_grids
    found = two_scales_of(ranked(ticks.only(assets)), ["asset"], grids)
    return found.select("asset", "volatility", F.when(F.isnan("noise"), F.col("noise")).otherwise(F.greatest(F.lit(0.0), "noise")).alias("noise"))


def change_volatility(ticks: Ticks) -> DataFrame:
    """(asset, volatility): root of summed squared changes over elapsed time."""
    d = F.col("value") - F.col("p_value")
    per = previous(ticks).groupBy("asset").agg(F.sum(d * d).alias("s"), (F.max("t") - F.min("t")).alias("span"))
    return per.select("asset", F.sqrt(F.col("s") / F.col("span")).alias("volatility"))


def default_spacing(ticks: Ticks, rough: int = 5, span: float | None = None) -> DataFrame:
    """(asset, spacing) balancing noise against sampling error, of assets that count as observed."""
    total = sampling.duration(ticks) if span is None else span
    rough_guess = two_scales_volatility(ticks, sampling.asset_names(ticks), rough)
    noise, vol = F.col("noise"), F.col("volatility")
    wanted = F.pow((F.lit(total) / (4 * noise * noise)) * total * F.pow(vol, F.lit(4.0)), F.lit(1.0 / 3.0))
    return rough_guess.select("asset", F.when(noise < TINY_NOISE, F.lit(FALLBACK_SPACING)).otherwise(wanted).alias("spacing"))


def simple_volatility(ticks: Ticks, assets: list[str] | None = None, *, grid: DataFrame | None = None, spacing: float | dict[str, float] | None = None, use_all_obs: bool = False, rough: int = 5) -> DataFrame:
    """(asset, volatility) from values on a grid: a given one, every tick, a spacing or the default spacing."""
    assets = assets or sampling.asset_names(ticks)
    mine = ticks.only(assets)
    if grid is None and use_all_obs:
        grid = ranked(mine).select("asset", F.col("rn").alias("k"), "t")
    elif grid is None:
        lo, hi = ticks.extent()
        if spacing is None:
            spacing = {r.asset: r.spacing for r in default_spacing(ticks, rough).collect()}  # one row per asset
        each = spacing if isinstance(spacing, dict) else dict.fromkeys(assets, float(spacing))
        rows = [(a, each[a], int(math.floor((hi - lo) / each[a] + 1e-12))) for a in assets]
        steps = ticks.spark.createDataFrame(rows, "asset string, step double, n long")
        grid = steps.select("asset", "step", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("k")).select("asset", "k", (F.lit(lo) + F.col("k") * F.col("step")).alias("t"))
    return grid_volatility(mine, grid)
