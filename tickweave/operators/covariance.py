"""Raw covariance estimates as rows (a, b, cov), a <= b; regularisation comes after."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.kernels import PARZEN, TRIANGLE, Kernel, Preaveraging
from tickweave.operators import sampling
from tickweave.operators.ordered import as_of, previous, ranked, running_sum, with_halo
from tickweave.operators.volatility import default_num_grids, default_spacing, two_scales_many, two_scales_volatility
from tickweave.sources.ticks import Ticks
from tickweave.workspace import drop_tables, materialise

#: Returns of one block of a realised kernel and of one part of an asset, at least.
BLOCK, PART = 20_000, 50_000
#: Up to this many weights a filter is a direct sum.
DIRECT = 256


def pairs_of(df: DataFrame, on: list[str], value: str, *, diagonal: bool = True) -> DataFrame:
    """Rows (on, a, b, x, y) of a self-join on the sampling key, a <= b by name."""
    left = df.select(*on, F.col("asset").alias("a"), F.col(value).alias("x"))
    right = df.select(*on, F.col("asset").alias("b"), F.col(value).alias("y"))
    return left.join(right, on).where("a <= b" if diagonal else "a < b")


def time_grid(ticks: Ticks, *, spacing: float | None = None, refresh: bool = False, rough: int = 5, assets: list[str] | None = None) -> DataFrame:
    """(k, t): a given spacing, refresh times, or the mean of the assets' default spacings."""
    if spacing is None and refresh:
        return sampling.refresh_times(ticks, assets)
    if spacing is None:
        span = sampling.duration(ticks)
        found = [r.spacing for r in default_spacing(ticks, rough, span).collect()]  # one row per asset
        valid = [x for x in found if x is not None and math.isfinite(x)]
        spacing = min(float(np.mean(valid)), span / 20) if valid else span / 20
    return sampling.even_grid(ticks, spacing)


def covariance_of_returns(returns: DataFrame) -> DataFrame:
    """Sample covariance (a, b, cov) of rows (asset, k, r)."""
    return pairs_of(returns, ["k"], "r").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))


def grid_covariance(ticks: Ticks, grid: DataFrame, assets: list[str]) -> DataFrame:
    return covariance_of_returns(sampling.returns(sampling.latest_value(ticks, grid, assets)))


def realised_autocovariance(returns: DataFrame, lag: int) -> DataFrame:
    """(a, b, cov): sum over k of r_a(k) r_b(k - lag), all ordered pairs."""
    late = returns.select(F.col("k"), F.col("asset").alias("a"), F.col("r").alias("x"))
    early = returns.select((F.col("k") + abs(lag)).alias("k"), F.col("asset").alias("b"), F.col("r").alias("y"))
    return late.join(early, "k").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cov"))


def end_averaged_returns(returns: DataFrame, m: int) -> DataFrame:
    """(asset, k, r), k from 1: the first and last m returns become one weighted return each."""
    returns = materialise(returns.select("asset", "k", "r"), "returns")  # read twice
    n, first = returns.agg(F.countDistinct("k"), F.min("k")).first()
    if m >= n / 2:
        drop_tables(returns)
        raise ValueError("m is too large for this number of returns")
    place = F.col("k") - first + 1
    df = returns.withColumn("i", place)
    weight = F.when(F.col("i") <= m, -F.col("i") / m).when(F.col("i") > n - m, (F.col("i") - (n - m)) / m).otherwise(F.lit(1.0))
    slot = F.when(F.col("i") <= m, F.lit(1)).when(F.col("i") > n - m, F.lit(n - 2 * m + 2)).otherwise(F.col("i") - m + 1)
    return df.select("asset", slot.cast("long").alias("k"), (F.col("r") * weight).alias("r")).groupBy("asset", "k").agg(F.sum("r").alias("r"))


def filtered(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """sum over j of weights[j] x[i - j] for every i; by Fourier transform where the direct sum is longer."""
    if min(len(x), len(weights)) <= DIRECT:
        return np.convolve(x, weights)[: len(x)]
    size = 1 << (len(x) + len(weights) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(weights, size), size)[: len(x)]


def realised_kernel(returns: DataFrame, kernel: Kernel, bandwidth: float, n: int) -> DataFrame:
    """(a, b, cov) of the multivariate realised kernel.

    Returns are cut into blocks, each with as many returns before it as the
    kernel has lags.  A block's share is one product of its returns with its
    returns filtered by the kernel; shares are summed.
    """
    weights = np.asarray(kernel.array(np.arange(kernel.lags(n, bandwidth) + 1) / bandwidth), float)
    weights[0] = 0.0  # lag 0 counts once and without a weight
    first = returns.agg(F.min("k").alias("k")).first()["k"] or 0
    rows = with_halo(returns.select("asset", "k", "r"), F.col("k") - first, max(BLOCK, len(weights)), before=len(weights) - 1)

    def work(table: pa.Table) -> pa.Table:
        names = sorted(table.column("asset").unique().to_pylist())
        k = table.column("k").to_numpy()
        low, own = int(k.min()), int(k[np.asarray(table.column("own").combine_chunks().cast(pa.uint8())) == 1].min(initial=k.max() + 1))
        x = np.zeros((int(k.max()) - low + 1, len(names)))
        at = {a: i for i, a in enumerate(names)}
        x[k - low, [at[a] for a in table.column("asset").to_pylist()]] = table.column("r").to_numpy()
        mine = x[own - low :]
        lagged = np.stack([filtered(x[:, i], weights)[own - low :] for i in range(len(names))], axis=1)
        side = mine.T @ lagged
        total = mine.T @ mine + side + side.T
        out = [(a, b, float(total[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], ["a", "b", "cov"])

    shares = rows.groupBy("part").applyInArrow(work, "a string, b string, cov double")
    return shares.groupBy("a", "b").agg(F.sum("cov").alias("cov"))


def mean_ticks(ticks: Ticks, assets: list[str]) -> float:
    return sampling.tick_counts(ticks.only(assets)).agg(F.avg("number_of_ticks").alias("n")).first()["n"]


def bnhls(ticks: Ticks, assets: list[str], kernel: Kernel = PARZEN, bandwidth: float | None = None, grid: DataFrame | None = None) -> DataFrame:
    """Realised kernel over refresh-time returns, as covariance over the whole extent; ``grid``: refresh times if known."""
    bandwidth = kernel.bandwidth(mean_ticks(ticks, assets)) if bandwidth is None else bandwidth
    grid = materialise(sampling.refresh_times(ticks, assets), "refresh-times") if grid is None else grid
    returns = sampling.returns(sampling.latest_value(ticks, grid, assets))
    return realised_kernel(returns, kernel, bandwidth, max(0, grid.count() - 1))


def orthogonal_sine(t: Column, j: Column, block: Column, width: float) -> Column:
    start = block * width
    return F.when(t > start, F.lit(math.sqrt(2 * width)) / (j * math.pi) * F.sin(j * math.pi * (t - start) / width)).otherwise(F.lit(0.0))


def spectral_blocks(ticks: Ticks, assets: list[str], *, num_j: int = 100, num_blocks: int = 10, width: float | None = None, noise: DataFrame | None = None) -> DataFrame:
    """(block, a, b, cov): spot covariance of each block from spectral statistics.

    The sine transform of a tick is exploded over frequencies and summed per
    (block, asset, frequency) before anything is shuffled.  A block without
    ticks has no rows.
    """
    hi = ticks.extent()[1]
    width = hi / num_blocks if width is None else width
    noise = two_scales_volatility(ticks, assets).select("asset", "noise") if noise is None else noise
    r = sampling.tick_returns(Ticks(ticks.only(assets).df.where("t > 0"), ticks.period, ticks.chunk))
    r = r.withColumn("block", F.least(F.lit(num_blocks - 1), F.floor(F.col("t") / width)).cast("int")).withColumn("gap", F.col("t") - F.col("p_t"))
    centre = F.col("p_t") + 0.5 * F.col("gap")
    waves = r.select("block", "asset", "r", centre.alias("centre"), F.explode(F.sequence(F.lit(1), F.lit(num_j))).alias("j"))
    term = (F.lit(math.pi) * F.col("j") / width) * F.col("r") * orthogonal_sine(F.col("centre"), F.col("j"), F.col("block"), width)
    s = waves.groupBy("block", "j", "asset").agg(F.sum(term).alias("s"))
    h = r.join(F.broadcast(noise), "asset").groupBy("block", "asset").agg((F.sum(F.col("gap") * F.col("gap")) * F.first("noise") / width).alias("h"))  # a row per asset
    mean = pairs_of(s, ["block", "j"], "s").groupBy("block", "a", "b").agg((F.sum(F.col("x") * F.col("y")) / num_j).alias("cov"))
    squares = (math.pi / width) ** 2 * sum(j * j for j in range(1, num_j + 1)) / num_j
    own = h.select("block", F.col("asset").alias("a"), F.col("asset").alias("b"), "h")
    return mean.join(own, ["block", "a", "b"], "left").select("block", "a", "b", (F.col("cov") - F.coalesce("h", F.lit(0.0)) * squares).alias("cov"))


def preaveraged_returns(ticks: Ticks, k: int, g: Preaveraging = TRIANGLE) -> DataFrame:
    """(asset, i, t, d, y): weighted sums y of the k - 1 returns from the i-th on; t is the time of return i.

    Returns are cut into parts, each with the k - 1 returns after it, and a
    part is filtered as one array.
    """
    d = previous(ticks).where(F.col("p_t").isNotNull()).select("asset", "t", "seq", (F.col("value") - F.col("p_value")).alias("value"))
    diffs = ranked(Ticks(d, ticks.period, ticks.chunk)).select("asset", F.col("rn").cast("int").alias("i"), "t", F.col("value").alias("d"))
    sizes = diffs.groupBy("asset").agg(F.max("i").alias("n"))
    rows = with_halo(diffs, F.col("i") - 1, max(PART, 2 * k), after=max(0, k - 2))
    rows = rows.join(F.broadcast(sizes), "asset")  # a row per asset
    weights = np.array(g.weights(k), float)[::-1]

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("i")
        own = np.asarray(table.column("own").combine_chunks().cast(pa.uint8())) == 1
        i, n, x = table.column("i").to_numpy(), table.column("n").to_numpy(), table.column("d").to_numpy()
        ahead = np.concatenate((x, np.zeros(len(weights))))
        y = filtered(ahead, weights)[len(weights) - 1 :][: len(x)] if len(weights) else np.zeros(len(x))
        out = table.select(["asset", "i", "t", "d"]).append_column("y", pa.array(y, mask=i > n - k + 1))
        return out.filter(pa.array(own))

    return rows.groupBy("asset", "part").applyInArrow(work, "asset string, i int, t double, d double, y double")


def overlap_sums(y: DataFrame, pairs: list[tuple[str, str]], k: int, psi: float, chunk: float | None = None) -> DataFrame:
    """(a, b, cov) of pairs: sum of products of preaveraged returns whose windows overlap.

    What b sums up to while a window of a lasts is the difference of b's
    running sum at two times.  Both are as-of joins, chunked in time, of all
    pairs at once; no pair of returns is listed and no asset is one task.
    """
    names = y.sparkSession.createDataFrame(list(pairs), "a string, b string")
    lengths = y.groupBy("asset").agg(F.count("y").alias("len"))
    rows = with_halo(y.select("asset", F.col("i").cast("long").alias("i"), "t", "y"), F.col("i") - 1, max(PART, 2 * k), after=k)
    rows = rows.withColumn("end", F.lead("t", k).over(Window.partitionBy("asset", "part").orderBy("i"))).where("own")
    rows = running_sum(rows, ["asset"], "i", {"sum": F.coalesce("y", F.lit(0.0))}).join(F.broadcast(lengths), "asset")  # a row per asset
    rows = materialise(rows.select("asset", "i", "t", "end", "y", "sum", "len"), "running-sums")
    own = rows.where(F.col("end").isNotNull() & F.col("y").isNotNull() & (F.col("i") <= F.col("len") - k + 2)).withColumnRenamed("asset", "a").join(F.broadcast(names), "a")  # a row per pair given
    # At its time the sum has reached return i; of windows that start before, it has left return i k returns later.
    reached = Ticks(rows.select("asset", "t", F.col("i").alias("seq"), F.col("sum").alias("value")), chunk=chunk)
    left = Ticks(rows.where(F.col("end").isNotNull()).select("asset", F.col("end").alias("t"), F.col("i").alias("seq"), F.col("sum").alias("value")), chunk=chunk)
    asked = own.select(F.col("b").alias("asset"), F.col("i").alias("k"), "t", "end", "a", "y")
    high = as_of(reached, asked.drop("t").withColumnRenamed("end", "t"), fill_first=False, carry=("a", "y"))
    low = as_of(left, asked.drop("end"), strict=True, fill_first=False, carry=("a", "y"))
    both = high.unionByName(low.withColumn("y", -F.col("y")))
    total = both.groupBy("a", F.col("asset").alias("b")).agg((F.sum(F.col("y") * F.coalesce("value", F.lit(0.0))) / (psi * k) ** 2).alias("cov"))
    return names.join(total, ["a", "b"], "left").select("a", "b", F.coalesce("cov", F.lit(0.0)).alias("cov"))


def own_overlap_sum(y: DataFrame, k: int, psi: float) -> DataFrame:
    """(a, b, cov) with a = b: each preaveraged return times the centred sum around it, as a difference of running sums."""
    made = y.where(F.col("y").isNotNull()).select("asset", F.col("i").cast("long").alias("i"), "y")
    sizes = made.groupBy("asset").agg(F.count("*").alias("n"))
    rows = with_halo(made, F.col("i") - 1, max(PART, 2 * k), before=k, after=k)
    w = Window.partitionBy("asset", "part").orderBy("i")
    rows = rows.withColumn("sum", F.sum("y").over(w))
    around = F.lead("sum", k - 1).over(w) - F.coalesce(F.lag("sum", k).over(w), F.lit(0.0))
    rows = rows.withColumn("around", around).where("own").join(F.broadcast(sizes), "asset")  # a row per asset
    inner = rows.where((F.col("i") >= k) & (F.col("i") <= F.col("n") - 2 * k + 1))
    return inner.groupBy("asset").agg((F.sum(F.col("y") * F.col("around")) / (psi * k) ** 2).alias("cov")).select(F.col("asset").alias("a"), F.col("asset").alias("b"), "cov")


def preaveraging_window(ticks: int, theta: float = 0.15) -> int:
    return math.ceil(min(ticks / 2, theta * math.sqrt(ticks)))


def preaveraged(ticks: Ticks, assets: list[str], *, theta: float = 0.15, g: Preaveraging = TRIANGLE, window: int | None = None) -> DataFrame:
    """(a, b, cov) of the preaveraged overlap estimator, all pairs; the window comes from the whole table."""
    k = preaveraging_window(ticks.df.count(), theta) if window is None else window
    y = materialise(preaveraged_returns(ticks.only(assets), k, g), "preaveraged")
    pairs = [(a, b) for x, a in enumerate(assets) for b in assets[x + 1 :]]
    own = own_overlap_sum(y, k, g.psi)
    return own.unionByName(overlap_sums(y, pairs, k, g.psi, ticks.chunk)) if pairs else own


def two_scales_correlations(ticks: Ticks, assets: list[str], *, equal_weight: bool = False, num_grids: float | None = None, min_obs: int = 10, fallback: float = math.nan, seed: int = 2604, vols: DataFrame | None = None) -> DataFrame:
    """(a, b, cor) for a < b from sums and differences of prices at pairwise refresh times; ``vols``: two-scales volatilities if known."""
    grids = default_num_grids(ticks) if num_grids is None else num_grids
    vols = materialise(two_scales_volatility(ticks, assets, grids), "volatilities") if vols is None else vols
    pairs = [(a, b) for i, a in enumerate(assets) for b in assets[i + 1 :]]
    times = sampling.refresh_times_of_pairs(ticks, pairs)
    both = times.select("a", "b", "k", "t", F.explode(F.array("a", "b")).alias("asset"))
    keyed = materialise(both, "pair-times")  # an asset is sampled on the grids of all its pairs at once
    price = _pair_prices(ticks, keyed, assets, seed)
    wide = price.groupBy("a", "b", "k", "t").agg(F.max(F.when(F.col("asset") == F.col("a"), F.col("value"))).alias("x"), F.max(F.when(F.col("asset") == F.col("b"), F.col("value"))).alias("y"))
    va, vb = vols.select(F.col("asset").alias("a"), F.col("volatility").alias("va")), vols.select(F.col("asset").alias("b"), F.col("volatility").alias("vb"))
    names = ticks.spark.createDataFrame(pairs, "a string, b string").join(va, "a").join(vb, "b")
    gamma = F.lit(0.5) if equal_weight else F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.col("vb") / (F.col("va") + F.col("vb"))))
    names = names.withColumn("gamma", gamma)
    wide = wide.join(F.broadcast(names.select("a", "b", "gamma")), ["a", "b"])  # a row per pair
    px, py = F.col("gamma") * F.col("x"), (1 - F.col("gamma")) * F.col("y")
    four = wide.select("a", "b", (F.col("k") + 1).cast("int").alias("rn"), "t", "x", "y", (px + py).alias("plus"), (px - py).alias("minus"))
    found = two_scales_many(materialise(four, "pair-prices"), ["a", "b"], grids, ["plus", "minus", "x", "y"])
    per = names.join(found, ["a", "b"])
    v = lambda name: F.col(f"volatility_{name}")
    cov = (v("plus") ** 2 - v("minus") ** 2) / (4 * F.col("gamma") * (1 - F.col("gamma")))
    eps = float(np.finfo(float).eps)
    cor = F.when((F.col("va") < eps) | (F.col("vb") < eps), F.lit(0.0)).when(F.col("n") < min_obs, F.lit(fallback)).otherwise(cov / (v("x") * v("y")))
    return per.select("a", "b", cor.alias("cor"))


def _pair_prices(ticks: Ticks, keyed: DataFrame, assets: list[str], seed: int) -> DataFrame:
    """(a, b, asset, k, t, value): random ticks in the intervals of each pair's refresh times."""
    numbered = ranked(ticks.only(assets))
    asked = keyed.select("asset", "k", "t", "a", "b")
    places = as_of(Ticks(numbered, ticks.period, ticks.chunk), asked, F.col("rn").cast("double"), carry=("a", "b")).withColumn("hi", F.col("value").cast("int"))
    places = with_halo(places.drop("value"), F.col("k"), PART, before=1)
    w = Window.partitionBy("a", "b", "asset", "part").orderBy("k")
    places = places.withColumn("lo", F.least(F.col("hi"), F.coalesce(F.lag("hi").over(w), F.lit(1)) + 1)).where("own")
    rn = (F.col("lo") + F.floor(sampling.pick_number(F.col("k"), F.col("asset"), seed) * (F.col("hi") - F.col("lo") + 1))).cast("int")
    return places.select("a", "b", "asset", "k", "t", rn.alias("rn")).join(numbered.select("asset", "rn", "value"), ["asset", "rn"]).drop("rn")
