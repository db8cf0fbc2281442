"""Random matrices, draws of returns, and simulated tick tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.functions import linalg
from tickweave.functions.periods import Period
from tickweave.operators.matrices import CovarianceMatrix, CovarianceModel
from tickweave.operators.ordered import running_sum, with_halo
from tickweave.operators.sampling import global_rank
from tickweave.sources.ticks import Ticks

#: Steps of a path that one task takes.
PART = 100_000


def random_psd(dims: int, rng: np.random.Generator) -> np.ndarray:
    """A draw of the inverse Wishart distribution with d degrees of freedom."""
    g = rng.standard_normal((dims, dims))
    return np.linalg.inv(g @ g.T)


def _correlated(columns: list[str], chol: np.ndarray, i: int):
    return sum((F.col(columns[k]) * F.lit(float(chol[i, k])) for k in range(i + 1)), F.lit(0.0))


def get_draws(spark: SparkSession, source: CovarianceMatrix | CovarianceModel, n: int, *, seed: int = 1234, antithetic: bool = False) -> DataFrame:
    """n draws over one period, a column per label (and ``draw``); antithetic ones negate the draw before."""
    cm = source.cm if isinstance(source, CovarianceModel) else source
    shift = source.means + source.drifts if isinstance(source, CovarianceModel) else np.zeros(len(cm.labels))
    chol = np.linalg.cholesky(cm.covariance())
    z = [f"_z{k}" for k in range(len(cm.labels))]
    rows = spark.range(math.ceil(n / 2) if antithetic else n)
    for k, name in enumerate(z):
        rows = rows.withColumn(name, F.randn(seed + k))
    if antithetic:
        rows = rows.withColumn("_s", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).withColumn("draw", 2 * F.col("id") + F.when(F.col("_s") < 0, 1).otherwise(0)).where(F.col("draw") < n)
    else:
        rows = rows.withColumn("_s", F.lit(1.0)).withColumn("draw", F.col("id"))
    return rows.select("draw", *[(F.lit(float(shift[i])) + F.col("_s") * _correlated(z, chol, i)).alias(x) for i, x in enumerate(cm.labels)])


@dataclass(frozen=True)
class Path:
    ticks: Ticks
    truth: CovarianceMatrix
    noise: dict[str, float]
    rates: dict[str, float]


def random_path(spark: SparkSession, dims: int, n_ticks: int, *, synchronous: bool = False, seed: int = 1, vols=None, rates=None, noise=None, assets=None, correlation=None, period: Period = Period()) -> Path:  # noqa: B008
    """A correlated Brownian path seen at regular (synchronous) or exponential arrival times, with noise.

    Volatilities per second are drawn between a tenth and a half a year (252
    days of 8 hours), the noise (a variance) is the square of a draw between the
    same bounds scaled to five minutes, and times between arrivals have means
    between 0.5 and 5; all can be given.

    Arrival times and increments are random numbers made from row numbers;
    arrival times and levels are running sums, cut into parts.  In the asynchronous case all assets move on the merged
    clock and each is seen at its own arrivals.
    """
    rng = np.random.default_rng(seed)
    assets = list(assets or [f"asset_{i + 1}" for i in range(dims)])
    low, high = (x / math.sqrt(252 * 8 * 3600) for x in (0.1, 0.5))
    five_minutes = math.sqrt(Period("Minute", 5).ratio(period))
    vols = np.asarray(vols if vols is not None else rng.uniform(low, high, dims), float)
    rates = np.asarray(rates if rates is not None else rng.uniform(0.5, 5.0, dims), float)
    noise = np.asarray(noise if noise is not None else rng.uniform(low * five_minutes, high * five_minutes, dims) ** 2, float)
    cor = linalg.cov_to_cor(random_psd(dims, rng))[0] if correlation is None else linalg.upper_symmetric(np.asarray(correlation, float))
    truth = CovarianceMatrix(cor, vols, tuple(assets), period)
    chol = np.linalg.cholesky(truth.covariance())
    z = [f"_z{k}" for k in range(dims)]
    if synchronous:
        step = float(rates.mean())
        clock = spark.range(1, math.ceil(n_ticks / dims) + 1).select("id", (F.col("id") * F.lit(step)).alias("t"), F.lit(step).alias("dt"), F.array(*[F.lit(a) for a in assets]).alias("who"))
    else:
        clock = _arrivals(spark, assets, rates, n_ticks, seed)
    clock = clock.withColumn("part", F.floor(F.col("id") / PART)).withColumns({name: _normal(F.col("id"), seed * 101 + k) for k, name in enumerate(z)})
    levels = running_sum(clock, [], "id", {f"_l{i}": F.sqrt("dt") * _correlated(z, chol, i) for i in range(dims)})
    level = F.create_map(*[x for i, a in enumerate(assets) for x in (F.lit(a), F.col(f"_l{i}"))])
    seen = levels.select("id", "t", level.alias("level"), F.explode("who").alias("asset"))
    scale = F.create_map(*[x for a, v in zip(assets, noise, strict=True) for x in (F.lit(a), F.lit(math.sqrt(v)))])
    value = F.col("level")[F.col("asset")] + scale[F.col("asset")] * _normal(F.xxhash64("id", "asset"), seed * 997)
    ticks = seen.select("asset", "t", value.alias("value"), F.col("id").cast("long").alias("seq"))
    chunk = n_ticks / float((1 / rates).sum()) * PART / n_ticks if n_ticks > PART else None
    return Path(Ticks(ticks, period, chunk), truth, dict(zip(assets, noise.tolist(), strict=True)), dict(zip(assets, rates.tolist(), strict=True)))


def _uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on a key and a seed alone, so that a lost part is made again as it was."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(key: Column, seed: int) -> Column:
    return F.sqrt(-2 * F.log(_uniform(key, 2 * seed))) * F.cos(2 * math.pi * _uniform(key, 2 * seed + 1))


def _arrivals(spark: SparkSession, assets: list[str], rates: np.ndarray, n_ticks: int, seed: int) -> DataFrame:
    """(id, t, dt, who): the first ``n_ticks`` of all assets' exponential arrivals on one clock, id from 1."""
    share = n_ticks / rates / (1 / rates).sum()
    wanted = [min(n_ticks, math.ceil(x + 12 * math.sqrt(x) + 100)) for x in share]  # twelve deviations more than expected
    rows = spark.createDataFrame([(a, float(r), n) for a, r, n in zip(assets, rates, wanted, strict=True)], "asset string, rate double, n long")
    gaps = spark.range(max(wanted)).withColumn("part", F.floor(F.col("id") / PART)).join(F.broadcast(rows), F.col("id") < F.col("n"))  # a row per asset
    gap = -F.log(1 - _uniform(F.xxhash64("id", "asset"), seed * 31)) * F.col("rate")
    own = running_sum(gaps.withColumn("gap", gap), ["asset"], "id", {"t": F.col("gap")})
    span = n_ticks / float((1 / rates).sum())
    pool = Ticks(own.select("asset", "t", F.lit(0.0).alias("value"), F.col("id").alias("seq")), chunk=span * min(1.0, PART / n_ticks))
    first = global_rank(pool).where(F.col("rn") <= n_ticks)
    cut = with_halo(first, F.col("rn") - 1, PART, before=1)
    before = F.lag("t").over(Window.partitionBy("part").orderBy("rn"))
    timed = cut.withColumn("dt", F.col("t") - F.coalesce(before, F.lit(0.0))).where("own")
    return timed.select(F.col("rn").alias("id"), "t", "dt", F.array("asset").alias("who"))
