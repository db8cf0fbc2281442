"""Estimators by name: from ticks to a regularised matrix, and blockwise estimation."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions import linalg
from tickweave.functions.kernels import PARZEN, TRIANGLE
from tickweave.operators import covariance as C
from tickweave.operators import sampling
from tickweave.operators.matrices import CovarianceMatrix, combine_matrices, matrix_from_pairs
from tickweave.operators.volatility import default_num_grids, simple_volatility, two_scales_volatility
from tickweave.sources.ticks import Ticks
from tickweave.workspace import drop_tables, materialise


def _warn(method: str, why: str) -> None:
    warnings.warn(f"Cannot estimate the correlation matrix with the {method} method: {why}.", stacklevel=3)


def identity_weight(m: np.ndarray, ticks: Ticks, assets: list[str], spacing: float | None = None, *, strict: bool = False) -> float:
    """Weight of the identity from returns per square root of time, at refresh times or on a grid from 0.

    Rows are compared with ``m`` where they are; the driver gets a sum.
    """
    grid = sampling.refresh_times(ticks, assets) if spacing is None else sampling.even_grid(ticks, spacing, start=0.0)
    r = sampling.returns(sampling.latest_value(ticks, grid, assets), rescale=True)
    rows = r.groupBy("k").pivot("asset", assets).agg(F.first("r")).drop("k")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scatter = linalg.scatter_of(m, np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns], axis=1))
            total = scatter.sum() if strict else np.sqrt(scatter).sum()
            yield pa.RecordBatch.from_arrays([pa.array([len(scatter)], pa.int64()), pa.array([float(total)], pa.float64())], ["n", "total"])

    got = rows.mapInArrow(work, "n long, total double").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return linalg.weight_of_scatter(m, got["total"], got["n"], strict=strict)


def regularise_array(m: np.ndarray, ticks: Ticks, assets: list[str], method: str | None, *, only_if_not_psd: bool = False, **given) -> np.ndarray:
    if method is None or (only_if_not_psd and linalg.clean(m) and linalg.is_psd(m)):
        return m
    if method not in linalg.REGULARISERS:
        raise ValueError(f"unknown regularisation {method!r}")
    if method == "eigenvalue_clean" and not given.keys() & {"obs", "threshold"}:
        given["obs"] = ticks.df.count() / len(assets)
    if method == "identity_regularisation" and not given.keys() & {"returns", "weight"}:
        given["weight"] = identity_weight(m, ticks, assets, given.pop("spacing", None), strict=given.pop("strict", False))
    return linalg.REGULARISERS[method](m, **given)


def _finish(m: np.ndarray, ticks: Ticks, assets: list[str], elapsed: float, method: str | None, only: bool, given: dict | None) -> CovarianceMatrix:
    m = regularise_array(m, ticks, assets, method, only_if_not_psd=only, **(given or {}))
    return CovarianceMatrix.from_covariance(m, assets, elapsed, ticks.period)


def simple_covariance(ticks: Ticks, assets: list[str] | None = None, *, regularisation: str | None = "covariance_default", regularisation_params: dict | None = None, only_if_not_psd: bool = False, grid: DataFrame | None = None, spacing: float | None = None, refresh_times: bool = False, rough: int = 5) -> CovarianceMatrix:
    assets = assets or sampling.asset_names(ticks)
    grid = C.time_grid(ticks, spacing=spacing, refresh=refresh_times, rough=rough, assets=assets) if grid is None else grid
    grid = materialise(grid, "grid")
    shape = grid.agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span")).first()
    if shape["n"] < 3:
        _warn("simple", "there are too few sampling times")
        return CovarianceMatrix.unknown(assets, ticks.period)
    step = ticks.period.times(shape["span"] / (shape["n"] - 1)).ns / ticks.period.ns
    m = matrix_from_pairs(C.grid_covariance(ticks, grid, assets), assets)
    drop_tables(grid)
    return _finish(m, ticks, assets, step, regularisation, only_if_not_psd, regularisation_params)


def bnhls_covariance(ticks: Ticks, assets: list[str] | None = None, *, regularisation: str | None = "covariance_default", regularisation_params: dict | None = None, only_if_not_psd: bool = False, kernel=PARZEN, bandwidth: float | None = None, m: int = 2) -> CovarianceMatrix:
    assets = assets or sampling.asset_names(ticks)
    grid = materialise(sampling.refresh_times(ticks, assets), "refresh-times")
    refreshes = grid.count()
    if m >= (refreshes - 1) / 2:
        _warn("bnhls", f"{refreshes} refresh times are too few")
        return CovarianceMatrix.unknown(assets, ticks.period)
    raw = matrix_from_pairs(C.bnhls(ticks, assets, kernel, bandwidth, grid), assets)
    drop_tables(grid)
    return _finish(raw, ticks, assets, sampling.duration(ticks), regularisation, only_if_not_psd, regularisation_params)


def spectral_covariance(ticks: Ticks, assets: list[str] | None = None, *, regularisation: str | None = "covariance_default", regularisation_params: dict | None = None, only_if_not_psd: bool = False, num_j: int = 100, num_blocks: int = 10, width: float | None = None, noise: DataFrame | None = None, strict: bool = False) -> CovarianceMatrix:
    """Equal-weight mean of the blocks' matrices; ``strict`` leaves out blocks without ticks."""
    assets = assets or sampling.asset_names(ticks)
    lo, hi = ticks.extent()
    width = (hi - lo) / num_blocks if width is None else width
    cells = C.spectral_blocks(ticks, assets, num_j=num_j, num_blocks=num_blocks, width=width, noise=noise).collect()  # d * d cells per block
    at = {a: i for i, a in enumerate(assets)}
    blocks = np.zeros((num_blocks, len(assets), len(assets)))
    full = np.zeros(num_blocks, bool)
    for r in cells:
        blocks[r["block"], at[r["a"]], at[r["b"]]] = blocks[r["block"], at[r["b"]], at[r["a"]]] = r["cov"]
        full[r["block"]] = True
    done = [_finish(b, ticks, assets, 1.0, regularisation, only_if_not_psd, regularisation_params) for b, ok in zip(blocks, full, strict=True) if ok or not strict]
    return combine_matrices(done)


def preaveraged_covariance(ticks: Ticks, assets: list[str] | None = None, *, regularisation: str | None = "covariance_default", regularisation_params: dict | None = None, only_if_not_psd: bool = False, drop_short: bool = False, theta: float = 0.15, g=TRIANGLE) -> CovarianceMatrix:
    assets = assets or sampling.asset_names(ticks)
    n = ticks.df.count()
    k = C.preaveraging_window(n, theta)
    counts = {r.asset: r.number_of_ticks for r in sampling.tick_counts(ticks).collect()}
    short = [a for a in assets if counts.get(a, 0) - k < 1]
    if short:
        if not drop_short:
            _warn("preaveraged", f"{n} ticks are too few for {', '.join(short)}")
            return CovarianceMatrix.unknown(assets, ticks.period)
        assets = [a for a in assets if a not in short]
    raw = matrix_from_pairs(C.preaveraged(ticks, assets, theta=theta, g=g), assets)
    raw = regularise_array(raw, ticks, assets, regularisation, only_if_not_psd=only_if_not_psd, **(regularisation_params or {}))
    cor = linalg.cov_to_cor(raw)[0] if (np.diag(raw) > 0).all() else CovarianceMatrix.unknown(assets).correlation
    vols = {r.asset: r.volatility for r in two_scales_volatility(ticks, assets).collect()}
    return CovarianceMatrix(cor, np.array([vols.get(a, np.nan) for a in assets]), tuple(assets), ticks.period)


def two_scales_covariance(ticks: Ticks, assets: list[str] | None = None, *, regularisation: str | None = "correlation_default", regularisation_params: dict | None = None, only_if_not_psd: bool = False, equal_weight: bool = False, num_grids: float | None = None, min_obs: int = 10, fallback: float = float("nan")) -> CovarianceMatrix:
    assets = assets or sampling.asset_names(ticks)
    grids = default_num_grids(ticks) if num_grids is None else num_grids
    own = materialise(two_scales_volatility(ticks, assets, grids), "volatilities")
    raw = matrix_from_pairs(C.two_scales_correlations(ticks, assets, equal_weight=equal_weight, num_grids=grids, min_obs=min_obs, fallback=fallback, vols=own), assets, "cor")
    np.fill_diagonal(raw, 1.0)
    if not linalg.clean(raw):
        _warn("two scales", "some pairs have too few common observations")
    cor = regularise_array(raw, ticks, assets, regularisation, only_if_not_psd=only_if_not_psd, **(regularisation_params or {}))
    vols = {r.asset: r.volatility for r in own.collect()}
    drop_tables(own)
    return CovarianceMatrix(cor, np.array([vols.get(a, np.nan) for a in assets]), tuple(assets), ticks.period)


COVARIANCE = {
    "simple_covariance": simple_covariance,
    "bnhls_covariance": bnhls_covariance,
    "spectral_covariance": spectral_covariance,
    "preaveraged_covariance": preaveraged_covariance,
    "two_scales_covariance": two_scales_covariance,
}
VOLATILITY = {"simple_volatility": simple_volatility, "two_scales_volatility": lambda t, a=None, **k: two_scales_volatility(t, a, **k).select("asset", "volatility")}


def estimate_covariance(ticks: Ticks, assets: list[str] | None = None, method: str = "preaveraged_covariance", *, regularisation: str | None = "default", **given) -> CovarianceMatrix:
    """Any estimator by name; ``default`` regularises correlations for two scales and covariances otherwise."""
    if method not in COVARIANCE:
        raise ValueError(f"unknown method {method!r}")
    if regularisation == "default":
        regularisation = "correlation_default" if method == "two_scales_covariance" else "covariance_default"
    return COVARIANCE[method](ticks, assets, regularisation=regularisation, **given)


def estimate_volatility(ticks: Ticks, assets: list[str] | None = None, method: str = "two_scales_volatility", **given) -> DataFrame:
    if method not in VOLATILITY:
        raise ValueError(f"unknown method {method!r}")
    return VOLATILITY[method](ticks, assets, **given)


def estimate_microstructure_noise(ticks: Ticks, assets: list[str] | None = None, num_grids: float | None = None) -> DataFrame:
    return two_scales_volatility(ticks, assets, num_grids).select("asset", "noise")


def regularise(cm: CovarianceMatrix, ticks: Ticks, method: str = "nearest_correlation_matrix", *, on_covariance: bool | None = None, **given) -> CovarianceMatrix:
    """A matrix regularised with what the ticks say (number of observations, returns)."""
    labels = list(cm.labels)
    if method == "eigenvalue_clean" and "threshold" not in given:
        given.setdefault("obs", ticks.df.count() / len(labels))
    if method == "identity_regularisation" and not given.keys() & {"weight", "returns"}:
        on_covariance = True if on_covariance is None else on_covariance
        m = cm.covariance() if on_covariance else cm.correlation
        given["weight"] = identity_weight(m, ticks, labels, given.pop("spacing", None), strict=given.pop("strict", False))
    return cm.regularise(method, on_covariance=on_covariance, **given)


# --- blocks ----------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """Assets estimated together, how, and how often they tick."""

    assets: frozenset[str]
    method: str = "preaveraged_covariance"
    parameters: dict = field(default_factory=dict)
    mean_number_of_ticks: float = 0.0
    mean_time_per_tick: float = 0.0

    @property
    def number_of_assets(self) -> int:
        return len(self.assets)


def groups_by_rate(rates: list[tuple[str, float]], multiple: float) -> list[list[str]]:
    """Assets in order of their rate; a new group where a rate exceeds its group's first by ``multiple`` times it."""
    out: list[list[str]] = []
    start = 0.0
    for asset, rate in sorted(rates, key=lambda x: x[1]):
        if not out or rate / start - 1 > multiple:
            out.append([])
            start = rate
        out[-1].append(asset)
    return out


def adjacent_blocks(groups: list[list[str]]) -> list[frozenset[str]]:
    """All groups together, then the same for the first and the second half of them."""
    if not groups:
        return []
    whole = frozenset(a for g in groups for a in g)
    if len(groups) == 1:
        return [whole]
    half = len(groups) // 2
    return [whole, *adjacent_blocks(groups[:half]), *adjacent_blocks(groups[half:])]


def sorted_adjacent_blocks(groups: list[list[str]]) -> list[frozenset[str]]:
    return sorted(adjacent_blocks(groups), key=len, reverse=True)


def blocks_by_frequency(ticks: Ticks, multiple: float, method: str = "preaveraged_covariance", parameters: dict | None = None) -> list[Block]:
    """The plan of a blockwise estimation of the assets that count as observed, largest block first."""
    names = set(sampling.asset_names(ticks))
    stats = {r.asset: r for r in sampling.time_between_refreshes(ticks).collect() if r.asset in names}  # one row per asset
    groups = groups_by_rate([(a, r.time_between_ticks) for a, r in stats.items()], multiple)
    out = []
    for block in sorted_adjacent_blocks(groups):
        n = float(np.mean([stats[a].number_of_ticks for a in block]))
        rate = float(np.mean([stats[a].time_between_ticks for a in block]))
        out.append(Block(block, method, dict(parameters or {}), n, rate))
    return out


def blockwise_estimation(ticks: Ticks, blocks: list[Block], *, at_once: int = 4) -> CovarianceMatrix:
    """Estimates of all blocks, ``at_once`` of them at a time; a later block's valid cells replace an earlier one's."""
    if not blocks:
        raise ValueError("no blocks")
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        found = list(pool.map(lambda b: estimate_covariance(ticks, sorted(b.assets), b.method, **b.parameters), blocks))
    return reduce(lambda old, new: combine_matrices([old, new], [0.0, 1.0]), found)
