"""Covariance matrices and models as values, and as long tables that Spark can join and aggregate."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import linalg
from tickweave.functions.periods import NANOSECONDS, Period, scale_drift, scale_volatility

LONG = "asset1 string, asset2 string, value double, variable string, vol_period_units string, vol_period long"
DECIMALS = 8


@dataclass(frozen=True)
class CovarianceMatrix:
    """Correlations and volatilities per ``period``; covariances are derived."""

    correlation: np.ndarray
    volatility: np.ndarray
    labels: tuple[str, ...]
    period: Period = Period()

    def __post_init__(self) -> None:
        object.__setattr__(self, "correlation", np.asarray(self.correlation, float))
        object.__setattr__(self, "volatility", np.asarray(self.volatility, float))
        object.__setattr__(self, "labels", tuple(self.labels))

    @classmethod
    def unknown(cls, labels, period: Period = Period()) -> CovarianceMatrix:  # noqa: B008
        n = len(labels)
        cor = np.full((n, n), np.nan)
        np.fill_diagonal(cor, 1.0)
        return cls(cor, np.full(n, np.nan), tuple(labels), period)

    @classmethod
    def from_covariance(cls, cov: np.ndarray, labels, elapsed: float, period: Period) -> CovarianceMatrix:
        """Splits a covariance over ``elapsed`` units; a diagonal that is not positive gives an unknown matrix."""
        if not (np.diag(cov) > 0).all():
            return cls.unknown(labels, period)
        return cls(*linalg.cov_to_cor_and_vol(cov, elapsed), tuple(labels), period)

    def _at(self, label: str) -> int | None:
        return self.labels.index(label) if label in self.labels else None

    def get_correlation(self, a: str, b: str) -> float | None:
        i, j = self._at(a), self._at(b)
        return None if i is None or j is None else float(self.correlation[i, j])

    def get_volatility(self, a: str, period: Period | None = None) -> float | None:
        i = self._at(a)
        return None if i is None else scale_volatility(float(self.volatility[i]), self.period, period or self.period)

    def covariance(self, period: Period | None = None, labels=None) -> np.ndarray:
        mine = self.rearrange(labels or self.labels, period)
        return linalg.cor_to_cov(mine.correlation, mine.volatility)

    def rearrange(self, labels=None, period: Period | None = None) -> CovarianceMatrix:
        """Another order or a subset of labels, volatilities in another period."""
        labels, period = tuple(labels or self.labels), period or self.period
        if set(labels) - set(self.labels):
            raise ValueError("labels that are not in the matrix")
        at = [self.labels.index(x) for x in labels]
        vol = self.volatility[at] * math.sqrt(period.ratio(self.period))
        return replace(self, correlation=self.correlation[np.ix_(at, at)], volatility=vol, labels=labels, period=period)

    def relabel(self, names: dict[str, str]) -> CovarianceMatrix:
        return replace(self, labels=tuple(names.get(x, x) for x in self.labels))

    def is_psd(self, least: float = 0.0) -> bool:
        return linalg.is_psd(self.correlation, least)

    def is_valid(self, least: float = 0.0) -> bool:
        return linalg.is_correlation(self.correlation, least)

    def regularise(self, method: str = "nearest_correlation_matrix", *, on_covariance: bool | None = None, only_if_not_psd: bool = False, **given) -> CovarianceMatrix:
        """A regularised copy; on the covariance (then split again) or on the correlation alone.

        The default is the covariance, but for a given weight of the identity the correlation.
        """
        if method not in linalg.REGULARISERS:
            raise ValueError(f"unknown regularisation {method!r}")
        if on_covariance is None:
            on_covariance = "weight" not in given
        if only_if_not_psd and self.is_psd():
            return self
        if method in ("nearest_correlation_matrix", "correlation_default") or not on_covariance:
            return replace(self, correlation=linalg.REGULARISERS[method](self.correlation, **given))
        cov = linalg.REGULARISERS[method](self.covariance(), **given)
        if not linalg.clean(cov):
            return self
        cor, vol = linalg.cov_to_cor(cov)
        return replace(self, correlation=cor, volatility=vol)

    def __repr__(self) -> str:
        return self.show()

    def show(self, significant: int = 4, decimals: int = 4) -> str:
        head = f"volatilities per {self.period.count} {self.period.unit}"
        rows = [f"{x}: {v:.{significant}g}  " + " ".join(f"{c:.{decimals}f}" for c in row) for x, v, row in zip(self.labels, self.volatility, self.correlation, strict=True)]
        return "\n".join([head, *rows])

    # --- long form --------------------------------------------------------

    def rows(self, *, half: bool = True) -> list[tuple]:
        n = len(self.labels)
        cells = [(i, j) for i in range(n) for j in range(n) if i < j or not half]
        out = [(self.labels[i], self.labels[j], float(self.correlation[i, j]), "correlation", None, None) for i, j in cells]
        return out + [(x, x, float(v), "volatility", self.period.unit, self.period.count) for x, v in zip(self.labels, self.volatility, strict=True)]

    def to_frame(self, spark: SparkSession, constants: dict | None = None, *, half: bool = True) -> DataFrame:
        df = spark.createDataFrame(self.rows(half=half), LONG)
        for name, value in (constants or {}).items():
            df = df.withColumn(name, F.lit(value))
        return df


def _period_of(unit: str | None, count) -> Period:
    if unit not in NANOSECONDS:
        raise ValueError(f"unknown unit {unit!r}")
    return Period(unit, int(count))


def _matrix_of(rows: list, complete: bool) -> CovarianceMatrix:
    vols = [r for r in rows if r["variable"] == "volatility"]
    labels = [r["asset1"] for r in vols]
    n, cor = len(labels), {}
    for r in rows:
        if r["variable"] == "correlation":
            cor[r["asset1"], r["asset2"]] = r["value"]
    out = np.eye(n)
    for i in range(n):
        for j in range(i + 1, n):
            value = cor.get((labels[i], labels[j]), cor.get((labels[j], labels[i])))
            if value is None and complete:
                raise ValueError(f"no correlation of {labels[i]} and {labels[j]}")
            out[i, j] = out[j, i] = math.nan if value is None else value
    period = _period_of(vols[0]["vol_period_units"], vols[0]["vol_period"]) if vols else Period()
    vol = [scale_volatility(r["value"], _period_of(r["vol_period_units"], r["vol_period"]), period) for r in vols]
    return CovarianceMatrix(out, np.array(vol), tuple(labels), period)


def matrix_from_frame(df: DataFrame, *, complete: bool = False) -> CovarianceMatrix:
    """The matrix of a long table, in any order of rows; absent pairs are NaN or, if ``complete``, an error."""
    return _matrix_of(df.select("asset1", "asset2", "value", "variable", "vol_period_units", "vol_period").collect(), complete)


def pairs_frame(spark: SparkSession, cm: CovarianceMatrix) -> DataFrame:
    """(a, b, cov), a before b or the same: the covariances of a matrix over its unit."""
    cov = cm.covariance()
    return spark.createDataFrame([(a, b, float(cov[i, j])) for i, a in enumerate(cm.labels) for j, b in enumerate(cm.labels) if i <= j], "a string, b string, cov double")


def matrix_from_pairs(rows: DataFrame, labels: list[str], value: str = "cov") -> np.ndarray:
    """A symmetric array of rows (a, b, value); d * d cells reach the driver, absent ones are NaN."""
    at = {x: i for i, x in enumerate(labels)}
    out = np.full((len(labels), len(labels)), np.nan)
    for r in rows.collect():
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = np.nan if r[value] is None else r[value]
    return out


@dataclass(frozen=True)
class CovarianceModel:
    """A matrix with means (independent of time) and drifts (per the matrix's period)."""

    cm: CovarianceMatrix
    means: np.ndarray
    drifts: np.ndarray

    def __post_init__(self) -> None:
        object.__setattr__(self, "means", np.asarray(self.means, float))
        object.__setattr__(self, "drifts", np.asarray(self.drifts, float))

    @classmethod
    def unknown(cls, labels, period: Period = Period()) -> CovarianceModel:  # noqa: B008
        nan = np.full(len(labels), np.nan)
        return cls(CovarianceMatrix.unknown(labels, period), nan, nan.copy())

    def get_mean(self, a: str) -> float | None:
        i = self.cm._at(a)
        return None if i is None else float(self.means[i])

    def get_drift(self, a: str, period: Period | None = None) -> float | None:
        i = self.cm._at(a)
        return None if i is None else scale_drift(float(self.drifts[i]), self.cm.period, period or self.cm.period)

    def rearrange(self, labels=None, period: Period | None = None, *, strict: bool = False) -> CovarianceModel:
        """Reorders; without ``strict`` a reordering in the same period fills the drifts with the means."""
        labels, period = tuple(labels or self.cm.labels), period or self.cm.period
        cm = self.cm.rearrange(labels, period)
        at = [self.cm.labels.index(x) for x in labels]
        same = period == self.cm.period
        if same and labels == self.cm.labels:
            return self
        drifts = self.means[at] if same and not strict else self.drifts[at] * period.ratio(self.cm.period)
        return CovarianceModel(cm, self.means[at], drifts)

    def relabel(self, names: dict[str, str], *, strict: bool = False) -> CovarianceModel:
        """Renames; without ``strict`` means and drifts change places."""
        cm = self.cm.relabel(names)
        return CovarianceModel(cm, self.means, self.drifts) if strict else CovarianceModel(cm, self.drifts, self.means)

    def covariance_and_mean(self, period: Period | None = None, labels=None, *, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
        mine = self.rearrange(labels, self.cm.period, strict=strict)
        period = period or self.cm.period
        return mine.cm.covariance(period), mine.means + mine.drifts * period.ratio(self.cm.period)

    def conditional(self, assets, returns, interval: Period) -> CovarianceModel:
        """The distribution of the other assets given returns of some over an interval."""
        rest = [x for x in self.cm.labels if x not in assets]
        order = rest + list(assets)
        cov = self.cm.covariance(interval, order)
        mean = np.array([self.get_mean(x) + self.get_drift(x, interval) for x in order])
        n = len(rest)
        weights = np.linalg.solve(cov[n:, n:], cov[n:, :n]).T
        residual = np.asarray(returns, float) - mean[n:]
        left = cov[:n, :n] - weights @ cov[n:, :n]
        cor, vol = linalg.cov_to_cor((left + left.T) / 2)
        means = np.array([self.get_mean(x) for x in rest]) + weights @ residual
        drifts = np.array([self.get_drift(x, interval) for x in rest])
        return CovarianceModel(CovarianceMatrix(cor, vol, tuple(rest), interval), means, drifts)

    def conditional_means(self, df: DataFrame, assets: list[str], interval: Period) -> DataFrame:
        """Adds <asset>_mean for the other assets to rows with a column of returns per given asset.

        The weights do not depend on the returns, so a row is a dot product.
        """
        zero = self.conditional(assets, [0.0] * len(assets), interval)
        unit = [self.conditional(assets, [1.0 if i == k else 0.0 for i in range(len(assets))], interval) for k in range(len(assets))]
        for i, x in enumerate(zero.cm.labels):
            terms = [F.col(a) * F.lit(float(unit[k].means[i] - zero.means[i])) for k, a in enumerate(assets)]
            df = df.withColumn(f"{x}_mean", sum(terms, F.lit(float(zero.means[i]))))
        return df

    def __repr__(self) -> str:
        return self.show()

    def show(self, significant: int = 4, decimals: int = 4) -> str:
        own = [f"{x}: mean {m:.{significant}g}, drift {d:.{significant}g}" for x, m, d in zip(self.cm.labels, self.means, self.drifts, strict=True)]
        return "\n".join([self.cm.show(significant, decimals), *own])

    def rows(self, *, half: bool = True) -> list[tuple]:
        p = self.cm.period
        own = [(x, x, float(v), kind, p.unit, p.count) for kind, values in (("drift", self.drifts), ("mean", self.means)) for x, v in zip(self.cm.labels, values, strict=True)]
        return self.cm.rows(half=half) + own

    def to_frame(self, spark: SparkSession, constants: dict | None = None, *, half: bool = True) -> DataFrame:
        df = spark.createDataFrame(self.rows(half=half), LONG)
        for name, value in (constants or {}).items():
            df = df.withColumn(name, F.lit(value))
        return df


def model_from_frame(df: DataFrame, *, complete: bool = False) -> CovarianceModel:
    rows = df.select("asset1", "asset2", "value", "variable", "vol_period_units", "vol_period").collect()
    cm = _matrix_of(rows, complete)
    found: dict[str, dict[str, float]] = {"mean": {}, "drift": {}}
    for r in rows:
        if r["variable"] in found:
            value = r["value"]
            if r["variable"] == "drift":
                value = scale_drift(value, _period_of(r["vol_period_units"], r["vol_period"]), cm.period)
            found[r["variable"]][r["asset1"]] = value
    pick = lambda kind: np.array([found[kind].get(x, math.nan) for x in cm.labels])
    return CovarianceModel(cm, pick("mean"), pick("drift"))


# --- combination and distance --------------------------------------------


def _valid(x) -> bool:
    return x is not None and math.isfinite(x)


def combine_matrices(matrices: list[CovarianceMatrix], cor_weights=None, vol_weights=None, period: Period | None = None) -> CovarianceMatrix:
    """Weighted mean per cell over the matrices that know it; labels in order of first appearance."""
    if not matrices:
        raise ValueError("no matrices to combine")
    period = period or matrices[0].period
    cw = np.ones(len(matrices)) if cor_weights is None else np.asarray(cor_weights, float)
    vw = cw if vol_weights is None else np.asarray(vol_weights, float)
    labels = tuple(dict.fromkeys(x for m in matrices for x in m.labels))

    def mean(values: list, weights: np.ndarray) -> float:
        ok = [i for i, v in enumerate(values) if _valid(v)]
        return linalg.weighted_mean(np.array([values[i] for i in ok]), weights[ok])

    cor = np.eye(len(labels))
    for i, a in enumerate(labels):
        for j in range(i + 1, len(labels)):
            cor[i, j] = cor[j, i] = mean([m.get_correlation(a, labels[j]) for m in matrices], cw)
    vol = np.array([mean([m.get_volatility(a, period) for m in matrices], vw) for a in labels])
    return CovarianceMatrix(cor, vol, labels, period)


def combine_models(models: list[CovarianceModel], cor_weights=None, vol_weights=None, drift_weights=None, mean_weights=None, period: Period | None = None) -> CovarianceModel:
    cm = combine_matrices([m.cm for m in models], cor_weights, vol_weights, period)
    base = np.ones(len(models)) if cor_weights is None else np.asarray(cor_weights, float)

    def mean(get, weights) -> np.ndarray:
        w = base if weights is None else np.asarray(weights, float)
        out = []
        for a in cm.labels:
            values = [get(m, a) for m in models]
            ok = [i for i, v in enumerate(values) if _valid(v)]
            out.append(linalg.weighted_mean(np.array([values[i] for i in ok]), w[ok]))
        return np.array(out)

    return CovarianceModel(cm, mean(lambda m, a: m.get_mean(a), mean_weights), mean(lambda m, a: m.get_drift(a, cm.period), drift_weights))


def combine_long(df: DataFrame, weight: str = "weight") -> DataFrame:
    """(asset1, asset2, variable, value): weighted means of long tables that were stacked with a weight column.

    Pairs meet in either direction; cells that are null, NaN or infinite are
    left out; weights that vanish give the plain mean.
    """
    x, y = F.least("asset1", "asset2").alias("asset1"), F.greatest("asset1", "asset2").alias("asset2")
    valid = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))
    own = df.select(x, y, "variable", F.when(valid, F.col("value")).alias("v"), F.when(valid, F.col(weight)).alias("w"))
    n, plain = F.count("v"), F.avg("v")
    mean = F.when(n == 0, F.lit(math.nan)).when(n == 1, F.max("v")).when(F.sum(F.abs("w")) < 100 * linalg.EPS, plain).otherwise(F.sum(F.col("v") * F.col("w")) / F.sum("w"))
    return own.groupBy("asset1", "asset2", "variable").agg(mean.alias("value"))


def mean_abs_distance(x: CovarianceMatrix, y: CovarianceMatrix, *, nan_if_labels_differ: bool = True) -> tuple[float, float]:
    """Errors of correlations and volatilities; the first counts each pair twice over the number of pairs."""
    if set(x.labels) != set(y.labels) and nan_if_labels_differ:
        return math.nan, math.nan
    labels = [a for a in x.labels if a in y.labels]
    p, q, n = x.rearrange(labels), y.rearrange(labels), len(labels)
    pairs = (n * n - n) / 2
    cor = float(np.abs(p.correlation - q.correlation).sum() / pairs) if pairs else math.nan
    return round(cor, DECIMALS), round(float(np.abs(p.volatility - q.volatility).mean()), DECIMALS)


def mean_abs_distance_of_values(x: dict[str, float], y: dict[str, float]) -> float:
    common = [a for a in x if a in y]
    return float(np.mean([abs(x[a] - y[a]) for a in common])) if common else math.nan


def mean_abs_distance_of_models(x: CovarianceModel, y: CovarianceModel, *, nan_if_labels_differ: bool = True, strict: bool = False) -> tuple[float, float, float, float]:
    """Errors of correlations, volatilities, drifts and means."""
    cor, vol = mean_abs_distance(x.cm, y.cm, nan_if_labels_differ=nan_if_labels_differ)
    if math.isnan(vol):
        return cor, vol, math.nan, math.nan
    labels = [a for a in x.cm.labels if a in y.cm.labels]
    p, q = x.rearrange(labels, strict=strict), y.rearrange(labels, strict=strict)
    return cor, vol, round(float(np.abs(p.drifts - q.drifts).mean()), DECIMALS), round(float(np.abs(p.means - q.means).mean()), DECIMALS)


def mean_abs_covariance_distance(x: CovarianceMatrix | CovarianceModel, y: CovarianceMatrix | CovarianceModel, *, nan_if_labels_differ: bool = True) -> float:
    """Mean absolute difference of the covariances over the natural unit, of matrices or of models."""
    x, y = (m.cm if isinstance(m, CovarianceModel) else m for m in (x, y))
    if set(x.labels) != set(y.labels) and nan_if_labels_differ:
        return math.nan
    labels = [a for a in x.labels if a in y.labels]
    return round(float(np.abs(x.covariance(labels=labels) - y.covariance(labels=labels)).mean()), DECIMALS)


# --- the same as joins on long tables -------------------------------------


def both_triangles(cov: DataFrame) -> DataFrame:
    """Rows (a, b, cov) for every ordered pair from rows with a <= b."""
    return cov.select("a", "b", "cov").unionByName(cov.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))


def correlations_of(cov: DataFrame) -> DataFrame:
    """(a, b, cor) of rows (a, b, cov); the diagonal is exactly 1."""
    own = cov.where("a = b")
    da, db = own.select("a", F.sqrt("cov").alias("sa")), own.select("b", F.sqrt("cov").alias("sb"))
    joined = cov.join(da, "a").join(db, "b")
    return joined.select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("cov") / (F.col("sa") * F.col("sb"))).alias("cor"))


def volatilities_of(cov: DataFrame, elapsed: float, wanted: float = 1.0) -> DataFrame:
    return cov.where("a = b").select(F.col("a").alias("asset"), (F.sqrt("cov") / math.sqrt(elapsed / wanted)).alias("volatility"))


def covariances_of(cor: DataFrame, vol: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(a, b, cov) of correlations and volatilities, scaled to a period that is ``ratio`` times as long."""
    va, vb = vol.select(F.col("asset").alias("a"), F.col("volatility").alias("va")), vol.select(F.col("asset").alias("b"), F.col("volatility").alias("vb"))
    return cor.join(va, "a").join(vb, "b").select("a", "b", (F.col("cor") * F.col("va") * F.col("vb") * ratio).alias("cov"))


def shrunk(cov: DataFrame, weight: float) -> DataFrame:
    """weight * identity + (1 - weight) * matrix, cell by cell."""
    eye = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.lit(0.0))
    return cov.select("a", "b", (weight * eye + (1 - weight) * F.col("cov")).alias("cov"))
