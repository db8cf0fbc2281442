"""Dense algebra on covariance matrices: the d x d end of every estimator."""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
TOLERANCE = 10 * EPS


def clean(m: np.ndarray) -> bool:
    return bool(np.isfinite(m).all())


def upper_symmetric(m: np.ndarray) -> np.ndarray:
    """The symmetric matrix whose upper triangle is that of ``m``."""
    up = np.triu(np.asarray(m, float))
    return up + np.triu(up, 1).T


def cov_to_cor(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation (diagonal exactly 1) and standard deviations."""
    sd = np.sqrt(np.diag(cov))
    cor = cov / np.outer(sd, sd)
    np.fill_diagonal(cor, 1.0)
    return cor, sd


def cor_to_cov(cor: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return cor * np.outer(sd, sd)


def cov_to_cor_and_vol(cov: np.ndarray, elapsed: float, wanted: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Correlation and volatility per ``wanted`` from a covariance over ``elapsed``."""
    cor, sd = cov_to_cor(cov)
    return cor, sd / math.sqrt(elapsed / wanted)


def from_eigen(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (vectors * values) @ vectors.T


def is_psd(m: np.ndarray, least: float = 0.0) -> bool:
    """All eigenvalues strictly above ``least``; an empty matrix is not."""
    return bool(len(m)) and bool(np.linalg.eigvalsh(m).min() > least)


def is_correlation(m: np.ndarray, least: float = 0.0) -> bool:
    if not clean(m) or not is_psd(m, least):
        return False
    return bool((np.abs(np.diag(m) - 1) < TOLERANCE).all() and (np.abs(m) <= 1 + TOLERANCE).all())


def squared_frobenius(m: np.ndarray) -> float:
    return float((m * m).sum() / len(m))


def squared_frobenius_distance(a: np.ndarray, b: np.ndarray) -> float:
    return squared_frobenius(a - b)


def weighted_mean(x: np.ndarray, w: np.ndarray) -> float:
    """NaN of nothing, x of one value, the plain mean of weights that vanish."""
    if not len(x):
        return math.nan
    if len(x) == 1:
        return float(x[0])
    return float(np.mean(x)) if np.abs(w).sum() < 100 * EPS else float((x * w).sum() / w.sum())


# --- towards the identity -------------------------------------------------


def shrink_to_identity(m: np.ndarray, weight: float) -> np.ndarray:
    return weight * np.eye(len(m)) + (1 - weight) * m


def shrinkage_weight(m: np.ndarray, returns: np.ndarray, *, strict: bool = False) -> float:
    """Weight of the identity from the scatter of the returns' outer products around ``m``.

    ``strict`` uses the mean of the diagonal and squared norms, as the
    estimator is usually stated.
    """
    scatter = scatter_of(m, returns)
    total = float(scatter.sum()) if strict else float(np.sqrt(scatter).sum())
    return weight_of_scatter(m, total, len(returns), strict=strict)


def scatter_of(m: np.ndarray, returns: np.ndarray) -> np.ndarray:
    """Squared distance of each row's outer product from ``m``, by its expansion."""
    norms = (returns * returns).sum(axis=1)
    distance = norms**2 - 2 * np.einsum("ki,ij,kj->k", returns, m, returns) + (m * m).sum()
    return np.maximum(distance / len(m), 0)


def weight_of_scatter(m: np.ndarray, total: float, n: int, *, strict: bool = False) -> float:
    """The weight from the summed scatter of n rows (squared if ``strict``, else of its roots)."""
    p = len(m)
    level = float(np.trace(m) / p) if strict else squared_frobenius(m - np.eye(p))
    d2 = squared_frobenius(m - level * np.eye(p))
    if strict:
        return min(total / n**2, d2) / d2
    d = math.sqrt(d2)
    return min(total / n**2, d) / d


def identity_regularisation(m: np.ndarray, returns: np.ndarray, *, strict: bool = False) -> np.ndarray:
    return shrink_to_identity(m, shrinkage_weight(m, returns, strict=strict))


# --- eigenvalues ----------------------------------------------------------


def eigenvalue_clean(m: np.ndarray, threshold: float) -> np.ndarray:
    """Eigenvalues below the threshold get one value, their mean or a share of the threshold."""
    if not clean(m):
        return m
    values, vectors = np.linalg.eigh(m)
    small = values < threshold
    if small.any():
        values = values.copy()
        values[small] = max(threshold / (4 * small.sum()), float(values[small].mean()))
    return from_eigen(values, vectors)


def noise_threshold(m: np.ndarray, obs: float) -> float:
    """Largest eigenvalue that noise alone would give with this many observations per asset."""
    n = len(m)
    diagonal = np.diag(m)
    level = float(np.sqrt(diagonal[diagonal > 0]).mean()) if (diagonal > 0).any() else 0.0
    variance = 1 - float(np.linalg.eigvalsh(m).max()) / n
    q = obs / n
    return variance * (1 + 1 / q + 2 * math.sqrt(1 / q)) * level**2


def eigenvalue_clean_for(m: np.ndarray, obs: float) -> np.ndarray:
    return eigenvalue_clean(m, noise_threshold(m, obs)) if clean(m) else m


# --- nearest correlation matrix -------------------------------------------


def root_psd(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return from_eigen(np.sqrt(np.maximum(values, 0)), vectors)


def project_to_unit_diagonal(a: np.ndarray, w_inverse: np.ndarray) -> np.ndarray:
    """Closest matrix (in the weighted norm) with a diagonal of ones."""
    if np.array_equal(w_inverse, np.diag(np.diag(w_inverse))):
        out = a.copy()
        np.fill_diagonal(out, 1.0)
        return out
    theta = np.linalg.solve(w_inverse * w_inverse, np.diag(a) - 1)
    return a - w_inverse @ np.diag(theta) @ w_inverse


def project_to_psd(a: np.ndarray, w_root: np.ndarray | None = None, w_root_inverse: np.ndarray | None = None) -> np.ndarray:
    """Closest positive semi-definite matrix in the weighted norm; a positive definite one is returned as it is."""
    root = np.eye(len(a)) if w_root is None else w_root
    back = np.linalg.inv(root) if w_root_inverse is None else w_root_inverse
    values, vectors = np.linalg.eigh(root @ a @ root)
    if (values > 0).all():
        return a
    return back @ from_eigen(np.maximum(values, 0), vectors) @ back


def alternate(y: np.ndarray, correction: np.ndarray, w_root: np.ndarray, w_inverse: np.ndarray, w_root_inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of alternating projections with a correction term."""
    r = y - correction
    x = project_to_psd(r, w_root, w_root_inverse)
    return project_to_unit_diagonal(x, w_inverse), x - r


def nearest_correlation(m: np.ndarray, weights: np.ndarray | None = None, *, dykstra: bool = True, stop_at_first: bool = True, max_iterates: int = 1000) -> tuple[np.ndarray, int, str]:
    """Nearest correlation matrix, the number of steps, and how it ended.

    A matrix with missing cells is returned as it is.
    """
    if not clean(m):
        return m, 0, "not_finite"
    w = np.eye(len(m)) if weights is None else np.asarray(weights, float)
    w_root = root_psd(w)
    w_inverse, w_root_inverse = np.linalg.inv(w), np.linalg.inv(w_root)
    y, correction, steps = upper_symmetric(m), np.zeros_like(m), 1
    while steps < max_iterates:
        y, moved = alternate(y, correction, w_root, w_inverse, w_root_inverse)
        y = (y + y.T) / 2
        correction = moved if dykstra else np.zeros_like(y)
        if stop_at_first and is_correlation(y):
            return y, steps, "already_valid_correlation_matrix"
        steps += 1
    return y, steps, "reached_maxiter"


def nearest_psd(m: np.ndarray) -> np.ndarray:
    """Nearest positive definite matrix: projection, then a touch of the identity if one eigenvalue is still 0."""
    if not clean(m):
        return m
    out = project_to_psd(upper_symmetric(m))
    if not is_psd(out):
        out = (1 - 100 * EPS) * out + 100 * EPS * np.eye(len(m))
    return out


def _identity(m: np.ndarray, *, weight: float | None = None, returns: np.ndarray | None = None, strict: bool = False) -> np.ndarray:
    if weight is not None:
        return shrink_to_identity(m, weight)
    if returns is None:
        raise ValueError("identity_regularisation needs a weight or returns")
    return identity_regularisation(m, returns, strict=strict)


def _eigenvalues(m: np.ndarray, *, obs: float | None = None, threshold: float | None = None) -> np.ndarray:
    if threshold is not None:
        return eigenvalue_clean(m, threshold)
    if obs is None:
        raise ValueError("eigenvalue_clean needs a threshold or the number of observations per asset")
    return eigenvalue_clean_for(m, obs)


def _nearest(m: np.ndarray, *, weights: np.ndarray | None = None, dykstra: bool = True, stop_at_first: bool = True, max_iterates: int = 1000) -> np.ndarray:
    return nearest_correlation(m, weights, dykstra=dykstra, stop_at_first=stop_at_first, max_iterates=max_iterates)[0]


#: By name; each takes a matrix and its own options, and an option that it does not know is an error.
REGULARISERS = {
    "covariance_default": nearest_psd,
    "nearest_psd_matrix": nearest_psd,
    "correlation_default": _nearest,
    "nearest_correlation_matrix": _nearest,
    "eigenvalue_clean": _eigenvalues,
    "identity_regularisation": _identity,
}
