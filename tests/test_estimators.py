"""Estimators against the truth of simulated noisy paths, and their last step against numpy."""

from dataclasses import replace

import numpy as np
import pytest

from tests.conftest import SF
from tickweave import catalogue
from tickweave.functions import linalg
from tickweave.operators import covariance as C
from tickweave.operators import matrices, simulation
from tickweave.operators import volatility as V
from tickweave.operators.matrices import CovarianceMatrix, CovarianceModel
from tickweave.plans import estimate
from tickweave.workspace import materialise

# Volatilities, noise variances and numbers of ticks of the documented example, and the errors it had there.
VOLS = [0.0157077, 0.0137856, 0.00484516, 0.0142265]
NOISE = [0.00216696, 0.0092135, 0.000226909, 0.000938589]
TICKS = [1964, 1340, 3242, 3454]
ERRORS = {
    "simple_covariance": (0.5321534542489482, 0.010511960080115556),
    "bnhls_covariance": (0.7422120933301078, 0.006815323622470541),
    "spectral_covariance": (0.5227424813357473, 0.007669889385330695),
    "preaveraged_covariance": (0.1840684108352901, 0.0022421828719004925),
    "two_scales_covariance": (0.38238270061443486, 0.0022421828719004925),
}


@pytest.fixture(scope="module")
def paths(spark):
    made = [simulation.random_path(spark, 4, sum(TICKS), seed=s, vols=VOLS, noise=NOISE, rates=[6_000 / n for n in TICKS]) for s in (1, 2, 3)]
    return [replace(p, ticks=replace(p.ticks, df=materialise(p.ticks.df, "path"))) for p in made]


@pytest.mark.parametrize("method", sorted(ERRORS))
def test_errors_are_those_of_the_documented_example(paths, method):
    errors = [matrices.mean_abs_distance(estimate.estimate_covariance(p.ticks, list(p.truth.labels), method), p.truth) for p in paths]
    cor, vol = np.mean(errors, axis=0)
    # The example is one path of another generator, so the order of magnitude is compared.
    assert cor <= 1.5 * ERRORS[method][0] and vol <= 1.5 * ERRORS[method][1]


def test_noise_and_volatility_of_paths(paths):
    for path in paths:
        counts = {r.asset: r["count"] for r in path.ticks.df.groupBy("asset").count().collect()}
        assert sum(counts.values()) == sum(TICKS) and all(abs(counts[f"asset_{i + 1}"] / n - 1) < 0.15 for i, n in enumerate(TICKS))
        for r in V.two_scales_volatility(path.ticks).collect():
            i = int(r.asset[-1]) - 1
            assert abs(r.noise / NOISE[i] - 1) < 0.2 and 0.7 < r.volatility / VOLS[i] < 1.5


def test_paths_are_the_same_twice_and_noisy_by_default(spark):
    one, two = (simulation.random_path(spark, 3, 500, seed=5) for _ in range(2))
    rows = lambda p: sorted(map(tuple, p.ticks.df.collect()))
    assert rows(one) == rows(two) and all(v > 0 for v in one.noise.values())
    assert 3.6e-5 < min(one.truth.volatility) and max(one.truth.volatility) < 1.9e-4


def raw(spark, name, value="cov"):
    return matrices.matrix_from_pairs(catalogue.QUERIES[name](spark, SF), catalogue.ASSETS, value)


def cells(spark, name):
    return matrices.matrix_from_frame(catalogue.QUERIES[name](spark, SF)).rearrange(catalogue.ASSETS)


def test_last_step_of_kernel_estimate(spark):
    """The raw cells have an oracle; what follows is the nearest matrix, split over the elapsed time."""
    ticks = catalogue.types(spark, SF)
    lo, hi = ticks.extent()
    want = linalg.nearest_psd(matrices.matrix_from_pairs(C.bnhls(ticks, catalogue.ASSETS), catalogue.ASSETS))
    cor, vol = linalg.cov_to_cor_and_vol(want, hi - lo)
    got = cells(spark, "estimate_bnhls")
    assert np.allclose(got.correlation, cor, atol=1e-5) and np.allclose(got.volatility, vol, atol=1e-5)


def test_last_step_of_preaveraged_estimate(spark):
    vols = {r.asset: r.volatility for r in catalogue.QUERIES["two_scales_volatility"](spark, SF).collect()}
    cor, _ = linalg.cov_to_cor(linalg.nearest_psd(raw(spark, "preaveraged_raw")))
    got = cells(spark, "estimate_preaveraged")
    assert np.allclose(got.correlation, cor, atol=1e-4) and np.allclose(got.volatility, [vols[a] for a in catalogue.ASSETS], atol=1e-5)


def test_last_step_of_two_scales_estimate(spark):
    m = raw(spark, "two_scales_correlations", "cor")
    np.fill_diagonal(m, 1.0)
    got = cells(spark, "estimate_two_scales")
    assert np.allclose(got.correlation, linalg.nearest_correlation(m)[0], atol=1e-4)


def test_last_step_of_spectral_estimate(spark):
    made = []
    ticks = catalogue.types(spark, SF)
    lo, hi = ticks.extent()
    blocks = C.spectral_blocks(ticks, catalogue.ASSETS, width=(hi - lo) / 10).collect()
    for k in range(10):
        m = np.zeros((5, 5))
        for r in blocks:
            if r["block"] == k:
                i, j = catalogue.ASSETS.index(r["a"]), catalogue.ASSETS.index(r["b"])
                m[i, j] = m[j, i] = r["cov"]
        made.append(CovarianceMatrix.from_covariance(linalg.nearest_psd(m), catalogue.ASSETS, 1.0, ticks.period))
    want = matrices.combine_matrices(made)
    got = cells(spark, "estimate_spectral")
    assert np.allclose(got.correlation, want.correlation, atol=1e-5, equal_nan=True) and np.allclose(got.volatility, want.volatility, atol=1e-5, equal_nan=True)


def test_blocks_one_by_one_or_at_once(spark):
    ticks = catalogue.types(spark, SF)
    blocks = estimate.blocks_by_frequency(ticks, 0.005, "simple_covariance", {"spacing": 3_600.0})
    one, many = (estimate.blockwise_estimation(ticks, blocks, at_once=n) for n in (1, 4))
    assert one.labels == many.labels and np.allclose(one.correlation, many.correlation)
    with pytest.raises(ValueError):
        estimate.blockwise_estimation(ticks, [])


# --- options and forms ---------------------------------------------------------

CM = CovarianceMatrix(np.array([[1, 0.4, 0.2], [0.4, 1, 0.1], [0.2, 0.1, 1]]), [0.1, 0.2, 0.3], ("a", "b", "c"))


def test_identity_of_a_matrix_by_weight():
    on_cor = CM.regularise("identity_regularisation", weight=0.25)
    assert np.allclose(on_cor.correlation, 0.25 * np.eye(3) + 0.75 * CM.correlation) and np.allclose(on_cor.volatility, CM.volatility)
    on_cov = CM.regularise("identity_regularisation", weight=0.25, on_covariance=True)
    assert np.allclose(on_cov.covariance(), 0.25 * np.eye(3) + 0.75 * CM.covariance())


def test_options_that_are_missing_or_unknown():
    for given in ({"obs": 3}, {"nothing": 1}):
        with pytest.raises(TypeError):
            CM.regularise("nearest_psd_matrix", **given)
    with pytest.raises(TypeError):
        CM.regularise("nearest_correlation_matrix", wieghts=np.eye(3))
    for method in ("identity_regularisation", "eigenvalue_clean"):
        with pytest.raises(ValueError):
            CM.regularise(method)
    assert np.allclose(CM.regularise("eigenvalue_clean", threshold=0.0).covariance(), CM.covariance())


def test_identity_weight_is_that_of_collected_returns(spark):
    from tickweave.operators import sampling

    ticks = catalogue.types(spark, SF)
    grid = sampling.refresh_times(ticks, catalogue.ASSETS)
    r = sampling.returns(sampling.latest_value(ticks, grid, catalogue.ASSETS), rescale=True).toPandas().pivot(index="k", columns="asset", values="r")[catalogue.ASSETS].to_numpy()
    m = np.cov(r.T)
    for strict in (False, True):
        assert estimate.identity_weight(m, ticks, catalogue.ASSETS, strict=strict) == pytest.approx(linalg.shrinkage_weight(m, r, strict=strict))
    cm = CovarianceMatrix.from_covariance(m, catalogue.ASSETS, 1.0, ticks.period)
    got = estimate.regularise(cm, ticks, "identity_regularisation")
    assert np.allclose(got.covariance(), linalg.identity_regularisation(cm.covariance(), r))


def test_models_shown_and_compared():
    one, two = CovarianceModel(CM, [1, 2, 3], [0, 0, 0.5]), CovarianceModel(CM.rearrange(["c", "a", "b"]), [3, 1, 2], [0.5, 0, 0])
    assert "mean 2" in one.show() and "a: " in repr(one)
    assert matrices.mean_abs_covariance_distance(one, two) == pytest.approx(0) and matrices.mean_abs_covariance_distance(one, CM) == pytest.approx(0)


def test_long_filters_equal_direct_sums():
    rng = np.random.default_rng(0)
    x, w = rng.standard_normal(5_000), rng.standard_normal(900)
    assert np.allclose(C.filtered(x, w), np.convolve(x, w)[:5_000])
