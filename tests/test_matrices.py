"""Algebra, regularisation, combination, serialisation, conditioning, clustering, simulation."""

import math

import numpy as np
import pytest

from tickweave.functions import linalg
from tickweave.functions.kernels import KERNELS, PARZEN, PARZEN_STRICT
from tickweave.functions.periods import Period
from tickweave.operators import clustering, matrices, simulation
from tickweave.operators.matrices import CovarianceMatrix, CovarianceModel
from tickweave.plans import estimate

NAMES = ("BARC", "HSBC", "VODL", "RYAL")
TRUTH = np.array([[1, 0.75, 0.5, 0], [0.75, 1, 0.5, 0.25], [0.5, 0.5, 1, 0.25], [0, 0.25, 0.25, 1]])
CM = CovarianceMatrix(TRUTH, [0.02, 0.03, 0.04, 0.05], NAMES, Period("Day"))
BAD = np.array([[1.02, 0.5, 0.9], [0.5, 0.98, 0.9], [0.9, 0.9, 1.01]])
WORSE = np.array([[1.02, 0.5, 0.9], [0.5, 0.98, -0.9], [0.9, -0.9, 1.01]])


def test_weighted_mean():
    w = lambda x, y: linalg.weighted_mean(np.array(x, float), np.array(y, float))
    assert math.isnan(w([], []))
    assert (w([5], [0]), w([1, 3], [0, 0]), w([1, 3], [1, 3])) == (5, 2, 2.5)


def test_parzen():
    assert PARZEN.array(np.array([0.25, 0.75, 1.0])).tolist() == [0.71875, 0.125, 0]
    assert PARZEN_STRICT.array(np.array([0.75]))[0] == 0.03125
    assert all(k.array(np.array([0.0]))[0] == pytest.approx(1) for k in KERNELS.values())


@pytest.mark.parametrize("bad", [BAD, WORSE, np.diag([1.02, 0.98, 1.05])])
@pytest.mark.parametrize("dykstra", [True, False])
def test_nearest_correlation(bad, dykstra):
    before = bad.copy()
    got, steps, how = linalg.nearest_correlation(bad, dykstra=dykstra)
    assert (bad == before).all()
    assert np.allclose(np.diag(got), 1, atol=1e-8) and np.linalg.eigvalsh(got).min() > -1e-8
    assert steps < 1000 and how == "already_valid_correlation_matrix" or steps == 1000


def test_weighted_projection():
    w = np.diag([1.0, 2.0, 3.0])
    inv = np.linalg.inv(w)
    assert np.allclose(np.diag(linalg.project_to_unit_diagonal(BAD, inv)), 1)
    full = np.array([[2, 0.3, 0.1], [0.3, 1, 0.2], [0.1, 0.2, 3]])
    assert np.allclose(np.diag(linalg.project_to_unit_diagonal(BAD, np.linalg.inv(full))), 1)
    assert np.linalg.eigvalsh(linalg.project_to_psd(WORSE, linalg.root_psd(full))).min() > -1e-9
    y, d = linalg.alternate(np.eye(4), np.zeros((4, 4)), np.eye(4), np.eye(4), np.eye(4))
    assert np.allclose(y, np.eye(4)) and np.allclose(d, 0)


def test_psd_and_eigenvalues():
    assert linalg.is_psd(linalg.nearest_psd(WORSE)) and not linalg.is_psd(WORSE) and not linalg.is_psd(np.zeros((0, 0)))
    cleaned = linalg.eigenvalue_clean_for(BAD, 50.0)
    assert linalg.is_psd(cleaned)
    hole = TRUTH.copy()
    hole[0, 1] = np.nan
    for f in (linalg.nearest_psd, lambda m: linalg.nearest_correlation(m)[0], lambda m: linalg.eigenvalue_clean(m, 0.1)):
        assert np.array_equal(f(hole), hole, equal_nan=True)
    r = np.random.default_rng(1).standard_normal((200, 3))
    for strict in (False, True):
        assert 0 <= linalg.shrinkage_weight(np.cov(r.T), r, strict=strict) <= 1


def test_brute_scatter():
    r = np.random.default_rng(2).standard_normal((50, 3))
    s = np.cov(r.T)
    m = linalg.squared_frobenius(s - np.eye(3))
    d = math.sqrt(linalg.squared_frobenius(s - m * np.eye(3)))
    b = sum(math.sqrt(linalg.squared_frobenius(np.outer(x, x) - s)) for x in r) / 50**2
    assert linalg.shrinkage_weight(s, r) == pytest.approx(min(b, d) / d)


def test_accessors_and_order():
    assert CM.get_correlation("BARC", "VODL") == 0.5 and CM.get_correlation("BARC", "nobody") is None
    assert CM.get_volatility("HSBC", Period("Hour")) == pytest.approx(0.03 / math.sqrt(24))
    part = CM.rearrange(["RYAL", "BARC"])
    assert part.labels == ("RYAL", "BARC") and part.correlation[0, 1] == 0
    with pytest.raises(ValueError):
        CM.rearrange(["nobody"])
    assert CM.relabel({"BARC": "B"}).labels[0] == "B"
    assert CM.is_valid() and CM.is_psd() and "BARC" in repr(CM)


def test_distance():
    two = lambda c: CovarianceMatrix([[1, c], [c, 1]], [1, 1], ("a", "b"))
    assert matrices.mean_abs_distance(two(0.5), two(0.0)) == (1.0, 0.0)
    assert math.isnan(matrices.mean_abs_distance(two(0.5), CM)[0])
    assert matrices.mean_abs_distance(CM, CM.rearrange(NAMES[::-1])) == (0.0, 0.0)
    assert matrices.mean_abs_covariance_distance(CM, CM) == 0
    assert matrices.mean_abs_distance_of_values({"a": 1, "b": 2}, {"b": 5}) == 3


def test_combination():
    left, right = CM.rearrange(["BARC", "HSBC"]), CM.rearrange(["VODL", "HSBC"])
    both = matrices.combine_matrices([left, right])
    assert both.labels == ("BARC", "HSBC", "VODL")
    assert math.isnan(both.get_correlation("BARC", "VODL")) and both.get_correlation("HSBC", "VODL") == 0.5
    assert both.get_volatility("HSBC") == pytest.approx(0.03)
    with pytest.raises(ValueError):
        matrices.combine_matrices([])


def test_round_trip(spark):
    model = CovarianceModel(CM, [0.05, 0.01, 0.01, -1.02], [0, 0, 0.1, 0.1])
    df = model.to_frame(spark, {"run": 7}).orderBy("value")
    again = matrices.model_from_frame(df)
    assert matrices.mean_abs_distance_of_models(model, again, strict=True) == (0, 0, 0, 0)
    full = CM.to_frame(spark, half=False)
    assert full.count() == 20
    assert matrices.mean_abs_distance(matrices.matrix_from_frame(full), CM) == (0, 0)
    with pytest.raises(ValueError):
        matrices.matrix_from_frame(df.where("variable <> 'correlation' and asset1 <> 'x'"), complete=True)


def test_model_quirks():
    model = CovarianceModel(CM, [1, 2, 3, 4], [5, 6, 7, 8])
    assert model.rearrange(NAMES[::-1]).drifts.tolist() == [4, 3, 2, 1]
    assert model.rearrange(NAMES[::-1], strict=True).drifts.tolist() == [8, 7, 6, 5]
    assert model.relabel({}).means.tolist() == [5, 6, 7, 8] and model.relabel({}, strict=True).means.tolist() == [1, 2, 3, 4]
    assert model.get_drift("BARC", Period("Week")) == 35 and model.get_mean("nobody") is None


def test_conditioning(spark):
    model = CovarianceModel(CM, np.zeros(4), np.zeros(4))
    got = model.conditional(["VODL", "HSBC", "RYAL"], [0.004, 0.002, 0.001], Period("Day"))
    assert got.means[0] == pytest.approx(0.001257575757575758)
    assert got.cm.volatility[0] == pytest.approx(0.012154310870109944)
    row = spark.createDataFrame([(0.004, 0.002, 0.001)], "VODL double, HSBC double, RYAL double")
    assert model.conditional_means(row, ["VODL", "HSBC", "RYAL"], Period("Day")).first()["BARC_mean"] == pytest.approx(0.001257575757575758)


def test_draws(spark):
    df = simulation.get_draws(spark, CM, 40_000, antithetic=True).toPandas()[list(NAMES)]
    assert np.allclose(df.mean(), 0, atol=1e-9) and np.allclose(df.std(), CM.volatility, rtol=0.03)
    assert np.allclose(df.corr(), TRUTH, atol=0.03)


@pytest.mark.parametrize("synchronous", [True, False])
def test_path(spark, synchronous):
    path = simulation.random_path(spark, 4, 2_000, synchronous=synchronous, seed=3, correlation=TRUTH, vols=CM.volatility, assets=NAMES)
    assert path.ticks.df.count() == 2_000
    found = estimate.estimate_covariance(path.ticks, list(NAMES), "simple_covariance", spacing=20.0)
    assert found.is_psd()


def test_blocks():
    assert estimate.adjacent_blocks([["a"], ["b"], ["c"]]) == [frozenset(x) for x in ("abc", "a", "bc", "b", "c")]
    assert estimate.groups_by_rate([("a", 1.0), ("b", 1.5), ("c", 4.0)], 1.2) == [["a", "b"], ["c"]]


def test_clustering():
    cor = np.array([[1, 0.1, 0.9], [0.1, 1, 0.1], [0.9, 0.1, 1]])
    tree = clustering.cluster(cor)
    assert set(tree.merges[0]) == {-1, -3} and len(clustering.dendrogram_segments(tree)) == 6
    cm = clustering.reorder_by_cluster(CovarianceMatrix(cor, [1, 1, 1], ("x", "y", "z")))
    assert abs(cm.labels.index("x") - cm.labels.index("z")) == 1
    with pytest.raises(ValueError):
        clustering.cluster(cor, "nothing")


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        estimate.estimate_covariance(None, ["a"], "nothing")
    with pytest.raises(ValueError):
        CM.regularise("nothing")
