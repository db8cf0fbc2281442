"""Chunked operators give the same whatever the chunks and parts; readers, ties and a caller's index."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tickweave import catalogue
from tickweave.functions import table_functions
from tickweave.functions.kernels import PARZEN
from tickweave.operators import covariance as C
from tickweave.operators import ordered, sampling
from tickweave.operators import volatility as V
from tickweave.sources import ticks as T
from tickweave.sources.ticks import Ticks

NAMES = ["A", "B", "C", "D"]


def random_ticks(spark, seed=1, n=600, chunk=None):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.0, 0.1, rng.random(), 4.0 if rng.random() < 0.02 else 0.3])
        rows.append((rng.choices(NAMES, [8, 4, 2, 1])[0], t, rng.gauss(0, 1) + 0.01 * i, i))
    return Ticks(spark.createDataFrame(rows, "asset string, t double, value double, seq long"), chunk=chunk), rows


def brute_refreshes(rows, assets):
    missing, out = set(assets), []
    for asset, t, _, _ in rows:
        missing.discard(asset)
        if not missing:
            out.append(t)
            missing = set(assets)
    return out


@pytest.mark.parametrize("chunk", [None, 0.2, 3.0, 50.0])
def test_refresh_times_of_any_chunks(spark, chunk):
    for seed, n in ((1, 600), (2, 40), (3, 5)):
        ticks, rows = random_ticks(spark, seed, n, chunk)
        got = sampling.refresh_times(ticks, NAMES).orderBy("k").collect()
        assert [r.k for r in got] == list(range(len(got))) and [r.t for r in got] == brute_refreshes(rows, NAMES)
        pairs = [("A", "B"), ("C", "D"), ("A", "D")]
        both = sampling.refresh_times_of_pairs(ticks, pairs).orderBy("a", "b", "k").collect()
        for a, b in pairs:
            assert [r.t for r in both if (r.a, r.b) == (a, b)] == brute_refreshes(rows, [a, b])


@pytest.mark.parametrize("chunk", [None, 0.2, 3.0, 50.0])
def test_refresh_times_in_sql_by_chunks(spark, chunk):
    table_functions.register(spark)
    for seed, n in ((1, 600), (2, 40), (3, 5)):
        ticks, rows = random_ticks(spark, seed, n)
        ticks.df.createOrReplaceTempView("chunked_ticks")
        for assets in (NAMES, ["A", "C"], ["B"], [*NAMES, "E"]):
            got = spark.sql(table_functions.refresh_times_sql("chunked_ticks", ",".join(assets), chunk)).orderBy("k").collect()
            assert [r.t for r in got] == brute_refreshes(rows, assets) and [r.k for r in got] == list(range(len(got)))


def test_refresh_times_with_an_asset_that_never_ticks(spark):
    ticks, _ = random_ticks(spark, chunk=5.0)
    assert sampling.refresh_times(ticks, [*NAMES, "E"]).count() == 0
    assert sampling.refresh_times(Ticks(ticks.df.limit(0), chunk=5.0), NAMES).count() == 0


def test_pieces_of_sorted_batches():
    chunks = [-4] * 3 + [-1] * 5 + [2] * 9 + [3]
    table = pa.table({"chunk": pa.array(chunks, pa.int64()), "row": range(len(chunks))})
    batches = [*table.slice(0, 4).to_batches(), *table.slice(0, 0).to_batches(), *table.slice(4, 10).to_batches(), *table.slice(14).to_batches()]
    got = [(chunk, piece.column("row").to_pylist()) for chunk, piece in sampling._pieces(iter(batches), 4)]
    assert got == [(-4, [0, 1, 2]), (-1, [3, 4, 5, 6]), (-1, [7]), (2, [8, 9, 10, 11]), (2, [12, 13, 14, 15]), (2, [16]), (3, [17])]


@pytest.mark.parametrize("chunk", [None, 50.0])
def test_a_chunk_is_read_in_pieces(spark, monkeypatch, chunk):
    """Ticks of one chunk, even of one time, are never held as a whole."""
    monkeypatch.setattr(sampling, "PIECE_ROWS", 7)
    ticks, rows = random_ticks(spark, 4, 500, chunk)
    assert [r.t for r in sampling.refresh_times(ticks, NAMES).orderBy("k").collect()] == brute_refreshes(rows, NAMES)
    both = sampling.refresh_times_of_pairs(ticks, [("A", "B"), ("C", "D")]).orderBy("k").collect()
    for a, b in [("A", "B"), ("C", "D")]:
        assert [r.t for r in both if (r.a, r.b) == (a, b)] == brute_refreshes(rows, [a, b])
    same = Ticks(ticks.df.withColumn("t", F.lit(1.0)), chunk=chunk)
    assert sampling.refresh_times(same, NAMES).count() == len(brute_refreshes(rows, NAMES))


def frame(df, *keys):
    return [tuple(r[k] for k in keys) for r in df.orderBy(*keys[:-1]).collect()]


def assert_close(x, y):
    assert len(x) == len(y) > 0
    for a, b in zip(x, y, strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], rel=1e-9, abs=1e-9, nan_ok=True)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(C, "PART", 30)
    monkeypatch.setattr(C, "BLOCK", 25)
    monkeypatch.setattr(V, "PART_RANKS", 40)


def estimates(spark, chunk):
    ticks, _ = random_ticks(spark, chunk=chunk)
    y = C.preaveraged_returns(ticks, 7)
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
    grid = sampling.refresh_times(ticks, NAMES)
    returns = sampling.returns(sampling.latest_value(ticks, grid, NAMES))
    return {
        "returns": frame(y.where("y is not null"), "asset", "i", "y"),
        "pairs": frame(C.overlap_sums(y, pairs, 7, 0.25, chunk), "a", "b", "cov"),
        "own": frame(C.own_overlap_sum(y, 7, 0.25), "a", "b", "cov"),
        "kernel": frame(C.realised_kernel(returns, PARZEN, 9.0, 60), "a", "b", "cov"),
        "two scales": frame(V.two_scales_volatility(ticks, NAMES, 6), "asset", "volatility"),
        "correlations": frame(C.two_scales_correlations(ticks, NAMES, num_grids=4), "a", "b", "cor"),
    }


def test_parts_and_chunks_do_not_matter(spark, small_parts):
    got = estimates(spark, 4.0)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "PART", 10_000)
        m.setattr(C, "BLOCK", 10_000)
        m.setattr(V, "PART_RANKS", 10_000)
        want = estimates(spark, None)
    for name, rows in want.items():
        assert_close(got[name], rows)


def test_realised_kernel_against_sums(spark, small_parts):
    rng = np.random.default_rng(3)
    r = rng.standard_normal((120, 3))
    rows = [(n, k + 1, float(r[k, i])) for i, n in enumerate("ABC") for k in range(120)]
    got = {(x.a, x.b): x["cov"] for x in C.realised_kernel(spark.createDataFrame(rows, "asset string, k long, r double"), PARZEN, 11.0, 120).collect()}
    weights = PARZEN.array(np.arange(12) / 11.0)
    for i, a in enumerate("ABC"):
        for j, b in enumerate("ABC"):
            if a <= b:
                want = r[:, i] @ r[:, j] + sum(weights[h] * (r[h:, i] @ r[:-h, j] + r[h:, j] @ r[:-h, i]) for h in range(1, 12))
                assert got[a, b] == pytest.approx(want)


def test_running_sums_and_halos(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("key"), F.floor(F.col("id") / 3).alias("i")).withColumn("x", F.col("i") + 0.5)
    parts = ordered.with_halo(df, F.col("i"), 7)
    got = ordered.running_sum(parts, ["key"], "i", {"s": F.col("x")}).collect()
    assert len(got) == 100 and all(r.s == pytest.approx(sum(k + 0.5 for k in range(r.i + 1))) for r in got)
    halo = ordered.with_halo(df, F.col("i"), 7, before=2, after=3).where("key = 0").collect()
    assert sum(r.own for r in halo) == 34 and {r.i for r in halo if r.part == 2} == set(range(12, 24))


# --- readers ---------------------------------------------------------------------


def test_ties_are_ordered_by_value(spark, tmp_path):
    rows = [("A", 1.0, 3.0), ("A", 1.0, 1.0), ("B", 1.0, 2.0), ("A", 1.0, 2.0), ("A", 2.0, 0.0)]
    spark.createDataFrame(rows, "name string, at double, price double").repartition(4).write.parquet(str(tmp_path / "ticks"))
    ticks = T.read_ticks(spark, str(tmp_path / "ticks"), "at", "name", "price")
    got = ordered.ranked(ticks).where("asset = 'A'").orderBy("rn").collect()
    assert [r.value for r in got] == [1.0, 2.0, 3.0, 0.0] and ticks.chunk is None
    assert sampling.refresh_times(ticks, ["A", "B"]).collect()[0].t == 1.0
    grid = spark.createDataFrame([("A", 0, 1.0)], "asset string, k long, t double")
    assert ordered.as_of(ticks, grid).first()["value"] == 3.0


def test_reader_sizes_chunks_and_takes_a_tie_breaker(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_ROWS", 50)
    ticks, rows = random_ticks(spark)
    ticks.df.write.json(str(tmp_path / "ticks"))
    read = T.read_ticks(spark, str(tmp_path / "ticks"), "t", "asset", "value", seq="seq", fmt="json", schema="asset string, t double, value double, seq long", chunk=T.chunk_for(ticks.df, 50))
    assert 6 <= (rows[-1][1] - rows[0][1]) / read.chunk <= 13
    assert frame(ordered.ranked(read), "asset", "seq", "rn") == frame(ordered.ranked(ticks), "asset", "seq", "rn")
    assert T.read_ticks(spark, str(tmp_path / "ticks"), "t", "asset", "value", fmt="json", chunk=2.0).chunk == 2.0


def test_stretches_of_events_hold_a_count(spark, monkeypatch):
    """However dense events are, a stretch holds about a count of them, and results are the same."""
    whole = T.event_ticks(spark, SF)
    n, lo, hi = whole.df.agg(F.count("*"), F.min("t"), F.max("t")).first()
    assert whole.chunk == 5 * 86_400.0 and T.event_ticks(spark, SF, chunk=None).chunk is None
    monkeypatch.setattr(T, "CHUNK_ROWS", 50)
    cut = T.event_ticks(spark, SF)
    assert cut.chunk == pytest.approx((hi - lo) * 50 / n)
    assets = sampling.asset_names(whole)
    grids = [sampling.refresh_times(x, assets) for x in (cut, whole)]
    got, want = (frame(C.covariance_of_returns(sampling.returns(sampling.latest_value(x, g, assets))), "a", "b", "cov") for x, g in zip((cut, whole), grids))
    assert_close(got, want)


def test_sorted_table_with_an_index(spark):
    df = spark.createDataFrame([(0, 5.0, 1.0), (1, 5.0, 2.0), (2, 6.0, 3.0), (3, 7.0, 4.0)], "row long, at double, asset double")
    ticks = T.from_sorted(df, "at", "asset", {"X": [0, 2], "Y": [1]})
    assert sorted(map(tuple, ticks.df.select("asset", "t", "value", "seq").collect())) == [("X", 5.0, 1.0, 0), ("X", 6.0, 3.0, 2), ("Y", 5.0, 2.0, 1)]
    text = T.show(ticks, rows=2)
    assert text.splitlines()[0].startswith("Ticks with 3 rows") and len(text.splitlines()) == 4 and "X  5  1" in text


# --- which assets count ------------------------------------------------------------


def test_assets_need_ticks_and_values_that_differ(spark):
    rows = [("few", float(i), float(i), i) for i in range(9)] + [("flat", float(i), 5.0, i) for i in range(30)]
    rows += [("moving", float(i), float(i % 3), i) for i in range(30)] + [("still", 1.0, float(i), i) for i in range(30)]
    rows += [("broken", float(i), float("nan") if i == 4 else float(i), i) for i in range(30)]
    ticks = Ticks(spark.createDataFrame(rows, "asset string, t double, value double, seq long"))
    assert [r.asset for r in sampling.get_assets(ticks).collect()] == ["moving", "still"]
    with pytest.warns(UserWarning, match="NaN values for broken"):
        assert sampling.asset_names(ticks) == ["moving", "still"]
    assert {r.asset for r in sampling.time_between_refreshes(ticks).collect()} == {"few", "flat", "moving", "still", "broken"}
    given = {r.asset: r.time_between_ticks for r in sampling.time_between_refreshes(ticks, ["few", "flat"]).collect()}
    assert given == {"few": pytest.approx(9 / 29), "flat": pytest.approx(30 / 29)}


def test_assets_may_be_a_table(spark):
    rows = [("flat", float(i), 5.0, i) for i in range(30)] + [("moving", float(i), float(i % 3), i) for i in range(15)]
    ticks = Ticks(spark.createDataFrame(rows, "asset string, t double, value double, seq long"))
    assert [tuple(r) for r in sampling.ticks_per_asset(ticks, sampling.get_assets(ticks)).collect()] == [("moving", 15)]
    assert [tuple(r) for r in sampling.time_between_refreshes(ticks, sampling.get_assets(ticks)).collect()] == [("moving", pytest.approx(15 / 29), 15)]


@pytest.mark.parametrize("name", ["time_between_refreshes", "ticks_per_asset"])
def test_plans_do_not_list_the_users(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.count() > 0 and " IN " not in str(df._jdf.queryExecution().analyzed())
