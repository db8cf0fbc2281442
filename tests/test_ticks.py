"""Sampling and estimators on small literal tick tables, against plain Python."""

import math
import random

import numpy as np
import pytest

from tickweave.functions.periods import Period, scale_drift, scale_volatility
from tickweave.operators import covariance as C
from tickweave.operators import ordered, sampling, volatility
from tickweave.sources import ticks as T

LITERAL = list(zip("ABAAABABB", [1, 2, 3, 4, 5, 5, 6, 7, 8], [1.01, 2.0, 1.011, 1.02, 1.011, 2.2, 1.0001, 2.2, 2.3]))


def table(spark, rows, chunk=None):
    df = spark.createDataFrame([(a, float(t), float(v), i) for i, (a, t, v) in enumerate(rows)], "who string, at double, price double, n long")
    return T.from_columns(df, "at", "who", "price", seq="n", chunk=chunk)


def noise(n, seed=4, assets="ABC"):
    rng = random.Random(seed)
    t, rows, level = 0.0, [], dict.fromkeys(assets, 0.0)
    for _ in range(n):
        t += rng.choice([0.0, 0.3, 1.1, 2.5])
        a = rng.choice(assets)
        level[a] += rng.gauss(0, 1)
        rows.append((a, t, round(level[a], 6)))
    return rows


@pytest.mark.parametrize("chunk", [None, 2.0])
def test_refresh_and_latest(spark, chunk):
    ticks = table(spark, LITERAL, chunk)
    grid = sampling.refresh_times(ticks, ["A", "B"])
    assert [r.t for r in grid.orderBy("k").collect()] == [2, 5, 7]
    got = {(r.asset, r.t): r.value for r in sampling.latest_value(ticks, grid, ["A", "B"]).collect()}
    assert [got["A", t] for t in (2, 5, 7)] == [1.01, 1.011, 1.0001]
    assert [got["B", t] for t in (2, 5, 7)] == [2.0, 2.2, 2.2]


def test_documented_refresh_times(spark):
    rows = [("A", t, 0) for t in (1, 5, 6, 7, 10)] + [("B", t, 0) for t in (2, 5, 7, 9)]
    ticks = table(spark, sorted(rows, key=lambda r: r[1]))
    assert [r.t for r in sampling.refresh_times(ticks, ["A", "B"]).orderBy("k").collect()] == [2, 5, 7, 10]
    assert [r.t for r in sampling.refresh_times_of_pairs(ticks, [("A", "B")]).orderBy("k").collect()] == [2, 5, 7, 10]
    assert tuple(sampling.next_tick(ticks, 3, ["A", "B"]).first()) == (5.0, 4)
    assert tuple(sampling.next_tick(ticks, 9, ["A", "B"]).first()) == (None, None)


@pytest.mark.parametrize("chunk", [None, 3.0, 50.0])
def test_chunks_change_nothing(spark, chunk):
    rows = noise(400)
    ticks = table(spark, rows, chunk)
    rank, last = {}, {}
    want_rank, want_prev = {}, {}
    for i, (a, t, v) in enumerate(rows):
        rank[a] = rank.get(a, 0) + 1
        want_rank[i], want_prev[i] = rank[a], last.get(a, (None, None))
        last[a] = (t, v)
    assert {r.seq: r.rn for r in ordered.ranked(ticks).collect()} == want_rank
    assert {r.seq: (r.p_t, r.p_value) for r in ordered.previous(ticks).collect()} == want_prev
    grid = [(k, -1.0 + k * 7.3) for k in range(60)]
    asked = sampling.for_assets(ticks, spark.createDataFrame(grid, "k long, t double"), ["A", "B", "C"])
    got = {(r.asset, r.k): r.value for r in ordered.as_of(ticks, asked).collect()}
    for a in "ABC":
        own = [(t, v) for x, t, v in rows if x == a]
        for k, t in grid:
            before = [v for s, v in own if s <= t]
            assert got[a, k] == (before[-1] if before else own[0][1])


def test_accessors(spark):
    ticks = table(spark, LITERAL)
    assert sampling.asset_names(ticks, 4) == ["A", "B"]
    assert sampling.asset_names(ticks, 5) == ["A"]
    assert sampling.asset_names(table(spark, [("Z", 1, 1)] * 12)) == []
    assert sampling.subset_to_tick(ticks, 3).df.count() == 3
    assert sampling.subset_to_time(ticks, 5.0).df.count() == 4
    assert sampling.duration(ticks) == 7
    assert sampling.duration_period(ticks).ns == 7_000_000_000
    rates = {r.asset: r.time_between_ticks for r in sampling.time_between_refreshes(ticks).collect()}
    assert rates == {"A": 5 / 7, "B": 4 / 7}
    assert {r.asset: r.time_between_ticks for r in sampling.time_between_refreshes(ticks, strict=True).collect()}["A"] == 7 / 5


def test_combine_and_rescale(spark):
    ticks = table(spark, LITERAL)
    both = T.combine([ticks, ticks])
    assert both.df.count() == 18
    assert T.rescaled(ticks, Period("Minute")).df.agg({"t": "max"}).first()[0] == 480
    assert T.rescaled(ticks, Period("Minute"), strict=True).df.agg({"t": "max"}).first()[0] == pytest.approx(8 / 60)
    with pytest.raises(ValueError):
        T.combine([])
    with pytest.raises(ValueError):
        Period("Month")
    assert scale_volatility(2.0, Period("Second"), Period("Minute")) == pytest.approx(2 * math.sqrt(60))
    assert scale_drift(None, Period(), Period()) is None


def brute_two_scales(values, times, grids):
    n, span = len(values), max(times) - min(times)
    k = min(n // 4, max(2, math.floor(grids)))

    def vol(v, t):
        return math.sqrt(sum((y - x) ** 2 for x, y in zip(v, v[1:])) / (max(t) - min(t)))

    full = vol(values, times)
    pure = (np.mean([vol(values[i::k], times[i::k]) for i in range(k)]) - full / k) / (1 - 1 / k)
    return pure, (full**2 - pure**2) * span / (2 * n)


@pytest.mark.parametrize("chunk", [None, 20.0])
def test_two_scales(spark, chunk):
    rows = noise(600, 9)
    got = {r.asset: r for r in volatility.two_scales_volatility(table(spark, rows, chunk), ["A", "B", "C"], 7).collect()}
    for a in "ABC":
        own = [(t, v) for x, t, v in rows if x == a]
        pure, noise_var = brute_two_scales([v for _, v in own], [t for t, _ in own], 7)
        assert got[a].volatility == pytest.approx(pure)
        assert got[a].noise == pytest.approx(max(0.0, noise_var))


def test_two_scales_short(spark):
    got = volatility.two_scales_volatility(table(spark, LITERAL), None, 3).collect()
    assert all(math.isnan(r.volatility) and math.isnan(r.noise) for r in got)


@pytest.mark.parametrize("chunk", [None, 15.0])
def test_preaveraged_overlap(spark, chunk):
    rows, k = noise(300, 6, "AB"), 5
    ticks = table(spark, rows, chunk)
    y = C.preaveraged_returns(ticks, k).cache()
    weights = [min(i / k, 1 - i / k) for i in range(1, k)]
    side = {}
    for a in "AB":
        own = [(t, v) for x, t, v in rows if x == a]
        d = [q[1] - p[1] for p, q in zip(own, own[1:])]
        side[a] = ([sum(w * x for w, x in zip(weights, d[i : i + k - 1])) for i in range(len(d) - k + 1)], [t for t, _ in own[1:]])
    (ya, ta), (yb, tb) = side["A"], side["B"]
    total = 0.0
    for i in range(len(ya) - k + 2):
        lo = max(1, sum(t < ta[i] for t in tb) + 1 - k)
        hi = min(len(yb), sum(t <= ta[i + k] for t in tb))
        total += ya[i] * sum(yb[lo - 1 : hi]) if hi >= lo else 0.0
    got = C.overlap_sums(y, [("A", "B")], k, 0.25).first()["cov"]
    assert got == pytest.approx(total / (0.25 * k) ** 2)
    own = {r.a: r["cov"] for r in C.own_overlap_sum(y, k, 0.25).collect()}
    n = len(ya)
    want = sum(ya[i - 1] * sum(ya[i - 1 - k + 1 : i + k - 1]) for i in range(k, n - 2 * k + 2)) / (0.25 * k) ** 2
    assert own["A"] == pytest.approx(want)


def test_end_averaging(spark):
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate([1, 2, 3, 4, 5, 6])], "asset string, k long, r double")
    got = [r.r for r in C.end_averaged_returns(df, 2).orderBy("k").collect()]
    assert got == [-1 / 2 - 2, 3, 4, 5 / 2 + 6]
    with pytest.raises(ValueError):
        C.end_averaged_returns(df, 3)


def test_end_averaging_makes_its_returns_once(spark):
    made = spark.sparkContext.accumulator(0)

    def work(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([("A", i, float(i)) for i in range(6)], "asset string, k long, r double").mapInArrow(work, "asset string, k long, r double")
    assert C.end_averaged_returns(df, 2).count() == 4 and made.value == 6


def test_empty_table(spark):
    ticks = table(spark, LITERAL).only([])
    assert sampling.asset_names(ticks) == []
    assert ordered.previous(ticks).count() == 0
    assert sampling.refresh_times(ticks, ["A", "B"]).count() == 0


def test_refresh_times_in_sql(spark):
    from tickweave.functions import table_functions

    table_functions.register(spark)
    rows = [("u", a, float(t), t) for t, a in enumerate("AABBA")] + [("v", a, float(t), t) for t, a in enumerate("BAB")]
    spark.createDataFrame(rows, "universe string, asset string, t double, seq long").createOrReplaceTempView("universes")
    got = spark.sql("select k, t from refresh_times(table(universes) partition by universe order by (t, seq), 'A, B')").collect()
    assert sorted(map(tuple, got)) == [(0, 1.0), (0, 2.0), (1, 4.0)]
