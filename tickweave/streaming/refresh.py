"""Refresh times and last values of a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_refresh_times(ticks: DataFrame, assets: list[str], universe: str = "universe") -> DataFrame:
    """(universe, t) whenever all assets of a universe have ticked again.

    ``ticks`` is a stream with columns universe, asset, t and seq; the state of
    a universe is which assets are still missing.  Rows of a micro-batch are
    taken in time order; rows that arrive in a later batch are taken then.
    """
    whole = sorted(assets)

    def work(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        missing = set(state.get[0].split("\u0001")) if state.exists else set(whole)
        rows = pd.concat(list(parts)).sort_values(["t", "seq"])
        out = []
        for asset, t in zip(rows["asset"], rows["t"], strict=True):
            missing.discard(asset)
            if not missing:
                out.append(t)
                missing = set(whole)
        state.update(("\u0001".join(sorted(missing)),))
        yield pd.DataFrame({"universe": [key[0]] * len(out), "t": out})

    wanted = ticks.where(F.col("asset").isin(whole))
    return wanted.groupBy(universe).applyInPandasWithState(work, "universe string, t double", "missing string", "append", "NoTimeout")


def streaming_last_values(ticks: DataFrame) -> DataFrame:
    """(asset, t, value): the latest tick of each asset so far (complete or update mode)."""
    return ticks.groupBy("asset").agg(F.max("t").alias("t"), F.max_by("value", F.struct("t", "seq")).alias("value"))


def streaming_bars(ticks: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Open, close, count and summed squares per asset and stretch of event time, with a watermark for late ticks."""
    bars = ticks.withWatermark(time, late).groupBy(F.window(time, width), "asset")
    return bars.agg(F.min_by("value", F.struct(time, "seq")).alias("open"), F.max_by("value", F.struct(time, "seq")).alias("close"), F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("squares"))
