"""Selection, accessors, sampling grids and refresh times of tick tables."""

from __future__ import annotations

import math
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.periods import Period
from tickweave.operators.ordered import as_of, previous, ranked
from tickweave.sources.ticks import Ticks

#: Below this spread of values an asset does not count as moving, so nothing can be estimated for it.
MIN_SPREAD = 1000 * np.finfo(float).eps
#: Rows of a chunk that refresh times hold at once, however many it has.
PIECE_ROWS = 200_000
#: Chunks of times that are NaN or null; they come last.
_NAN_CHUNK, _NULL_CHUNK = 2**63 - 2, 2**63 - 1


def _observed(ticks: Ticks, min_obs: int) -> DataFrame:
    """asset, n_nan, and whether it has ``min_obs`` ticks and values that differ."""
    spread = F.max("value") - F.min("value")
    stats = ticks.df.groupBy("asset").agg(F.count("*").alias("n"), spread.alias("spread"), F.count(F.when(F.isnan("value"), 1)).alias("n_nan"))
    return stats.select("asset", "n_nan", ((F.col("n") >= min_obs) & (F.col("n_nan") == 0) & (F.col("spread") > MIN_SPREAD)).alias("counts"))


def get_assets(ticks: Ticks, min_obs: int = 10) -> DataFrame:
    """Assets with at least ``min_obs`` ticks and values that differ, none of them NaN; sorted."""
    return _observed(ticks, min_obs).where("counts").select("asset").orderBy("asset")


def asset_names(ticks: Ticks, min_obs: int = 10) -> list[str]:
    """The same as a list; warns of assets with NaN values."""
    rows = _observed(ticks, min_obs).collect()  # a row per asset
    for r in rows:
        if r.n_nan:
            warnings.warn(f"There are NaN values for {r.asset}.", stacklevel=2)
    return sorted(r.asset for r in rows if r.counts)


def subset_to_tick(ticks: Ticks, n: int) -> Ticks:
    """The first n ticks in time order."""
    return Ticks(ticks.df.orderBy("t", "seq").limit(n), ticks.period, ticks.chunk)


def subset_to_time(ticks: Ticks, before: float) -> Ticks:
    """Ticks strictly before a time."""
    return Ticks(ticks.df.where(F.col("t") < before), ticks.period, ticks.chunk)


def duration(ticks: Ticks) -> float:
    """Last minus first time, in units of the table's period."""
    lo, hi = ticks.extent()
    return hi - lo


def duration_period(ticks: Ticks) -> Period:
    return Period("Nanosecond", round(duration(ticks) * ticks.period.ns))


def tick_counts(ticks: Ticks) -> DataFrame:
    """(asset, number_of_ticks) of every asset in the table."""
    return ticks.df.groupBy("asset").agg(F.count("*").alias("number_of_ticks"))


def ticks_per_asset(ticks: Ticks, assets: list[str] | DataFrame | None = None) -> DataFrame:
    """(asset, number_of_ticks) of the given assets, or of all; ``get_assets`` and ``asset_names`` give those that count as observed.

    Many assets are better given as a table: their names go neither through the driver nor into the plan.
    """
    if isinstance(assets, DataFrame):
        return tick_counts(ticks).join(assets.select("asset"), "asset", "left_semi")
    return tick_counts(ticks.only(assets))


def time_between_refreshes(ticks: Ticks, assets: list[str] | DataFrame | None = None, *, strict: bool = False) -> DataFrame:
    """Ticks per unit of time over the whole table's extent (``strict``: time per tick), slowest first; of all assets or the given ones."""
    extent = ticks.df.agg((F.max("t") - F.min("t")).alias("span"))
    per = ticks_per_asset(ticks, assets).join(F.broadcast(extent))  # one row
    rate = F.col("span") / F.col("number_of_ticks") if strict else F.col("number_of_ticks") / F.col("span")
    return per.select("asset", rate.alias("time_between_ticks"), "number_of_ticks").orderBy("time_between_ticks", "asset")


def even_grid(ticks: Ticks, spacing: float, start: float | None = None, end: float | None = None) -> DataFrame:
    """(k, t): start, start + spacing, ... up to the last time."""
    lo, hi = ticks.extent()
    lo, hi = (lo if start is None else start), (hi if end is None else end)
    n = int(np.floor((hi - lo) / spacing + 1e-12)) + 1
    return ticks.spark.range(n).select(F.col("id").alias("k"), (F.lit(lo) + F.col("id") * F.lit(float(spacing))).alias("t"))


def for_assets(ticks: Ticks, grid: DataFrame, assets: list[str] | None = None) -> DataFrame:
    """(asset, k, t): the grid for every asset."""
    names = F.array(*[F.lit(a) for a in (assets or asset_names(ticks))])
    return grid.select(F.explode(names).alias("asset"), "k", "t")


def latest_value(ticks: Ticks, grid: DataFrame, assets: list[str] | None = None) -> DataFrame:
    """Long form (asset, k, t, value) of the latest values at the grid's times."""
    assets = assets or asset_names(ticks)
    return as_of(ticks.only(assets), for_assets(ticks, grid, assets))


def wide(sampled: DataFrame, assets: list[str]) -> DataFrame:
    """Time and one column per asset."""
    return sampled.groupBy("k", F.col("t").alias("Time")).pivot("asset", assets).agg(F.first("value")).drop("k")


def pick_number(k: Column, asset: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) for an interval and an asset, by integer arithmetic only."""
    mixed = (k + 1) * 7919 + F.ascii(asset) * 104_729 + F.length(asset) * 1_299_709 + seed * 15_485_863
    return F.pmod(mixed * 48_271, F.lit(2_147_483_647)) / 2_147_483_647.0


def random_value_in_interval(ticks: Ticks, grid: DataFrame, assets: list[str] | None = None, *, seed: int = 2604) -> DataFrame:
    """(asset, k, t, value): a random tick after the previous grid time and up to this one.

    Without such a tick it is the latest one.  The first interval starts after
    the asset's first tick.
    """
    assets = assets or asset_names(ticks)
    mine = ticks.only(assets)
    numbered = ranked(mine)
    places = as_of(Ticks(numbered, ticks.period, ticks.chunk), for_assets(ticks, grid, assets), F.col("rn").cast("double")).withColumn("hi", F.col("value").cast("int"))
    before = F.coalesce(F.lag("hi").over(Window.partitionBy("asset").orderBy("k")), F.lit(1))
    places = places.withColumn("lo", F.least(F.col("hi"), before + 1))
    rn = (F.col("lo") + F.floor(pick_number(F.col("k"), F.col("asset"), seed) * (F.col("hi") - F.col("lo") + 1))).cast("int")
    picked = places.select("asset", "k", "t", rn.alias("rn"))
    return picked.join(numbered.select("asset", "rn", "value"), ["asset", "rn"]).select("asset", "k", "t", "value")


def next_tick(ticks: Ticks, from_index: int, assets: list[str] | None = None) -> DataFrame:
    """One row (refresh_time, refresh_index): the row by which all assets have ticked again; nulls if one never does."""
    assets = assets or asset_names(ticks)
    rows = ticks.df.withColumn("rn", F.row_number().over(Window.partitionBy().orderBy("t", "seq"))) if ticks.chunk is None else global_rank(ticks)
    first = rows.where((F.col("rn") >= from_index) & F.col("asset").isin(assets)).groupBy("asset").agg(F.min("rn").alias("rn"), F.min_by("t", "rn").alias("t"))
    out = first.agg(F.count("*").alias("n"), F.max("rn").alias("refresh_index"), F.max_by("t", "rn").alias("refresh_time"))
    full = F.col("n") == len(assets)
    return out.select(F.when(full, F.col("refresh_time")).alias("refresh_time"), F.when(full, F.col("refresh_index")).cast("long").alias("refresh_index"))


def global_rank(ticks: Ticks) -> DataFrame:
    """rn over all assets: counts per chunk, then ranks within chunks."""
    df = ticks.df.withColumn("chunk", ticks.chunk_of(F.col("t")))
    counts = df.groupBy("chunk").agg(F.count("*").alias("n"))
    before = counts.select("chunk", (F.sum("n").over(Window.orderBy("chunk")) - F.col("n")).alias("before"))
    inside = df.withColumn("rn", F.row_number().over(Window.partitionBy("chunk").orderBy("t", "seq")))
    return inside.join(before, "chunk").withColumn("rn", F.col("rn") + F.col("before")).drop("chunk", "before")


class _Piece:
    """A piece of a chunk, its ticks in time order: where each asset ticks, and the ways through it.

    A state is the set of assets that are still missing.  A piece with some
    assets missing has its next refresh at the latest of their first ticks
    here; from there on the way through the piece depends on nothing before.
    """

    def __init__(self, table: pa.Table, place: dict[str, int]) -> None:
        self.t = table.column("t").to_numpy()
        self.at: list[list[int]] = [[] for _ in place]
        if table.num_rows:
            names = table.column("asset").combine_chunks().dictionary_encode()
            names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
            code = np.array([place[x] for x in names.dictionary.to_pylist()])[np.asarray(names.indices)]
            order = np.argsort(code, kind="stable")
            bounds = np.searchsorted(code[order], np.arange(len(place) + 1))
            self.at = [order[bounds[i] : bounds[i + 1]].tolist() for i in range(len(place))]

    def next_refresh(self, group: tuple[int, ...], row: int, seen: list[int]) -> int:
        """The row by which all of the group have ticked from ``row`` on, or -1; ``seen`` holds how far each was read."""
        latest = -1
        for k, asset in enumerate(group):
            ticks = self.at[asset]
            seen[k] = bisect_left(ticks, row, seen[k])
            if seen[k] == len(ticks):
                return -1
            latest = max(latest, ticks[seen[k]])
        return latest

    def walk(self, group: tuple[int, ...], row: int, known: dict) -> tuple[list[int], int]:
        """Refreshes from ``row`` on until one is in ``known`` or the piece ends, and where the last stretch began."""
        found, seen = [], [0] * len(group)
        while row not in known:
            latest = self.next_refresh(group, row, seen)
            if latest < 0:
                break
            found.append(latest)
            row = latest + 1
        return found, row

    def missing_from(self, group: tuple[int, ...], row: int) -> list[int]:
        return [a for a in group if not self.at[a] or self.at[a][-1] < row]

    def ways(self, group: tuple[int, ...]) -> list[tuple[int, int, int, list[int]]]:
        """(asset, first row, refreshes after it, assets missing at the end) if that asset's first tick completes a refresh."""
        known: dict[int, tuple[int, list[int]]] = {}
        out = []
        for first, asset in sorted(((self.at[a][0], a) for a in group if self.at[a]), reverse=True):
            found, row = self.walk(group, first + 1, known)
            if row not in known:
                known[row] = (0, self.missing_from(group, row))
            count, missing = known[row]
            for k, refresh in enumerate(reversed(found), 1):
                start = found[-k - 1] + 1 if k < len(found) else first + 1
                known[start] = (count + k, missing)
            out.append((asset, first, *known[first + 1]))
        return out

    def refreshes(self, group: tuple[int, ...], missing: list[int]) -> list[int]:
        """Rows of the refreshes if ``missing`` is the state at the start."""
        if not all(self.at[a] for a in missing):
            return []
        first = max(self.at[a][0] for a in missing)
        return [first, *self.walk(group, first + 1, {})[0]]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.Table]]:
    """(chunk, rows) from batches sorted by chunk: each chunk in pieces of at most ``rows`` rows."""
    held: list[pa.Table] = []
    n = chunk = 0
    for batch in batches:
        table, keys = pa.Table.from_batches([batch]), batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for lo, hi in zip(cuts, cuts[1:]):
            while lo < hi:
                if n and (keys[lo] != chunk or n == rows):
                    yield chunk, pa.concat_tables(held)
                    held, n = [], 0
                take = min(hi - lo, rows - n)
                held.append(table.slice(lo, take))
                n, chunk, lo = n + take, int(keys[lo]), lo + take
    if n:
        yield chunk, pa.concat_tables(held)


#: asset -> (first row, refreshes after it, assets missing at the end)
_Ways = dict[int, tuple[int, int, list[int]]]


def _through(missing: list[int], ways: _Ways) -> tuple[int, list[int]]:
    """Refreshes in a stretch that is entered with some assets missing, and which are missing at its end."""
    if any(a not in ways for a in missing):
        return 0, [a for a in missing if a not in ways]
    last = max((ways[a] for a in missing), key=lambda w: w[0])
    return 1 + last[1], last[2]


def _joined(ways: _Ways, later: _Ways) -> _Ways:
    """Ways through two stretches, one after the other."""
    out = {}
    for asset, (first, count, missing) in ways.items():
        more, left = _through(missing, later)
        out[asset] = (first, count + more, left)
    return out | {a: w for a, w in later.items() if a not in ways}


_WAYS = "g int, chunk long, ways array<struct<asset:int,first:long,count:long,missing:array<int>>>"
#: What is missing is text: a list that is null for all ticks makes Spark's writing of Arrow batches quadratic.
_ENTRY = "g int, chunk long, missing string, k long"


def group_refresh_times(ticks: Ticks, groups: list[tuple[str, ...]]) -> DataFrame:
    """(g, k, t): for each group of assets, the times by which all of it have ticked since the refresh before.

    Chunks are read in parallel twice: first each says where it leads to from
    every state it may be entered in (a row per group and chunk), these are
    chained, and then each gives its refreshes.  A task reads its chunks in
    time order, a piece at a time, so a chunk may have any number of ticks.
    """
    names = sorted({a for g in groups for a in g})
    place = {a: i for i, a in enumerate(names)}
    coded = [tuple(place[a] for a in g) for g in groups]
    t = F.col("t")
    chunk_of = F.when(t.isNull(), F.lit(_NULL_CHUNK)).when(F.isnan(t), F.lit(_NAN_CHUNK)).otherwise(ticks.chunk_of(t))
    base = ticks.only(names).df.select(chunk_of.alias("chunk"), "asset", "t", "seq")
    size = PIECE_ROWS
    way = pa.list_(pa.struct([("asset", pa.int32()), ("first", pa.int64()), ("count", pa.int64()), ("missing", pa.list_(pa.int32()))]))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(g: int, chunk: int, ways: _Ways) -> dict:
            return {"g": g, "chunk": chunk, "ways": [{"asset": a, "first": f, "count": n, "missing": m} for a, (f, n, m) in ways.items()]}

        def rows() -> pa.RecordBatch:
            made = [row(g, chunk, ways) for g, ways in enumerate(found)]
            return pa.RecordBatch.from_pylist(made, pa.schema([("g", pa.int32()), ("chunk", pa.int64()), ("ways", way)]))

        found: list[_Ways] = []
        chunk = at = 0
        for key, table in _pieces(batches, size):
            if found and key != chunk:
                yield rows()
                found = []
            if not found:
                chunk, at, found = key, 0, [{} for _ in coded]
            piece = _Piece(table, place)
            found = [_joined(ways, {a: (at + f, n, m) for a, f, n, m in piece.ways(group)}) for ways, group in zip(found, coded, strict=True)]
            at += table.num_rows
        if found:
            yield rows()

    def follow(key: tuple, table: pa.Table) -> pa.Table:
        missing, k, out = sorted(coded[key[0].as_py()]), 0, []
        for row in table.sort_by("chunk").to_pylist():
            out.append({"g": row["g"], "chunk": row["chunk"], "missing": " ".join(map(str, missing)), "k": k})
            more, missing = _through(missing, {w["asset"]: (w["first"], w["count"], w["missing"]) for w in row["ways"]})
            k += more
        return pa.Table.from_pylist(out, pa.schema([("g", pa.int32()), ("chunk", pa.int64()), ("missing", pa.string()), ("k", pa.int64())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, dict[int, tuple[list[int], int]]] = {}

        def ticks_of() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                is_tick = batch.column("g").is_null()
                for row in batch.filter(pc.invert(is_tick)).to_pylist():
                    state.setdefault(row["chunk"], {})[row["g"]] = ([int(a) for a in row["missing"].split()], row["k"])
                yield batch.select(["chunk", "asset", "t"]).filter(is_tick)

        for chunk, table in _pieces(ticks_of(), size):
            piece = _Piece(table, place)
            for g, (missing, k) in state[chunk].items():
                found = piece.refreshes(coded[g], missing)
                left = piece.missing_from(coded[g], found[-1] + 1) if found else [a for a in missing if not piece.at[a]]
                state[chunk][g] = (left, k + len(found))
                columns = (np.full(len(found), g, np.int32), k + np.arange(len(found)), piece.t[np.array(found, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.float64()), strict=True)], ["g", "k", "t"])

    # Chunks follow each other in order of time, so a sort by time keeps each together.
    order = [t.asc_nulls_last(), F.col("seq")]
    entry = base.repartition("chunk").sortWithinPartitions(*order).select("chunk", "asset", "t").mapInArrow(summarise, _WAYS).groupBy("g").applyInArrow(follow, _ENTRY)
    both = base.unionByName(entry.withColumn("t", F.lit(-math.inf)), allowMissingColumns=True)  # entries come before all ticks of a task
    both = both.repartition("chunk").sortWithinPartitions(*order, F.col("g").isNull()).select("chunk", "asset", "t", "g", "missing", "k")
    return both.mapInArrow(emit, "g int, k long, t double")


def refresh_times(ticks: Ticks, assets: list[str] | None = None, start_time: float | None = None) -> DataFrame:
    """(k, t): times by which every asset has ticked since the refresh before."""
    assets = assets or asset_names(ticks)
    if start_time is not None:
        ticks = Ticks(ticks.df.where(F.col("t") >= start_time), ticks.period, ticks.chunk)
    return group_refresh_times(ticks, [tuple(assets)]).select("k", "t")


def refresh_times_of_pairs(ticks: Ticks, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, k, t) for many pairs at once; ticks are not copied for their pairs."""
    names = ticks.spark.createDataFrame([(g, a, b) for g, (a, b) in enumerate(pairs)], "g int, a string, b string")
    return group_refresh_times(ticks, list(pairs)).join(F.broadcast(names), "g").select("a", "b", "k", "t")  # a row per pair


def returns(sampled: DataFrame, *, rescale: bool = False) -> DataFrame:
    """Level differences (asset, k, t, r) of sampled values, optionally per square root of the time between."""
    w = Window.partitionBy("asset").orderBy("k")
    r = F.col("value") - F.lag("value").over(w)
    if rescale:
        r = r / F.sqrt(F.col("t") - F.lag("t").over(w))
    return sampled.withColumn("r", r).where(F.col("r").isNotNull()).select("asset", "k", "t", "r")


def tick_returns(ticks: Ticks) -> DataFrame:
    """(asset, t, p_t, r) of neighbouring ticks."""
    return previous(ticks).where(F.col("p_t").isNotNull()).select("asset", "t", "p_t", "seq", (F.col("value") - F.col("p_value")).alias("r"))
