"""Operators as SQL table functions.

``register(spark)`` makes refresh_times callable from SQL:

    SELECT * FROM refresh_times(TABLE(ticks) PARTITION BY universe ORDER BY (t, seq), 'A,B,C')

Every partition of the table is one universe of assets, read in its order with a
state of one set.  A single universe that is too long for one task is cut into
chunks of time, as ``refresh_times_sql`` writes it: refresh_ways says where each
chunk leads to, refresh_entries follows these few rows, and refresh_times then
reads all chunks in parallel, each from the state that a first row gives.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


def _names(assets: str) -> set[str]:
    return {a.strip() for a in assets.split(",") if a.strip()}


class RefreshTimes:
    """(k, t): times by which every asset of the list has ticked since the refresh before, in the order of the rows.

    A row with a ``missing`` that is not null is no tick: it says which assets
    are missing and how many refreshes there were before.
    """

    def __init__(self) -> None:
        self.whole: set[str] | None = None
        self.missing: set[str] = set()
        self.k = 0
        self.entered = False

    def eval(self, row: Row, assets: str) -> Iterator[tuple[int, float]]:
        if self.whole is None:
            self.whole = _names(assets)
            self.missing = set(self.whole)
            self.entered = "missing" in row
        if self.entered and row["missing"] is not None:
            self.missing, self.k = set(row["missing"]), row["k"]
            return
        self.missing.discard(row["asset"])
        if self.whole and not self.missing:
            self.missing = set(self.whole)
            self.k += 1
            yield self.k - 1, None if row["t"] is None else float(row["t"])


class RefreshWays:
    """(chunk, asset, first, refreshes, missing) of a chunk: what follows if an asset's first tick, in row ``first``, completes a refresh.

    Ways that have met share one state, so most ticks change one set.
    """

    def __init__(self) -> None:
        self.whole: set[str] | None = None
        self.chunk: int | None = None
        self.row = 0
        self.first: dict[str, int] = {}
        self.met: list[dict] = []

    def eval(self, row: Row, assets: str) -> None:
        if self.whole is None:
            self.whole, self.chunk = _names(assets), row["chunk"]
        asset = row["asset"]
        if asset in self.whole:
            done = []
            for one in self.met:
                one["missing"].discard(asset)
                if not one["missing"]:
                    one["count"] += 1
                    done.append(one)
            if asset not in self.first:
                self.first[asset] = self.row
                one = {"missing": set(), "count": 0, "before": {asset: 0}}
                self.met.append(one)
                done.append(one)
            if done:
                kept = done[0]
                kept["missing"] = set(self.whole)
                for one in done[1:]:
                    kept["before"] |= {a: n + one["count"] - kept["count"] for a, n in one["before"].items()}
                if len(done) > 1:
                    self.met = [one for one in self.met if one is kept or one["missing"]]
        self.row += 1

    def terminate(self) -> Iterator[tuple[int | None, str, int, int, list[str]]]:
        for one in self.met:
            for asset, before in one["before"].items():
                yield self.chunk, asset, self.first[asset], before + one["count"], sorted(one["missing"])


class RefreshEntries:
    """(chunk, missing, k): the state in which each chunk is entered; reads the ways of all chunks in order of chunk."""

    def __init__(self) -> None:
        self.missing: set[str] | None = None
        self.k = 0
        self.chunk: int | None = None
        self.ways: dict[str, tuple[int, int, list[str]]] = {}

    def _pass(self) -> tuple[int | None, list[str], int]:
        entry = self.chunk, sorted(self.missing), self.k
        if self.missing <= self.ways.keys():
            _, count, missing = max((self.ways[a] for a in self.missing), key=lambda w: w[0])
            self.missing, self.k = set(missing), self.k + 1 + count
        else:
            self.missing = self.missing - self.ways.keys()
        self.ways = {}
        return entry

    def eval(self, row: Row, assets: str) -> Iterator[tuple[int | None, list[str], int]]:
        if self.missing is None:
            self.missing = _names(assets)
        if self.ways and row["chunk"] != self.chunk:
            yield self._pass()
        self.chunk = row["chunk"]
        self.ways[row["asset"]] = (row["first"], row["refreshes"], row["missing"])

    def terminate(self) -> Iterator[tuple[int | None, list[str], int]]:
        if self.ways:
            yield self._pass()


def refresh_times_sql(view: str, assets: str, chunk: float | None) -> str:
    """SQL of (k, t) over a view (asset, t, seq) that is one universe, in chunks of a stretch of time."""
    listed = assets.replace("'", "''")
    place = "0L" if chunk is None else f"floor(t / {chunk!r}D)"
    place = f"case when t is null then {2**63 - 1}L when isnan(t) then {2**63 - 2}L else {place} end"
    return f"""
        with chunked as (select {place} as chunk, asset, t, seq from {view}),
        ways as (select * from refresh_ways(table(chunked) partition by chunk order by (t nulls last, seq), '{listed}')),
        entries as (select * from refresh_entries(table(ways) with single partition order by (chunk), '{listed}')),
        steps as (
            select chunk, asset, t, seq, cast(null as array<string>) as missing, cast(null as bigint) as k, 1 as place from chunked
            union all select chunk, null, null, null, missing, k, 0 from entries
        )
        select k, t from refresh_times(table(steps) partition by chunk order by (place, t nulls last, seq), '{listed}')
    """


def register(spark: SparkSession) -> None:
    """Registers the table functions with a session, for its SQL."""
    spark.udtf.register("refresh_times", udtf(RefreshTimes, returnType="k bigint, t double"))
    spark.udtf.register("refresh_ways", udtf(RefreshWays, returnType="chunk bigint, asset string, first bigint, refreshes bigint, missing array<string>"))
    spark.udtf.register("refresh_entries", udtf(RefreshEntries, returnType="chunk bigint, missing array<string>, k bigint"))
