"""Tick tables: irregular observations (asset, t, value) with a tie-breaker."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.functions.periods import Period

COLUMNS = ["asset", "t", "value", "seq"]
#: Ticks of a chunk that is sized by a count.
CHUNK_ROWS = 200_000


@dataclass(frozen=True)
class Ticks:
    """``df`` has asset string, t double (in units of ``period``), value double and seq long.

    ``chunk`` is a stretch of time.  Ordered operators work on (asset, stretch)
    and pass the state at each border on, so that an asset with a third of all
    ticks is spread over as many tasks as it has stretches.  Without it an asset
    is one group.
    """

    df: DataFrame
    period: Period = Period()
    chunk: float | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def only(self, assets: list[str] | None) -> Ticks:
        return self if assets is None else replace(self, df=self.df.where(F.col("asset").isin(list(assets))))

    def chunk_of(self, t: Column) -> Column:
        return F.lit(0).cast("long") if self.chunk is None else F.floor(t / F.lit(float(self.chunk))).cast("long")

    def extent(self) -> tuple[float, float]:
        """First and last time of the whole table."""
        r = self.df.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
        return r["lo"], r["hi"]


def from_columns(df: DataFrame, time: str, grouping: str, value: str, period: Period = Period(), *, seq: str | None = None, chunk: float | None = None) -> Ticks:  # noqa: B008
    """Names three columns of any table; ``seq`` orders ties.

    Without it ties in time are ordered by value and then by name, which costs
    a shuffle by time.
    """
    columns = [F.col(grouping).cast("string").alias("asset"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("value")]
    if seq:
        return Ticks(df.select(*columns, F.col(seq).cast("long").alias("seq")), period, chunk)
    place = F.row_number().over(Window.partitionBy("t").orderBy("value", "asset"))
    return Ticks(df.select(*columns).withColumn("seq", place.cast("long")), period, chunk)


def from_sorted(df: DataFrame, time: str, value: str, index: dict[str, Sequence[int]], period: Period = Period(), *, row: str = "row", chunk: float | None = None) -> Ticks:  # noqa: B008
    """Ticks of a table in a caller's order, with a caller's index of rows per asset.

    ``row`` names the column with a row's place in the table; ``index`` says
    which places belong to an asset and is trusted: rows that it does not name
    are left out, and a row that several assets name is a tick of each.
    """
    places = df.sparkSession.createDataFrame([(str(a), int(i)) for a, rows in index.items() for i in rows], "asset string, place long")
    picked = df.select(F.col(row).cast("long").alias("place"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("value"))
    return Ticks(picked.join(places, "place").select("asset", "t", "value", F.col("place").alias("seq")), period, chunk)


def show(ticks: Ticks, rows: int = 6, width: int = 50) -> str:
    """The first ticks in time order as text, with the number of all."""
    names = ["asset", "t", "value"]
    top = ticks.df.orderBy("t", "seq").limit(rows).select(*names).collect()
    lines = [f"Ticks with {ticks.df.count()} rows per {ticks.period.count} {ticks.period.unit}", "  ".join(names)]
    return "\n".join(line[:width] for line in lines + [f"{r.asset}  {r.t:g}  {r.value:g}" for r in top])


def chunk_for(df: DataFrame, rows: int = CHUNK_ROWS) -> float | None:
    """A stretch of time that holds about ``rows`` ticks on average; None if all are fewer."""
    r = df.agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    return None if r["n"] <= rows or r["hi"] <= r["lo"] else (r["hi"] - r["lo"]) * rows / r["n"]


def rescaled(ticks: Ticks, period: Period, *, strict: bool = False) -> Ticks:
    """Times in another unit.

    The rule multiplies times by new over old; ``strict`` uses old over new,
    so that 60 s become 1 min.
    """
    ratio = ticks.period.ratio(period) if strict else period.ratio(ticks.period)
    if ratio == 1:
        return replace(ticks, period=period)
    return replace(ticks, df=ticks.df.withColumn("t", F.col("t") * ratio), period=period, chunk=ticks.chunk and ticks.chunk * ratio)


def combine(tables: list[Ticks], period: Period | None = None) -> Ticks:
    """Bag union of tick tables in one unit; duplicates stay."""
    if not tables:
        raise ValueError("no tick tables to combine")
    period = period or tables[0].period
    first, *rest = (rescaled(t, period) for t in tables)
    df = first.df
    for other in rest:
        df = df.unionByName(other.df)
    return replace(first, df=df)


def read_ticks(
    spark: SparkSession,
    path: str,
    time: str,
    grouping: str,
    value: str,
    period: Period = Period(),  # noqa: B008
    *,
    seq: str | None = None,
    chunk: float | str | None = "auto",
    fmt: str = "parquet",
    schema: str | None = None,
    **options,
) -> Ticks:
    """Ticks from Parquet, ORC, JSON or CSV files; ``seq`` orders ties, and chunks are sized by a count unless given."""
    reader = spark.read.format(fmt).options(**options)
    ticks = from_columns((reader.schema(schema) if schema else reader).load(path), time, grouping, value, period, seq=seq)
    return replace(ticks, chunk=chunk_for(ticks.df) if chunk == "auto" else chunk)


def event_ticks(spark: SparkSession, sf_dir: str, grouping: str = "event_type", chunk: float | None = 5 * 86_400.0) -> Ticks:
    """The ``events`` table as ticks: seconds since the start of 2024, ties in order of event_id.

    ``chunk`` is the longest stretch; where it would hold more than a count on average, it is cut by that count.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.expr("cast(cast(cast(ts - timestamp_ntz'2024-01-01 00:00:00' as interval second) as decimal(18,6)) as double)")
    ticks = from_columns(events.withColumn("t", seconds), "t", grouping, "value", seq="event_id")
    if chunk is None:
        return ticks
    return replace(ticks, chunk=min(chunk, chunk_for(ticks.df, CHUNK_ROWS) or chunk))
