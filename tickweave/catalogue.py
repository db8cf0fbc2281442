"""Registered queries of the tick operators with their DuckDB counterparts.

All run over the whole ``events`` table: assets are event types (five) or
users, time is seconds since the start of 2024.  Doubles are rounded in both
languages, so that the order of summation does not show.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import linalg, table_functions
from tickweave.functions.kernels import KERNELS
from tickweave.functions.periods import Period
from tickweave.operators import clustering, matrices, ordered, sampling, simulation
from tickweave.operators import covariance as C
from tickweave.operators import volatility as V
from tickweave.plans import estimate
from tickweave.sources import ticks as T
from tickweave.workspace import materialise

HOUR = 3600.0
ASSETS = ["click", "error", "purchase", "signup", "view"]
FLAGSHIP = "grid_correlation"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TICKS = "ticks as (select event_type as asset, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t, value, event_id as seq from events)"
RANKED = TICKS + ", ranked as (select *, row_number() over (partition by asset order by t, seq) as rn from ticks)"
RETURNS = TICKS + ", d as (select * from (select asset, t, seq, value, lag(t) over w as p_t, value - lag(value) over w as r from ticks window w as (partition by asset order by t, seq)) where p_t is not null)"
GRID = "ext as (select min(t) as lo, max(t) as hi from ticks), grid as (select k, lo + k * 3600.0 as t from (select unnest(range(0, cast(floor((hi - lo) / 3600.0) as bigint) + 1)) as k, lo from ext))"
SAMPLED = (
    f"{TICKS}, {GRID}, firsts as (select asset, arg_min(value, (t, seq)) as v0 from ticks group by asset), "
    "gx as (select f.asset, g.k, g.t, f.v0 from grid g cross join firsts f), "
    "sampled as (select asset, k, t, coalesce(v, v0) as value from (select gx.asset, gx.k, gx.t, gx.v0, x.value as v from gx asof left join ticks x on gx.asset = x.asset and gx.t >= x.t)), "
    "ret as (select * from (select asset, k, t, value - lag(value) over (partition by asset order by k) as r, t - lag(t) over (partition by asset order by k) as dt from sampled) where r is not null), "
    "cov as (select p.asset as a, q.asset as b, covar_samp(p.r, q.r) as cov from ret p join ret q on p.k = q.k and p.asset <= q.asset group by 1, 2)"
)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits, without negative zeros."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 as {name}"


def types(spark: SparkSession, sf_dir: str) -> T.Ticks:
    return T.event_ticks(spark, sf_dir)


def users(spark: SparkSession, sf_dir: str) -> T.Ticks:
    """Users as assets, for queries that count by asset and so need no stretches."""
    return T.event_ticks(spark, sf_dir, "user_id", chunk=None)


def hourly(ticks: T.Ticks) -> DataFrame:
    return sampling.even_grid(ticks, HOUR)


# --- sources and selection --------------------------------------------------


@query("tick_table", f"with {TICKS} select asset, t, value, seq from ticks")
def _(spark, sf):
    return types(spark, sf).df


@query("tick_table_ranked", f"with {RANKED} select asset, t, value, seq, rn from ranked")
def _(spark, sf):
    return ordered.ranked(types(spark, sf))


@query("rescaled_ticks", f"with {TICKS} select asset, {r('t / 60.0', 't', 4)}, value, seq from ticks")
def _(spark, sf):
    return rounded(T.rescaled(types(spark, sf), Period("Minute"), strict=True).df, 4)


@query("rescaled_by_rule", f"with {TICKS} select asset, {r('t * 60.0', 't', 4)}, value, seq from ticks")
def _(spark, sf):
    return rounded(T.rescaled(types(spark, sf), Period("Minute")).df, 4)


@query("ticks_of_columns", "select event_type as asset, cast(user_id as double) as t, value, row_number() over (partition by user_id order by value, event_type) as seq from events")
def _(spark, sf):
    return T.from_columns(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "event_type", "value").df


@query("read_ticks", f"with {RANKED} select asset, t, value, seq, rn from ranked")
def _(spark, sf):
    seconds = "cast(cast(cast(ts - timestamp_ntz'2024-01-01 00:00:00' as interval second) as decimal(18,6)) as double) as t"
    written = materialise(spark.read.parquet(f"{sf}/events.parquet").selectExpr("*", seconds), "ticks")
    folder = written.inputFiles()[0].rsplit("/", 1)[0]
    return ordered.ranked(T.read_ticks(spark, folder, "t", "event_type", "value", seq="event_id"))


@query("sorted_ticks", f"with {TICKS}, g as (select *, row_number() over (order by t, seq) - 1 as row from ticks) select asset, t, value, row as seq from g where asset in ('click', 'view') and row < 200")
def _(spark, sf):
    rows = sampling.global_rank(types(spark, sf)).select("asset", "t", "value", (F.col("rn") - 1).alias("row"))
    index: dict[str, list[int]] = {}
    for x in rows.where("row < 200 and asset in ('click', 'view')").collect():  # a caller's index
        index.setdefault(x.asset, []).append(x.row)
    return T.from_sorted(rows, "t", "value", index).df


@query("combined_ticks", f"with {TICKS}, u as (select * from ticks union all select * from ticks where t < 864000) select asset, count(*) as n, {r('sum(value)', 'total')}, count(distinct seq) as n_distinct from u group by asset")
def _(spark, sf):
    all_ = types(spark, sf)
    both = T.combine([all_, sampling.subset_to_time(all_, 864_000.0)])
    return rounded(both.df.groupBy("asset").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.countDistinct("seq").alias("n_distinct")))


USERS = "ticks as (select cast(user_id as varchar) as asset, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t, value, event_id as seq from events)"


@query("get_assets", f"with {USERS} select asset from ticks group by asset having count(*) >= 10 and max(value) - min(value) > 2.220446049250313e-13")
def _(spark, sf):
    return sampling.get_assets(users(spark, sf))


@query("subset_to_tick", f"with {TICKS} select * from ticks order by t, seq limit 500")
def _(spark, sf):
    return sampling.subset_to_tick(types(spark, sf), 500).df


@query("subset_to_time", f"with {TICKS} select * from ticks where t < 864000.0")
def _(spark, sf):
    return sampling.subset_to_time(types(spark, sf), 864_000.0).df


@query("duration", f"with {TICKS} select {r('max(t) - min(t)', 'duration')}, cast(round((max(t) - min(t)) * 1e9 / 1000) as bigint) as microseconds from ticks")
def _(spark, sf):
    ticks = types(spark, sf)
    out = ticks.df.agg((F.max("t") - F.min("t")).alias("duration"))
    return rounded(out.withColumn("microseconds", F.round(F.col("duration") * 1e9 / 1000).cast("long")))


@query("ticks_per_asset", f"with {USERS} select asset, count(*) as number_of_ticks from ticks group by asset having count(*) >= 10 and max(value) - min(value) > 2.220446049250313e-13")
def _(spark, sf):
    ticks = users(spark, sf)
    return sampling.ticks_per_asset(ticks, sampling.get_assets(ticks))


@query("time_between_refreshes", f"with {USERS} select asset, {r('count(*) / (select max(t) - min(t) from ticks)', 'time_between_ticks', 10)}, count(*) as number_of_ticks from ticks group by asset having count(*) >= 10 and max(value) - min(value) > 2.220446049250313e-13")
def _(spark, sf):
    ticks = users(spark, sf)
    return rounded(sampling.time_between_refreshes(ticks, sampling.get_assets(ticks)), 10)


# --- sampling ---------------------------------------------------------------


@query("latest_value", f"with {SAMPLED} select asset, k, {r('t', 't')}, value from sampled")
def _(spark, sf):
    ticks = types(spark, sf)
    return rounded(sampling.latest_value(ticks, hourly(ticks)))


@query("latest_value_wide", f"with {SAMPLED} select {r('t', 'time')}, " + ", ".join(f"max(value) filter (where asset = '{a}') as {a}" for a in ASSETS) + " from sampled group by k, t")
def _(spark, sf):
    ticks = types(spark, sf)
    return rounded(sampling.wide(sampling.latest_value(ticks, hourly(ticks), ASSETS), ASSETS).withColumnRenamed("Time", "time"))


@query("grid_returns", f"with {SAMPLED} select asset, k, {r('r', 'r')}, {r('r / sqrt(dt)', 'scaled')} from ret")
def _(spark, sf):
    ticks = types(spark, sf)
    sampled = materialise(sampling.latest_value(ticks, hourly(ticks)), "sampled")
    scaled = sampling.returns(sampled, rescale=True).withColumnRenamed("r", "scaled")
    return rounded(sampling.returns(sampled).join(scaled, ["asset", "k"]).select("asset", "k", "r", "scaled"))


@query("tick_returns", f"with {RETURNS} select asset, t, p_t, seq, {r('r', 'r')} from d")
def _(spark, sf):
    return rounded(sampling.tick_returns(types(spark, sf)))


_PICK = "((((k + 1) * 7919 + ascii(asset) * 104729 + length(asset) * 1299709 + 2604 * 15485863::bigint) * 48271) % 2147483647) / 2147483647.0"


@query(
    "random_value_in_interval",
    f"with {RANKED}, {GRID}, gx as (select a.asset, g.k, g.t from grid g cross join (select distinct asset from ticks) a), "
    "p as (select gx.asset, gx.k, gx.t, greatest(1, coalesce(x.rn, 1)) as hi from gx asof left join ranked x on gx.asset = x.asset and gx.t >= x.t), "
    "q as (select *, least(hi, coalesce(lag(hi) over (partition by asset order by k), 1) + 1) as lo from p), "
    f"s as (select asset, k, t, lo + cast(floor({_PICK} * (hi - lo + 1)) as bigint) as rn from q) "
    f"select s.asset, s.k, {r('s.t', 't')}, x.value from s join ranked x on s.asset = x.asset and s.rn = x.rn",
)
def _(spark, sf):
    ticks = types(spark, sf)
    return rounded(sampling.random_value_in_interval(ticks, hourly(ticks)))


@query("next_tick", f"with {TICKS}, g as (select asset, t, row_number() over (order by t, seq) as n from ticks), f as (select asset, min(n) as n, arg_min(t, n) as t from g where n >= 100 group by asset) select case when count(*) = 5 then {'arg_max(t, n)'} end as refresh_time, case when count(*) = 5 then max(n) end as refresh_index from f")
def _(spark, sf):
    return sampling.next_tick(types(spark, sf), 100)


_REFRESH_STEPS = (
    "with recursive {ticks}, g as (select asset, t, row_number() over (order by t, seq) as n from ticks), "
    "nxt as (select n, t, {cols} from g), "
    "jump as (select n, greatest({names}) as nr from nxt where {all}), "
    "walk(k, n) as (select 0, nr from jump where n = 1 union all select walk.k + 1, jump.nr from walk join jump on jump.n = walk.n + 1), "
    "refresh as (select walk.k, g.t from walk join g on g.n = walk.n)"
)
REFRESH = _REFRESH_STEPS.format(
    ticks=TICKS,
    cols=", ".join(f"min(case when asset = '{a}' then n end) over (order by n rows between current row and unbounded following) as m{i}" for i, a in enumerate(ASSETS)),
    names=", ".join(f"m{i}" for i in range(5)),
    all=" and ".join(f"m{i} is not null" for i in range(5)),
)


@query("refresh_times", REFRESH + " select k, t from refresh")
def _(spark, sf):
    return sampling.refresh_times(types(spark, sf))


@query("refresh_times_in_sql", REFRESH + " select k, t from refresh")
def _(spark, sf):
    table_functions.register(spark)
    ticks = types(spark, sf)
    ticks.df.createOrReplaceTempView("tickweave_ticks")
    return spark.sql(table_functions.refresh_times_sql("tickweave_ticks", ",".join(ASSETS), ticks.chunk))


@query(
    "refresh_times_of_pairs",
    f"with recursive {TICKS}, pr as (select p.asset as a, q.asset as b from (select distinct asset from ticks) p join (select distinct asset from ticks) q on p.asset < q.asset), "
    "g as (select a, b, asset, t, row_number() over (partition by a, b order by t, seq) as n from pr join ticks on asset = a or asset = b), "
    "nx as (select a, b, n, min(case when asset = a then n end) over w as m0, min(case when asset = b then n end) over w as m1 from g window w as (partition by a, b order by n rows between current row and unbounded following)), "
    "jump as (select a, b, n, greatest(m0, m1) as nr from nx where m0 is not null and m1 is not null), "
    "walk(a, b, k, n) as (select a, b, 0, nr from jump where n = 1 union all select jump.a, jump.b, walk.k + 1, jump.nr from walk join jump on jump.a = walk.a and jump.b = walk.b and jump.n = walk.n + 1) "
    "select walk.a, walk.b, walk.k, g.t from walk join g on g.a = walk.a and g.b = walk.b and g.n = walk.n",
)
def _(spark, sf):
    return sampling.refresh_times_of_pairs(types(spark, sf), [(a, b) for i, a in enumerate(ASSETS) for b in ASSETS[i + 1 :]])


# --- volatility -------------------------------------------------------------


@query("volatility_of_returns", f"with {SAMPLED} select asset, {r('sqrt(avg(r * r))', 'volatility')} from ret group by asset")
def _(spark, sf):
    ticks = types(spark, sf)
    return rounded(V.volatility_of_returns(sampling.returns(sampling.latest_value(ticks, hourly(ticks)))))


@query("change_volatility", f"with {RETURNS}, x as (select asset, max(t) - min(t) as span from ticks group by asset) select asset, {r('sqrt(sum(r * r) / max(span))', 'volatility', 9)} from d join x using (asset) group by asset")
def _(spark, sf):
    return rounded(V.change_volatility(types(spark, sf)), 9)


def two_scales_sql(source: str, keys: str, grids: str) -> str:
    """CTEs pure(keys, v, noise) from a ranked source(keys, rn, t, value)."""
    return (
        f"sz as (select {keys}, count(*) as n, max(t) - min(t) as span, least(cast(floor(count(*) / 4) as bigint), greatest(2, {grids})) as grids from {source} group by {keys}), "
        f"sub as (select {keys}, value, t, rn, n, span, grids, (rn - 1) % grids as s from {source} join sz using ({keys})), "
        f"dd as (select *, value - lag(value) over (partition by {keys}, s order by rn) as ds, value - lag(value) over (partition by {keys} order by rn) as df from sub), "
        f"vs as (select {keys}, avg(v) as sparse from (select {keys}, s, sqrt(sum(ds * ds) / (max(t) - min(t))) as v from dd group by {keys}, s) group by {keys}), "
        f"vf as (select {keys}, sqrt(sum(df * df) / (max(t) - min(t))) as full_v from dd group by {keys}), "
        f"pure as (select {keys}, (sparse - full_v / grids) / (1 - 1.0 / grids) as v, full_v, n, span from vs join vf using ({keys}) join sz using ({keys})), "
        f"est as (select {keys}, v as volatility, (full_v * full_v - v * v) * span / (2 * n) as noise from pure)"
    )


_DEFAULT_GRIDS = "(select cast(greatest(floor(min(c) / 100.0), 3) as bigint) from (select count(*) as c from ticks group by asset))"
TWO_SCALES = f"{RANKED}, {two_scales_sql('ranked', 'asset', _DEFAULT_GRIDS)}"


@query("two_scales_volatility", f"with {TWO_SCALES} select asset, {r('volatility', 'volatility', 9)} from est")
def _(spark, sf):
    return rounded(estimate.estimate_volatility(types(spark, sf)), 9)


@query("microstructure_noise", f"with {TWO_SCALES} select asset, {r('greatest(0.0, noise)', 'noise')} from est")
def _(spark, sf):
    return rounded(estimate.estimate_microstructure_noise(types(spark, sf)))


@query("default_spacing", f"with {RANKED}, {two_scales_sql('ranked', 'asset', '5')}, tt as (select max(t) - min(t) as span_all from ticks) select asset, {r('case when noise < 1e-7 then 20.0 else ((span_all / (4 * noise * noise)) * span_all * volatility ** 4) ** (1.0 / 3.0) end', 'spacing', 4)} from est, tt")
def _(spark, sf):
    return rounded(V.default_spacing(types(spark, sf)), 4)


_SPACING = (
    f"{RANKED}, {two_scales_sql('ranked', 'asset', '5')}, tt as (select min(t) as lo, max(t) as hi, max(t) - min(t) as span_all from ticks), "
    "spacing as (select asset, case when noise < 1e-7 then 20.0 else ((span_all / (4 * noise * noise)) * span_all * volatility ** 4) ** (1.0 / 3.0) end as spacing from est, tt)"
)
_FIRST = "firsts as (select asset, arg_min(value, (t, seq)) as v0 from ticks group by asset)"


@query(
    "simple_volatility",
    f"with {_SPACING}, {_FIRST}, own as (select asset, spacing, v0, unnest(range(0, cast(floor((hi - lo) / spacing + 1e-12) as bigint) + 1)) as k, lo from spacing join firsts using (asset), tt), "
    "gx as (select asset, k, lo + k * spacing as t, v0 from own), "
    "sampled as (select gx.asset, gx.k, gx.t, coalesce(x.value, gx.v0) as value from gx asof left join ticks x on gx.asset = x.asset and gx.t >= x.t), "
    "ret as (select asset, t, value - lag(value) over (partition by asset order by k) as r from sampled) "
    f"select asset, {r('sqrt(avg(r * r)) / sqrt((max(t) - min(t)) / (count(*) - 1))', 'volatility', 9)} from ret group by asset",
)
def _(spark, sf):
    return rounded(V.simple_volatility(types(spark, sf)), 9)


# --- covariance -------------------------------------------------------------


@query("grid_covariance", f"with {SAMPLED} select a, b, {r('cov', 'cov')} from cov")
def _(spark, sf):
    ticks = types(spark, sf)
    return rounded(C.grid_covariance(ticks, hourly(ticks), ASSETS))


_COR = "sd as (select a as asset, sqrt(cov) as s from cov where a = b), cor as (select cov.a, cov.b, case when cov.a = cov.b then 1.0 else cov / (x.s * y.s) end as cor from cov join sd x on cov.a = x.asset join sd y on cov.b = y.asset)"


@query("grid_correlation", f"with {SAMPLED}, {_COR} select a, b, {r('cor', 'cor', 9)} from cor")
def _(spark, sf):
    ticks = types(spark, sf)
    return rounded(matrices.correlations_of(C.grid_covariance(ticks, hourly(ticks), ASSETS)), 9)


@query("covariance_to_volatility", f"with {SAMPLED} select a as asset, {r('sqrt(cov) / sqrt(3600.0)', 'volatility', 9)} from cov where a = b")
def _(spark, sf):
    ticks = types(spark, sf)
    return rounded(matrices.volatilities_of(C.grid_covariance(ticks, hourly(ticks), ASSETS), HOUR), 9)


@query("covariance_in_period", f"with {SAMPLED}, {_COR} select c.a, c.b, {r('c.cor * x.s * y.s / 60.0', 'cov')} from cor c join sd x on c.a = x.asset join sd y on c.b = y.asset")
def _(spark, sf):
    ticks = types(spark, sf)
    cov = materialise(C.grid_covariance(ticks, hourly(ticks), ASSETS), "covariance")
    return rounded(matrices.covariances_of(matrices.correlations_of(cov), matrices.volatilities_of(cov, HOUR), 60.0))


_REF_RET = (
    REFRESH + ", rfirst as (select asset, arg_min(value, (t, seq)) as v0 from ticks group by asset), rs as (select f.asset, g.k, g.t, coalesce(x.value, f.v0) as value from refresh g cross join rfirst f asof left join ticks x on f.asset = x.asset and g.t >= x.t), "
    "rr as (select * from (select asset, k, value - lag(value) over (partition by asset order by k) as r from rs) where r is not null)"
)


def _refresh_returns(ticks: T.Ticks) -> DataFrame:
    return sampling.returns(sampling.latest_value(ticks, sampling.refresh_times(ticks, ASSETS), ASSETS))


@query("refresh_prices", _REF_RET + f" select asset, k, {r('t', 't')}, value from rs")
def _(spark, sf):
    ticks = types(spark, sf)
    return rounded(sampling.latest_value(ticks, sampling.refresh_times(ticks, ASSETS), ASSETS))


@query("refresh_covariance", _REF_RET + f" select p.asset as a, q.asset as b, {r('covar_samp(p.r, q.r)', 'cov')} from rr p join rr q on p.k = q.k and p.asset <= q.asset group by 1, 2")
def _(spark, sf):
    return rounded(C.covariance_of_returns(_refresh_returns(types(spark, sf))))


@query("realised_autocovariance", _REF_RET + f" select p.asset as a, q.asset as b, {r('sum(p.r * q.r)', 'cov', 4)} from rr p join rr q on p.k = q.k + 3 group by 1, 2")
def _(spark, sf):
    return rounded(C.realised_autocovariance(_refresh_returns(types(spark, sf)), 3), 4)


@query(
    "preaveraged_end_returns",
    _REF_RET + ", nn as (select count(distinct k) as n from rr), e as (select asset, k as i, n, r from rr, nn) "
    f"select asset, cast(case when i <= 2 then 1 when i > n - 2 then n - 2 else i - 1 end as bigint) as k, {r('sum(case when i <= 2 then -r * i / 2.0 when i > n - 2 then r * (i - n + 2) / 2.0 else r end)', 'r')} from e group by 1, 2",
)
def _(spark, sf):
    return rounded(C.end_averaged_returns(_refresh_returns(types(spark, sf)), 2))


_KERNEL_COV = (
    _REF_RET + ", hh as (select 3.51 * (count(*) / 5.0) ** 0.6 as h from ticks), "
    "w as (select p.asset as a, q.asset as b, abs(p.k - q.k) / max(h) as x, sum(p.r * q.r) as g from rr p join rr q on p.asset <= q.asset join hh on abs(p.k - q.k) <= floor(h) group by p.asset, q.asset, p.k - q.k), "
    "kc as (select a, b, sum(g * case when x < 0.5 then 1 - 6 * x * x + 6 * x * x * x when x < 1 then 2 * (1 - x) * (1 - x) else 0 end) as cov from w group by 1, 2)"
)


@query("realised_kernel", _KERNEL_COV + f" select a, b, {r('cov', 'cov', 4)} from kc")
def _(spark, sf):
    return rounded(C.bnhls(types(spark, sf), ASSETS), 4)


_X = "(select unnest(range(1, 41)) / 10.0 as x)"
_KERNEL_SQL = {
    "parzen": "case when x < 0.5 then 1 - 6 * x * x + 6 * x * x * x when x < 1 then 2 * (1 - x) * (1 - x) else 0 end",
    "quadratic_spectral": "3 / (x * x) * (sin(x) / x - cos(x))",
    "fejer": "(sin(x) / x) * (sin(x) / x)",
    "tukey_hanning": "sin(pi() / 2 * exp(-x)) * sin(pi() / 2 * exp(-x))",
    "bnhls_2008": "(1 + x) * exp(-x)",
}


@query("kernels", f"select {r('x', 'x', 2)}, " + ", ".join(r(e, n, 9) for n, e in _KERNEL_SQL.items()) + f" from {_X}")
def _(spark, sf):
    x = spark.range(1, 41).select((F.col("id") / 10.0).alias("x"))
    return rounded(x.select(F.round("x", 2).alias("x"), *[k.column(F.col("x")).alias(n) for n, k in KERNELS.items()]), 9)


@query("orthogonal_sine", f"with {TICKS} select seq, {r('case when t > 86400.0 * floor(t / 86400.0) then sqrt(2 * 86400.0) / (3 * pi()) * sin(3 * pi() * (t - 86400.0 * floor(t / 86400.0)) / 86400.0) else 0 end', 's')} from ticks")
def _(spark, sf):
    df = types(spark, sf).df
    return rounded(df.select("seq", C.orthogonal_sine(F.col("t"), F.lit(3), F.floor(F.col("t") / 86_400.0), 86_400.0).alias("s")))


_SPECTRAL = (
    f"with {TWO_SCALES}, d as (select * from (select asset, t, seq, value, lag(t) over w as p_t, value - lag(value) over w as r from ticks where t > 0 window w as (partition by asset order by t, seq)) where p_t is not null), "
    "bw as (select max(t) / 10 as w from ticks), "
    "q as (select asset, r, t - p_t as gap, p_t + 0.5 * (t - p_t) as c, cast(least(9, floor(t / w)) as int) as block, w from d, bw), "
    "s as (select block, asset, j, sum((pi() * j / w) * r * case when c > block * w then sqrt(2 * w) / (j * pi()) * sin(j * pi() * (c - block * w) / w) else 0 end) as s from q cross join (select unnest(range(1, 101)) as j) group by 1, 2, 3), "
    "h as (select block, asset, sum(gap * gap) * max(greatest(0.0, est.noise)) / max(w) as h from q join est using (asset) group by 1, 2), "
    "sb as (select p.block, p.asset as a, q.asset as b, sum(p.s * q.s) / 100 - case when p.asset = q.asset then max(h.h) * (select (pi() / w) ** 2 from bw) * (select sum(j * j) from range(1, 101) x(j)) / 100.0 else 0 end as cov "
    "from s p join s q on p.block = q.block and p.j = q.j and p.asset <= q.asset join h on h.block = p.block and h.asset = p.asset group by 1, 2, 3)"
)


@query("spectral_blocks", _SPECTRAL + f" select block, a, b, {r('cov', 'cov', 9)} from sb")
def _(spark, sf):
    return rounded(C.spectral_blocks(types(spark, sf), ASSETS), 9)


_PRE = (
    f"with {RETURNS}, kk as (select cast(ceil(least(count(*) / 2.0, 0.15 * sqrt(count(*)))) as bigint) as k from ticks), "
    "di as (select asset, t, r, row_number() over (partition by asset order by t, seq) as i, count(*) over (partition by asset) as n from d), "
    "ws as (select k, j, least(j * 1.0 / k, 1 - j * 1.0 / k) as weight from kk, lateral (select unnest(range(1, k)) as j)), "
    "yy as (select x.asset, x.i, sum(ws.weight * z.r) as y from di x join ws on true join di z on z.asset = x.asset and z.i = x.i + ws.j - 1 group by 1, 2), "
    "ya as (select di.asset, di.i, di.t, di.n, kk.k, case when di.i <= di.n - kk.k + 1 then coalesce(yy.y, 0) end as y, di.n - kk.k + 1 as len from di cross join kk left join yy on yy.asset = di.asset and yy.i = di.i), "
    "yc as (select *, sum(coalesce(y, 0)) over (partition by asset order by i) as c from ya)"
)
_OWN = (
    "ow as (select m.asset as a, m.asset as b, sum(m.y * (hi.c - coalesce(lo.c, 0))) / (0.25 * max(m.k)) ** 2 as cov from yc m join yc hi on hi.asset = m.asset and hi.i = m.i + m.k - 1 "
    "left join yc lo on lo.asset = m.asset and lo.i = m.i - m.k where m.y is not null and m.i >= m.k and m.i <= m.len - 2 * m.k + 1 group by 1, 2)"
)
_OVERLAP = (
    "aa as (select x.asset as a, e.asset as b, x.i, x.t, z.t as te, x.y, x.k from yc x join yc z on z.asset = x.asset and z.i = x.i + x.k join (select distinct asset from ticks) e on x.asset < e.asset where x.i <= x.len - x.k + 2 and x.y is not null), "
    "lo as (select aa.*, greatest(1, coalesce(x.i, 0) + 1 - aa.k) as lo from aa asof left join yc x on x.asset = aa.b and aa.t > x.t), "
    "sp as (select lo.*, least(coalesce(x.len, 0), coalesce(x.i, 0)) as hi from lo asof left join yc x on x.asset = lo.b and lo.te >= x.t), "
    "ov as (select sp.a, sp.b, sum(sp.y * (h.c - coalesce(l.c, 0))) / (0.25 * max(sp.k)) ** 2 as cov from sp join yc h on h.asset = sp.b and h.i = sp.hi left join yc l on l.asset = sp.b and l.i = sp.lo - 1 where sp.hi >= sp.lo group by 1, 2), "
    "ovs as (select p.asset as a, q.asset as b, coalesce(ov.cov, 0) as cov from (select distinct asset from ticks) p join (select distinct asset from ticks) q on p.asset < q.asset left join ov on ov.a = p.asset and ov.b = q.asset)"
)


def _window(ticks: T.Ticks) -> int:
    return C.preaveraging_window(ticks.df.count())


@query("preaveraged_returns", _PRE + f" select asset, i, t, {r('y', 'y')} from ya")
def _(spark, sf):
    ticks = types(spark, sf)
    return rounded(C.preaveraged_returns(ticks, _window(ticks)).select("asset", F.col("i").cast("long").alias("i"), "t", "y"))


@query("own_overlap_sum", _PRE + f", {_OWN} select a, b, {r('cov', 'cov', 4)} from ow")
def _(spark, sf):
    ticks = types(spark, sf)
    k = _window(ticks)
    return rounded(C.own_overlap_sum(C.preaveraged_returns(ticks, k), k, 0.25), 4)


@query("overlap_sums", _PRE + f", {_OVERLAP} select a, b, {r('cov', 'cov', 4)} from ovs")
def _(spark, sf):
    ticks = types(spark, sf)
    k = _window(ticks)
    return rounded(C.overlap_sums(C.preaveraged_returns(ticks, k), [(a, b) for i, a in enumerate(ASSETS) for b in ASSETS[i + 1 :]], k, 0.25, ticks.chunk), 4)


@query("preaveraged_raw", _PRE + f", {_OWN}, {_OVERLAP} select a, b, {r('cov', 'cov', 4)} from (select * from ow union all select * from ovs)")
def _(spark, sf):
    return rounded(C.preaveraged(types(spark, sf), ASSETS), 4)


_PAIR_WALK = (
    "with recursive {ticks}, pr as (select p.asset as a, q.asset as b from (select distinct asset from ticks) p join (select distinct asset from ticks) q on p.asset < q.asset), "
    "g as (select a, b, asset, t, row_number() over (partition by a, b order by t, seq) as n from pr join ticks on asset = a or asset = b), "
    "nx as (select a, b, n, min(case when asset = a then n end) over w as m0, min(case when asset = b then n end) over w as m1 from g window w as (partition by a, b order by n rows between current row and unbounded following)), "
    "jump as (select a, b, n, greatest(m0, m1) as nr from nx where m0 is not null and m1 is not null), "
    "walk(a, b, k, n) as (select a, b, 0, nr from jump where n = 1 union all select jump.a, jump.b, walk.k + 1, jump.nr from walk join jump on jump.a = walk.a and jump.b = walk.b and jump.n = walk.n + 1), "
    "pt as (select walk.a, walk.b, walk.k, g.t from walk join g on g.a = walk.a and g.b = walk.b and g.n = walk.n)"
)
_PAIR_COR = (
    _PAIR_WALK.format(ticks=TWO_SCALES) + ", gx as (select a, b, k, t, asset from pt, lateral (select unnest([a, b]) as asset)), "
    "p as (select gx.*, greatest(1, coalesce(x.rn, 1)) as hi from gx asof left join ranked x on gx.asset = x.asset and gx.t >= x.t), "
    "q as (select *, least(hi, coalesce(lag(hi) over (partition by a, b, asset order by k), 1) + 1) as lo from p), "
    f"s as (select a, b, asset, k, t, lo + cast(floor({_PICK} * (hi - lo + 1)) as bigint) as rn from q), "
    "pp as (select s.a, s.b, s.k, s.t, max(case when s.asset = s.a then x.value end) as x, max(case when s.asset = s.b then x.value end) as y from s join ranked x on s.asset = x.asset and s.rn = x.rn group by 1, 2, 3, 4), "
    "vv as (select pp.*, greatest(0.1, least(0.9, vb.volatility / (va.volatility + vb.volatility))) as gamma from pp join est va on va.asset = pp.a join est vb on vb.asset = pp.b), "
    "four as (select a, b, kind, k + 1 as rn, t, value, gamma from vv, lateral (select unnest(['plus', 'minus', 'x', 'y']) as kind, unnest([gamma * x + (1 - gamma) * y, gamma * x - (1 - gamma) * y, x, y]) as value)), "
    + two_scales_sql("four", "a, b, kind", _DEFAULT_GRIDS).replace("sz as", "sz4 as").replace("join sz using", "join sz4 using").replace("sub as", "sub4 as").replace("from sub)", "from sub4)").replace("dd as", "dd4 as").replace("from dd ", "from dd4 ").replace("vs as", "vs4 as").replace("from vs join vf", "from vs4 join vf4").replace("vf as", "vf4 as").replace("pure as", "pure4 as").replace("from pure)", "from pure4)").replace("est as", "est4 as")
    + ", gm as (select distinct a, b, gamma from four), "
    "pc as (select e.a, e.b, (max(case when kind = 'plus' then volatility end) ** 2 - max(case when kind = 'minus' then volatility end) ** 2) / (4 * max(gamma) * (1 - max(gamma))) / (max(case when kind = 'x' then volatility end) * max(case when kind = 'y' then volatility end)) as cor from est4 e join gm on gm.a = e.a and gm.b = e.b group by 1, 2)"
)


@query("two_scales_correlations", _PAIR_COR + f" select a, b, {r('cor', 'cor')} from pc")
def _(spark, sf):
    return rounded(C.two_scales_correlations(types(spark, sf), ASSETS))


# --- estimated matrices as long tables --------------------------------------


def _long(name: str, method: str, sql: str | None = None, **given):
    @query(name, sql)
    def _(spark, sf):
        cm = estimate.estimate_covariance(types(spark, sf), ASSETS, method, **given)
        return rounded(cm.to_frame(spark), 6)


def long_sql(cells: str, elapsed: str) -> str:
    """Long form of a covariance cells(a, b, cov), a <= b, over ``elapsed`` seconds that regularisation leaves as it is."""
    return (
        f"v as (select a as asset, sqrt(cov) as s from {cells} where a = b), "
        f"lf as (select c.a as asset1, c.b as asset2, c.cov / (x.s * y.s) as value, 'correlation' as variable from {cells} c join v x on c.a = x.asset join v y on c.b = y.asset where c.a < c.b "
        f"union all select asset, asset, s / sqrt({elapsed}), 'volatility' from v) "
        f"select asset1, asset2, {r('value', 'value')}, variable, case when variable = 'volatility' then 'Second' end as vol_period_units, case when variable = 'volatility' then 1::bigint end as vol_period from lf"
    )


_DEFAULT_COV = (
    f"with {_SPACING}, {_FIRST}, sp as (select least(avg(spacing), max(span_all) / 20) as sp from spacing, tt), "
    "grid as (select k, lo + k * sp as t, sp from (select unnest(range(0, cast(floor((hi - lo) / sp + 1e-12) as bigint) + 1)) as k, lo, sp from tt, sp)), "
    "gx as (select f.asset, g.k, g.t, f.v0 from grid g cross join firsts f), "
    "sampled as (select gx.asset, gx.k, coalesce(x.value, gx.v0) as value from gx asof left join ticks x on gx.asset = x.asset and gx.t >= x.t), "
    "ret as (select * from (select asset, k, value - lag(value) over (partition by asset order by k) as r from sampled) where r is not null), "
    "dc as (select p.asset as a, q.asset as b, covar_samp(p.r, q.r) as cov from ret p join ret q on p.k = q.k and p.asset <= q.asset group by 1, 2)"
)
_long("estimate_simple", "simple_covariance", f"{_DEFAULT_COV}, {long_sql('dc', '(select max(sp) from grid)')}")
_long("estimate_bnhls", "bnhls_covariance")
_long("estimate_spectral", "spectral_covariance")
_long("estimate_preaveraged", "preaveraged_covariance")
_long("estimate_two_scales", "two_scales_covariance")


@query("spectral_raw", f"{_SPECTRAL} select a, b, {r('sum(cov) / 10', 'cov', 9)} from sb group by 1, 2")
def _(spark, sf):
    """Mean of the blocks, before each is regularised."""
    return rounded(C.spectral_blocks(types(spark, sf), ASSETS).groupBy("a", "b").agg((F.sum("cov") / 10).alias("cov")), 9)


_BLOCK_SQL = f"with {SAMPLED}, {long_sql('cov', '3600.0')}"


@query("blockwise_estimation", _BLOCK_SQL)
def _(spark, sf):
    ticks = types(spark, sf)
    blocks = estimate.blocks_by_frequency(ticks, 0.005, "simple_covariance", {"spacing": HOUR})
    return rounded(estimate.blockwise_estimation(ticks, blocks).rearrange(ASSETS).to_frame(spark), 6)


@query("blocking_plan")
def _(spark, sf):
    blocks = estimate.blocks_by_frequency(users(spark, sf), 0.1)
    rows = [(i, sorted(b.assets), b.method, b.number_of_assets, b.mean_number_of_ticks, b.mean_time_per_tick) for i, b in enumerate(blocks)]
    return spark.createDataFrame(rows, "ord int, assets array<string>, method string, number_of_assets int, mean_number_of_ticks double, mean_time_per_tick double")


_BLOCKS_SQL = (
    f"with recursive {USERS}, rates as (select asset, count(*) / (select max(t) - min(t) from ticks) as rate, count(*) as n from ticks group by asset having count(*) >= 10 and max(value) - min(value) > 2.220446049250313e-13), "
    "starts(s) as (select min(rate) from rates union all select (select min(rate) from rates where rate / s - 1 > 0.1) from starts where exists (select 1 from rates where rate / s - 1 > 0.1)), "
    "numbered as (select s, row_number() over (order by s) - 1 as g from starts), "
    "members as (select r.asset, r.rate, r.n, max(x.g) as g from rates r join numbered x on r.rate >= x.s group by 1, 2, 3), "
    "blocks(path, lo, hi) as (select '', 0, (select count(*) from numbered) union all "
    "select path || side, case side when '0' then lo else lo + (hi - lo) // 2 end, case side when '0' then lo + (hi - lo) // 2 else hi end from blocks, (select unnest(['0', '1']) as side) where hi - lo > 1), "
    "sized as (select path, count(*) as number_of_assets, avg(n) as ticks, avg(rate) as rate from blocks join members on g >= lo and g < hi group by path), "
    "placed as (select *, row_number() over (order by number_of_assets desc, path) - 1 as ord from sized) "
    f"select cast(p.ord as int) as ord, m.asset, cast(p.number_of_assets as int) as number_of_assets, {r('p.ticks', 'mean_number_of_ticks')}, {r('p.rate', 'mean_time_per_tick', 10)} "
    "from placed p join blocks b using (path) join members m on m.g >= b.lo and m.g < b.hi"
)


@query("blocks_by_frequency", _BLOCKS_SQL)
def _(spark, sf):
    """The blocking plan, a row per asset of each block."""
    blocks = estimate.blocks_by_frequency(users(spark, sf), 0.1)
    rows = [(i, a, b.number_of_assets, b.mean_number_of_ticks, b.mean_time_per_tick) for i, b in enumerate(blocks) for a in sorted(b.assets)]
    df = spark.createDataFrame(rows, "ord int, asset string, number_of_assets int, mean_number_of_ticks double, mean_time_per_tick double")
    return df.withColumns({"mean_number_of_ticks": F.round("mean_number_of_ticks", 6) + F.lit(0.0), "mean_time_per_tick": F.round("mean_time_per_tick", 10) + F.lit(0.0)})


# --- matrices ---------------------------------------------------------------


def _cor(spark, sf) -> DataFrame:
    ticks = types(spark, sf)
    return C.grid_covariance(ticks, hourly(ticks), ASSETS)


@query("shrink_to_identity", f"with {SAMPLED} select a, b, {r('0.3 * case when a = b then 1.0 else 0.0 end + 0.7 * cov', 'cov')} from cov")
def _(spark, sf):
    return rounded(matrices.shrunk(_cor(spark, sf), 0.3))


@query("squared_frobenius", f"with {SAMPLED} select {r('sum(cov * cov * case when a = b then 1 else 2 end) / 5', 'norm', 2)} from cov")
def _(spark, sf):
    both = matrices.both_triangles(_cor(spark, sf))
    return rounded(both.agg((F.sum(F.col("cov") * F.col("cov")) / len(ASSETS)).alias("norm")), 2)


_LONG_SQL = f"with {SAMPLED}, {_COR}, lf as (select a as asset1, b as asset2, cor as value, 'correlation' as variable from cor where a < b union all select a, a, sqrt(cov) / 60.0, 'volatility' from cov where a = b)"


@query("covariance_long_form", _LONG_SQL + f" select asset1, asset2, {r('value', 'value', 9)}, variable, case when variable = 'volatility' then 'Second' end as vol_period_units, case when variable = 'volatility' then 1::bigint end as vol_period from lf")
def _(spark, sf):
    ticks = types(spark, sf)
    cm = estimate.simple_covariance(ticks, ASSETS, spacing=HOUR, regularisation=None)
    return rounded(cm.to_frame(spark), 9)


@query("covariance_round_trip", _LONG_SQL + f" select asset1, asset2, {r('value', 'value', 9)}, variable from lf")
def _(spark, sf):
    cm = estimate.simple_covariance(types(spark, sf), ASSETS, spacing=HOUR, regularisation=None)
    again = matrices.matrix_from_frame(cm.to_frame(spark).orderBy(F.rand(3)))
    return rounded(again.rearrange(ASSETS).to_frame(spark).select("asset1", "asset2", "value", "variable"), 9)


@query("rearranged", _LONG_SQL + f" select asset1, asset2, {r('value * case when variable = $$volatility$$ then sqrt(60.0) else 1 end', 'value', 9)}, variable from lf where asset1 in ('click', 'view') and asset2 in ('click', 'view')")
def _(spark, sf):
    cm = estimate.simple_covariance(types(spark, sf), ASSETS, spacing=HOUR, regularisation=None)
    return rounded(cm.rearrange(["click", "view"], Period("Minute")).to_frame(spark).select("asset1", "asset2", "value", "variable"), 9)


@query("relabelled", _LONG_SQL + f" select replace(asset1, 'view', 'visit') as asset1, replace(asset2, 'view', 'visit') as asset2, {r('value', 'value', 9)}, variable from lf")
def _(spark, sf):
    cm = estimate.simple_covariance(types(spark, sf), ASSETS, spacing=HOUR, regularisation=None)
    return rounded(cm.relabel({"view": "visit"}).to_frame(spark).select("asset1", "asset2", "value", "variable"), 9)


def _half(sql_filter: str, tag: str) -> str:
    return (
        f"{tag}r as (select * from ret where {sql_filter}), {tag} as (select p.asset as asset1, q.asset as asset2, 'covariance' as variable, covar_samp(p.r, q.r) as value from {tag}r p join {tag}r q on p.k = q.k and p.asset <= q.asset group by 1, 2)"
    )


@query("combined_matrices", f"with {SAMPLED}, {_half('k <= 300', 'h1')}, {_half('k > 300', 'h2')} select asset1, asset2, variable, {r('(h1.value * 1.0 + h2.value * 3.0) / 4.0', 'value')} from h1 join h2 using (asset1, asset2, variable)")
def _(spark, sf):
    ticks = types(spark, sf)
    ret = materialise(sampling.returns(sampling.latest_value(ticks, hourly(ticks))), "returns")
    halves = None
    for part, weight in ((ret.where("k <= 300"), 1.0), (ret.where("k > 300"), 3.0)):
        one = C.covariance_of_returns(part).select(F.col("a").alias("asset1"), F.col("b").alias("asset2"), F.lit("covariance").alias("variable"), F.col("cov").alias("value"), F.lit(weight).alias("weight"))
        halves = one if halves is None else halves.unionByName(one)
    return rounded(matrices.combine_long(halves))


_TWO_GRIDS = SAMPLED + ", " + ", ".join(
    x.replace("grid as", "grid2 as").replace("3600.0", "7200.0") if x.startswith("grid as") else x
    for x in [
        "grid as (select k, lo + k * 3600.0 as t from (select unnest(range(0, cast(floor((hi - lo) / 3600.0) as bigint) + 1)) as k, lo from ext))",
    ]
) + (
    ", gx2 as (select f.asset, g.k, g.t, f.v0 from grid2 g cross join firsts f), "
    "sampled2 as (select gx2.asset, gx2.k, coalesce(x.value, gx2.v0) as value from gx2 asof left join ticks x on gx2.asset = x.asset and gx2.t >= x.t), "
    "ret2 as (select * from (select asset, k, value - lag(value) over (partition by asset order by k) as r from sampled2) where r is not null), "
    "cov2 as (select p.asset as a, q.asset as b, covar_samp(p.r, q.r) as cov from ret2 p join ret2 q on p.k = q.k and p.asset <= q.asset group by 1, 2), "
    "sd as (select a as asset, sqrt(cov) as s from cov where a = b), sd2 as (select a as asset, sqrt(cov) as s from cov2 where a = b), "
    "cor as (select cov.a, cov.b, cov / (x.s * y.s) as cor, cov / 3600.0 as per from cov join sd x on cov.a = x.asset join sd y on cov.b = y.asset), "
    "cor2 as (select cov2.a, cov2.b, cov / (x.s * y.s) as cor, cov / 7200.0 as per from cov2 join sd2 x on cov2.a = x.asset join sd2 y on cov2.b = y.asset)"
)


def _two_grids(spark, sf) -> tuple[matrices.CovarianceMatrix, matrices.CovarianceMatrix]:
    ticks = types(spark, sf)
    return tuple(estimate.simple_covariance(ticks, ASSETS, spacing=n * HOUR, regularisation=None) for n in (1, 2))


@query(
    "matrix_distance",
    f"with {_TWO_GRIDS} select {r('sum(case when a < b then 2 * abs(cor.cor - cor2.cor) else 0 end) / 10', 'correlation')}, "
    f"(select {r('avg(abs(sd.s / 60.0 - sd2.s / sqrt(7200.0)))', 'volatility')} from sd join sd2 using (asset)) as volatility, "
    f"{r('sum(case when a < b then 2 else 1 end * abs(cor.per - cor2.per)) / 25', 'covariance')} from cor join cor2 using (a, b)",
)
def _(spark, sf):
    x, y = _two_grids(spark, sf)
    cor, vol = matrices.mean_abs_distance(x, y)
    return rounded(spark.createDataFrame([(cor, vol, matrices.mean_abs_covariance_distance(x, y))], "correlation double, volatility double, covariance double"))


@query("two_matrices", f"with {_TWO_GRIDS}, c as (select a, b, case when a = b then 1.0 else cor end as cor from cor union all select b, a, cor from cor2 where a < b) select a, b, {r('cor', 'cor')}, cast(cast(floor(round_even(cor, 2) * 100) as bigint) as varchar) || '%' as label from c")
def _(spark, sf):
    x, y = (matrices.correlations_of(matrices.pairs_frame(spark, m)) for m in _two_grids(spark, sf))
    return rounded(clustering.comparison_rows(x, y))


_MODEL_SQL = f"with {SAMPLED}, {_COR}, mm as (select asset, avg(value) as mean from ticks group by asset), dd as (select asset, avg(r) / 3600.0 as drift from ret group by asset)"
_MODEL_ROWS = (
    "ml as (select a as asset1, b as asset2, cor as value, 'correlation' as variable from cor where a < b union all select a, a, sqrt(cov) / 60.0, 'volatility' from cov where a = b "
    "union all select asset, asset, drift, 'drift' from dd union all select asset, asset, mean, 'mean' from mm)"
)


def _model(spark, sf) -> matrices.CovarianceModel:
    """Hourly covariances with mean levels and mean returns per second."""
    ticks = types(spark, sf)
    cm = estimate.simple_covariance(ticks, ASSETS, spacing=HOUR, regularisation=None)
    means = {x.asset: x.m for x in ticks.df.groupBy("asset").agg(F.avg("value").alias("m")).collect()}
    drifts = {x.asset: x.d for x in sampling.returns(sampling.latest_value(ticks, hourly(ticks), ASSETS)).groupBy("asset").agg((F.avg("r") / HOUR).alias("d")).collect()}
    return matrices.CovarianceModel(cm, [means[a] for a in ASSETS], [drifts[a] for a in ASSETS])


def _values(df: DataFrame) -> DataFrame:
    return rounded(df.select("asset1", "asset2", "value", "variable"))


_UNIT = "case when variable = 'correlation' then null else 'Second' end as vol_period_units, case when variable = 'correlation' then null else 1::bigint end as vol_period"


@query("model_long_form", f"{_MODEL_SQL}, {_MODEL_ROWS} select asset1, asset2, {r('value', 'value')}, variable, {_UNIT} from ml")
def _(spark, sf):
    return rounded(_model(spark, sf).to_frame(spark))


@query("model_round_trip", f"{_MODEL_SQL}, {_MODEL_ROWS} select asset1, asset2, {r('value', 'value')}, variable from ml")
def _(spark, sf):
    again = matrices.model_from_frame(_model(spark, sf).to_frame(spark).orderBy(F.rand(5)))
    return _values(again.rearrange(ASSETS, strict=True).to_frame(spark))


@query(
    "model_rearranged",
    f"{_MODEL_SQL}, {_MODEL_ROWS} select asset1, asset2, {r('value * case variable when $$volatility$$ then sqrt(60.0) when $$drift$$ then 60.0 else 1 end', 'value')}, variable from ml where asset1 in ('click', 'view') and asset2 in ('click', 'view')",
)
def _(spark, sf):
    return _values(_model(spark, sf).rearrange(["click", "view"], Period("Minute")).to_frame(spark))


@query(
    "model_reordered",
    f"{_MODEL_SQL}, {_MODEL_ROWS}, x as (select * from ml where variable <> 'drift' and asset1 in ('click', 'view') and asset2 in ('click', 'view') union all select asset, asset, mean, 'drift' from mm where asset in ('click', 'view')) select asset1, asset2, {r('value', 'value')}, variable from x",
)
def _(spark, sf):
    """In the same period a reordering fills drifts with means."""
    return _values(_model(spark, sf).rearrange(["click", "view"]).to_frame(spark))


@query(
    "model_relabelled",
    f"{_MODEL_SQL}, {_MODEL_ROWS} select replace(asset1, 'view', 'visit') as asset1, replace(asset2, 'view', 'visit') as asset2, {r('value', 'value')}, case variable when 'mean' then 'drift' when 'drift' then 'mean' else variable end as variable from ml",
)
def _(spark, sf):
    """Means and drifts change places."""
    return _values(_model(spark, sf).relabel({"view": "visit"}).to_frame(spark))


@query(
    "model_lookups",
    f"{_MODEL_SQL} select {r('max(cor.cor)', 'correlation')}, (select {r('max(s) / sqrt(60.0)', 's')} from sd where asset = 'view') as volatility, (select {r('max(mean)', 'm')} from mm where asset = 'view') as mean, "
    f"(select {r('max(drift) * 60.0', 'd')} from dd where asset = 'view') as drift, cast(null as double) as unknown from cor where a = 'click' and b = 'view'",
)
def _(spark, sf):
    m = _model(spark, sf)
    minute = Period("Minute")
    row = (m.cm.get_correlation("click", "view"), m.cm.get_volatility("view", minute), m.get_mean("view"), m.get_drift("view", minute), m.get_mean("nobody"))
    return rounded(spark.createDataFrame([row], "correlation double, volatility double, mean double, drift double, unknown double"))


@query(
    "covariance_and_mean",
    f"{_MODEL_SQL}, full_cov as (select a, b, cov from cov union all select b, a, cov from cov where a < b) select a, b, {r('cov / 60.0', 'cov')}, {r('mean + drift * 60.0', 'mean')} from full_cov join mm on a = mm.asset join dd on a = dd.asset",
)
def _(spark, sf):
    cov, mean = _model(spark, sf).covariance_and_mean(Period("Minute"))
    rows = [(a, b, float(cov[i, j]), float(mean[i])) for i, a in enumerate(ASSETS) for j, b in enumerate(ASSETS)]
    return rounded(spark.createDataFrame(rows, "a string, b string, cov double, mean double"))


@query(
    "combined_models",
    f"with {_TWO_GRIDS}, mm as (select asset, avg(value) as mean from ticks group by asset), dd as (select asset, avg(r) / 3600.0 as drift from ret group by asset), dd2 as (select asset, avg(r) / 7200.0 as drift from ret2 group by asset), "
    "x as (select a as asset1, b as asset2, (cor.cor + 3 * cor2.cor) / 4 as value, 'correlation' as variable from cor join cor2 using (a, b) where a < b "
    "union all select asset, asset, (sd.s / 60.0 + 3 * sd2.s / sqrt(7200.0)) / 4, 'volatility' from sd join sd2 using (asset) "
    "union all select asset, asset, (dd.drift + dd2.drift) / 2, 'drift' from dd join dd2 using (asset) union all select asset, asset, mean * 5 / 4, 'mean' from mm) "
    f"select asset1, asset2, {r('value', 'value')}, variable from x",
)
def _(spark, sf):
    ticks = types(spark, sf)
    one = _model(spark, sf)
    drifts = {x.asset: x.d for x in sampling.returns(sampling.latest_value(ticks, sampling.even_grid(ticks, 2 * HOUR), ASSETS)).groupBy("asset").agg((F.avg("r") / (2 * HOUR)).alias("d")).collect()}
    two = matrices.CovarianceModel(estimate.simple_covariance(ticks, ASSETS, spacing=2 * HOUR, regularisation=None), one.means * 2, [drifts[a] for a in ASSETS])
    both = matrices.combine_models([one, two], [1.0, 3.0], drift_weights=[1.0, 1.0], mean_weights=[3.0, 1.0])
    return _values(both.to_frame(spark))


@query(
    "identity_from_ticks",
    f"{_REF_RET}, rz as (select * from (select asset, k, (value - lag(value) over w) / sqrt(t - lag(t) over w) as z from rs window w as (partition by asset order by k)) where z is not null), "
    f"{GRID.replace('grid as', 'hgrid as')}, hx as (select f.asset, g.k, g.t, f.v0 from hgrid g cross join rfirst f), hs as (select hx.asset, hx.k, coalesce(x.value, hx.v0) as value from hx asof left join ticks x on hx.asset = x.asset and hx.t >= x.t), "
    "hr as (select * from (select asset, k, value - lag(value) over (partition by asset order by k) as r from hs) where r is not null), "
    "m as (select p.asset as a, q.asset as b, covar_samp(p.r, q.r) / 3600.0 as m from hr p join hr q on p.k = q.k group by 1, 2), "
    "sizes as (select sum(m * m) as mm, sum((m - case when a = b then 1 else 0 end) ** 2) / 5 as level from m), "
    "dist as (select sqrt(sum((m - case when a = b then max_level else 0 end) ** 2) / 5) as d from (select m.*, (select level from sizes) as max_level from m)), "
    "norms as (select k, sum(z * z) as z2 from rz group by k), quad as (select p.k, sum(m * p.z * q.z) as q from rz p join rz q on p.k = q.k join m on m.a = p.asset and m.b = q.asset group by 1), "
    "sc as (select count(*) as n, sum(sqrt(greatest(0, (z2 * z2 - 2 * q + mm) / 5))) as total from norms join quad using (k), sizes), "
    "wt as (select least(total / (n * n), d) / d as weight from sc, dist) "
    f"select a, b, {r('weight * case when a = b then 1 else 0 end + (1 - weight) * m', 'cov', 9)} from m, wt where a <= b",
)
def _(spark, sf):
    ticks = types(spark, sf)
    cov = estimate.simple_covariance(ticks, ASSETS, spacing=HOUR, regularisation=None).covariance()
    out = estimate.regularise_array(cov, ticks, ASSETS, "identity_regularisation")
    return rounded(spark.createDataFrame([(a, b, float(out[i, j])) for i, a in enumerate(ASSETS) for j, b in enumerate(ASSETS) if i <= j], "a string, b string, cov double"), 9)


@query("identity_of_matrix", f"with {SAMPLED}, {_COR} select a, b, {r('case when a = b then 1 else 0.7 * cor end', 'cor', 9)} from cor")
def _(spark, sf):
    cm = estimate.simple_covariance(types(spark, sf), ASSETS, spacing=HOUR, regularisation=None).regularise("identity_regularisation", weight=0.3)
    return rounded(spark.createDataFrame([(a, b, float(cm.correlation[i, j])) for i, a in enumerate(ASSETS) for j, b in enumerate(ASSETS) if i <= j], "a string, b string, cor double"), 9)


_BAD = np.array([[1.02, 0.5, 0.9], [0.5, 0.98, 0.9], [0.9, 0.9, 1.01]])


@query("regularised_matrices")
def _(spark, sf):
    made = {
        "nearest_correlation": linalg.nearest_correlation(_BAD)[0],
        "nearest_psd": linalg.nearest_psd(_BAD),
        "eigenvalue_clean": linalg.eigenvalue_clean_for(_BAD, 50.0),
        "identity": linalg.shrink_to_identity(_BAD, 0.5),
    }
    return rounded(spark.createDataFrame([(n, i, j, float(m[i, j])) for n, m in made.items() for i in range(3) for j in range(3)], "method string, i int, j int, value double"), 9)


@query("regularised_from_ticks")
def _(spark, sf):
    ticks = types(spark, sf)
    cm = estimate.simple_covariance(ticks, ASSETS, spacing=HOUR)
    out = None
    for method in ("identity_regularisation", "eigenvalue_clean", "nearest_psd_matrix", "nearest_correlation_matrix"):
        one = estimate.regularise(cm, ticks, method).to_frame(spark, {"method": method})
        out = one if out is None else out.unionByName(one)
    return rounded(out, 9)


_PAIR_OF = f"with {SAMPLED}, {_COR}, e as (select cor as c, 1 - abs(cor) as lo, 1 + abs(cor) as hi, sign(cor) as sg, (select count(*) from ticks) / 5.0 as obs from cor where a = 'click' and b = 'view')"


def _two_cells(name: str, low: str, high: str, sign: str = "sg") -> str:
    """Rows of a symmetric matrix with equal diagonal cells, from its eigenvalues."""
    return f"select '{name}' as operator, ({low} + {high}) / 2 as diagonal, {sign} * ({high} - {low}) / 2 as other, true as holds from e"


_THRESHOLD = "(1 - hi / 2) * (1 + 2 / obs + 2 * sqrt(2 / obs))"


@query(
    "matrices_of_two",
    f"{_PAIR_OF}, x as ("
    + " union all ".join(
        [
            _two_cells("root_psd", "sqrt(lo)", "sqrt(hi)"),
            _two_cells("from_eigen", "lo", "hi"),
            _two_cells("eigenvalue_clean", "case when lo < 1.0 then greatest(0.25, lo) else lo end", "hi"),
            _two_cells("eigenvalue_clean_for", f"case when lo < {_THRESHOLD} then greatest({_THRESHOLD} / 4, lo) else lo end", "hi"),
            _two_cells("project_to_psd", "0.0", "2 + abs(c)", "1"),
            _two_cells("nearest_psd", "0.0", "2 + abs(c)", "1"),
            "select 'project_to_unit_diagonal', 1.0, c, true from e",
            "select 'is_psd', 1.0, c, true from e",
            "select 'is_psd_of_bad', 1.0, 1 + abs(c), false from e",
            "select 'is_correlation', 1.0, c, true from e",
            "select 'is_correlation_of_bad', 1.0, 1 + abs(c), false from e",
        ]
    )
    + f") select operator, {r('diagonal', 'diagonal')}, {r('other', 'other')}, holds from x",
)
def _(spark, sf):
    """Two assets, where every one of these has a closed form."""
    ticks = types(spark, sf)
    m = matrices.matrix_from_pairs(matrices.correlations_of(C.grid_covariance(ticks, hourly(ticks), ["click", "view"])), ["click", "view"], "cor")
    bad = np.array([[1.0, 1 + abs(m[0, 1])], [1 + abs(m[0, 1]), 1.0]])
    obs = ticks.df.count() / 5
    made = {
        "root_psd": linalg.root_psd(m),
        "from_eigen": linalg.from_eigen(*np.linalg.eigh(m)),
        "eigenvalue_clean": linalg.eigenvalue_clean(m, 1.0),
        "eigenvalue_clean_for": linalg.eigenvalue_clean_for(m, obs),
        "project_to_psd": linalg.project_to_psd(bad),
        "nearest_psd": linalg.nearest_psd(bad),
        "project_to_unit_diagonal": linalg.project_to_unit_diagonal(m * np.array([[3.0, 1.0], [1.0, 0.5]]), np.eye(2)),
    }
    rows = [(n, float(x[0, 0]), float(x[0, 1]), True) for n, x in made.items()]
    for name, holds in (("is_psd", linalg.is_psd), ("is_correlation", linalg.is_correlation)):
        rows += [(name, 1.0, float(m[0, 1]), bool(holds(m))), (f"{name}_of_bad", 1.0, float(bad[0, 1]), bool(holds(bad)))]
    return rounded(spark.createDataFrame(rows, "operator string, diagonal double, other double, holds boolean"))


@query(
    "unknown_model",
    f"with {TICKS}, n as (select distinct asset from ticks) select p.asset as asset1, q.asset as asset2, 'correlation' as variable, true as unknown from n p join n q on p.asset < q.asset "
    "union all select asset, asset, v, true from n, (select unnest(['volatility', 'drift', 'mean']) as v)",
)
def _(spark, sf):
    """What cannot be estimated is NaN everywhere."""
    names = [x.asset for x in types(spark, sf).df.select("asset").distinct().orderBy("asset").collect()]
    return matrices.CovarianceModel.unknown(names).to_frame(spark).select("asset1", "asset2", "variable", F.isnan("value").alias("unknown"))


_TRUTH = np.array([[1, 0.75, 0.5, 0], [0.75, 1, 0.5, 0.25], [0.5, 0.5, 1, 0.25], [0, 0.25, 0.25, 1]])
_MODEL = matrices.CovarianceModel(matrices.CovarianceMatrix(_TRUTH, [0.02, 0.03, 0.04, 0.05], ("BARC", "HSBC", "VODL", "RYAL"), Period("Day")), np.zeros(4), np.zeros(4))


@query("conditional_distribution")
def _(spark, sf):
    return rounded(_MODEL.conditional(["VODL", "HSBC", "RYAL"], [0.004, 0.002, 0.001], Period("Day")).to_frame(spark), 12)


@query("conditional_means", f"with {TICKS} select seq, {r('value * 0.01 * 0.75 * 0.02 / 0.03', 'BARC_mean', 9)} from ticks")
def _(spark, sf):
    pair = matrices.CovarianceModel(_MODEL.cm.rearrange(["BARC", "HSBC"]), np.zeros(2), np.zeros(2))
    rows = types(spark, sf).df.select("seq", (F.col("value") * 0.01).alias("HSBC"))
    return rounded(pair.conditional_means(rows, ["HSBC"], Period("Day")).select("seq", "BARC_mean"), 9)


@query("draws")
def _(spark, sf):
    return simulation.get_draws(spark, _MODEL, 10_000, antithetic=True)


@query("random_path")
def _(spark, sf):
    return simulation.random_path(spark, 4, 2_000, seed=2, correlation=_TRUTH, vols=[0.02, 0.03, 0.04, 0.05]).ticks.df


@query("cluster_order")
def _(spark, sf):
    cm = estimate.simple_covariance(types(spark, sf), ASSETS, spacing=HOUR)
    tree = clustering.cluster(cm.correlation)
    return spark.createDataFrame([(i, cm.labels[k]) for i, k in enumerate(tree.order)], "place int, asset string")


@query("heatmap", f"with {SAMPLED}, {_COR} select a, b, {r('cor', 'cor', 9)}, cast(cast(floor(round_even(cor, 2) * 100) as bigint) as varchar) || '%' as label from cor")
def _(spark, sf):
    return rounded(clustering.heatmap_rows(matrices.correlations_of(_cor(spark, sf))), 9)


@query("tick_lines", f"with {TICKS}, e as (select min(t) as lo, (max(t) - min(t)) / 200 as w from ticks) select asset, cast(floor((t - lo) / w) as bigint) as bin, min(t) as t, {r('avg(value)', 'value')} from ticks, e group by 1, 2")
def _(spark, sf):
    return rounded(clustering.tick_lines(types(spark, sf), 200))
