"""Cross-site line deduplication by the spread of a line over distinct sites.

Every line of at least ``min_chars`` characters is hashed, and a HyperLogLog
sketch of the sites it occurs on is aggregated per hash.  Sketches merge, so a
line that occurs in a third of all documents is folded in each scan task.  An
estimate well off the threshold decides; lines near it get an exact distinct
count.  A document then loses the lines that occur on ``min_sites`` sites or
more, and keeps all others in their order.

Everything is DataFrame operations; hash tables of lines are broadcast only up
to a counted size.

Defined results: lines end at \\n and are compared without surrounding spaces; a
null text has no line and an empty one a single empty line; a null site is a
site of its own; repeated rows count as often as they occur and their spread
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.decontamination import bounded
from tickweave.workspace import materialise

MIN_SITES = 10
MIN_CHARS = 20
LG_K = 12
#: Relative and absolute width of the zone around the threshold that is counted exactly.
ZONE, ZONE_SITES = 0.1, 1


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def split_lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes h of lines that occur on at least ``min_sites`` distinct sites, from rows (h, site)."""
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    low, high = min_sites * (1 - ZONE) - ZONE_SITES, min_sites * (1 + ZONE) + ZONE_SITES
    spread = materialise(spread.where(F.col("sites") >= low), "spread")
    near = spread.where(F.col("sites") < high).select("h")
    exact = lines.join(bounded(near), "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("sites"))
    return spread.where(F.col("sites") >= high).select("h").unionByName(exact.where(F.col("sites") >= min_sites).select("h"))


def drop_common_lines(docs: DataFrame, *, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every row."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), text.alias("text"))
    lines = rows.select("doc_id", "site", F.explode(split_lines(F.col("text"))).alias("line")).where(F.length(F.trim("line")) >= min_chars)
    lines = lines.select("doc_id", "site", line_hash(F.col("line")).alias("h"))
    common = materialise(boilerplate(lines.select("h", "site"), min_sites), "common")
    hits = lines.select("doc_id", "h").join(bounded(common), "h").groupBy("doc_id").agg(F.collect_set("h").alias("gone")).withColumnRenamed("doc_id", "_id")
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("all", split_lines(F.col("text")))
    stays = lambda line: ~(F.coalesce(F.array_contains(F.col("gone"), line_hash(line)), F.lit(False)) & (F.length(F.trim(line)) >= min_chars))
    kept = joined.withColumn("kept", F.when(F.col("gone").isNull(), F.col("all")).otherwise(F.filter("all", stays)))
    return kept.select(
        "doc_id",
        F.size("all").cast("long").alias("n_lines"),
        (F.size("all") - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("text"),
    )


ORACLE_SQL = f"""
with l as (
  select doc_id, coalesce(source, '') as site, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as k
  from documents where text is not null),
c as (
  select trim(line) as t from l where length(trim(line)) >= {MIN_CHARS}
  group by 1 having count(distinct site) >= {MIN_SITES}),
m as (select doc_id, line, k, trim(line) in (select t from c) as gone from l),
s as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
         coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '') as text
  from m group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(s.text, '') as text
from documents d left join s using (doc_id)
"""
