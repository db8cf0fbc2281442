"""Connected components of an edge table by alternating large and small stars.

Each round hangs neighbours on the smallest vertex around them, first the
larger ones, then the smaller ones, until the edges are stars.  Rounds grow
with the logarithm of the longest chain.  Every round is a grouped minimum,
folded before its shuffle, and one join whose hot keys can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.workspace import drop_tables, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """Both stars of one round over distinct edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    small_least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(small_least, "u")
    linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def _print_of(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every vertex that an edge touches and that is not a component's smallest."""
    u, v = F.greatest(a, b), F.least(a, b)
    current = materialise(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    seen = _print_of(current)
    while seen[0]:
        following = materialise(_stars(current), "edges", rows=2 * seen[0])  # each star has no more edges than there were
        found = _print_of(following)
        drop_tables(current)
        current = following
        if found == seen:
            break
        seen = found
    return current.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
