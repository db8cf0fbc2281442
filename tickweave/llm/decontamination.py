"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if the document has at least 80 % of
the item's distinct five-word shingles.  Documents are partitioned by their
number of shingles: a partition of documents with up to U has a signature of
U * 2 ** extra bins, and a document keeps the least hash of each bin (MinHash
with one permutation, so that one sort of a document's hashes gives them all).
Bins grow with the partition, so a shared shingle is kept with the same chance
p in short and in long documents.  Of an item of q shingles at least 0.8 q are
shared, so ``extra`` is the least for which the shortest items are found but
for a chance of ``miss``, and each band of item sizes has its own threshold:
the number of an item's shingles that must be among a document's bin minima is
the largest that a contained item reaches but for a chance of ``miss``.
Candidates are verified by exact containment over all their shingles.

The shorter the items, the denser the signatures must be; with ``miss=0`` they
hold every shingle, and the search is exact by construction.

Everything is DataFrame operations.  Items' shingles (two longs a row) and
candidates' ids are broadcast only if there are at most BROADCAST_ROWS of
them, and joined by a shuffle otherwise.

Defined results: words are maximal runs of letters and digits in lower case; a
null text has none; items of fewer than five words have no shingle and are
never reported; of rows repeated with one id the shingles are united; a text of
any length is one document; a null id is never reported; empty tables give no
pairs; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.workspace import drop_tables, materialise

WORDS = 5
CONTAINMENT = 0.8
#: Accepted chance that a contained item is no candidate, for each of the two thresholds.
MISS = 1e-6
#: Bits of a hash; bins this fine hold one shingle each.
BITS = 64
BROADCAST_ROWS = 1_000_000


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(df: DataFrame, key: str, n: int = WORDS) -> DataFrame:
    """(key, hashes): hashes of all n-word shingles of each row, in order."""

    def windows(w: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, all_).otherwise(F.array().cast("array<bigint>"))

    # The word list is bound to a variable: named twice it would be split anew for each shingle.
    hashes = F.transform(F.array(word_list(F.col("text"))), windows)
    return df.select(F.col(key).cast("long").alias(key), F.get(hashes, F.lit(0)).alias("hashes"))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count shows that it is small enough; for rows of a few numbers only."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kept_chance(extra: int) -> float:
    """Chance that a shingle is the least of its bin, with 2 ** extra bins for each of the document's shingles at least."""
    load = 2.0**-extra
    return (1 - math.exp(-load)) / load if load > 1e-9 else 1.0


def tail(n: int, p: float, least: int) -> float:
    """Chance that fewer than ``least`` of n independent events of chance p happen."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))


def extra_bits(shared: int, miss: float) -> int:
    """The least bins a shingle, as a power of two, for which one of ``shared`` shingles is kept but for ``miss``."""
    for extra in range(-8, BITS):
        if (1 - kept_chance(extra)) ** shared <= miss:
            return extra
    return BITS


def hits_needed(shared: int, extra: int, miss: float) -> int:
    """The largest number of kept shingles that ``shared`` ones reach but for ``miss``."""
    n, p, needed = min(shared, 512), kept_chance(extra), 1  # a part of very many shared ones will do
    while needed < n and tail(n, p, needed + 1) <= miss:
        needed += 1
    return needed


def signature(hashes: Column, extra: int) -> Column:
    """The bin minima of a document's hashes; its partition is the next power of two above their number."""

    def minima(a: Column) -> Column:
        size = F.greatest(F.size(a), F.lit(1)).cast("double")
        bits = F.greatest(F.least(F.ceil(F.log2(size)).cast("int") + extra, F.lit(BITS)), F.lit(1))
        bin_of = lambda h, drop: F.call_function("shiftrightunsigned", h, drop)
        first = lambda drop: F.filter(a, lambda h, i: (i == 0) | (bin_of(h, drop) != bin_of(F.get(a, i - 1), drop)))
        return F.get(F.transform(F.array(BITS - bits), first), F.lit(0))

    # Values used by a lambda are bound by an array of one, or they would be computed anew for each element.
    return F.get(F.transform(F.array(F.sort_array(hashes)), minima), F.lit(0))


def item_shingles(items: DataFrame, n: int = WORDS) -> DataFrame:
    """(item_id, q, h): a row per distinct shingle of each item, q of them."""
    rows = shingle_hashes(items, "item_id", n).select("item_id", F.explode("hashes").alias("h")).where("item_id is not null").distinct()
    return rows.join(rows.groupBy("item_id").agg(F.count("*").alias("q")), "item_id").select("item_id", "q", "h")


def candidates(docs: DataFrame, probes: DataFrame, *, containment: float = CONTAINMENT, n: int = WORDS, miss: float = MISS) -> DataFrame:
    """(doc_id, item_id, q) of the pairs whose signatures say that the item may be contained."""
    band = F.floor(F.log2("q")).cast("int")
    bands = [r[0] for r in probes.select(band).distinct().collect()]  # a row per power of two
    shared = {b: max(1, math.ceil(containment * 2**b - 1e-9)) for b in sorted(bands)}
    extra = extra_bits(min(shared.values(), default=1), miss) if miss > 0 else BITS
    least = {b: hits_needed(c, extra, miss) if miss > 0 else c for b, c in shared.items()}
    needed = F.element_at(F.create_map(*[F.lit(x) for pair in (least or {0: 1}).items() for x in pair]), band)
    kept = shingle_hashes(docs, "doc_id", n).where("doc_id is not null").select("doc_id", F.explode(signature(F.col("hashes"), extra)).alias("h"))
    hits = kept.join(bounded(probes), "h").select("doc_id", "item_id", "q", "h").distinct()
    return hits.groupBy("doc_id", "item_id", "q").agg(F.count("*").alias("hits")).where(F.col("hits") >= needed).select("doc_id", "item_id", "q")


def contained_items(docs: DataFrame, items: DataFrame, *, containment: float = CONTAINMENT, n: int = WORDS, miss: float = MISS) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every contained item."""
    probes = materialise(item_shingles(items, n), "probes")
    pairs = materialise(candidates(docs, probes, containment=containment, n=n, miss=miss), "pairs")

    # Exact containment of the candidates: all shingles of their documents, each counted once.
    found = bounded(pairs.select("doc_id").distinct())
    whole = shingle_hashes(docs.where(F.col("text").isNotNull()).join(found, docs["doc_id"].cast("long") == found["doc_id"], "left_semi"), "doc_id", n)
    both = whole.select("doc_id", F.explode("hashes").alias("h")).join(bounded(probes), "h").select("doc_id", "item_id", "h").distinct()
    counted = both.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    counted = counted.join(bounded(pairs), ["doc_id", "item_id"]).where(F.col("n_shared") >= F.col("q") * containment)
    counted = materialise(counted.select("doc_id", "item_id", F.col("q").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment")), "contained")
    drop_tables(probes, pairs)
    return counted


def decontaminate(docs: DataFrame, items: DataFrame, *, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    bad = contained_items(docs, items, containment=containment, miss=miss).select("doc_id").distinct()
    return docs.alias("all").join(bad.alias("bad"), F.col("all.doc_id").cast("long") == F.col("bad.doc_id"), "left_anti")


ORACLE_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
b as (
  select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
ds as (
  select distinct doc_id, array_to_string(w[i:i+4], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from d where len(w) >= 5)),
bs as (
  select distinct item_id, array_to_string(w[i:i+4], ' ') as s
  from (select item_id, w, unnest(generate_series(1, len(w) - 4)) as i from b where len(w) >= 5)),
q as (select item_id, count(*) as n_item from bs group by item_id),
c as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment
from c join q using (item_id) where n_shared >= 0.8 * n_item
"""
