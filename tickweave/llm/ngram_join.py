"""Set-similarity join on word n-grams by parity sketches.

A document is the set of its word shingles.  A parity sketch XORs every token
into one of B cells, so two sketches differ in at most as many cells as the
sets have tokens not in common: the cells' Hamming distance is a lower bound of
the symmetric difference.  Two sets of a size band that are similar enough
differ in at most k tokens, hence with B = k + 1 + e cells they agree in at
least 1 + e of them (pigeonhole), and documents that share no cell need not be
compared.  Pairs that share one are filtered by a second, bit-wise parity
sketch and then verified on the exact sets.

* Bands are powers of two, and documents near a power of two are also in a
  band around it, so every pair that can be similar meets in one band.
* A cell without tokens is the same for many documents.  A document with at
  most e such cells leaves them out (it still agrees with each partner in a
  cell with tokens); one with more keeps them, so nothing is lost.  A partner
  may lack up to e of the kept ones.
* Equal sets are one class; only its smallest id takes part in the join.
* Linked documents agree in all but k of their cells, so they agree in one of
  the k + 1 rarest of each (prefix filter), or k + 1 + e where empty cells are
  kept; the other cells are left out, and with them most of those that a large
  family of rather similar texts shares.
* Documents of a cell are not paired with each other but with the cell's
  smallest id.  After verification, components are formed; cells whose
  documents are all in one component are done.  In the others the bit sketches
  of documents of different components are compared, in blocks of bounded
  size.  Of pairs close enough to be linked a first pass gives a spanning
  forest of the components, one pair a link at most; only where that left pairs
  out a second pass gives those whose documents are still apart.  Components
  are therefore exact, and pairs of a large group are never listed.
* A bit sketch has at least as many bits as its set has tokens.  Sketches of
  different lengths are compared at the shorter: parities fold by XOR.

Defined results: a null or blank text has no shingles and is linked with
nothing; a text with fewer than n words is one shingle; rows repeated with one
id are one set; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm import arrowtext as A
from tickweave.llm.components import components
from tickweave.workspace import drop_tables, materialise

#: Ids up to this many (8 bytes each) are broadcast to filter rows in place; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Bits of a sketch at least.
BITS = 1024
#: Documents of a cell that are compared with each other in one task.
BLOCK = 1024

_U = np.uint64


@dataclass(frozen=True)
class Similarity:
    """Word n-grams are linked when den * intersection >= num * union."""

    n: int = 5
    num: int = 80
    den: int = 100

    def slack(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def bands(self, size: int) -> list[tuple[int, int]]:
        """(band, largest difference of its pairs) of a set of this size."""
        if size < 2:
            return []  # linked with equal sets only
        j = size.bit_length() - 1
        low, high = 1 << j, 1 << (j + 1)
        found = [(2 * j, self.slack(2 * (high - 1)))]
        for edge, k in ((low, 2 * j - 1), (high, 2 * j + 1)):
            largest = (edge - 1) * self.den // self.num
            if edge > 1 and size <= largest and size * self.den >= edge * self.num:
                found.append((k, self.slack(edge - 1 + largest)))
        return [(band, k) for band, k in found if k > 0]


def cell_keys(tokens: np.ndarray, sim: Similarity) -> list[tuple[np.ndarray, int]]:
    """For each band of a set: join keys, one per cell, and how many of the rarest a link must touch.

    Empty cells are left out where that is safe.
    """
    found = []
    for band, k in sim.bands(len(tokens)):
        spare = 3 + k // 16
        cells = k + 1 + spare
        seed = A.mix(np.array([band + 1], np.uint64))[0]
        place = ((A.mix(tokens + seed) >> _U(40)) * _U(cells)) >> _U(24)
        order = np.argsort(place, kind="stable")
        sorted_place = place[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_place[1:] != sorted_place[:-1])))
        value = np.bitwise_xor.reduceat(tokens[order], first)
        used = sorted_place[first]
        missed = min(k, sim.slack(len(tokens) + len(tokens) * sim.den // sim.num))  # largest linked set
        if cells - len(used) > spare:
            missed += spare  # agreed empty cells that the partner leaves out
            empty = np.setdiff1d(np.arange(cells, dtype=np.uint64), used)
            used, value = np.concatenate((used, empty)), np.concatenate((value, np.zeros(len(empty), np.uint64)))
        found.append((A.mix(value ^ A.mix(used + seed)), missed + 1))
    return found


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """A sketch in which each token flips one bit; a power of two of them, not fewer than tokens."""
    size = max(BITS, 1 << max(0, len(tokens) - 1).bit_length())
    flips = np.bincount((tokens & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with fewer words."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def shingles(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The shingle set of each text in the second column."""
    data, offsets = A.text_buffers(batch.column(1))
    for first, last in A.row_slices(offsets):
        words, at = A.hash_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        for i in range(last - first):
            yield A.shingle_set(words[at[i] : at[i + 1]], n)


def sketch(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n_shingles, print (of the set), keys and spare cells per band, and bits of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys, spare, bits = [], [], [], [], []
            for tokens in shingles(batch, sim.n):
                sizes.append(len(tokens))
                prints.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                found = cell_keys(tokens, sim)
                keys.append([k for k, _ in found])
                spare.append([limit - len(k) for k, limit in found])
                bits.append(parity_bits(tokens))
            flat = [k for row in keys for k in row]
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(k) for k in flat]), pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, np.uint64)]).view(np.int64)))
            words = np.concatenate([*bits, np.zeros(0, np.int64)])
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(row) for row in keys]), pa.int32()), inner),
                pa.array(spare, pa.list_(pa.int32())),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(b) for b in bits]), pa.int32()), pa.array(words)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print", "keys", "spare", "bits"])

    columns = "doc_id long, n_shingles long, print binary, keys array<array<bigint>>, spare array<int>, bits array<bigint>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, columns)


def keep_ids(df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a table of ids, in place if there are at most BROADCAST_IDS of them."""
    ids = ids.toDF(column)
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, column, how)


def verified(pairs: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (a, b) that are linked, by their exact sets."""
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted", rows=2 * pairs.count())

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingles(batch, sim.n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["id", "tokens"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((p, q))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                flags.append(sim.den * common >= sim.num * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(flags, pa.bool_()))

    texts = keep_ids(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", wanted, "left_semi")
    sets = texts.select("doc_id", "text").mapInArrow(sets_of, "id long, tokens binary").dropDuplicates(["id"])
    sets = materialise(sets, "sets", codec="lz4")
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    links = materialise(two.select("a", "b", "x", "y").mapInArrow(linked, "a long, b long"), "links")
    drop_tables(wanted, sets)
    return links


def close(pairs: DataFrame, sketches: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs whose sizes and parity bits allow a link."""
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")  # rows repeated with one id give repeated pairs
    sizes = (F.least("na", "nb") * sim.den >= F.greatest("na", "nb") * sim.num)
    xor = lambda x, y: x.bitwiseXOR(y)
    # Sizes of linked sets differ by less than a factor of two, so one fold will do.
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), xor)).otherwise(F.col(x))
    distance = F.aggregate(F.zip_with(fold("bitsa", "bitsb"), fold("bitsb", "bitsa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where(sizes & (distance <= F.floor((F.col("na") + F.col("nb")) * (sim.den - sim.num) / (sim.den + sim.num)))).select("a", "b").distinct()


def rarest(crowd: DataFrame) -> DataFrame:
    """The rows of (key, n, id, which, spare) that are among their document's k + 1 rarest cells of a band.

    Cells of one document only are not in ``crowd``; they come first in the
    order and are counted by what is missing from the document's cells.
    """
    own = Window.partitionBy("id", "which")
    ranked = crowd.withColumn("place", F.row_number().over(own.orderBy("n", "key"))).withColumn("many", F.count("*").over(own))
    return ranked.where(F.col("place") <= F.col("spare") + F.col("many")).select("key", "id")


def forest(left: np.ndarray, right: np.ndarray, comp: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the pairs to keep so that each two components they connect stay connected; closest first."""
    order = np.argsort(distance, kind="stable")
    lo, hi = np.minimum(comp[left], comp[right])[order], np.maximum(comp[left], comp[right])[order]
    _, first = np.unique(np.stack((lo, hi)), axis=1, return_index=True)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k in np.sort(first).tolist():
        x, y = find(int(lo[k])), find(int(hi[k]))
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(order[k])
    return np.array(kept, np.int64)


def close_across(inside: DataFrame, sketches: DataFrame, sim: Similarity, *, spanning: bool) -> DataFrame:
    """Pairs (a, b) of one cell but different components whose sizes and bits allow a link.

    A cell of many documents is cut into blocks; two blocks meet in one task,
    which compares bit sketches as arrays and returns only close pairs.  If
    ``spanning``, a forest of them, and a row of nulls where it left out some.
    """
    sizes = materialise(inside.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    rows = inside.join(sizes, "key").join(sketches.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bits"), "id")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "c", "n", "bits")
    many = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(many, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(group: list) -> tuple[list, list]:
        ids, comp, n, own = (np.array(x) for x in list(zip(*group, strict=True))[:4])
        words = min(len(g[4]) for g in group)
        bits = np.stack([folded(np.array(g[4], np.int64), words) for g in group]).view(np.uint64)
        left, right, apart = [], [], []
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            total = n[part, None] + n[None, :]
            ok = (comp[part, None] != comp[None, :]) & (ids[part, None] < ids[None, :])
            ok &= np.minimum(n[part, None], n[None, :]) * sim.den >= np.maximum(n[part, None], n[None, :]) * sim.num
            if own.min() != own.max():
                ok &= own[part, None] != own[None, :]
            if ok.any():
                i, j = np.nonzero(ok)
                distance = np.bitwise_count(bits[part][i] ^ bits[j]).sum(axis=1)
                near = distance * (sim.den + sim.num) <= total[i, j] * (sim.den - sim.num)
                left.append(i[near] + at)
                right.append(j[near])
                apart.append(distance[near] / total[i, j][near])
        if not left:
            return [], []
        x, y = np.concatenate(left), np.concatenate(right)
        if not spanning or not len(x):
            return ids[x].tolist(), ids[y].tolist()
        kept = forest(x, y, comp, np.concatenate(apart))
        more = [None] if len(kept) < len(x) else []
        return ids[x[kept]].tolist() + more, ids[y[kept]].tolist() + more

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(group: list) -> pa.RecordBatch:
            left, right = compare(group)
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        current, group = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "lo", "hi", "id", "c", "n", "own", "bits"))
            for key, lo, hi, *row in zip(*columns, strict=True):
                if (key, lo, hi) != current:
                    if len(group) > 1:
                        yield answer(group)
                    current, group = (key, lo, hi), []
                group.append(row)
        if len(group) > 1:
            yield answer(group)

    return grouped.mapInArrow(work, "a long, b long").distinct()


def ngram_components(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id of every row; components of the links of ``sim``."""
    sketches = materialise(sketch(docs, sim), "sketches")
    # Small tables are written before they are joined: with a plain exchange on both sides hot keys can be split.
    many = sketches.count()
    classes = materialise(sketches.where("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("rep")), "classes", rows=many)
    members = sketches.select("doc_id", "n_shingles", "print").join(classes, "print", "left")
    members = materialise(members.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members", rows=many)

    copies = members.where("doc_id <> rep").select("doc_id").distinct()
    heads_only = keep_ids(sketches.select("doc_id", "keys", "spare"), "doc_id", copies, "left_anti")
    bands = heads_only.select(F.col("doc_id").alias("id"), "spare", F.posexplode("keys").alias("which", "band"))
    cells = bands.select("id", "which", F.get("spare", F.col("which")).alias("spare"), F.explode("band").alias("key"))
    shared = materialise(cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    crowd = materialise(cells.join(shared, "key").select("key", "n", "id", "which", "spare").distinct(), "crowd")
    drop_tables(shared)
    rare = materialise(rarest(crowd), "rarest", rows=crowd.count())
    cells_left = rare.count()
    heads = materialise(rare.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1").select("key", "head"), "heads", rows=cells_left)
    drop_tables(crowd, classes)
    crowd = materialise(rare.join(heads, "key"), "crowd", rows=cells_left)
    drop_tables(rare, heads)
    slim = sketches.select("doc_id", "n_shingles", "bits")

    stars = crowd.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    near = materialise(close(stars, slim, sim), "close")
    links = verified(near, docs, sim)
    found = components(links)
    drop_tables(near)

    # What the stars leave open: cells that hold more than one component.
    for spanning in (True, False):
        placed = materialise(crowd.join(found, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("c")), "placed", rows=cells_left)
        mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        mixed = materialise(mixed, "mixed", rows=cells_left)
        rest = materialise(close_across(placed.join(mixed, "key"), slim, sim, spanning=spanning), "rest")
        pairs, left_out = rest.where("a is not null"), not rest.where("a is null").isEmpty()
        if not pairs.isEmpty():
            more = verified(pairs, docs, sim)
            both = materialise(links.unionByName(more), "links")
            drop_tables(links, more, found)
            links, found = both, components(both)
        drop_tables(placed, mixed, rest)
        if not left_out:
            break
    drop_tables(sketches, crowd, links)
    final = members.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return final.select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
