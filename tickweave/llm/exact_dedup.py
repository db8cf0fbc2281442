"""Exact deduplication over an extendible-hash index on shared files.

Every text has a 64-bit key, a hash of its normalised form.  The index maps the
leading bits of a key through a directory to a bucket.  A bucket with more
bytes than its capacity is split on the next bit, doubling the directory when
the bucket already uses all its bits.  The directory is planned from entries
and bytes per key prefix.  Buckets are files in the shared folder, and owner
tasks, each with whole buckets and so with ranges of keys, walk their entries
in key order: entries with one key form a chain, and texts of a chain are
compared byte by byte before they count as one.  What the owners find (which
row stays and how many share its text) is joined to the rows.

An entry holds its text only if another row has its key.  Copies are counted
and folded inside each scan task before anything is shuffled, so a text that
fills a third of the table reaches its owner as one entry per task.

Defined results: null counts as empty text, and all texts that are empty after
normalisation are one group; of equal texts the one with most code points and
then the smallest id stays, a null id last; rows repeated with one id are one
document each and share its fate; a text of any length is one entry; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.workspace import drop_tables, materialise, new_folder, shuffles_removed

#: Bytes of a bucket's entries; a larger corpus than MAX_BUCKETS of these has larger buckets.
BUCKET_BYTES = 1 << 20
MAX_BUCKETS = 1 << 14
#: Bytes of an entry besides its text.
ENTRY_BYTES = 64
#: Key bits by which the histogram grows when a directory needs more.
STEP_BITS = 6
MAX_BITS = 20
#: Directory cells that fit into an expression; a larger directory is joined.
LITERAL_CELLS = 1 << 12
#: Shared keys (8 bytes each) that are broadcast to the scan; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_LAST = 10**19  # above all ids
_STEP = 10**20
HEADS = "key long, digest string, norm binary, group_size long, keep_id long"
_HEAD_NAMES = ["key", "digest", "norm", "group_size", "keep_id"]


@dataclass(frozen=True)
class Directory:
    """depth bits of a key -> bucket; a bucket is (prefix, local depth)."""

    depth: int
    buckets: tuple[tuple[int, int], ...]

    def cells(self) -> list[int]:
        """Bucket number of each of the 2**depth directory cells."""
        out = [0] * (1 << self.depth)
        for number, (prefix, local) in enumerate(self.buckets):
            width = 1 << (self.depth - local)
            out[prefix * width : (prefix + 1) * width] = [number] * width
        return out


def key_prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("long") if bits else F.lit(0).cast("long")


def plan_directory(keys: DataFrame, capacity: int = BUCKET_BYTES, max_bits: int = MAX_BITS, weight: Column | None = None) -> Directory:
    """Splits overfull buckets until each weighs at most ``capacity`` or has a single row of ``keys``.

    The driver sees one count per occupied prefix, and deeper prefixes only of
    buckets that are still overfull, never keys.
    """
    done: list[tuple[int, int]] = []
    open_, bits = {(0, 0)}, 0
    sums = [F.count("*").alias("n"), F.sum(F.lit(1) if weight is None else weight).alias("w")]
    while open_:
        bits = min(bits + STEP_BITS, max_bits)
        held = keys
        if (0, 0) not in open_:
            local = next(iter(open_))[1]
            inside = keys.sparkSession.createDataFrame([(p,) for p, _ in open_], "open long")
            held = keys.join(F.broadcast(inside), key_prefix(F.col("key"), local) == F.col("open"), "left_semi")
        counts = {r.p: (r.n, r.w) for r in held.groupBy(key_prefix(F.col("key"), bits).alias("p")).agg(*sums).collect()}
        still: set[tuple[int, int]] = set()
        stack = list(open_)
        while stack:
            p, local = stack.pop()
            width = bits - local
            inner = [counts[c] for c in range(p << width, (p + 1) << width) if c in counts]
            rows, size = sum(n for n, _ in inner), sum(w for _, w in inner)
            if size <= capacity or rows < 2 or local == max_bits:
                done.append((p, local))
            elif local == bits:
                still.add((p, local))
            else:
                stack += [(2 * p, local + 1), (2 * p + 1, local + 1)]
        open_ = still
    depth = max(local for _, local in done)
    return Directory(depth, tuple(sorted(done, key=lambda b: b[0] << (depth - b[1]))))


def bucket_of(key: Column, directory: Directory) -> Column:
    """Bucket number of a key by an array of the directory's cells."""
    if len(directory.buckets) == 1:
        return F.lit(0).cast("long")
    cells = F.array(*[F.lit(c).cast("long") for c in directory.cells()])
    return F.element_at(cells, (key_prefix(key, directory.depth) + 1).cast("int"))


def with_bucket(df: DataFrame, directory: Directory) -> DataFrame:
    """``df`` with the bucket of its keys; a directory of many cells is a broadcast table of 2 ** MAX_BITS rows at most."""
    if 1 << directory.depth <= LITERAL_CELLS:
        return df.withColumn("bucket", bucket_of(F.col("key"), directory))
    cells = df.sparkSession.createDataFrame(list(enumerate(directory.cells())), "cell long, bucket long")
    return df.withColumn("cell", key_prefix(F.col("key"), directory.depth)).join(F.broadcast(cells), "cell").drop("cell")


def normalised(text: Column) -> Column:
    """The text without the six characters of ASCII white space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def rank_of(points: Column, doc_id: Column) -> Column:
    """A number that is largest for the row that stays: most code points, then the smallest id."""
    low = F.coalesce(F.lit(Decimal(_LAST)) - doc_id, F.lit(Decimal(0)))
    return (points.cast("decimal(12,0)") * F.lit(Decimal(_STEP)) + low).cast("decimal(38,0)")


def _id_of(rank: int) -> int | None:
    low = rank % _STEP
    return _LAST - low if low else None


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks entries sorted by key and gives each distinct text its head.

    An entry without text is alone with its key and passes as it is.  ``norm``
    is given only for texts that share key and digest with another text.
    Memory: the distinct texts of one key, nearly always one.
    """

    def heads(key: int, texts: dict) -> list[tuple]:
        seen: dict[str, int] = {}
        for digest, _ in texts:
            seen[digest] = seen.get(digest, 0) + 1
        return [(key, digest, text if seen[digest] > 1 else None, n, _id_of(rank)) for (digest, text), (n, rank) in texts.items()]

    current, texts = None, {}
    for batch in batches:
        alone = pc.is_null(batch.column("norm"))
        single = batch.filter(alone)
        yield pa.RecordBatch.from_arrays([single.column(c) for c in ("key", "digest", "norm", "n", "only")], _HEAD_NAMES)
        batch, rows = batch.filter(pc.invert(alone)), []
        for key, digest, text, n, rank in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "norm", "n", "rank")), strict=True):
            if key != current:
                if texts:
                    rows += heads(current, texts)
                current, texts = key, {}
            same = texts.get((digest, text), (0, 0))
            texts[digest, text] = same[0] + n, max(same[1], int(rank))
        yield _heads_batch(rows)
    if texts:
        yield _heads_batch(heads(current, texts))


def _heads_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _HEAD_NAMES)


def write_index(keyed: DataFrame, entries: DataFrame, capacity: int) -> tuple[str, DataFrame]:
    """Writes the index, a folder per bucket; returns its path and schema-bearing table.

    ``keyed`` has the rows with their normalised texts, ``entries`` the same rows without.
    """
    spark = entries.sparkSession
    size = F.lit(ENTRY_BYTES) + F.when(F.col("n") > 1, F.col("size")).otherwise(0)
    rank = rank_of(F.col("points"), F.col("doc_id"))
    keys = entries.groupBy("key").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("digest").alias("digest"), F.min("doc_id").alias("only"))
    keys = materialise(keys, "keys")
    total = keys.agg(F.sum(size)).first()[0] or 0
    directory = plan_directory(keys, max(capacity, total // MAX_BUCKETS), weight=size)

    # Only keys that several rows share need their bytes; each scan task sends a text once.
    shared = keys.where("n > 1").select("key")
    few = shared.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    bodies = keyed.join(F.broadcast(shared), "key", "left_semi") if few else keyed
    bodies = bodies.groupBy("key", "digest", "norm").agg(F.count("*").alias("n"), F.max(rank).alias("rank"))
    if not few:
        bodies = bodies.join(shared, "key", "left_semi")
    body = F.encode("norm", "UTF-8").alias("norm")
    none = F.lit(None)
    index = keys.where("n = 1").select("key", "digest", none.cast("binary").alias("norm"), "n", none.cast("decimal(38,0)").alias("rank"), "only")
    index = with_bucket(index.unionByName(bodies.select("key", "digest", body, "n", "rank", none.cast("long").alias("only"))), directory)
    path = new_folder(spark, "index")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owned = index.repartition(min(many, len(directory.buckets)), "bucket").sortWithinPartitions("bucket", "key")
    with shuffles_removed(spark):
        owned.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    drop_tables(keys)
    return path, spark.read.schema(index.schema).parquet(path)


def find_heads(index: DataFrame) -> DataFrame:
    """HEADS of an index: owner tasks read whole buckets in key order."""
    many = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = index.repartition(many, "bucket").sortWithinPartitions("bucket", "key")
    return owned.select("key", "digest", "norm", "n", "rank", "only").mapInArrow(chain, HEADS)


def exact_dedup(docs: DataFrame, *, capacity: int = BUCKET_BYTES, key_of: Callable[[Column], Column] | None = None, digest_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    ``key_of`` and ``digest_of`` replace the hashes of a normalised text (tests
    use weak ones to force chains and clashes).
    """
    key_of = key_of or (lambda norm: F.xxhash64(norm))
    digest_of = digest_of or (lambda norm: F.sha2(norm, 256))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), F.char_length(text).cast("long").alias("points"))
    keyed = base.withColumn("key", key_of(F.col("norm"))).withColumn("digest", digest_of(F.col("norm")))
    entries = materialise(keyed.select("doc_id", "points", "key", "digest", F.octet_length("norm").cast("long").alias("size")), "entries")

    path, index = write_index(keyed, entries, capacity)
    heads = materialise(find_heads(index), "heads")
    drop_tables(index)

    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    finish = lambda df: df.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumnRenamed("digest", "text_sha256").select(out)
    rows = entries.select("doc_id", "key", "digest")
    clashing = heads.where("norm is not null").select("key", "digest").distinct()
    if clashing.isEmpty():
        return finish(rows.join(heads.drop("norm"), ["key", "digest"]))
    # More texts than digests for a key: the digest is not to be trusted there.
    plain = finish(rows.join(heads.where("norm is null").drop("norm"), ["key", "digest"]))
    bad = keyed.join(clashing, ["key", "digest"], "left_semi").withColumn("norm", F.encode("norm", "UTF-8"))
    return plain.unionByName(finish(bad.join(heads.where("norm is not null"), ["key", "digest", "norm"])))
