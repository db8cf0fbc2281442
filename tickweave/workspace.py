"""Tables that cut lineage, kept in the folder that every executor can read.

The folder comes from ``spark.checkpoint.dir``.  Only where that setting is
missing and everything runs in one process (unit tests, a laptop) a temporary
folder of this process is set.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session; in local mode a private one if there is none."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickweave-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Rows of a counted table that one task writes at most, unless there are fewer tasks anyway.
FILE_ROWS = 100_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside, _before = threading.Lock(), 0, None
_made: set[str] = set()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here remove their shuffle files when they end."""
    global _inside, _before
    with _lock:
        if not _inside:
            _before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _inside += 1
    try:
        yield
    finally:
        with _lock:
            _inside -= 1
            if not _inside:
                spark.conf.set(_CLEANUP, _before)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; only such folders are ever deleted."""
    folder = f"{name}-{uuid.uuid4().hex}"
    _made.add(folder)
    return f"{shared_root(spark)}/{folder}"


def materialise(df: DataFrame, name: str, *, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    A lost executor costs no recomputation of what is above the cut, and a
    random or order-dependent column keeps one value for all later readers.
    The shuffle files above the cut are removed.

    ``rows`` is an upper bound of the rows, as counted by the caller: it bounds
    the tasks that write them, whatever the number of shuffle partitions.  In a
    local file system each file costs its executor three helper processes.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if rows is not None:
        written = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    else:
        written = df
    with shuffles_removed(spark):
        written.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote and nobody reads any more.

    Of a plan over several tables, all that this process wrote go; inputs never
    do, not even if they lie in the shared folder.
    """
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = shared_root(spark)
        inside = "/" + root.split(":", 1)[-1].strip("/") + "/"
        names = {f.split(inside, 1)[1].split("/", 1)[0] for f in table.inputFiles() if inside in f}
        for name in names & _made:
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            path.getFileSystem(conf).delete(path, True)
            _made.discard(name)
