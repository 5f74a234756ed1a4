"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: dict[str, list[str]] = {}
_open = threading.local()  # the lists of the blocks of `temporary` that this thread is in
#: Spark (4.1 and later) deletes the shuffle files of an execution at its end; before, it leaves them until garbage is collected.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_sweeping: dict[int, list] = {}  # by session: how many threads are in `_swept`, and what SWEEP was before
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Only where it is unset and everything runs in one process (as in tests) a temporary folder takes its place, which goes
    with the process; on a cluster that is an error, as executors would write to disks that nothing else can read.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        path = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[context.applicationId] = f"file://{path}"
    return _own[context.applicationId]


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors.

    The table stays until `removed` is called: results that read it are computed later. The shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{what}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    for block in getattr(_open, "blocks", []):
        block.append(path)
    with _swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """SWEEP holds within the block; after the last thread's the session has what it had."""
    me = id(spark)
    with _lock:
        if me not in _sweeping:
            _sweeping[me] = [0, spark.conf.get(SWEEP, None)]
            spark.conf.set(SWEEP, "true")
        _sweeping[me][0] += 1
    try:
        yield
    finally:
        with _lock:
            _sweeping[me][0] -= 1
            if not _sweeping[me][0]:
                before = _sweeping.pop(me)[1]
                spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def removed(spark: SparkSession) -> int:
    """Deletes the tables that this application has written, once their results are no longer needed; their number."""
    return _deleted(spark, _paths.pop(spark.sparkContext.applicationId, []))


def _deleted(spark: SparkSession, paths: list[str]) -> int:
    context, gone = spark.sparkContext, 0
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True))
    return gone


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread writes within the block at its end: no result that reads them may go out of it. Spark
    deletes shuffle files when the driver's JVM finds that nothing refers to them, so that is asked to look."""
    blocks, own = _open.__dict__.setdefault("blocks", []), []
    blocks.append(own)
    try:
        yield
    finally:
        blocks[:] = [b for b in blocks if b is not own]
        still = _paths.get(spark.sparkContext.applicationId, [])
        mine = set(own) & set(still)
        still[:] = [p for p in still if p not in mine]
        _deleted(spark, sorted(mine))
        spark.sparkContext._jvm.System.gc()


def settled(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """make(), written like `written`; the tables that were written on the way are deleted."""
    with temporary(spark):
        out = written(make(), what)
        _open.blocks[-1].pop()  # the result itself
    return out
