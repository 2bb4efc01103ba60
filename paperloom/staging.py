"""Cutting lineage: a DataFrame is written once to the shared folder and read back.

The folder is the one the cluster names in ``spark.checkpoint.dir``; every executor must see it. Only where that is
unset (tests, a laptop) a folder of this machine is set. A written table costs one pass, whereas ``checkpoint()`` runs
its last stage twice, and it survives the loss of any executor. What is staged within ``scope`` is deleted when it ends,
everything else when the application does.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task of a range partitioning should get.
TASK_BYTES = 64 << 20
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/paperloom-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STAGED:
        atexit.register(_clear, 0)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clear(since: int) -> None:
    while len(_STAGED) > since:
        try:
            _delete(*_STAGED.pop())
        except Exception:  # the session is gone, and with it whoever could delete
            pass


def unstage(*frames: DataFrame) -> None:
    """Delete the tables behind staged frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            _delete(df.sparkSession, path)
            _STAGED[:] = [x for x in _STAGED if x[1] != path]
            df._staged_at = None


@contextmanager
def scope() -> Iterator[None]:
    """Everything staged inside is deleted at the end: results must be written or collected before."""
    since = len(_STAGED)
    try:
        yield
    finally:
        _clear(since)


def spread_of(df: DataFrame) -> int:
    """Partitions for a range partitioning of ``df``: those of the session, or more if what the plan reads has more than
    ``TASK_BYTES`` for each of them. Leaves of unknown size (rows made by a program) count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(-(-size // TASK_BYTES), 200_000))
