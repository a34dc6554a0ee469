"""Shared scratch storage: how jobs cut lineage so that a lost executor never loses data.

Everything is written below the folder that the session names in
``spark.checkpoint.dir``.  Only when that setting is absent is a folder chosen
here: a temporary one for a ``local`` master (tests), else one in the warehouse,
which all machines of a cluster share.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_chosen: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.applicationId not in _chosen:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        _chosen[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="gristmill-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _chosen[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared storage; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the stored table, which has no lineage to recompute.

    Row groups are no larger than a split, as only one of the tasks that share a row group reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    df.write.option("parquet.block.size", min(split, 128 << 20)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gristmill_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is run inside goes to Python in batches of at most so many rows: memory on both sides grows with a batch of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*tables: DataFrame | str) -> None:
    """Remove stored tables that no later step reads."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_gristmill_path", None)
        for spark, made in [x for x in _made if x[1] == path]:
            remove(spark, made)
            _made.remove((spark, made))


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder, if it is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before
            return
