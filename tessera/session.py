"""A session with the settings the library expects, and where shared files go."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster, use the cluster's own session."""
    return (
        SparkSession.builder.master(master)
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in ``spark.checkpoint.dir`` or, by
    ``setCheckpointDir``, in the context. Only on one machine (a local master) is one made where
    neither names any; on a cluster that is an error, as its machines share no folder of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; ``cleanup`` removes it unless it is to be kept."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _written.append(path)
    return path


#: Intermediate paths of this driver that have not been removed yet.
_written: list[str] = []


def cleanup(spark: SparkSession, since: int = 0) -> int:
    """Removes the intermediate tables written so far (from the ``since``-th on); call it when the
    results that read them are written or no longer needed. Returns how many there were."""
    n = len(_written) - since
    while len(_written) > since:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it results are computed and written; at its end their intermediate tables go."""
    mark = len(_written)
    try:
        yield
    finally:
        cleanup(spark, mark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
