"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return _shared(current, sc.master)
    root = spark.conf.get(_CONF, None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {_CONF} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lucidgraph-")
    sc.setCheckpointDir(_shared(root, sc.master))
    return sc.getCheckpointDir()


def _shared(root: str, master: str) -> str:
    """``root``, unless a cluster would look for it on the local disk of each machine.

    A folder that is mounted everywhere is named with ``file://``; a bare path is not enough.
    """
    if not master.startswith("local") and ":" not in root:
        raise ValueError(f"{_CONF} = {root} is a local path; name a folder that all executors share")
    return root


class Steps:
    """Tables of an iteration, each written to the shared folder; the one before is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        if self.last:
            delete(self.spark, self.last)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that this package wrote, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """What is made and run inside gives back its shuffle files when it is over.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    Used where two branches must see the same rows (cut lines, chunk numbers)
    and between iterations; the copy outlives lost executors.
    """
    checkpoint_root(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        # a frame of its own, as the setting is read when a frame is made
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for tables of as many rows as the input: by columns, in a third of the space."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
