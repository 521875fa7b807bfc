"""Tables written once to the cluster's shared folder and read back.

A written table cuts the lineage, keeps columnar pruning for every later
reader, and survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a fresh
    temporary folder. A cluster without the setting is refused, because its
    executors do not share a machine-local folder.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="cabinlift-")
    return _local_folders[application]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of a ``scratch`` block."""
    _paths.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


# What a query shuffled is deleted when it ends, not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Rows that are dealt by some columns already are joined by these and more where they are.
TOGETHER = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def tidy(spark: SparkSession, **more: str) -> Iterator[None]:
    """Queries that start inside the block leave no shuffle files behind; for those that run once."""
    settings = TIDY | more
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, name: str = "step", together: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the copy.

    With ``together`` a join takes rows that are dealt by a part of its keys as they lie.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with tidy(spark, **(TOGETHER if together else {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the copies made inside the block when it ends."""
    mark = len(_paths)
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        while len(_paths) > mark:
            path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
            path.getFileSystem(hadoop).delete(path, True)
