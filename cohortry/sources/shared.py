"""The shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def _local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; `local-cluster` is a cluster."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def _on_one_machine(spark: SparkSession, folder: str) -> bool:
    """A path without a scheme on a local default file system. `file:` in front of a path says that
    the folder is mounted everywhere."""
    if "://" in folder or folder.startswith("file:"):
        return False
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).getScheme() == "file"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only a local session may fall back on a temporary folder: on a cluster executors could
    not see it, so the setting is required there and must name a folder that all of them see. Spark resolves a bare path
    when it starts. If that gives a local folder, nothing says whether it is mounted everywhere, so it is tried.
    """
    folder, resolved = spark.conf.get(_SETTING, None), spark.sparkContext.getCheckpointDir()
    if _local(spark):
        if not (folder or resolved):
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortry-"))
        return folder or spark.sparkContext.getCheckpointDir()
    if folder and not _on_one_machine(spark, folder):
        return folder
    if resolved and (not resolved.startswith("file:") or _seen_by_all(spark, resolved)):
        return resolved
    raise ValueError(f"set {_SETTING} to a folder all executors share, with its scheme")


_tried: dict[tuple[str, str], bool] = {}


def _seen_by_all(spark: SparkSession, folder: str) -> bool:
    """Whether what tasks write there is found again, tried once for each application: files that a task
    writes to a disk of its own are missed by the driver that commits them."""
    application = spark.sparkContext.applicationId, folder
    if application not in _tried:
        n, path = max(2, spark.sparkContext.defaultParallelism), f"{folder}/trial-{uuid.uuid4().hex}"
        spark.range(0, n, 1, n).write.parquet(path)
        _tried[application] = spark.read.schema("id bigint").parquet(path).count() == n
        delete_folder(spark, path)
    return _tried[application]


def use_checkpoints(spark: SparkSession) -> None:
    """Make `DataFrame.checkpoint()` usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = shared_folder(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)


_tables: dict[str, list[str]] = {}


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written table.

    For a small result that later steps read several times. Every call takes a new
    folder; the files stay until `remove_written` or until the shared folder is cleaned. With
    `partition_by` rows are gathered first, so that a partition gets few files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.partitionBy(*partition_by).parquet(path)
    remember_written(spark, path)
    return spark.read.schema(schema).parquet(path)


def remember_written(spark: SparkSession, path: str) -> None:
    """`remove_written` will delete the folder too."""
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)


def remove_written(spark: SparkSession) -> int:
    """Delete the tables that `written` has made in this application; returns their number.

    Frames that still depend on them cannot be read afterwards.
    """
    paths = _tables.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        delete_folder(spark, name)
    return len(paths)


def delete_folder(spark: SparkSession, name: str) -> None:
    """Delete a folder of this library's own, on whatever file system it is."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
