"""Shared storage for checkpoints, stream state and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"

# Temporary folders of local sessions that name none, by application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; any other session
    must name one, since executors on other machines could not read ours.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="labmesh-")
    return _local[context.applicationId]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one that is of no use any more."""
    if not path.startswith(f"{shared_folder(spark)}/"):
        raise ValueError("only scratch folders are removed")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
