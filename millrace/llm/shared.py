"""Places and sizes that the operators share: the cluster's shared folder, partition counts, row fingerprints."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession


#: The folders made in this process that nothing has removed, oldest first.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir; a path without a scheme is one of the cluster's own file system.

    Where a session on one machine has no such setting (a test), a temporary folder
    becomes the checkpoint folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base}/{uuid.uuid4().hex}")
    made = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _MADE.append(made)
    return made


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made_so_far() -> list[str]:
    return _MADE.copy()


def saved_alone(df: DataFrame, before: list[str]) -> DataFrame:
    """saved(df), after which the folders made since before go: for a step whose result is all that is still read."""
    out, context = saved(df), df.sparkSession.sparkContext
    for name in [x for x in _MADE[:-1] if x not in before]:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(name)
    return out


def partitions_for(df: DataFrame, each: int) -> int:
    """A partition count for about each bytes of input, at least the session's own."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(ceil(size / each), 200_000) if size < 1 << 60 else own)
