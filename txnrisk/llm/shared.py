"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, the session has no checkpoint folder and all executors are on this machine, a temporary one is taken.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


#: Rows of a written table up to which it is broadcast; beyond that the join shuffles.
FEW = 1_000_000


def broadcast_few(table: DataFrame) -> DataFrame:
    """``table`` (a written one, of narrow rows) hinted as a broadcast, if it has at most ``FEW`` rows."""
    return F.broadcast(table) if table.count() <= FEW else table


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into a table in the shared folder, and read from there: a lost executor loses none of it, and later
    readers take only the columns they need. The folder goes when the session ends."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(folder)
    table.folder = folder  # for forget()
    return table
