"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark setting by which the shuffle files of a query go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it. Only a local session may do without: driver and executors are one process there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "lumenary-checkpoints")
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    This cuts the lineage: a lost executor costs a re-read of Parquet, never a re-run of
    what made it, and unlike checkpoint() the columns stay compressed and prunable. The
    shuffle files of the write go with it. discard() deletes the table; one that a returned
    DataFrame reads stays until the folder's owner clears it, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenary_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete durable() tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lumenary_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
