"""Session settings used by the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lumenary", master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with AQE, Arrow and a UTC clock. On a cluster the submitter's settings win over these."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **extra,
    }
    return SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's own reader, so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
