"""Health of a source over its most recent runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Runs that count towards health.
HEALTH_RUNS = 10


def source_health(runs: DataFrame, last_n: int = HEALTH_RUNS) -> DataFrame:
    """Share of OK runs among each source's latest ``last_n``, in whole percent.

    ``runs`` has source_id, run_id, started_at and status. A source is disabled only
    when it has a full set of runs and not one of them succeeded.
    """
    newest = Window.partitionBy("source_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    recent = runs.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last_n)
    per_source = recent.groupBy("source_id").agg(
        F.count("*").alias("n_runs"),
        F.count_if(F.col("status") == "OK").alias("n_ok"),
    )
    return per_source.select(
        "source_id",
        "n_runs",
        "n_ok",
        F.floor(F.col("n_ok") * 100.0 / F.col("n_runs") + 0.5).cast("long").alias("health"),
        ((F.col("n_runs") >= last_n) & (F.col("n_ok") == 0)).alias("disabled"),
    )
