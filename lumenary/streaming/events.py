"""Transformations that run alike on a batch and on a stream, and sinks that may be run again.

A stream has no place for the reference time of a query, so everything here takes event time from a
column. Watermarks are additions: nothing upstream defines lateness, so the caller states it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenary.streaming.streaks import streaks


def rate_windows(events: DataFrame, most: int, minutes: int = 10, late: str | None = None) -> DataFrame:
    """Events of each user in tumbling windows, and whether they are more than ``most``."""
    if late is not None:
        events = events.withWatermark("ts", late)
    counts = events.groupBy("user_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n_events"))
    return counts.select("user_id", F.col("w.start").alias("window_start"), "n_events", (F.col("n_events") > most).alias("limited"))


def event_counts(events: DataFrame) -> DataFrame:
    """Events by type; on a stream, bounded state of one row per type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n_events"))


def first_delivery(events: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """The first of the events with a key within a time; state is dropped once the watermark has passed it."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def failure_streaks(runs: DataFrame, late: str) -> DataFrame:
    """Failures in a row of each source: (source_id, streak, longest) after each batch, of runs (source_id, run_id, started_at, status) in any order."""
    rows = runs.select(F.col("source_id").alias("key"), F.col("run_id").alias("id"), F.col("started_at").cast("timestamp").alias("at"), (F.col("status") == "FAIL").alias("failed"))
    return streaks(rows, late).withColumnRenamed("key", "source_id")


def sliding_digest(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events and their summed value of each user in the 24 hours before every full hour: (user_id, upto, n_events, total).

    On a stream ``late`` says how late events may be: an addition, as nothing upstream defines it. An hour is
    given out once it cannot change any more.
    """
    if late is not None:
        events = events.withWatermark("ts", late)
    sums = events.groupBy("user_id", F.window("ts", "24 hours", "1 hour").alias("w")).agg(F.count("*").alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return sums.select("user_id", F.col("w.end").cast("timestamp_ntz").alias("upto"), "n_events", "total")


def read_folder(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what has arrived and stop; the checkpoint remembers what has been processed, so another run takes only what is new."""
    stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def append_once(path: str, keys: list[str], day: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that appends rows with new keys to a table by day; a batch that is run again adds nothing.

    ``day`` is a date column that is decided by the keys, so that a row has been stored on its own
    day or not at all: only the days of a batch are read. A batch writes partitions of its own,
    over those of an attempt that failed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        days = [r[0] for r in new.select(F.col(day).cast("string")).distinct().collect()]
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        if root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(root):
            stored = spark.read.schema(f"{batch.select(*keys).schema.toDDL()}, _day string, _batch long").parquet(path)
            before = stored.where(F.col("_day").isin(days) & (F.col("_batch") != batch_id)).select(*keys)
            new = new.join(before, keys, "left_anti")
        rows = new.withColumns({"_day": F.col(day).cast("string"), "_batch": F.lit(batch_id)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day", "_batch").parquet(path)

    return write
