"""From raw postings to the stored ones: merging a run, upserts, postings that disappear, append-once sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary.storage import workspace

#: Cycles without a posting after which it is removed.
MISSED_CYCLES = 3


def merge_run(raw: DataFrame, order: str, arrays: tuple[str, ...]) -> DataFrame:
    """One row per (source_id, source_job_id) of a run: the first, with the arrays of all merged in order of first mention."""
    keys = ["source_id", "source_job_id"]
    rest = [c for c in raw.columns if c not in (*keys, *arrays, order)]

    def united(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(order, name)))
        return F.array_distinct(F.flatten(F.transform(rows, lambda x: x[name]))).alias(name)

    merged = raw.groupBy(*keys).agg(
        F.min_by(F.struct(order, *rest), order).alias("first"),
        F.count("*").alias("n_rows"),
        *map(united, arrays),
    )
    return merged.select(*keys, "first.*", *arrays, "n_rows")


def upsert(stored: DataFrame, seen: DataFrame, as_of: Column) -> DataFrame:
    """What a run makes of stored and seen postings: job_id, status, missed_cycles, last_seen_at, outcome.

    ``stored`` has job_id, status, missed_cycles and last_seen_at, ``seen`` job_id. A seen posting is
    touched: its counter starts again and a removed one is active again (REVIVED). One only seen is
    CREATED, one only stored stays as it is (KEPT).
    """
    both = stored.withColumn("known", F.lit(True)).join(seen.select("job_id").distinct().withColumn("seen", F.lit(True)), "job_id", "full")
    known, met = F.col("known").isNotNull(), F.col("seen").isNotNull()
    back = known & met & (F.col("status") == "REMOVED")
    return both.select(
        "job_id",
        F.when(~known | back, "ACTIVE").otherwise(F.col("status")).alias("status"),
        F.when(met, 0).otherwise(F.col("missed_cycles")).alias("missed_cycles"),
        F.when(met, as_of).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(~known, "CREATED").when(back, "REVIVED").when(met, "TOUCHED").otherwise("KEPT").alias("outcome"),
    )


def reconcile(stored: DataFrame, seen: DataFrame, covered_from: Column | None = None) -> DataFrame:
    """Active postings of a run's sources: missed ones count one cycle more and are removed at the third.

    Of an incomplete run only postings that it covered, posted since ``covered_from``, can be missed.
    """
    met = seen.select("job_id").distinct().withColumn("seen", F.lit(True))
    rows = stored.where("status = 'ACTIVE'").join(met, "job_id", "left")
    missed = F.col("seen").isNull() if covered_from is None else F.col("seen").isNull() & (F.col("posted_at") >= covered_from)
    n = F.when(F.col("seen").isNotNull(), 0).when(missed, F.col("missed_cycles") + 1).otherwise(F.col("missed_cycles"))
    return rows.select(*stored.columns, n.cast("int").alias("missed_now"), F.when(n >= MISSED_CYCLES, "REMOVED").otherwise("ACTIVE").alias("status_now"))


def missed_streaks(presence: DataFrame) -> DataFrame:
    """Per posting over a series of runs: cycles missed since it was last seen, its longest gap, and whether it was ever removed.

    ``presence`` has job_id, cycle and seen (boolean). Gaps and islands, in one window of a posting's runs.
    """
    order = Window.partitionBy("job_id").orderBy("cycle")
    islands = presence.select("job_id", "seen", F.sum(F.col("seen").cast("int")).over(order).alias("island"))
    gaps = islands.groupBy("job_id", "island").agg(F.count_if(~F.col("seen")).alias("gap"))
    out = gaps.groupBy("job_id").agg(F.max_by("gap", "island").alias("missed_now"), F.max("gap").alias("longest_gap"))
    return out.withColumn("was_removed", F.col("longest_gap") >= MISSED_CYCLES)


def append_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, each key once; appending these twice changes nothing."""
    return new.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def refresh(stored: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows after a recalculation: scored pairs with their new values, pairs without a score gone."""
    at = stored.select(*keys).distinct().withColumn("known", F.lit(True))
    return scored.join(at, keys, "left").withColumn("outcome", F.when(F.col("known").isNull(), "INSERTED").otherwise("UPDATED")).drop("known")


def replace_children(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children after those of every parent in ``new`` are replaced; other parents keep theirs."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def bucket_of(parent: str, buckets: int) -> Column:
    """The bucket of a parent's children."""
    return F.pmod(F.xxhash64(parent), F.lit(buckets)).cast("int")


def write_children(spark: SparkSession, path: str, new: DataFrame, parent: str, buckets: int = 64) -> None:
    """replace_children() on a stored table, partitioned by bucket of the parent: only buckets with a parent in ``new`` are read and written.

    ``new`` is written once to the shared folder, as is what the buckets become, so that no bucket is read
    while it is overwritten and a job that is run again ends in the same table.
    """
    with workspace(spark) as work:
        rows = work.table(new.withColumn("bucket", bucket_of(parent, buckets)))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        made = rows
        if root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(root):
            stored = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched))
            made = work.table(replace_children(stored.select(rows.columns), rows, parent))
        made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def newest_batch(jobs: DataFrame, n: int = 1000) -> DataFrame:
    """The ``n`` active postings that were first seen last, for a recalculation; ties go to the smaller id."""
    return jobs.where("status = 'ACTIVE'").orderBy(F.desc_nulls_last("first_seen_at"), "job_id").limit(n)
