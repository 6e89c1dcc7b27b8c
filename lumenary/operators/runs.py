"""Source runs: streaks, latest runs, due sources, fallbacks, roll-ups and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.operators.committed import CommittedBatches

#: Failures from which a source is left alone for a while, and the longest such time in hours.
BACKOFF_FROM, BACKOFF_MOST_HOURS = 3, 24
#: Mean description quality and share of failed link checks that two runs in a row must miss for an alert.
LEAST_QUALITY, MOST_LINK_FAILURES = 60, 0.2


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Per source: failures since its last success, its longest streak, and the wait that calls for in hours.

    ``runs`` has source_id, run_id, started_at, status. Gaps and islands: the island of a run is the
    number of successes before it; a source's runs are in one window, which one source bounds.
    """
    order = Window.partitionBy("source_id").orderBy("started_at", "run_id")
    ok = (F.col("status") == "OK").cast("int")
    islands = runs.select("source_id", "run_id", "status", F.sum(ok).over(order).alias("island"))
    lengths = islands.groupBy("source_id", "island").agg(F.count_if(F.col("status") == "FAIL").alias("fails"))
    out = lengths.groupBy("source_id").agg(F.max("fails").alias("longest_streak"), F.max_by("fails", "island").alias("current_streak"))
    return out.withColumn("backoff_hours", backoff_hours(F.col("current_streak")))


def backoff_hours(failures: Column) -> Column:
    """Hours to leave a source alone: 2 to the power of the failures beyond the third, a day at most."""
    wait = F.least(F.pow(F.lit(2.0), failures - BACKOFF_FROM), F.lit(float(BACKOFF_MOST_HOURS)))
    return F.when(failures >= BACKOFF_FROM, wait).otherwise(F.lit(0.0))


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, as columns; ties go to the larger ``tie``. Combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(key, "r.*")


def due_sources(sources: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Sources never run, or last run at least their frequency ago; in no order."""
    last = runs.groupBy("source_id").agg(F.max("started_at").alias("last_run"))
    waited = F.timestamp_diff("MINUTE", "last_run", as_of)
    return sources.join(last, "source_id", "left").where(F.col("last_run").isNull() | (waited >= F.col("frequency_min")))


def due_deep(sources: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Sources with a time for deep collection (deep_every_min) whose last deep run, failed or not, is that long ago, or that had none."""
    last = runs.where("mode = 'DEEP'").groupBy("source_id").agg(F.max("started_at").alias("last_deep"))
    waited = F.timestamp_diff("MINUTE", "last_deep", as_of)
    return sources.where("deep_every_min > 0").join(last, "source_id", "left").where(F.col("last_deep").isNull() | (waited >= F.col("deep_every_min")))


def queue_order(due: DataFrame, ranks: dict[str, int], last_rank: int) -> DataFrame:
    """Due sources with the ``queue_rank`` of their tier, as they are worked on: by rank, then by id."""
    rank = F.coalesce(*(F.when(F.col("tier") == t, n) for t, n in ranks.items()), F.lit(last_rank))
    return due.withColumn("queue_rank", rank).orderBy("queue_rank", "source_id")


def run_rollup(runs: DataFrame) -> DataFrame:
    """Counters over the runs of a source and mode."""
    return runs.groupBy("source_id", "mode").agg(
        F.count("*").alias("n_runs"),
        F.count_if(F.col("status") == "FAIL").alias("n_failed"),
        F.sum("jobs_fetched").alias("jobs_fetched"),
        F.sum("link_checks").alias("link_checks"),
        F.sum("link_failures").alias("link_failures"),
        F.round(F.avg("quality"), 6).alias("avg_quality"),
        F.count_if(F.col("quality") < LEAST_QUALITY).alias("n_low_quality"),
    )


def quality_alerts(runs: DataFrame) -> DataFrame:
    """Runs that, like the one before them, had low quality or many dead links."""
    order = Window.partitionBy("source_id").orderBy("started_at", "run_id")
    low = F.col("quality") < LEAST_QUALITY
    dead = (F.col("link_checks") > 0) & (F.col("link_failures") > MOST_LINK_FAILURES * F.col("link_checks"))
    marked = runs.select("source_id", "run_id", low.alias("low"), dead.alias("dead"), F.lag(low, 1, False).over(order).alias("low_before"), F.lag(dead, 1, False).over(order).alias("dead_before"))
    alerts = marked.select("source_id", "run_id", (F.col("low") & F.col("low_before")).alias("quality_alert"), (F.col("dead") & F.col("dead_before")).alias("link_alert"))
    return alerts.where("quality_alert OR link_alert")


def fallback_choice(health: DataFrame, chain: DataFrame) -> DataFrame:
    """For each source the first of its ordered alternates that is not disabled, itself first.

    ``chain`` has source_id, step (0 is the source itself) and alternate; ``health`` has source_id and
    disabled. A source without a usable alternate gets null.
    """
    state = health.select(F.col("source_id").alias("alternate"), F.col("disabled").alias("alternate_disabled"), "health")
    usable = F.col("alternate_disabled").isNotNull() & ~F.col("alternate_disabled")
    return (
        chain.join(state, "alternate", "left")
        .groupBy("source_id")
        .agg(F.min_by(F.when(usable, F.col("alternate")), F.when(usable, F.col("step"))).alias("chosen"), F.min(F.when(usable, F.col("step"))).alias("step"))
    )


def newest(rows: DataFrame, n: int, key: str, at: str, tie: str) -> DataFrame:
    """The ``n`` newest rows of each key, with their ``recency`` from 1.

    Spark limits each group before the shuffle too, so a hot key sends ``n`` rows a task.
    """
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


RUNS = T.StructType().add("run_id", "long").add("source_id", "string").add("started_at", "timestamp_ntz").add("status", "string").add("mode", "string")
CATEGORIES = T.StructType().add("run_id", "long").add("source_id", "string").add("category", "string").add("pages_fetched", "long").add("jobs_fetched", "long").add("errors", "long").add("stopped_reason", "string")
TOTALS = ("pages_fetched", "jobs_fetched", "errors")


def with_totals(runs: DataFrame, categories: DataFrame) -> DataFrame:
    """Runs with what their categories add up to: pages_fetched, jobs_fetched, errors, categories_searched; zeros for a run without any."""
    sums = categories.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in TOTALS), F.count("*").alias("categories_searched"))
    names = (*TOTALS, "categories_searched")
    return runs.drop(*names).join(sums, "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def run_log(spark: SparkSession, root: str) -> CommittedBatches:
    """Runs and their category rows, appended as one: neither is seen without the other."""
    parent = T.StructType(RUNS.fields)
    for c in (*TOTALS, "categories_searched"):
        parent = parent.add(c, "long")
    return CommittedBatches(spark, root, {"runs": parent, "categories": CATEGORIES})


def log_runs(log: CommittedBatches, batch: int, runs: DataFrame, categories: DataFrame) -> bool:
    """Append the runs of a collection cycle with their category rows; category rows of other runs are left out, and a cycle that is logged already adds nothing."""
    own = categories.join(runs.select("run_id"), "run_id", "left_semi")
    return log.commit(batch, {"runs": with_totals(runs, own), "categories": own})


def coverage(sources: DataFrame, runs: DataFrame, categories: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each source with its active postings, its latest deep run and a row for each category of that; one row with nulls where there is none."""
    active = jobs.groupBy("source_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("active_jobs"))
    deep = latest(runs.where("mode = 'DEEP'").select("source_id", "run_id", "started_at"), "source_id", "started_at", "run_id").withColumnRenamed("started_at", "last_deep")
    rows = sources.select("source_id").join(active, "source_id", "left").join(deep, "source_id", "left").join(categories.drop("source_id"), "run_id", "left")
    return rows.select("source_id", F.coalesce("active_jobs", F.lit(0)).alias("active_jobs"), "last_deep", "category", *TOTALS, "stopped_reason")
