"""What time does to postings, users and applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary import dims

#: Days after which a user is dormant, removed postings are archived, messages are purged.
DORMANT_DAYS, ARCHIVE_DAYS, PURGE_DAYS, FOLLOW_UP_DAYS = 30, 60, 90, 7


def days_before(as_of: Column, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(-days), as_of)


def expire(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Active postings past their deadline become EXPIRED, ones missed three times REMOVED."""
    active = F.col("status") == "ACTIVE"
    now = F.when(active & (F.col("deadline") < as_of), "EXPIRED").when(active & (F.col("missed_cycles") >= 3), "REMOVED").otherwise(F.col("status"))
    return jobs.withColumn("status", now)


def archive(jobs: DataFrame, applications: DataFrame, as_of: Column, days: int = ARCHIVE_DAYS) -> DataFrame:
    """Old removed or expired postings that nobody applied to lose their description."""
    used = applications.select("job_id").distinct().withColumn("used", F.lit(True))
    rows = jobs.join(used, "job_id", "left")
    old = F.col("status").isin("REMOVED", "EXPIRED") & (F.col("posted_at") < days_before(as_of, days)) & F.col("used").isNull()
    return rows.withColumns({"status": F.when(old, "ARCHIVED").otherwise(F.col("status")), "description": F.when(~old, F.col("description"))}).drop("used")


def dormancy(users: DataFrame, as_of: Column, days: int = DORMANT_DAYS) -> DataFrame:
    """Active users not seen for long become DORMANT."""
    gone = (F.col("status") == "ACTIVE") & (F.col("last_active_at") < days_before(as_of, days))
    return users.withColumn("status", F.when(gone, "DORMANT").otherwise(F.col("status")))


def login(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users after their latest login: dormant ones are active again, and it counts as activity if at least five minutes after the last."""
    last = logins.groupBy("user_id").agg(F.max("at").alias("at"))
    rows = users.join(last, "user_id", "left")
    later = F.timestamp_diff("MINUTE", "last_active_at", "at") >= 5
    return rows.withColumns(
        {
            "status": F.when((F.col("status") == "DORMANT") & F.col("at").isNotNull(), "ACTIVE").otherwise(F.col("status")),
            "last_active_at": F.when(F.coalesce(later, F.lit(False)), F.col("at")).otherwise(F.col("last_active_at")),
        }
    ).drop("at")


def purge(notifications: DataFrame, as_of: Column, days: int = PURGE_DAYS) -> DataFrame:
    """Notifications but the delivered ones that are old."""
    return notifications.where(~(F.col("status").isin("SENT", "READ") & (F.col("created_at") < days_before(as_of, days))))


def legal(spark: SparkSession) -> DataFrame:
    """(from_stage, to_stage) of the stage graph."""
    return F.broadcast(dims.frame(spark, dims.TRANSITIONS, "from_stage string, to_stage string").withColumn("legal", F.lit(True)))


def move(applications: DataFrame, requests: DataFrame, as_of: Column, spark: SparkSession) -> DataFrame:
    """Applications after requests (application_id, to_stage, version): a move needs a legal step and the version that the caller saw.

    A move raises the version, dates the stage, and APPLIED sets a follow-up a week later; ``outcome`` is MOVED, ILLEGAL, CONFLICT or null without a request.
    """
    rows = applications.join(requests.select("application_id", "to_stage", F.col("version").alias("seen")), "application_id", "left")
    rows = rows.join(legal(spark).withColumnRenamed("from_stage", "stage"), ["stage", "to_stage"], "left")
    outcome = F.when(F.col("to_stage").isNull(), None).when(F.col("legal").isNull(), "ILLEGAL").when(F.col("seen") != F.col("version"), "CONFLICT").otherwise("MOVED")
    moved = F.coalesce(outcome == "MOVED", F.lit(False))
    return rows.select(
        "application_id",
        F.when(moved, F.col("to_stage")).otherwise(F.col("stage")).alias("stage"),
        (F.col("version") + moved.cast("int")).alias("version"),
        F.when(moved & (F.col("to_stage") == "APPLIED"), F.timestamp_add("DAY", F.lit(FOLLOW_UP_DAYS), as_of)).alias("follow_up"),
        outcome.alias("outcome"),
    )


def history(transitions: DataFrame, spark: SparkSession) -> DataFrame:
    """Transitions with the stage before, and whether that step is legal (null for the first)."""
    order = Window.partitionBy("application_id").orderBy("moved_at", "transition_id")
    rows = transitions.withColumn("from_stage", F.lag("to_stage").over(order))
    rows = rows.join(legal(spark), ["from_stage", "to_stage"], "left")
    return rows.withColumn("legal", F.when(F.col("from_stage").isNotNull(), F.coalesce("legal", F.lit(False))))


def pseudonymise(users: DataFrame, left: DataFrame) -> DataFrame:
    """Users, with those of ``left`` DELETED and without anything personal."""
    rows = users.join(left.select("user_id").distinct().withColumn("gone", F.lit(True)), "user_id", "left")
    gone = F.col("gone").isNotNull()
    return rows.withColumns(
        {
            "status": F.when(gone, "DELETED").otherwise(F.col("status")),
            "paused": F.col("paused") | gone,
            **{c: F.when(gone, F.array().cast("array<string>")).otherwise(F.col(c)) for c in ("skills", "role1", "role2")},
            **{c: F.when(~gone, F.col(c)) for c in ("region", "min_salary", "last_active_at")},
        }
    ).drop("gone")


def toggle_saved(applications: DataFrame, requests: DataFrame) -> DataFrame:
    """Applications after saves: a saved one is withdrawn, any other saved again, whatever the stage graph says; new pairs are saved."""
    keys = ["user_id", "job_id"]
    asked = requests.select(*keys).distinct().withColumn("asked", F.lit(True))
    rows = applications.join(asked, keys, "full")
    stage = F.when(F.col("asked").isNull(), F.col("stage")).when(F.col("stage") == "SAVED", "WITHDRAWN").otherwise("SAVED")
    return rows.withColumn("stage", stage).drop("asked")


def recheck_links(jobs: DataFrame, checks: DataFrame) -> DataFrame:
    """Postings after link checks (job_id, url_status): a dead link removes an active posting, a live one revives it."""
    rows = jobs.join(checks.select("job_id", "url_status"), "job_id", "left")
    dead, alive = F.col("url_status") == "NOT_FOUND", F.col("url_status") == "OK"
    now = F.when(dead & (F.col("status") == "ACTIVE"), "REMOVED").when(alive & (F.col("status") == "REMOVED"), "ACTIVE").otherwise(F.col("status"))
    return rows.withColumn("status", now)


#: Failed deliveries in a row after which a chat counts as unreachable.
UNREACHABLE_AFTER = 5


def reachability(deliveries: DataFrame) -> DataFrame:
    """State of each chat after its deliveries (chat_id, at, ok): UNREACHABLE after five failures in a row, ACTIVE again with a success."""
    order = Window.partitionBy("chat_id").orderBy("at")
    islands = deliveries.select("chat_id", "ok", F.sum(F.col("ok").cast("int")).over(order).alias("island"))
    failed = islands.groupBy("chat_id", "island").agg(F.count_if(~F.col("ok")).alias("n"))
    last = failed.groupBy("chat_id").agg(F.max_by("n", "island").alias("failures"))
    return last.withColumn("status", F.when(F.col("failures") >= UNREACHABLE_AFTER, "UNREACHABLE").otherwise("ACTIVE"))


def backfill(jobs: DataFrame, column: str, made: Column) -> DataFrame:
    """Postings with an array made anew where it is null or empty."""
    return jobs.withColumn(column, F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.col(column)).otherwise(made))
