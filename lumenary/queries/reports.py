"""Reports for administrators: overviews, histograms, duplicates and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary.bindings import relations as R
from lumenary.bindings.ctes import NOW, with_
from lumenary.functions.text import LEGAL_SUFFIX, fingerprint
from lumenary.queries.register import query


@query(
    "admin_overview",
    with_("app_user", "job", "match", "notification", "application", "source_run")
    + f"""SELECT * FROM (SELECT count(*) AS n_users, count(*) FILTER (WHERE status = 'ACTIVE') AS n_users_active, count(*) FILTER (WHERE last_active_at >= {NOW} - INTERVAL 24 HOUR) AS n_users_today FROM app_user),
    (SELECT count(*) AS n_jobs, count(*) FILTER (WHERE status = 'ACTIVE') AS n_jobs_active, count(*) FILTER (WHERE status = 'REMOVED') AS n_jobs_removed FROM job),
    (SELECT count(*) AS n_matches, count(*) FILTER (WHERE score >= 80) AS n_strong FROM match), (SELECT count(*) FILTER (WHERE status = 'SENT') AS n_sent, count(*) FILTER (WHERE status = 'FAILED') AS n_failed FROM notification),
    (SELECT count(*) AS n_applications FROM application), (SELECT count(*) FILTER (WHERE status = 'FAIL') AS n_runs_failed FROM source_run)""",
)
def _overview(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counters: a single pass over each table, and a product of single rows."""
    when = lambda test, name: F.count_if(test).alias(name)
    status = lambda s: F.col("status") == s
    parts = [
        R.app_user(spark, sf).agg(F.count("*").alias("n_users"), when(status("ACTIVE"), "n_users_active"), when(F.col("last_active_at") >= F.timestamp_add("HOUR", F.lit(-24), R.now()), "n_users_today")),
        R.job(spark, sf).agg(F.count("*").alias("n_jobs"), when(status("ACTIVE"), "n_jobs_active"), when(status("REMOVED"), "n_jobs_removed")),
        R.match(spark, sf).agg(F.count("*").alias("n_matches"), when(F.col("score") >= 80, "n_strong")),
        R.notification(spark, sf).agg(when(status("SENT"), "n_sent"), when(status("FAILED"), "n_failed")),
        R.application(spark, sf).agg(F.count("*").alias("n_applications")),
        R.source_run(spark, sf).agg(when(status("FAIL"), "n_runs_failed")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)


@query("group_counts", with_("job", "notification") + " UNION ALL ".join(f"SELECT '{c}' AS what, {c} AS value, count(*) AS n FROM {t} GROUP BY 2" for t, c in (("job", "status"), ("job", "work_place"), ("job", "location_class"), ("notification", "channel"))))
def _groups(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by status, work place, location class and channel."""
    count = lambda df, c: df.groupBy(F.lit(c).alias("what"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    jobs = R.job(spark, sf)
    return reduce(DataFrame.unionByName, [*(count(jobs, c) for c in ("status", "work_place", "location_class")), count(R.notification(spark, sf), "channel")])


@query("score_histogram", with_("match") + "SELECT CASE WHEN score <= 25 THEN '0-25' WHEN score <= 50 THEN '26-50' WHEN score <= 75 THEN '51-75' ELSE '76-100' END AS bucket, count(*) AS n_matches FROM match GROUP BY 1")
def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score")
    return R.match(spark, sf).groupBy(F.when(s <= 25, "0-25").when(s <= 50, "26-50").when(s <= 75, "51-75").otherwise("76-100").alias("bucket")).agg(F.count("*").alias("n_matches"))


@query("score_stats", with_("match") + "SELECT min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean, count(*) AS n, count(*) FILTER (WHERE score < 0 OR score > 100) AS n_out_of_range FROM match")
def _stats(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score")
    return R.match(spark, sf).agg(F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.avg(s), 6).alias("mean"), F.count("*").alias("n"), F.count_if(~s.between(0, 100)).alias("n_out_of_range"))


@query(
    "match_funnel",
    with_("match", "app_user", "notification")
    + """SELECT * FROM (SELECT count(DISTINCT job_id) AS n_jobs, count(DISTINCT user_id) AS n_users, count(*) AS n_created, count(*) FILTER (WHERE score >= threshold) AS n_above FROM match JOIN app_user USING (user_id)),
    (SELECT count(*) FILTER (WHERE status IN ('SENT', 'READ') AND channel = 'TELEGRAM') AS n_sent, count(*) FILTER (WHERE status IN ('SENT', 'READ') AND channel = 'IN_APP') AS n_inbox, count(*) FILTER (WHERE status = 'FAILED') AS n_skipped FROM notification)""",
)
def _funnel(spark: SparkSession, sf: str) -> DataFrame:
    made = R.match(spark, sf).join(R.app_user(spark, sf).select("user_id", "threshold"), "user_id")
    counts = made.agg(F.count_distinct("job_id").alias("n_jobs"), F.count_distinct("user_id").alias("n_users"), F.count("*").alias("n_created"), F.count_if(F.col("score") >= F.col("threshold")).alias("n_above"))
    done = F.col("status").isin("SENT", "READ")
    told = R.notification(spark, sf).agg(
        F.count_if(done & (F.col("channel") == "TELEGRAM")).alias("n_sent"), F.count_if(done & (F.col("channel") == "IN_APP")).alias("n_inbox"), F.count_if(F.col("status") == "FAILED").alias("n_skipped")
    )
    return counts.crossJoin(told)


@query("dup_source_keys", with_("job") + "SELECT source_id, source_job_id, count(*) AS n_rows, min(job_id) AS first_job FROM job GROUP BY 1, 2 HAVING count(*) > 1")
def _dup_keys(spark: SparkSession, sf: str) -> DataFrame:
    return R.job(spark, sf).groupBy("source_id", "source_job_id").agg(F.count("*").alias("n_rows"), F.min("job_id").alias("first_job")).where("n_rows > 1")


_PRINT = f"""regexp_replace(company, '{LEGAL_SUFFIX}', '') || '|' || lower(trim(title)) || '|' || lower(trim(location)) || '|' || left(trim(regexp_replace(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')), 500)"""


@query("job_fingerprints", with_("job") + f"SELECT job_id, sha256({_PRINT}) AS fingerprint FROM job")
def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return R.job(spark, sf).select("job_id", F.sha2(fingerprint(F.col("company"), F.col("title"), F.col("location"), F.col("description")).cast("binary"), 256).alias("fingerprint"))


_LOOSE = "md5(trim(regexp_replace(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')))"


@query("dup_fingerprints", with_("job") + f"SELECT f AS fingerprint, count(*) AS n_jobs, min(job_id) AS first_job, count(DISTINCT source_id) AS n_sources FROM (SELECT *, {_LOOSE} AS f FROM job) GROUP BY 1 HAVING count(*) > 1")
def _dup_prints(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions that several postings share; a digest keeps the shuffled key narrow."""
    loose = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("description", F.lit(""))), r"[^a-z0-9_\s]", ""), r"\s+", " "))
    rows = R.job(spark, sf).select("job_id", "source_id", F.md5(loose.cast("binary")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n_jobs"), F.min("job_id").alias("first_job"), F.count_distinct("source_id").alias("n_sources")).where("n_jobs > 1")


@query("dup_skill_case", with_("job") + "SELECT lower(s) AS skill, count(DISTINCT s) AS n_spellings, count(*) AS n_uses FROM (SELECT unnest(skills) AS s FROM job) GROUP BY 1 HAVING count(DISTINCT s) > 1")
def _dup_case(spark: SparkSession, sf: str) -> DataFrame:
    return R.job(spark, sf).select(F.explode("skills").alias("s")).groupBy(F.lower("s").alias("skill")).agg(F.count_distinct("s").alias("n_spellings"), F.count("*").alias("n_uses")).where("n_spellings > 1")


@query("dup_matches", with_("match") + "SELECT user_id, job_id, count(*) AS n FROM match GROUP BY 1, 2 HAVING count(*) > 1")
def _dup_matches(spark: SparkSession, sf: str) -> DataFrame:
    return R.match(spark, sf).groupBy("user_id", "job_id").agg(F.count("*").alias("n")).where("n > 1")


@query("ids_across_sources", with_("job") + "SELECT source_job_id, count(DISTINCT source_id) AS n_sources, count(*) AS n_rows FROM job GROUP BY 1")
def _across(spark: SparkSession, sf: str) -> DataFrame:
    return R.job(spark, sf).groupBy("source_job_id").agg(F.count_distinct("source_id").alias("n_sources"), F.count("*").alias("n_rows"))


@query("orphan_matches", with_("match", "job") + "SELECT match_id, match.job_id, job.status FROM match LEFT JOIN job USING (job_id) WHERE job.job_id IS NULL OR job.status <> 'ACTIVE'")
def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    jobs = R.job(spark, sf).select("job_id", "status", F.lit(True).alias("known"))
    return R.match(spark, sf).join(jobs, "job_id", "left").where("known IS NULL OR status <> 'ACTIVE'").select("match_id", "job_id", "status")


@query(
    "quality_nulls_and_dates",
    with_("job")
    + f"""SELECT source_id, count(*) AS n_jobs, count(*) FILTER (WHERE salary IS NULL) AS n_no_salary, count(*) FILTER (WHERE deadline IS NULL) AS n_no_deadline, count(*) FILTER (WHERE posted_at > {NOW}) AS n_future,
    count(*) FILTER (WHERE deadline < posted_at) AS n_before_posted, count(*) FILTER (WHERE location ILIKE '%ethiopia%' AND location_class NOT LIKE 'ETHIOPIA%') AS n_ambiguous, count(DISTINCT title) AS n_titles,
    CAST(floor(max(epoch({NOW}) - epoch(posted_at)) / 3600) AS BIGINT) AS oldest_hours FROM job GROUP BY 1""",
)
def _nulls(spark: SparkSession, sf: str) -> DataFrame:
    when = lambda test, name: F.count_if(test).alias(name)
    c = F.col
    return R.job(spark, sf).groupBy("source_id").agg(
        F.count("*").alias("n_jobs"),
        when(c("salary").isNull(), "n_no_salary"),
        when(c("deadline").isNull(), "n_no_deadline"),
        when(c("posted_at") > R.now(), "n_future"),
        when(c("deadline") < c("posted_at"), "n_before_posted"),
        when(c("location").ilike("%ethiopia%") & ~c("location_class").startswith("ETHIOPIA"), "n_ambiguous"),
        F.count_distinct("title").alias("n_titles"),
        F.timestamp_diff("HOUR", F.min("posted_at"), R.now()).alias("oldest_hours"),
    )


@query(
    "score_percentiles",
    with_("match") + "SELECT job_id % 10 AS bucket, CAST(quantile_disc(score, 0.5) AS INTEGER) AS p50, CAST(quantile_disc(score, 0.95) AS INTEGER) AS p95 FROM match GROUP BY 1",
)
def _percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact discrete percentiles, from a histogram of the scores so that no group is sorted row by row."""
    counts = R.match(spark, sf).groupBy((F.col("job_id") % 10).alias("bucket"), "score").agg(F.count("*").alias("n"))
    w = Window.partitionBy("bucket").orderBy("score")
    ranked = counts.select("bucket", "score", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy("bucket")).alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(p).cast("decimal(4,2)")), F.col("score")))
    return ranked.groupBy("bucket").agg(at("0.5").alias("p50"), at("0.95").alias("p95"))
