"""Queries about the life of postings, users, applications and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary import dims
from lumenary.bindings import relations as R
from lumenary.bindings.ctes import NOW, with_
from lumenary.functions.times import fresh_since
from lumenary.operators import lifecycle as op
from lumenary.queries.register import query
from lumenary.streaming.events import event_counts, rate_windows, sliding_digest
from lumenary.streaming.limiter import limited, window_counts

_LEGAL = dims.values(dims.TRANSITIONS, "a, b")


@query("lifecycle_expire", with_("job") + f"SELECT job_id, CASE WHEN status = 'ACTIVE' AND deadline < {NOW} THEN 'EXPIRED' WHEN status = 'ACTIVE' AND missed_cycles >= 3 THEN 'REMOVED' ELSE status END AS status FROM job")
def _expire(spark: SparkSession, sf: str) -> DataFrame:
    return op.expire(R.job(spark, sf), R.now()).select("job_id", "status")


@query(
    "lifecycle_archive",
    with_("job", "application")
    + f"""SELECT job_id, CASE WHEN old THEN 'ARCHIVED' ELSE status END AS status, CASE WHEN NOT old THEN length(description) END AS n_chars
    FROM (SELECT *, status IN ('REMOVED', 'EXPIRED') AND posted_at < {NOW} - INTERVAL 60 DAY AND job_id NOT IN (SELECT job_id FROM application WHERE stage = 'OFFER') AS old FROM job)""",
)
def _archive(spark: SparkSession, sf: str) -> DataFrame:
    """Here only offers keep a posting."""
    kept = R.application(spark, sf).where("stage = 'OFFER'")
    return op.archive(R.job(spark, sf), kept, R.now()).select("job_id", "status", F.length("description").alias("n_chars"))


@query("lifecycle_dormant", with_("app_user") + f"SELECT user_id, CASE WHEN status = 'ACTIVE' AND last_active_at < {NOW} - INTERVAL 30 DAY THEN 'DORMANT' ELSE status END AS status FROM app_user")
def _dormant(spark: SparkSession, sf: str) -> DataFrame:
    return op.dormancy(R.app_user(spark, sf), R.now()).select("user_id", "status")


@query("lifecycle_purge", with_("notification") + f"SELECT notification_id, status, created_at FROM notification WHERE NOT (status IN ('SENT', 'READ') AND created_at < {NOW} - INTERVAL 90 DAY)")
def _purge(spark: SparkSession, sf: str) -> DataFrame:
    return op.purge(R.notification(spark, sf), R.now()).select("notification_id", "status", "created_at")


@query(
    "lifecycle_login",
    with_("app_user", "transition")
    + """, l AS (SELECT application_id AS user_id, max(moved_at) AS login_at FROM transition GROUP BY 1)
    SELECT user_id, CASE WHEN status = 'DORMANT' AND login_at IS NOT NULL THEN 'ACTIVE' ELSE status END AS status, CASE WHEN login_at >= last_active_at + INTERVAL 5 MINUTE THEN login_at ELSE last_active_at END AS last_active_at FROM app_user LEFT JOIN l USING (user_id)""",
)
def _login(spark: SparkSession, sf: str) -> DataFrame:
    """Events as logins."""
    logins = R.transition(spark, sf).select(F.col("application_id").alias("user_id"), F.col("moved_at").alias("at"))
    return op.login(R.app_user(spark, sf), logins).select("user_id", "status", "last_active_at")


@query(
    "application_moves",
    with_("application", "transition")
    + f""", q AS (SELECT application_id, arg_max(to_stage, (moved_at, transition_id)) AS to_stage, CAST(count(*) % 3 + 1 AS INTEGER) AS seen FROM transition GROUP BY 1), g AS (SELECT * FROM {_LEGAL}),
    o AS (SELECT a.*, to_stage, CASE WHEN to_stage IS NULL THEN NULL WHEN b IS NULL THEN 'ILLEGAL' WHEN seen <> version THEN 'CONFLICT' ELSE 'MOVED' END AS outcome FROM application a LEFT JOIN q USING (application_id) LEFT JOIN g ON g.a = stage AND g.b = to_stage)
    SELECT application_id, CASE WHEN outcome = 'MOVED' THEN to_stage ELSE stage END AS stage, CAST(version + CASE WHEN outcome = 'MOVED' THEN 1 ELSE 0 END AS INTEGER) AS version, CASE WHEN outcome = 'MOVED' AND to_stage = 'APPLIED' THEN {NOW} + INTERVAL 7 DAY END AS follow_up, outcome FROM o""",
)
def _moves(spark: SparkSession, sf: str) -> DataFrame:
    """Applications after the latest requested stage of each."""
    asked = R.transition(spark, sf).groupBy("application_id").agg(F.max_by("to_stage", F.struct("moved_at", "transition_id")).alias("to_stage"), (F.count("*") % 3 + 1).cast("int").alias("version"))
    return op.move(R.application(spark, sf), asked, R.now(), spark)


@query(
    "transition_legality",
    with_("transition")
    + f""", t AS (SELECT *, lag(to_stage) OVER (PARTITION BY application_id ORDER BY moved_at, transition_id) AS from_stage FROM transition), g AS (SELECT * FROM {_LEGAL})
    SELECT from_stage, to_stage, count(*) AS n, bool_and(EXISTS (SELECT 1 FROM g WHERE a = from_stage AND b = to_stage)) AS legal FROM t WHERE from_stage IS NOT NULL GROUP BY 1, 2""",
)
def _legality(spark: SparkSession, sf: str) -> DataFrame:
    return op.history(R.transition(spark, sf), spark).where("from_stage IS NOT NULL").groupBy("from_stage", "to_stage").agg(F.count("*").alias("n"), F.every("legal").alias("legal"))


@query(
    "transition_continuity",
    with_("transition")
    + """SELECT application_id, count(*) AS n_steps, count(*) FILTER (WHERE to_stage = before) AS n_repeats, max_by(to_stage, (moved_at, transition_id)) AS last_stage
    FROM (SELECT *, lag(to_stage) OVER (PARTITION BY application_id ORDER BY moved_at, transition_id) AS before FROM transition) GROUP BY 1""",
)
def _continuity(spark: SparkSession, sf: str) -> DataFrame:
    steps = op.history(R.transition(spark, sf), spark)
    return steps.groupBy("application_id").agg(F.count("*").alias("n_steps"), F.count_if(F.col("to_stage") == F.col("from_stage")).alias("n_repeats"), F.max_by("to_stage", F.struct("moved_at", "transition_id")).alias("last_stage"))


@query(
    "account_pseudonyms",
    with_("app_user") + "SELECT user_id, CASE WHEN status = 'DISABLED' THEN 'DELETED' ELSE status END AS status, paused OR status = 'DISABLED' AS paused, CASE WHEN status <> 'DISABLED' THEN len(skills) ELSE 0 END AS n_skills, CASE WHEN status <> 'DISABLED' THEN region END AS region FROM app_user",
)
def _pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Disabled users have left."""
    users = R.app_user(spark, sf)
    return op.pseudonymise(users, users.where("status = 'DISABLED'")).select("user_id", "status", "paused", F.size("skills").cast("long").alias("n_skills"), "region")


@query(
    "saved_toggle",
    with_("application", "match")
    + """, q AS (SELECT DISTINCT user_id, job_id FROM match WHERE score >= 95)
    SELECT coalesce(a.user_id, q.user_id) AS user_id, coalesce(a.job_id, q.job_id) AS job_id, CASE WHEN q.user_id IS NULL THEN stage WHEN stage = 'SAVED' THEN 'WITHDRAWN' ELSE 'SAVED' END AS stage FROM application a FULL JOIN q ON a.user_id = q.user_id AND a.job_id = q.job_id""",
)
def _toggle(spark: SparkSession, sf: str) -> DataFrame:
    return op.toggle_saved(R.application(spark, sf), R.match(spark, sf).where("score >= 95")).select("user_id", "job_id", "stage")


@query(
    "link_recheck",
    with_("job", "seen_in_run")
    + """SELECT job_id, CASE WHEN s.job_id IS NULL OR status NOT IN ('ACTIVE', 'REMOVED') THEN status WHEN job.job_id % 2 = 0 AND status = 'ACTIVE' THEN 'REMOVED' WHEN job.job_id % 2 = 1 AND status = 'REMOVED' THEN 'ACTIVE' ELSE status END AS status FROM job LEFT JOIN seen_in_run s USING (job_id)""".replace("s.job_id IS NULL", "s.hit IS NULL").replace("seen_in_run s", "(SELECT job_id, TRUE AS hit FROM seen_in_run) s"),
)
def _links(spark: SparkSession, sf: str) -> DataFrame:
    checks = R.seen_in_run(spark, sf).withColumn("url_status", F.when(F.col("job_id") % 2 == 0, "NOT_FOUND").otherwise("OK"))
    return op.recheck_links(R.job(spark, sf), checks).select("job_id", "status")


@query(
    "rate_limit_windows",
    """SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS n_events, count(*) > 1 AS limited FROM events GROUP BY 1, 2""",
)
def _limits(spark: SparkSession, sf: str) -> DataFrame:
    return rate_windows(spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts"), most=1)


_DAY_MS = 24 * 3600 * 1000


@query(
    "rate_limit_anchored",
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_ms(ts) AS t FROM events),
    w AS (SELECT user_id, min(t) AS s FROM e GROUP BY 1 UNION ALL SELECT w.user_id, min(e.t) FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.s + {_DAY_MS} GROUP BY w.user_id, w.s)
    SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(least(n, 2)) AS BIGINT) AS n_allowed, count(*) AS n_windows
    FROM (SELECT w.user_id, w.s, count(*) AS n FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.s AND e.t < w.s + {_DAY_MS} GROUP BY 1, 2) GROUP BY 1""",
)
def _anchored(spark: SparkSession, sf: str) -> DataFrame:
    """Two events a day let through, by windows that begin at a user's first event after the last one."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return window_counts(limited(events, "user_id", "event_id", "ts", 2, 24 * 3600)).withColumnRenamed("key", "user_id")


@query(
    "digest_sliding",
    """SELECT user_id, upto, count(*) AS n_events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total
    FROM (SELECT *, date_trunc('hour', ts) + to_hours(CAST(k AS INTEGER)) AS upto FROM events, (SELECT unnest(range(1, 25)) AS k)) GROUP BY 1, 2""",
)
def _sliding(spark: SparkSession, sf: str) -> DataFrame:
    """What happened to each user in the 24 hours before every full hour."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return sliding_digest(events)


@query("event_counts_batch", "SELECT event_type, count(*) AS n_events FROM events GROUP BY 1")
def _event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return event_counts(spark.read.parquet(f"{sf}/events.parquet"))


@query(
    "chat_reachability",
    """WITH d AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS ok FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id, ok ORDER BY event_id) AS b, count(*) OVER (PARTITION BY user_id) AS total FROM d),
    g AS (SELECT user_id, ok, count(*) AS n, max(a) = max(total) AS last FROM n GROUP BY user_id, ok, a - b)
    SELECT user_id AS chat_id, coalesce(max(n) FILTER (WHERE NOT ok AND last), 0) AS failures, CASE WHEN coalesce(max(n) FILTER (WHERE NOT ok AND last), 0) >= 5 THEN 'UNREACHABLE' ELSE 'ACTIVE' END AS status FROM g GROUP BY 1""",
)
def _reachability(spark: SparkSession, sf: str) -> DataFrame:
    """Views and clicks as deliveries that arrived."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return op.reachability(events.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("at"), F.col("event_type").isin("view", "click").alias("ok")))


@query(
    "freshness_windows",
    with_("source", "job")
    + f""", s AS (SELECT source_id, unnest(['FAST', 'DEEP']) AS mode, CASE WHEN number % 3 > 0 THEN number * 6 END AS fast_hours, CASE WHEN number % 4 > 0 THEN number END AS deep_days, CASE WHEN number % 5 > 0 THEN number + 3 END AS window_days FROM source),
    w AS (SELECT source_id, mode, CAST(CASE WHEN mode = 'FAST' AND fast_hours IS NOT NULL THEN fast_hours WHEN mode = 'DEEP' AND deep_days IS NOT NULL THEN deep_days * 24 ELSE coalesce(window_days, 14) * 24 END AS INTEGER) AS hours FROM s)
    SELECT source_id, mode, {NOW} - to_hours(hours) AS since, count(*) FILTER (WHERE posted_at >= {NOW} - to_hours(hours)) AS n_fresh FROM w LEFT JOIN (SELECT source_id, posted_at FROM job) j USING (source_id) GROUP BY ALL""",
)
def _fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Postings within the window of their source, in either mode."""
    n = F.col("number")
    modes = R.source(spark, sf).select("source_id", n, F.explode(F.array(F.lit("FAST"), F.lit("DEEP"))).alias("mode"))
    since = fresh_since(F.col("mode"), F.when(n % 3 > 0, n * 6), F.when(n % 4 > 0, n), F.when(n % 5 > 0, n + 3), R.now())
    rows = modes.select("source_id", "mode", since.alias("since")).join(R.job(spark, sf).select("source_id", "posted_at"), "source_id", "left")
    return rows.groupBy("source_id", "mode", "since").agg(F.count_if(F.col("posted_at") >= F.col("since")).alias("n_fresh"))


@query(
    "category_backfill",
    with_("job")
    + "SELECT job_id, CASE WHEN len(list_filter(labels, lambda l: l <> 'Zoology')) > 0 THEN array_to_string(list_filter(labels, lambda l: l <> 'Zoology'), ',') ELSE 'unsorted' END AS labels FROM job",
)
def _backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Postings whose only label says nothing get a label."""
    jobs = R.job(spark, sf).withColumn("labels", F.filter("labels", lambda x: x != "Zoology"))
    return op.backfill(jobs, "labels", F.array(F.lit("unsorted"))).select("job_id", F.array_join("labels", ",").alias("labels"))
