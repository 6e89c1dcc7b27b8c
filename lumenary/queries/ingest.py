"""Queries about collecting: merging runs, upserts and disappearing postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.bindings import relations as R
from lumenary.bindings.ctes import NOW, with_
from lumenary.operators import ingest as op
from lumenary.operators.matching import next_batch
from lumenary.queries.register import query


@query(
    "within_run_dedupe",
    with_("job")
    + """,
    f AS (SELECT source_id, source_job_id, min(job_id) AS job_id, count(*) AS n_rows, arg_min(title, job_id) AS title FROM job GROUP BY 1, 2),
    s AS (SELECT source_id, source_job_id, string_agg(s, ',' ORDER BY seq) AS skills FROM (SELECT source_id, source_job_id, s, min(job_id * 100 + pos) AS seq FROM (SELECT *, unnest(skills) AS s, unnest(range(len(skills))) AS pos FROM job) GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT f.*, coalesce(skills, '') AS skills FROM f LEFT JOIN s USING (source_id, source_job_id)
    """,
)
def _dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The first posting of a source's key, with the skills of all."""
    raw = R.job(spark, sf).select("source_id", "source_job_id", "job_id", "title", "skills")
    return op.merge_run(raw, "job_id", ("skills",)).withColumn("skills", F.array_join("skills", ","))


_STORED = {"stored": f"SELECT job_id, status, missed_cycles, posted_at AS last_seen_at FROM job WHERE labels[1] <> 'Zoology'", "seen": "SELECT job_id FROM seen_in_run"}


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Postings known before the run."""
    return R.job(spark, sf).where(F.col("labels")[0] != "Zoology")


@query(
    "upsert_outcome",
    with_("job", "seen_in_run", more=_STORED)
    + f"""SELECT coalesce(s.job_id, n.job_id) AS job_id, CASE WHEN s.job_id IS NULL OR (n.job_id IS NOT NULL AND status = 'REMOVED') THEN 'ACTIVE' ELSE status END AS status,
    CASE WHEN n.job_id IS NOT NULL THEN 0 ELSE missed_cycles END AS missed_cycles, CASE WHEN n.job_id IS NOT NULL THEN {NOW} ELSE last_seen_at END AS last_seen_at,
    CASE WHEN s.job_id IS NULL THEN 'CREATED' WHEN n.job_id IS NOT NULL AND status = 'REMOVED' THEN 'REVIVED' WHEN n.job_id IS NOT NULL THEN 'TOUCHED' ELSE 'KEPT' END AS outcome
    FROM stored s FULL JOIN seen n ON s.job_id = n.job_id""",
)
def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored(spark, sf).select("job_id", "status", "missed_cycles", F.col("posted_at").alias("last_seen_at"))
    return op.upsert(stored, R.seen_in_run(spark, sf), R.now())


@query(
    "ghost_reconcile",
    with_("job", "seen_in_run")
    + f"""SELECT job_id, n AS missed_now, CASE WHEN n >= 3 THEN 'REMOVED' ELSE 'ACTIVE' END AS status_now FROM (SELECT job.job_id, CAST(CASE WHEN s.job_id IS NOT NULL THEN 0 WHEN posted_at >= {NOW} - INTERVAL 1200 HOUR THEN missed_cycles + 1 ELSE missed_cycles END AS INTEGER) AS n
    FROM job LEFT JOIN seen_in_run s ON s.job_id = job.job_id WHERE status = 'ACTIVE')""",
)
def _reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """After an incomplete run that covered the last 1200 hours."""
    rows = R.job(spark, sf).select("job_id", "status", "missed_cycles", "posted_at")
    return op.reconcile(rows, R.seen_in_run(spark, sf), F.timestamp_add("HOUR", F.lit(-1200), R.now())).select("job_id", "missed_now", "status_now")


@query(
    "missed_cycle_streaks",
    """WITH p AS (SELECT user_id AS job_id, event_id AS cycle, event_type IN ('view', 'signup') AS seen FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY cycle) AS a, row_number() OVER (PARTITION BY job_id, seen ORDER BY cycle) AS b FROM p),
    g AS (SELECT job_id, seen, a - b AS island, count(*) AS gap, max(a) AS last FROM n GROUP BY ALL), t AS (SELECT job_id, count(*) AS total FROM p GROUP BY 1)
    SELECT t.job_id, coalesce(max(gap) FILTER (WHERE NOT seen AND last = total), 0) AS missed_now, coalesce(max(gap) FILTER (WHERE NOT seen), 0) AS longest_gap, coalesce(max(gap) FILTER (WHERE NOT seen), 0) >= 3 AS was_removed FROM t JOIN g USING (job_id) GROUP BY 1""",
)
def _missed(spark: SparkSession, sf: str) -> DataFrame:
    """Users as postings that events see or miss."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return op.missed_streaks(events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("cycle"), F.col("event_type").isin("view", "signup").alias("seen")))


@query("insert_once", with_("match", "notification") + "SELECT m.user_id, m.job_id, max(m.score) AS score FROM match m ANTI JOIN notification n USING (user_id, job_id) GROUP BY 1, 2")
def _once(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs to notify that have no notification; each once."""
    best = R.match(spark, sf).groupBy("user_id", "job_id").agg(F.max("score").alias("score"))
    return op.append_new(R.notification(spark, sf), best, ["user_id", "job_id"])


@query(
    "match_refresh",
    with_("match", "application")
    + """SELECT m.user_id, m.job_id, m.score, CASE WHEN a.user_id IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS outcome FROM (SELECT user_id, job_id, max(score) AS score FROM match GROUP BY 1, 2) m
    LEFT JOIN (SELECT DISTINCT user_id, job_id FROM application) a USING (user_id, job_id)""",
)
def _refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Recalculated pairs against stored ones, for which applications stand."""
    scored = R.match(spark, sf).groupBy("user_id", "job_id").agg(F.max("score").alias("score"))
    return op.refresh(R.application(spark, sf), scored, ["user_id", "job_id"])


@query("skill_dictionary_new", with_("job", "app_user") + "SELECT DISTINCT lower(s) AS skill FROM (SELECT unnest(skills) AS s FROM job) WHERE lower(s) NOT IN (SELECT DISTINCT lower(s) FROM (SELECT unnest(skills) AS s FROM app_user WHERE user_id < 3))")
def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Skills of postings that the first users' dictionary lacks."""
    known = R.app_user(spark, sf).where("user_id < 3").select(F.explode("skills").alias("s")).select(F.lower("s").alias("skill"))
    return op.append_new(known, R.job(spark, sf).select(F.explode("skills").alias("s")).select(F.lower("s").alias("skill")), ["skill"])


_MATCHED = "SELECT job_id FROM match WHERE match_id % 10 = 0"


@query(
    "match_batch_oldest",
    with_("job", "match") + f"SELECT job_id, first_seen_at FROM job ANTI JOIN ({_MATCHED}) USING (job_id) WHERE status = 'ACTIVE' ORDER BY first_seen_at NULLS FIRST, job_id LIMIT 250",
)
def _oldest(spark: SparkSession, sf: str) -> DataFrame:
    """What the next cycle matches: postings that earlier ones have not taken, the first seen first."""
    return next_batch(R.job(spark, sf).select("job_id", "first_seen_at", "status"), R.match(spark, sf).where("match_id % 10 = 0")).select("job_id", "first_seen_at")


@query("match_batch_newest", with_("job") + "SELECT job_id, first_seen_at FROM job WHERE status = 'ACTIVE' ORDER BY first_seen_at DESC NULLS LAST, job_id LIMIT 1000")
def _newest(spark: SparkSession, sf: str) -> DataFrame:
    """What a recalculation of one user looks at."""
    return op.newest_batch(R.job(spark, sf).select("job_id", "first_seen_at", "status")).select("job_id", "first_seen_at")


@query(
    "children_replaced",
    with_("match", "application")
    + """, new AS (SELECT user_id, job_id, CAST(version AS INTEGER) AS score FROM application WHERE user_id % 4 = 0)
    SELECT user_id, job_id, score FROM match WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT * FROM new""",
)
def _children(spark: SparkSession, sf: str) -> DataFrame:
    """Matches after those of every fourth user are made anew."""
    new = R.application(spark, sf).where("user_id % 4 = 0").select("user_id", "job_id", F.col("version").alias("score"))
    return op.replace_children(R.match(spark, sf).select("user_id", "job_id", "score"), new, "user_id")
