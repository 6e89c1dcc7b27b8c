"""Queries about sources and their runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.bindings import relations as R
from lumenary.bindings.ctes import NOW, with_
from lumenary.dims import LAST_RANK, TIER_RANK
from lumenary.operators import runs as op
from lumenary.operators.health import source_health
from lumenary.queries.register import query


@query(
    "source_health_last10",
    with_("source_run")
    + """,
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM source_run),
    a AS (SELECT source_id, count(*) AS n_runs, count(*) FILTER (WHERE status = 'OK') AS n_ok FROM r WHERE rn <= 10 GROUP BY 1)
    SELECT source_id, n_runs, n_ok, CAST(floor(n_ok * 100.0 / n_runs + 0.5) AS BIGINT) AS health, n_runs >= 10 AND n_ok = 0 AS disabled FROM a
    """,
)
def _health(spark: SparkSession, sf: str) -> DataFrame:
    return source_health(R.source_run(spark, sf))


@query(
    "source_failure_streaks",
    with_("source_run")
    + """,
    n AS (SELECT *, row_number() OVER w AS a, row_number() OVER (PARTITION BY source_id, status ORDER BY started_at, run_id) AS b
          FROM source_run WINDOW w AS (PARTITION BY source_id ORDER BY started_at, run_id)),
    g AS (SELECT source_id, status, a - b AS island, count(*) AS fails, max(a) AS last FROM n GROUP BY ALL),
    t AS (SELECT source_id, count(*) AS total FROM source_run GROUP BY 1),
    s AS (SELECT t.source_id, coalesce(max(fails) FILTER (WHERE status = 'FAIL'), 0) AS longest_streak,
                 coalesce(max(fails) FILTER (WHERE status = 'FAIL' AND last = total), 0) AS current_streak FROM t JOIN g USING (source_id) GROUP BY 1)
    SELECT *, CASE WHEN current_streak >= 3 THEN least(pow(2.0, current_streak - 3), 24.0) ELSE 0.0 END AS backoff_hours FROM s
    """,
)
def _streaks(spark: SparkSession, sf: str) -> DataFrame:
    return op.failure_streaks(R.source_run(spark, sf))


@query(
    "source_latest_run",
    with_("source_run") + "SELECT DISTINCT ON (source_id, mode) source_id, mode, run_id, started_at, status, jobs_fetched FROM source_run ORDER BY source_id, mode, started_at DESC, run_id DESC",
)
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    runs = R.source_run(spark, sf)
    newest = runs.groupBy("source_id", "mode").agg(F.max_by(F.struct("run_id", "started_at", "status", "jobs_fetched"), F.struct("started_at", "run_id")).alias("r"))
    return newest.select("source_id", "mode", "r.*")


@query(
    "sources_due",
    with_("source", "source_run")
    + f""",
    l AS (SELECT source_id, max(started_at) AS last_run FROM source_run GROUP BY 1)
    SELECT source_id, tier, frequency_min, last_run, CASE tier WHEN 'ETHIOPIA' THEN 1 WHEN 'INTERNATIONAL' THEN 3 ELSE 5 END AS queue_rank
    FROM source LEFT JOIN l USING (source_id) WHERE last_run IS NULL OR date_sub('minute', last_run, {NOW}) >= frequency_min
    """,
)
def _due(spark: SparkSession, sf: str) -> DataFrame:
    due = op.due_sources(R.source(spark, sf), R.source_run(spark, sf), R.now())
    return op.queue_order(due, TIER_RANK, LAST_RANK).select("source_id", "tier", "frequency_min", "last_run", "queue_rank")


@query(
    "sources_due_deep",
    with_("source", "source_run")
    + f""",
    l AS (SELECT source_id, max(started_at) AS last_deep FROM source_run WHERE mode = 'DEEP' GROUP BY 1),
    s AS (SELECT source_id, CASE WHEN number % 4 <> 1 THEN (number % 3 + 1) * 1440 END AS deep_every_min FROM source)
    SELECT source_id, deep_every_min, last_deep FROM s LEFT JOIN l USING (source_id)
    WHERE deep_every_min IS NOT NULL AND (last_deep IS NULL OR date_sub('minute', last_deep, {NOW}) >= deep_every_min) ORDER BY source_id
    """,
)
def _due_deep(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("number")
    sources = R.source(spark, sf).withColumn("deep_every_min", F.when(number % 4 != 1, (number % 3 + 1) * 1440)).drop("tier")
    due = op.due_deep(sources, R.source_run(spark, sf), R.now()).withColumn("tier", F.lit("DEEP"))
    return op.queue_order(due, TIER_RANK, LAST_RANK).select("source_id", "deep_every_min", "last_deep")


@query(
    "source_fallback_choice",
    with_("source", "source_run")
    + """,
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM source_run),
    h AS (SELECT source_id, count(*) FILTER (WHERE status = 'OK') * 100 < 60 * count(*) AS disabled FROM r WHERE rn <= 10 GROUP BY 1),
    c AS (SELECT source_id, step, 'src' || ((number + step * 7) % 20) AS alternate FROM source, unnest([0, 1, 2, 3]) AS u(step)),
    u AS (SELECT c.source_id, c.step, c.alternate FROM c JOIN h ON h.source_id = c.alternate AND NOT h.disabled)
    SELECT s.source_id, arg_min(u.alternate, u.step) AS chosen, min(u.step) AS step FROM source s LEFT JOIN u USING (source_id) GROUP BY 1
    """,
)
def _fallback(spark: SparkSession, sf: str) -> DataFrame:
    chain = R.source(spark, sf).select("source_id", "number", F.explode(F.array(*map(F.lit, range(4)))).alias("step"))
    chain = chain.select("source_id", "step", F.concat(F.lit("src"), (F.col("number") + F.col("step") * 7) % 20).alias("alternate"))
    health = source_health(R.source_run(spark, sf)).select("source_id", "health", (F.col("n_ok") * 100 < 60 * F.col("n_runs")).alias("disabled"))
    return op.fallback_choice(health, chain)


@query(
    "source_run_rollup",
    with_("source_run")
    + """SELECT source_id, mode, count(*) AS n_runs, count(*) FILTER (WHERE status = 'FAIL') AS n_failed, CAST(sum(jobs_fetched) AS BIGINT) AS jobs_fetched,
    CAST(sum(link_checks) AS BIGINT) AS link_checks, CAST(sum(link_failures) AS BIGINT) AS link_failures, round(avg(quality), 6) AS avg_quality,
    count(*) FILTER (WHERE quality < 60) AS n_low_quality FROM source_run GROUP BY 1, 2""",
)
def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return op.run_rollup(R.source_run(spark, sf))


@query(
    "source_quality_alerts",
    with_("source_run")
    + """,
    m AS (SELECT source_id, run_id, quality < 60 AS low, link_checks > 0 AND link_failures * 5 > link_checks AS dead,
                 row_number() OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS n FROM source_run),
    p AS (SELECT a.source_id, a.run_id, a.low AND coalesce(b.low, FALSE) AS quality_alert, a.dead AND coalesce(b.dead, FALSE) AS link_alert
          FROM m a LEFT JOIN m b ON a.source_id = b.source_id AND b.n = a.n - 1)
    SELECT * FROM p WHERE quality_alert OR link_alert
    """,
)
def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return op.quality_alerts(R.source_run(spark, sf))


@query(
    "coverage_report",
    with_("source", "source_run", "run_category", "job")
    + """,
    d AS (SELECT source_id, arg_max(run_id, (started_at, run_id)) AS run_id, max(started_at) AS last_deep FROM source_run WHERE mode = 'DEEP' GROUP BY 1),
    a AS (SELECT source_id, count(*) FILTER (status = 'ACTIVE') AS active_jobs FROM job GROUP BY 1)
    SELECT source_id, coalesce(active_jobs, 0) AS active_jobs, last_deep, c.category, c.pages_fetched, c.jobs_fetched, c.errors, c.stopped_reason
    FROM source LEFT JOIN a USING (source_id) LEFT JOIN d USING (source_id) LEFT JOIN run_category c ON c.run_id = d.run_id
    """,
)
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Active postings of each source, and what its latest deep run did in each category."""
    return op.coverage(R.source(spark, sf), R.source_run(spark, sf), R.run_category(spark, sf), R.job(spark, sf).select("source_id", "status"))


@query(
    "run_log_write",
    with_("source_run", "run_category")
    + """SELECT r.run_id, r.source_id, r.mode, CAST(sum(c.pages_fetched) AS BIGINT) AS pages_fetched, CAST(sum(c.jobs_fetched) AS BIGINT) AS jobs_fetched, CAST(sum(c.errors) AS BIGINT) AS errors, count(c.run_id) AS categories_searched
    FROM source_run r LEFT JOIN run_category c USING (run_id) GROUP BY 1, 2, 3""",
)
def _run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Runs as they are logged, with the sums of their category rows."""
    runs = R.source_run(spark, sf).select("run_id", "source_id", "started_at", "status", "mode")
    return op.with_totals(runs, R.run_category(spark, sf)).select("run_id", "source_id", "mode", *op.TOTALS, "categories_searched")


@query(
    "source_top3_runs",
    with_("source_run")
    + """SELECT source_id, run_id, rn AS recency FROM (SELECT source_id, run_id, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM source_run) WHERE rn <= 3""",
)
def _recent(spark: SparkSession, sf: str) -> DataFrame:
    """The three newest runs of each source."""
    return op.newest(R.source_run(spark, sf), 3, "source_id", "started_at", "run_id").select("source_id", "run_id", "recency")


@query(
    "source_run_spans",
    with_("source_run")
    + """,
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM source_run)
    SELECT source_id, count(*) AS n_runs, CAST(floor((epoch(max(started_at)) - epoch(min(started_at))) / 3600) AS BIGINT) AS span_hours FROM r WHERE rn <= 20 GROUP BY 1
    """,
)
def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Hours between the first and last of a source's latest 20 runs."""
    runs = op.newest(R.source_run(spark, sf), 20, "source_id", "started_at", "run_id")
    return runs.groupBy("source_id").agg(F.count("*").alias("n_runs"), F.timestamp_diff("HOUR", F.min("started_at"), F.max("started_at")).alias("span_hours"))
