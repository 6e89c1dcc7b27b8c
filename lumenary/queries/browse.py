"""Queries that serve users: lists, pages, boards and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.bindings import relations as R
from lumenary.bindings.ctes import NOW, with_
from lumenary.functions.phrases import band, experience
from lumenary.functions.variant import strings_at
from lumenary.operators import serve as op
from lumenary.operators.classify import benchmark
from lumenary.operators.keyset import page
from lumenary.queries.classify import _PAY, _TAGS, tagged
from lumenary.queries.register import query

_TAGGED = {"tagged": _TAGS}


@query(
    "jobs_browse_filters",
    with_("job", "source", more=_TAGGED)
    + """SELECT job_id, title, company, tier FROM tagged JOIN source USING (source_id) WHERE status = 'ACTIVE' AND contains(location_class, 'REMOTE') AND list_contains(tags, 'tech')
    AND tier = 'INTERNATIONAL' AND (contains(lower(title), 'developer') OR contains(lower(company), 'developer') OR contains(lower(description), 'developer') OR len(list_filter(skills, lambda s: contains(lower(s), 'developer'))) > 0)""",
)
def _browse(spark: SparkSession, sf: str) -> DataFrame:
    sources = R.source(spark, sf)
    # The filter takes the class that the posting came with.
    jobs = tagged(spark, sf).drop("location_class").withColumnRenamed("given_class", "location_class")
    found = op.browse(jobs, sources, q="Developer", tag="tech", tier="INTERNATIONAL", work_place="REMOTE")
    return found.join(F.broadcast(sources.select("source_id", "tier")), "source_id").select("job_id", "title", "company", "tier")


@query(
    "job_view",
    with_("job", "source", "match", "application")
    + """SELECT j.job_id, j.title, s.tier, array_to_string(list_sort(list_distinct(skills)), ',') AS skills, coalesce(m.n, 0) AS n_matches, m.best, coalesce(a.n, 0) AS n_saved FROM job j LEFT JOIN source s USING (source_id)
    LEFT JOIN (SELECT job_id, count(*) AS n, max(score) AS best FROM match GROUP BY 1) m USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS n FROM application GROUP BY 1) a USING (job_id)""",
)
def _view(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with source, skills, matches and applications; the many sides are counted before they are joined."""
    matches = R.match(spark, sf).groupBy("job_id").agg(F.count("*").alias("n_matches"), F.max("score").alias("best"))
    saved = R.application(spark, sf).groupBy("job_id").agg(F.count("*").alias("n_saved"))
    jobs = R.job(spark, sf).join(R.source(spark, sf).select("source_id", "tier"), "source_id", "left").join(matches, "job_id", "left").join(saved, "job_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return jobs.select("job_id", "title", "tier", F.array_join(F.array_sort(F.array_distinct("skills")), ",").alias("skills"), zero("n_matches"), "best", zero("n_saved"))


_NEWEST = "SELECT job_id, posted_at FROM job WHERE status = 'ACTIVE' ORDER BY posted_at DESC NULLS LAST, job_id DESC LIMIT 51"


@query("jobs_keyset_page1", with_("job") + _NEWEST)
def _page1(spark: SparkSession, sf: str) -> DataFrame:
    return page(R.job(spark, sf).where("status = 'ACTIVE'").select("job_id", "posted_at"), "posted_at", "job_id", 50)


@query("jobs_keyset_page2", with_("job") + "SELECT job_id, posted_at FROM job WHERE status = 'ACTIVE' ORDER BY posted_at DESC NULLS LAST, job_id DESC LIMIT 51 OFFSET 50")
def _page2(spark: SparkSession, sf: str) -> DataFrame:
    """The second page; the cursor is the last row of the first, one row on the driver as in any paging client."""
    rows = R.job(spark, sf).where("status = 'ACTIVE'").select("job_id", "posted_at")
    last = page(rows, "posted_at", "job_id", 50).collect()[:50][-1]
    return page(rows, "posted_at", "job_id", 50, (last.posted_at, last.job_id))


@query("jobs_page_total", with_("job") + "SELECT *, (SELECT count(*) FROM job WHERE status = 'ACTIVE') AS total FROM (" + _NEWEST + " OFFSET 50)")
def _page_total(spark: SparkSession, sf: str) -> DataFrame:
    """The second page with the number of all rows that the filters keep, whatever the cursor."""
    total = R.job(spark, sf).where("status = 'ACTIVE'").agg(F.count(F.lit(1))).scalar()
    return _page2(spark, sf).withColumn("total", total)


@query("jobs_keyset_deadline_nulls", with_("job") + "SELECT job_id, deadline FROM job WHERE (deadline IS NULL AND job_id > 30) OR deadline IS NOT NULL ORDER BY deadline NULLS FIRST, job_id LIMIT 101")
def _page_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """By deadline, postings without one first, from a cursor among these."""
    return page(R.job(spark, sf).select("job_id", "deadline"), "deadline", "job_id", 100, (None, 30), descending=False)


@query(
    "matches_banded",
    with_("match", "job")
    + """SELECT user_id, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 80 THEN 'Strong' WHEN score >= 70 THEN 'Good' WHEN score >= 60 THEN 'Possible' ELSE 'Weak' END AS band, count(*) AS n_matches, max(score) AS best
    FROM match SEMI JOIN (SELECT job_id FROM job WHERE status = 'ACTIVE') USING (job_id) GROUP BY 1, 2""",
)
def _banded(spark: SparkSession, sf: str) -> DataFrame:
    live = R.job(spark, sf).where("status = 'ACTIVE'").select("job_id")
    return R.match(spark, sf).join(live, "job_id", "left_semi").groupBy("user_id", band(F.col("score")).alias("band")).agg(F.count("*").alias("n_matches"), F.max("score").alias("best"))


@query("matches_unseen", with_("match", "notification") + "SELECT match_id, user_id, job_id, score FROM match ANTI JOIN notification USING (user_id, job_id)")
def _unseen(spark: SparkSession, sf: str) -> DataFrame:
    return op.unseen(R.match(spark, sf), R.notification(spark, sf)).select("match_id", "user_id", "job_id", "score")


@query(
    "dashboard_summary",
    with_("app_user", "match", "application", "notification")
    + f"""SELECT user_id, coalesce(m.n_good, 0) AS n_good, coalesce(a.n_saved, 0) AS n_saved, coalesce(a.n_in_flight, 0) AS n_in_flight, coalesce(n.n_unread, 0) AS n_unread, n.last_at FROM app_user
    LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE score >= 70) AS n_good FROM match GROUP BY 1) m USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE stage = 'SAVED') AS n_saved, count(*) FILTER (WHERE stage IN ('APPLIED', 'INTERVIEW', 'OFFER')) AS n_in_flight FROM application GROUP BY 1) a USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE status = 'SENT') AS n_unread, max(created_at) AS last_at FROM notification GROUP BY 1) n USING (user_id)""",
)
def _dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each user, each table counted before it is joined."""
    good = R.match(spark, sf).groupBy("user_id").agg(F.count_if(F.col("score") >= 70).alias("n_good"))
    apps = R.application(spark, sf).groupBy("user_id").agg(F.count_if(F.col("stage") == "SAVED").alias("n_saved"), F.count_if(F.col("stage").isin("APPLIED", "INTERVIEW", "OFFER")).alias("n_in_flight"))
    told = R.notification(spark, sf).groupBy("user_id").agg(F.count_if(F.col("status") == "SENT").alias("n_unread"), F.max("created_at").alias("last_at"))
    rows = R.app_user(spark, sf).select("user_id").join(good, "user_id", "left").join(apps, "user_id", "left").join(told, "user_id", "left")
    return rows.select("user_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_good", "n_saved", "n_in_flight", "n_unread")), "last_at")


@query(
    "application_board",
    with_("application", "match", "job")
    + """SELECT user_id, stage, count(*) AS n_jobs FROM (SELECT user_id, job_id, stage FROM application UNION ALL SELECT DISTINCT user_id, job_id, 'DISCOVERED' FROM match ANTI JOIN application USING (user_id, job_id) WHERE score >= 80)
    SEMI JOIN job USING (job_id) GROUP BY 1, 2""",
)
def _board(spark: SparkSession, sf: str) -> DataFrame:
    return op.board(R.application(spark, sf), R.match(spark, sf), R.job(spark, sf)).groupBy("user_id", "stage").agg(F.count("*").alias("n_jobs"))


@query(
    "notify_candidates",
    with_("match", "app_user", "job", "job_link", "notification")
    + """SELECT user_id, job_id, max(score) AS score FROM match JOIN app_user USING (user_id) ANTI JOIN notification USING (user_id, job_id)
    SEMI JOIN (SELECT job_id FROM job_link WHERE status = 'ACTIVE' AND (apply_method <> 'ONLINE_URL' OR url_status IS NULL OR url_status NOT IN ('NOT_FOUND', 'ERROR'))) USING (job_id) WHERE NOT paused AND score >= threshold GROUP BY 1, 2""",
)
def _notify(spark: SparkSession, sf: str) -> DataFrame:
    return op.deliverable(R.match(spark, sf), R.app_user(spark, sf), R.job_link(spark, sf), R.notification(spark, sf))


@query(
    "digest_report",
    with_("match", "search_profile", "job", "app_user")
    + f""",
    w AS (SELECT match.*, location_class, lower(title || ' ' || company || ' ' || array_to_string(skills, ' ')) AS said, posted_at FROM match JOIN job USING (job_id)),
    t AS (SELECT user_id, count(*) AS n_matches, count(*) FILTER (WHERE score >= 80) AS n_strong, count(*) FILTER (WHERE posted_at >= {NOW} - INTERVAL 24 HOUR) AS n_new FROM w GROUP BY 1),
    h AS (SELECT user_id, count(*) AS n_hits FROM w JOIN search_profile s USING (user_id) WHERE (NOT s.remote OR contains(location_class, 'REMOTE')) AND contains(said, lower(s.q)) AND score >= CASE s.tier WHEN 'HIGH' THEN 80 WHEN 'MEDIUM' THEN 70 WHEN 'LOW' THEN 60 ELSE 0 END GROUP BY 1),
    b AS (SELECT user_id, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY rn) AS top_jobs FROM (SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id, match_id) AS rn FROM w) WHERE rn <= 8 GROUP BY 1)
    SELECT t.*, coalesce(n_hits, 0) AS n_hits, top_jobs FROM t LEFT JOIN h USING (user_id) LEFT JOIN b USING (user_id)
    """,
)
def _digest(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a user's day, hits of the saved search and the best eight."""
    jobs = R.job(spark, sf)
    matches = R.match(spark, sf).join(jobs.select("job_id", "posted_at"), "job_id")
    totals = matches.groupBy("user_id").agg(
        F.count("*").alias("n_matches"), F.count_if(F.col("score") >= 80).alias("n_strong"), F.count_if(F.col("posted_at") >= F.timestamp_add("HOUR", F.lit(-24), R.now())).alias("n_new")
    )
    hits = op.search_hits(R.search_profile(spark, sf), matches, jobs).groupBy("user_id").agg(F.count("*").alias("n_hits"))
    top = op.digest_top(matches).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "job_id"))), lambda x: x["job_id"].cast("string")), ",").alias("top_jobs"))
    return totals.join(hits, "user_id", "left").join(top, "user_id", "left").select("user_id", "n_matches", "n_strong", "n_new", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "top_jobs")


@query(
    "profile_completion",
    with_("app_user")
    + """SELECT user_id, CAST(least(30, len(skills) * 10) + least(20, (len(role1) + len(role2)) * 10) + CASE WHEN home_tier IS NOT NULL OR remote_tier IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN years > 0 THEN 15 ELSE 0 END
    + CASE WHEN min_salary > 0 THEN 10 ELSE 0 END + CASE WHEN len(employment_types) > 0 THEN 10 ELSE 0 END AS INTEGER) AS completion FROM app_user""",
)
def _completion(spark: SparkSession, sf: str) -> DataFrame:
    users = R.app_user(spark, sf)
    return users.select("user_id", op.completion(users).alias("completion"))


@query("match_threshold_preview", with_("match", "app_user") + "SELECT user_id, threshold, count(*) FILTER (WHERE score >= threshold) AS n_over, count(*) FILTER (WHERE score >= threshold + 10) AS n_stricter FROM match JOIN app_user USING (user_id) GROUP BY 1, 2")
def _preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.match(spark, sf).join(R.app_user(spark, sf).select("user_id", "threshold"), "user_id")
    over = lambda more: F.count_if(F.col("score") >= F.col("threshold") + more)
    return rows.groupBy("user_id", "threshold").agg(over(0).alias("n_over"), over(10).alias("n_stricter"))


@query("latest_notifications", with_("notification") + "SELECT notification_id, user_id, channel, created_at FROM notification ORDER BY created_at DESC, notification_id DESC LIMIT 30")
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty newest, a top-k."""
    return R.notification(spark, sf).select("notification_id", "user_id", "channel", "created_at").orderBy(F.desc("created_at"), F.desc("notification_id")).limit(30)


@query(
    "job_nested",
    with_(
        "job", "source", "match", "application",
        more={
            "roles": _PAY["roles"], "bench": _PAY["bench"],
            "j": _PAY["j"], "p": "SELECT j.job_id, arg_min(b, CASE WHEN b.level = want THEN n ELSE 100 + n END) AS b FROM j LEFT JOIN bench b ON b.role = j.role GROUP BY 1",
            "f": "SELECT user_id, job_id, arg_min(struct_pack(match_id, score), match_id) AS m FROM match GROUP BY 1, 2",
            "a": "SELECT user_id, job_id, bool_or(stage = 'SAVED') AS saved, arg_min(struct_pack(stage, version), application_id) AS app FROM application GROUP BY 1, 2",
        },
    )
    + """SELECT f.user_id, f.job_id, CAST(json_object('title', title, 'company', company, 'source', json_object('id', source_id, 'tier', tier), 'skills', skills, 'status', status, 'saved', coalesce(saved, FALSE),
      'application', CASE WHEN app IS NOT NULL THEN json_object('stage', app.stage, 'version', app.version) END, 'match', json_object('match_id', m.match_id, 'score', m.score),
      'benchmark', CASE WHEN p.b.role IS NOT NULL THEN json_object('role', p.b.role, 'level', p.b.level, 'mid', p.b.lm) END) AS VARCHAR) AS view
    FROM f JOIN job USING (job_id) LEFT JOIN source USING (source_id) LEFT JOIN a ON a.user_id = f.user_id AND a.job_id = f.job_id LEFT JOIN p ON p.job_id = f.job_id""",
)
def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Users' matched postings as they are served, as JSON."""
    pay = benchmark(F.col("title"), experience(F.col("title")))
    jobs = R.job(spark, sf).drop("description").withColumn("b", pay).withColumn("benchmark", F.when(F.col("b").isNotNull(), F.struct("b.role", "b.level", F.col("b.local_mid").alias("mid"))))
    found = op.nested_jobs(R.match(spark, sf), jobs, R.source(spark, sf), R.application(spark, sf))
    return found.select("user_id", "job_id", F.to_json("view", {"ignoreNullFields": "false"}).alias("view"))


@query(
    "profile_assembled",
    with_("app_user")
    + """SELECT user_id, CAST(to_json(skills) AS VARCHAR) AS skills, CAST(to_json(list_concat(list_transform(role1, lambda r: {'role': r, 'priority': priority1}), list_transform(role2, lambda r: {'role': r, 'priority': 'LOW'}))) AS VARCHAR) AS target_roles,
      array_to_string(list_sort(list_filter([CASE WHEN home_tier IS NOT NULL THEN 'Ethiopia=' || home_tier END, CASE WHEN city_tier IS NOT NULL THEN 'addis_ababa=' || city_tier END, CASE WHEN remote_tier IS NOT NULL THEN 'Remote=' || remote_tier END, region || '=' || region_tier], lambda x: x IS NOT NULL)), ',') AS tiers FROM app_user""",
)
def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles put together from a row for each skill, role and region."""
    users = R.app_user(spark, sf)
    skills = users.select("user_id", F.posexplode("skills").alias("ord", "skill"))
    roles = users.select("user_id", F.posexplode("role1").alias("ord", "role"), F.col("priority1").alias("priority")).unionByName(users.select("user_id", F.posexplode("role2").alias("ord", "role"), F.lit("LOW").alias("priority")).withColumn("ord", F.col("ord") + 1))
    named = {"Ethiopia": "home_tier", "addis_ababa": "city_tier", "Remote": "remote_tier"}
    places = F.array(*(F.struct(F.lit(k).alias("region"), F.col(c).alias("tier")) for k, c in named.items()), F.struct("region", F.col("region_tier").alias("tier")))
    locations = users.select("user_id", F.inline(places)).where("tier IS NOT NULL")
    found = op.assembled_profiles(users.select("user_id"), skills, roles, locations)
    tiers = F.array_join(F.array_sort(F.transform(F.map_entries("location_tiers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return found.select("user_id", F.to_json("skills").alias("skills"), F.to_json("target_roles").alias("target_roles"), tiers.alias("tiers"))


_RAW = {0: """'{"sourceCategories":' || to_json(labels) || '}'""", 1: """'{"sourceCategories":"' || labels[1] || '","x":[1]}'""", 2: """'{"meta":{"sourceCategories":["' || labels[2] || '",7,{"a":1},null]}}'""", 3: "'{\"sourceCategories\":' || job_id || '}'", 4: "'{\"sourceCategories\":{\"a\":[1]}}'", 5: "'no json'"}


@query(
    "raw_data_pick",
    with_("job") + "SELECT job_id, CASE job_id % 6 WHEN 0 THEN array_to_string(labels, '|') WHEN 1 THEN labels[1] WHEN 2 THEN labels[2] || '|7' WHEN 3 THEN CAST(job_id AS VARCHAR) ELSE '' END AS categories FROM job",
)
def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Source categories out of raw data of six shapes."""
    raw = f"CASE job_id % 6 {' '.join(f'WHEN {k} THEN {e}' for k, e in _RAW.items())} END".replace("labels[1]", "get(labels, 0)").replace("labels[2]", "get(labels, 1)")
    rows = R.job(spark, sf).select("job_id", F.expr(raw).alias("raw"))
    return rows.select("job_id", F.array_join(strings_at(F.col("raw"), "$.sourceCategories", "$.meta.sourceCategories"), "|").alias("categories"))
