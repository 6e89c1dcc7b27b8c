"""The domain relations of ``lumenary.bindings.relations`` as SQL common table expressions."""

from __future__ import annotations

from lumenary.bindings import relations as R


def listed(words) -> str:
    return "[" + ", ".join("'" + str(w).replace("'", "''") + "'" if isinstance(w, str) else str(w) for w in words) + "]"


def pick(words, at: str) -> str:
    return f"{listed(words)}[CAST(({at}) % {len(words)} AS BIGINT) + 1]"


NOW = f"TIMESTAMP '{R.AS_OF}'"

_JOB = f"""
SELECT d.doc_id AS job_id, d.source AS source_id, CAST(d.doc_id // 40 AS VARCHAR) AS source_job_id,
       {pick(R.LEVEL_WORDS, 'd.doc_id // 16')} || {pick(R.TITLE_ROLES, 'p_partkey')} || ' - ' || p_type AS title,
       s_name || {pick(R.SUFFIXES, 'd.doc_id')} AS company,
       CASE WHEN d.doc_id % 4 = 0 THEN 'Addis Ababa, Ethiopia' WHEN d.doc_id % 7 = 0 THEN 'Remote' ELSE n_name END AS location,
       n_name AS country, {pick(R.LOCATION_CLASSES, 'd.doc_id')} AS location_class, {pick(R.WORK_PLACES, 'd.doc_id // 4')} AS work_place,
       {pick(R.EMPLOYMENT, 'd.doc_id // 3')} AS employment_type,
       CASE WHEN d.doc_id % 5 = 0 THEN 0 WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS BIGINT) END AS salary,
       CASE WHEN d.doc_id % 13 <> 0 THEN {pick(R.MONEY, 'd.doc_id')} END AS currency,
       CAST(30 + d.doc_id * 11 % 70 AS INTEGER) AS parse_confidence, {pick(R.STATUSES, 'd.doc_id')} AS status,
       CAST(d.doc_id // 10 % 5 AS INTEGER) AS missed_cycles,
       [{pick(R.LABELS, 'd.doc_id')}, {pick(R.LABELS, 'd.doc_id // 8')}] AS labels,
       list_transform(range(1, d.doc_id % 6 + 1), lambda k: {pick(R.RAW_SKILLS, 'd.doc_id * 7 + k * k * 3 + k')}) AS skills,
       d.text AS description,
       {NOW} - INTERVAL 2000 HOUR + to_hours(CAST(d.doc_id * 37 % 2000 AS INTEGER)) AS posted_at,
       CASE WHEN d.doc_id % 3 > 0 THEN {NOW} + to_days(CAST(d.doc_id * 13 % 60 - 20 AS INTEGER)) END AS deadline,
       {NOW} - INTERVAL 2000 HOUR + to_hours(CAST(d.doc_id * 37 % 2000 + d.doc_id * 7 % 48 AS INTEGER)) AS first_seen_at
FROM documents d JOIN part ON p_partkey = d.doc_id % (SELECT count(*) FROM part)
JOIN supplier ON s_suppkey = d.doc_id % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey
"""

CTES = {
    "job": _JOB,
    "source": f"""
SELECT source_id, number, {pick(R.TIERS, 'number')} AS tier, {pick(R.FREQUENCIES, 'number')} AS frequency_min,
       CASE number % 3 WHEN 0 THEN ['ethiopian', 'ngo'] WHEN 1 THEN ['remote'] ELSE CAST([] AS VARCHAR[]) END AS default_tags,
       {pick(R.LOCATION_CLASSES, 'number')} AS default_location_class
FROM (SELECT DISTINCT source AS source_id, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS number FROM documents)
""",
    "job_link": f"""
SELECT *, {pick(R.APPLY_METHODS, 'job_id // 5')} AS apply_method, CASE WHEN job_id % 4 > 0 THEN {pick(R.URL_STATUSES, 'job_id // 3')} END AS url_status FROM job
""",
    "source_run": """
SELECT 'src' || user_id AS source_id, event_id AS run_id, ts AS started_at, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'OK' END AS status,
       CASE WHEN event_id // 7 % 2 = 0 THEN 'FAST' ELSE 'DEEP' END AS mode, CAST(floor(value) AS BIGINT) AS jobs_fetched,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS quality, event_id % 9 AS link_checks, event_id % 9 % 4 AS link_failures
FROM events
""",
    "run_category": f"""
SELECT run_id, source_id, lower({pick(R.LABELS, 'run_id + k')}) AS category, run_id * (k + 1) % 7 + 1 AS pages_fetched, run_id * (k + 3) % 50 AS jobs_fetched,
       CAST(CASE WHEN run_id % 5 = 0 THEN k ELSE 0 END AS BIGINT) AS errors, {pick(R.STOPPED, 'run_id + k')} AS stopped_reason
FROM source_run, (SELECT unnest(range(3)) AS k)
""",
    "app_user": f"""
SELECT c_custkey AS user_id, CAST(55 + c_custkey % 4 * 5 AS INTEGER) AS threshold,
       CASE c_custkey % 20 WHEN 3 THEN 'DORMANT' WHEN 7 THEN 'DISABLED' ELSE 'ACTIVE' END AS status, c_custkey % 8 = 5 AS paused,
       CAST(c_custkey % 9 AS INTEGER) AS years, CAST(floor(abs(c_acctbal)) AS BIGINT) % 2000 AS min_salary,
       c_custkey % 6 = 0 AS remote, c_custkey % 5 = 0 AS exclude_onsite, c_custkey % 7 = 0 AS exclude_entry,
       CASE WHEN c_custkey % 10 <> 9 THEN [{pick(R.USER_ROLES, 'c_custkey')}] ELSE CAST([] AS VARCHAR[]) END AS role1,
       CASE WHEN c_custkey % 4 = 1 AND c_custkey % 10 <> 9 THEN [{pick(R.USER_ROLES, 'c_custkey + 5')}] ELSE CAST([] AS VARCHAR[]) END AS role2,
       {pick(R.PRIORITIES, 'c_custkey')} AS priority1,
       list_transform(range(1, c_custkey % 4 + 1), lambda k: {pick(R.RAW_SKILLS, 'c_custkey * 5 + k * 7')}) AS skills,
       CASE c_custkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END AS home_tier, CASE WHEN c_custkey % 4 = 2 THEN 'LOW' END AS city_tier,
       CASE WHEN c_custkey % 2 = 0 THEN 'HIGH' WHEN c_custkey % 5 = 1 THEN 'LOW' END AS remote_tier,
       'NATION_' || c_nationkey AS region, {pick(R.PRIORITIES, 'c_nationkey')} AS region_tier,
       [{pick(R.EMPLOYMENT, 'c_custkey')}, {pick(R.EMPLOYMENT, 'c_custkey + 1')}] AS employment_types,
       {NOW} - INTERVAL 1500 HOUR + to_hours(CAST(c_custkey * 29 % 1500 AS INTEGER)) AS last_active_at
FROM customer
""",
    "match": """
SELECT o_orderkey AS match_id, o_custkey AS user_id, o_orderkey % (SELECT count(*) FROM documents) AS job_id,
       CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INTEGER) AS score FROM orders
""",
    "notification": f"""
SELECT o_orderkey AS notification_id, o_custkey AS user_id, (o_orderkey + o_custkey % 2) % (SELECT count(*) FROM documents) AS job_id,
       CASE WHEN o_orderpriority < '3' THEN 'TELEGRAM' ELSE 'IN_APP' END AS channel,
       CASE o_orderstatus WHEN 'F' THEN 'SENT' WHEN 'O' THEN 'READ' ELSE 'FAILED' END AS status,
       {NOW} - INTERVAL 4000 HOUR + to_hours(CAST(o_orderkey * 17 % 4000 AS INTEGER)) AS created_at FROM orders
""",
    "application": f"""
SELECT o_orderkey AS application_id, o_custkey AS user_id, o_orderkey * 7 % (SELECT count(*) FROM documents) AS job_id,
       {pick(R.STAGES, 'o_orderkey // 5')} AS stage, CAST(o_orderkey % 3 + 1 AS INTEGER) AS version FROM orders
""",
    "transition": f"""
SELECT event_id AS transition_id, user_id AS application_id,
       CASE event_type {' '.join(f"WHEN '{e}' THEN '{s}'" for e, s in R.EVENT_STAGES)} END AS to_stage, ts AS moved_at FROM events
""",
    "search_profile": f"""
SELECT c_custkey AS user_id, {pick(R.KEYWORDS, 'c_custkey')} AS q, CASE WHEN c_custkey % 4 > 0 THEN {pick(R.PRIORITIES, 'c_custkey // 2')} END AS tier,
       c_custkey % 3 = 0 AS remote FROM customer
""",
    "seen_in_run": "SELECT DISTINCT doc_id AS job_id FROM labels",
}


def with_(*names: str, more: dict[str, str] | None = None) -> str:
    """``WITH`` the named relations, then the further ones."""
    parts = {n: CTES[n] for n in names} | (more or {})
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + "\n"
