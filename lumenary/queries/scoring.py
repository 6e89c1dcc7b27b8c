"""Queries about skills, roles and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary import dims
from lumenary.bindings import relations as R
from lumenary.bindings.ctes import NOW, with_
from lumenary.functions.phrases import experience
from lumenary.operators import matching
from lumenary.operators import skills as op
from lumenary.queries.register import query
from lumenary.storage import Workspace, result, workspace

_NAMES = {s.lower(): s for s in dims.SKILLS} | dims.ALIASES
_LEVEL = """CASE WHEN regexp_matches(lower(title), '\\b(intern|graduate|trainee|apprentice)\\b') THEN 'INTERN'
WHEN regexp_matches(lower(title), '\\b(junior|entry|associate|i)\\b') AND NOT regexp_matches(lower(title), '\\b(senior|lead)\\b') THEN 'ENTRY'
WHEN regexp_matches(lower(title), '\\b(principal|head|director|vp|chief|staff)\\b') THEN 'LEAD' WHEN regexp_matches(lower(title), '\\b(senior|lead|sr)\\b') THEN 'SENIOR' ELSE 'UNKNOWN' END"""
_WORDS = lambda x: f"(' ' || trim(regexp_replace(lower({x}), '[^a-z0-9+#.]+', ' ', 'g')) || ' ')"
_CORES = [(r, i, len(c), s) for i, (r, c) in enumerate(dims.ROLE_CORES.items()) for s in c]
_PHRASES = [(r, i, p) for i, r in enumerate(dims.ROLE_CORES) for p in dims.ROLE_SYNONYMS.get(r, (r,))]

#: Skills and roles of users and postings, and what they have to do with one another.
_BASE = {
    "names": f"SELECT * FROM {dims.values(_NAMES.items(), 'low, name')}",
    "transfer": f"SELECT * FROM {dims.values(dims.transfer_pairs(), 'a, b, t, rel')}",
    "us": "SELECT DISTINCT user_id, coalesce(name, trim(s)) AS skill FROM (SELECT user_id, unnest(skills) AS s FROM app_user) LEFT JOIN names ON low = lower(trim(s))",
    "js": "SELECT DISTINCT job_id, coalesce(name, trim(s)) AS skill FROM (SELECT job_id, unnest(skills) AS s FROM job) LEFT JOIN names ON low = lower(trim(s))",
    "reach": "SELECT user_id, skill, 1.0 AS t, TRUE AS same, FALSE AS rel FROM us UNION ALL SELECT user_id, b, t, FALSE, rel FROM us JOIN transfer ON a = skill",
    "sig": "SELECT user_id, job_id, js.skill, bool_or(same) AS same, max(t) AS t, bool_or(rel) AS rel FROM js JOIN reach ON lower(js.skill) = lower(reach.skill) AND (NOT same OR lower(js.skill) = lower(reach.skill)) GROUP BY ALL",
    "kinds": "SELECT *, CASE WHEN same THEN 'direct' WHEN t >= 0.6 THEN 'transferable' WHEN rel THEN 'related' END AS kind, CASE WHEN same THEN 1.0 WHEN t >= 0.6 THEN t ELSE 0.3 END AS earned FROM sig WHERE same OR t >= 0.6 OR rel",
    "bys": "SELECT user_id, job_id, sum(CAST(round(earned * 1e6) AS BIGINT)) AS earned, count(*) AS n, count(*) FILTER (WHERE kind = 'direct') AS n_direct, count(*) FILTER (WHERE kind = 'transferable') AS n_transferable, count(*) FILTER (WHERE kind = 'related') AS n_related, string_agg(skill, ', ' ORDER BY skill) FILTER (WHERE kind = 'transferable') AS transferable, string_agg(skill, ', ' ORDER BY skill) FILTER (WHERE kind = 'related') AS related FROM kinds GROUP BY ALL",
    "wants": """SELECT user_id, 0 AS ord, trim(replace(regexp_replace(lower(role1[1]), '["'']', '', 'g'), '_', ' ')) AS role, priority1 AS priority FROM app_user WHERE len(role1) > 0
      UNION ALL SELECT user_id, 1, trim(replace(regexp_replace(lower(role2[1]), '["'']', '', 'g'), '_', ' ')), 'LOW' FROM app_user WHERE len(role2) > 0""",
    "syn": f"SELECT * FROM {dims.values(dims.role_phrases(), 'role, phrase')}",
    "core": f"SELECT * FROM {dims.values(_CORES, 'role, ord, n, skill')}",
    "sim": f"""SELECT t.title, r.role, max(CASE WHEN contains({_WORDS('title')}, {_WORDS('r.role')}) THEN CAST(1.0 AS DOUBLE) WHEN s.phrase IS NOT NULL AND contains({_WORDS('title')}, {_WORDS('s.phrase')}) THEN 0.75
      WHEN len(list_filter(string_split({_WORDS('title')}, ' '), lambda w: length(w) > 3 AND (contains(lower(c.skill), w) OR contains(w, lower(c.skill))))) > 0 THEN 0.35 ELSE 0.0 END) AS similarity
      FROM (SELECT DISTINCT title FROM job) t CROSS JOIN (SELECT DISTINCT role FROM wants) r LEFT JOIN syn s ON s.role = r.role LEFT JOIN core c ON c.role = r.role GROUP BY ALL HAVING similarity > 0""",
    "byr": f"""SELECT user_id, job_id, max_by(role, (w, -ord)) AS role_target, max_by(priority, (w, -ord)) AS role_priority, max(w) AS w FROM (SELECT user_id, job_id, role, ord, priority, similarity * CASE priority WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.72 ELSE 0.45 END AS w
      FROM wants JOIN sim USING (role) JOIN job USING (title)) GROUP BY 1, 2""",
    "prof": f"""SELECT title, min_by(role, ord) AS role FROM (SELECT DISTINCT title FROM job) JOIN (SELECT * FROM {dims.values(_PHRASES, 'role, ord, phrase')}) ON contains({_WORDS('title')}, {_WORDS('phrase')}) GROUP BY 1""",
    "cover": "SELECT user_id, role, count(DISTINCT core.skill) / CAST(max(n) AS DOUBLE) AS coverage FROM core JOIN us ON us.skill = core.skill OR EXISTS (SELECT 1 FROM transfer WHERE a = us.skill AND b = core.skill AND rel) GROUP BY 1, 2",
}
_PARTS = f"""SELECT u.user_id, j.job_id, j.title, n_skills, role_target, greatest(coalesce(w, 0.0), coalesce(CASE WHEN coverage > 0.5 THEN coverage END * 0.8, 0.0)) AS role_part,
  CASE WHEN n_skills > 0 THEN coalesce(earned, 0) / 1e6 / n_skills ELSE 0.4 END AS skill_part, coalesce(n, 0) AS n_signals, coalesce(n_direct, 0) AS n_direct, coalesce(n_transferable, 0) AS n_transferable, coalesce(n_related, 0) AS n_related,
  CASE WHEN level IN ('ENTRY', 'INTERN') THEN 1.0 ELSE least(1.0, greatest(0.3, years / CAST(need AS DOUBLE))) END AS experience_part,
  CASE location_class WHEN 'ETHIOPIA_LOCAL' THEN home WHEN 'ETHIOPIA_REMOTE' THEN greatest(home, away) WHEN 'INTERNATIONAL_REMOTE' THEN away ELSE CASE WHEN country = region THEN CASE region_tier WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.62 ELSE 0.38 END ELSE 0.12 END END AS location_part,
  CASE WHEN list_contains(employment_types, employment_type) THEN 1.0 ELSE 0.35 END AS employment_part,
  greatest(0.05, exp(-(epoch({NOW}) - epoch(posted_at)) / 3600.0 / 72)) AS freshness_part,
  CASE WHEN salary IS NULL OR salary = 0 THEN 0.55 WHEN salary >= min_salary THEN 1.0 ELSE greatest(0.2, salary / CAST(greatest(1, min_salary) AS DOUBLE)) END AS salary_part,
  (remote AND work_place = 'ONSITE') OR (exclude_onsite AND work_place = 'ONSITE' AND NOT contains(location_class, 'LOCAL')) OR (exclude_entry AND level IN ('ENTRY', 'INTERN')) AS excluded,
  coalesce(CASE WHEN coverage > 0.5 THEN coverage END, 0.0) AS cov, role_priority, transferable, related, need, level, location_class, (epoch({NOW}) - epoch(posted_at)) / 3600.0 AS hours,
  list_filter([CASE WHEN remote AND work_place = 'ONSITE' THEN 'On-site role, you only want remote work' END, CASE WHEN exclude_onsite AND work_place = 'ONSITE' AND NOT contains(location_class, 'LOCAL') THEN 'International on-site role, you excluded on-site work' END,
    CASE WHEN exclude_entry AND level IN ('ENTRY', 'INTERN') THEN 'Entry-level role, you hide entry-level jobs' END], lambda x: x IS NOT NULL) AS why_not,
  parse_confidence, years, regexp_matches(lower(j.title), '\\b(senior|lead|principal|head)\\b') AND years < 4 AS too_senior, coalesce(pen, 0) AS negative
FROM app_user_x u CROSS JOIN job_x j LEFT JOIN bys USING (user_id, job_id) LEFT JOIN byr USING (user_id, job_id) LEFT JOIN prof ON prof.title = j.title LEFT JOIN cover ON cover.user_id = u.user_id AND cover.role = prof.role
LEFT JOIN pens ON pens.user_id = u.user_id AND pens.title = j.title
WHERE greatest(coalesce(w, 0.0), coalesce(CASE WHEN coverage > 0.5 THEN coverage END * 0.8, 0.0)) >= 0.5 OR coalesce(n, 0) >= 2"""
_NEGATIVE = [(r, i, w, c, p) for i, (r, (w_, c_)) in enumerate(dims.NEGATIVE.items()) for w, c in [("|".join(w_), "|".join(c_))] for p in dims.ROLE_SYNONYMS.get(r, (r,))]
_ALL = _BASE | {
    "job_x": f"SELECT *, {_LEVEL} AS level, CASE {_LEVEL} WHEN 'ENTRY' THEN 1 WHEN 'MID' THEN 3 WHEN 'SENIOR' THEN 5 WHEN 'LEAD' THEN 7 WHEN 'INTERN' THEN 0 ELSE 2 END AS need, (SELECT count(*) FROM js WHERE js.job_id = job.job_id) AS n_skills FROM job",
    "app_user_x": """SELECT *, CASE coalesce(home_tier, city_tier) WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.62 WHEN 'LOW' THEN 0.38 ELSE 0.12 END AS home,
      CASE remote_tier WHEN 'HIGH' THEN 1.0 WHEN 'LOW' THEN 0.38 ELSE 0.12 END AS away FROM app_user""",
    "neg": f"SELECT * FROM {dims.values(_NEGATIVE, 'role, ord, weak, core, phrase')}",
    "pens": """SELECT title, user_id, min_by(pen, ord) AS pen FROM (SELECT title, neg.role, ord, user_id, count(DISTINCT CASE WHEN list_contains(string_split(weak, '|'), us.skill) THEN us.skill END) AS nw,
      count(DISTINCT CASE WHEN list_contains(string_split(core, '|'), us.skill) THEN us.skill END) AS nc, least(20, 4 * nw) AS pen FROM (SELECT DISTINCT title FROM job) JOIN neg ON contains(lower(title), phrase), us GROUP BY ALL) WHERE nw > 2 AND nc < 2 GROUP BY 1, 2""",
    "parts": _PARTS,
    "scored": """SELECT *, CASE WHEN excluded THEN 0 ELSE CAST(least(100, greatest(0, floor(round(p * CASE WHEN parse_confidence < 40 THEN 0.9 ELSE 1 END, 9) + 0.5))) AS INTEGER) END AS score
      FROM (SELECT *, 25 * role_part + 30 * skill_part + 15 * experience_part + 15 * location_part + 5 * employment_part + 5 * freshness_part + 5 * salary_part - negative - CASE WHEN too_senior THEN 5 ELSE 0 END AS p FROM parts)""",
}


def _part(*names: str) -> str:
    return with_("job", "app_user", more={n: _ALL[n] for n in names})


_EVERY = with_("job", "app_user", more=_ALL)


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return R.job(spark, sf).withColumn("experience_level", experience(F.col("title")))


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Users with their target roles and location tiers as the scorer takes them."""
    role = lambda c, p: F.transform(c, lambda r: F.struct(r.alias("role"), p.alias("priority")))
    tier = lambda k, v: F.struct(k.alias("key"), F.col(v).alias("value"))
    tiers = F.filter(F.array(tier(F.lit(dims.HOME), "home_tier"), tier(F.lit("addis_ababa"), "city_tier"), tier(F.lit("Remote"), "remote_tier"), tier(F.col("region"), "region_tier")), lambda e: e["value"].isNotNull())
    return R.app_user(spark, sf).withColumns({"target_roles": F.concat(role("role1", F.col("priority1")), role("role2", F.lit("LOW"))), "location_tiers": F.map_from_entries(tiers)})


@query("skill_normalize", _part("names", "us", "js") + "SELECT skill, count(DISTINCT job_id) AS n_jobs, count(DISTINCT user_id) AS n_users FROM (SELECT skill, job_id, NULL AS user_id FROM js UNION ALL SELECT skill, NULL, user_id FROM us) GROUP BY 1")
def _normalize(spark: SparkSession, sf: str) -> DataFrame:
    """How many postings want and users offer each canonical skill."""
    want = R.job(spark, sf).select(F.explode(op.canonical_all(F.col("skills"))).alias("skill")).groupBy("skill").agg(F.count("*").alias("n_jobs"))
    offer = R.app_user(spark, sf).select(F.explode(op.canonical_all(F.col("skills"))).alias("skill")).groupBy("skill").agg(F.count("*").alias("n_users"))
    return want.join(offer, "skill", "full").select("skill", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"), F.coalesce("n_users", F.lit(0)).alias("n_users"))


@query("skill_transfer", _part("names", "transfer", "us", "js", "reach", "sig", "kinds") + "SELECT skill, kind, count(*) AS n_pairs, CAST(sum(CAST(round(earned * 1e6) AS BIGINT)) AS BIGINT) AS earned_millionths FROM kinds GROUP BY 1, 2")
def _transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of user and posting by wanted skill and kind of evidence."""
    wanted = R.job(spark, sf).select("job_id", F.explode(op.canonical_all(F.col("skills"))).alias("skill"))
    offered = R.app_user(spark, sf).select("user_id", F.explode(op.canonical_all(F.col("skills"))).alias("skill"))
    return op.skill_sums(wanted, offered, spark)


@query("role_similarity", _part("wants", "syn", "core", "sim") + "SELECT title, role, similarity FROM sim")
def _similarity(spark: SparkSession, sf: str) -> DataFrame:
    roles = users(spark, sf).select(F.explode("target_roles").alias("t")).select(op.role_key(F.col("t.role")).alias("role"))
    return op.role_similarity(R.job(spark, sf).select("title"), roles, spark)


@query("role_profile", _part("names", "transfer", "us", "core", "prof", "cover") + "SELECT job_id, user_id, prof.role, coverage FROM job JOIN prof USING (title) JOIN cover ON cover.role = prof.role WHERE coverage > 0.5")
def _profile(spark: SparkSession, sf: str) -> DataFrame:
    """Users with most of the core skills of the role that a posting's title names."""
    offered = R.app_user(spark, sf).select("user_id", F.explode(op.canonical_all(F.col("skills"))).alias("skill"))
    named = R.job(spark, sf).select("job_id", op.title_profile(F.col("title")).alias("role")).where("role IS NOT NULL")
    return op.profile_pairs(named, op.profile_coverage(offered, spark).where("coverage > 0.5"))


def _pairs(spark: SparkSession, sf: str, texts: bool = False) -> DataFrame:
    """Every relevant pair, scored. The tables it reads, of one side or of signatures, stay; pairs are made as they are read and not written."""
    return matching.relevant_pairs(jobs(spark, sf).drop("description"), users(spark, sf), R.now(), Workspace(spark), texts=texts)


@query("match_candidates", _EVERY + "SELECT user_id, job_id, n_direct, n_transferable, n_related, round(role_part, 6) AS role_part, round(skill_part, 6) AS skill_part FROM parts")
def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that pass the relevance gate. The tables of signatures that it reads stay; pairs are made as they are read."""
    columns = ["n_direct", "n_transferable", "n_related", *(F.round(p, 6).alias(p) for p in ("role_part", "skill_part"))]
    pairs = matching.evidence_pairs(jobs(spark, sf).drop("description"), users(spark, sf), Workspace(spark), *columns)
    return pairs.select("user_id", "job_id", "n_direct", "n_transferable", "n_related", "role_part", "skill_part")


_FACTORS = ("role_part", "skill_part", "experience_part", "location_part", "employment_part", "freshness_part", "salary_part")


@query("score_factors", _EVERY + f"SELECT job_id, count(*) AS n_users, {', '.join(f'CAST(sum(CAST(round({p} * 1e6) AS BIGINT)) AS BIGINT) AS {p}' for p in _FACTORS)} FROM parts GROUP BY 1")
def _factors(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a posting, in millionths, summed over the users it is relevant to."""
    with workspace(spark) as work:
        return result(matching.factor_sums(jobs(spark, sf).drop("description"), users(spark, sf), R.now(), work))


@query("score_total", _EVERY + "SELECT user_id, job_id, score, excluded, CAST(negative AS INTEGER) AS negative, too_senior FROM scored")
def _total(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every relevant pair."""
    return _pairs(spark, sf).select("user_id", "job_id", "score", F.col("barred").alias("excluded"), F.col("negative").cast("int").alias("negative"), "too_senior")


@query("score_best8", _EVERY + "SELECT user_id, job_id, score, rn AS place FROM (SELECT user_id, job_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS rn FROM scored WHERE NOT excluded) WHERE rn <= 8")
def _best(spark: SparkSession, sf: str) -> DataFrame:
    """The eight best postings of each user."""
    return matching.best_matches(jobs(spark, sf).drop("description"), users(spark, sf), R.now(), spark)


#: Matching cycles: each takes the postings seen first that none before it has taken, and skips pairs that are stored.
_CYCLES = {
    "batch1": "SELECT job_id, first_seen_at FROM job WHERE status = 'ACTIVE' ORDER BY first_seen_at NULLS FIRST, job_id LIMIT 250",
    "batch2": "SELECT job_id, first_seen_at FROM job ANTI JOIN batch1 USING (job_id) WHERE status = 'ACTIVE' ORDER BY first_seen_at NULLS FIRST, job_id LIMIT 250",
    "fresh": "SELECT s.user_id, s.job_id, s.score, s.score >= u.threshold AS above FROM scored s JOIN app_user u USING (user_id) ANTI JOIN match m ON m.user_id = s.user_id AND m.job_id = s.job_id WHERE NOT excluded",
}
_CYCLE = lambda k: with_("job", "app_user", "match", more=_ALL | _CYCLES) + f"SELECT job_id, count(user_id) AS n_matches, count(*) FILTER (above) AS n_above, max(score) AS best FROM batch{k} LEFT JOIN fresh USING (job_id) GROUP BY 1"


def _cycle(spark: SparkSession, sf: str, processed: DataFrame) -> DataFrame:
    """Matches of a cycle's postings, counted; a posting without any is processed too."""
    with workspace(spark) as work:
        made = matching.cycle(jobs(spark, sf).drop("description"), users(spark, sf), processed, R.match(spark, sf), R.now(), work)
        sums = made["matches"].groupBy("job_id").agg(F.count("*").alias("n_matches"), F.count_if("above").alias("n_above"), F.max("score").alias("best"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return result(made["processed"].select("job_id").join(sums, "job_id", "left").select("job_id", zero("n_matches"), zero("n_above"), "best"))


@query("match_cycle_1", _CYCLE(1))
def _cycle_1(spark: SparkSession, sf: str) -> DataFrame:
    """A cycle that finds nothing processed: its 250 postings, those that suit nobody too."""
    return _cycle(spark, sf, R.job(spark, sf).select("job_id").limit(0))


@query("match_cycle_2", _CYCLE(2))
def _cycle_2(spark: SparkSession, sf: str) -> DataFrame:
    """The cycle after it, which takes other postings whether or not those before had a match."""
    return _cycle(spark, sf, matching.next_batch(jobs(spark, sf), R.job(spark, sf).select("job_id").limit(0)).select("job_id"))


@query(
    "match_recalculate_all",
    with_("job", "app_user", "notification", more=_ALL | {
        "newest": "SELECT job_id FROM job WHERE status = 'ACTIVE' ORDER BY first_seen_at DESC NULLS LAST, job_id LIMIT 500",
        "active": "SELECT user_id, threshold FROM app_user WHERE status = 'ACTIVE' AND (len(skills) > 0 OR len(role1) > 0 OR len(role2) > 0)",
        "pairs": "SELECT s.user_id, s.score >= a.threshold AS above, EXISTS (SELECT 1 FROM notification n WHERE n.user_id = s.user_id AND n.job_id = s.job_id) AS known FROM scored s JOIN newest USING (job_id) JOIN active a ON a.user_id = s.user_id WHERE NOT excluded",
    }) + "SELECT a.user_id, count(p.user_id) AS n_matches, count(*) FILTER (above) AS n_above, count(*) FILTER (above AND NOT known) AS n_notify FROM active a LEFT JOIN pairs p USING (user_id) GROUP BY 1",
)
def _recalculate(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of all active users against the 500 newest active postings, made anew."""
    with workspace(spark) as work:
        return result(matching.recalculate_all(jobs(spark, sf).drop("description"), users(spark, sf), R.notification(spark, sf), R.now(), work))


_SAID = """list_filter([CASE WHEN cov > 0.5 THEN 'Strong role profile match (' || CAST(floor(cov * 100 + 0.5) AS BIGINT) || '% of core skills)' END,
  CASE WHEN role_part >= 0.9 THEN 'Matches your "' || role_target || '" goal (' || role_priority || ' priority)' WHEN role_part >= 0.6 THEN 'Closely related to your "' || role_target || '" goal' END,
  CASE WHEN n_direct > 0 THEN n_direct || ' direct skill matches' END, 'Transferable: ' || transferable, 'Related via graph: ' || related,
  CASE WHEN years >= need THEN 'Experience fits (' || years || ' yrs vs ' || need || '+ required)' WHEN need - years >= 2 THEN 'Requires ' || need || '+ yrs, you have ' || years END,
  CASE WHEN location_part >= 0.9 THEN CASE WHEN location_class = 'ETHIOPIA_LOCAL' THEN 'In your top market' WHEN contains(location_class, 'REMOTE') THEN 'Remote' ELSE 'On-site abroad' END END,
  CASE WHEN hours <= 12 THEN 'Very fresh, posted ' || CAST(floor(hours + 0.5) AS BIGINT) || 'h ago' END, CASE WHEN negative > 0 THEN 'Your skills are weakly aligned with this role' END,
  CASE WHEN too_senior THEN 'Seniority above your stated experience (-5)' END, CASE WHEN parse_confidence < 40 THEN 'Low parse confidence, details may be incomplete' END], lambda x: x IS NOT NULL)"""
_BITS = """list_filter(['matches your ' || role_target || ' goal', CASE WHEN n_skills > 0 THEN (n_direct + n_transferable) || ' of ' || n_skills || ' skills' END, CASE WHEN n_transferable > 0 THEN n_transferable || ' transferable' END,
  CASE WHEN contains(location_class, 'REMOTE') THEN 'remote' WHEN location_class = 'ETHIOPIA_LOCAL' THEN 'local' END, CASE WHEN level = 'ENTRY' THEN 'junior level' END], lambda x: x IS NOT NULL)"""


@query(
    "score_reasons",
    _EVERY + f"""SELECT user_id, job_id, score, array_to_string(list_concat({_SAID}, why_not), '; ') AS reasons,
    CASE WHEN excluded THEN array_to_string(why_not, '; ') || '.' ELSE 'Matches your profile: ' || array_to_string({_BITS}, ', ') || '.' END AS summary FROM scored""",
)
def _reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons and summary of every relevant pair."""
    return _pairs(spark, sf, texts=True).select("user_id", "job_id", "score", F.col("reasons_text").alias("reasons"), "summary")


@query("skill_prerequisites", with_("app_user", more={n: _BASE[n] for n in ("names", "us")}) + f"""SELECT u.user_id, target, bool_and(EXISTS (SELECT 1 FROM us WHERE us.user_id = u.user_id AND us.skill = need)) AS ready
 FROM app_user u, (SELECT * FROM {dims.values([(t, p) for t, ps in dims.PREREQUISITES.items() for p in ps], 'target, need')}) GROUP BY 1, 2""")  # fmt: skip
def _prerequisites(spark: SparkSession, sf: str) -> DataFrame:
    """Whether users know what a skill presupposes."""
    targets = F.explode(F.array(*map(F.lit, dims.PREREQUISITES))).alias("target")
    rows = R.app_user(spark, sf).select("user_id", op.canonical_all(F.col("skills")).alias("skills"), targets)
    return rows.select("user_id", "target", op.knows(F.col("target"), F.col("skills")).alias("ready"))
