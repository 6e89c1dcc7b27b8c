"""The domain relations, derived from the supplied tables by integer arithmetic only.

Each takes (spark, sf_dir). ``lumenary.bindings.ctes`` states the same rows as SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.session import read_table

#: The moment that all queries take as now.
AS_OF = "2024-02-01 00:00:00"

LEVEL_WORDS = ("Senior ", "", "Junior ", "Lead ", "", "Intern ", "Staff ", "")
TITLE_ROLES = ("Backend Developer", "Frontend Engineer", "Full-Stack Developer", "Data Analyst", "Accountant", "Registered Nurse", "Project Officer", "Sales Representative", "Graphic Designer", "Mobile Developer", "DevOps Engineer", "Driver", "Civil Engineer", "Teacher", "Marketing Manager", "Data Scientist")
RAW_SKILLS = ("JavaScript", "js", "TypeScript", "React", "node", "NestJS", "python", "Django", "SQL", "postgres", "Docker", "k8s", "AWS", "Java", "Excel", "Accounting", "accounting", "Patient Care", "Project Management", "Figma", "Sales", "Welding")
USER_ROLES = ("backend_developer", "frontend developer", "full stack developer", "data analyst", '"accountant"', "nurse", "project officer", "sales representative", "graphic designer", "mobile developer", "devops engineer", "teacher")
SUFFIXES = ("", " PLC", ", Inc.", " Ltd", " GmbH")
LOCATION_CLASSES = ("ETHIOPIA_LOCAL", "INTERNATIONAL_REMOTE", "INTERNATIONAL_ONSITE", "ETHIOPIA_REMOTE")
WORK_PLACES = ("REMOTE", "ONSITE", "UNKNOWN")
EMPLOYMENT = ("FULL_TIME", "PART_TIME", "CONTRACT", "UNKNOWN")
MONEY = ("USD", "ETB", "eur", "XXX")
STATUSES = ("ACTIVE", "ACTIVE", "ACTIVE", "ACTIVE", "ACTIVE", "ACTIVE", "ACTIVE", "REMOVED", "EXPIRED", "ARCHIVED")
LABELS = ("ICT", "Banking", "Health care", "Schools", "Marketing", "Web design", "project work", "Zoology")
STAGES = ("SAVED", "APPLIED", "INTERVIEW", "OFFER", "REJECTED", "WITHDRAWN")
EVENT_STAGES = (("view", "SAVED"), ("click", "APPLIED"), ("signup", "INTERVIEW"), ("purchase", "OFFER"), ("error", "REJECTED"))
TIERS = ("ETHIOPIA", "INTERNATIONAL", "OTHER")
FREQUENCIES = (30, 60, 240, 1440)
PRIORITIES = ("HIGH", "MEDIUM", "LOW")
APPLY_METHODS = ("ONLINE_URL", "ONLINE_URL", "EMAIL")
URL_STATUSES = ("OK", "NOT_FOUND", "ERROR", "REDIRECTED", "TIMEOUT")
KEYWORDS = ("developer", "nurse", "data", "officer", "designer")


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def pick(words: Sequence, at: Column) -> Column:
    """The word at a position, counted round."""
    return F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))


def moved(unit: str, by: str, ts: str) -> Column:
    """Timestamp ``ts`` moved by so many units; both are SQL expressions."""
    return F.expr(f"timestampadd({unit}, cast({by} as int), {ts})")


def _n(spark: SparkSession, sf_dir: str, table: str) -> Column:
    """Rows of a table, as a value within the query."""
    return read_table(spark, sf_dir, table).agg(F.count(F.lit(1))).scalar()


def job(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", (F.col("doc_id") % _n(spark, sf_dir, "part")).alias("p_partkey"), (F.col("doc_id") % _n(spark, sf_dir, "supplier")).alias("s_suppkey"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    firm = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    i = F.col("doc_id")
    out = docs.join(part, "p_partkey").join(firm, "s_suppkey").select(
        i.alias("job_id"),
        F.col("source").alias("source_id"),
        F.floor(i / 40).cast("string").alias("source_job_id"),
        F.concat(pick(LEVEL_WORDS, F.floor(i / 16)), pick(TITLE_ROLES, F.col("p_partkey")), F.lit(" - "), F.col("p_type")).alias("title"),
        F.concat(F.col("s_name"), pick(SUFFIXES, i)).alias("company"),
        F.when(i % 4 == 0, "Addis Ababa, Ethiopia").when(i % 7 == 0, "Remote").otherwise(F.col("n_name")).alias("location"),
        F.col("n_name").alias("country"),
        pick(LOCATION_CLASSES, i).alias("location_class"),
        pick(WORK_PLACES, F.floor(i / 4)).alias("work_place"),
        pick(EMPLOYMENT, F.floor(i / 3)).alias("employment_type"),
        F.when(i % 5 == 0, F.lit(0)).when(i % 11 == 0, None).otherwise(F.floor("p_retailprice")).cast("long").alias("salary"),
        F.when(i % 13 == 0, None).otherwise(pick(MONEY, i)).alias("currency"),
        (30 + i * 11 % 70).cast("int").alias("parse_confidence"),
        pick(STATUSES, i).alias("status"),
        (F.floor(i / 10) % 5).cast("int").alias("missed_cycles"),
        F.array(pick(LABELS, i), pick(LABELS, F.floor(i / 8))).alias("labels"),
        F.transform(F.sequence(F.lit(1), (i % 6 + 1).cast("int")), lambda k: pick(RAW_SKILLS, i * 7 + k * k * 3 + k)).alias("skill_slots"),
        (i % 6).cast("int").alias("n_skills"),
        F.col("text").alias("description"),
        moved("HOUR", "doc_id * 37 % 2000", f"timestamp_ntz'{AS_OF}' - interval 2000 hours").alias("posted_at"),
        F.when(i % 3 > 0, moved("DAY", "doc_id * 13 % 60 - 20", f"timestamp_ntz'{AS_OF}'")).alias("deadline"),
        moved("HOUR", "doc_id * 37 % 2000 + doc_id * 7 % 48", f"timestamp_ntz'{AS_OF}' - interval 2000 hours").alias("first_seen_at"),
    )
    return out.withColumn("skills", F.expr("slice(skill_slots, 1, n_skills)")).drop("skill_slots", "n_skills")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting sources, with tier, frequency in minutes and default tags."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return read_table(spark, sf_dir, "documents").select("source").distinct().select(
        F.col("source").alias("source_id"),
        number.alias("number"),
        pick(TIERS, number).alias("tier"),
        pick(FREQUENCIES, number).alias("frequency_min"),
        F.when(number % 3 == 0, F.array(F.lit("ethiopian"), F.lit("ngo"))).when(number % 3 == 1, F.array(F.lit("remote"))).otherwise(F.array().cast("array<string>")).alias("default_tags"),
        pick(LOCATION_CLASSES, number).alias("default_location_class"),
    )


def job_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with how they are answered and the state of their link, null where it was never checked."""
    i = F.col("job_id")
    return job(spark, sf_dir).withColumns({"apply_method": pick(APPLY_METHODS, F.floor(i / 5)), "url_status": F.when(i % 4 > 0, pick(URL_STATUSES, F.floor(i / 3)))})


def source_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("src"), F.col("user_id")).alias("source_id"),
        e.alias("run_id"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"),
        F.when(F.col("event_type") == "error", "FAIL").otherwise("OK").alias("status"),
        F.when(F.floor(e / 7) % 2 == 0, "FAST").otherwise("DEEP").alias("mode"),
        F.floor("value").cast("long").alias("jobs_fetched"),
        F.get_json_object("props", "$.k").cast("long").alias("quality"),
        (e % 9).alias("link_checks"),
        (e % 9 % 4).alias("link_failures"),
    )


#: Why a run stopped in a category.
STOPPED = ("WINDOW_END", "LAST_PAGE", "PAGE_LIMIT", "ERROR")


def run_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run did in its three categories."""
    k = F.col("k")
    run = F.col("run_id")
    return source_run(spark, sf_dir).select("run_id", "source_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(
        "run_id",
        "source_id",
        F.lower(pick(LABELS, run + k)).alias("category"),
        (run * (k + 1) % 7 + 1).alias("pages_fetched"),
        (run * (k + 3) % 50).alias("jobs_fetched"),
        F.when(run % 5 == 0, k).otherwise(0).cast("long").alias("errors"),
        pick(STOPPED, run + k).alias("stopped_reason"),
    )


def app_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        i.alias("user_id"),
        (55 + i % 4 * 5).cast("int").alias("threshold"),
        F.when(i % 20 == 3, "DORMANT").when(i % 20 == 7, "DISABLED").otherwise("ACTIVE").alias("status"),
        (i % 8 == 5).alias("paused"),
        (i % 9).cast("int").alias("years"),
        (F.floor(F.abs("c_acctbal")).cast("long") % 2000).alias("min_salary"),
        (i % 6 == 0).alias("remote"),
        (i % 5 == 0).alias("exclude_onsite"),
        (i % 7 == 0).alias("exclude_entry"),
        F.when(i % 10 != 9, F.array(pick(USER_ROLES, i))).otherwise(F.array().cast("array<string>")).alias("role1"),
        F.when((i % 4 == 1) & (i % 10 != 9), F.array(pick(USER_ROLES, i + 5))).otherwise(F.array().cast("array<string>")).alias("role2"),
        pick(PRIORITIES, i).alias("priority1"),
        F.expr(f"slice(transform(sequence(1, 3), k -> element_at(array({', '.join(repr(s) for s in RAW_SKILLS)}), cast((c_custkey * 5 + k * 7) % {len(RAW_SKILLS)} as int) + 1)), 1, cast(c_custkey % 4 as int))").alias("skills"),
        F.when(i % 3 == 0, "HIGH").when(i % 3 == 1, "MEDIUM").alias("home_tier"),
        F.when(i % 4 == 2, "LOW").alias("city_tier"),
        F.when(i % 2 == 0, "HIGH").when(i % 5 == 1, "LOW").alias("remote_tier"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("region"),
        pick(PRIORITIES, F.col("c_nationkey")).alias("region_tier"),
        F.array(pick(EMPLOYMENT, i), pick(EMPLOYMENT, i + 1)).alias("employment_types"),
        moved("HOUR", "c_custkey * 29 % 1500", f"timestamp_ntz'{AS_OF}' - interval 1500 hours").alias("last_active_at"),
    )


def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        k.alias("match_id"), F.col("o_custkey").alias("user_id"), (k % _n(spark, sf_dir, "documents")).alias("job_id"), (F.floor("o_totalprice").cast("long") % 101).cast("int").alias("score")
    )


def notification(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        k.alias("notification_id"),
        F.col("o_custkey").alias("user_id"),
        ((k + F.col("o_custkey") % 2) % _n(spark, sf_dir, "documents")).alias("job_id"),
        F.when(F.col("o_orderpriority") < "3", "TELEGRAM").otherwise("IN_APP").alias("channel"),
        F.when(F.col("o_orderstatus") == "F", "SENT").when(F.col("o_orderstatus") == "O", "READ").otherwise("FAILED").alias("status"),
        moved("HOUR", "o_orderkey * 17 % 4000", f"timestamp_ntz'{AS_OF}' - interval 4000 hours").alias("created_at"),
    )


def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        k.alias("application_id"), F.col("o_custkey").alias("user_id"), (k * 7 % _n(spark, sf_dir, "documents")).alias("job_id"), pick(STAGES, F.floor(k / 5)).alias("stage"), (k % 3 + 1).cast("int").alias("version")
    )


def transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.coalesce(*(F.when(F.col("event_type") == e, s) for e, s in EVENT_STAGES))
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("transition_id"), F.col("user_id").alias("application_id"), to.alias("to_stage"), F.col("ts").cast("timestamp_ntz").alias("moved_at"))


def search_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        i.alias("user_id"), pick(KEYWORDS, i).alias("q"), F.when(i % 4 > 0, pick(PRIORITIES, F.floor(i / 2))).alias("tier"), (i % 3 == 0).alias("remote")
    )


def seen_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that the latest run met."""
    return read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id")).distinct()
