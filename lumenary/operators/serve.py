"""What users see: browsing, matches, boards, dashboards, digests and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score floors of a saved search by tier; matches that a digest lists.
SEARCH_FLOOR: dict[str, int] = {"HIGH": 80, "MEDIUM": 70, "LOW": 60}
DIGEST_TOP = 8
#: Link states by which a posting is not sent.
DEAD_LINKS = ("NOT_FOUND", "ERROR")


def browse(jobs: DataFrame, sources: DataFrame, *, q: str | None = None, tag: str | None = None, tier: str | None = None, work_place: str | None = None, employment_type: str | None = None, show_dead: bool = False) -> DataFrame:
    """Postings that pass the filters; each None is off. Keywords match title, company, description or a skill, whatever their case."""
    out = jobs if show_dead else jobs.where("status = 'ACTIVE'")
    if employment_type is not None:
        out = out.where(F.col("employment_type") == employment_type)
    if work_place is not None:
        remote = F.col("location_class").contains("REMOTE")
        out = out.where(remote if work_place == "REMOTE" else ~remote)
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if q is not None:
        low, has = q.lower(), lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q.lower())
        out = out.where(has("title") | has("company") | has("description") | F.exists("skills", lambda s: F.lower(s).contains(low)))
    if tier is not None:
        out = out.join(F.broadcast(sources.where(F.col("tier") == tier).select("source_id")), "source_id", "left_semi")
    return out


def unseen(matches: DataFrame, notifications: DataFrame) -> DataFrame:
    """Matches whose posting the user has not been told of; an anti-join, so a null id hides nothing."""
    return matches.join(notifications.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


def deliverable(matches: DataFrame, users: DataFrame, jobs: DataFrame, notifications: DataFrame) -> DataFrame:
    """Matches to deliver: over the user's threshold, user not paused, posting active, not told before; a pair once, with its best score.

    A posting that is answered online goes if its link was found dead; one that was never checked stays.
    """
    best = matches.groupBy("user_id", "job_id").agg(F.max("score").alias("score"))
    ready = users.where(~F.col("paused")).select("user_id", "threshold")
    dead = F.coalesce((F.col("apply_method") == "ONLINE_URL") & F.col("url_status").isin(*DEAD_LINKS), F.lit(False))
    live = jobs.where((F.col("status") == "ACTIVE") & ~dead).select("job_id")
    return unseen(best.join(ready, "user_id").where("score >= threshold").join(live, "job_id", "left_semi"), notifications).select("user_id", "job_id", "score")


def board(applications: DataFrame, matches: DataFrame, jobs: DataFrame, least: int = 80) -> DataFrame:
    """Applications of a user by stage, and as DISCOVERED the strong matches that the user has not applied to."""
    new = matches.where(F.col("score") >= least).select("user_id", "job_id").distinct().join(applications.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")
    rows = applications.select("user_id", "job_id", "stage").unionByName(new.withColumn("stage", F.lit("DISCOVERED")))
    return rows.join(jobs.select("job_id"), "job_id", "left_semi")


def search_hits(searches: DataFrame, matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Matches of a user that a saved search of the user finds, by keyword, remoteness and the tier's floor.

    Searches meet their user's matches by equality, so it is no product of searches and postings.
    """
    seen = jobs.select("job_id", "location_class", F.lower(F.concat_ws(" ", "title", "company", F.array_join("skills", " "))).alias("said"))
    floor = F.coalesce(*(F.when(F.col("tier") == t, n) for t, n in SEARCH_FLOOR.items()), F.lit(0))
    pairs = searches.join(matches.select("user_id", "job_id", "score"), "user_id").join(seen, "job_id")
    return pairs.where((~F.col("remote") | F.col("location_class").contains("REMOTE")) & F.col("said").contains(F.lower("q")) & (F.col("score") >= floor))


def digest_top(matches: DataFrame, n: int = DIGEST_TOP) -> DataFrame:
    """The best ``n`` matches of each user; ties go to the smaller posting, then the smaller match."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "job_id", "match_id")
    return matches.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def completion(users: DataFrame) -> Column:
    """How complete a profile is, 0 to 100."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return (
        F.least(F.lit(30), size("skills") * 10)
        + F.least(F.lit(20), (size("role1") + size("role2")) * 10)
        + F.when(F.col("home_tier").isNotNull() | F.col("remote_tier").isNotNull(), 15).otherwise(0)
        + F.when(F.col("years") > 0, 15).otherwise(0)
        + F.when(F.col("min_salary") > 0, 10).otherwise(0)
        + F.when(size("employment_types") > 0, 10).otherwise(0)
    )


def nested_jobs(matches: DataFrame, jobs: DataFrame, sources: DataFrame, applications: DataFrame) -> DataFrame:
    """(user_id, job_id, view) of each user's matched postings; view nests source, skills, the first match, and whether it is saved and where the application stands.

    The many sides become one struct a pair before they are joined, so nothing is multiplied. ``jobs`` has the columns of the
    view and benchmark, a struct or null.
    """
    first = matches.groupBy("user_id", "job_id").agg(F.min_by(F.struct("match_id", "score"), "match_id").alias("match"))
    filed = applications.groupBy("user_id", "job_id").agg(F.max(F.col("stage") == "SAVED").alias("saved"), F.min_by(F.struct("stage", "version"), "application_id").alias("application"))
    whole = jobs.join(sources.select("source_id", "tier"), "source_id", "left")
    rows = first.join(whole, "job_id").join(filed, ["user_id", "job_id"], "left")
    view = F.struct(
        "title", "company", F.struct(F.col("source_id").alias("id"), "tier").alias("source"), "skills", "status", F.coalesce("saved", F.lit(False)).alias("saved"), "application", "match", "benchmark"
    )
    return rows.select("user_id", "job_id", view.alias("view"))


def assembled_profiles(users: DataFrame, skills: DataFrame, roles: DataFrame, locations: DataFrame) -> DataFrame:
    """Users with skills and target roles as arrays in order and location tiers as a map, from a row each (user_id, ord, skill), (user_id, ord, role, priority), (user_id, region, tier).

    A region named twice keeps its greatest tier name; a user without rows has empty collections.
    """
    inorder = lambda *fields: F.transform(F.array_sort(F.collect_list(F.struct("ord", *fields))), lambda x: x[fields[0]] if len(fields) == 1 else F.struct(*(x[f].alias(f) for f in fields)))
    own_skills = skills.groupBy("user_id").agg(inorder("skill").alias("skills"))
    own_roles = roles.groupBy("user_id").agg(inorder("role", "priority").alias("target_roles"))
    tiers = locations.groupBy("user_id", "region").agg(F.max("tier").alias("tier")).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "tier")))).alias("location_tiers"))
    out = users.join(own_skills, "user_id", "left").join(own_roles, "user_id", "left").join(tiers, "user_id", "left")
    empty = {"skills": "array<string>", "target_roles": "array<struct<role:string,priority:string>>"}
    filled = {c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()} | {"location_tiers": F.coalesce("location_tiers", F.create_map().cast("map<string,string>"))}
    return out.withColumns(filled)
