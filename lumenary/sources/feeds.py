"""Parsers of landed payloads: rows of (source_id, url, fetched_at, payload) to raw postings.

Fetching is not Spark's work; a landing step writes payloads and these turn them into rows of RAW.
All are projections and explodes of one payload at a time, so they need no shuffle and run alike on a
batch and on a stream. A payload that cannot be read gives no rows, a field that is missing is null,
and postings without a title or an address are left out. ``kind`` names the shape of a feed:

    rss            items whose first category is the company
    rss_dashed     items titled "title - company - location"
    json_list      {"jobs": [...]} of remote work with pay as text
    json_paged     {"data": [...]} with moments as seconds, milliseconds or ISO text
    json_headed    [metadata, job, ...] with pay bounds
    json_industry  {"jobs": [...]} by industry
    json_cities    [job, ...] with cities and requirements as HTML
    posts          [post, ...] of a site's REST interface, facts in the text
    embedded       a page with its data as JSON in a script
    linked_data    a page with linked data, and text around it where that lacks something
    cards          a page of cards, each with a numbered link
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.functions.money import half_up, midpoint, parse_pay
from lumenary.functions.phrases import employment, experience, known_skills
from lumenary.functions.text import deadline_in, epoch_or_iso, parse_when, strip_html

RAW = (
    "title", "company", "location", "location_class", "employment_type", "experience_level", "work_place", "salary", "currency", "skills",
    "url", "source_job_id", "posted_at", "deadline", "description", "country", "parse_confidence", "source_categories",
)
MOST_SKILLS = 8
# ---- fixed values
NAMED_SKILLS = (
    "Java", "Python", "JavaScript", "TypeScript", "React", "Angular", "Vue", "Node.js", "NestJS", "Express", "Django", "Flask", "Spring", "Spring Boot",
    "PostgreSQL", "MySQL", "MongoDB", "Redis", "SQL", "Docker", "Kubernetes", "AWS", "Azure", "GCP", "CI/CD", "GraphQL", "REST", "Git", "Linux", "Microservices",
)
JOB_TYPES = {1: "Full Time", 2: "Part Time", 3: "Contract", 4: "Internship"}
# ----


def _raw(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows of RAW with what a parser found; what it does not mention is null or empty."""
    types = {"salary": "long", "skills": "array<string>", "posted_at": "timestamp_ntz", "deadline": "timestamp_ntz", "parse_confidence": "int", "source_categories": "array<string>"}
    empty = {"skills", "source_categories"}
    out = [columns.get(c, F.array() if c in empty else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in RAW]
    return rows.select("source_id", "fetched_at", *out).where("title <> '' AND url <> ''")


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"<!\[CDATA\[|\]\]>", ""))


def _or(c: Column, default: str | Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def _picked(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def _items(pages: DataFrame) -> DataFrame:
    """Items of RSS payloads."""
    blocks = pages.select("source_id", "fetched_at", F.explode(F.regexp_extract_all("payload", F.lit(r"<item>([\s\S]*?)</item>"), F.lit(1))).alias("i"))
    grab = lambda tag: _plain(F.regexp_extract("i", rf"(?i)<{tag}[^>]*>([\s\S]*?)</{tag}>", 1))
    cats = F.transform(F.regexp_extract_all("i", F.lit(r"<category[^>]*>([\s\S]*?)</category>"), F.lit(1)), _plain)
    date = F.try_to_timestamp(F.regexp_extract(grab("pubDate"), r"(\d{1,2} \w{3} \d{4} \d\d:\d\d:\d\d)", 1), F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    return blocks.select("source_id", "fetched_at", grab("title").alias("title"), _or(grab("link"), grab("guid")).alias("link"), grab("guid").alias("guid"), date.alias("date"), grab("description").alias("description"), cats.alias("cats"))


def _rss_type(title: Column, contract: Column) -> Column:
    return F.when(title.rlike("(?i)intern"), "INTERNSHIP").when(contract | title.rlike("(?i)consultancy|consultant"), "CONTRACT").otherwise("UNKNOWN")


def rss(pages: DataFrame) -> DataFrame:
    rows, title, first = _items(pages), F.col("title"), F.try_element_at("cats", F.lit(1))
    company = F.when(~F.lower(first).isin("job", "ethiopia"), first)
    return _raw(
        rows, title=title, company=_or(company, F.col("source_id")), location=F.lit("Ethiopia"), location_class=F.lit("ETHIOPIA_LOCAL"),
        employment_type=_rss_type(title, F.exists("cats", lambda c: F.lower(c) == "consultancy")), experience_level=experience(title), work_place=F.lit("ONSITE"),
        url=F.col("link"), source_job_id=_or(F.substring_index("link", "/", -1), F.col("link")), posted_at=F.col("date"), description=F.col("description"),
        country=F.lit("Ethiopia"), parse_confidence=F.lit(70), source_categories=F.col("cats"),
    )


def rss_dashed(pages: DataFrame) -> DataFrame:
    parts = F.filter(F.transform(F.split("title", " - "), lambda s: F.trim(s)), lambda s: s != "")
    rows = _items(pages).withColumn("p", parts).withColumn("n", F.size("p"))
    many = F.col("n") >= 3
    title = F.when(many, F.array_join(F.slice("p", F.lit(1), F.greatest(F.col("n") - 2, F.lit(1))), " - ")).otherwise(_or(F.try_element_at("p", F.lit(1)), F.col("title")))
    location = F.when(F.col("n") >= 2, F.try_element_at("p", F.lit(-1))).otherwise("Ethiopia")
    company = F.when(many, F.try_element_at("p", F.lit(-2))).otherwise(_or(F.regexp_replace(F.try_element_at("cats", F.lit(1)), r"(?i) Jobs in Ethiopia\z", ""), F.col("source_id")))
    remote = location.rlike("(?i)remote")
    return _raw(
        rows, title=title, company=company, location=location, location_class=F.when(remote, "ETHIOPIA_REMOTE").otherwise("ETHIOPIA_LOCAL"),
        employment_type=_rss_type(title, F.exists("cats", lambda c: F.lower(c).contains("consultant"))), experience_level=experience(title),
        work_place=F.when(remote, "REMOTE").otherwise("ONSITE"), url=F.col("link"), source_job_id=_or(F.col("guid"), _or(F.substring_index("link", "/", -1), F.col("link"))),
        posted_at=F.col("date"), description=F.col("description"), country=F.lit("Ethiopia"), parse_confidence=F.lit(70), source_categories=F.col("cats"),
    )


def _jobs(pages: DataFrame, schema: str, at: str | None) -> DataFrame:
    """Elements of a JSON payload, an array or the array in a field."""
    kind = f"array<struct<{schema}>>" if at is None else f"struct<{at}: array<struct<{schema}>>>"
    found = F.from_json("payload", kind)
    return pages.select("source_id", "fetched_at", F.explode(found if at is None else found[at]).alias("j")).select("source_id", "fetched_at", "j.*")


def _remote(location: Column) -> Column:
    return F.when(F.nullif(location, F.lit("")).isNull() | location.isin("Worldwide", "Anywhere"), "Remote").otherwise(F.concat(F.lit("Remote ("), location, F.lit(")")))


def json_list(pages: DataFrame) -> DataFrame:
    rows = _jobs(pages, "id string, title string, company_name string, candidate_required_location string, job_type string, salary string, tags array<string>, url string, publication_date string, description string", "jobs")
    return _raw(
        rows, title=F.col("title"), company=_or(F.col("company_name"), F.col("source_id")), location=_remote(F.col("candidate_required_location")), location_class=F.lit("INTERNATIONAL_REMOTE"),
        employment_type=employment(F.col("job_type")), experience_level=experience(F.col("title")), work_place=F.lit("REMOTE"), salary=parse_pay(F.col("salary")), currency=F.lit("USD"),
        skills=F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, MOST_SKILLS), url=F.col("url"), source_job_id=F.col("id"), posted_at=parse_when(F.col("publication_date")),
        description=F.col("description"), country=F.lit("Remote"), parse_confidence=F.lit(80),
    )


def json_paged(pages: DataFrame) -> DataFrame:
    rows = _jobs(pages, "slug string, title string, company_name string, location string, job_types array<string>, tags array<string>, url string, created_at string, description string", "data")
    place = F.nullif(F.col("location"), F.lit(""))
    return _raw(
        rows, title=F.col("title"), company=_or(F.col("company_name"), F.col("source_id")), location=F.when(place.isNull(), "Remote").otherwise(F.concat(F.lit("Remote ("), place, F.lit(")"))),
        location_class=F.lit("INTERNATIONAL_REMOTE"), employment_type=employment(F.try_element_at("job_types", F.lit(1))), experience_level=experience(F.col("title")), work_place=F.lit("REMOTE"),
        skills=F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, MOST_SKILLS), url=F.col("url"), source_job_id=F.col("slug"), posted_at=epoch_or_iso(F.col("created_at")),
        description=F.col("description"), country=F.lit("Remote"), parse_confidence=F.lit(80),
    ).where("posted_at IS NOT NULL")


def json_headed(pages: DataFrame) -> DataFrame:
    rows = _jobs(pages, "id string, position string, company string, salary_min long, salary_max long, tags array<string>, url string, date string, description string", None).where("id <> '' AND position <> ''")
    return _raw(
        rows, title=F.col("position"), company=_or(F.col("company"), F.col("source_id")), location=F.lit("Remote"), location_class=F.lit("INTERNATIONAL_REMOTE"), employment_type=F.lit("UNKNOWN"),
        experience_level=experience(F.col("position")), work_place=F.lit("REMOTE"), salary=midpoint(F.col("salary_min"), F.col("salary_max")), currency=F.lit("USD"),
        skills=F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, MOST_SKILLS), url=F.col("url"), source_job_id=F.col("id"), posted_at=parse_when(F.substring("date", 1, 19)),
        description=F.col("description"), country=F.lit("Remote"), parse_confidence=F.lit(75),
    )


def json_industry(pages: DataFrame) -> DataFrame:
    rows = _jobs(pages, "id string, jobTitle string, companyName string, jobGeo string, jobType array<string>, jobIndustry array<string>, annualSalaryMin long, annualSalaryMax long, salaryCurrency string, url string, pubDate string, jobExcerpt string", "jobs")
    tags = F.transform(F.coalesce("jobIndustry", F.array().cast("array<string>")), lambda t: F.trim(F.replace(t, F.lit("&amp;"), F.lit("&"))))
    return _raw(
        rows, title=F.col("jobTitle"), company=_or(F.col("companyName"), F.col("source_id")), location=_or(F.col("jobGeo"), "Remote"), location_class=F.lit("INTERNATIONAL_REMOTE"),
        employment_type=employment(F.try_element_at("jobType", F.lit(1))), experience_level=experience(F.col("jobTitle")), work_place=F.lit("REMOTE"),
        salary=midpoint(F.col("annualSalaryMin"), F.col("annualSalaryMax")), currency=_or(F.col("salaryCurrency"), "USD"), skills=F.slice(tags, 1, MOST_SKILLS), url=F.col("url"),
        source_job_id=F.col("id"), posted_at=parse_when(F.col("pubDate")), description=F.coalesce("jobExcerpt", F.lit("")), country=F.lit("Remote"), parse_confidence=F.lit(80), source_categories=F.col("jobIndustry"),
    )


def json_cities(pages: DataFrame) -> DataFrame:
    rows = _jobs(pages, "id string, title string, city string, country string, remote boolean, employment_type string, gross_salary_low long, gross_salary_high long, currency_code string, main_requirements string, nice_to_have string, tags array<string>, url string, published_at string, created_at string, expires_at string", None)
    country = F.nullif(F.col("country"), F.lit(""))
    place = F.when((F.col("city") != "") & country.isNotNull(), F.concat(F.col("city"), F.lit(", "), country)).otherwise(F.coalesce(country, F.lit("Remote")))
    need, nice, remote = F.coalesce("main_requirements", F.lit("")), F.nullif("nice_to_have", F.lit("")), F.coalesce("remote", F.lit(False))
    skills = F.slice(F.array_distinct(F.concat(known_skills(need, NAMED_SKILLS), F.coalesce("tags", F.array().cast("array<string>")))), 1, MOST_SKILLS)
    return _raw(
        rows, title=F.col("title"), company=F.col("source_id"), location=place, location_class=F.when(remote, "INTERNATIONAL_REMOTE").otherwise("INTERNATIONAL_ONSITE"),
        employment_type=employment(F.col("employment_type")), experience_level=experience(F.col("title")), work_place=F.when(remote, "REMOTE").otherwise("ONSITE"),
        salary=midpoint(F.col("gross_salary_low"), F.col("gross_salary_high")), currency=_or(F.col("currency_code"), "EUR"), skills=skills, url=F.col("url"), source_job_id=F.col("id"),
        posted_at=parse_when(F.substring(_or(F.col("published_at"), F.col("created_at")), 1, 19)), deadline=parse_when(F.substring("expires_at", 1, 10)),
        description=F.concat(need, F.coalesce(F.concat(F.lit("\n\n<p><strong>Nice to have:</strong></p>\n"), nice), F.lit(""))), country=F.coalesce(country, F.lit("Europe")), parse_confidence=F.lit(75),
    )


def posts(pages: DataFrame) -> DataFrame:
    rows = _jobs(pages, "id string, link string, date string, title struct<rendered: string>, content struct<rendered: string>", None)
    body = F.coalesce("content.rendered", F.lit(""))
    text, title = strip_html(body), F.trim("title.rendered")
    clip = lambda c: F.substring(F.regexp_replace(c, r"[,|]\z", ""), 1, 120)
    place = F.regexp_replace(F.coalesce(clip(_picked(text, r"(?i)location\s*:\s*([^\n]+)")), F.lit("Ethiopia")), r"(?i)\s+(?:Deadline|Job Description|Project|Ref|Employment|Salary)(?![A-Za-z0-9_])[\s\S]*\z", "")
    due = _picked(text, r"(?i)deadline\s*:\s*[^\n]*?([A-Za-z]+\s+\d{1,2},\s+\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4})")
    return _raw(
        rows, title=F.regexp_replace(title, r"(?i)_\s*Job\s*@", " @"), company=F.coalesce(clip(_picked(text, r"(?i)organization\s*:\s*([^\n]+)")), clip(_picked(title, r"@\s*([^\n]+)")), F.col("source_id")),
        location=place, location_class=F.lit("ETHIOPIA_LOCAL"), employment_type=F.lit("FULL_TIME"), experience_level=experience(title), work_place=F.lit("ONSITE"), url=F.col("link"), source_job_id=F.col("id"),
        posted_at=parse_when(F.replace(F.substring("date", 1, 19), F.lit("T"), F.lit(" "))), deadline=parse_when(due), description=body, country=F.lit("Ethiopia"), parse_confidence=F.lit(70),
    )


def embedded(pages: DataFrame, base: str = "https://www.example.org") -> DataFrame:
    """Both shapes of page: data under jobs or under category.jobs."""
    one = "slug string, title string, state string, location_type string, type int, company struct<name: string>, catalogs array<struct<name: string>>, date_published string, date_expiry string, description string"
    many = f"array<struct<{one}>>"
    data = F.from_json(F.regexp_extract("payload", r'(?i)<script[^>]*id="__NEXT_DATA__"[^>]*>([\s\S]*?)</script>', 1), f"props struct<pageProps: struct<jobs: {many}, category: struct<jobs: {many}>>>")
    found = F.coalesce(data["props"]["pageProps"]["jobs"], data["props"]["pageProps"]["category"]["jobs"])
    rows = pages.select("source_id", "fetched_at", F.explode(found).alias("j")).select("source_id", "fetched_at", "j.*")
    place = _or(F.col("state"), "Ethiopia")
    remote = F.coalesce(F.col("location_type").rlike("(?i)remote"), F.lit(False)) | place.rlike("(?i)remote")
    kind = F.coalesce(*(F.when(F.col("type") == k, v) for k, v in JOB_TYPES.items()), F.lit(JOB_TYPES[1]))
    return _raw(
        rows, title=F.col("title"), company=_or(F.col("company.name"), F.col("source_id")), location=place, location_class=F.when(remote, "ETHIOPIA_REMOTE").otherwise("ETHIOPIA_LOCAL"),
        employment_type=employment(kind), experience_level=experience(F.col("title")), work_place=F.when(remote, "REMOTE").otherwise("ONSITE"),
        url=F.when(F.col("slug") != "", F.concat(F.lit(f"{base}/jobs/"), F.col("slug"))), source_job_id=F.col("slug"), posted_at=parse_when(F.substring("date_published", 1, 10)), deadline=parse_when(F.substring("date_expiry", 1, 10)),
        description=F.coalesce("description", F.lit("")), country=F.lit("Ethiopia"), parse_confidence=F.lit(75), source_categories=F.slice(F.coalesce("catalogs.name", F.array().cast("array<string>")), 1, 8),
    )


def linked_data(pages: DataFrame) -> DataFrame:
    """Linked data first, then the text of the page, then its markup."""
    schema = "title string, description string, datePosted string, validThrough string, experienceRequirements string, hiringOrganization struct<name: string>, jobLocation struct<address: struct<addressLocality: string>>, baseSalary struct<value: string, currency: string>"
    html = F.col("payload")
    rows = pages.select("source_id", "fetched_at", "url", "payload", F.from_json(F.regexp_extract(html, r'(?i)<script type="application/ld\+json">([\s\S]*?)</script>', 1), schema).alias("ld"), strip_html(html).alias("said"))
    title = F.coalesce("ld.title", _picked(html, r"(?i)<title>([^<]*)</title>"))
    for tail in (r"(?i)\s*-\s*Readvert.*\z", r"(?i)\s+via\s+\w+\z", r"\s*\|\s*[^|]*\z"):
        title = F.regexp_replace(title, tail, "")
    meta = F.coalesce(_picked(html, r'(?i)<meta[^>]*property="og:description"[^>]*content="([^"]*)"'), _picked(html, r'(?i)<meta[^>]*content="([^"]*)"[^>]*property="og:description"'))
    how = _picked(html, r"(?i)<h3[^>]*>How to Apply</h3>[\s\S]*?<div[^>]*>([\s\S]*?)</div>\s*</div>")
    body = F.concat(F.coalesce("ld.description", F.lit("")), F.coalesce(F.concat(F.lit("\n\n<h3>How to Apply</h3>\n"), how), F.lit("")))
    body = _or(body, F.coalesce(_picked(html, r'(?i)<div class="job-content">([\s\S]*?)</div>'), meta, F.lit("")))
    given = F.col("ld.baseSalary.value").try_cast("double")
    stated = F.coalesce(_picked(F.col("said"), r"(?i)Salary\s+([A-Z]{2,3}\s+[\d,\s.-]+)"), _picked(html, r"(?i)<p[^>]*>Salary</p>\s*<p[^>]*>([^<]+)</p>"))
    numbers = F.transform(F.regexp_extract_all(F.replace(stated, F.lit(","), F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda n: n.try_cast("double"))
    mean = F.when(F.size(numbers) > 0, half_up(F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b) / F.size(numbers)))
    asked = F.coalesce("ld.experienceRequirements", _picked(F.col("said"), r"(?i)Experience\s+(.+?)(?=\s+Deadline|\s+Salary|\s+How|\z)"), title)
    due = F.coalesce(parse_when(F.substring("ld.validThrough", 1, 10)), deadline_in(F.col("said")).cast("timestamp_ntz"))
    remote = F.concat_ws(" ", body, title).rlike("(?i)remote")
    return _raw(
        rows, title=F.trim(title), company=_or(F.trim("ld.hiringOrganization.name"), F.col("source_id")), location=_or(F.col("ld.jobLocation.address.addressLocality"), "Ethiopia"),
        location_class=F.when(remote, "ETHIOPIA_REMOTE").otherwise("ETHIOPIA_LOCAL"), employment_type=F.lit("UNKNOWN"), experience_level=experience(asked), work_place=F.when(remote, "REMOTE").otherwise("UNKNOWN"),
        salary=F.coalesce(half_up(given), mean), currency=F.when(given.isNotNull(), _or(F.col("ld.baseSalary.currency"), "ETB")).when(stated.rlike("(?i)USD"), "USD").otherwise("ETB"), url=F.col("url"),
        source_job_id=F.substring_index("url", "/", -1), posted_at=parse_when(F.substring("ld.datePosted", 1, 10)), deadline=due, description=body, country=F.lit("Ethiopia"),
        parse_confidence=F.when(given.isNotNull(), 95).otherwise(90),
    )


def cards(pages: DataFrame, international: bool = False, around: int = 1500) -> DataFrame:
    """Each distinct number once, its facts from so many characters on either side of its first link."""
    ids = pages.select("source_id", "fetched_at", "url", "payload", F.explode(F.array_distinct(F.regexp_extract_all("payload", F.lit(r"job_detail=(\d+)"), F.lit(1)))).alias("id"))
    at = F.expr("locate(concat('job_detail=', id), payload)")
    start = F.greatest(F.lit(1), at - around)
    rows = ids.withColumn("b", F.substring(F.col("payload"), start, at + around - start))
    fact = lambda name: _picked(F.col("b"), rf"(?i)<strong>{name}:\s*</strong>\s*([^<]+)")
    title, due, asked = _picked(F.col("b"), r'(?i)<h3[^>]*class="job-card-title"[^>]*>([^<]+)</h3>'), fact("Deadline"), fact("Experience")
    kind = _picked(F.col("b"), r"(?i)<span[^>]*>\s*(Full Time|Part Time|Contract|Temporary|Internship)\s*</span>")
    detail = F.concat(F.substring_index("url", "?", 1), F.lit("?job_detail="), F.col("id"))
    company, place = F.coalesce(fact("Company"), F.lit("Unknown")), F.coalesce(fact("Location"), F.lit("International" if international else "Ethiopia"))
    line = lambda name, c: F.concat(F.lit(f"<p><strong>{name}:</strong> "), c, F.lit("</p>"))
    body = F.concat_ws("\n", F.concat(F.lit("<h2>"), title, F.lit("</h2>")), line("Company", company), line("Location", place), line("Experience", asked), line("Education", fact("Education")), line("Deadline", due))
    return _raw(
        rows, title=title, company=company, location=place, location_class=F.lit("INTERNATIONAL_ONSITE" if international else "ETHIOPIA_LOCAL"),
        employment_type=F.coalesce(F.replace(F.upper(kind), F.lit(" "), F.lit("_")), F.lit("FULL_TIME")), experience_level=experience(F.coalesce(asked, title)), work_place=F.lit("ONSITE"), currency=F.lit("ETB"),
        url=F.coalesce(_picked(F.col("b"), r'(?i)href="(https?://[^"]*(?:apply|forms\.microsoft|docs\.google)[^"]*)"'), detail), source_job_id=F.concat(F.col("source_id"), F.lit("-"), F.col("id")),
        posted_at=F.col("fetched_at"), deadline=parse_when(due), description=body, country=F.lit(None if international else "Ethiopia"), parse_confidence=F.lit(80),
    )


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rss": rss, "rss_dashed": rss_dashed, "json_list": json_list, "json_paged": json_paged, "json_headed": json_headed, "json_industry": json_industry,
    "json_cities": json_cities, "posts": posts, "embedded": embedded, "linked_data": linked_data, "cards": cards,
}


def parse(pages: DataFrame, kind: str, since: Column | None = None) -> DataFrame:
    """Raw postings of payloads of one kind, those posted before ``since`` (or at no known time, if it is given) left out."""
    rows = PARSERS[kind](pages)
    return rows if since is None else rows.where(F.col("posted_at") >= since)


def parse_all(pages: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Raw postings of all sources of ``kinds`` (source_id to kind), united by name."""
    by_kind: dict[str, list[str]] = {}
    for source, kind in kinds.items():
        by_kind.setdefault(kind, []).append(source)
    out = None
    for kind, sources in by_kind.items():
        rows = parse(pages.where(F.col("source_id").isin(*sources)), kind)
        out = rows if out is None else out.unionByName(rows)
    return out
