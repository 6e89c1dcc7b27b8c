"""Payloads of every shape of feed, made from the postings: a page holds a source's postings of one block of forty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.bindings import relations as R

PAGE = "https://h.example/p/"
#: Between two cards, so that the text around one link holds one card.
GAP = 2000


def _text(ts: str, pattern: str) -> Column:
    return F.date_format(ts, pattern)


def _iso(ts: str) -> Column:
    return _text(ts, "yyyy-MM-dd'T'HH:mm:ss")


def _about() -> Column:
    return F.concat(F.lit("About "), F.col("title"))


def _link() -> Column:
    return F.concat(F.lit("https://x.example/jobs/"), F.col("job_id"))


def _pages(rows: DataFrame, item: Column, whole: Callable[[Column], Column]) -> DataFrame:
    """One payload a source and block, of the items in order."""
    block = F.col("source_job_id").alias("block")
    items = rows.select("source_id", block, "job_id", item.alias("item")).groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("job_id", "item")))["item"].alias("items"))
    return items.select("source_id", F.concat(F.lit(PAGE), "block", F.lit("?a=1")).alias("url"), R.now().alias("fetched_at"), whole(F.col("items")).alias("payload"))


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _in(field: str) -> Callable[[Column], Column]:
    return lambda items: F.concat(F.lit(f'{{"{field}":'), _array(items), F.lit("}"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _rss(rows: DataFrame, title: Column, first: Column, second: Column) -> DataFrame:
    cdata = lambda c: F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    when = F.concat(_text("posted_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    item = F.concat(
        tag("title", cdata(title)), tag("link", _link()), tag("guid", F.concat(F.lit("g"), F.col("job_id"))), tag("pubDate", when), tag("description", cdata(_about())), tag("category", cdata(first)), tag("category", cdata(second))
    )
    return _pages(rows, tag("item", item), lambda items: F.concat(F.lit("<rss><channel>"), F.array_join(items, "\n"), F.lit("</channel></rss>")))


def rss(rows: DataFrame) -> DataFrame:
    i = F.col("job_id")
    return _rss(rows, F.col("title"), F.when(i % 4 == 0, "Job").otherwise(F.col("company")), F.when(i % 5 == 0, "Consultancy").otherwise(F.col("labels")[0]))


def rss_dashed(rows: DataFrame) -> DataFrame:
    i = F.col("job_id")
    short = F.substring_index("title", " - ", 1)
    title = F.when(i % 6 == 0, short).otherwise(F.concat_ws(" - ", "title", "company", "location"))
    return _rss(rows, title, F.concat("company", F.lit(" Jobs in Ethiopia")), F.when(i % 5 == 0, "Consultants").otherwise(F.col("labels")[0]))


def json_list(rows: DataFrame) -> DataFrame:
    i, s = F.col("job_id"), F.col("salary")
    pay = F.when(i % 2 == 0, F.concat(F.lit("USD "), F.format_number(s, 0), F.lit(" - "), F.format_number(s + 101, 0))).otherwise(F.concat(s, F.lit("k/yr")))
    place = F.when(i % 3 == 0, "Worldwide").when(i % 3 == 1, "").otherwise(F.col("country"))
    item = _json(id=i, title=F.col("title"), company_name=F.col("company"), candidate_required_location=place, job_type=F.lower("employment_type"), salary=pay, tags=F.col("skills"), url=_link(), publication_date=_iso("posted_at"), description=_about())
    return _pages(rows, item, _in("jobs"))


def json_paged(rows: DataFrame) -> DataFrame:
    i, at = F.col("job_id"), F.unix_timestamp(F.col("posted_at").cast("timestamp"))
    created = F.when(i % 13 == 0, "never").when(i % 3 == 0, at.cast("string")).when(i % 3 == 1, (at * 1000).cast("string")).otherwise(_iso("posted_at"))
    item = _json(slug=F.concat(F.lit("s"), i), title=F.col("title"), company_name=F.when(i % 7 > 0, F.col("company")).otherwise(""), location=F.when(i % 2 == 0, F.col("country")), job_types=F.array("employment_type"), tags=F.col("labels"), url=_link(), created_at=created, description=_about())
    return _pages(rows, item, _in("data"))


def json_headed(rows: DataFrame) -> DataFrame:
    i = F.col("job_id")
    item = _json(id=i.cast("string"), position=F.when(i % 9 > 0, F.col("title")).otherwise(""), company=F.col("company"), salary_min=F.col("salary"), salary_max=F.col("salary") * (i % 3), tags=F.col("skills"), url=_link(), date=F.concat(_iso("posted_at"), F.lit("+00:00")), description=_about())
    return _pages(rows, item, lambda items: F.concat(F.lit('[{"legal":"terms","last_updated":1},'), F.array_join(items, ","), F.lit("]")))


def json_industry(rows: DataFrame) -> DataFrame:
    i = F.col("job_id")
    industry = F.array(F.concat(F.col("labels")[0], F.lit(" &amp; Co")), F.col("labels")[1])
    item = _json(id=i, jobTitle=F.col("title"), companyName=F.col("company"), jobGeo=F.when(i % 4 > 0, F.col("country")).otherwise(""), jobType=F.array(F.lower("employment_type")), jobIndustry=industry, annualSalaryMin=F.col("salary"), annualSalaryMax=F.col("salary") + 21, salaryCurrency=F.col("currency"), url=_link(), pubDate=_text("posted_at", "yyyy-MM-dd HH:mm:ss"), jobExcerpt=_about())
    return _pages(rows, item, _in("jobs"))


def json_cities(rows: DataFrame) -> DataFrame:
    i = F.col("job_id")
    need = F.concat(F.lit("<li>"), F.array_join("skills", "</li><li>"), F.lit("</li>"))
    item = _json(id=i, title=F.col("title"), city=F.when(i % 4 == 0, "Lisbon").otherwise(""), country=F.when(i % 5 > 0, F.col("country")), remote=F.col("work_place") == "REMOTE", employment_type=F.lower("employment_type"), gross_salary_low=F.col("salary"), gross_salary_high=F.lit(0), currency_code=F.col("currency"), main_requirements=need, nice_to_have=F.when(i % 2 == 0, "tea"), tags=F.slice("labels", 1, 1), url=_link(), published_at=F.when(i % 2 == 0, F.concat(_iso("posted_at"), F.lit(".000Z"))), created_at=F.concat(_iso("posted_at"), F.lit("Z")), expires_at=_text("deadline", "yyyy-MM-dd"))
    return _pages(rows, item, _array)


def posts(rows: DataFrame) -> DataFrame:
    due = F.coalesce(F.concat(F.lit(" Deadline: "), _text("deadline", "MMMM d, yyyy")), F.lit(""))
    body = F.concat(F.lit("<p>Location&nbsp;: <b>"), F.col("location"), F.lit("</b>"), due, F.lit("</p>"))
    rendered = lambda c: F.struct(c.alias("rendered"))
    item = _json(id=F.col("job_id"), link=_link(), date=_iso("posted_at"), title=rendered(F.concat("title", F.lit("_ Job @ "), "company")), content=rendered(body))
    return _pages(rows, item, _array)


def embedded(rows: DataFrame) -> DataFrame:
    i = F.col("job_id")
    name = lambda c: F.struct(c.alias("name"))
    item = _json(slug=F.concat(F.lit("s-"), i), title=F.col("title"), state=F.when(i % 3 > 0, F.col("location")), location_type=F.col("work_place"), type=(i % 5).cast("int"), company=name(F.col("company")), catalogs=F.transform("labels", name), date_published=_iso("posted_at"), date_expiry=_iso("deadline"), description=_about())
    data = lambda items: F.when(F.size(items) % 2 == 0, F.concat(F.lit('{"jobs":'), _array(items), F.lit("}"))).otherwise(F.concat(F.lit('{"category":{"jobs":'), _array(items), F.lit("}}")))
    return _pages(rows, item, lambda items: F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":'), data(items), F.lit("}}</script></html>")))


def linked_data(rows: DataFrame) -> DataFrame:
    """A page a posting."""
    i = F.col("job_id")
    pay = F.when(F.col("salary").isNotNull(), F.struct(F.col("salary").cast("string").alias("value"), F.col("currency").alias("currency")))
    name = lambda c: F.struct(c.alias("name"))
    place = F.struct(F.struct(F.col("location").alias("addressLocality")).alias("address"))
    ld = _json(title=F.concat("title", F.lit(" | Site")), description=F.when(i % 3 == 0, "Work is remote").otherwise(_about()), datePosted=_text("posted_at", "yyyy-MM-dd"), validThrough=_iso("deadline"), hiringOrganization=name(F.col("company")), jobLocation=place, baseSalary=pay)
    html = F.concat(F.lit("<title>page</title><script type=\"application/ld+json\">"), ld, F.lit("</script><p>Some words</p>"))
    return rows.select("source_id", F.concat(F.lit(PAGE), i).alias("url"), R.now().alias("fetched_at"), html.alias("payload"))


def cards(rows: DataFrame) -> DataFrame:
    i = F.col("job_id")
    fact = lambda name, c: F.coalesce(F.concat(F.lit(f"<strong>{name}: </strong> "), c, F.lit("<br>")), F.lit(""))
    kind = F.when(i % 3 == 0, "<span> Part Time </span>").when(i % 3 == 1, "<span> Contract </span>").otherwise("")
    link = F.concat(F.lit('<a href="?job_detail='), i, F.lit('">x</a>'))
    item = F.concat(F.lit('<h3 class="job-card-title">'), F.col("title"), F.lit("</h3>"), fact("Company", F.col("company")), fact("Location", F.when(i % 4 > 0, F.col("location"))), fact("Deadline", _text("deadline", "dd/MM/yyyy")), kind, link, link, F.lit(" " * GAP))
    return _pages(rows, item, lambda items: F.array_join(items, "\n"))


MAKERS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (rss, rss_dashed, json_list, json_paged, json_headed, json_industry, json_cities, posts, embedded, linked_data, cards)}


def payloads(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(source_id, url, fetched_at, payload) of one shape."""
    return MAKERS[kind](R.job(spark, sf_dir).drop("description"))
