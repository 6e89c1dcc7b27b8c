"""Parsers against small payloads of each shape."""

import json

import pytest
from pyspark.sql import functions as F

from lumenary.sources.feeds import PARSERS, RAW, parse, parse_all

ITEM = "<item><title><![CDATA[{t}]]></title><link>https://x.example/jobs/{n}</link><guid>g{n}</guid><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate><description><![CDATA[<p>d</p>]]></description><category>{c}</category></item>"
LD = {"title": "Senior Nurse | Site", "datePosted": "2024-01-05", "validThrough": "2024-02-01T00:00", "hiringOrganization": {"name": "Clinic"}, "baseSalary": {"value": "900", "currency": "USD"}, "description": "Care"}
CARD = '<div><h3 class="job-card-title">{t}</h3><strong>Company: </strong> Firm{n}<br><strong>Deadline: </strong> 31/08/2026<span> Part Time </span><a href="?job_detail={n}">x</a><a href="?job_detail={n}">y</a></div>' + " " * 2000
PAYLOADS = {
    "rss": "<rss>" + ITEM.format(t="Finance Consultant", n=1, c="Aid Org") + ITEM.format(t="Intern", n=2, c="Job") + "</rss>",
    "rss_dashed": "<rss>" + ITEM.format(t="Senior Driver - Big - Firm - Remote, Ethiopia", n=3, c="X Jobs in Ethiopia") + ITEM.format(t="Driver", n=4, c="X Jobs in Ethiopia") + "</rss>",
    "json_list": json.dumps({"jobs": [{"id": 7, "title": "Lead Dev", "url": "u", "candidate_required_location": "Worldwide", "job_type": "full_time", "salary": "50k - 70k/yr", "tags": list("abcdefghij"), "publication_date": "2024-01-02T03:04:05"}, {"id": 8, "title": "", "url": "u"}]}),
    "json_paged": json.dumps({"data": [{"slug": f"s{k}", "title": "T", "url": "u", "created_at": c} for k, c in enumerate((1704164645, 1704164645000, "2024-01-02T03:04:05", "never"))]}),
    "json_headed": json.dumps([{"legal": "x"}, {"id": "5", "position": "Junior QA", "url": "u", "salary_min": 10, "salary_max": 21, "date": "2024-01-02T03:04:05+00:00"}]),
    "json_industry": json.dumps({"jobs": [{"id": 1, "jobTitle": "T", "url": "u", "jobType": ["part-time"], "jobIndustry": ["A &amp; B"], "annualSalaryMin": 0, "annualSalaryMax": 9, "pubDate": "2024-01-02 03:04:05"}]}),
    "json_cities": json.dumps([{"id": 1, "title": "T", "url": "u", "city": "Lisbon", "country": "Portugal", "remote": False, "main_requirements": "<b>python</b> and SQL", "nice_to_have": "x", "tags": ["SQL", "Z"], "created_at": "2024-01-02T03:04:05.000Z", "expires_at": "2024-02-02"}]),
    "posts": json.dumps([{"id": 9, "link": "l", "date": "2024-01-02T03:04:05", "title": {"rendered": "Nurse_ Job @ Clinic"}, "content": {"rendered": "<p>Location : Jimma Deadline: June 3, 2024</p>"}}]),
    "embedded": '<html><script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"category": {"jobs": [{"slug": "a-b", "title": "Clerk", "state": "Addis", "type": 2, "company": {"name": "C"}, "catalogs": [{"name": "Fin"}], "date_published": "2024-01-02"}]}}}}) + "</script></html>",
    "linked_data": f'<title>x</title><script type="application/ld+json">{json.dumps(LD)}</script><h3>How to Apply</h3><div>Work remote<div>now</div></div>',
    "cards": CARD.format(t="Clerk", n=11) + CARD.format(t="Cook", n=12),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"https://h.example/p/{k}?a=1", p) for k, p in PAYLOADS.items()] + [(k, "u", bad) for k in PAYLOADS for bad in ("", "not a feed", None)]
    return spark.createDataFrame(rows, "source_id string, url string, payload string").withColumn("fetched_at", F.lit("2024-03-01").cast("timestamp_ntz"))


def rows(pages, kind):
    return sorted(parse(pages.where(F.col("source_id") == kind), kind).collect(), key=lambda r: r.source_job_id)


@pytest.mark.parametrize("kind", PARSERS)
def test_columns_and_garbage(pages, kind):
    got = rows(pages, kind)
    assert got and all(r.title and r.url for r in got)
    assert list(got[0].asDict())[2:] == list(RAW)


def test_rss(pages):
    a, b = rows(pages, "rss")
    assert (a.title, a.company, a.employment_type, a.source_job_id, str(a.posted_at), a.parse_confidence) == ("Finance Consultant", "Aid Org", "CONTRACT", "1", "2024-03-05 10:00:00", 70)
    assert (b.company, b.employment_type, b.experience_level) == ("rss", "INTERNSHIP", "INTERN")
    a, b = rows(pages, "rss_dashed")
    assert (a.title, a.company, a.location, a.work_place, a.experience_level, a.source_job_id) == ("Senior Driver - Big", "Firm", "Remote, Ethiopia", "REMOTE", "SENIOR", "g3")
    assert (b.title, b.company, b.location) == ("Driver", "X", "Ethiopia")


def test_json(pages):
    (a,) = rows(pages, "json_list")
    assert (a.location, a.salary, a.employment_type, a.experience_level, len(a.skills)) == ("Remote", 60000, "FULL_TIME", "SENIOR", 8)
    assert {str(r.posted_at) for r in rows(pages, "json_paged")} == {"2024-01-02 03:04:05"} and len(rows(pages, "json_paged")) == 3
    (a,) = rows(pages, "json_headed")
    assert (a.title, a.salary, a.employment_type, a.experience_level) == ("Junior QA", 16, "UNKNOWN", "ENTRY")
    (a,) = rows(pages, "json_industry")
    assert (a.salary, a.skills, a.source_categories, a.employment_type, a.currency) == (9, ["A & B"], ["A &amp; B"], "PART_TIME", "USD")
    (a,) = rows(pages, "json_cities")
    assert (a.location, a.skills, a.work_place, str(a.deadline)[:10]) == ("Lisbon, Portugal", ["Python", "SQL", "Z"], "ONSITE", "2024-02-02")


def test_pages(pages):
    (a,) = rows(pages, "posts")
    assert (a.title, a.company, a.location, str(a.deadline)[:10]) == ("Nurse @ Clinic", "Clinic", "Jimma", "2024-06-03")
    (a,) = rows(pages, "embedded")
    assert (a.url, a.employment_type, a.source_categories, a.company) == ("https://www.example.org/jobs/a-b", "PART_TIME", ["Fin"], "C")
    (a,) = rows(pages, "linked_data")
    assert (a.title, a.salary, a.currency, a.parse_confidence, a.work_place, str(a.deadline)[:10]) == ("Senior Nurse", 900, "USD", 95, "REMOTE", "2024-02-01")
    assert a.description.startswith("Care\n\n<h3>How to Apply")
    a, b = rows(pages, "cards")
    assert (a.title, b.title, a.company, a.employment_type, str(a.deadline)[:10], a.url) == ("Clerk", "Cook", "Firm11", "PART_TIME", "2026-08-31", "https://h.example/p/cards?job_detail=11")


def test_union_and_freshness(pages):
    assert parse_all(pages, {k: k for k in PARSERS}).count() == sum(len(rows(pages, k)) for k in PARSERS)
    assert parse(pages.where("source_id = 'rss'"), "rss", F.lit("2024-03-06").cast("timestamp_ntz")).count() == 0
