"""One query for each shape of feed, over payloads made from the postings; the oracles state what must be read from the postings themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.bindings.ctes import NOW, listed, with_
from lumenary.bindings.payloads import PAGE, payloads
from lumenary.queries.register import query
from lumenary.queries.scoring import _LEVEL
from lumenary.sources.feeds import JOB_TYPES, NAMED_SKILLS, parse

_LINK = "'https://x.example/jobs/' || job_id"
_ABOUT = "'About ' || title"
_DATE = lambda c: f"CAST(CAST({c} AS DATE) AS TIMESTAMP)"
#: What a shape does not say.
_DEFAULT = {
    "source_job_id": "CAST(job_id AS VARCHAR)", "title": "title", "company": "company", "location": "'Remote'", "location_class": "'INTERNATIONAL_REMOTE'", "employment_type": "employment_type", "experience_level": _LEVEL,
    "work_place": "'REMOTE'", "salary": "CAST(NULL AS BIGINT)", "currency": "'USD'", "skills": "''", "url": _LINK, "posted_at": "posted_at", "deadline": "CAST(NULL AS TIMESTAMP)",
    "description": _ABOUT, "country": "'Remote'", "parse_confidence": "80", "source_categories": "''",
}
_HOME = {"location_class": "'ETHIOPIA_LOCAL'", "work_place": "'ONSITE'", "currency": "CAST(NULL AS VARCHAR)", "country": "'Ethiopia'", "parse_confidence": "70"}


def _sql(where: str = "TRUE", source: str = "job", **columns: str) -> str:
    return with_("job") + f"SELECT source_id, {', '.join(f'{c} AS {n}' for n, c in (_DEFAULT | columns).items())} FROM {source} WHERE {where}"


def _mid(low: str, high: str) -> str:
    return f"CASE WHEN nullif({low}, 0) IS NOT NULL AND nullif({high}, 0) IS NOT NULL THEN CAST(floor(({low} + {high}) / 2.0 + 0.5) AS BIGINT) ELSE coalesce(nullif({low}, 0), nullif({high}, 0)) END"


_RSS_TYPE = lambda contract: f"CASE WHEN contains(lower(title), 'intern') THEN 'INTERNSHIP' WHEN {contract} OR contains(lower(title), 'consultan') THEN 'CONTRACT' ELSE 'UNKNOWN' END"
_SHORT = "job_id % 6 = 0"
_REMOTE = f"NOT {_SHORT} AND contains(lower(location), 'remote')"
_NEED = "'<li>' || array_to_string(skills, '</li><li>') || '</li>'"
_AWAY = "(work_place = 'REMOTE' OR (job_id % 3 > 0 AND contains(lower(location), 'remote')))"
_LD_REMOTE = "(job_id % 3 = 0 OR contains(lower(title), 'remote'))"
_CARD_PLACE = "CASE WHEN job_id % 4 > 0 THEN location ELSE 'Ethiopia' END"
_P = lambda name, c: f"coalesce(chr(10) || '<p><strong>{name}:</strong> ' || {c} || '</p>', '')"

_SQL = {
    "rss": _sql(**_HOME | {"company": "CASE WHEN job_id % 4 = 0 THEN source_id ELSE company END", "location": "'Ethiopia'", "employment_type": _RSS_TYPE("job_id % 5 = 0"), "source_categories": "CASE WHEN job_id % 4 = 0 THEN 'Job' ELSE company END || '|' || CASE WHEN job_id % 5 = 0 THEN 'Consultancy' ELSE labels[1] END"}),
    "rss_dashed": _sql(source=f"(SELECT * REPLACE (CASE WHEN {_SHORT} THEN split_part(title, ' - ', 1) ELSE title END AS title), title AS given FROM job)", **_HOME | {
        "source_job_id": "'g' || job_id", "location": f"CASE WHEN {_SHORT} THEN 'Ethiopia' ELSE location END", "location_class": f"CASE WHEN {_REMOTE} THEN 'ETHIOPIA_REMOTE' ELSE 'ETHIOPIA_LOCAL' END", "description": "'About ' || given",
        "work_place": f"CASE WHEN {_REMOTE} THEN 'REMOTE' ELSE 'ONSITE' END", "employment_type": _RSS_TYPE("job_id % 5 = 0"), "source_categories": "company || ' Jobs in Ethiopia|' || CASE WHEN job_id % 5 = 0 THEN 'Consultants' ELSE labels[1] END"}),
    "json_list": _sql(location="CASE WHEN job_id % 3 < 2 THEN 'Remote' ELSE 'Remote (' || country || ')' END", salary="CASE WHEN job_id % 2 = 0 THEN salary + 51 ELSE salary * 1000 END", skills="array_to_string(skills[1:8], '|')"),
    "json_paged": _sql("job_id % 13 > 0", source_job_id="'s' || job_id", company="CASE WHEN job_id % 7 > 0 THEN company ELSE source_id END", location="CASE WHEN job_id % 2 = 0 THEN 'Remote (' || country || ')' ELSE 'Remote' END", currency="CAST(NULL AS VARCHAR)", skills="array_to_string(labels, '|')"),
    "json_headed": _sql("job_id % 9 > 0", employment_type="'UNKNOWN'", salary=_mid("salary", "salary * (job_id % 3)"), skills="array_to_string(skills[1:8], '|')", parse_confidence="75"),
    "json_industry": _sql(location="CASE WHEN job_id % 4 > 0 THEN country ELSE 'Remote' END", salary=_mid("salary", "(salary + 21)"), currency="coalesce(currency, 'USD')", skills="labels[1] || ' & Co|' || labels[2]", source_categories="labels[1] || ' &amp; Co|' || labels[2]"),
    "json_cities": _sql(company="source_id", location="CASE WHEN job_id % 4 = 0 AND job_id % 5 > 0 THEN 'Lisbon, ' || country WHEN job_id % 5 > 0 THEN country ELSE 'Remote' END", location_class="CASE WHEN work_place = 'REMOTE' THEN 'INTERNATIONAL_REMOTE' ELSE 'INTERNATIONAL_ONSITE' END",
        work_place="CASE WHEN work_place = 'REMOTE' THEN 'REMOTE' ELSE 'ONSITE' END", salary="nullif(salary, 0)", currency="coalesce(currency, 'EUR')", skills=f"array_to_string(list_concat(list_filter({listed(NAMED_SKILLS)}, lambda s: contains(lower({_NEED}), lower(s)))[1:8], labels[1:1])[1:8], '|')",
        deadline=_DATE("deadline"), description=f"{_NEED} || CASE WHEN job_id % 2 = 0 THEN chr(10) || chr(10) || '<p><strong>Nice to have:</strong></p>' || chr(10) || 'tea' ELSE '' END", country="CASE WHEN job_id % 5 > 0 THEN country ELSE 'Europe' END", parse_confidence="75"),
    "posts": _sql(**_HOME | {"title": "title || ' @ ' || company", "location": "location", "employment_type": "'FULL_TIME'", "deadline": _DATE("deadline"), "description": "'<p>Location&nbsp;: <b>' || location || '</b>' || coalesce(' Deadline: ' || strftime(deadline, '%B %-d, %Y'), '') || '</p>'"}),
    "embedded": _sql(**_HOME | {"source_job_id": "'s-' || job_id", "location": "CASE WHEN job_id % 3 > 0 THEN location ELSE 'Ethiopia' END", "location_class": f"CASE WHEN {_AWAY} THEN 'ETHIOPIA_REMOTE' ELSE 'ETHIOPIA_LOCAL' END", "work_place": f"CASE WHEN {_AWAY} THEN 'REMOTE' ELSE 'ONSITE' END",
        "employment_type": f"CASE job_id % 5 {' '.join(f'''WHEN {k} THEN '{'INTERNSHIP' if v == 'Internship' else v.upper().replace(' ', '_')}' ''' for k, v in JOB_TYPES.items())} ELSE 'FULL_TIME' END", "url": "'https://www.example.org/jobs/s-' || job_id", "posted_at": _DATE("posted_at"), "deadline": _DATE("deadline"), "parse_confidence": "75", "source_categories": "array_to_string(labels, '|')"}),
    "linked_data": _sql(**_HOME | {"location": "location", "location_class": f"CASE WHEN {_LD_REMOTE} THEN 'ETHIOPIA_REMOTE' ELSE 'ETHIOPIA_LOCAL' END", "work_place": f"CASE WHEN {_LD_REMOTE} THEN 'REMOTE' ELSE 'UNKNOWN' END", "employment_type": "'UNKNOWN'", "salary": "salary",
        "currency": "CASE WHEN salary IS NOT NULL THEN coalesce(currency, 'ETB') ELSE 'ETB' END", "url": f"'{PAGE}' || job_id", "posted_at": _DATE("posted_at"), "deadline": _DATE("deadline"), "description": f"CASE WHEN job_id % 3 = 0 THEN 'Work is remote' ELSE {_ABOUT} END", "parse_confidence": "CASE WHEN salary IS NOT NULL THEN 95 ELSE 90 END"}),
    "cards": _sql(**_HOME | {"source_job_id": "source_id || '-' || job_id", "location": _CARD_PLACE, "employment_type": "CASE job_id % 3 WHEN 0 THEN 'PART_TIME' WHEN 1 THEN 'CONTRACT' ELSE 'FULL_TIME' END", "currency": "'ETB'", "url": f"'{PAGE}' || source_job_id || '?job_detail=' || job_id", "posted_at": NOW, "deadline": _DATE("deadline"),
        "description": f"'<h2>' || title || '</h2>' || {_P('Company', 'company')} || {_P('Location', _CARD_PLACE)} || {_P('Deadline', 'strftime(deadline, ' + repr('%d/%m/%Y') + ')')}", "parse_confidence": "80"}),
}


def _register(kind: str) -> None:
    @query(f"feed_{kind}", _SQL[kind])
    def read(spark: SparkSession, sf: str) -> DataFrame:
        joined = lambda c: F.array_join(c, "|").alias(c)
        rows = parse(payloads(spark, sf, kind), kind)
        return rows.select("source_id", *(joined(c) if c in ("skills", "source_categories") else c for c in _DEFAULT))


for _kind in _SQL:
    _register(_kind)
