"""Queries about texts, pages, links and pay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.bindings import relations as R
from lumenary.bindings.ctes import with_
from lumenary.dims import CURRENCIES
from lumenary.functions import money, phrases, text, urls
from lumenary.queries.register import query
from lumenary.session import read_table
from lumenary.sources import posts


def _q(s: str) -> str:
    return "'" + s.replace("(?md)", "(?m)").replace("'", "''") + "'"


def _replaced(sql: str, pairs) -> str:
    for pattern, by in pairs:
        sql = f"regexp_replace({sql}, {_q(pattern)}, {_q(by)}, 'g')"
    return sql


def _clean_sql(column: str) -> str:
    sql = _replaced(f"coalesce({column}, '')", [(rf"(?i)<{t}[^>]*>[\s\S]*?</{t}>", "") for t in text.DROPPED_TAGS])
    for bad, good in text.MOJIBAKE:
        sql = f"replace({sql}, {_q(bad)}, {_q(good)})"
    return _replaced(sql, [*((p, "") for p in text.BOILERPLATE), (r"[^\S\n]+", " "), (r"\n\s*\n\s*\n", "\n\n"), (r"(?m)^\s+|\s+$", ""), (r"\A\s+|\s+\z", "")])


_EXPERIENCE = """CASE WHEN t = '' OR t IS NULL THEN 'UNKNOWN' WHEN regexp_matches(t, '\\b(intern|graduate|trainee|apprentice)\\b') THEN 'INTERN'
WHEN regexp_matches(t, '\\b(junior|entry|associate|i)\\b') AND NOT regexp_matches(t, '\\b(senior|lead)\\b') THEN 'ENTRY'
WHEN regexp_matches(t, '\\b(principal|head|director|vp|chief|staff)\\b') THEN 'LEAD' WHEN regexp_matches(t, '\\b(senior|lead|sr)\\b') THEN 'SENIOR' ELSE 'UNKNOWN' END"""


@query("description_clean", f"SELECT doc_id, length(c) AS n_clean, md5(c) AS clean_md5 FROM (SELECT doc_id, {_clean_sql('text')} AS c FROM documents)")
def _clean(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", text.clean_description(F.col("text")).alias("c"))
    return docs.select("doc_id", F.length("c").alias("n_clean"), F.md5(F.col("c").cast("binary")).alias("clean_md5"))


@query(
    "page_clean",
    f"""SELECT page_id, length(c) AS n_clean, length(l) AS n_light, length(s) AS n_text, md5(s) AS text_md5 FROM (SELECT page_id, {_clean_sql('html')} AS c,
    trim({_replaced("coalesce(html, '')", [*((rf"(?i)<{t}[^>]*>[\s\S]*?</{t}>", " ") for t in text.LIGHT_TAGS), (r"[\s\x{a0}]+", " ")])}) AS l,
    trim({_replaced("html", [(r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), (r"&#\d+;", ""), (r"[\s\x{a0}]+", " ")])}) AS s FROM pages)""",
)
def _page_clean(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    pages = read_table(spark, sf, "pages").select("page_id", text.clean_description(h).alias("c"), text.light_clean(h).alias("l"), text.strip_html(h).alias("s"))
    return pages.select("page_id", F.length("c").alias("n_clean"), F.length("l").alias("n_light"), F.length("s").alias("n_text"), F.md5(F.col("s").cast("binary")).alias("text_md5"))


_HITS = " + ".join(f"CAST(regexp_matches(text, {_q(p)}) AS INTEGER)" for p in text.BOILERPLATE)
_QUALITY = f"""SELECT doc_id, source, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE least(100,
 CASE WHEN length(text) >= 300 THEN 30 WHEN length(text) >= 200 THEN 20 WHEN length(text) >= 100 THEN 10 ELSE 5 END
 + CASE WHEN contains(text, '...') OR contains(text, '…') OR contains(lower(text), '/more') THEN 5 ELSE 20 END
 + CASE WHEN {_HITS} = 0 THEN 20 WHEN {_HITS} <= 2 THEN 12 ELSE 5 END + CASE WHEN contains(text, 'â€') OR contains(text, 'Ã') THEN 0 ELSE 15 END
 + CASE WHEN regexp_matches(text, '(?m)^#{{1,6}}\\s|^[A-Z][A-Za-z\\s]{{2,}}:$') THEN 5 ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?m)^[\\s]*[-*•]\\s|^[\\s]*\\d+[.)]\\s') THEN 5 ELSE 0 END
 + CASE WHEN length(text) - length(replace(text, chr(10), '')) >= 3 THEN 5 ELSE 0 END) END AS quality FROM documents"""


@query("description_quality", _QUALITY)
def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "source", text.quality(F.col("text")).alias("quality"))


@query("quality_by_source", f"SELECT source, count(*) AS n_docs, round(avg(quality), 6) AS avg_quality, count(*) FILTER (WHERE quality < 60) AS n_low FROM ({_QUALITY}) GROUP BY 1")
def _quality_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).groupBy("source").agg(F.count("*").alias("n_docs"), F.round(F.avg("quality"), 6).alias("avg_quality"), F.count_if(F.col("quality") < 60).alias("n_low"))


_URL = r"\A(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"


@query(
    "url_normalize",
    f"""SELECT page_id, CASE WHEN scheme = '' THEN url ELSE (CASE WHEN contains(host, 'localhost') THEN scheme ELSE 'https' END) || '://' || host || (CASE path WHEN '' THEN '/' ELSE path END)
    || (CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END) || frag END AS normal_url FROM (
    SELECT page_id, url, regexp_extract(url, '{_URL}', 1) AS scheme, lower(regexp_extract(url, '{_URL}', 2)) AS host, regexp_extract(url, '{_URL}', 3) AS path,
    list_filter(string_split(substr(regexp_extract(url, '{_URL}', 4), 2), '&'), lambda p: p <> '' AND NOT list_contains({list(urls.TRACKING)}, string_split(p, '=')[1])) AS kept,
    regexp_extract(url, '{_URL}', 5) AS frag FROM pages)""",
)
def _url(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal_url"))


#: A page's address and, from its number, variants that must not be fetched.
_VARIANTS = (
    "{u}", "ftp://h/{i}", "http://a:b@h.example/{i}", "http://10.{i}.0.1/", "http://100.64.{i}.9:80/x", "https://172.{i}.3.4/", "http://h.example:8080/", "http://localhost/", "http://[::1]/", "http://[fd00::1]/", "http://8.8.{i}.8/",
    "http://[::ffff:192.168.0.1]/", "no url", "http://192.0.2.{i}/",
)
#: The number of a page's address, and the forms that a URL may give it.
_NUMBER = "page_id * 7919 * 65537 % 4294967296"
_FORMS = {"plain": "http://{d}/", "hex": "http://0X{x}/", "octal": "http://0{o}/", "short": "http://{a}.{r}/", "mixed": "http://0x{ax}.0{bo}.{c}/", "end": "http://{d}./", "mapped": "http://[::ffff:{h}:{l}]/", "spelt": "http://[0:0:0:0:0:ffff:{h}:{l}]/", "high": "http://9{d}000000000/", "group": "http://[{h}::{l}:1]/", "loop": "http://[0:0:0:0:0:0:0:1]/", "odd": "http://[1::{h}::{l}]/", "name": "http://{d}.example/", "digit": "http://a.{a}/"}


@query(
    "url_safety",
    f"""WITH v AS (SELECT page_id, k, replace(replace(p, '{{u}}', url), '{{i}}', CAST(page_id % 256 AS VARCHAR)) AS u FROM pages, (SELECT unnest({list(_VARIANTS)}) AS p, unnest(range({len(_VARIANTS)})) AS k)),
    x AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*)@', 1) AS cred,
      lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1)) AS host,
      regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\\[[^\\]]*\\]|[^/?#:]*):(\\d+)', 1) AS port FROM v),
    n AS (SELECT *, CASE WHEN regexp_full_match(host, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}') THEN list_reduce(list_transform(string_split(host, '.'), lambda s: CAST(s AS BIGINT)), lambda a, b: a * 256 + b) END AS ip FROM x),
    b AS (SELECT * FROM (VALUES {', '.join(map(str, urls.blocked_ranges()))}) AS r(lo, hi)),
    f AS (SELECT page_id, ip, ip // 65536 AS h, ip % 65536 AS l, EXISTS (SELECT 1 FROM b WHERE ip BETWEEN lo AND hi) AS bad FROM (SELECT page_id, {_NUMBER} AS ip FROM pages))
    SELECT page_id, CAST(k AS VARCHAR) AS k, CASE WHEN scheme = '' THEN 'INVALID' WHEN scheme NOT IN ('http', 'https') THEN 'SCHEME' WHEN cred <> '' THEN 'CREDENTIALS' WHEN port NOT IN ('', '80', '443') THEN 'PORT'
      WHEN host IN ('', 'localhost') THEN 'HOST' WHEN EXISTS (SELECT 1 FROM b WHERE ip BETWEEN lo AND hi) THEN 'ADDRESS' WHEN host IN ('[::1]', '[fd00::1]', '[::ffff:192.168.0.1]') THEN 'ADDRESS' END AS reason FROM n
    UNION ALL SELECT page_id, k, CASE WHEN bad THEN 'ADDRESS' END FROM f, (SELECT unnest({[k for k in _FORMS if k not in ("high", "group", "loop", "odd", "name", "digit")]}) AS k)
    UNION ALL SELECT page_id, 'high', 'INVALID' FROM f UNION ALL SELECT page_id, 'odd', 'INVALID' FROM f UNION ALL SELECT page_id, 'loop', 'ADDRESS' FROM f UNION ALL SELECT page_id, 'name', NULL FROM f UNION ALL SELECT page_id, 'digit', 'INVALID' FROM f
    UNION ALL SELECT page_id, 'group', CASE WHEN h BETWEEN 64512 AND 65023 OR h BETWEEN 65152 AND 65215 OR h >= 65280 THEN 'ADDRESS' WHEN h = 0 AND EXISTS (SELECT 1 FROM b WHERE l * 65536 + 1 BETWEEN lo AND hi) THEN 'ADDRESS' END FROM f""",
)
def _safety(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of a page's URL, and its number as an address in all forms that a URL may give it."""
    i = (F.col("page_id") % 256).cast("string")
    fill = lambda v: F.replace(F.replace(F.lit(v), F.lit("{u}"), F.col("url")), F.lit("{i}"), i)
    pages = read_table(spark, sf, "pages")
    rows = pages.select("page_id", F.posexplode(F.array(*map(fill, _VARIANTS))).alias("k", "u")).withColumn("k", F.col("k").cast("string"))
    n = F.expr(_NUMBER)
    base = lambda x, b: F.lower(F.conv(x.cast("string"), 10, b))
    octet = lambda k: F.shiftright(n, 8 * (3 - k)).bitwiseAND(255)
    said = {"{d}": n, "{x}": base(n, 16), "{o}": base(n, 8), "{a}": octet(0), "{r}": n.bitwiseAND((1 << 24) - 1), "{ax}": base(octet(0), 16), "{bo}": base(octet(1), 8), "{c}": n.bitwiseAND(65535), "{h}": base(F.shiftright(n, 16), 16), "{l}": base(n.bitwiseAND(65535), 16)}

    def form(pattern: str):
        out = F.lit(pattern)
        for name, value in said.items():
            if name in pattern:
                out = F.replace(out, F.lit(name), value.cast("string"))
        return out

    forms = pages.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), form(p).alias("u")) for k, p in _FORMS.items()))).alias("f")).select("page_id", "f.k", "f.u")
    return rows.unionByName(forms).select("page_id", "k", urls.unsafe_reason(F.col("u")).alias("reason"))


@query(
    "html_field_extract",
    """SELECT page_id, regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS lang,
    coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]*content="([^"]*)"[^>]*name="description"', 1), '')) AS description,
    array_to_string(list_transform(regexp_extract_all(html, 'href="(/[^"]*)"', 1), lambda x: x), ' ') AS links, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS n_links FROM pages""",
)
def _fields(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return read_table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("html", "(?i)<title[^>]*>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", r'(?i)<html[^>]*\slang="([^"]*)"', 1).alias("lang"),
        F.coalesce(some('(?i)<meta[^>]*name="description"[^>]*content="([^"]*)"'), some('(?i)<meta[^>]*content="([^"]*)"[^>]*name="description"')).alias("description"),
        F.array_join(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)), " ").alias("links"),
        F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).cast("long").alias("n_links"),
    )


@query(
    "apply_method",
    """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS d, lower(coalesce(lang, '')) || '/' || doc_id || (CASE WHEN doc_id % 9 = 0 THEN '.PDF' ELSE '' END) AS url FROM documents),
    e AS (SELECT *, coalesce(nullif(regexp_extract(d, 'apply\\s+(via\\s+)?email\\s+(to|at)\\s+([^\\s,]+)', 3), ''), nullif(regexp_extract(d, 'mailto:([^"''<>\\s?]+)', 1), ''),
      nullif(regexp_extract(d, 'send\\s+(your\\s+)?(cv|resume|application)\\s+to\\s+([^\\s,]+)', 3), '')) AS email FROM d)
    SELECT doc_id, m AS method, CASE WHEN m = 'EMAIL' THEN email END AS email FROM (SELECT *, CASE WHEN lower(url) LIKE '%.pdf' OR contains(d, 'pdf application form') THEN 'PDF_FORM' WHEN contains(email, '@') THEN 'EMAIL'
      WHEN contains(d, 'apply in person') OR contains(d, 'submit at office') OR contains(d, 'submit in person') OR contains(d, 'drop off') OR contains(d, 'walk-in') THEN 'IN_PERSON'
      WHEN contains(d, 'requires a') AND (contains(d, 'account') OR contains(d, 'registration')) THEN 'SOURCE_ACCOUNT' ELSE 'ONLINE_URL' END AS m FROM e)""",
)
def _apply(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lower(F.coalesce("lang", F.lit(""))), F.lit("/"), F.col("doc_id"), F.when(F.col("doc_id") % 9 == 0, ".PDF").otherwise(""))
    return read_table(spark, sf, "documents").select("doc_id", text.apply_method(url, F.col("text")).alias("a")).select("doc_id", "a.*")


_POST_TITLES = ", ".join(
    "(SELECT CASE WHEN length(x) BETWEEN 5 AND 120 THEN x END FROM (SELECT regexp_replace(regexp_replace(trim(nullif(regexp_extract(text, " + _q(p) + ", 1), '')), '(?i)\\A(?:at|@|for)\\s+', ''), '(?i)\\s*[-–]\\s*(?:deadline|how to apply).*\\z', '') AS x))"
    for p in posts.TITLES
)


# What a post says of its deadline, and the date that this is; the shapes go round.
_N, _SHAPE = "(conv_id % 28 + 1)", "(turn + conv_id) % 7 + 1"
_POST_DEADLINE = f"['deadline: ' || {_N} || ' March 2024', 'Deadline: ' || {_N} || '/9/2024', 'deadline: jun ' || {_N} || ', 2024', 'deadline:' || {_N} || '-November-24', 'deadline: ' || {_N} || ' Xyz 2024', 'closes by ' || {_N} || '.dec.99', 'deadline: 7.' || {_N} || '.2025'][{_SHAPE}]"
_POST_DATE = f"[make_date(2024, 3, {_N}), CASE WHEN {_N} <= 12 THEN make_date(2024, {_N}, 9) END, make_date(2024, 6, {_N}), make_date(2024, 11, {_N}), NULL, make_date(1999, 12, {_N}), make_date(2025, 7, {_N})][{_SHAPE}]"


@query(
    "post_extract",
    f"""WITH p AS (SELECT conv_id, turn, role || ' vacancy: ' || 'Q' || left(text, 24) || '
Company: ' || left(text, 9) || '
' || {_POST_DEADLINE} || '
apply ' || (CASE WHEN conv_id % 2 = 0 THEN 'hr' || conv_id || '@firm.example.' ELSE 'https://firm.example/' || conv_id || ' ' END) || text AS text FROM conversations),
    t AS (SELECT *, coalesce({_POST_TITLES}, list_filter(list_transform(regexp_split_to_array(text, '[.\\n]'), lambda x: trim(x)), lambda x: length(x) BETWEEN 10 AND 100 AND regexp_matches(x, '^[A-Z]'))[1]) AS title
          FROM p WHERE length(text) >= 50 AND regexp_matches(text, {_q(posts.GATE)})),
    d AS (SELECT *, nullif(regexp_extract(text, {_q(posts.EMAIL)}), '') AS e FROM t WHERE title IS NOT NULL)
    SELECT conv_id, turn, title, coalesce({', '.join(f"left(trim(nullif(regexp_extract(text, {_q(p)}, 1), '')), 100)" for p in posts.COMPANIES)}, 'Unknown') AS company,
      {_POST_DATE} AS deadline,
      e AS apply_email, CASE WHEN e IS NULL THEN nullif(regexp_extract(text, {_q(posts.LINK)}), '') END AS apply_url, {_EXPERIENCE.replace(' t ', ' lower(title) ').replace('(t,', '(lower(title),')} AS experience_level, length(left(text, 2000)) AS n_description FROM d""",
)
def _posts(spark: SparkSession, sf: str) -> DataFrame:
    t, turn = F.col("text"), F.col("turn")
    n = F.col("conv_id") % 28 + 1
    shapes = (("deadline: ", n, " March 2024"), ("Deadline: ", n, "/9/2024"), ("deadline: jun ", n, ", 2024"), ("deadline:", n, "-November-24"), ("deadline: ", n, " Xyz 2024"), ("closes by ", n, ".dec.99"), ("deadline: 7.", n, ".2025"))
    said = F.element_at(F.array(*(F.concat(*(x if x is n else F.lit(x) for x in s)) for s in shapes)), ((turn + F.col("conv_id")) % len(shapes) + 1).cast("int"))
    contact = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("hr"), F.col("conv_id"), F.lit("@firm.example."))).otherwise(F.concat(F.lit("https://firm.example/"), F.col("conv_id"), F.lit(" ")))
    made = F.concat(F.col("role"), F.lit(" vacancy: Q"), F.substring(t, 1, 24), F.lit("\nCompany: "), F.substring(t, 1, 9), F.lit("\n"), said, F.lit("\napply "), contact, t)
    found = posts.parse_posts(read_table(spark, sf, "conversations").select("conv_id", "turn", made.alias("text")))
    return found.select("conv_id", "turn", "title", "company", "deadline", "apply_email", "apply_url", "experience_level", F.length("description").alias("n_description"))


_NAMES = "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in text.NAMED_ENTITIES.items()) + "}"
_POINT = lambda n: f"CASE WHEN {n} BETWEEN 1 AND 1114111 AND NOT {n} BETWEEN 55296 AND 57343 THEN chr(CAST({n} AS INTEGER)) ELSE p END"


@query(
    "entity_decode",
    f"""WITH s AS (SELECT page_id, string_split(regexp_replace(html, '(?i)(&(?:#\\d{{2,6}}|#x[0-9a-f]{{2,6}}|[a-z]{{2,8}});)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM pages),
    d AS (SELECT page_id, array_to_string(list_transform(ps, lambda p: CASE WHEN regexp_full_match(p, '&#\\d{{2,6}};') THEN {_POINT("CAST(p[3:-2] AS BIGINT)")} WHEN regexp_full_match(p, '(?i)&#x[0-9a-f]{{2,6}};') THEN {_POINT("CAST('0x' || p[4:-2] AS BIGINT)")}
      WHEN regexp_full_match(p, '(?i)&[a-z]{{2,8}};') THEN coalesce(({_NAMES})[lower(p[2:-2])], p) ELSE p END), '') AS h FROM s)
    SELECT page_id, length(h) AS n_chars, md5(h) AS html_md5 FROM d""",
)
def _entities(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their character references decoded; tests hold the rule against Python's own table."""
    return read_table(spark, sf, "pages").select("page_id", text.decode_entities(F.col("html")).alias("h")).select("page_id", F.length("h").alias("n_chars"), F.md5(F.col("h").cast("binary")).alias("html_md5"))


@query(
    "deadline_extract",
    """WITH d AS (SELECT doc_id, text || ' Application deadline &nbsp; : ' || (CASE doc_id % 4 WHEN 0 THEN 'September ' || (doc_id % 28 + 1) || ', 2026' WHEN 1 THEN (doc_id % 28 + 1) || ' <b>Oct.</b> 2025' WHEN 2 THEN 'soon' ELSE 'Foo 3, 2024 or closing date 31 December 1999' END) AS t FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN make_date(2026, 9, CAST(doc_id % 28 + 1 AS BIGINT)) WHEN 1 THEN make_date(2025, 10, CAST(doc_id % 28 + 1 AS BIGINT)) END AS deadline FROM d WHERE t IS NOT NULL""",
)
def _deadline(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    day = (i % 28 + 1).cast("string")
    said = (
        F.when(i % 4 == 0, F.concat(F.lit("September "), day, F.lit(", 2026")))
        .when(i % 4 == 1, F.concat(day, F.lit(" <b>Oct.</b> 2025")))
        .when(i % 4 == 2, "soon")
        .otherwise("Foo 3, 2024 or closing date 31 December 1999")
    )
    docs = read_table(spark, sf, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", text.deadline_in(F.concat("text", F.lit(" Application deadline &nbsp; : "), said)).alias("deadline"))


@query("experience_and_employment", with_("job") + f"""SELECT job_id, {_EXPERIENCE} AS experience_level, CASE WHEN t LIKE '%part%' THEN 'PART_TIME' WHEN t LIKE '%contract%' OR t LIKE '%freelance%' THEN 'CONTRACT'
 WHEN t LIKE '%intern%' THEN 'INTERNSHIP' WHEN t LIKE '%temp%' THEN 'TEMPORARY' WHEN t LIKE '%full%' THEN 'FULL_TIME' ELSE 'UNKNOWN' END AS employment_type FROM (SELECT job_id, lower(title) AS t FROM job)""")  # fmt: skip
def _experience(spark: SparkSession, sf: str) -> DataFrame:
    return R.job(spark, sf).select("job_id", phrases.experience(F.col("title")).alias("experience_level"), phrases.employment(F.col("title")).alias("employment_type"))


@query(
    "salary_normalize",
    with_("job")
    + f"""SELECT job_id, CASE WHEN salary <> 0 THEN salary END AS salary, CASE WHEN salary IS NULL OR salary = 0 THEN coalesce(nullif(currency, ''), 'USD') WHEN upper(currency) IN {CURRENCIES} THEN upper(currency) ELSE 'USD' END AS currency,
    CASE WHEN salary <> 0 AND parse_confidence <> 0 THEN CAST(floor((salary + parse_confidence) / 2.0 + 0.5) AS BIGINT) ELSE coalesce(nullif(salary, 0), parse_confidence) END AS mid FROM job""",
)
def _pay(spark: SparkSession, sf: str) -> DataFrame:
    amount, currency = money.normalize_pay(F.col("salary"), F.col("currency"))
    return R.job(spark, sf).select("job_id", amount.alias("salary"), currency.alias("currency"), money.midpoint(F.col("salary"), F.col("parse_confidence").cast("long")).alias("mid"))
