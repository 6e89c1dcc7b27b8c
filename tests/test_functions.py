"""Scalar rules against worked examples."""

import html
import re

import pytest
from pyspark.sql import functions as F

from lumenary import dims
from lumenary.functions import money, phrases, text, times, urls
from lumenary.operators import keyset, skills
from lumenary.operators.runs import backoff_hours


@pytest.fixture(scope="module")
def ask(spark):
    def run(make, *args):
        row = spark.createDataFrame([tuple(args)], ", ".join(f"c{k} {t}" for k, t in enumerate({str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}[type(a)] for a in args)))
        return row.select(make(*(F.col(f"c{k}") for k in range(len(args)))).alias("x")).first().x

    return run


@pytest.mark.parametrize("raw, want", [("node", "Node.js"), ("NodeJS", "Node.js"), ("Node.js", "Node.js"), ("ts", "TypeScript"), ("postgres", "PostgreSQL"), (" Basket weaving ", "Basket weaving"), ("", "")])
def test_canonical(ask, raw, want):
    assert ask(skills.canonical, raw) == want


def test_related():
    near = {(a, b): (t, r) for a, b, t, r in dims.transfer_pairs()}
    assert all(near[p][1] for p in [("JavaScript", "TypeScript"), ("Node.js", "NestJS"), ("PostgreSQL", "SQL")])
    assert ("Node.js", "PostgreSQL") not in near and ("SQL", "SQL") not in near
    assert near["JavaScript", "TypeScript"][0] == pytest.approx(0.68) and near["JavaScript", "React"][0] == pytest.approx(0.64)
    assert near["SQL", "PostgreSQL"][0] == near["PostgreSQL", "SQL"][0] == 0.85


@pytest.mark.parametrize("title, role, want", [("Junior Backend Engineer", "Backend Developer", 0.75), ("Accounting Clerk", "Accountant", 0), ("Software Engineer", "Full Stack Developer", 0.75), ("Head Nurse", "Nurse", 1), ("Senior_accountant", '"accountant"', 1)])
def test_role_similarity(spark, title, role, want):
    titles = spark.createDataFrame([(title,)], "title string")
    roles = spark.createDataFrame([(role,)], "role string").select(skills.role_key(F.col("role")).alias("role"))
    got = skills.role_similarity(titles, roles, spark).collect()
    assert (got[0].similarity if got else 0) == want


def test_signals(spark):
    wanted = spark.createDataFrame([(1, "TypeScript"), (1, "React"), (1, "Cooking")], "job_id long, skill string")
    offered = spark.createDataFrame([(9, "JavaScript"), (9, "cooking")], "user_id long, skill string")
    got = {r.skill: (r.kind, round(r.earned, 2)) for r in skills.skill_signals(wanted, offered, spark).collect()}
    assert got == {"TypeScript": ("transferable", 0.68), "React": ("transferable", 0.64), "Cooking": ("direct", 1.0)}


def test_prerequisites(ask):
    assert ask(skills.knows, "NestJS", ["Node.js", "TypeScript"]) and not ask(skills.knows, "NestJS", ["Node.js"]) and ask(skills.knows, "Painting", [])


@pytest.mark.parametrize("title, want", [("Graduate Trainee", "INTERN"), ("Accountant I", "ENTRY"), ("Junior Lead", "SENIOR"), ("Head of Sales", "LEAD"), ("Sr Nurse", "SENIOR"), ("Cook", "UNKNOWN"), (None, "UNKNOWN"), ("éintern", "INTERN")])
def test_experience(ask, title, want):
    assert ask(phrases.experience, title) == want


@pytest.mark.parametrize("raw, want", [("Part-time contract", "PART_TIME"), ("Freelance", "CONTRACT"), ("internship", "INTERNSHIP"), ("Temporary", "TEMPORARY"), ("Full Time", "FULL_TIME"), ("?", "UNKNOWN"), (None, "UNKNOWN")])
def test_employment(ask, raw, want):
    assert ask(phrases.employment, raw) == want


def test_phrases(ask):
    assert ask(phrases.contains_phrase, "Senior Full-Stack (C++) dev", "full stack") and not ask(phrases.contains_phrase, "accounting", "account") and not ask(phrases.contains_phrase, "x", "--")
    assert ask(lambda t: phrases.known_skills(t, ("Go", "SQL", "Java"), 2), "sql, JAVA, go") == ["Go", "SQL"]


def test_pay(ask):
    assert ask(money.parse_pay, "$50k - 70k/yr") == 60000 and ask(money.parse_pay, "1,500") == 1500 and ask(money.parse_pay, "much") is None
    assert ask(money.midpoint, 0, 9) == 9 and ask(money.midpoint, 4, 9) == 7 and ask(money.midpoint, 0, 0) is None
    assert ask(lambda a: money.half_up(a), -2.5) == -2
    assert [ask(money.percentile_in, a, 10, 20) for a in (5, 15, 99)] == [0, 50, 100] and ask(money.percentile_in, 5, 7, 7) == 50


ENTITIES = "&lt;b&gt; &amp;lt; &#8211; &#x2014; &#X41; &eacute;&NBSP; &bogus; &#7; &#99999999; & &#128512;"


def test_entities(ask):
    one = lambda m: (
        (chr(int(m[1])) if m[1] else chr(int(m[2], 16)) if m[2] else text.NAMED_ENTITIES.get(m[3].lower(), m[0]))
    )
    want = re.sub(r"&(?:#(\d{2,6})|#[xX]([0-9a-fA-F]{2,6})|([a-zA-Z]{2,8}));", one, ENTITIES)
    assert ask(text.decode_entities, ENTITIES) == want
    assert ask(text.decode_entities, "&#72;i &amp; bye") == html.unescape("&#72;i &amp; bye") and ask(text.decode_entities, None) is None and ask(text.decode_entities, "") == ""


def test_descriptions(ask):
    assert ask(text.clean_description, "<nav>x</nav>Donâ€™t  wait\n\n\n\nApply  now <b>x</b><FORM a>y</form> ") == "Don't wait<b>x</b>"
    assert ask(text.truncate_html, "ab<b>c") == "ab<b>c" and ask(lambda t: text.truncate_html(t, 4), "ab<b class>cd") == "ab<b class>" and ask(lambda t: text.truncate_html(t, 2), "abcd") == "ab"
    assert ask(text.quality, "") == 0 and ask(text.quality, "x" * 300) == 85 and ask(text.quality, "Apply now... Ã©") == 5 + 5 + 12 + 0
    assert ask(text.light_clean, "<script>a</script><p>b</p>\n c") == "<p>b</p> c" and ask(text.escape_html, "<a&b>") == "&lt;a&amp;b&gt;"


@pytest.mark.parametrize(
    "url, said, want",
    [
        ("https://x/a.PDF", None, ("PDF_FORM", None)),
        ("u", "Send your CV to Jobs@x.org, now", ("EMAIL", "jobs@x.org")),
        ("u", '<a href="mailto:hr@x.org">', ("EMAIL", "hr@x.org")),
        ("u", "Walk-in only", ("IN_PERSON", None)),
        ("u", "requires a free account", ("SOURCE_ACCOUNT", None)),
        ("u", "", ("ONLINE_URL", None)),
    ],
)
def test_apply(ask, url, said, want):
    assert tuple(ask(text.apply_method, url, said)) == want


def test_names_and_dates(ask):
    assert ask(text.company, "Acme, Inc.") == "Acme" and ask(text.company, "Incorporate") == "Incorporate"
    assert ask(text.fingerprint, "Acme PLC", " Dev ", "Here", "A  b!c") == "Acme|dev|here|a bc"
    assert str(ask(text.deadline_in, "Closing date: <b>6 September 2026</b>")) == "2026-09-06" and ask(text.deadline_in, "the deadline is near, 2026") is None
    assert str(ask(text.epoch_or_iso, "1704164645")) == str(ask(text.epoch_or_iso, "1704164645000")) == str(ask(text.epoch_or_iso, "2024-01-02T03:04:05Z")) == "2024-01-02 03:04:05"
    assert str(ask(text.parse_when, "31/08/2026"))[:10] == "2026-08-31" and ask(text.parse_when, "soon") is None


@pytest.mark.parametrize(
    "raw, base, want",
    [
        ("http://A.example/x?utm_source=f&b=1&ref=z#t", "", "https://a.example/x?b=1#t"),
        ("http://localhost:3000", "", "http://localhost:3000/"),
        ("/p?a=1", "https://h.example/x/y", "https://h.example/p?a=1"),
        ("q", "https://h.example/x/y", "https://h.example/x/q"),
        ("//c.example/z", "https://h.example", "https://c.example/z"),
        ("mailto:x", "https://h.example", "mailto:x"),
    ],
)
def test_urls(ask, raw, base, want):
    assert ask(lambda r, b: urls.normalize_url(r, b), raw, base) == want


@pytest.mark.parametrize("url, want", [("https://8.8.8.8/", None), ("http://172.31.255.255", "ADDRESS"), ("http://172.32.0.1", None), ("http://[fe80::1]/", "ADDRESS"), ("http://[2001:db8::1]/", None), ("file:///etc", "SCHEME"), ("http://u@h/", "CREDENTIALS"), ("http://h:22/", "PORT"), ("nonsense", "INVALID")])
def test_safety(ask, url, want):
    assert ask(urls.unsafe_reason, url) == want


def test_backoff(ask):
    assert [ask(backoff_hours, n) for n in (0, 2, 3, 5, 30)] == [0, 0, 1, 4, 24]


def test_cursor():
    assert keyset.decode_cursor(keyset.encode_cursor(None, 7)) == (None, 7) and keyset.decode_cursor("%%") is None and keyset.decode_cursor(None) is None
    assert [keyset.clamp_limit(x) for x in (0, 5, 500, None, 2.5, True)] == [50, 5, 100, 50, 50, 50]


@pytest.mark.parametrize("descending", [True, False])
def test_pages_join_to_the_full_order(spark, descending):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else k // 4) for k in range(25)], "id long, key long")
    order = [F.col("key").desc_nulls_last(), F.col("id").desc()] if descending else [F.col("key").asc_nulls_first(), F.col("id").asc()]
    want, got, cursor = [r.id for r in rows.orderBy(*order).collect()], [], None
    while True:
        some = keyset.page(rows, "key", "id", 4, cursor, descending).collect()
        got += [r.id for r in some[:4]]
        if len(some) <= 4:
            break
        cursor = (some[3].key, some[3].id)
    assert got == want


def test_times(ask):
    assert [times.duration_ms(t, 7) for t in ("30m", "6 h", "1500", None, "soon")] == [1_800_000, 21_600_000, 1500, 7, 7]
    assert ask(times.json_list, '["a", "b"]') == ["a", "b"] and ask(times.json_list, "no json") == [] and ask(times.json_list, None) == []
