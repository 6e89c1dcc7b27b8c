"""Postings in the free text of channel posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.functions.phrases import experience
from lumenary.functions.text import MONTHS

# ---- fixed values
LEAST_CHARS, CONFIDENCE, MOST_DESCRIPTION = 50, 65, 2000
GATE = "(?i)job|position|vacancy|required|qualification|degree|experience|deadline|apply|submit"
TITLES = (r"(?i)(?:position|job title|vacancy):\s*([^\n]+)", r"\A([A-Z][^.!?\n]{10,80})", r"(?:🔹|▪️|✅|💎|🎨|📋)\s*([^\n]+)")
COMPANIES = (
    r"(?i)(?:company|organization|employer):\s*([^\n]+)",
    r"(?:at|@)\s+([A-Z][A-Za-z\s&]+(?:PLC|Ltd|Inc|Corp|SC|S\.C\.|Company|Organization))",
    r"#([A-Za-z_]+(?:PLC|Ltd|Inc|Corp|SC|Company))",
)
DEADLINES = (
    r"(?i)deadline:\s*(\d{1,2}[-/.]\w+[-/.]\d{2,4})",
    r"(?i)deadline:\s*(\w+\s+\d{1,2},?\s*\d{4})",
    r"(?i)deadline:\s*(\d{1,2}\s+\w+\s+\d{4})",
    r"(?i)by\s+(\d{1,2}[-/.]\w+[-/.]\d{2,4})",
)
EMAIL, LINK = r"[\w.+-]+@[\w-]+\.[\w.-]+", r"https?://[^\s<>\"]+"
# ----


def _some(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def loose_date(text: Column) -> Column:
    """A date as posts write it: numbers with the month first, or a month's name before or after the day.

    Years of two digits are of 2000 up to 49, else of 1900. A day beyond its month, up to 31, runs into the
    next one; other days, months beyond 12 and words that begin with no month's name give null.
    """
    names = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)))
    named = lambda word: F.try_element_at(names, F.lower(F.substring(word, 1, 3)))

    def date(pattern: str, day: int, month: int, by_name: bool) -> Column:
        at = lambda g: F.regexp_extract(text, pattern, g)
        d, y = at(day).try_cast("int"), at(3).try_cast("int")
        m = named(at(month)) if by_name else at(month).try_cast("int")
        year = F.when(F.length(at(3)) > 2, y).when(y < 50, y + 2000).otherwise(y + 1900)
        return F.when(d.between(1, 31) & m.between(1, 12) & (year > 0), F.date_add(F.make_date(year, m, F.lit(1)), d - 1))

    return F.coalesce(
        date(r"\A(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})\z", 2, 1, False),
        date(r"\A(\d{1,2})[-/.\s]+([A-Za-z]+)[-/.\s]+(\d{2,4})\z", 1, 2, True),
        date(r"\A([A-Za-z]+)\s+(\d{1,2}),?\s*(\d{4})\z", 2, 1, True),
    )


def title(text: Column) -> Column:
    """First pattern that gives 5 to 120 characters, else the first line or sentence of 10 to 100 that begins with a capital."""

    def cleaned(p: str) -> Column:
        t = F.regexp_replace(F.trim(_some(text, p, 1)), r"(?i)\A(?:at|@|for)\s+", "")
        t = F.regexp_replace(t, r"(?i)\s*[-–]\s*(?:deadline|how to apply).*\z", "")
        return F.when(F.length(t).between(5, 120), t)

    lines = F.transform(F.split(text, r"[.\n]"), lambda x: F.trim(x))
    line = F.try_element_at(F.filter(lines, lambda x: F.length(x).between(10, 100) & x.rlike(r"\A[A-Z]")), F.lit(1))
    return F.coalesce(*map(cleaned, TITLES), line)


def parse_posts(posts: DataFrame, text: str = "text") -> DataFrame:
    """Columns of a posting for the posts that look like one; the others go.

    A post needs 50 characters, a word of work and a title. Null texts are no postings.
    """
    t = F.col(text)
    deadline = F.coalesce(*(loose_date(F.regexp_extract(t, p, 1)) for p in DEADLINES))
    email = _some(t, EMAIL, 0)
    found = posts.where((F.length(t) >= LEAST_CHARS) & t.rlike(GATE)).withColumn("title", title(t)).where(F.col("title").isNotNull())
    return found.select(
        *posts.columns,
        "title",
        F.coalesce(*(F.substring(F.trim(_some(t, p, 1)), 1, 100) for p in COMPANIES), F.lit("Unknown")).alias("company"),
        deadline.alias("deadline"),
        email.alias("apply_email"),
        F.when(email.isNull(), _some(t, LINK, 0)).alias("apply_url"),
        experience(F.col("title")).alias("experience_level"),
        F.lit("FULL_TIME").alias("employment_type"),
        F.lit("ONSITE").alias("work_place"),
        F.lit(CONFIDENCE).alias("parse_confidence"),
        F.substring(t, 1, MOST_DESCRIPTION).alias("description"),
    )
