"""Descriptions: entities, cleaning, quality, how to apply, deadlines and fingerprints, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary.functions.bind import let
from lumenary.functions.phrases import word

MOST_CHARS, FINGERPRINT_CHARS = 8000, 500

# ---- fixed values
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "\u2013", "mdash": "\u2014", "hellip": "\u2026",
    "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "bulls": "\u2022", "middot": "\u00b7", "eacute": "é",
    "egrave": "è", "agrave": "à", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú", "uuml": "ü", "ouml": "ö", "auml": "ä",
    "ntilde": "ñ", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "cent": "¢",
}
DROPPED_TAGS = ("script", "style", "nav", "aside", "footer", "header", "form", "noscript")
LIGHT_TAGS = ("script", "style", "nav", "footer", "aside", "form")
MOJIBAKE = (("â€™", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ('â€"', "—"), ("Ã©", "é"), ("Ã¨", "è"), ("Ã¼", "ü"), ("Ã¶", "ö"), ("Ã¤", "ä"))
BOILERPLATE = (
    r"(?i)apply\s+now",
    r"(?i)share\s+(this|on)",
    r"©\s*\d{4}",
    r"(?i)all\s+rights\s+reserved",
    r"(?i)cookie(s)?\s+(policy|notice|consent)",
    r"(?i)privacy\s+policy",
    r"(?i)terms\s+(of|&)\s+(service|use|conditions)",
    r"(?i)sign\s+up\s+(for|to)\s+(updates|newsletter)",
    r"(?i)follow\s+us\s+on",
    r"(?i)social\s+media",
    r"(?i)share\s+(this|on)\s+(twitter|facebook|linkedin|whatsapp)",
    r"(?i)\.\.\./more",
    r"\.\.\.\s*\z",
    r"(?md)^\s*\.{3}\s*",
)
#: In lower case, one of these is in every text that some pattern of BOILERPLATE is found in.
BOILERPLATE_WORDS = ("apply", "share", "©", "rights", "cookie", "privacy", "terms", "sign", "follow", "social", "...")
LEGAL_SUFFIX = r"(?i)\s*,?\s*(PLC|LLC|Inc\.?|Ltd\.?|Corp\.?|Co\.?|SA|AG|BV|GmbH|Pty\.?)\z"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
IN_PERSON = ("apply in person", "submit at office", "submit in person", "drop off", "walk-in")
# ----


def _code_point(n: Column) -> Column:
    """The character of a code point; null for a number that is none."""
    ok = (n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decode_entities(html: Column) -> Column:
    """Character references decoded once, unknown ones kept. Each is a piece of a split, so nothing is decoded twice."""
    pieces = F.split(F.regexp_replace(html, r"(?i)(&(?:#\d{2,6}|#x[0-9a-f]{2,6}|[a-z]{2,8});)", "\x01$1\x01"), "\x01")
    names = F.create_map(*(F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair))

    def one(p: Column) -> Column:
        decimal = F.regexp_extract(p, r"\A&#(\d{2,6});\z", 1)
        hexa = F.regexp_extract(p, r"(?i)\A&#x([0-9a-f]{2,6});\z", 1)
        name = F.regexp_extract(p, r"(?i)\A&([a-z]{2,8});\z", 1)
        number = F.coalesce(decimal.try_cast("long"), F.conv(F.nullif(hexa, F.lit("")), 16, 10).try_cast("long"))
        return F.coalesce(_code_point(number), F.try_element_at(names, F.lower(F.nullif(name, F.lit("")))), p)

    return F.when(html.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(html)


def without_tags(html: Column, tags: tuple[str, ...], by: str = "") -> Column:
    """Elements removed with what is in them, tag by tag."""
    return reduce(lambda t, tag: F.regexp_replace(t, rf"(?i)<{tag}[^>]*>[\s\S]*?</{tag}>", by), tags, html)


def light_clean(html: Column) -> Column:
    """Scripts, styles and page furniture gone, white space collapsed; structural tags stay."""
    return F.trim(F.regexp_replace(without_tags(F.coalesce(html, F.lit("")), LIGHT_TAGS, " "), r"[\s\u00a0]+", " "))


def strip_html(html: Column) -> Column:
    """Text without tags and with the commonest references decoded."""
    t = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"(?i)&nbsp;", " ")
    for name, by in (("amp", "&"), ("lt", "<"), ("gt", ">")):
        t = F.regexp_replace(t, f"(?i)&{name};", by)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"&#\d+;", ""), r"[\s\u00a0]+", " "))


def _has_boilerplate_word(text: Column) -> Column:
    """A plain search that tells most texts without boilerplate."""
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, (low.contains(w) for w in BOILERPLATE_WORDS)))


def clean_description(raw: Column) -> Column:
    """Page furniture, mojibake and boilerplate gone; white space collapsed, line by line. Patterns are tried where a plain search finds what each needs."""
    replaced = lambda t: reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, t)
    without = lambda t: reduce(lambda x, pattern: F.regexp_replace(x, pattern, ""), BOILERPLATE, t)
    t = let(F.coalesce(raw, F.lit("")), lambda t: F.when(t.contains("<"), without_tags(t, DROPPED_TAGS)).otherwise(t))
    t = let(t, lambda t: F.when(t.contains("â") | t.contains("Ã"), replaced(t)).otherwise(t))
    t = let(t, lambda t: F.when(_has_boilerplate_word(t), without(t)).otherwise(t))
    t = F.regexp_replace(t, r"[^\S\n]+", " ")
    t = let(t, lambda t: F.when(t.contains("\n"), F.regexp_replace(F.regexp_replace(t, r"\n\s*\n\s*\n", "\n\n"), r"(?md)^\s+|\s+$", "")).otherwise(t))
    return F.regexp_replace(t, r"\A\s+|\s+\z", "")


def truncate_html(html: Column, most: int = MOST_CHARS) -> Column:
    """The first ``most`` characters, and the rest of a tag that would be cut."""
    cut = F.substring(html, 1, most)
    open_tag = F.regexp_extract(cut, r"<[^<>]*\z", 0) != ""
    rest = F.substring(html, F.lit(most + 1), F.length(html))
    end = F.locate(">", rest)
    return F.when(F.length(html) <= most, html).when(open_tag & (end > 0), F.concat(cut, F.substring(rest, F.lit(1), end))).otherwise(cut)


def quality(text: Column) -> Column:
    """0 to 100 by length, truncation, boilerplate, mojibake and structure."""
    hits = F.when(_has_boilerplate_word(text), sum((F.when(text.rlike(p), 1).otherwise(0) for p in BOILERPLATE), F.lit(0))).otherwise(0)
    cut = text.contains("...") | text.contains("…") | text.rlike("(?i:/more)")
    points = (
        let(F.length(text), lambda n: F.when(n >= 300, 30).when(n >= 200, 20).when(n >= 100, 10).otherwise(5))
        + F.when(cut, 5).otherwise(20)
        + let(hits, lambda n: F.when(n == 0, 20).when(n <= 2, 12).otherwise(5))
        + F.when(text.contains("â€") | text.contains("Ã"), 0).otherwise(15)
        + F.when(text.rlike(r"(?md)^#{1,6}\s|^[A-Z][A-Za-z\s]{2,}:$"), 5).otherwise(0)
        + F.when(text.rlike(r"(?md)^[\s]*[-*•]\s|^[\s]*\d+[.)]\s"), 5).otherwise(0)
        + F.when(F.regexp_count(text, F.lit("\n")) >= 3, 5).otherwise(0)
    )
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.least(F.lit(100), points))


def apply_method(url: Column, description: Column) -> Column:
    """struct(method, email): how a posting wants to be answered; the first rule that fits."""
    d = F.lower(F.coalesce(description, F.lit("")))
    found = lambda p, g: F.nullif(F.regexp_extract(d, p, g), F.lit(""))
    email = F.coalesce(
        found(r"apply\s+(via\s+)?email\s+(to|at)\s+([^\s,]+)", 3),
        found(r"mailto:([^\"'<>\s?]+)", 1),
        found(r"send\s+(your\s+)?(cv|resume|application)\s+to\s+([^\s,]+)", 3),
    )
    in_person = reduce(lambda a, b: a | b, (d.contains(p) for p in IN_PERSON))
    method = (
        F.when(F.lower(url).endswith(".pdf") | d.contains("pdf application form"), "PDF_FORM")
        .when(email.contains("@"), "EMAIL")
        .when(in_person, "IN_PERSON")
        .when(d.contains("requires a") & (d.contains("account") | d.contains("registration")), "SOURCE_ACCOUNT")
        .otherwise("ONLINE_URL")
    )
    return F.struct(method.alias("method"), F.when(method == "EMAIL", email).alias("email"))


def company(name: Column) -> Column:
    """A company without its legal suffix."""
    return F.trim(F.regexp_replace(name, LEGAL_SUFFIX, ""))


def fingerprint(company_name: Column, title: Column, location: Column, description: Column) -> Column:
    """What two copies of a posting share: company, title, location and the start of the description."""
    d = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), r"[^a-z0-9_\s]", "")
    d = F.substring(F.trim(F.regexp_replace(d, r"\s+", " ")), 1, FINGERPRINT_CHARS)
    return F.concat_ws("|", company(company_name), F.trim(F.lower(title)), F.trim(F.lower(location)), d)


def deadline_in(text: Column) -> Column:
    """First date that follows a word for deadline, month or day first; a date from 2000 to 2100."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), "(?i)&nbsp;", " "), r"[\s\u00a0]+", " "))
    tails = F.regexp_extract_all(t, F.lit(rf"(?i){word('application deadline|closing date|deadline')}[^a-zA-Z0-9]{{0,10}}(?=(.{{0,80}}))"), F.lit(1))
    numbers = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)))

    def date(tail: Column, pattern: str, month: int, day: int) -> Column:
        at = lambda g: F.regexp_extract(tail, pattern, g)
        m = F.try_element_at(numbers, F.lower(F.substring(at(month), 1, 3)))
        d, y = at(day).try_cast("int"), at(3).try_cast("int")
        days = F.when(d.between(1, 31) & y.between(2000, 2100) & m.isNotNull(), F.expr("1"))
        return F.when(days == 1, F.date_add(F.make_date(y, m, F.lit(1)), d - 1))

    def one(tail: Column) -> Column:
        return F.coalesce(
            date(tail, r"(?<![A-Za-z0-9_])([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?![A-Za-z0-9_])", 1, 2),
            date(tail, r"(?<![A-Za-z0-9_])(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})(?![A-Za-z0-9_])", 2, 1),
        )

    return F.try_element_at(F.filter(F.transform(tails, one), lambda d: d.isNotNull()), F.lit(1))


def parse_when(raw: Column) -> Column:
    """A moment from the declared formats: ISO, day first with slashes or hyphens, and month names; UTC."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSS]['Z']", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")
    return F.coalesce(*(F.try_to_timestamp(F.trim(raw), F.lit(f)).cast("timestamp_ntz") for f in formats))


def epoch_or_iso(raw: Column) -> Column:
    """A moment from seconds or milliseconds since 1970, as a number or as its digits, or from an ISO text."""
    n = raw.try_cast("double")
    at = F.when(n < 1e12, F.timestamp_millis((n * 1000).cast("long"))).when(n.isNotNull(), F.timestamp_millis(n.cast("long")))
    return F.coalesce(at.cast("timestamp_ntz"), parse_when(raw))


def escape_html(text: Column) -> Column:
    """Text for a message in HTML mode."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
