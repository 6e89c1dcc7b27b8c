"""URLs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary.functions.bind import let

# ---- fixed values
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "ref", "source", "via", "sharer", "share_source")
BLOCKED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
# ----


def ipv4(text: str) -> int:
    """An address as a number."""
    a, b, c, d = map(int, text.split("."))
    return a << 24 | b << 16 | c << 8 | d


def blocked_ranges() -> list[tuple[int, int]]:
    """(first, last) of the blocked IPv4 ranges."""
    return [(ipv4(base), ipv4(base) | (1 << 32 - bits) - 1) for base, bits in BLOCKED_V4]


def _whole(digits: Column, base: int, most: int) -> Column:
    """Digits of a base as a number; null if there are more than ``most`` besides leading zeros, or others than the base has."""
    valid = digits.rlike({8: r"\A[0-7]*\z", 10: r"\A[0-9]+\z", 16: r"\A[0-9a-f]*\z"}[base])
    number = lambda short: F.when(valid & (F.length(short) <= most), F.conv(F.concat(F.lit("0"), short), base, 10).cast("long"))
    return let(F.regexp_replace(digits, r"\A0+", ""), number)


def _part_number(part: Column) -> Column:
    """A part of an IPv4 host: hexadecimal behind 0x, octal behind 0, else decimal; null if it is none."""
    return (
        F.when(part.startswith("0x"), _whole(F.substring(part, 3, 1 << 30), 16, 8))
        .when(part.startswith("0") & (F.length(part) > 1), _whole(F.substring(part, 2, 1 << 30), 8, 11))
        .otherwise(_whole(part, 10, 10))
    )


#: A lower-case host whose last part is a number, so that it must be an IPv4 address; a final dot does not count.
_NUMERIC = r"(?:\A|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z"


def ipv4_number(host: Column) -> Column:
    """A lower-case IPv4 host as a number, in any form that a URL may have: one to four parts, of which the last fills the rest; null for any other host."""
    room = F.array(*(F.lit(256**k) for k in (4, 3, 2, 1))).cast("array<bigint>")

    def whole(n: Column) -> Column:
        before = F.slice(n, 1, F.greatest(F.lit(0), F.size(n) - 1))
        sums = F.aggregate(before, F.lit(0).cast("long"), lambda a, x: F.when((x <= 255), a * 256 + x))  # null from the first part that is no byte
        return let(F.get(room, F.size(n) - 1), lambda most: F.when(F.element_at(n, -1) < most, sums * most + F.element_at(n, -1)))

    parts = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.")
    return F.when(host.rlike(_NUMERIC), let(F.transform(parts, _part_number), whole))


def blocked_ipv4(n: Column) -> Column:
    """Whether a numeric address is in a private, local or reserved range."""
    ranges = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in blocked_ranges()))
    return F.coalesce(F.exists(ranges, lambda r: n.between(r["a"], r["b"])), F.lit(False))


def ipv6_groups(host: Column) -> Column:
    """The eight numbers of a lower-case IPv6 literal, ``::`` expanded and a dotted end read as two; null if it is none."""
    dotted = F.regexp_extract(host, r"\A(?:.*:)?([^:]*)\z", 1)
    four = F.when(dotted.rlike(r"\A(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})\z"), ipv4_number(dotted))
    tail = let(four, lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF)))))
    plain = F.when(host.contains("."), F.concat(F.regexp_extract(host, r"\A(.*:)?[^:]*\z", 1), tail)).otherwise(host)
    side = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def joined(sides: Column) -> Column:
        """One side without ``::``, or two around it."""
        gap = 8 - F.size(F.flatten(sides))
        return F.when(F.size(sides) == 1, sides[0]).when((F.size(sides) == 2) & (gap > 0), F.concat(sides[0], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), gap)), F.try_element_at(sides, F.lit(2))))

    numbers = lambda every: F.when((F.size(every) == 8) & F.forall(every, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z")), F.transform(every, lambda g: F.conv(g, 16, 10).cast("long")))
    return let(let(F.transform(F.split(plain, "::"), side), joined), numbers)


def blocked_ipv6(groups: Column) -> Column:
    """Whether the numbers of an IPv6 address are loopback, unique local, link-local, multicast, or an IPv4 address that is blocked."""
    first = groups[0]
    local = (first.bitwiseAND(0xFE00) == 0xFC00) | (first.bitwiseAND(0xFFC0) == 0xFE80) | (first.bitwiseAND(0xFF00) == 0xFF00)
    zero = F.forall(F.slice(groups, 1, 5), lambda g: g == 0)
    four = groups[6] * 65536 + groups[7]
    inner = zero & groups[5].isin(0, 0xFFFF) & (blocked_ipv4(four) | ((groups[5] == 0) & (four <= 1)))
    return local | inner


def unsafe_reason(url: Column) -> Column:
    """Why a URL must not be fetched: scheme, credentials, port, host or address; null if nothing speaks against it."""
    part = lambda g: F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?", g)
    scheme, port = F.lower(part(1)), part(4)
    four = lambda n: F.when(n.isNull(), "INVALID").when(blocked_ipv4(n), "ADDRESS")
    six = lambda groups: F.when(groups.isNull(), "INVALID").when(blocked_ipv6(groups), "ADDRESS")

    def by_host(host: Column) -> Column:
        return (
            F.when((host == "") | (host == "localhost") | host.endswith(".localhost"), "HOST")
            .when(host.startswith("["), let(ipv6_groups(F.regexp_extract(host, r"\A\[(.*)\]\z", 1)), six))
            .when(host.rlike(_NUMERIC), let(ipv4_number(host), four))
        )

    return (
        F.when(scheme == "", "INVALID")
        .when(~scheme.isin("http", "https"), "SCHEME")
        .when(part(2) != "", "CREDENTIALS")
        .when((port != "") & ~port.isin("80", "443"), "PORT")
        .otherwise(let(F.lower(part(3)), by_host))
    )


def normalize_url(raw: Column, base: Column | None = None) -> Column:
    """An absolute https URL without tracking parameters; text that is no URL comes back as it is."""
    url = raw
    if base is not None:
        root = F.regexp_extract(base, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
        folder = F.regexp_extract(base, r"\A([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
        url = (
            F.when(raw.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*:"), raw)
            .when(raw.startswith("//"), F.concat(F.regexp_extract(base, r"\A[a-zA-Z][a-zA-Z0-9+.-]*:", 0), raw))
            .when(raw.startswith("/"), F.concat(root, raw))
            .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), raw))
        )
    part = lambda g: F.regexp_extract(url, r"\A(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z", g)
    host = F.lower(part(2))
    scheme = F.when(host.contains("localhost"), part(1)).otherwise("https")
    path = F.when(part(3) == "", "/").otherwise(part(3))
    kept = F.filter(F.split(F.substring(part(4), F.lit(2), F.length(part(4))), "&"), lambda p: ~F.substring_index(p, "=", 1).isin(*TRACKING) & (p != ""))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(part(1) == "", raw).otherwise(F.concat(scheme, F.lit("://"), host, path, query, part(5)))
