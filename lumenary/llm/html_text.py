"""Main text of web pages by the distribution of text over lines of blocks."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenary.llm.arrow import add_columns, texts

#: Lines of a sliding window; characters that a window must reach for a surge, or this share of the page's
#: fullest window if that is less; weight of a character in an article or main element against one elsewhere.
WINDOW_LINES, SURGE_CHARS, SURGE_SHARE, BONUS = 3, 86, 0.2, 10
#: A line outside of an article is a menu if links have this share of its characters.
LINK_SHARE = 0.6

#: Elements without main text, elements that begin a line, and words of a class, id or role that
#: mark a menu, notice, advert, form or reader comment (fixed values).
_DROP = frozenset("nav header footer aside form button select textarea noscript iframe object svg canvas dialog figure menu template head title script style".split())
#: Of these, what is never the page itself.
_NEVER = _DROP - {"form"}
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
_CONTAINER = frozenset("address article aside details dialog div dl fieldset figure footer form header main nav ol section table ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion "
    "related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside one of these in a name, like comment-list; beside any other word, as in has-sidebar, a name marks nothing.
_BESIDE = frozenset("area bar block body bottom box btn button buttons col column container content entry form group header icons inner item items left link links list main menu outer panel post posts right row section text title top wrap wrapper".split())
#: A marked element stays if its characters are so many times those of all else, and there is no article.
WHOLE_PAGE = 3
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|template)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROP:
        return not (tag in ("header", "figure") and in_article)
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _MARK.finditer(attributes):
        names = m[2].strip("\"'").lower().split()
        if m[1].lower() == "role":
            if _NOISE_ROLES.intersection(names):
                return True
        elif any(_NOISE.intersection(parts := re.split("[_-]+", n)) and all(p in _NOISE or p in _BESIDE or p.isdigit() for p in parts) for n in names):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, in article) of each line; an element that is marked as no main text, but holds nearly all of it, is none."""
    wrappers: set[int] = set()
    while True:
        lines, left_out = _lines_of(page, wrappers)
        kept = sum(len(t) for t, w, _ in lines if w)
        whole = {at for at, n in left_out.items() if n > WHOLE_PAGE * kept}
        if not whole or any(inside for _, _, inside in lines):
            return lines
        wrappers |= whole


def _lines_of(page: str, wrappers: set[int]) -> tuple[list[tuple[str, int, bool]], dict[int, int]]:
    """Lines, and the characters of each element that was left out, by its place; those at ``wrappers`` are not.

    A line is the text between the borders of block elements. Its weight is its characters, times BONUS in an
    article or main element. Empty lines, as many as a window has, stand where a container begins or ends, so that
    the distribution dives between containers; within an article they do not. Menus, notices and the like have no weight.
    """
    lines: list[tuple[str, int, bool]] = []
    left_out: dict[int, int] = {}
    parts: list[str] = []
    linked = depth = skip = at = skipped_at = 0
    skipped, in_link = "", False

    def close(dive: bool = False) -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text and not skip:
            menu = not depth and linked >= LINK_SHARE * len(text)
            lines.append((text, 0 if menu else len(text) * (BONUS if depth else 1), depth > 0))
        if dive and not depth and lines and lines[-1][0]:
            lines.extend([("", 0, False)] * WINDOW_LINES)
        parts, linked = [], 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            text = html.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        elif raw and skipped not in _NEVER:
            left_out[skipped_at] = left_out.get(skipped_at, 0) + len(raw.strip())

    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if skip and tag in ("article", "main", "body") and not _is_noise(tag, m[4], False):
            skip = 0  # what was left open ends here
        if skip:
            if tag == skipped and tag not in _VOID:
                skip += -1 if closing else 1
            continue
        if tag in _BLOCK:
            close(tag in _CONTAINER)
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if tag == "a":
            in_link = not closing
        if closing:
            if tag in ("article", "main") and depth:
                depth -= 1
                close(True)
        elif _is_noise(tag, m[4], depth > 0) and m.start() not in wrappers:
            if tag not in _VOID and not m[4].endswith("/"):
                close(True)
                skip, skipped, skipped_at = 1, tag, m.start()
        elif tag in ("article", "main"):
            depth += 1
    take(page[at:])
    close()
    return lines, left_out


def main_text(page: str) -> str:
    """Blocks of the main text, joined by newlines; empty if there is none.

    Sums of the lines' weights over sliding windows surge where the main text begins and dive to
    nothing where it ends; all lines with weight between such points are kept. A window must reach
    SURGE_CHARS, or a share of the fullest one; where the fullest one is an article's, BONUS times SURGE_CHARS.
    """
    lines = lines_of(page)
    weight = np.array([w for _, w, _ in lines], np.int64)
    if not weight.any():
        return ""
    window = np.convolve(weight, np.ones(WINDOW_LINES, np.int64))  # sums that end at each line
    fullest = int(window.argmax())
    marked = any(inside for _, w, inside in lines[max(0, fullest - WINDOW_LINES + 1) : fullest + 1] if w)
    surge = min(SURGE_CHARS * (BONUS if marked else 1), SURGE_SHARE * window[fullest])
    full = np.concatenate([[0], window > 0, [0]])
    begins, ends = np.flatnonzero(np.diff(full) == 1), np.flatnonzero(np.diff(full) == -1)
    kept = np.zeros(len(lines), bool)
    for a, b in zip(begins, ends, strict=True):
        if window[a:b].max() >= surge:
            kept[a:b] = True
    return "\n".join(lines[k][0] for k in np.flatnonzero(kept & (weight > 0)))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, its code points.

    A null or empty page has an empty text, as has one of markup only; text without markup is one
    block. Pages are read one by one, so repeated rows agree; columns with these names are replaced.
    """

    def make(values: pa.Array) -> list:
        found = [main_text(p) for p in texts(values)]
        return [found, [len(t) for t in found]]

    return add_columns(pages, column, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)
