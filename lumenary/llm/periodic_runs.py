"""Runs of words that repeat with a period, by Lyndon stacks under both orders and rolling-hash extensions."""

from __future__ import annotations

from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.llm.arrow import add_columns, byte_texts

#: Fewest words of a run, and fewest periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that a comparison looks at before it turns to hashes.
DIRECT = 16

_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Extensions:
    """How far the words from two places on, or before them, agree.

    Prefix sums of w[k] * base^k modulo 2^64 stand for the words; a binary search over them finds a length,
    which the words themselves then confirm. Equal words always have equal hashes, so a length that is
    confirmed is the right one; where hashes have lied, the words are compared.
    """

    def __init__(self, ids: np.ndarray) -> None:
        n = self.n = len(ids)
        self.ids = ids
        self.power = np.full(n + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * self.power[:n], out=self.sums[1:])

    @cached_property
    def _numbers(self) -> tuple[array, array]:
        return array("Q", self.sums.tobytes()), array("Q", self.power.tobytes())

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from i and from j on have equal hashes; i <= j."""
        return (self.sums[i + size] - self.sums[i]) * self.power[j - i] == self.sums[j + size] - self.sums[j]

    def after(self, i: int, j: int) -> int:
        """Words that agree from i and j on; i < j."""
        s, powers = self._numbers
        shift, low, high, a, b = powers[j - i], 0, self.n - j, s[i], s[j]
        while low < high:
            k = (low + high + 1) // 2
            if ((s[i + k] - a) * shift - s[j + k] + b) & _MASK:
                high = k - 1
            else:
                low = k
        x, y = self.ids[i : i + low], self.ids[j : j + low]
        return low if np.array_equal(x, y) else int(np.argmax(x != y))

    def before(self, i: int, j: int) -> int:
        """Words that agree just before i and j, backwards; i < j."""
        s, powers = self._numbers
        shift, low, high, a, b = powers[j - i], 0, i, s[i], s[j]
        while low < high:
            k = (low + high + 1) // 2
            if ((a - s[i - k]) * shift - b + s[j - k]) & _MASK:
                high = k - 1
            else:
                low = k
        x, y = self.ids[i - low : i][::-1], self.ids[j - low : j][::-1]
        return low if np.array_equal(x, y) else int(np.argmax(x != y))


def lyndon_ends(order: np.ndarray, extensions: Extensions) -> np.ndarray:
    """For each place the end of the longest Lyndon word that starts there, from right to left; a text's end is less than any word.

    The words between a place and the next smaller suffix form that word, so the ends are the stack.
    ``order`` numbers the words as they compare.
    """
    n = len(order)
    w = array("q", np.append(order.astype(np.int64), -1).tobytes())
    ends = array("q", bytes(8 * (n + 1)))
    known: dict[int, tuple[int, int]] = {}  # by distance: places from the first on agree with those so far behind, up to the second, where they differ

    def less(i: int, j: int) -> bool:
        p, k = j - i, 1
        low, high = known.get(p, (n, n))
        most = min(DIRECT, n - j)
        while k < most and not low <= i + k <= high and w[i + k] == w[j + k]:
            k += 1
        if low <= i + k <= high:
            k = high - i
            known[p] = (i, high)
        elif k == DIRECT:
            k = extensions.after(i, j)
            known[p] = (i, i + k)
        return w[i + k] < w[j + k]

    for i in range(n - 1, -1, -1):
        x, j = w[i], i + 1
        while (y := w[j]) > x or y == x and less(i, j):
            j = ends[j]
        ends[i] = j
    return np.frombuffer(ends, np.int64)[:n]


def find_runs(ids: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of so many words and smallest periods at least, by start, then period.

    A run with the period p holds, under one of the two orders, a word of p that is the longest Lyndon
    word at its start; ``min_periods`` is two or more.
    """
    n = len(ids)
    if n < min_words or n < min_periods:
        return []
    extensions = Extensions(ids)
    found: dict[int, list[tuple[int, int]]] = {}
    for order in (ids, ids.max() - ids):
        end = lyndon_ends(order, extensions)
        at = np.arange(n)
        period = end - at
        # Of what a run needs besides the word itself, at least half lies on one side of it.
        half = (np.maximum(min_words - period, (min_periods - 1) * period) + 1) // 2
        right = end + half <= n
        right[right] = extensions.same(at[right], end[right], half[right])
        left = at >= half
        left[left] = extensions.same((at - half)[left], (end - half)[left], half[left])
        for i in np.flatnonzero(right | left).tolist():
            j = int(end[i])
            runs = found.setdefault(j - i, [])
            if any(a <= i and j <= b for a, b in runs[-2:]):
                continue
            a, b = i - extensions.before(i, j), j + extensions.after(i, j)
            if b - a >= max(min_words, min_periods * (j - i)) and (a, b) not in runs[-2:]:
                runs.append((a, b))
    return sorted({(a, b - a, p) for p, runs in found.items() for a, b in runs}, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and those of each run's first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words by equal numbers, as they first occur."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``docs`` with runs, an array of (start, length, period) by start, then period, and collapsed, the text without repeats.

    Words are runs without ASCII white space, numbered from 0. A run is a stretch of words with the
    smallest period q, of ``min_words`` and ``min_periods`` * q words at least, that cannot be
    extended; its words after the first q are left out of collapsed, whose words are joined by one
    space. Null and empty texts have no runs and an empty collapsed text. Rows are read one by one,
    so ties and repeated rows agree, and memory follows the longest text. Columns of ``docs`` with
    these names are replaced.
    """

    def make(column: pa.Array) -> list:
        runs, kept = [], []
        for t in byte_texts(column):
            words = t.split()
            found = find_runs(numbered(words), min_words, min_periods)
            runs.append([dict(zip(RUN.names, r, strict=True)) for r in found])
            kept.append(collapse(words, found).decode())
        return [runs, kept]

    return add_columns(docs, text, [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())], make)


def plant_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every tenth text, by the CRC-32 of its key, made periodic from some word on.

    With h that sum, g = h / 10 and n words, a = g % n and p = 1 + (n - a) / (3 + g % 8): each word
    i >= a becomes word a + (i - a) % p. A null key or text and a text without words stay as they are.
    """
    h = F.crc32(F.col(key).cast("string"))
    hit = (h % 10 == 0) & F.col(text).isNotNull()
    words = F.when(hit, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    ready = docs.withColumn("_words", words)
    n, g = F.size("_words").cast("long"), F.floor(h / 10)
    ready = ready.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.floor((n - F.col("_a")) / (3 + g % 8)) + 1)

    def word(w: Column, i: Column) -> Column:
        return F.when(i >= F.col("_a"), F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))).otherwise(w)

    planted = F.when(F.col("_p").isNotNull(), F.array_join(F.transform("_words", word), " ")).otherwise(F.col(text))
    return ready.select(*(planted.alias(text) if c == text else F.col(c) for c in docs.columns))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one, and the digests of all runs and of what is kept."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.s")).alias("start"),
        F.col("_longest.l").alias("length"),
        (-F.col("_longest.p")).alias("period"),
        F.floor(1000 * F.col("_longest.l") / -F.col("_longest.p")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
