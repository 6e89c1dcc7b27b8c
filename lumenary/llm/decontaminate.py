"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark text."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.llm.arrow import add_columns, byte_texts
from lumenary.llm.storage import durable

#: Words of a window, bytes of benchmark text that one automaton holds, and words after which an item is split.
WINDOW, AUTOMATON_BYTES, PIECE_WORDS = 10, 2 << 20, 4096
#: Bytes of words, lowered; every other byte becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and anything beyond ASCII."""
    return text.translate(_FOLD).split()


class Scanner:
    """One automaton over words; a pattern is a window, with the numbers of the items that have it.

    A word is one symbol, written as the character of its number, so a window makes as many nodes as it
    has words at most. Benchmark text of AUTOMATON_BYTES has fewer words than there are characters.
    """

    def __init__(self, texts: list[bytes], size: int = WINDOW) -> None:
        owners: dict[str, set[int]] = {}
        self.symbol: dict[bytes, str] = {}
        for k, text in enumerate(texts):
            w = "".join([self.symbol.setdefault(x, chr(len(self.symbol) + 2)) for x in words_of(text)])
            for i in range(max(1, len(w) - size + 1)) if w else ():
                owners.setdefault(w[i : i + size], set()).add(k)
        # Children of a node are searched in the order in which they came: unknown words first, then the frequent ones.
        often = Counter(w[0] for w in owners)
        self.automaton = ahocorasick.Automaton()
        self.automaton.add_word("\0\1", (0, set()))
        for w, items in sorted(owners.items(), key=lambda x: -often[x[0][0]]):
            self.automaton.add_word(w, (len(w), items))
        self.automaton.make_automaton()
        self.some = bool(owners)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words of the text, merged runs [first, end) of hit words, and items found."""
        w = words_of(text)
        if not w or not self.some:
            return len(w), [], set()
        found = [(end + 1, *value) for end, value in self.automaton.iter("".join(map(self.symbol.get, w, repeat("\0"))))]
        runs: list[list[int]] = []
        for a, b in sorted((end - n, end) for end, n, _ in found):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        return len(w), [(a, b) for a, b in runs], set().union(*(f[2] for f in found))


def word_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as code-point spans of the original text."""
    at = [m.span() for m in _WORD.finditer(text.lower())]
    starts = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
    points = np.concatenate([[0], np.cumsum(starts)])
    return [{"start": int(points[at[a][0]]), "end": int(points[at[b - 1][1]])} for a, b in runs]


def _scan_block(docs: DataFrame, items: list, texts: list[bytes], item_type: T.DataType, size: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, texts))
    ready: list[Scanner] = []

    def make(column: pa.Array) -> list:
        names, patterns = shared.value
        if not ready:
            ready.append(Scanner(patterns, size))
        out: list[list] = [[], [], [], []]
        for text in byte_texts(column):
            n, runs, found = ready[0].scan(text)
            out[0].append(n)
            out[1].append(sum(b - a for a, b in runs))
            out[2].append(sorted({names[k] for k in found}))
            out[3].append(word_spans(text, runs) if runs else [])
        return out

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("hit_spans", SPAN)]
    return add_columns(docs, "text", fields, make)


def _merged(spans: str) -> F.Column:
    """Sorted spans with the touching or overlapping ones joined."""
    step = (
        "aggregate(array_sort({0}), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) -> "
        "if(size(acc) > 0 and s.start <= element_at(acc, -1).end, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))), "
        "concat(acc, array(s))))"
    )
    return F.expr(step.format(spans))


def _pieces(bench: DataFrame, size: int, words: int = PIECE_WORDS) -> DataFrame:
    """Rows (item, text) whose texts have a bounded number of words: an item's windows are dealt to pieces, of which each ends with the start of the next."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = bench.select("item", F.regexp_extract_all(low, F.lit(_WORD.pattern.decode()), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1), F.lit(words))
    return split.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, words + size - 1), " "))).alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items and hit_spans; ``text`` is the column scanned.

    A document word is hit if it lies in an occurrence of any window of ``size`` benchmark words;
    hit_spans are code-point spans of the original text, items the ids with a window in it, in order.
    A null text has no words; an item with a null id or no words is left out; equal items and
    repeated rows change nothing. Columns of ``docs`` with these names are replaced.

    The benchmark's bytes are summed first. Up to ``automaton_bytes`` it is broadcast as one
    automaton and the documents are read once, without a shuffle. Beyond that its items, the long ones
    in pieces, are dealt to blocks of that size, every block scans all documents, and the hits of a row are then united.
    """
    bench = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    bench = _pieces(bench, size).distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    automaton_bytes = min(automaton_bytes, AUTOMATON_BYTES)  # more words might not fit the characters that stand for them
    blocks = max(1, math.ceil(2 * total / automaton_bytes)) if total > automaton_bytes else 1
    item_type = bench.schema["item"].dataType

    def block(k: int) -> tuple[list, list[bytes]]:
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        rows = part.collect()
        return [r.item for r in rows], [r.text.encode() for r in rows]

    if blocks == 1:
        return _scan_block(docs, *block(0), item_type, size)
    names = ["n_words", "n_hit", "items", "hit_spans"]
    numbered = durable(docs.drop(*names).withColumn("_row", F.monotonically_increasing_id()))
    hits = None
    for k in range(blocks):
        part = durable(_scan_block(numbered.select("_row", "text"), *block(k), item_type, size).drop("text"))
        hits = part if hits is None else hits.unionByName(part)
    # Words inside several blocks' spans count once: the united spans are scanned for words again.
    united = hits.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("hit_spans")).alias("hit_spans"),
    ).withColumn("hit_spans", _merged("hit_spans"))
    inside = F.expr(r"aggregate(hit_spans, 0L, (n, s) -> n + regexp_count(lower(substring(text, cast(s.start as int) + 1, cast(s.end - s.start as int))), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))")
    return numbered.join(united, "_row").withColumn("n_hit", inside).drop("_row").select(*(c for c in docs.columns if c not in names), *names)
