"""Byte-level BPE: DuckDB recursive queries contract the distinct words of a partition."""

from __future__ import annotations

import base64
import gc
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenary.llm.arrow import KEPT, add_columns, texts

#: White space by Unicode's property, as the word pattern means it (fixed values).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Parts of a text that the word pattern never joins or looks beyond: a run without white space with
#: the one space before it, white space before white space, or a single white space.
_UNITS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
#: Characters of text taken together, words known to a worker at most, token rows of one query at
#: most (a word of n bytes makes up to n*n/2), and bytes beyond which a word goes to the heap instead.
GROUP_CHARS, KNOWN_WORDS, QUERY_ROWS, LONG_WORD = 6 << 20, 700_000, 1_000_000, 1024

_ENCODE = """
WITH RECURSIVE s(it, w, pos, tok, after, next) AS (
  SELECT 0, w, pos, tok, after, next FROM words
  UNION ALL
  (WITH least AS (SELECT s.w, min((m.rank::BIGINT << 32) | s.pos) AS best
                  FROM s JOIN merges m ON m.pair = ((s.tok::BIGINT << 32) | s.after) WHERE s.after >= 0 GROUP BY s.w),
        pick AS (SELECT w, (best & 4294967295)::INT AS pos, (best >> 32)::INT AS rank FROM least),
        edge AS (SELECT s.w, s.pos, s.next, pick.rank, r.after, r.next AS beyond
                 FROM pick JOIN s ON s.pos = pick.pos JOIN s r ON r.pos = s.next)
   SELECT s.it + 1, s.w, s.pos,
          CASE WHEN s.pos = edge.pos THEN edge.rank ELSE s.tok END,
          CASE WHEN s.pos = edge.pos THEN edge.after WHEN s.next = edge.pos THEN edge.rank ELSE s.after END,
          CASE WHEN s.pos = edge.pos THEN edge.beyond ELSE s.next END
   FROM s JOIN edge ON s.w = edge.w WHERE s.pos <> edge.next))
SELECT w, list(tok ORDER BY pos) AS ids FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) last USING (w, it) GROUP BY w ORDER BY w
"""
_DECODE = """
SELECT w, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """One DuckDB connection with the merge table and the vocabulary of a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        left, right, rank = np.array(pairs, np.int64).T if pairs else np.zeros((3, 0), np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._table("merges", pair=left << 32 | right, rank=rank.astype(np.int32))
        self._table("vocabulary", id=np.fromiter(ranks.values(), np.int32), hex=[t.hex() for t in ranks])
        #: Words with their ids and the bytes of these: the ones met lately, and those of the time before.
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}

    def _table(self, table: str, **columns: np.ndarray | list) -> None:
        given = pa.table(columns)  # noqa: F841  DuckDB finds it by name
        self.db.execute(f"CREATE OR REPLACE TABLE {table} AS SELECT * FROM given")

    def _query(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one behind the other, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(flat), dtype=np.int32)
        tok = self.single[flat]
        after = np.append(tok[1:], np.int32(-1))
        after[np.cumsum(size) - 1] = -1
        self._table("words", w=np.repeat(np.arange(len(words), dtype=np.int32), size), pos=pos, tok=tok, after=after, next=pos + 1)
        ids = self.db.sql(_ENCODE).to_arrow_table().column("ids").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        return ids.flatten().to_numpy(zero_copy_only=False), np.diff(ids.offsets.to_numpy())

    def _heap(self, word: bytes) -> list[int]:
        """The same contraction for a very long word, whose token rows would grow with its square."""
        tok: list[int | None] = self.single[np.frombuffer(word, np.uint8)].tolist()
        parts = [word[i : i + 1] for i in range(len(word))]
        after, before = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        queue: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (rank := self.ranks.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(queue, (rank, i, both))

        for i in range(len(word)):
            offer(i)
        while queue:
            rank, i, both = heapq.heappop(queue)
            if tok[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != both or len(parts[i]) == len(both):
                continue
            parts[i], tok[i], tok[j], after[i] = both, rank, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [t for t in tok if t is not None]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one behind the other, and how many each has; they go to the recursive query in groups of bounded size."""
        found, group, rows = [], [], 0

        def flush() -> None:
            nonlocal group, rows
            if group:
                found.append(self._query(group))
            group, rows = [], 0

        for w in words:
            if len(w) > LONG_WORD:
                flush()
                ids = self._heap(w)
                found.append((np.array(ids), np.array([len(ids)])))
                continue
            group.append(w)
            rows += len(w) * (len(w) + 1) // 2
            if rows >= QUERY_ROWS:
                flush()
        flush()
        ids, sizes = zip(*found, strict=True) if found else ([np.zeros(0)], [np.zeros(0, np.int64)])
        return np.concatenate(ids).astype("<u4"), np.concatenate(sizes).astype(np.int64)

    def decode(self, flat: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Bytes of each sequence of ids, by an ordered aggregation; ``flat`` has the sequences one behind the other."""
        out = [b""] * len(size)
        if len(flat):
            self._table("tokens", w=np.repeat(np.arange(len(size), dtype=np.int32), size), pos=np.arange(len(flat), dtype=np.int32), id=flat.astype(np.int32))
            found = self.db.sql(_DECODE).to_arrow_table()
            for w, b in zip(found.column("w").to_pylist(), found.column("bytes").to_pylist(), strict=True):
                out[w] = b
        return out

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet, and decode their ids."""
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > KNOWN_WORDS // 2:
            self.known, self.before, missing = {}, self.known, words
        known, before, new = self.known, self.before, []
        for w in missing:
            if (pair := before.get(w)) is None:
                new.append(w)
            else:
                known[w] = pair
        if new:
            flat, size = self.encode_words([w.encode() for w in new])
            raw, ends = flat.tobytes(), np.cumsum(size) * 4
            ids = (raw[a:b] for a, b in zip((ends - size * 4).tolist(), ends.tolist(), strict=True))
            known.update(zip(new, zip(ids, self.decode(flat, size), strict=True), strict=True))

    def code(self, group: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers, and the bytes that they decode to, of each text."""
        gc.disable()  # hundreds of thousands of short lists, none in a cycle
        try:
            units = list(map(_UNITS.findall, group))
            split = self.pattern.findall
            words = {u: split(u) for u in set().union(*units)}
            self.learn(set(chain.from_iterable(words.values())))
            known, join = self.known, b"".join
            ids, text = {}, {}
            for u, ws in words.items():
                if len(ws) == 1:
                    ids[u], text[u] = known[ws[0]]
                else:
                    pairs = [known[w] for w in ws]
                    ids[u], text[u] = join([p[0] for p in pairs]), join([p[1] for p in pairs])
            return zip([join(map(ids.__getitem__, us)) for us in units], [join(map(text.__getitem__, us)) for us in units], strict=True)
        finally:
            gc.enable()


def coder(path: str, pattern: str) -> Coder:
    """The worker's coder for a rank file; kept, with the words that it knows, for the worker's next tasks."""
    if (path, pattern) not in KEPT:
        KEPT[path, pattern] = Coder(read_ranks(path), pattern)
    return KEPT[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", fields: list[T.StructField] | None = None, make=None) -> DataFrame:
    """``docs`` with ``ids`` (little-endian 32-bit integers) and ``decoded`` (the bytes of those ids).

    Each match of ``pattern`` is contracted by itself, leftmost pair of least rank first; special
    tokens do not exist. A null or empty text has no ids. Distinct words of some megabytes of text
    go to a DuckDB recursive query together; a bounded number is remembered by the worker. Rows
    are coded one by one, so repeated rows agree; columns with these names are replaced. ``path`` is
    the rank file, at the same place on every executor. With ``fields`` and ``make``, those columns
    are made from each (ids, decoded) instead, so that they need not leave the worker.
    """
    fields = fields or [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    make = make or (lambda ids, decoded: (ids, decoded))

    def run(column: pa.Array) -> list:
        own, out, group, size = coder(path, pattern), [[] for _ in fields], [], 0
        rows = texts(column)
        for k, t in enumerate(rows):
            group.append(t)
            size += len(t)
            if size >= GROUP_CHARS or k == len(rows) - 1:
                for pair in own.code(group):
                    for o, v in zip(out, make(*pair), strict=True):
                        o.append(v)
                group, size = [], 0
        return out

    return add_columns(docs, text, fields, run)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of a column of ids as encode_decode() makes it; null ids decode to nothing."""

    def run(column: pa.Array) -> list:
        rows = [b or b"" for b in column.to_pylist()]
        return [coder(path, pattern).decode(np.frombuffer(b"".join(rows), "<u4"), np.array([len(b) // 4 for b in rows], np.int64))]

    return add_columns(rows, ids, [T.StructField("decoded", T.BinaryType())], run)
