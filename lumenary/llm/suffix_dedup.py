"""Removal of strings that an earlier document has, by difference-cover names of their prefixes.

The strings are the byte strings of WINDOW bytes. Comparing them by suffix order needs no more of a
suffix than that prefix, so the recursion ends once names cover it:

* sampled positions are those not divisible by three, within a region of text;
* the triple at a sampled position is three symbols of six bytes, 18 bytes; triples are sorted, and their
  ranks are their names;
* the string of names is sampled again: the triple of names 15 bytes apart covers 48 bytes; these
  are sorted and named likewise;
* the remaining positions are merged by the cover's shifts: any two positions have a shift of 0, 1 or 2
  to sampled ones, so a prefix of 50 bytes is one such name and the two bytes beside it; these are sorted by rank;
* entries that are adjacent once sorted have equal prefixes; the smallest document among them owns it.

A name that only one document has ends there: no string over it can be in another.

Sorting is distributed by ranges: a bounded sample gives splitters, a unit of regions sorts its distinct keys and
sends each range to the task that merges it, and takes ranks back. So ranks order keys across all tasks.
Keys travel as compressed binary columns, so Spark moves few rows. Every unit writes to every part; as the input grows,
both get larger up to a bound and are sorted piece by piece, so that the messages stay few.

Two things choose the work and remove nothing by themselves. Of equal texts (SHA-256) only the first
document's goes through the method; the others are covered by it whole. And most text is in one document
only: the least hash of the grams in a string is the same wherever the string is, so strings whose least
hash no other document has are set aside.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.storage import discard, durable

#: Bytes of a string, of a gram of the filter, of a block's text, of a unit of regions; keys that a sorting task should get.
WINDOW, GRAM, BLOCK_BYTES, UNIT_BYTES, PART_KEYS = 50, 24, 6 << 20, 768 << 10, 600_000
#: From so many blocks or parts on these get larger, with the units of a block: blocks and parts up to so many times.
MANY, LARGER_BLOCKS, LARGER_PARTS = 64, 4, 8
#: Bytes of texts that the filter takes together, so that its arrays stay in the processor's cache, and of a piece of a longer text.
SLICE_BYTES, PIECE_BYTES = 96 << 10, 1 << 20
#: Bytes of a symbol, of a triple of symbols, distance of names, and bytes of a triple of names.
SYMBOL, FIRST, STEP, SECOND = 6, 18, 15, 48
#: Bounds of the sample for splitters: units, keys, and ranges. Where more parts are needed each range is dealt to several.
SAMPLE_UNITS, SAMPLE_KEYS, RANGES = 48, 1 << 18, 1 << 14
#: Bits of a name: its part and its rank there.
NAME_BITS = 46
_U = np.uint64
_MIX = tuple(map(_U, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))
NONE = np.iinfo(np.int64).max

REPLY = "unit long, part long, reply binary"
ASKED = "part long, unit long, n long, keys binary, docs binary"
MARKS = "unit long, doc binary, h binary, start binary, stop binary, bytes binary, names binary"


def squeezed(a: np.ndarray) -> bytes:
    """An array by planes of its bytes, compressed; sorted numbers become small."""
    planes = np.ascontiguousarray(a.reshape(len(a), -1).view(np.uint8).T) if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(blob: bytes, kind: type, width: int = 1) -> np.ndarray:
    """What squeezed() was given, with ``width`` columns."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    row = np.dtype(kind).itemsize * width
    return np.ascontiguousarray(planes.reshape(row, -1).T).view(kind).reshape(-1, width)


def packed(data: bytes, n: int) -> np.ndarray:
    """Each ``n`` (up to 8) consecutive bytes as one number that sorts like them."""
    many = max(0, len(data) - n + 1)
    eight = np.ndarray((many,), ">u8", data + bytes(8), strides=(1,)).astype(_U)
    return eight >> _U(8 * (8 - n)) if n < 8 else eight


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes, a multiple of eight, at each position."""
    p = packed(data, 8)
    n = max(0, len(data) - gram + 1)
    h = p[:n] * _MIX[0]
    for k in range(8, gram, 8):
        h = (h ^ h >> _U(29) ^ p[k : k + n]) * _MIX[k // 8 % 3]
    return h ^ h >> _U(33)


def least_hashes(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The least gram hash in the string of WINDOW bytes at each position."""
    width, have, m = WINDOW - gram + 1, 1, h
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where another value than the one before begins."""
    return np.append(True, ordered[1:] != ordered[:-1])


def sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and where each row is among them.

    As many bits as fit are packed into one number from the left, and only plain numbers are sorted. Rows that
    are equal so far are sorted again, by the number of their group and the bits that follow.
    """
    n = len(rows)
    if not n:
        return rows, np.zeros(0, np.int64)
    tops = [int(rows[:, k].max()).bit_length() for k in range(rows.shape[1])]
    k, left = 0, tops[0]  # the column and how many of its bits are still to be taken in

    def packed_more(code: np.ndarray, bits: int, some: np.ndarray | None) -> np.ndarray:
        nonlocal k, left
        while bits < 64:
            if not left:
                if k + 1 == len(tops):
                    break
                k, left = k + 1, tops[k + 1]
                continue
            take = min(left, 64 - bits)
            new = rows[:, k] if some is None else rows[some, k]
            new = new >> _U(left - take) if left > take else new
            code = (code << _U(take) | new & _U((1 << take) - 1)) if take < 64 else new
            bits, left = bits + take, left - take
        return code

    code = packed_more(np.zeros(n, _U), 0, None)
    order = np.argsort(code)
    new = _begins(code[order])
    while left or any(tops[k + 1 :]):
        tied = ~new
        tied[:-1] |= tied[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        some, group = order[where], np.cumsum(new[where], dtype=np.int64)
        code = packed_more(group.astype(_U), int(group[-1]).bit_length(), some)
        again = np.argsort(code)
        order[where] = some[again]
        new[where] = _begins(code[again])
    at = np.empty(n, np.int64)
    at[order] = np.cumsum(new, dtype=np.int64) - 1
    return rows[order[new]], at


def as_text(rows: np.ndarray) -> np.ndarray:
    """Rows as byte strings that sort like them."""
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * rows.shape[1]}").ravel()


class Splitters:
    """Where ranges of keys begin, and how many parts each range is dealt to."""

    def __init__(self, begins: np.ndarray, sub: int) -> None:
        self.begins, self.sub = begins, sub
        self.parts = (len(begins) + 1) * sub
        self.bits = NAME_BITS - self.parts.bit_length()

    def slices(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each part with the numbers of its keys; ``keys`` are sorted, and so are those of a part."""
        if not len(keys):
            return
        edges = np.concatenate([[0], np.searchsorted(as_text(keys), self.begins), [len(keys)]])
        for r in np.flatnonzero(np.diff(edges)):
            some = np.arange(edges[r], edges[r + 1])
            if self.sub == 1:
                yield int(r), some
                continue
            h = keys[some, 0] * _MIX[0]
            for k in range(1, keys.shape[1]):
                h = (h ^ keys[some, k] ^ h >> _U(29)) * _MIX[k % 3]
            place = (h >> _U(33)) % _U(self.sub)
            for p in np.unique(place).tolist():
                yield int(r) * self.sub + p, some[place == p]


class Asked:
    """Distinct keys of a unit in sorted order, with the least document of each."""

    def __init__(self, rows: np.ndarray, docs: np.ndarray) -> None:
        self.keys, self.at = sorted_rows(rows)
        self.docs, last = np.full(len(self.keys), NONE), np.full(len(self.keys), -NONE)
        np.minimum.at(self.docs, self.at, docs)
        np.maximum.at(last, self.at, docs)
        self.many = last > self.docs


def messages(unit: int, pieces: Iterable[Asked], splitters: Splitters, owners: bool) -> list[tuple]:
    """One to each part from all pieces of a unit: keys, and with ``owners`` their least documents, otherwise whether they have several."""
    to: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for own in pieces:
        docs = own.docs if owners else own.many.astype(np.int8)
        for part, some in splitters.slices(own.keys):
            to.setdefault(part, []).append((own.keys[some], docs[some]))
    out = []
    for part in sorted(to):
        keys, docs = (np.concatenate(c) for c in zip(*to.pop(part), strict=True))
        out.append((part, unit, len(keys), squeezed(keys), squeezed(docs)))
    return out


class Replies:
    """The parts' answers to messages(), taken piece by piece in the same order."""

    def __init__(self, table: pa.Table, splitters: Splitters, owners: bool) -> None:
        self.splitters, self.owners = splitters, owners
        self.blobs = dict(zip(table.column("part").to_pylist(), table.column("reply").to_pylist(), strict=True))
        self.left: dict[int, np.ndarray] = {}

    def _read(self, part: int) -> np.ndarray:
        got = unsqueezed(self.blobs.pop(part), np.int8 if self.owners else np.int64).ravel()
        if not self.owners:
            got = np.cumsum(got)
            got = np.where(got & 1, -1, part << self.splitters.bits | got >> 1)
        return got

    def of(self, own: Asked) -> np.ndarray:
        """For each key: with ``owners`` whether a document before its least one has it, otherwise its name, -1 if no other document has it."""
        out = np.zeros(len(own.keys), np.int64)
        for part, some in self.splitters.slices(own.keys):
            got = self.left.pop(part) if part in self.left else self._read(part)
            out[some] = got[: len(some)]
            self.left[part] = got[len(some) :]
        return out


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def _asked_table(rows: list[tuple]) -> pa.Table:
    return _table(rows, ["part", "unit", "n", "keys", "docs"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def _ranges(keys: np.ndarray) -> Iterator[np.ndarray | slice]:
    """The keys of a part in ascending ranges of about PART_KEYS, so that sorting takes little memory beside them."""
    many = len(keys) // PART_KEYS
    if many < 2:
        yield slice(None)
        return
    some = np.sort(keys[:: max(1, len(keys) // (256 * many)), 0])
    begins = np.unique(some[np.linspace(0, len(some), many, endpoint=False)[1:].astype(np.int64)])
    place = np.searchsorted(begins, keys[:, 0], side="right").astype(np.uint16)
    for p in range(len(begins) + 1):
        found = np.flatnonzero(place == p)
        if len(found):
            yield found


def _merge_part(width: int, owners: bool, bits: int):
    """Sort the keys that one part got from all units; answer with what Replies reads."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        ends = np.cumsum(sizes)
        keys, docs = np.empty((ends[-1], width), _U), np.empty(ends[-1], np.int64 if owners else np.int8)
        for n, end, k, d in zip(sizes.tolist(), ends.tolist(), table.column("keys"), table.column("docs"), strict=True):
            keys[end - n : end], docs[end - n : end] = unsqueezed(k.as_py(), _U, width), unsqueezed(d.as_py(), docs.dtype).ravel()
        reply, names = np.empty(len(keys), np.int8 if owners else np.int64), 0
        for some in _ranges(keys):
            distinct, at = sorted_rows(keys[some])
            if owners:
                least = np.full(len(distinct), NONE)
                np.minimum.at(least, at, docs[some])
                reply[some] = least[at] < docs[some]
            else:
                alone = np.bincount(at, docs[some] + 1)[at] < 2  # one document of a unit or more count as 1 or 2
                reply[some] = (at + names) * 2 + alone
            names += len(distinct)
        if not owners and names >> bits:
            raise ValueError(f"a part has {names} names, more than its {bits} bits: lower part_keys")
        out, part = [], table.column("part")[0].as_py()
        for unit, n, end in zip(table.column("unit").to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
            own = reply[end - n : end]
            out.append((unit, part, squeezed(own if owners else np.diff(own, prepend=0))))
        return _table(out, ["unit", "part", "reply"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _copies(copies: pa.Table) -> set[tuple[int, int]]:
    return set(zip(copies.column("doc_id").to_pylist(), copies.column("h").to_pylist(), strict=True))


def _texts(table: pa.Table, later: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(doc_id, h, where it begins, bytes) of pieces of the documents that have an id and a string and are no later copies."""
    for d, h, t in zip(table.column("doc_id").to_pylist(), table.column("h").to_pylist(), table.column("text").cast(pa.binary()), strict=True):
        if d is None or not t.is_valid or (d, h) in later:
            continue
        t = t.as_py()
        for a in range(0, len(t) - WINDOW + 1, PIECE_BYTES):
            yield d, h, a, t[a : a + PIECE_BYTES + WINDOW - 1]


class Slice:
    """Some texts of a block as whole regions: the runs of strings with one least hash."""

    def __init__(self, docs: list[tuple[int, int, int, bytes]]) -> None:
        start = np.array([a for _, _, a, _ in docs], np.int64)
        stop = start + [len(t) - WINDOW + 1 for *_, t in docs]
        self.texts = Regions(0, [d for d, *_ in docs], [h for _, h, *_ in docs], start, stop, b"".join([t for *_, t in docs]))
        self.begins, self.ends, least = self.texts.least_runs(gram_hashes(self.texts.text), GRAM)
        self.least = least * _MIX[0]  # minima are small numbers; their products are even


def _slices(table: pa.Table, later: set[tuple[int, int]]) -> Iterator[Slice]:
    some, size = [], 0
    for row in _texts(table, later):
        some.append(row)
        size += len(row[-1])
        if size >= SLICE_BYTES:
            yield Slice(some)
            some, size = [], 0
    if some:
        yield Slice(some)


def _filter_keys(table: pa.Table, later: set[tuple[int, int]]) -> tuple[list[Slice], Asked]:
    """The slices of a block, and the least hashes of their runs as keys."""
    slices, docs = [], []
    for s in _slices(table, later):
        docs.append(s.texts.doc[s.texts.of[s.begins]])
        s.texts.forget()
        slices.append(s)
    join = lambda some, kind: np.concatenate(some) if some else np.zeros(0, kind)
    return slices, Asked(join([s.least for s in slices], _U).reshape(-1, 1), join(docs, np.int64))


def _ask_filter(splitters: Splitters):
    def run(docs: pa.Table, copies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _asked_table([])
        return _asked_table(messages(docs.column("block")[0].as_py(), [_filter_keys(docs, _copies(copies))[1]], splitters, False))

    return run


def _within(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A mask of the positions in any of the spans."""
    edges = np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edges[:-1]) > 0


MARK_NAMES = ["unit", "doc", "h", "start", "stop", "bytes", "names"]
MARK_TYPES = [pa.int64(), *[pa.binary()] * 6]
_NO_MARKS = pa.table([pa.array([], t) for t in MARK_TYPES], names=MARK_NAMES)


def _mark(splitters: Splitters, unit_bytes: float):
    """The runs that other documents may share as units of regions, of some ``unit_bytes`` each."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _NO_MARKS
        told_copies = told.filter(pa.array([p is None for p in told.column("part").to_pylist()], pa.bool_()))
        later = _copies(told_copies)
        slices, asked = _filter_keys(docs, later)
        shared = Replies(told.filter(pa.array([p is not None for p in told.column("part").to_pylist()], pa.bool_())), splitters, False).of(asked)[asked.at] >= 0
        block, at, size, some, out = docs.column("block")[0].as_py(), 0, 0, [], []

        def flush() -> None:
            nonlocal some, size
            if some:
                whole = Regions(block << 24 | len(out), *(np.concatenate([r[k] for r in some]) for k in range(4)), b"".join([r[4] for r in some]))
                out.append(whole.row(None))
            some, size = [], 0

        for s in slices:
            known = shared[at : at + len(s.least)]
            at += len(s.least)
            if known.any():
                some.append(s.texts.cut(_within(s.begins[known], s.ends[known], len(s.texts.flat))))
                s.texts.forget()
                size += len(some[-1][4])
                if size >= unit_bytes:
                    flush()
        flush()
        return _table(out, MARK_NAMES, MARK_TYPES)

    return run


class Regions:
    """Regions of a unit one behind the other, with the sampled positions of each."""

    def __init__(self, unit: int, doc, h, start, stop, text: bytes, names: np.ndarray | None = None) -> None:
        self.unit, self.text, self.names = unit, text, names
        self.doc, self.h, self.start, self.stop = (np.asarray(c, np.int64) for c in (doc, h, start, stop))
        sizes = self.stop - self.start + WINDOW - 1
        self.flat = np.frombuffer(self.text, np.uint8)
        self.sizes, self.base = sizes, np.cumsum(sizes) - sizes

    @cached_property
    def of(self) -> np.ndarray:
        """The region of each byte."""
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    @cached_property
    def offset(self) -> np.ndarray:
        """Where in its region each byte is."""
        return np.arange(len(self.flat), dtype=np.int32) - np.repeat(self.base.astype(np.int32), self.sizes)

    @cached_property
    def left(self) -> np.ndarray:
        """Bytes from each one to the end of its region."""
        return np.repeat(self.sizes.astype(np.int32), self.sizes) - self.offset

    def forget(self) -> None:
        """Let go of what is derived for each byte."""
        for name in ("of", "offset", "left"):
            self.__dict__.pop(name, None)

    def pieces(self, depth: int) -> Iterator[Regions]:
        """The regions in pieces of some UNIT_BYTES, each with its part of the names that a round has."""
        ends = np.cumsum(self.sizes)
        edges = np.flatnonzero(np.append(True, np.diff(ends // UNIT_BYTES) > 0)).tolist() + [len(ends)]
        names = np.zeros(1, np.int64)
        if depth:
            many = np.maximum(0, self.sizes - (FIRST, SECOND)[depth - 1] + 1)
            names = np.append(0, np.cumsum(many - (many + 2) // 3))
        for i, j in zip(edges, edges[1:]):
            own = self.names[names[i] : names[j]] if depth else None
            if i < j:
                yield Regions(self.unit, self.doc[i:j], self.h[i:j], self.start[i:j], self.stop[i:j], self.text[self.base[i] : ends[j - 1]], own)

    @classmethod
    def read(cls, row: dict) -> Regions:
        names = None if row["names"] is None else unsqueezed(row["names"], np.int64).ravel()
        return cls(row["unit"], *(np.frombuffer(row[c], np.int64) for c in ("doc", "h", "start", "stop")), row["bytes"], names)

    def row(self, names: np.ndarray | None) -> tuple:
        """The regions as a row of MARKS, with names."""
        return (self.unit, *(c.tobytes() for c in (self.doc, self.h, self.start, self.stop)), self.text, None if names is None else squeezed(names))

    def sampled(self, covers: int) -> np.ndarray:
        """Sampled positions with so many bytes to the end of their region."""
        return np.flatnonzero((self.offset % 3 != 0) & (self.left >= covers))

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.sampled(FIRST)
        symbol = packed(self.text, SYMBOL)
        return at, np.stack([symbol[at], symbol[at + SYMBOL], symbol[at + 2 * SYMBOL]], 1) if len(at) else np.zeros((0, 3), _U)

    def second(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Triples of names where documents share all three; ``names`` has one for each first position, -1 elsewhere."""
        many = max(0, len(names) - 2 * STEP)
        one, two, three = (names[k * STEP : k * STEP + many] for k in range(3))
        at = np.flatnonzero((self.left[:many] >= SECOND) & (one >= 0) & (two >= 0) & (three >= 0))
        return at, np.stack([one[at], two[at], three[at]], 1).astype(_U) if len(at) else np.zeros((0, 3), _U)

    def strings(self) -> np.ndarray:
        """Positions where a string begins."""
        return np.flatnonzero(self.left >= WINDOW)

    def prefixes(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (name, shift and the bytes beside the name, as one number) of the strings with a shared name at the shift, and their positions.

        ``names`` has one for each second position, -1 elsewhere.
        """
        at, keys = [], []
        many = max(0, len(names) - WINDOW + 1)
        whole = self.left[:many] >= WINDOW
        for shift in range(3):
            some = np.flatnonzero(whole & (names[shift : shift + many] >= 0))
            one, two = (self.flat[k : k + many][some].astype(_U) for k in (*range(shift), *range(shift + SECOND, WINDOW)))
            keys.append(names[shift : shift + many][some].astype(_U) << _U(18) | _U(shift << 16) | one << _U(8) | two)
            at.append(some)
        return np.concatenate(at), np.concatenate(keys).reshape(-1, 1)

    def spread(self, at: np.ndarray, names: np.ndarray) -> np.ndarray:
        out = np.full(len(self.flat), -1)
        out[at] = names
        return out

    def least_runs(self, h: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where runs of strings with one least hash begin and end, and that hash; ``h`` are the gram hashes."""
        at = self.strings()
        m = least_hashes(h, gram)[at]
        new = np.append(True, (m[1:] != m[:-1]) | (self.of[at[1:]] != self.of[at[:-1]])) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return at[first], at[first] + np.diff(np.append(first, len(at))), m[first]

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of a mask, none beyond its region, and the region of each."""
        edge = self.of[1:] != self.of[:-1]
        begins, ends = mask.copy(), mask.copy()
        begins[1:] &= ~mask[:-1] | edge
        ends[:-1] &= ~mask[1:] | edge
        a = np.flatnonzero(begins)
        return a, np.flatnonzero(ends) + 1, self.of[a]

    def cut(self, mask: np.ndarray) -> tuple:
        """The strings that begin in a mask as regions: document, h, first and last position, bytes."""
        a, b, of = self.runs(mask)
        moved = (self.start - self.base)[of]
        return self.doc[of], self.h[of], a + moved, b + moved, b"".join([self.text[x : y + WINDOW - 1] for x, y in zip(a.tolist(), b.tolist(), strict=True)])

    def rows(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of a round: triples of symbols, triples of names, or prefixes of the strings."""
        if depth == 0:
            return self.first()
        if depth == 1:
            return self.second(self.spread(self.sampled(FIRST), self.names))
        return self.prefixes(self.spread(self.sampled(SECOND), self.names))

    def keys(self, depth: int) -> tuple[np.ndarray, Asked]:
        at, rows = self.rows(depth)
        return at, Asked(rows, self.doc[self.of[at]])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[Regions]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Regions.read(batch.slice(k, 1).to_pylist()[0])


def _sample(depth: int, rate: int):
    """Every ``rate``-th key of some units, as a byte string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for regions in _units(batches):
            for piece in regions.pieces(depth):
                keys = piece.rows(depth)[1][regions.unit % rate :: rate]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in keys.astype(">u8")], pa.binary())], ["key"])

    return run


def _ask(depth: int, splitters: Splitters):
    """The keys of each unit's regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for regions in _units(batches):
            pieces = (piece.keys(depth)[1] for piece in regions.pieces(depth))
            yield from _asked_table(messages(regions.unit, pieces, splitters, depth == 2)).to_batches()

    return run


def _use(depth: int, splitters: Splitters):
    """What replies make of a unit's regions: they get names, or turn into covered spans."""

    def run(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _NO_MARKS
        regions = Regions.read(table.to_pylist()[0])
        replies, names, spans = Replies(reply, splitters, depth == 2), [], []
        for piece in regions.pieces(depth):
            at, own = piece.keys(depth)
            got = replies.of(own)[own.at]
            if depth < 2:
                names.append(piece.spread(at, got)[piece.sampled((FIRST, SECOND)[depth])])
                continue
            hit = np.zeros(len(piece.flat), bool)
            hit[at[(got > 0) | (own.docs[own.at] < piece.doc[piece.of[at]])]] = True
            hit = np.flatnonzero(hit)
            a, b, of = piece.runs(_within(hit, hit + WINDOW, len(piece.flat)))
            moved = (piece.start - piece.base)[of]
            spans.append((piece.doc[of], piece.h[of], a + moved, b + moved))
        if depth < 2:
            return _table([regions.row(np.concatenate(names))], MARK_NAMES, MARK_TYPES)
        columns = [np.concatenate(c) for c in zip(*spans, strict=True)]
        return _table([(regions.unit, *(c.tobytes() for c in columns), b"", None)] if len(columns[0]) else [], MARK_NAMES, MARK_TYPES)

    return run


def _finish(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Counts and digests of the documents of a block without their covered bytes; a mark without spans covers a whole later copy."""
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for row in zip(*(marks.column(c).to_pylist() for c in ("doc", "h", "start", "stop")), strict=True):
        for d, h, a, b in zip(*(np.frombuffer(c, np.int64).tolist() for c in row), strict=True):
            spans.setdefault((d, h), []).append((a, b))
    out = []
    for d, h, t in zip(docs.column("doc_id").to_pylist(), docs.column("h").to_pylist(), docs.column("text").cast(pa.binary()), strict=True):
        t = t.as_py() or b""
        runs: list[list[int]] = []
        for a, b in sorted(spans.get((d, h), ())):
            b = min(b, len(t))
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        kept, at = hashlib.sha256(), 0
        for a, b in [*runs, (len(t), len(t))]:
            kept.update(t[at:a])
            at = b
        out.append((d, len(t), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "stop": b} for a, b in runs]))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return _table(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"], [pa.int64()] * 4 + [pa.string(), span])


def larger(n: float, most: int) -> float:
    """Times that blocks or parts, ``n`` at their least size, are larger than that."""
    return min(most, max(1.0, n / MANY))


def _splitters(regions: DataFrame, depth: int, units: int, unit_bytes: float, parts: int, most: int) -> Splitters:
    """Ranges of about equal numbers of keys, from a sample of bounded size."""
    ranges = min(parts, most)
    if ranges == 1:
        return Splitters(np.zeros(0, f"S{8 if depth == 2 else 24}"), math.ceil(parts / ranges))
    some = regions.where(F.pmod(F.xxhash64("unit"), F.lit(max(1, units // SAMPLE_UNITS))) == 0)
    rate = max(1, int(2 * SAMPLE_UNITS * unit_bytes * (2 if depth == 2 else 1)) // min(SAMPLE_KEYS, 64 * ranges))
    keys = np.unique(np.array([r.key for r in some.mapInArrow(_sample(depth, rate), "key binary").limit(2 * SAMPLE_KEYS).collect()], f"S{8 if depth == 2 else 24}"))
    begins = np.unique(keys[np.linspace(0, len(keys), ranges, endpoint=False)[1:].astype(np.int64)]) if len(keys) else keys
    return Splitters(begins, math.ceil(parts / ranges))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS, ranges: int = RANGES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans.

    A byte is removed if a string of 50 bytes over it also begins in a document with a smaller id;
    strings lie within one document and are judged on the input. Texts under 50 bytes, null ones
    (empty) and rows with a null id lose nothing and take nothing from others; rows with the same id do
    not take from each other. An empty table gives no rows. Other columns are not read.

    Documents are dealt by hash to blocks of bounded bytes, shared regions to units and keys to parts of bounded
    size, so no task sees more of a hot string than one entry from each unit. Long texts are read in pieces.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    size = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    times = larger(size / block_bytes, LARGER_BLOCKS)
    blocks, unit_bytes = max(1, math.ceil(size / (block_bytes * times))), UNIT_BYTES * times
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)))
    parts = lambda keys: max(1, math.ceil(keys / (part_keys * larger(keys / part_keys, LARGER_PARTS))))

    marked = own.where("doc_id is not null and octet_length(text) >= 50").select("doc_id", "h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    marked = durable(marked.withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks))))
    firsts = durable(marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select("digest", "first"))
    copies = durable(marked.join(firsts, "digest").where("doc_id > first").select("block", "doc_id", "h", "size"))
    discard(marked, firsts)

    filter_parts = parts(size / 8)
    few = min(filter_parts, ranges)
    splitters = Splitters(as_text(np.array([(k << 64) // few for k in range(1, few)], _U).reshape(-1, 1)), math.ceil(filter_parts / few))
    asked = dealt.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(_ask_filter(splitters), ASKED)
    reply = durable(asked.groupBy("part").applyInArrow(_merge_part(1, False, splitters.bits), REPLY))
    told = reply.select(F.col("unit").alias("block"), "part", "reply", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("h")).unionByName(copies.select("block", "doc_id", "h"), allowMissingColumns=True)
    regions = durable(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_mark(splitters, unit_bytes), MARKS))
    discard(reply)

    for depth in range(3):
        units, size = regions.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()
        splitters = _splitters(regions, depth, units, unit_bytes, parts(size * (2 if depth == 2 else 2 / 3)), ranges)
        asked = regions.mapInArrow(_ask(depth, splitters), ASKED)
        reply = durable(asked.groupBy("part").applyInArrow(_merge_part(1 if depth == 2 else 3, depth == 2, splitters.bits), REPLY))
        used = durable(regions.groupBy("unit").cogroup(reply.groupBy("unit")).applyInArrow(_use(depth, splitters), MARKS))
        discard(reply, regions)
        regions = used
    packed_long = lambda c: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8))))
    whole = copies.select("block", packed_long(F.col("doc_id")).alias("doc"), packed_long(F.col("h")).alias("h"), packed_long(F.lit(0).cast("long")).alias("start"), packed_long(F.col("size")).alias("stop"))
    covered = regions.select(F.shiftright("unit", 24).alias("block"), "doc", "h", "start", "stop").unionByName(whole)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    return dealt.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(_finish, schema)
