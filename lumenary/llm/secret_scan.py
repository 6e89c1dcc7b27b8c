"""Secret scans: a worklist of decoded layers, each scanned, with spans mapped to the original text."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenary.llm.arrow import add_columns, byte_texts

KINDS = ("assign", "access", "hex")
_NAME = rb"(?i:password|passwd|secret|token|api_?key)"
_VALUE = rb"[A-Za-z0-9+/_.=-]"
#: What a span may be: pattern, and the least bytes of its last group.
_PATTERNS = {
    "assign": (re.compile(_NAME + rb"""["']?\x20*[:=]\x20*["']?(""" + _VALUE + rb"+)"), 6),
    "access": (re.compile(rb"AKIA([A-Z0-9]+)"), 16),
    "hex": (re.compile(rb"([0-9a-f]{24,})"), 24),
}
#: The letters of that group, and what the end of a piece may hold of a span whose group has not begun.
_LETTERS = {k: bytes(c for c in range(256) if re.fullmatch(p, bytes([c]))) for k, p in (("assign", _VALUE), ("access", rb"[A-Z0-9]"), ("hex", rb"[0-9a-f]"))}
_BEGUN = re.compile(_NAME + rb"""["']?\x20*(?:[:=]\x20*["']?)?\Z""")
_TAIL = {"assign": 7, "access": 4, "hex": 0}
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Base64 letters, of both alphabets, to one letter: a long run is then found by plain search.
_RUNS = bytes(97 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else 32 for c in range(256))
_RUN = b"a" * 16  # the least that _BASE64 takes
_RUN_LETTERS = bytes(c for c in range(256) if _RUNS[c] == 97)
_URL = re.compile(rb"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(
    rb"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|[0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})"
)
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Bytes that are decoded, opened and scanned at a time.
PIECE = 1 << 17
_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, zstandard.ZstdError)

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Piece:
    """Some bytes of a layer; for each, the original bytes [start, end) that it comes from, and if it was decoded. Neither falls from one byte to the next."""

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray, changed: np.ndarray) -> None:
        self.data, self.start, self.end, self.changed = data, start, end, changed

    @classmethod
    def of_text(cls, data: bytes, at: int = 0) -> Piece:
        places = np.arange(at, at + len(data), dtype=np.int64)
        return cls(data, places, places + 1, np.zeros(len(data), bool))

    @classmethod
    def decoded(cls, data: bytes, start: np.ndarray | int, end: np.ndarray | int) -> Piece:
        n = len(data)
        return cls(data, np.broadcast_to(np.int64(start), n), np.broadcast_to(np.int64(end), n), np.ones(n, bool))

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, part: slice) -> Piece:
        return Piece(self.data[part], self.start[part], self.end[part], self.changed[part])

    @staticmethod
    def joined(parts: list[Piece]) -> Piece:
        if len(parts) == 1:
            return parts[0]
        return Piece(b"".join(p.data for p in parts), *(np.concatenate([getattr(p, n) for p in parts]) for n in ("start", "end", "changed")))

    def __add__(self, other: Piece) -> Piece:
        return Piece.joined([self, other]) if len(self) and len(other) else self if len(self) else other

    def replaced(self, edits: list[tuple[int, int, bytes]]) -> Piece:
        """With bytes in place of each [a, b)."""
        if not edits:
            return self
        parts, at = [], 0
        for a, b, new in edits:
            parts += [self.data[at:a], new]
            at = b
        first, last, n = (np.array(x) for x in zip(*((a, b - 1, len(new)) for a, b, new in edits), strict=True))
        step = np.zeros(len(self) + 1, np.int8)
        step[first] += 1
        step[last + 1] -= 1
        within = np.cumsum(step[:-1], dtype=np.int8) > 0
        from_first, from_last = np.where(within, 0, 1), np.where(within, 0, 1)
        from_first[first], from_last[last] = n, n
        return Piece(
            b"".join([*parts, self.data[at:]]), np.repeat(self.start, from_first), np.repeat(self.end, from_last), np.repeat(self.changed | within, from_first)
        )


class Layer:
    """The pieces of a layer, packed: places and repeated content take next to nothing, however large the layer is."""

    def __init__(self) -> None:
        self.packed: list[tuple[int, bytes, int | bytes, int | bytes, bytes]] = []
        self.digest, self.tail = hashlib.sha256(), b""
        self.has_url = self.has_escape = self.has_run = False
        self._encoder = zstandard.ZstdCompressor(level=1)

    def append(self, piece: Piece) -> None:
        self.digest.update(piece.data)
        near = self.tail + piece.data
        self.has_url |= b"%" in piece.data
        self.has_escape |= b"\\" in piece.data
        self.has_run = self.has_run or _RUN in near.translate(_RUNS)
        self.tail = near[-15:]
        self.packed.append((len(piece), self._pack(piece.data), self._places(piece.start), self._places(piece.end), self._pack(piece.changed.tobytes())))

    def _pack(self, data: bytes) -> bytes:
        return bytes(memoryview(self._encoder.compress(data)))  # a copy: the first one holds on to room for the unpacked bytes

    def _places(self, places: np.ndarray) -> int | bytes:
        """One number where all are equal, as in what was compressed; else the packed steps."""
        return int(places[0]) if places[0] == places[-1] else self._pack(np.diff(places, prepend=np.int64(0)).tobytes())

    def __iter__(self) -> Iterator[Piece]:
        decoder = zstandard.ZstdDecompressor()
        for n, data, *places, changed in self.packed:
            start, end = (np.broadcast_to(np.int64(x), n) if isinstance(x, int) else np.cumsum(np.frombuffer(decoder.decompress(x), np.int64)) for x in places)
            yield Piece(decoder.decompress(data), start, end, np.frombuffer(decoder.decompress(changed), bool))


class Finder:
    """Spans with decoded bytes in a stream of pieces. What a pattern takes beyond a piece is carried on as a count, or as the little that has begun."""

    def __init__(self) -> None:
        self.found: set[tuple[str, int, int]] = set()
        self._rest = {k: Piece.of_text(b"") for k in KINDS}
        self._open: dict[str, list] = {}

    def feed(self, piece: Piece) -> None:
        for kind in KINDS:
            self._feed(kind, piece)

    def _feed(self, kind: str, piece: Piece) -> None:
        if (grown := self._open.get(kind)) is not None:
            n = len(piece) - len(piece.data.lstrip(_LETTERS[kind]))
            if n:
                grown[1], grown[2], grown[3] = int(piece.end[n - 1]), grown[2] + n, grown[3] or piece.changed[:n].any()
            if n == len(piece):
                return
            self._close(kind)
            piece = piece[n:]
        piece = self._rest[kind] + piece
        data, at = piece.data, 0
        pattern, least = _PATTERNS[kind]
        for m in pattern.finditer(data) if self._may_hold(kind, data) else ():
            at = m.end()
            if at == len(data):
                self._open[kind] = [int(piece.start[m.start()]), int(piece.end[at - 1]), len(m[1]), piece.changed[m.start() : at].any()]
            elif len(m[1]) >= least and piece.changed[m.start() : at].any():
                self.found.add((kind, int(piece.start[m.start()]), int(piece.end[at - 1])))
        if kind == "hex" and at < len(data) and (n := len(data) - len(data[at:].rstrip(_LETTERS[kind])) - at):
            self._open[kind], at = [int(piece.start[-n]), int(piece.end[-1]), n, piece.changed[-n:].any()], len(data)
        begun = _BEGUN.search(data, at) if kind == "assign" and self._may_hold(kind, data) else None
        self._rest[kind] = _one_space(piece[begun.start() :]) if begun else piece[max(at, len(data) - _TAIL[kind]) :]

    @staticmethod
    def _may_hold(kind: str, data: bytes) -> bool:
        return kind == "hex" or (b"AKIA" in data if kind == "access" else any(n in low for low in (data.lower(),) for n in _NAMES))

    def _close(self, kind: str) -> None:
        start, end, n, changed = self._open.pop(kind)
        if n >= _PATTERNS[kind][1] and changed:
            self.found.add((kind, start, end))

    def finish(self) -> set[tuple[str, int, int]]:
        for kind in list(self._open):
            self._close(kind)
        return self.found


def _one_space(piece: Piece) -> Piece:
    """A begun assignment with one space for each run of them; the first byte stands for what is left out."""
    space = np.frombuffer(piece.data, np.uint8) == 32
    keep = ~(space & np.concatenate([[False], space[:-1]]))
    changed = piece.changed[keep]
    changed[0] = piece.changed.any()
    return Piece(np.frombuffer(piece.data, np.uint8)[keep].tobytes(), piece.start[keep], piece.end[keep], changed)


def base_spans(data: bytes) -> list[tuple[str, int, int]]:
    """Spans of the plain patterns, leftmost and non-overlapping for each kind."""
    return [(k, *m.span()) for k, (pattern, least) in _PATTERNS.items() if Finder._may_hold(k, data) for m in pattern.finditer(data) if len(m[1]) >= least]


def _url(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    return ((*m.span(), bytes([int(m[0][1:], 16)])) for m in _URL.finditer(data))


def _unicode(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    for m in _ESCAPE.finditer(data):
        if m[3]:
            units = bytes.fromhex(m[3].replace(b"\\u", b"").decode())
            yield *m.span(), units.decode("utf-16-be", "replace").encode()
        else:
            n = int(m[1] or m[2] or m[4], 16)
            if n <= 0x10FFFF and not 0xD800 <= n < 0xE000:
                yield *m.span(), chr(n).encode()


def _unescaped(pieces: Iterable[Piece], find: Callable[[bytes], Iterator[tuple[int, int, bytes]]], longest: int) -> Iterator[Piece]:
    """The pieces with escapes of at most so many bytes decoded; one that a piece may cut waits for the next."""
    rest = Piece.of_text(b"")
    for piece in pieces:
        rest = rest + piece
        sure = max(0, len(rest) - longest + 1)
        edits = [e for e in find(rest.data) if e[0] < sure]
        cut = max(sure, edits[-1][1]) if edits else sure
        yield rest[:cut].replaced(edits)
        rest = rest[cut:]
    yield rest.replaced(list(find(rest.data)))


class _Source:
    """Chunks of bytes as a file, with a look at its first bytes."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self._chunks, self._held = chunks, b""

    def head(self) -> bytes:
        while len(self._held) < 6 and (more := next(self._chunks, None)) is not None:
            self._held += more
        return self._held[:6]

    def read(self, n: int = PIECE) -> bytes:
        while not self._held and (more := next(self._chunks, None)) is not None:
            self._held = more
        out, self._held = self._held[:n], self._held[n:]
        return out


def _opened(source: _Source) -> Iterator[bytes] | None:
    """What compressed bytes hold, chunk by chunk, if they begin like such."""
    head = source.head()
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return _inflated(source)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return _zstd_content(source)
    if head[:3] == b"BZh":
        return _unpacked(source, bz2.BZ2Decompressor())
    return _unpacked(source, lzma.LZMADecompressor()) if head == b"\xfd7zXZ\x00" else None


def _zstd_content(source: _Source) -> Iterator[bytes]:
    """A few bytes at a time: each block of four or more opens to 128 KiB at most."""
    d = zstandard.ZstdDecompressor().decompressobj()
    while not d.eof and (data := source.read(64)):
        yield d.decompress(data)


def _inflated(source: _Source) -> Iterator[bytes]:
    z = zlib.decompressobj(47)
    while not z.eof and (data := z.unconsumed_tail or source.read()):
        yield z.decompress(data, PIECE)
    while not z.eof and (more := z.decompress(z.unconsumed_tail, PIECE)):
        yield more


def _unpacked(source: _Source, d: bz2.BZ2Decompressor | lzma.LZMADecompressor) -> Iterator[bytes]:
    while not d.eof:
        data = source.read() if d.needs_input else b""
        if d.needs_input and not data:
            return
        yield d.decompress(data, PIECE)


def _letters_decoded(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Bytes of a base64 run; ValueError for a number of letters that none has."""
    rest = b""
    for chunk in chunks:
        rest += chunk.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
        n = len(rest) // 4 * 4
        yield base64.b64decode(rest[:n])
        rest = rest[n:]
    if len(rest) == 1:
        raise ValueError("a single letter is left")
    yield base64.b64decode(rest + b"=" * (-len(rest) % 4))


def _content(chunks: Iterable[bytes], depth: int) -> Iterator[bytes] | None:
    """A base64 run decoded and so many times decompressed; None if it does not begin like that."""
    out = _letters_decoded(chunks)
    for _ in range(depth):
        out = _opened(_Source(out))
        if out is None:
            return None
    return out


class _Verdict:
    """How many compressed layers of a base64 run are opened, looked for one by one; a layer that was there before ends it, as a broken one does."""

    def __init__(self) -> None:
        self.depth, self.readable, self.done = -1, False, False
        self._seen: set[bytes] = set()

    def look(self, chunks: Iterable[bytes]) -> None:
        """Read the run once more, one layer deeper."""
        digest, text = hashlib.sha256(), _Readable()
        try:
            content = _content(chunks, self.depth + 1)
            for chunk in content if content is not None else ():
                digest.update(chunk)
                text.feed(chunk)
        except _BROKEN:
            content = None
        if content is None or (key := digest.digest()) in self._seen:
            self.done = True
            return
        self._seen.add(key)
        self.depth, self.readable = self.depth + 1, text.finish()


class _Readable:
    """UTF-8 without control characters other than white space, and not empty."""

    _CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

    def __init__(self) -> None:
        self._rest, self._some, self._right = b"", False, True

    def feed(self, chunk: bytes) -> None:
        if not self._right or not chunk:
            return
        self._some = True
        data = self._rest + chunk
        try:
            data.decode()
            self._rest = b""
        except UnicodeDecodeError as error:
            self._rest = data[error.start :]
            self._right = len(self._rest) < 4 and error.reason == "unexpected end of data"
        self._right = self._right and self._CONTROL.search(chunk) is None

    def finish(self) -> bool:
        return self._some and self._right and not self._rest


def _runs(pieces: Iterable[Piece]) -> Iterator[tuple[str, Piece]]:
    """The pieces as "text", "run" (a whole base64 run), and "part", ..., "last" (a run that is longer than a piece)."""
    rest, within = Piece.of_text(b""), False
    last = object()
    for piece in _and_end(pieces, last):
        final = piece is last
        rest = rest if final else rest + piece
        if within:
            n = len(rest) - len(rest.data.lstrip(_RUN_LETTERS))
            pad = 2 if rest.data[n : n + 2] == b"==" else 1 if rest.data[n : n + 1] == b"=" else 0
            if not final and n + pad == len(rest) and pad < 2:
                yield "part", rest[:n]
                rest = rest[n:]
                continue
            yield "last", rest[: n + pad]
            rest, within = rest[n + pad :], False
        at = 0
        for m in _BASE64.finditer(rest.data):
            if m.end() == len(rest) and not final:
                break
            yield "text", rest[at : m.start()]
            yield "run", rest[m.start() : m.end()]
            at = m.end()
        else:
            m = None
        if m is not None:
            yield "text", rest[at : m.start()]
            rest = rest[m.start() :]
            if len(rest) > PIECE:
                n = len(rest.data.rstrip(b"="))
                yield "part", rest[:n]
                rest, within = rest[n:], True
        elif final:
            yield "text", rest[at:]
        else:
            near = max(at, len(rest) - 15)
            cut = near + len(rest.data[near:].rstrip(_RUN_LETTERS))
            yield "text", rest[at:cut]
            rest = rest[cut:]


def _and_end(pieces: Iterable[Piece], last: object) -> Iterator:
    yield from pieces
    yield last


def _rest_of_run(items: Iterator[tuple[str, Piece]], first: Piece) -> Iterator[Piece]:
    yield first
    for tag, piece in items:
        yield piece
        if tag == "last":
            return


def _long_runs(layer: Layer) -> list[tuple[_Verdict, int, int]]:
    """For each run of several pieces its verdict and the original bytes that it comes from; the layer is read once for each depth."""
    found: list[tuple[_Verdict, int, int]] = []
    first = True
    while first or not all(v.done for v, _, _ in found):
        items, at = _runs(layer), 0
        for tag, piece in items:
            if tag != "part":
                continue
            parts, ends = _rest_of_run(items, piece), [0]
            if first:
                found.append((_Verdict(), int(piece.start[0]), 0))
            verdict, start, _ = found[at]
            if not verdict.done:
                verdict.look(_noting(parts, ends))
            for p in parts:
                ends[0] = int(p.end[-1]) if len(p) else ends[0]
            found[at] = verdict, start, max(found[at][2], ends[0])
            at += 1
        first = False
    return found


def _noting(parts: Iterable[Piece], ends: list[int]) -> Iterator[bytes]:
    for p in parts:
        ends[0] = int(p.end[-1]) if len(p) else ends[0]
        yield p.data


def _by_three(parts: Iterable[Piece]) -> Iterator[Piece]:
    """Decoded letters: three bytes come from four letters."""
    rest = Piece.of_text(b"")
    for part in _and_end(parts, None):
        rest = rest if part is None else rest + part
        n = len(rest) if part is None or part.data.endswith(b"=") else len(rest) // 4 * 4
        block, rest = rest[:n], rest[n:]
        if not n:
            continue
        raw = b"".join(_letters_decoded([block.data]))
        k = np.arange(len(raw)) // 3 * 4
        yield Piece.decoded(raw, block.start[np.minimum(k, n - 1)], block.end[np.minimum(k + 3, n - 1)])


def _base64(layer: Layer) -> Iterator[Piece]:
    """The layer with base64 runs decoded, and what is compressed in them opened, where that gives text."""
    long_runs, items = iter(_long_runs(layer)), _runs(layer)
    for tag, piece in items:
        if tag == "text":
            yield piece
            continue
        if tag == "run":
            parts, verdict = iter([piece]), _Verdict()
            while not verdict.done:
                verdict.look([piece.data])
            start, end = int(piece.start[0]), int(piece.end[-1])
        else:
            parts = _rest_of_run(items, piece)
            verdict, start, end = next(long_runs)
        if not verdict.readable:
            yield from parts
        elif verdict.depth == 0:
            yield from _by_three(parts)
        else:
            for chunk in _content((p.data for p in parts), verdict.depth):
                yield Piece.decoded(chunk, start, end)
            for _ in parts:  # letters after the compressed content
                pass


def _of_size(pieces: Iterable[Piece]) -> Iterator[Piece]:
    """The same bytes in pieces of about PIECE bytes."""
    held, n = [], 0
    for piece in pieces:
        for at in range(0, len(piece), PIECE):
            part = piece[at : at + PIECE]
            held.append(part)
            n += len(part)
            if n >= PIECE:
                yield Piece.joined(held)
                held, n = [], 0
    if held:
        yield Piece.joined(held)


def nested_spans(data: bytes) -> set[tuple[str, int, int]]:
    """Spans that only decoded layers show, as byte spans of ``data``.

    Every layer offers its URL, Unicode and base64 decodings as further layers, compressed content
    opened on the way. The worklist ends at the fixpoint; a layer met before is not taken again.
    Layers of any size are decoded, opened and scanned piece by piece and kept packed, so that
    memory follows the text and not what it opens to; no pattern, run or escape ends with a piece.
    """
    found: set[tuple[str, int, int]] = set()
    root = Layer()
    for at in range(0, len(data), PIECE):
        root.append(Piece.of_text(data[at : at + PIECE], at))
    met, work = {root.digest.digest()}, [root]
    while work:
        layer = work.pop()
        decodings = []
        if layer.has_url:
            decodings.append(_unescaped(layer, _url, 3))
        if layer.has_escape:
            decodings.append(_unescaped(layer, _unicode, 12))
        if layer.has_run:
            decodings.append(_base64(layer))
        for pieces in decodings:
            inner, finder = Layer(), Finder()
            for piece in _of_size(pieces):
                inner.append(piece)
                finder.feed(piece)
            if (key := inner.digest.digest()) not in met:
                met.add(key)
                work.append(inner)
                found |= finder.finish()
    return found


def scan(data: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, in bytes, by start, then kind, then end."""
    coded = b"%" in data and _URL.search(data) or b"\\" in data and _ESCAPE.search(data)
    runs = _RUN in data.translate(_RUNS)
    if not (coded or runs or any(n in data.lower() for n in _NAMES)):
        return [], []
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(data), key=order)
    more = nested_spans(data) if coded or _BASE64.search(data) else set()
    return base, sorted({*base, *more}, key=order)


def redact(data: bytes, spans: list[tuple[str, int, int]], mark: bytes) -> bytes:
    """Each run of touching or overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in spans:
        if a > at or not out:
            out += [data[at:a], mark]
        at = max(at, b)
    return b"".join([*out, data[at:]])


def secret_scan(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with base_spans, spans and redacted.

    base_spans holds what the plain patterns find in the text itself; spans adds what nested URL,
    Unicode, base64 and compressed layers hide. Both are arrays of (kind, start, end) in code
    points of the original, by start, kind and end. redacted is the text with every run of spans
    replaced by ``mark``, and the text itself if it has none. A null text is an empty one, with no
    spans and a null redacted. Rows are scanned one by one; columns with these names are replaced.
    """

    def make(column: pa.Array) -> list:
        out: list[list] = [[], [], []]
        for value, t in zip(column, byte_texts(column), strict=True):
            base, spans = scan(t)
            if not spans:
                out[0].append([])
                out[1].append([])
                out[2].append(value.as_py())
                continue
            points = np.concatenate([[0], np.cumsum(np.frombuffer(t, np.uint8) & 0xC0 != 0x80)])
            for o, found in zip(out, (base, spans), strict=False):
                o.append([{"kind": k, "start": int(points[a]), "end": int(points[b])} for k, a, b in found])
            out[2].append(redact(t, spans, mark.encode()).decode("utf-8", "replace"))
        return out

    return add_columns(docs, text, [T.StructField("base_spans", SPANS), T.StructField("spans", SPANS), T.StructField("redacted", T.StringType())], make)
