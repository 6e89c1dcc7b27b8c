"""Quality rules: word and line counts, and bands of zstandard compression ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenary.llm.arrow import add_columns, byte_texts

#: Fewest words, and most repeated words in a hundred.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: zstandard level, and bytes of a chunk; a last chunk under half of that joins the one before.
LEVEL, CHUNK_BYTES = 3, 4096
#: Whole texts: up to so many bytes, the least and the greatest ratio of raw to compressed bytes.
#: Short texts compress less, as the encoder has seen little; long ones of plain prose more.
WHOLE_BANDS = ((512, 1.02, 2.1), (2048, 1.15, 2.35), (8192, 1.3, 2.5), (65536, 1.45, 2.75), (1 << 62, 1.5, 3.5))
#: Chunks: least and greatest ratio, and the share of chunks outside that rejects a text.
CHUNK_BAND, CHUNK_SHARE = (1.2, 2.9), 0.5

_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    key = w[:n].copy()
    for k in range(1, size):  # dense numbers of the windows one word longer
        key = np.unique(key * len(ids) + w[k : n + k], return_inverse=True)[1]
    often = np.bincount(key)[key] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(often), 1)
    np.add.at(edge, np.flatnonzero(often) + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def chunks_of(text: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    """The whole text in chunks of ``size`` bytes, the last one of half to one and a half of that."""
    n = max(1, (len(text) + size // 2) // size)
    return [text[i * size : (i + 1) * size if i < n - 1 else len(text)] for i in range(n)]


class Ratios:
    """Compression ratios of a text; holds one encoder."""

    def __init__(self, level: int = LEVEL) -> None:
        self.encoder = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

    def of(self, text: bytes) -> float:
        return len(text) / len(self.encoder.compress(text)) if text else 0.0

    def outside(self, text: bytes) -> tuple[float, float]:
        """Ratio of the whole text; share of its chunks outside the chunk band."""
        whole = self.of(text)
        parts = chunks_of(text)
        if len(parts) == 1:
            return whole, 0.0
        low, high = CHUNK_BAND
        return whole, sum(not low <= self.of(x) <= high for x in parts) / len(parts)


def in_band(n_bytes: int, whole: float, share: float) -> bool:
    """The verdict of the compression bands for a text of that length."""
    low, high = next((low, high) for most, low, high in WHOLE_BANDS if n_bytes <= most)
    return low <= whole <= high and share <= CHUNK_SHARE


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts, base_failed, zstd_ratio, chunk_share and kept.

    Words are runs without ASCII white space. base_failed: under 50 words, or over half of them in
    repeated 3-word windows. kept: not base_failed, and the compression bands agree: the ratio of
    the whole text lies within limits for its length, and at most half of its 4 KiB chunks lie
    outside theirs. Null and empty texts have no words and fail. Rows are judged one by one, so
    ties and repeated rows agree. Columns of ``docs`` with these names are replaced.
    """
    ready: list[Ratios] = []

    def make(column: pa.Array) -> list:
        if not ready:
            ready.append(Ratios())
        out: list[list] = [[] for _ in range(9)]
        for t in byte_texts(column):
            w = t.split()
            repeat = repeated_words(w)
            failed = len(w) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(w)
            whole, share = ready[0].outside(t)
            inner = b"".join(w)
            marks = len(inner) - len(inner.translate(None, _SYMBOLS))
            points = len(inner.decode())
            row = (len(w), points, marks, duplicate_lines(t), repeat, failed, whole, share, not failed and in_band(len(t), whole, share))
            for o, v in zip(out, row, strict=True):
                o.append(v)
        return out

    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField(n, T.LongType()) for n in longs]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("zstd_ratio", T.DoubleType()), T.StructField("chunk_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return add_columns(docs, text, fields, make)
