import re
from collections import Counter

import zstandard
from fixtures import TEXTS, awkward, empty, table

from lumenary.llm import queries
from lumenary.llm.quality import CHUNK_BYTES, LEVEL, chunks_of, quality_rules


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(wins)
    n = len({k for i, x in enumerate(wins) if often[x] > 1 for k in (i, i + 1, i + 2)})
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def brute_kept(text):
    """The verdict of the bands from frames written one by one, limits as documented."""
    data = (text or "").encode()

    def ratio(part):
        return len(part) / len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(part))

    if brute(text)[5]:
        return False
    limits = {512: (1.02, 2.1), 2048: (1.15, 2.35), 8192: (1.3, 2.5), 65536: (1.45, 2.75)}
    low, high = next((v for most, v in limits.items() if len(data) <= most), (1.5, 3.5))
    cuts = list(range(0, len(data), 4096))
    if len(cuts) > 1 and len(data) - cuts[-1] < 2048:
        cuts.pop()
    parts = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    outside = sum(not 1.2 <= ratio(x) <= 2.9 for x in parts) if len(parts) > 1 else 0
    return low <= ratio(data) <= high and 2 * outside <= len(parts)


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_awkward_rows(spark):
    for r in quality_rules(awkward(spark)).collect():
        assert counts(r) == brute(r.text) and r.kept == brute_kept(r.text)
    assert quality_rules(awkward(spark)).count() == len(TEXTS)


def test_empty_table(spark):
    assert quality_rules(empty(spark)).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, CHUNK_BYTES, CHUNK_BYTES * 3 // 2 - 1, CHUNK_BYTES * 3 // 2, CHUNK_BYTES * 7 + 5):
        parts = chunks_of(bytes(range(256)) * (n // 256) + b"x" * (n % 256))
        assert sum(map(len, parts)) == n and all(CHUNK_BYTES // 2 <= len(p) <= CHUNK_BYTES * 3 // 2 for p in parts[1:])


def test_query_against_brute_force_and_labels(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(sf, "documents")}
    good = {r["doc_id"] for r in table(sf, "labels") if r["quality"] == 1}
    rows = queries.op10_quality(spark, sf).collect()
    assert all(counts(r) == brute(texts[r.doc_id]) and r.kept == brute_kept(texts[r.doc_id]) for r in rows)
    assert 0 < sum(r.kept for r in rows) <= sum(not r.base_failed for r in rows)
    assert all(r.kept for r in rows if r.doc_id in good and not r.base_failed)


def test_bands_reject_repetition_and_noise(spark):
    import random

    random.seed(1)
    letters = "".join(chr(random.randrange(0x4E00, 0x9FFF)) + " " * (i % 7 == 0) for i in range(4000))
    loop = " ".join(f"row {i % 97} of table {i % 89} has value {i % 101} here" for i in range(3000))
    docs = spark.createDataFrame([(1, letters), (2, loop)], "doc_id long, text string")
    assert [r.kept for r in quality_rules(docs).orderBy("doc_id").collect()] == [False, False]
