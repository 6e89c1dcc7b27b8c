import math
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import TEXTS, awkward, empty, table

from lumenary.llm import queries
from lumenary.llm.ppm import lm_scores


def lowered(t):
    return (t or "").encode().lower()


def is_train(d, folds=10):
    return d is not None and zlib.crc32(str(d).encode()) % folds != 0


class Trie:
    """The same model, symbol by symbol."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            data = b"\xfe" * order + t + b"\xff"
            for i in range(order, len(data)):
                for m in range(order + 1):
                    self.seen[data[i - m : i]][data[i]] += 1

    def score(self, t):
        data, total = b"\xfe" * self.order + t + b"\xff", 0.0
        for i in range(self.order, len(data)):
            excluded = set()
            for m in range(self.order, -1, -1):
                here = self.seen.get(data[i - m : i])
                if not here:
                    continue
                left = {s: c for s, c in here.items() if s not in excluded}
                n, d = sum(left.values()), len(left)
                if data[i] in left:
                    total += math.log10(left[data[i]] / (n + d))
                    break
                if d:
                    total += math.log10(d / (n + d))
                excluded |= here.keys()
            else:
                total -= math.log10(256 - len(excluded))
        return total


def brute(rows, order=4):
    train = [lowered(t) for d, t in rows if is_train(d)]
    words = Counter(w for t in train for w in [*t.split(), None])
    n, v, trie, out = sum(words.values()), len(words), Trie(train, order), []
    for d, t in rows:
        tokens = [*lowered(t).split(), None]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((d, not is_train(d), len(tokens), sum(words[w] > 0 for w in tokens), n, base, trie.score(lowered(t))))
    return out


def check(df, rows):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 5))
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=key)
    expected = sorted(brute(rows), key=key)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for f, e in zip(found, expected, strict=True):
        assert f[5:] == pytest.approx(e[5:], rel=1e-9, abs=1e-9)


def test_awkward_rows(spark):
    rows = [(d, t if t is None or len(t) < 1000 else t[:3000]) for d, t in TEXTS]
    from pyspark.sql import functions as F

    check(lm_scores(awkward(spark).withColumn("text", F.substring("text", 1, 3000))), rows)


def test_many_blocks_agree_with_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    values = [sorted((r.doc_id, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(docs, block_bytes=b).collect()) for b in (1 << 30, 20_000)]
    assert values[0] == values[1]


def test_no_training_rows_and_empty_table(spark):
    held = next(d for d in range(100) if not is_train(d))
    docs = spark.createDataFrame([(held, "ab")], "doc_id long, text string")
    r = lm_scores(docs).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 2, 0, 0, 0.0)
    assert r.score == pytest.approx(-3 * math.log10(256))
    assert lm_scores(empty(spark)).count() == 0


def test_query_against_brute_force(spark, sf):
    check(queries.op5_ppm(spark, sf), [(r["doc_id"], r["text"]) for r in table(sf, "documents")])
