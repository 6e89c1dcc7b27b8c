import hashlib
import random
import zlib

import numpy as np
from fixtures import TEXTS, awkward, empty

from lumenary.llm.periodic_runs import find_runs, numbered, periodic_runs, plant_repeats, run_digests


def brute(w, min_words=6, min_periods=4):
    """Every distance q: maximal stretches in which words q apart agree; of the distances of one stretch the smallest counts."""
    best = {}
    for q in range(1, len(w) // min_periods + 1):
        x = 0
        while x + q < len(w):
            y = x
            while y + q < len(w) and w[y] == w[y + q]:
                y += 1
            if y > x and y - x + q >= max(min_words, min_periods * q):
                best.setdefault((x, y - x + q), q)
            x = y + 1
    return sorted(((a, n, q) for (a, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randrange(90), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 3 + 1))
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        limits = rng.choice([(6, 4), (2, 2), (1, 2), (5, 3)])
        assert find_runs(np.array(w, np.int64), *limits) == brute(w, *limits)


def test_long_texts():
    for period in (1, 7, 5000):
        assert find_runs(np.arange(200_000) % period) == [(0, 200_000, period)]
    a, b = "a", "ab"  # no run of four periods, many of two and three
    while len(b) < 100_000:
        a, b = b, b + a
    assert find_runs(numbered([c.encode() for c in b])) == []


def test_hashes_that_lie_are_found_out():
    from lumenary.llm.periodic_runs import Extensions

    class Liar(Extensions):
        @property
        def _numbers(self):
            return [0] * (self.n + 1), [1] * (self.n + 1)

    w = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    liar = Liar(w)
    assert (liar.after(0, 3), liar.before(2, 5), liar.after(0, 6), liar.before(3, 9)) == (2, 2, 3, 3)


def expected(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    if doc_id is not None and text is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        if h % 10 == 0:
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = brute(w) if len(w) < 5000 else find_runs(numbered(w))
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(runs), start, length, period, runs and 1000 * length // period or None, sha(listed.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def test_awkward_rows(spark):
    got = run_digests(periodic_runs(plant_repeats(awkward(spark)))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t) for i, t in TEXTS), key=repr)
    assert run_digests(periodic_runs(plant_repeats(empty(spark)))).count() == 0


def test_clashing_columns_and_ties(spark):
    rows = [(1, "x y " * 9, "r", "c"), (1, "x y " * 9, "r", "c"), (2, None, "r", "c")]
    got = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string")).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(1, [(0, 18, 2)], "x y")] * 2 + [(2, [], "")]


def test_damage_reaches_every_tenth_text(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 60), x -> x * (id + 1)), ' ') AS text")
    got = {r.doc_id: r for r in run_digests(periodic_runs(plant_repeats(docs))).collect()}
    assert all(tuple(got[r.doc_id]) == expected(r.doc_id, r.text) for r in docs.collect()) and sum(r.n_runs > 0 for r in got.values()) > 5
