import random
from collections import defaultdict

import corpus_pipeline
import numpy as np

from lumenary.llm import jaccard
from lumenary.llm.jaccard import prefix, shingles, similar_texts

SCHEMA = "doc_id long, text string, lang string"


def brute_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def brute(texts):
    """Indices of the texts, as components of all pairs with a Jaccard similarity of 0.8 or more."""
    sets, root = brute_sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    groups = defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(i)
    return sorted(groups.values())


def invented(seed=3):
    """Texts with copies in which more or fewer words differ, around the similarity of a link."""
    rng, out = random.Random(seed), []
    for _ in range(30):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 150))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 30)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(400)}"
            out.append(" ".join(copy))
    return out + ["a common line of seven words here " + " ".join(f"u{k}x{i}" for i in range(20)) for k in range(20)] + [None, "", "one", "ONE"]


def components(spark, texts):
    rows = similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.component].append(r.doc_id)
    assert len(rows) == len(texts)
    return sorted(sorted(g) for g in groups.values())


def test_components_against_brute_force(spark, monkeypatch):
    texts = invented()
    expected = brute(texts)
    assert any(len(g) > 1 for g in expected) and len(expected) > 40
    assert components(spark, texts) == expected
    monkeypatch.setattr(jaccard, "BUCKET", 300)
    assert components(spark, texts) == expected


def test_prefixes_of_similar_sets_meet_whatever_is_common():
    rng = np.random.default_rng(1)
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(5, 80), dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 1 << 62, 3, dtype=np.uint64)]))
        common = np.unique(rng.choice(base, 4))
        if 5 * len(np.intersect1d(base, other)) >= 4 * len(np.union1d(base, other)):
            count = np.arange(1, len(common) + 1)
            assert len(np.intersect1d(prefix(base, common, count), prefix(other, common, count)))
    assert len(shingles(b"")) == 0 and len(shingles(b"one Two")) == 1


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(6)
    for _ in range(200):
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(0, 600), dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.8], rng.integers(0, 1 << 62, rng.integers(0, 40), dtype=np.uint64)]))
        apart = jaccard.Sketches([jaccard.sketch(x) for x in (base, other, base)]).apart(np.array([0, 0]), np.array([1, 2]))
        assert apart[0] <= len(np.setxor1d(base, other)) and apart[1] == 0


def test_a_large_group_of_near_copies_around_the_limit(spark):
    """Copies of one text with many or few words changed: some are linked by chains only, some not at all."""
    rng = random.Random(8)
    story, texts = [f"w{k}" for k in range(150)], []
    for _ in range(120):
        copy = list(story)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(60)}"
        texts.append(" ".join(copy))
    expected = brute(texts)
    assert 2 < len(expected) < 100 and max(map(len, expected)) > 20
    assert components(spark, texts) == expected


def test_pipeline_stage_drops_near_copies_beyond_two_bits(spark, sf):
    words = [f"word{k}" for k in range(200)]
    texts = [" ".join(words), " ".join([*words[:50], "x", *words[51:120], "y", *words[121:]]), " ".join(f"other{k}" for k in range(200))]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()) == [0, 2]


def test_rows_with_shared_and_null_ids(spark, sf):
    story = [f"word{k}" for k in range(200)]
    near = " ".join([*story[:50], "x", *story[51:]])
    rows = [(1, " ".join(story)), (2, near), (2, "a text of its own under an id that a copy has too"), (None, " ".join(story)), (None, near)]
    alone = [f"other{k}" for k in range(200)]
    rows += [(None, " ".join(alone)), (None, " ".join(alone)), (None, " ".join([*alone[:90], "y", *alone[91:]]))]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    assert sorted(k for k in kept if k[0] is not None) == [rows[0], rows[2]]
    assert len([t for d, t in kept if d is None]) == 1 and next(t for d, t in kept if d is None).startswith("other0 ")
