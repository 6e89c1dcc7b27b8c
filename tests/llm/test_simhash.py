import re
from collections import defaultdict

import numpy as np
import xxhash
from fixtures import TEXTS, awkward, empty, table

from lumenary.llm import queries
from lumenary.llm.components import stars
from lumenary.llm.simhash import near_duplicates, trie_links, trie_self_join


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, budget=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_awkward_rows(spark):
    assert got(near_duplicates(awkward(spark))) == brute(TEXTS)


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(sf, "documents")]
    assert got(queries.op1_simhash(spark, sf)) == brute(rows)


def near_values(seed, n=600):
    """Values in dense groups, with many links and long chains."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 5), dtype=np.uint64), initial=np.uint64(0)) for _ in range(n)]
    return np.unique(rng.choice(centres, n) ^ np.array(flips, np.uint64))


def test_trie_finds_each_pair_once():
    values = near_values(1)
    expected = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 2}
    found = [(int(a), int(b)) for x, y in trie_links(values, None, 0, 0, 2) for a, b in zip(x, y, strict=True)]
    assert len(found) == len(set(found)) and set(found) == expected


def test_subtrees_at_every_depth_give_the_same_components(spark):
    values = near_values(2)
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    seen = {tuple(sorted((r.a, r.b) for r in stars(trie_self_join(rows, subtree=s)).collect())) for s in (8192, 64)}
    assert len(seen) == 1 and len(seen.pop()) > 100


def test_a_dense_subtree_goes_deeper(spark):
    """All values under one prefix of 8 bits: only the levels below it can split them."""
    values = np.unique(np.random.default_rng(4).integers(0, 1 << 16, 500, dtype=np.uint64) << np.uint64(40) | np.uint64(0xAB << 56))
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = {frozenset((r.a, r.b)) for r in trie_self_join(rows, budget=4, subtree=40).select("a", "b").collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
    assert all(near(*pair) for pair in found)
    root = {int(v): int(v) for v in values.view(np.int64)}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    def groups(pairs):
        for v in root:
            root[v] = v
        for a, b in pairs:
            root[find(a)] = find(b)
        return sorted(sorted(v for v in root if find(v) == r) for r in {find(v) for v in root})

    all_pairs = [(a, b) for a in root for b in root if a < b and near(a, b)]
    assert groups(map(tuple, found)) == groups(all_pairs) and len(all_pairs) > len(found) > 100


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(k + 1, k) for k in range(100)]
    hub = [(1000, 1000 + k) for k in range(1, 200)]
    found = {r.a: r.b for r in stars(spark.createDataFrame(path + hub, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 101)} | {1000 + k: 1000 for k in range(1, 200)}
