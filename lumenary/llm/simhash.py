"""Near-duplicates by SimHash: fingerprints, and a self-join of their binary trie."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.llm.arrow import add_columns, byte_texts
from lumenary.llm.components import stars
from lumenary.llm.storage import discard, durable

#: Words of a shingle, seed of the hash, and most differing bits of a link.
SHINGLE_WORDS, SEED, BUDGET = 3, 42, 2
#: Values that one pair of subtrees of the trie should hold: sets the depth at which subtrees are dealt to tasks. Bits by
#: which a pair that holds several times as many goes deeper.
SUBTREE, DEEPER = 1 << 15, 4
#: Node pairs that a task expands at once, and shingles hashed at once.
BLOCK, CHUNK = 1 << 16, 1 << 15


def word_shingles(text: bytes, words: int) -> Iterator[bytes]:
    """Runs of so many words, A-Z lowered; a text of fewer words is one run, one without words none."""
    tokens = text.lower().split()
    if len(tokens) > words:
        return map(b" ".join, zip(*(islice(tokens, i, None) for i in range(words)), strict=False))
    return iter([b" ".join(tokens)] if tokens else [])


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of the text's word shingles, some thousands at a time."""
    shingles = word_shingles(text, words)
    while len(h := np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in islice(shingles, CHUNK)), np.uint64)):
        yield h


def majority_bits(hashes: Iterator[np.ndarray]) -> int:
    """64 bits, each set if over half of the hashes have it; zero if there are none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's word shingles.

    Letters A-Z are lowered; shingles count as often as they occur; a text of fewer words is one
    shingle; without words the fingerprint is zero. Long texts are hashed in chunks.
    """
    return majority_bits(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` with a bigint column of the fingerprint's bits. A null text has no words: zero."""

    def make(column: pa.Array) -> list:
        return [np.array([fingerprint(t, words, seed) for t in byte_texts(column)], np.uint64).view(np.int64)]

    return add_columns(docs, text, [T.StructField(name, T.LongType())], make)


def _bounds(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the child with bit 1 begins in each node [lo, hi) at this depth."""
    bit = np.uint64(1 << (63 - depth))
    top = np.uint64((0xFFFFFFFFFFFFFFFF >> (64 - depth) << (64 - depth)) if depth else 0)
    return np.clip(np.searchsorted(keys, (keys[lo] & top) | bit), lo, hi)


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, spent: int, budget: int, leaf: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in ``budget`` bits at most, from a traversal of node pairs.

    ``left`` and ``right`` are sorted distinct uint64 values under one trie node each, at the same
    depth; ``right`` None joins ``left`` with itself, each unordered pair once. A node is a range of
    the sorted values. Node pairs go down together, one bit a level; a pair whose bits differ adds
    one to what it has spent, and is pruned beyond the budget. Small pairs are compared outright.
    The stack holds blocks of node pairs, so memory is bounded by the block size times the depth.
    """
    same = right is None
    right = left if same else right
    if not len(left) or not len(right):
        return
    one = lambda x: np.array([x], np.int64)
    stack = [(depth, one(0), one(len(left)), one(0), one(len(right)), one(spent))]
    while stack:
        depth, l0, l1, r0, r1, diff = stack.pop()
        if len(l0) > BLOCK:
            half = len(l0) // 2
            stack += [(depth, *(x[:half] for x in (l0, l1, r0, r1, diff))), (depth, *(x[half:] for x in (l0, l1, r0, r1, diff)))]
            continue
        sizes = (l1 - l0) * (r1 - r0)
        small = sizes <= leaf
        if small.any():
            n, a0, b0, nb = sizes[small], l0[small], r0[small], (r1 - r0)[small]
            at = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            a, b = a0[at] + k // nb[at], b0[at] + k % nb[at]
            near = np.bitwise_count(left[a] ^ right[b]) <= budget
            if same:
                near &= a < b
            if near.any():
                yield a[near], b[near]
        big = ~small
        if not big.any():
            continue
        l0, l1, r0, r1, diff = (x[big] for x in (l0, l1, r0, r1, diff))
        lm, rm = _bounds(left, l0, l1, depth), _bounds(right, r0, r1, depth)
        own = (l0 == r0) & (l1 == r1) if same else np.zeros(len(l0), bool)
        children = [(l0, lm, r0, rm, diff), (lm, l1, rm, r1, diff), (l0, lm, rm, r1, diff + 1), (lm, l1, r0, rm, diff + 1)]
        keep = [np.ones(len(l0), bool), np.ones(len(l0), bool), diff < budget, (diff < budget) & ~own]
        parts = [[x[k & (c[0] < c[1]) & (c[2] < c[3])] for x in c] for c, k in zip(children, keep, strict=True)]
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n nodes."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            low = np.minimum(ra, rb)
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while not (root[root] == root).all():
                root = root[root]
    return root


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of the pairs, fewer than n, that connect the same nodes as all of them."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                break
            a, b, low = a[apart], b[apart], low[apart]
            high, at = np.unique(high[apart], return_index=True)
            yield a[at], b[at]
            root[high] = low[at]
            while not (root[root] == root).all():
                root = root[root]


def _join_subtrees(budget: int):
    """Links within one pair of subtrees that connect what its links connect: fewer rows than values."""

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        p, q, depth = (table.column(c)[0].as_py() for c in ("p", "q", "depth"))
        side = table.column("side").to_numpy()
        left, right = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        nodes = np.concatenate([left, right])
        found = trie_links(left, None, depth, 0, budget) if p == q else ((a, b + len(left)) for a, b in trie_links(left, right, depth, (p ^ q).bit_count(), budget))
        links = list(spanning(len(nodes), found))
        a, b = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in range(2))
        return pa.table({"a": nodes[a].view(np.int64), "b": nodes[b].view(np.int64)})

    return run


def _deeper(rows: DataFrame, budget: int, bits: int) -> DataFrame:
    """Rows (fp, p, q, side, depth) dealt to the pairs that their subtrees form so many bits further down, within the budget."""
    masks = [sum(1 << b for b in some) for r in range(budget + 1) for some in combinations(range(bits), r)]
    left = F.lit(budget) - F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    own = F.expr(f"shiftrightunsigned(fp, 64 - depth - {bits})").bitwiseAND(F.lit((1 << bits) - 1))
    same, first = F.col("p") == F.col("q"), F.col("side") == 0
    made = rows.withColumn("mask", F.explode(F.filter(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.bit_count(m) <= left)))
    made = made.withColumn("own", own).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    below = lambda node, bits_of: F.shiftleft(node, bits).bitwiseOR(bits_of)
    return made.select(
        "fp",
        below(F.col("p"), F.when(same, F.least("own", "other")).when(first, F.col("own")).otherwise(F.col("other"))).alias("p"),
        below(F.col("q"), F.when(same, F.greatest("own", "other")).when(first, F.col("other")).otherwise(F.col("own"))).alias("q"),
        F.when(same, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side")).alias("side"),
        (F.col("depth") + bits).alias("depth"),
    )


def trie_self_join(fps: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE) -> DataFrame:
    """Links (a, b) between ``fp`` values that differ in ``budget`` bits at most; they connect what all such pairs connect.

    The top of the trie is met as a table: at a depth where a subtree holds about ``subtree`` values,
    every value goes to each pair of subtrees that its own subtree forms with one within the budget,
    1 + d + d(d-1)/2 of them for two bits. A pair that still holds several times as many values, as it
    is dense, goes further down with what is left of the budget, until none does. Each pair is then
    traversed in a task. Values are made distinct first, so any number of equal texts is one value.
    """
    values = durable(fps.select("fp").distinct())
    depth = min(24, max(0, math.ceil(math.log2(max(values.count(), 1) / subtree))))
    zero = F.lit(0).cast("long")
    rows = _deeper(values.select("fp", zero.alias("p"), zero.alias("q"), F.lit(0).alias("side"), F.lit(0).alias("depth")), budget, depth)
    light = None
    while True:
        size = rows.groupBy("p", "q", "depth").agg(F.count("*").alias("n"), F.countDistinct("side").alias("sides"))
        dense = (F.col("n") > 4 * subtree) & (F.col("depth") <= 64 - DEEPER) & ((F.col("p") == F.col("q")) | (F.col("sides") > 1))
        heavy = durable(size.where(dense).select("p", "q", "depth"))
        some = not heavy.isEmpty()
        here = rows.join(heavy, ["p", "q", "depth"], "left_anti").select(*rows.columns) if some else rows
        light = here if light is None else light.unionByName(here)
        if not some:
            return light.groupBy("p", "q", "depth").applyInArrow(_join_subtrees(budget), "a long, b long")
        rows = durable(_deeper(rows.join(heavy, ["p", "q", "depth"], "left_semi").select(*rows.columns), budget, DEEPER))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: its id, ``fingerprint`` in hex and ``component_id``.

    Fingerprints that differ in ``budget`` bits at most are linked; component_id is the smallest id
    reachable, the document's own included. Texts without words (null, empty, white space) have the
    fingerprint zero and are linked like any others. Repeated rows each give a row, all in one
    component. A null id is ignored when the smallest is taken; a component of null ids only has a
    null component_id. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    marked = durable(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words, seed=seed).select("doc_id", "fp"))
    links = stars(trie_self_join(marked, budget))
    first = (
        marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
        .join(links.select(F.col("a").alias("fp"), F.col("b").alias("star")), "fp", "left")
        .withColumn("star", F.coalesce("star", "fp"))
    )
    component = first.groupBy("star").agg(F.min("least").alias("component_id"))
    of = first.join(component, "star").select("fp", "component_id")
    return marked.join(of, "fp").select(
        F.col("doc_id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
