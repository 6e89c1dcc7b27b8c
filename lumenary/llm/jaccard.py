"""SimHash near-duplicates at five words and a similarity of 0.8 or more, none left out.

The trie self-join of five-word fingerprints gives candidates, and an exact check of their shingle sets decides.
Fingerprints of texts at a similarity of 0.8 differ in about ten bits, which no trie can be walked with, so
a join by prefixes of the sorted sets follows for the links that the trie's budget does not reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.llm import arrow
from lumenary.llm.arrow import add_columns, byte_texts
from lumenary.llm.components import stars
from lumenary.llm.simhash import majority_bits, shingle_hashes, spanning, trie_self_join
from lumenary.llm.storage import discard, durable

#: Words of a shingle, seed of its hash, and the least similarity of a link as a fraction.
SHINGLE_WORDS, SEED, LEAST, OF = 5, 42, 4, 5
#: Texts counted to find common shingles, texts of these that make one common, and the most that are kept.
SAMPLE, COMMON, MOST_COMMON = 20_000, 2, 1_000_000
#: Postings of a task, pairs that a task looks at at once, partners of a posting in a random round, and such rounds.
BUCKET, BLOCK, NEAREST, RANDOM_ROUNDS = 150_000, 1 << 17, 3, 2

#: Bytes of a sketch, and of one of a set of more than so many shingles: each shingle flips one bit, so sketches
#: differ in no more bits than sets in shingles.
SKETCH, LARGE_SKETCH, LARGE = 32, 128, 300

_NODE = [T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
_POSTING, _PAIR = "h long, key long, n int, pos int", "a long, b long, na int, nb int"


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the text's word shingles, sorted. A-Z are lowered; fewer words are one shingle, none are no shingle."""
    found = list(shingle_hashes(text, words, SEED))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def sketch(found: np.ndarray) -> bytes:
    """The parity of how many shingles fall on each bit."""
    bits = 8 * (LARGE_SKETCH if len(found) > LARGE else SKETCH)
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


class Sketches:
    """Sketches of two sizes; a large one folds to a small one."""

    def __init__(self, sketches: list[bytes]) -> None:
        self.large = np.array([len(b) > SKETCH for b in sketches], bool)
        self.row = np.cumsum(self.large) - 1
        self.wide = np.frombuffer(b"".join([b for b in sketches if len(b) > SKETCH]), np.uint64).reshape(-1, LARGE_SKETCH // 8)
        self.small = np.empty((len(sketches), SKETCH // 8), np.uint64)
        self.small[~self.large] = np.frombuffer(b"".join([b for b in sketches if len(b) == SKETCH]), np.uint64).reshape(-1, SKETCH // 8)
        self.small[self.large] = np.bitwise_xor.reduce(self.wide.reshape(-1, LARGE_SKETCH // SKETCH, SKETCH // 8), axis=1)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sketches at i and j differ."""
        out = np.bitwise_count(self.small[i] ^ self.small[j]).sum(1, dtype=np.int64)
        both = np.flatnonzero(self.large[i] & self.large[j])
        out[both] = np.bitwise_count(self.wide[self.row[i[both]]] ^ self.wide[self.row[j[both]]]).sum(1, dtype=np.int64)
        return out


def prefix(found: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The part of a set that a set as similar must meet, in an order that has common shingles last.

    Whatever order all sets agree on, two sets of similarity t share one of the first n - ceil(t n) + 1
    of each; that common ones come last only saves work.
    """
    n = len(found)
    if not n:
        return found
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, count[at], 0)
    return found[np.argsort(rank, kind="stable")[: n - -(-LEAST * n // OF) + 1]]


def _common(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of the texts, sorted, and their counts."""
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(max(1, n // SAMPLE))) == 0)
    rows = _sets(some).select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON).orderBy(F.desc("c"), "h").limit(MOST_COMMON).toArrow()
    h, c = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _sorted_postings(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The columns by shingle, then size, then key; and for each posting, where the partners behind it end."""
    h, key, n, pos = (table.column(c).to_numpy() for c in ("h", "key", "n", "pos"))
    order = np.lexsort((key, n, h))
    h, key, n, pos = h[order], key[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    run = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) if len(h) else h
    wide = run * (1 << 34) + n
    end = np.searchsorted(wide, run * (1 << 34) + n * OF // LEAST, side="right")
    return order, run, key, n, pos, end


def _met(table: pa.Table) -> pa.Table:
    """Postings with a partner of fitting size under the same shingle."""
    order, run, key, n, pos, end = _sorted_postings(table)
    at = np.arange(len(order))
    many = end - at > 1
    keep = np.zeros(len(order) + 1, np.int64)
    np.add.at(keep, at[many], 1)
    np.add.at(keep, end[many], -1)
    return table.take(pa.array(order[np.cumsum(keep)[:-1] > 0])).select(["h", "key", "n", "pos"])


def _partners(n: np.ndarray, run: np.ndarray, end: np.ndarray, own: np.ndarray, step: np.ndarray | None):
    """Blocks (i, j) of places of postings with partners to look at: few at random, or all in another component."""
    at, width = np.arange(len(n)), np.zeros(len(n), np.int64)
    if step is not None:  # partners that differ by shingle, so that large groups meet at random
        begin, some = at + 1, np.maximum(end - at - 1, 0)
        width = np.minimum(some, NEAREST)
    else:  # who is not in the list's largest component looks at all the others, on both sides
        code = np.unique(own, return_inverse=True)[1] + run * (len(own) + 1)
        kinds, of, count = np.unique(code, return_inverse=True, return_counts=True)
        largest = np.lexsort((count, kinds // (len(own) + 1)))
        last = np.append(np.diff(kinds[largest] // (len(own) + 1)) != 0, True) if len(kinds) else np.zeros(0, bool)
        main = np.zeros(len(kinds), bool)
        main[largest[last]] = True
        minor = ~main[of]
        wide = run * (1 << 34) + n
        begin = np.searchsorted(wide, run * (1 << 34) - (-n * LEAST // OF))
        width = np.where(minor, end - begin, 0)
    total, lo = np.concatenate([[0], np.cumsum(width)]), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BLOCK, side="right")) - 1)
        c = width[lo:hi]
        i = np.repeat(at[lo:hi], c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        if step is not None:
            j = ((step[i] + j.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % some[i] + begin[i]
        else:
            j += begin[i]
            once = (own[i] != own[j]) & (~minor[j] | (i < j))
            i, j = i[once], j[once]
        yield i, j
        lo = hi


def _pairs(seed: int | None):
    """Distinct pairs of keys under a common shingle whose sizes, places in the sets and sketches allow the similarity.

    With a seed, partners are drawn, and only pairs that span what the drawn ones connect are returned.
    """

    def run(table: pa.Table) -> pa.Table:
        arrow.KEPT.clear()
        order, runs, key, n, pos, end = _sorted_postings(table)
        sketches = Sketches(table.column("sketch").take(pa.array(order)).to_pylist())
        own = table.column("component").to_numpy()[order]
        step = None if seed is None else (table.column("h").to_numpy()[order].view(np.uint64) ^ key.view(np.uint64)) + np.uint64(seed)
        out = [np.empty((2, 0), np.int64)]
        for i, j in _partners(n, runs, end, own, step):
            least = -(-LEAST * (n[i] + n[j]) // (LEAST + OF))  # shingles that both must have
            fits = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least) & (own[i] != own[j])
            i, j, least = i[fits], j[fits], least[fits]
            fits = sketches.apart(i, j) <= n[i] + n[j] - 2 * least
            i, j = i[fits], j[fits]
            if len(i):
                flip = key[i] > key[j]
                out.append(np.unique(np.stack([np.where(flip, j, i), np.where(flip, i, j)]), axis=1))
        a, b = np.concatenate(out, axis=1)
        if len(a):
            _, once = np.unique(np.stack([key[a], key[b]]), axis=1, return_index=True)
            a, b = a[once], b[once]
        if len(a) and seed is not None:
            ends = np.unique(key[np.concatenate([a, b])], return_inverse=True)[1]
            number = {x: k for k, x in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True))}
            some = [number[x] for left, right in spanning(int(ends.max()) + 1, iter([(ends[: len(a)], ends[len(a) :])])) for x in zip(left.tolist(), right.tolist(), strict=True)]
            a, b = a[some], b[some]
        return pa.table({"a": key[a], "b": key[b], "na": n[a].astype(np.int32), "nb": n[b].astype(np.int32)})

    return run


def _sets(texts: DataFrame) -> DataFrame:
    def make(column: pa.Array) -> list:
        arrow.KEPT.clear()
        return [[shingles(t).view(np.int64) for t in byte_texts(column)]]

    return add_columns(texts, "text", [T.StructField("h", T.ArrayType(T.LongType()))], make)


def _verified(found: DataFrame, rows: DataFrame, of_text: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, from the shingles of the texts that occur in pairs; ``of_text`` has a text's mark for each key."""
    pairs = durable(found.distinct())
    used = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    texts = rows.select("text", F.md5("text").alias("mark")).join(of_text.join(used, "key", "left_semi"), "mark").select("key", "text").dropDuplicates(["key"])
    sets = durable(_sets(texts).select("key", "h"))
    left, right = sets.select(F.col("key").alias("a"), F.col("h").alias("x")), sets.select(F.col("key").alias("b"), F.col("h").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    links = durable(pairs.join(left, "a").join(right, "b").where(both * (LEAST + OF) >= LEAST * (F.col("na") + F.col("nb"))).select("a", "b"))
    discard(pairs, sets)
    return links


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``mark`` (MD5 of the text) and ``component`` of its text.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is LEAST / OF or
    more, none left out; components follow links. Sets are known by 64-bit hashes of shingles and of
    themselves; texts without words have the same, empty set. Candidates are looked for in rounds: the
    trie self-join of the five-word SimHash fingerprints; few partners of each posting, at random; and all partners in
    another component whose sketches allow the similarity, so that a large group of near copies is not
    paired with itself. Each round's candidates are checked exactly.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    common, count = _common(rows, rows.count())

    def make(column: pa.Array) -> list:
        arrow.KEPT.clear()
        out: list[list] = [[] for _ in _NODE]
        for t in byte_texts(column):
            hashes = list(shingle_hashes(t, SHINGLE_WORDS, SEED))
            s = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
            key, fp = (np.uint64(x).view(np.int64) for x in (xxhash.xxh64_intdigest(s.tobytes(), SEED), majority_bits(iter(hashes))))
            for o, v in zip(out, (key, fp, len(s), sketch(s), prefix(s, common, count).view(np.int64)), strict=True):
                o.append(v)
        return out

    nodes = durable(add_columns(rows.withColumn("mark", F.md5("text")), "text", _NODE, make).select("doc_id", "mark", *(f.name for f in _NODE)))
    of_text = durable(nodes.groupBy("key").agg(F.min("mark").alias("mark")))
    firsts = nodes.groupBy("key").agg(F.min(F.struct("fp", "n", "sketch", "prefix")).alias("s")).select("key", "s.*")
    sketches = durable(firsts.select("key", "fp", "n", "sketch"))
    buckets = max(1, (firsts.agg(F.sum(F.size("prefix"))).first()[0] or 0) // BUCKET)
    dealt = firsts.select("key", "n", F.posexplode("prefix").alias("pos", "h")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    met = durable(dealt.groupBy("bucket").applyInArrow(_met, _POSTING))
    drawn = durable(met.join(sketches.select("key", "sketch"), "key").withColumn("bucket", F.pmod("h", F.lit(buckets))))
    label = lambda df, links: df.join(links.select(F.col("a").alias("key"), F.col("b").alias("component")), "key", "left").withColumn("component", F.coalesce("component", "key"))

    of_fp = sketches.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("first"))
    ends = trie_self_join(sketches).join(of_fp.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    same = sketches.join(of_fp, "fp").where(F.col("key") > F.col("first.key")).select(F.struct("key", "n").alias("x"), F.col("first").alias("y"))
    candidates = ends.select("x", "y").unionByName(same).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"), F.when(F.col("x.key") < F.col("y.key"), F.col("x.n")).otherwise(F.col("y.n")).alias("na"), F.when(F.col("x.key") < F.col("y.key"), F.col("y.n")).otherwise(F.col("x.n")).alias("nb"))
    known = stars(_verified(candidates, rows, of_text))
    for seed in (*range(1, 1 + RANDOM_ROUNDS), None):
        more = _verified(label(drawn, known).groupBy("bucket").applyInArrow(_pairs(seed), _PAIR), rows, of_text)
        before, known = known, stars(known.unionByName(more))
        discard(before, more)
    discard(met, drawn, sketches, of_text)
    return label(nodes.select("doc_id", "mark", "key"), known).select(F.col("doc_id").alias(doc_id), "mark", "component")
