"""Language-model scores: unigram words, and prediction by partial matching over bytes."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.storage import durable

#: Bytes of context, bytes of text that a block of documents should have, and bytes taken at once.
ORDER, BLOCK_BYTES, PIECE_BYTES = 4, 32 << 20, 2 << 20
#: Bytes that UTF-8 never has: one before a text begins, one where it ends.
PAD, END = 0xFE, 0xFF
#: The end of a text, counted as a word; it has white space, so no word equals it.
END_WORD = b" "
WORD, GRAM = 0, 1
#: Smoothing of the word model.
ADD = 0.1


def word_key(word: bytes) -> int:
    """A word's 64-bit key, as the word tables have it."""
    return xxhash.xxh64_intdigest(word, 7)


def pieces(texts: list[bytes], order: int) -> list[list[int]]:
    """Numbers of texts that are taken together: some megabytes, at least one text."""
    out: list[list[int]] = []
    size = PIECE_BYTES
    for k, t in enumerate(texts):
        if size >= PIECE_BYTES:
            out.append([])
            size = 0
        out[-1].append(k)
        size += len(t) + order + 1
    return out


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts and each end, packed behind the ``order`` bytes before it; where each text begins."""
    pad = bytes([PAD]) * order
    flat = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8)
    packed = np.zeros(len(flat) - order, np.uint64)
    for k in range(order + 1):
        packed <<= np.uint64(8)
        packed |= flat[k : len(packed) + k]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return packed[flat[order:] != PAD], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _lowered(table: pa.Table) -> list[bytes]:
    return [(t or b"").lower() for t in table.column("text").cast(pa.binary()).to_pylist()]


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    u, at = np.unique(k, return_inverse=True)
    return u, np.bincount(at, n, len(u)).astype(np.int64)


def _count(order: int):
    """Distinct words and grams of a block of documents, with their counts in its training texts."""

    def run(table: pa.Table) -> pa.Table:
        texts, train = _lowered(table), table.column("train").to_pylist()
        words: Counter = Counter()
        seen: set[bytes] = set()
        for t, learn in zip(texts, train, strict=True):
            w = t.split()
            (words if learn else seen).update(w)
            if learn:
                words[END_WORD] += 1
        seen |= words.keys()
        seen.add(END_WORD)
        keys, counts = [], []
        for part in pieces(texts, order):
            for learn in (True, False):
                some = [texts[k] for k in part if bool(train[k]) is learn]
                if some:
                    u, n = np.unique(grams(some, order)[0], return_counts=True)
                    keys.append(u)
                    counts.append(n if learn else np.zeros(len(u), np.int64))
            if len(keys) > 16:
                u, n = _merge(keys, counts)
                keys, counts = [u], [n]
        g, n = _merge(keys, counts)
        w = np.fromiter((word_key(x) for x in seen), np.uint64, len(seen))
        c = np.fromiter((words[x] for x in seen), np.int64, len(seen))
        return pa.table(
            {
                "block": pa.array(np.full(len(w) + len(g), table.column("block")[0].as_py()), pa.int64()),
                "kind": pa.array(np.repeat([WORD, GRAM], [len(w), len(g)]), pa.int32()),
                "key": np.concatenate([w, g]).view(np.int64),
                "n": np.concatenate([c, n]),
            }
        )

    return run


def byte_model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """log10 probability of the last byte of each gram after those before it.

    ``counts`` has distinct ``key`` and ``n``, its count in training, which may be 0. The counts of
    a shorter context are sums over the longer ones, so they form a trie. A context with total T
    of D different bytes escapes with D / (T + D), otherwise predicts c / (T + D); below it, the
    bytes that it has seen are excluded from counts. A context never seen is passed without cost.
    After the empty context the bytes left are equally likely. All of it is joins and sums.
    """
    low = lambda key, n: key.bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))
    key = F.col("key")
    state = counts.select("key", F.lit(0.0).alias("p"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("et"), F.lit(0).cast("long").alias("ed"))
    level = counts.where("n > 0").select(key.alias("g"), F.col("n").alias("c"))
    for m in range(order, -1, -1):
        if m < order:
            level = level.groupBy(low(F.col("g"), m + 1).alias("g")).agg(F.sum("c").alias("c"))
        level = durable(level)
        context = F.shiftrightunsigned("g", 8)
        below = level.groupBy(low(F.col("g"), m).alias("b")).agg(F.sum("c").alias("bc")) if m else None
        seen = level.join(below, low(F.col("g"), m) == F.col("b")) if m else level.withColumn("bc", F.lit(0).cast("long"))
        stats = seen.groupBy(context.alias("ctx")).agg(F.sum("c").alias("t"), F.count("*").alias("d"), F.sum("bc").alias("next_et"))
        joined = (
            state.withColumn("g", low(key, m + 1))
            .join(level, "g", "left")
            .withColumn("ctx", F.shiftrightunsigned("g", 8))
            .join(stats, "ctx", "left")
        )
        t, d = F.col("t") - F.col("et"), F.col("d") - F.col("ed")
        here = ~F.col("done") & F.col("t").isNotNull()
        gain = F.when(F.col("c").isNotNull(), F.log10(F.col("c") / (t + d))).when(d > 0, F.log10(d / (t + d))).otherwise(0.0)
        state = durable(
            joined.select(
                "key",
                (F.col("p") + F.when(here, gain).otherwise(0.0)).alias("p"),
                (F.col("done") | F.col("c").isNotNull()).alias("done"),
                F.coalesce("next_et", F.lit(0)).alias("et"),
                F.coalesce("d", F.lit(0)).alias("ed"),
            )
        )
    return state.select("key", F.when(F.col("done"), F.col("p")).otherwise(F.col("p") - F.log10((F.lit(256) - F.col("ed")).cast("double"))).alias("value"))


class Lookup:
    """Values of sorted distinct keys; a table by hash finds most, a binary search the others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(10, int(len(keys)).bit_length() + 1))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


def _score(order: int, total: int, distinct: int):
    """Scores of a block of documents by the values of its own words and grams."""
    least = math.log10(ADD)
    norm = math.log10(total + ADD * (distinct + 1))

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        texts = _lowered(docs)
        kind, key, value = (values.column(c).to_numpy() for c in ("kind", "key", "value"))
        key = key.view(np.uint64)
        by_word = Lookup(key[kind == WORD], value[kind == WORD])
        by_gram = Lookup(key[kind == GRAM], value[kind == GRAM])
        score, base = np.zeros(len(texts)), np.zeros(len(texts))
        n_tokens, n_known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for part in pieces(texts, order):
            numbers: dict[bytes, int] = {END_WORD: 0}
            ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in texts[k].split()), np.int64) for k in part]
            word_values = by_word.of(np.fromiter((word_key(w) for w in numbers), np.uint64, len(numbers)))
            for k, i in zip(part, ids, strict=True):
                own = np.append(word_values[i], word_values[0])
                base[k] = own.sum() - len(own) * norm
                n_tokens[k], n_known[k] = len(own), int((own > least + 1e-9).sum())
            packed, begins = grams([texts[k] for k in part], order)
            score[part] = np.add.reduceat(by_gram.of(packed), begins)
        held = [not t for t in docs.column("train").to_pylist()]
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": pa.array(held, pa.bool_()), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(texts), total), "base_score": base, "score": score})

    return run


def is_training(doc_id: Column, folds: int = 10) -> Column:
    """True if the row's texts are learned from: crc32 of the id as text is no multiple of ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != 0, F.lit(False))


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z). base_score is a smoothed unigram model of words and text ends;
    score the log10 probability of the text's bytes and its end under prediction by partial
    matching, pretrained on the training rows. A null text is an empty one: its end only. A row
    with a null id is held out. Without training rows every word is unknown and every byte equally
    likely. Repeated rows count as often as they occur. An empty table gives no rows.

    Neither vocabulary nor trie is gathered anywhere: documents are dealt by hash to blocks of
    bounded size; a block gives its distinct words and grams, these meet the corpus counts in
    a join, and the values go back to the block that asked. What is shuffled grows with the input.
    Words meet by 64-bit keys.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).withColumn("train", is_training(F.col("doc_id"), folds))
    asked = durable(dealt.groupBy("block").applyInArrow(_count(order), "block long, kind int, key long, n long"))
    counts = durable(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total, distinct = counts.where((F.col("kind") == WORD) & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("kind") == WORD).select("kind", "key", F.log10(F.col("n") + ADD).alias("value"))
    model = byte_model(counts.where(F.col("kind") == GRAM).select("key", "n"), order).select(F.lit(GRAM).alias("kind"), "key", "value")
    answers = asked.select("block", "kind", "key").join(words.unionByName(model), ["kind", "key"]).select("block", "kind", "key", "value")
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, total, distinct), schema)
