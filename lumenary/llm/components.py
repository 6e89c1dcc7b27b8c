"""Connected components by alternating star contraction, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.storage import discard, durable


def _state(edges: DataFrame):
    """A fingerprint of an edge set: its size and the sum of its row hashes."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def stars(edges: DataFrame) -> DataFrame:
    """From links (a, b) to (a, b) where b is the smallest node of a's component and a is not b.

    Each round links every larger neighbour of a node to the smallest one, then every smaller
    neighbour likewise; rounds grow with the logarithm of the longest path. Only sums, joins and
    minima run on the executors: a hub's rows are combined before they are shuffled, and its join
    is one that adaptive execution can split. The driver sees two numbers a round.
    """
    now = durable(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        after = durable(small)
        state = _state(after)
        discard(now)
        now = after
        if state == before:
            return now
        before = state
