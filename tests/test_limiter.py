"""Anchored windows of a batch equal those of a plain loop, and a stream's equal the batch's."""

import random

from pyspark.sql import functions as F

from lumenary.streaming.events import read_folder, run_available
from lumenary.streaming.limiter import limited, limited_stream, window_counts
from lumenary.streaming.streaks import STATE_STORE


def loop(rows, most, seconds):
    """(key, id) to (window start, allowed), by a table of buckets."""
    out, buckets = {}, {}
    for key, number, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        b = buckets.get(key)
        if b is None or b[1] <= at:
            b = buckets[key] = [at, at + seconds, 0]
        ok = b[2] < most
        b[2] += ok
        out[key, number] = (b[0] * 1000, ok)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, n long, s long").withColumn("ts", F.timestamp_seconds("s"))


def test_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), n, rng.randrange(4000) if n % 3 else 100 + n % 7) for n in range(900)]
    got = limited(frame(spark, rows), "k", "n", "ts", 3, 60)
    assert {(r.key, r.id): (r.window_start, r.allowed) for r in got.collect()} == loop(rows, 3, 60)
    ends = [("a", 1, 0), ("a", 2, 59), ("a", 3, 60), ("a", 4, 119), ("a", 5, 120)]
    assert [tuple(r) for r in window_counts(limited(frame(spark, ends), "k", "n", "ts", 1, 60)).collect()] == [("a", 5, 3, 3)]
    assert limited(frame(spark, rows).limit(0), "k", "n", "ts", 3, 60).count() == 0


def test_stream(spark, tmp_path):
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    rng = random.Random(2)
    rows = sorted((rng.choice("ab"), n, rng.randrange(3000)) for n in range(300))
    rows.sort(key=lambda r: r[2])
    folder, got = str(tmp_path / "in"), []
    for part in (rows[:100], rows[100:180], rows[180:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
        stream = limited_stream(read_folder(spark, folder, "k string, n long, s long, ts timestamp"), "k", "n", "ts", 2, 100)
        run_available(stream, str(tmp_path / "cp"), lambda b, _: got.extend(b.collect()))
    for k in STATE_STORE:
        spark.conf.unset(k)
    assert {(r.key, r.id): (r.window_start, r.allowed) for r in got} == loop(rows, 2, 100) and len(got) == 300
