"""Streaks of a stream equal those of the batch, with late rows and after a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lumenary.operators.runs import failure_streaks
from lumenary.streaming.events import read_folder, run_available
from lumenary.streaming.streaks import STATE_STORE, streaks

SCHEMA = "key string, id long, at timestamp, failed boolean"


@pytest.fixture(autouse=True)
def state_store(spark):
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in STATE_STORE:
        spark.conf.unset(k)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def rows_of(seed, n, keys="abc"):
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    return [(rng.choice(keys), k, start + datetime.timedelta(minutes=10 * k + rng.randrange(3)), rng.random() < 0.6) for k in range(n)]


def batch(spark, rows):
    runs = spark.createDataFrame(rows, SCHEMA).select(F.col("key").alias("source_id"), F.col("id").alias("run_id"), F.col("at").alias("started_at"), F.when(F.col("failed"), "FAIL").otherwise("OK").alias("status"))
    return {r.source_id: (r.current_streak, r.longest_streak) for r in failure_streaks(runs).collect()}


def stream(spark, folder, checkpoint, last):
    run_available(streaks(read_folder(spark, folder, SCHEMA, 1), "6 hours"), checkpoint, lambda b, _: last.update({r.key: (r.streak, r.longest) for r in b.collect()}), "update")


def test_late_rows_count_where_they_belong(spark, tmp_path):
    rows = rows_of(3, 120)
    late = [r for r in rows if r[1] % 5 == 0]  # each block's fifth rows come with the next block, one to five hours late
    folder, last = str(tmp_path / "in"), {}
    for k in range(0, 120, 30):
        now = [r for r in rows[k : k + 30] if r not in late]
        put(spark, folder, now + [r for r in late if k - 30 <= r[1] < k])
        stream(spark, folder, str(tmp_path / "cp"), last)
    put(spark, folder, [r for r in late if r[1] >= 90])
    stream(spark, folder, str(tmp_path / "cp"), last)  # each block was a run of its own, so every one of them began from the checkpoint
    assert last == batch(spark, rows)


def test_rows_that_arrive_again_change_nothing(spark, tmp_path):
    rows, folder, last = rows_of(4, 40), str(tmp_path / "in"), {}
    for part in (rows[:25], rows[15:], rows[20:]):
        put(spark, folder, part)
    stream(spark, folder, str(tmp_path / "cp"), last)
    assert last == batch(spark, rows)
