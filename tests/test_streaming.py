"""Streams give what the same transformation gives on a batch, and sinks may be run again."""

from pyspark.sql import functions as F

from lumenary.operators import ingest
from lumenary.operators.runs import failure_streaks as batch_streaks
from lumenary.streaming import events as S
from lumenary.streaming.streaks import STATE_STORE

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def land(spark, sf, tmp_path, n=3):
    folder = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(n, "ts").write.parquet(folder)
    return folder


def collected(stream, tmp_path, mode):
    out = {}
    S.run_available(stream, str(tmp_path / "cp"), lambda b, k: out.__setitem__(k, b.collect()), mode)
    return [r for k in sorted(out) for r in out[k]]


def test_counts(spark, sf, tmp_path):
    folder = land(spark, sf, tmp_path)
    rows = collected(S.event_counts(S.read_folder(spark, folder, SCHEMA, 1)), tmp_path, "complete")
    want = {tuple(r) for r in S.event_counts(spark.read.parquet(folder)).collect()}
    assert want <= {tuple(r) for r in rows}


def test_windows(spark, sf, tmp_path):
    folder = land(spark, sf, tmp_path)
    stream = S.rate_windows(S.read_folder(spark, folder, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")), 1)
    assert len(collected(stream, tmp_path, "complete")) == S.rate_windows(spark.read.parquet(folder), 1).count()


def test_first_delivery(spark, sf, tmp_path):
    folder = land(spark, sf, tmp_path, 1)
    stream = S.read_folder(spark, folder, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = collected(S.first_delivery(stream.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "400 days"), tmp_path, "append")
    assert len(rows) == spark.read.parquet(folder).select("user_id", "event_type").distinct().count()


def test_streaks(spark, sf, tmp_path):
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    folder = land(spark, sf, tmp_path)
    as_runs = lambda df: df.select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started_at"), F.when(F.col("event_type") == "error", "FAIL").otherwise("OK").alias("status"))
    rows = collected(S.failure_streaks(as_runs(S.read_folder(spark, folder, SCHEMA)), "400 days"), tmp_path, "update")
    got = {r.source_id: (r.streak, r.longest) for r in rows}
    assert got == {r.source_id: (r.current_streak, r.longest_streak) for r in batch_streaks(as_runs(spark.read.parquet(folder))).collect()}
    for k in STATE_STORE:
        spark.conf.unset(k)


def test_sliding_digest(spark, tmp_path):
    rows = [(1 + k % 2, f"2024-01-0{1 + k // 12} {k % 12 + 3:02d}:30:00", float(k)) for k in range(40)]
    events = spark.createDataFrame(rows, "user_id long, at string, value double").select("user_id", F.col("at").cast("timestamp").alias("ts"), "value")
    ahead = spark.createDataFrame([(9, "2024-03-01 00:00:00", 0.0)], "user_id long, at string, value double").select("user_id", F.col("at").cast("timestamp").alias("ts"), "value")
    folder = str(tmp_path / "in")
    for part in (events.where("value < 20"), events.where("value >= 20"), ahead):  # the last one moves the watermark past all before it
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = S.sliding_digest(S.read_folder(spark, folder, events.schema, 1), "12 hours")
    got = {tuple(r) for r in collected(stream, tmp_path, "append") if r.user_id < 9}
    assert got == {tuple(r) for r in S.sliding_digest(events).collect()} and len(got) > 60


def test_append_once(spark, tmp_path):
    write, path = S.append_once(str(tmp_path / "table"), ["user_id", "job_id"], "day"), str(tmp_path / "table")
    made = lambda *rows: spark.createDataFrame(rows, "user_id long, job_id long").withColumn("day", F.make_date(F.lit(2024), F.lit(1), (F.col("job_id")).cast("int")))
    first = made((1, 2), (1, 2), (1, 3))
    for k, rows in ((0, first), (0, first), (1, first.union(made((2, 2)))), (2, made((5, 9)))):
        write(rows, k)
    stored = spark.read.parquet(path)
    assert sorted((r.user_id, r.job_id) for r in stored.collect()) == [(1, 2), (1, 3), (2, 2), (5, 9)]
    assert {(str(r._day), r._batch) for r in stored.select("_day", "_batch").collect()} == {("2024-01-02", 0), ("2024-01-03", 0), ("2024-01-02", 1), ("2024-01-09", 2)}


def test_missed_cycles(spark):
    rows = spark.createDataFrame([(1, "ACTIVE", 2), (2, "ACTIVE", 0), (3, "ACTIVE", 2), (4, "REMOVED", 9)], "job_id long, status string, missed_cycles int")
    seen = spark.createDataFrame([(3,), (4,), (5,)], "job_id long")
    assert {r.job_id: (r.missed_now, r.status_now) for r in ingest.reconcile(rows, seen).collect()} == {1: (3, "REMOVED"), 2: (1, "ACTIVE"), 3: (0, "ACTIVE")}
    out = ingest.upsert(rows.withColumn("last_seen_at", F.lit(None).cast("timestamp_ntz")), seen, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {r.job_id: (r.status, r.outcome) for r in out.collect()} == {1: ("ACTIVE", "KEPT"), 2: ("ACTIVE", "KEPT"), 3: ("ACTIVE", "TOUCHED"), 4: ("ACTIVE", "REVIVED"), 5: ("ACTIVE", "CREATED")}


def test_append_is_idempotent(spark):
    new = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "user_id long, job_id long")
    once = ingest.append_new(new.limit(0), new, ["user_id", "job_id"])
    assert once.count() == 2 and ingest.append_new(once, new, ["user_id", "job_id"]).count() == 0
    assert ingest.replace_children(new, spark.createDataFrame([(1, 9)], new.schema), "user_id").count() == 2
