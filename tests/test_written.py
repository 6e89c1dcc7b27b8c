"""Tables that jobs write: the run log as one unit, children replaced bucket by bucket."""

import os

from pyspark.sql import functions as F

from lumenary.bindings import relations as R
from lumenary.operators import ingest, runs


def test_run_log_is_one_unit_and_may_be_run_again(spark, sf, tmp_path):
    log = runs.run_log(spark, str(tmp_path / "log"))
    some = R.source_run(spark, sf).select("run_id", "source_id", "started_at", "status", "mode").where("run_id < 20")
    rows = R.run_category(spark, sf)
    assert log.read("runs").count() == 0
    assert runs.log_runs(log, 1, some.where("run_id < 10"), rows) and not runs.log_runs(log, 1, some, rows)
    assert runs.log_runs(log, 2, some.where("run_id >= 10"), rows)
    some.limit(1).write.parquet(f"{log.root}/runs/batch=3")  # an attempt that died before its category rows
    parents, children = log.read("runs").collect(), log.read("categories").collect()
    assert len(parents) == some.count() and len(children) == 3 * len(parents)
    for p in parents:
        mine = [c for c in children if c.run_id == p.run_id]
        assert (p.categories_searched, p.pages_fetched, p.errors, {c.batch for c in mine}) == (3, sum(c.pages_fetched for c in mine), sum(c.errors for c in mine), {p.batch})
    got = runs.coverage(R.source(spark, sf), log.read("runs"), log.read("categories").drop("batch"), R.job(spark, sf))
    assert got.count() >= R.source(spark, sf).count()


def test_a_run_without_categories(spark):
    some = spark.createDataFrame([(1, "a")], "run_id long, source_id string")
    none = spark.createDataFrame([], runs.CATEGORIES)
    assert [tuple(r) for r in runs.with_totals(some, none).collect()] == [(1, "a", 0, 0, 0, 0)]


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_children_are_replaced_in_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.range(400).selectExpr("id % 100 AS user_id", "id AS job_id", "1 AS score")
    ingest.write_children(spark, path, first, "user_id", 16)
    before = files(path)
    new = spark.createDataFrame([(7, 1, 9), (7, 2, 9), (500, 3, 9)], "user_id long, job_id long, score int")
    for _ in range(2):  # the second time changes nothing
        ingest.write_children(spark, path, new, "user_id", 16)
        stored = {tuple(r) for r in spark.read.parquet(path).select("user_id", "job_id", "score").collect()}
        assert stored == {tuple(r) for r in first.where("user_id <> 7").union(new).collect()}
    buckets = {r.b for r in new.select(ingest.bucket_of("user_id", 16).alias("b")).collect()}
    changed = {os.path.basename(os.path.dirname(f)) for f in before.keys() - files(path).keys()}
    assert changed == {f"bucket={b}" for b in buckets if any(f"bucket={b}/" in f for f in before)} and len(changed) <= 2
    assert spark.read.parquet(path).where(F.col("user_id") == 7).count() == 2
