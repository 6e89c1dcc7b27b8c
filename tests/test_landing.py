"""Landed payloads are read one partition each, and a stream goes on where it stopped."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_feeds import PAYLOADS

from lumenary.bindings.payloads import payloads
from lumenary.sources.feeds import PARSERS, parse, parse_all
from lumenary.sources.landing import land, register
from lumenary.streaming.events import run_available

AT = datetime(2024, 3, 1, 12, 30)


@pytest.fixture
def folder(spark, tmp_path):
    register(spark)
    for k, (kind, payload) in enumerate(PAYLOADS.items(), 1):
        land(str(tmp_path / "in"), k, kind, f"https://h.example/p/{kind}?a=1", AT, payload)
    return str(tmp_path / "in")


def pages(spark, folder, **options):
    return spark.read.format("landed").options(**options).load(folder)


def test_batch(spark, folder):
    df = pages(spark, folder)
    assert {(r.source_id, r.payload, r.fetched_at) for r in df.collect()} == {(k, p, AT) for k, p in PAYLOADS.items()}
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == len(PAYLOADS)
    assert pages(spark, folder, payloadsPerTask="4").select(F.spark_partition_id().alias("p")).distinct().count() == 3
    assert [r.source_id for r in pages(spark, folder, sources="posts,rss").orderBy("landed_no").collect()] == ["rss", "posts"]
    assert parse_all(df, {k: k for k in PARSERS}).count() > len(PARSERS)


def test_no_folder_and_awkward_sources(spark, tmp_path):
    register(spark)
    assert pages(spark, str(tmp_path / "none")).count() == 0
    land(str(tmp_path / "in"), 1, "a/../b é", "u", AT, "")
    assert [(r.source_id, r.payload) for r in pages(spark, str(tmp_path / "in")).collect()] == [("a/../b é", "")]


def test_a_stream_goes_on_behind_its_cursor(spark, folder, tmp_path):
    got = []
    stream = lambda: spark.readStream.format("landed").load(folder)
    each = lambda batch, k: got.append([r.landed_no for r in batch.collect()])
    run_available(stream(), str(tmp_path / "cp"), each)
    assert sorted(n for b in got for n in b) == list(range(1, len(PAYLOADS) + 1))
    got.clear()
    land(folder, 50, "rss", "u", AT, PAYLOADS["rss"])
    run_available(stream(), str(tmp_path / "cp"), each)
    assert sorted(n for b in got for n in b) == [50]
    titles = []
    run_available(parse(stream().where("source_id = 'rss'"), "rss"), str(tmp_path / "other"), lambda b, k: titles.extend(r.title for r in b.collect()))
    assert sorted(titles) == ["Finance Consultant", "Finance Consultant", "Intern", "Intern"]


def test_payloads_of_the_tables_survive_landing(spark, sf, tmp_path):
    register(spark)
    made = payloads(spark, sf, "json_list").collect()
    for k, r in enumerate(made, 1):
        land(str(tmp_path / "in"), k, r.source_id, r.url, r.fetched_at, r.payload)
    read = parse(pages(spark, str(tmp_path / "in"), payloadsPerTask="16"), "json_list")
    assert sorted(map(tuple, read.collect()), key=repr) == sorted(map(tuple, parse(payloads(spark, sf, "json_list"), "json_list").collect()), key=repr)
