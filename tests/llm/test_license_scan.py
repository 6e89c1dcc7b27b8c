import re

import pytest
from fixtures import TEXTS, awkward, empty

from lumenary.llm import queries
from lumenary.llm.license_scan import BASE, default_templates, license_scan


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(text):
    w = words(text)
    return sorted((i, label) for phrase, label in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def scan(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in license_scan(docs).orderBy("doc_id").collect()]


def test_awkward_rows(spark):
    got = license_scan(awkward(spark)).collect()
    assert len(got) == len(TEXTS) and all(r.n_words == len(words(t)) for r, t in zip(sorted(got, key=repr), sorted(TEXTS, key=repr), strict=False) if r.text == t)
    by = {(r.doc_id, r.n_words) for r in got}
    assert by == {(i, len(words(t))) for i, t in TEXTS}
    assert all(r.labels == [] and r.score == 0.0 and r.places == [] for r in got)
    assert "n_words" in got[0] and got[0]["kept"] == "k"


def test_empty_table_and_texts(spark):
    assert license_scan(empty(spark)).count() == 0
    assert [(r.n_words, r.labels, r.score) for r in scan(spark, None, "", " \n")] == [(0, [], 0.0)] * 3


def test_notices_are_placed_word_by_word(spark):
    mit = "Copyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, and so on."
    gpl = "# You can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation"
    got = scan(spark, mit, gpl, "x " * 4000 + "Licensed under CC BY-NC 4.0.", "both: " + mit + " and " + gpl, "nothing here")
    assert [r.labels for r in got] == [["mit"], ["gpl"], ["cc-by-nc"], ["gpl", "mit"], []]
    assert [r.base_labels for r in got] == [[], ["gpl"], [], ["gpl"], []]
    assert [(p.at, p.share) for p in got[2].placements] == [(4000, 1.0)] and got[0].placements[0].at == 5
    assert [r.score for r in got] == [1.0, 1.0, 1.0, 1.0, 0.0]


def test_key_phrases_are_mandatory(spark):
    got = scan(spark, "redistribution and use in source and binary shapes with or without modification are permitted provided that the following conditions are met", "MIT license", "mit licensed", "mit. LICENSE, apache license")
    assert [(r.labels, r.score) for r in got] == [([], 0.0), (["mit"], 0.5), ([], 0.0), (["apache", "mit"], 0.5)]
    assert [(p.at, p.label) for p in got[3].places] == [(0, "mit"), (2, "apache")]


def test_case_is_that_of_ascii(spark):
    assert [r.places for r in scan(spark, "MİT license", "general public Key license", "mit lİcense")] == [[]] * 3


def test_templates_are_a_parameter_with_a_bound(spark):
    own = spark.createDataFrame([("house", "All of this stays within these four walls", ["four walls"])], "label string, notice string, phrases array<string>")
    docs = spark.createDataFrame([(1, "now all of this stays within these four walls, please"), (2, "four walls")], "doc_id long, text string")
    assert [(r.labels, r.score) for r in license_scan(docs, own).orderBy("doc_id").collect()] == [(["house"], 1.0), ([], 0.0)]
    large = own.withColumn("notice", __import__("pyspark.sql.functions", fromlist=["repeat"]).repeat("notice", 300_000))
    with pytest.raises(ValueError):
        license_scan(docs, large)


def test_repeated_rows_agree_and_no_python_runs(spark, sf):
    notice = "Released under the MIT License."
    got = scan(spark, notice, notice, notice + " " + notice)
    assert [[p.at for p in r.placements if p.share == 1.0] for r in got] == [[0], [0], [0, 5]]
    plan = license_scan(default_templates(spark).select("notice", "label").withColumnRenamed("notice", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
    assert sum(r.n_base for r in queries.op12_license_scan(spark, sf).collect()) == sum(len(base_places(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
