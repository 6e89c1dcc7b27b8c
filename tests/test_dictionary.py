"""A dictionary of any size is loaded from a folder, and plans do not grow with it."""

import pytest
from pyspark.sql import functions as F

from lumenary import dictionary as D
from lumenary.functions.trie import Trie
from lumenary.operators import classify, skills


def large(n):
    """n entries a table: a taxonomy of n nodes, each but the first 39 below one of these."""
    return D.Dictionary(
        skills=[(k, f"Skill {k}", [f"Skill {(k + 1) % n}"]) for k in range(n)],
        aliases=[(f"s{k}", f"Skill {k}") for k in range(n)],
        synonyms=[(f"role {k}", [f"maker of thing number {k} in the very large dictionary of things"]) for k in range(n)],
        roles=[(k, f"role {k}", [f"Skill {k}", f"Skill {(k + 2) % n}"]) for k in range(n)],
        taxonomy=[(k, f"node{k}", f"node{k % 39}" if k >= 39 else None, [f"alias {k} x"], [f"keyword{k}."]) for k in range(n)],
        catalogue=[(k, "src", f"id{k}", f"Label {k}", [f"node{k}"]) for k in range(n)],
        pay_roles=[(k, f"thing number {k} ", f"role {k}") for k in range(n)],
        pay=[(k, f"role {k}", "MID", k, k + 1, k + 2, k, k + 1, k + 2) for k in range(n)],
    )


def test_trie_finds_what_stands_in_a_text():
    words = ["a", "ab", "bc", "abc", "", "cab"]
    for text in ("", "abcab", "xbcx", "ca"):
        assert Trie((w, w) for w in words).find(text) == {w for w in words if w in text}
    phrases = ["x y", "y", "y z x y w v u t s"]
    assert Trie((p.split(), p) for p in phrases).find("x y z x y w v u t s".split()) == set(phrases)


def test_round_trip_through_a_folder(spark, tmp_path):
    D.SUPPLIED.save(spark, str(tmp_path))
    assert D.Dictionary.load(spark, str(tmp_path)).rows == {n: [tuple(r) for r in rows] for n, rows in D.SUPPLIED.rows.items()}


def test_too_many_rows_are_refused(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_ROWS", 5)
    with pytest.raises(ValueError):
        D.Dictionary.of({"aliases": spark.range(6).selectExpr("string(id) alias", "'x' skill")})


def plans(spark, words):
    jobs = spark.createDataFrame([(1, "Maker of thing number 7 in the very large dictionary of things", "src", ["Label 3", "alias 4 x"], ["s5", "keyword6."])], "job_id long, title string, source string, labels array<string>, skills array<string>")
    roles = spark.createDataFrame([("role 7",), ("one role whose phrase has quite a lot of words in it",)], "role string")
    offered = spark.createDataFrame([(1, "Skill 7"), (1, "Skill 9")], "user_id long, skill string")
    named = jobs.select(
        classify.map_categories(F.col("source"), F.col("labels"), F.col("title"), F.col("skills"), words).alias("categories"),
        skills.canonical_all(F.col("skills"), words).alias("names"), skills.title_profile(F.col("title"), words).alias("profile"), classify.benchmark(F.col("title"), F.lit("MID"), words)["local_mid"].alias("mid"),
    )
    return named, skills.role_similarity(jobs, roles, spark, words), skills.profile_coverage(offered, spark, words)


def nodes(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size(), df._jdf.queryExecution().optimizedPlan().treeString().count("\n")


def test_large_and_small_dictionaries_have_the_same_plans(spark):
    small, big = plans(spark, large(10)), plans(spark, large(10_000))
    assert [nodes(a) for a in small] == [nodes(b) for b in big]
    row = big[0].first()
    assert (row.categories, row.names, row.profile, row.mid) == (["node3", "node4", "node6"], ["Skill 5", "keyword6."], "role 7", 8)
    assert [(r.role, r.similarity) for r in big[1].collect()] == [("role 7", 0.75)]
    assert sorted(r.role for r in big[2].where("coverage = 1").collect()) == ["role 6", "role 7", "role 8"]  # its own skills, or related ones


def test_phrases_of_any_length(spark):
    titles = spark.createDataFrame([("Head of One Two Three Four Five Six Seven Eight Nine",)], "title string")
    roles = spark.createDataFrame([("one two three four five six seven eight nine",), ("two four",)], "role string")
    assert [(r.role, r.similarity) for r in skills.role_similarity(titles, roles, spark).collect()] == [("one two three four five six seven eight nine", 1.0)]
    assert skills.role_similarity(titles, roles.limit(0), spark).count() == 0
