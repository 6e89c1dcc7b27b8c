import math
import zlib

import numpy as np
from fixtures import awkward, empty

from lumenary.llm.queries import QUERIES
from lumenary.llm.toxicity import _EDGE, EDIT_LETTERS, QUOTED, Features, Lexicon, choose_terms, fit, folded, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = ["idiot", "moron", "trash", "scum", "pathetic"]
    words = ["idiot", "idot", "idiott", "idyot", "iidiot", "diot", "idoit", "moron", "maron", "morons", "scum", "scam", "trsh", "thrash", "trashes", "pathetc", "pathetics", "", "x", "idi", "mmoron"]
    lexicon = Lexicon([(t, False) for t in terms])
    for w in words:
        near = {t: distance(w, t) for t in terms}
        expected = 1.0 if 0 in near.values() else 0.8 if any(d == 1 and len(t) >= 5 for t, d in near.items()) else 0.0
        assert lexicon.match(w) == expected, w


def test_stems_match_any_ending():
    lexicon = Lexicon([("vequ", True)])
    assert [lexicon.match(w) for w in ("vequ", "vequeur", "avequ", "veq")] == [1.0, 1.0, 0.0, 0.0]


def test_context_tells_quotation_from_abuse():
    f = Features([("idiot", False)])
    abuse, quoted, reported, leet = (f.of(t)[3] for t in ("you are an idiot", 'the sign read "idiot" in red', "someone called him idiot once", "such an 1d10t here"))
    assert abuse > quoted and abuse > reported and leet > 0 and f.of("nothing here") == [0.0] * 4


def test_company_of_a_term_is_not_learned():
    found = [[0, 1] for _ in range(10)] + [[0] for _ in range(30)]
    assert choose_terms(["idiot ", "friend "], found) == [("idiot", False)]


def labelled(spark, n=600):
    docs, labels = [], []
    for k in range(n):
        toxic = k % 10 == 0
        docs.append((k, f"plain words number {k} and {'some idiot or trash' if toxic else 'some friend or table'} with more text{k % 7}", "x"))
        if k % 3 or toxic:
            labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    for r in toxicity(docs, labels).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) == (r.doc_id % 10 == 0)


def test_awkward_rows_and_tables_without_labels(spark):
    docs, labels = labelled(spark)
    rows = toxicity(awkward(spark), spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id long, toxic int")).collect()
    assert len(rows) == awkward(spark).count() and len({r.score for r in rows}) == 1
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert toxicity(empty(spark), labels).count() == 0


def by_table(word, terms, letters):
    """1 for a term or the beginning of one that is a stem, 0.8 for a term of enough letters at one edit, by the table of distances."""
    if any(word.startswith(t) if stem else word == t for t, stem in terms):
        return 1.0
    return 0.8 if any(not stem and len(t) >= letters and abs(len(t) - len(word)) <= 1 and distance(t, word) == 1 for t, stem in terms) else 0.0


def brute_features(text, terms, known):
    """The features word by word, without automaton, trie or memory of states."""
    words, hits, near, weight = (text or "").lower().split(), 0, 0, 0.0
    for i, w in enumerate(words):
        if w not in known:
            bare = w.strip(_EDGE)
            known[w] = bare and (by_table(bare, terms, EDIT_LETTERS) or (by_table(folded(bare), terms, EDIT_LETTERS) if folded(bare) != bare else 0.0)) or 0.0
        if value := known[w]:
            weight += value * (QUOTED if Features._quoted(words, i) else 1.0)
            hits, near = hits + (value == 1.0), near + (value < 1.0)
    return [1.0, math.log1p(hits), math.log1p(near), math.log1p(weight)] if hits or near else [0.0] * 4


def test_query_against_brute_force_and_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, got = fit(docs, labels), {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    assert model.terms and len(got) == docs.count()
    known, toxic = {}, {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    rows = {r.doc_id: (r.text, brute_features(r.text, model.terms, known)) for r in docs.select("doc_id", "text").collect()}
    for doc_id, (_, x) in rows.items():
        expected = 1 / (1 + math.exp(-float(np.dot(model.weights, [1.0, *x]))))
        r = got[doc_id]
        assert abs(r.score - expected) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
    # At the weights, the slope of the penalised likelihood over the distinct training texts is nil.
    seen = {}
    for doc_id, label in toxic.items():
        if not got[doc_id].held_out and rows[doc_id][0] is not None:
            seen[rows[doc_id][0]] = (max(label, seen.get(rows[doc_id][0], (0,))[0]), rows[doc_id][1])
    x, y = np.array([[1.0, *f] for _, f in seen.values()]), np.array([t for t, _ in seen.values()], float)
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ model.weights))) - np.array([1e-6, 1, 1, 1, 1]) * model.weights
    assert np.abs(slope).max() < 1e-6
    held = [(got[d].predicted, t) for d, t in toxic.items() if got[d].held_out]
    # So few toxic rows carry few terms (README has the figures): better than the label that most rows have, and no clean row is marked.
    assert sum(p == t for p, t in held) > sum(t == 0 for _, t in held) and not any(p for p, t in held if t == 0)


def test_clashing_columns_and_long_texts(spark):
    docs, labels = labelled(spark)
    long = docs.where("doc_id = 1").selectExpr("cast(9999 as long) as doc_id", "repeat('plain words ', 200000) || 'some idiot or trash' as text", "score")
    extra = docs.unionByName(long).selectExpr("*", "1 as held_out", "'x' as predicted", "array(1) as features", "0 as toxic", "'y' as found")
    want = {r.doc_id: (r.score, r.predicted) for r in toxicity(docs, labels).collect()}
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity(extra, labels).collect()}
    assert got.pop(9999)[0] > min(s for s, _ in want.values()) and got == want
