import hashlib
import re

from fixtures import TEXTS, awkward, empty, table

from lumenary.llm import queries
from lumenary.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            p = words(t)
            for win in [p[k : k + 10] for k in range(max(1, len(p) - 9))] if p and i is not None else []:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        found.add(i)
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


ITEMS = [(1, "jumps OVER the lazy-dog"), (2, None), (3, ""), (None, "one"), (7, "gamma delta alpha beta gamma delta alpha beta gamma delta alpha beta"), (9, "日本語 text"), (9, "日本語 text"), (11, "delta!")]


def test_awkward_rows_in_one_and_in_many_blocks(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = brute(TEXTS, ITEMS)
    assert got(decontaminate(awkward(spark), bench)) == expected
    assert got(decontaminate(awkward(spark), bench, automaton_bytes=60)) == expected


def test_spans_are_of_the_original_text(spark):
    docs = spark.createDataFrame([(1, "É — The (Lazy)  DOG, ran; THE lazy dog.")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "the lazy dog")], "item_id long, text string")
    r = decontaminate(docs, bench).first()
    assert [r.text[s.start : s.end] for s in r.hit_spans] == ["The (Lazy)  DOG", "THE lazy dog"]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(empty(spark), bench).count() == 0
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontaminate(awkward(spark), bench).collect())


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(sf, "documents")][:60]
    items = [(r["item_id"], r["text"]) for r in table(sf, "benchmark")]
    expected = {d: (n, h, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)}
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op2_decontaminate(spark, sf).collect()}
    assert len(rows) == 200 and {d: rows[d] for d in expected} == expected


def test_an_item_of_more_words_than_there_are_characters(spark):
    words = [f"w{k}" for k in range(1_200_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "one short item")], "item_id long, text string")
    texts = [" ".join(words[k : k + 12]) + " and more" for k in (0, 4090, 600_000, 1_199_988)] + ["w1 w2 w3 w5 w6 w7 w8 w9 w10 w11 w12", "one short item here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(docs, bench).collect()}
    assert got == {**{k: (12, [1]) for k in range(4)}, 4: (0, []), 5: (3, [2])}
