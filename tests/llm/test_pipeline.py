import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken
from fixtures import table
from test_decontaminate import brute as leaks
from test_jaccard import brute as near
from test_quality import brute as counts
from test_secret_scan import brute as secrets

from lumenary.llm.bpe import read_ranks
from lumenary.llm.quality import Ratios, in_band


def test_stages_against_brute_force(spark, sf):
    docs = [r for r in table(sf, "documents")]
    ratios = Ratios()
    docs = [r for r in docs if not counts(r["text"])[5] and in_band(len(b := r["text"].encode()), *ratios.outside(b))]
    first = {min(docs[k]["doc_id"] for k in group) for group in near([r["text"] for r in docs])}
    docs = [r for r in docs if r["doc_id"] in first]
    items = [(r["item_id"], r["text"]) for r in table(sf, "benchmark")]
    assert {t: c for t, c in corpus_pipeline.STAGES}.keys() and len(corpus_pipeline.STAGES) == 5
    clean = {d for d, _, hit, _ in leaks([(r["doc_id"], r["text"]) for r in docs], items) if not hit}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert rows.keys() == clean
    for r in docs:
        assert (r["doc_id"] in rows) == (r["doc_id"] in clean)
        if r["doc_id"] in clean:
            text, at, out = r["text"], 0, ""
            for _, a, b in secrets(text):
                if a >= at:
                    out, at = f"{out}{text[at:a]}[SECRET]", b
                at = max(at, b)
            ids = np.array(encoding.encode_ordinary(out + text[at:]), "<u4").tobytes()
            got = rows[r["doc_id"]]
            assert got.ids == ids and got.ids_sha256 == hashlib.sha256(ids).hexdigest() and got.n_chars == len(out + text[at:])


def test_repeated_rows_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.unionByName(docs)
    kept = corpus_pipeline.drop_near_duplicates(spark, twice, sf)
    assert kept.columns == docs.columns and kept.count() == corpus_pipeline.drop_near_duplicates(spark, docs, sf).count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
