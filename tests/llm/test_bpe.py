import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from fixtures import awkward, empty, table

from lumenary.llm import queries
from lumenary.llm.bpe import Coder, decode, encode_decode, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_awkward_rows(spark):
    coded = encode_decode(awkward(spark), PATH, P.PATTERN)
    for r in decode(coded.withColumnRenamed("decoded", "first"), PATH, P.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ENCODING.encode_ordinary(r.text or "")
        assert r.first == r.decoded == (r.text or "").encode()


def test_white_space_of_every_kind():
    texts = ["a  b", " \n a", "a \n\n  b\t\tc ", " a  b 　", "\x1c\x1d a\x85b ​ c", "  ", "\n", " 'tis it's’s", "á ½ ²x", "x\r\n y"]
    for (ids, back), t in zip(Coder(RANKS, P.PATTERN).code(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ENCODING.encode_ordinary(t) and back == t.encode()


def test_heap_and_recursive_query_agree():
    coder = Coder(RANKS, P.PATTERN)
    words = [w.encode() for w in ("aaaaaaaaaaaaa", " thethethethe", "ÄäÄäÄä", "0101010101", "x" * 60)]
    flat, size = coder._query(words)
    assert [coder._heap(w) for w in words] == [ids.tolist() for ids in np.split(flat, np.cumsum(size)[:-1])]


def test_empty_table(spark):
    assert encode_decode(empty(spark), PATH, P.PATTERN).count() == 0


def test_query_against_tiktoken(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(sf, "documents")}
    for r in queries.op9_byte_bpe(spark, sf).collect():
        ids = ENCODING.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
