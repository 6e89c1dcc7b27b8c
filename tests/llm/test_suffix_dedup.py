import hashlib
import random

import numpy as np
import pyarrow as pa
from fixtures import TEXTS, awkward, empty, table

from lumenary.llm import queries
from lumenary.llm import suffix_dedup
from lumenary.llm.suffix_dedup import WINDOW, Splitters, as_text, gram_hashes, least_hashes, remove_repeats, sorted_rows, squeezed, unsqueezed


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - WINDOW + 1):
                s = b[i : i + WINDOW]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - WINDOW + 1) if d is not None else ():
            if first[b[i : i + WINDOW]] < d:
                gone[i] += 1
                gone[i + WINDOW] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def shared_passages(seed, n=60):
    """Texts that share passages of all lengths about the limit, at their ends and next to each other."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    passages = [("".join(word() for _ in range(200)))[: rnd.randint(30, 400)] for _ in range(12)]
    fill = lambda: "".join(word() for _ in range(rnd.randint(0, 60)))
    rows = [(k, "".join(rnd.choice([rnd.choice(passages), fill(), fill()[:5]]) for _ in range(rnd.randint(0, 8)))) for k in range(n)]
    base = "".join(word() for _ in range(2000))
    for k in range(n, n + 12):  # near copies of a long text
        at = rnd.randrange(len(base))
        rows.append((k, base[:at] + "#" * rnd.randint(0, 3) + base[at + rnd.randint(0, 3) :]))
    return rows


def test_passages_of_all_lengths_in_one_and_many_blocks_and_parts(spark, monkeypatch):
    for seed in (1, 2):
        rows = shared_passages(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        expected = brute(rows)
        assert got(remove_repeats(docs)) == expected
        monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 5_000)
        assert got(remove_repeats(docs, block_bytes=20_000, part_keys=2_000)) == expected
        assert got(remove_repeats(docs, block_bytes=20_000, part_keys=2_000, ranges=3)) == expected
        monkeypatch.undo()


def test_all_removed_bytes_come_from_equal_texts_or_shared_names(spark, monkeypatch):
    """Without the rounds over names only whole later copies are removed."""
    rows = shared_passages(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    use = suffix_dedup._use
    monkeypatch.setattr(suffix_dedup, "_use", lambda depth, splitters: use(depth, splitters) if depth < 2 else lambda table, reply: suffix_dedup._NO_MARKS)
    first = {}
    for d, t in rows:
        first.setdefault(t, d)
    for r in remove_repeats(docs).collect():
        copy = len(rows[r.doc_id][1].encode()) >= WINDOW and first[rows[r.doc_id][1]] < r.doc_id
        assert r.n_removed == (r.n_bytes if copy else 0)


def test_long_texts_are_read_in_pieces_that_have_every_string(monkeypatch):
    dice = random.Random(7)
    rows = [(k, k, "".join(dice.choice("abc ") for _ in range(dice.choice([0, 49, 50, 700, 749, 750, 3000])))) for k in range(30)]
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 3000)
    table = pa.table({"doc_id": [d for d, *_ in rows], "h": [h for _, h, _ in rows], "text": [t for *_, t in rows]})
    seen = []
    for s in suffix_dedup._slices(table, set()):
        for a, b in zip(s.begins.tolist(), s.ends.tolist(), strict=True):
            of = s.texts.of[a]
            seen += [(int(s.texts.doc[of]), x - int(s.texts.base[of]) + int(s.texts.start[of]), s.texts.text[x : x + WINDOW].decode()) for x in range(a, b)]
    assert sorted(seen) == [(d, i, t[i : i + WINDOW]) for d, _, t in rows for i in range(len(t) - WINDOW + 1)]


def test_messages_stay_few_where_there_is_much_for_many_blocks_and_parts(spark, monkeypatch):
    """Blocks and parts get larger in time, so that messages do not grow with the square of the input."""
    rows = shared_passages(4, 400)
    durable, replies = suffix_dedup.durable, []

    def counted(df):
        out = durable(df)
        if out.columns == ["unit", "part", "reply"]:
            replies.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "durable", counted)
    size = sum(len(t.encode()) for _, t in rows)
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=size // 200, part_keys=size // 2400)) == brute(rows)
    assert len(replies) == 4 and max(replies) < 8_000


def test_a_part_is_sorted_in_ranges_and_a_unit_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 50, (3000, 3), dtype=np.uint64)
    monkeypatch.setattr(suffix_dedup, "PART_KEYS", 400)
    ranges = list(suffix_dedup._ranges(keys))
    assert len(ranges) > 3 and sorted(np.concatenate(ranges).tolist()) == list(range(len(keys)))
    assert all(keys[a, 0].max() < keys[b, 0].min() for a, b in zip(ranges, ranges[1:]))

    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 300)
    stop = rng.integers(1, 90, 40)
    text = bytes(rng.integers(97, 100, int(stop.sum()) + 40 * (WINDOW - 1)).tolist())
    whole = suffix_dedup.Regions(7, range(40), range(40), np.zeros(40), stop, text)
    for depth, covers in ((1, suffix_dedup.FIRST), (2, suffix_dedup.SECOND)):
        whole.names = whole.sampled(covers) * 10
        spread, at = whole.spread(whole.sampled(covers), whole.names), 0
        for piece in whole.pieces(depth):
            assert piece.text == text[at : at + len(piece.text)]
            assert (piece.spread(piece.sampled(covers), piece.names) == spread[at : at + len(piece.text)]).all()
            at += len(piece.text)
        assert at == len(text) and len(list(whole.pieces(depth))) > 5


def test_many_copies_of_one_text(spark):
    base = "the same passage of a text that many documents have, over and over again; "
    rows = [(k, base * 3) for k in range(40)] + [(k, f"{k} {base} {k * k}") for k in range(40, 80)] + [(7, base * 3), (None, base * 3)]
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_sorted_rows_and_packing():
    rng = np.random.default_rng(2)
    for width in (1, 3):
        for top in (3, 1 << 20, 1 << 48, (1 << 63) - 1):
            rows = rng.integers(0, top, (500, width), dtype=np.uint64)
            keys, at = sorted_rows(rows)
            assert [tuple(k) for k in keys.tolist()] == sorted(set(map(tuple, rows.tolist()))) and (keys[at] == rows).all()
            assert (unsqueezed(squeezed(keys), np.uint64, width) == keys).all()
            cut = Splitters(as_text(keys[len(keys) // 3 :: len(keys) // 3]), 2)
            parts = list(cut.slices(keys))
            assert sorted(np.concatenate([some for _, some in parts]).tolist()) == list(range(len(keys)))
            assert all(keys[a].max(0)[0] <= keys[b].min(0)[0] for (p, a), (q, b) in zip(parts, parts[1:]) if p // 2 < q // 2)


def test_awkward_rows(spark):
    assert got(remove_repeats(awkward(spark))) == brute(TEXTS)


def test_empty_table_and_constant_bytes(spark):
    assert remove_repeats(empty(spark)).count() == 0
    rows = [(1, "a" * 300), (2, "a" * 49), (3, "a" * 50), (4, "b" * 20 + "a" * 70 + "b" * 20)]
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_filter_parts():
    dice = random.Random(3)
    data = bytes(dice.randrange(256) for _ in range(5000))
    h = gram_hashes(data)
    m = least_hashes(h)
    assert len(m) == len(data) - WINDOW + 1 and all(m[i] == h[i : i + WINDOW - 23].min() for i in range(0, len(m), 97))


def test_query_against_brute_force(spark, sf):
    assert got(queries.op3_suffix_dedup(spark, sf)) == brute([(r["doc_id"], r["text"]) for r in table(sf, "documents")])
