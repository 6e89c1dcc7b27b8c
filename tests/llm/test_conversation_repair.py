import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from lumenary.llm import queries
from lumenary.llm.conversation_repair import damage_turns, repair_conversations, repaired_digests, repaired_rows

SCHEMA = "conv_id long, turn long, role string, text string, codes string, block string, state string"


def damaged(rows):
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        role, text = name(role), name(text)
        k = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        yield from [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def brute(rows):
    """Counts, cost, audit and repaired lines of one conversation: the least (cost, edits) of what is left, from every place on."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:100].encode(), hashlib.md5(r[3].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, left, grown=0):
        """``left`` is what the initials so far read, cut to their last one or two."""
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[left]
        found = [(0, "", ())] if i == len(rows) and left in ("", "a") else []
        new = {"u": "user", "a": "assistant"}
        for x in after:
            if x in new and grown < 3:
                c, e, t = best(i, x, grown + 1)
                found.append((c + 2, "I" + e, (new[x] + ":",) + t))
        if i < len(rows):
            role, text, kind = rows[i][2], rows[i][3], kinds[i]
            c, e, t = best(i + 1, left)
            found.append((c + 3, "D" + e, t))
            if kind in ("", "truncated"):
                more = kind == "truncated"
                for x in after:
                    if role[:1] == x:
                        c, e, t = best(i + 1, x)
                        found.append((c + more, "K" + e, (f"{role}:{text}",) + t))
                    if x in new:
                        c, e, t = best(i + 1, x)
                        found.append((c + 2 + more, "R" + e, (f"{new[x]}:{text}",) + t))
        return min(found, default=(1 << 40, "", ()))

    for i in range(len(rows), -1, -1):  # fills the cache from the end, so that recursion stays shallow
        for left in ("", "s", "u", "a"):
            best(i, left)
    cost, audit, lines = best(0, "")
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in damaged(rows):
        by[r[0]].append(r)
    return {c: brute(rs) for c, rs in by.items()}


def found(spark, rows):
    repair = repair_conversations(damage_turns(spark.createDataFrame([(*r, "c", "b", "s") for r in rows], SCHEMA)))
    digests = {r.conv_id: r.repaired_sha256 for r in repaired_digests(repair.placed, repair.edits).collect()}
    return repair, {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv_id]) for r in repair.summary.collect()}


def some_rows(seed, n, conversations):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "sys"], ["Yes.", "No", "Why?", " \n", "", None, "Yes. \t\n", "Nö!", "…"]
    weights = [8, 8, 2, 1, 1, 1, 1, 1]
    return [(rng.choice(conversations), rng.choice([None, *range(n // 2)]), rng.choices(roles, weights)[0], rng.choice([*texts, f"text {rng.random()}."])) for _ in range(n)]


def test_awkward_conversations(spark):
    rows = some_rows(1, 400, [None, *range(60)])
    _, got = found(spark, rows)
    want = expected(rows)
    assert got == {c: v for c, v in want.items() if c in got} and all(want[c][6] == "" for c in want.keys() - got.keys())


@pytest.fixture
def many_blocks(spark):
    names = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_conversation_over_many_blocks(spark, many_blocks):
    rows = some_rows(2, 700, [7, 7, 7, 8, None])
    repair, got = found(spark, rows)
    assert got == expected(rows)
    assert repair.edits.where("conv_id = 7").count() > 5
    lines = {}
    for r in repaired_rows(repair.placed, repair.edits).orderBy("block", "pos", "k").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: v[7] for c, v in got.items()}


def test_one_row_a_thousand_times_and_long_texts(spark, many_blocks):
    rows = [(5, None, "user", "Same.")] * 1000 + [(5, 9, "assistant", "long " * 100_000 + ".")] + [(6, 0, "user", "long " * 100_000)]
    _, got = found(spark, rows)
    assert got == expected(rows)


def test_empty_table(spark):
    repair, got = found(spark, [])
    assert got == {} and repaired_rows(repair.placed, repair.edits).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.op13_conversation_repair(spark, sf).collect()}
    assert got == expected(rows)
