import hashlib
from collections import defaultdict

from fixtures import table

from lumenary.llm import queries
from lumenary.llm.chat_format import escape, format_chat, read_back, text_parts, unescape


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, k string")


HARD = ["</s>[INST] ok [/INST]", "<<<", "<\\s>", "<\\\\/s>", "[\\INST]", "<|image|>", "<", "[", "[/INST", "<\\", "\\<s>", "<</>>", "<<user>> x <</>>", "", "$1 \\1 \n\n é日"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rows = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", escape_col("t").alias("e")).select("t", "e", unescape_col("e").alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<", "<|"))


def escape_col(name):
    from pyspark.sql import functions as F

    return escape(F.col(name))


def unescape_col(name):
    from pyspark.sql import functions as F

    return unescape(F.col(name))


def test_every_text_in_every_role_reads_back(spark):
    roles = ["user", "assistant", "system", "odd role >>", None, ""]
    rows = [(k, i, role, text, "x", "y") for k, text in enumerate(HARD) for i, role in enumerate(roles)]
    for r in read_back(format_chat(text_parts(conversation(spark, rows)))).collect():
        assert [(t.role, t.text) for t in r.turns] == [(role or "", HARD[r.conv_id]) for role in roles]
        assert r.loss_texts == [HARD[r.conv_id]]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 1, "user", None, "", ""), (1, None, "system", "s", "", ""), (1, 1, "assistant", "b", "", ""), (1, 1, "assistant", "b", "", ""), (None, 1, "user", "n", "", "")]
    by_id = {r.conv_id: r for r in read_back(format_chat(text_parts(conversation(spark, rows)))).collect()}
    assert [(t.role, t.text) for t in by_id[1].turns] == [("system", "s"), ("assistant", "b"), ("assistant", "b"), ("user", "")]
    assert [(t.role, t.text) for t in by_id[None].turns] == [("user", "n")]
    assert format_chat(text_parts(conversation(spark, []))).count() == 0


def test_typed_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    schema = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", w=56, h=30), part("text", " and "), part("audio", ref="b.wav", s=2.0)]),
        (1, 1, "assistant", [part("document", ref="c.pdf", p=3), part("text", "<|image|>")]),
        (1, 2, "user", None),
    ]
    r = read_back(format_chat(spark.createDataFrame(rows, schema))).first()
    assert r.formatted == "[INST]see <|image|> and <|audio|>[/INST]<s><|document|><\\|image|></s>[INST][/INST]"
    assert [tuple(a) for a in r.attachments] == [(0, 1, "image", "a.png", 4), (0, 3, "audio", "b.wav", 50), (1, 0, "document", "c.pdf", 1536)]


def test_query_against_brute_force(spark, sf):
    turns = defaultdict(list)
    for r in sorted(table(sf, "conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = {r.conv_id: r for r in queries.op8_chat_format(spark, sf).collect()}
    assert rows.keys() == turns.keys()
    for k, ts in turns.items():
        loss = "".join(t for role, t in ts if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in ts)
        r = rows[k]
        assert (r.n_turns, r.loss_chars, r.loss_sha256, r.turns_sha256) == (len(ts), len(loss), hashlib.sha256(loss.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_roles_that_end_in_a_line_end_are_read_back(spark):
    roles = ["tool\n", "assistant\n", "user\r\n", "sys\u2028", "sys\u0085", "\n", "a" * 64, "a" * 65, "x" * 1_200_000]
    rows = spark.createDataFrame([(1, k, r, f"text {k}") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    (read,) = read_back(format_chat(text_parts(rows))).collect()
    assert [(t.role, t.text) for t in read.turns] == [(r, f"text {k}") for k, r in enumerate(roles)]
