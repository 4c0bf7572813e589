import hashlib
import math

import pytest
from conftest_twin import same, twin
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import chat_format as C

SF = "/root/testdata/sf0.001"
T = C.Template()
TURNS = "conv_id long, turn long, role string, text string"
AWKWARD = ["", "\\", "\\\\", "### ", "#### :\n", "\n</turn>\n", "</turn>", "\\</turn>", "<image 1>", "<image ", "a:\n", T.open * 3, "\\### Assistant: </turn> ok", "\U0001f600\\", "\n", "<\\/turn>"]


def part(kind, text=None, ref=None, **more):
    return {"kind": kind, "text": text, "ref": ref, "width": None, "height": None, "seconds": None, "pages": None, **more}


@settings(deadline=None)
@given(st.lists(st.tuples(st.one_of(st.text(max_size=9), st.sampled_from(AWKWARD)), st.lists(st.one_of(st.text(), st.sampled_from(AWKWARD), st.lists(st.sampled_from(AWKWARD)).map("".join)), max_size=4)), max_size=4))
def test_any_turns_come_back(turns):
    whole, number = "", 0
    for role, texts in turns:
        parts = [p for t in texts for p in (part("text", t), part("image", ref="r"))]
        v = C.segment(T, role, parts, number)
        number = v.number
        assert v.size == len("".join(v.pieces))
        whole += "".join(v.pieces)
    got = [(role, [t for k, t in parts if k == "text"], [k for k, _ in parts if k != "text"]) for role, parts in C.parse(T, whole)]
    assert got == [(role, [t for t in texts if t], ["image"] * len(texts)) for role, texts in turns]


@settings(deadline=None)
@given(st.text(alphabet="ab\\", max_size=12), st.text(alphabet="ab\\", max_size=12))
def test_controls_that_overlap_themselves(role, text):
    t = C.Template(open="aa", named="b\n", close="\naba")
    v = C.segment(t, role, [part("text", text)], 0)
    assert list(C.parse(t, "".join(v.pieces))) == [(role, [("text", text)] if text else [])]


def test_parse_refuses_what_is_no_turn():
    for bad in ("x", "### user", "### user:\nhello", "### user:\nhello\n\\</turn>\n"):
        with pytest.raises(ValueError):
            list(C.parse(T, bad))


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [part("text", "look: "), part("image", ref="s3/a.png", width=57, height=28), part("text", " and "), part("audio", ref="b.wav", seconds=1.01)]),
        (1, 1, "assistant", [part("text", "<image 1> is "), part("document", ref="c.pdf", pages=3), part("text", "it")]),
        (1, 2, "user", None),
        (1, 3, "assistant", [None, part(None, "plain"), part("video", ref="d"), part("image"), part("audio", seconds=math.inf)]),
        (2, 0, "user", [part("image", ref="e", width=0, height=1)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {C.PARTS}")
    got = {(r.conv_id, r.seq): r for r in C.format_conversations(turns).collect()}
    a, b, d = got[1, 0], got[1, 1], got[1, 3]
    assert a.segment == "### user:\nlook: <image 1> and <audio 2>\n</turn>\n" and a.loss == []
    assert [(x.number, x.kind, x.ref, x.tokens) for x in a.attachments] == [(1, "image", "s3/a.png", 3), (2, "audio", "b.wav", 26)] and a.expanded_tokens == 29
    assert all(a.segment[x.at :].startswith(f"<{x.kind} {x.number}>") for x in a.attachments)
    assert b.segment == "### assistant:\n\\<image 1> is <document 3>it\n</turn>\n"
    assert [b.segment[s.start : s.end] for s in b.loss] == ["\\<image 1> is ", "it"] and b.expanded_tokens == 3 * 512
    assert got[1, 2].segment == "### user:\n\n</turn>\n"
    assert [(x.number, x.kind, x.tokens) for x in d.attachments] == [(4, "attachment", 1), (5, "image", 1), (6, "audio", 1)]
    assert [x.number for x in got[2, 0].attachments] == [1]
    back = {r.conv_id: r for r in C.read_back(C.format_conversations(turns)).collect()}
    loss = "<image 1> is itplain"
    assert (back[1].n_turns, back[1].loss_chars, back[1].loss_sha256) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert back[2].loss_sha256 == hashlib.sha256(b"").hexdigest()


def query(turns):
    return C.read_back(C.format_conversations(turns.select("conv_id", "turn", "role", C.text_part(F.col("text")).alias("parts"))))


def test_query_against_twin(spark):
    got = same(C.op13_chat_format(spark, SF), twin(C.OP13_SQL, SF))
    planted = next(r for r in got if r["conv_id"] == -7)
    assert (planted["n_turns"], planted["loss_chars"], planted["loss_sha256"]) == (2, len(C.PLANTED), hashlib.sha256(C.PLANTED.encode()).hexdigest())


def test_odd_turns_against_twin(spark):
    rows = [(None, 0, "user", "no id"), (None, None, None, None), (1, 5, "assistant", "b"), (1, 5, "assistant", "a"), (1, 5, "assistant", "a"), (1, 5, "user", "a"), (1, None, "assistant", None)]
    rows += [(2, i, ("user", "assistant", "a:b\n### ")[i % 3], x) for i, x in enumerate(AWKWARD)]
    rows += [(3, i, "assistant", f"turn {i} ") for i in range(5000)] + [(4, 0, "assistant", "</turn>\\ " * 60_000), (5, 0, "assistant", "x" * 300_000)]
    turns = spark.createDataFrame(rows, TURNS)
    own = turns.withColumns({c: F.lit("own") for c in ("seq", "segment", "loss", "kind", "ref")})
    want = twin(C.OP13_SQL, SF, {"conversations": turns})
    assert same(query(C.with_planted(spark, own)), want)


def test_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert query(none).collect() == []
    assert [r.conv_id for r in query(C.with_planted(spark, none)).collect()] == [-7]
