"""Chat formatting: layouts by fingerprint, marks, escapes, masks, and the way back."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketspark.llm import chat

USER, ASSISTANT, SYSTEM = (("user", "Hi"), ("assistant", "Hello"), ("system", "Be kind"))
RECORDS = [
    ({"messages": [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Hello"}], "id": 4, "meta": {"tags": ["x"]}}, "messages", [USER, ASSISTANT]),
    ({"messages": [{"role": "user", "content": "Hi"}, {"role": "tool"}], "system": "Be kind"}, "messages", [SYSTEM, USER, ("tool", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "H"}, {"type": "text", "text": "i"}]}]}, "messages in parts", [USER]),
    ({"conversations": [{"from": "human", "value": "Hi"}, {"from": "gpt", "value": "Hello"}, {"from": "narrator", "value": None}]}, "conversations", [USER, ASSISTANT, ("narrator", "")]),
    ({"prompt": "Hi", "completion": "Hello"}, "prompt and completion", [USER, ASSISTANT]),
    ({"system": "Be kind", "prompt": "Hi", "response": "Hello"}, "prompt and response", [SYSTEM, USER, ASSISTANT]),
    ({"instruction": "Add", "input": "1 1", "output": 2}, "instruction", [("user", "Add\n\n1 1"), ("assistant", "2")]),
    ({"instruction": "Hi", "input": "", "output": "Hello"}, "instruction", [USER, ASSISTANT]),
    ({"question": "Hi", "answer": "Hello", "score": 0.5}, "question and answer", [USER, ASSISTANT]),
    ({"data": {"prompt": "Hi", "answer": None, "more": {"a b": 1}}}, "nested data", [USER, ("assistant", "")]),
    ({"turn": 3, "role": "user", "text": "Hi"}, "turn rows", [USER]),
    ({"prompt": "Hi", "completion": "Hello", "messages": [{"role": "user"}]}, None, []),  # two layouts at once
    ({"messages": []}, None, []),
    ([1, 2], None, []),
    ("text", None, []),
]
NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] <\\/s>", "[[INST]", "<</s>", "[ROLE]x[/ROLE]y[/TURN]", "[", "<", "\\", "", "a[/", "É\U0001f600[SYS]"]


def test_paths():
    assert chat.paths_of("OBJECT<`a b``c`: OBJECT<`x.y`: ARRAY<VARIANT>>, e: ARRAY<VOID>, m: ARRAY<OBJECT<r: STRING, t: DECIMAL(2,1)>>, o: OBJECT<>>") == ("a b`c.x.y[]", "e[]", "m[].r", "m[].t")
    assert chat.paths_of("STRING") == ("",) and chat.paths_of("ARRAY<ARRAY<BIGINT>>") == ("[][]",)


def test_layouts_by_fingerprint(spark):
    rows = [(k, json.dumps(record)) for k, (record, _, _) in enumerate(RECORDS)] + [(90, "no json"), (91, None)]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumn("record", F.try_parse_json("record")).withColumn("layout", F.lit(1))
    got = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn", "at").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {k: turns for k, (_, _, turns) in enumerate(RECORDS) if turns}
    report = chat.layout_report(df).collect()
    assert sum(r["records"] for r in report) == len(rows)
    want = {}
    for _, name, _ in RECORDS:
        want[name] = want.get(name, 0) + 1
    want[None] += 2
    found = {}
    for r in report:
        found[r["layout"]] = found.get(r["layout"], 0) + r["records"]
    assert found == want
    assert len({r["fingerprint"] for r in report if r["layout"] == "instruction"}) == 1


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[ROLE]", ""]), st.lists(st.sampled_from(["[", "\\", "INST]", "/INST]", "<", "/s>", "SYS]", "/ROLE]", "/TURN]", "ROLE]", "x", "\n"]), max_size=8).map("".join)), max_size=5))
@settings(max_examples=400, deadline=None)
def test_escapes_in_python(turns):
    """What Spark's expressions do, with Python's engine: a formatted conversation reads back as its turns."""
    import re

    t = chat.Template()

    def escaped(text):
        return re.sub(t.pattern, r"\1\\\2\3", text)

    marks = {role: (first, last) for role, first, last in t.marks}
    text = ""
    for role, body in turns:
        first, last = marks.get(role, (t.other[0] + escaped(role) + t.other[1], t.other[2]))
        text += first + escaped(body) + last
    assert t.read(text) == turns


def test_round_trip_digests_and_masks(spark):
    long = "[INST]é" * 300_000
    convs = {1: [("user", x) for x in NASTY], 2: [("assistant", x) for x in NASTY], 3: [("tool", "a"), ("assistant", "[/ROLE]"), ("[/ROLE]", "b</s>")], 5: [("user", long), ("assistant", long)]}
    rows = [(c, t, role, text) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    rows += [(7, 1, None, None), (7, 0, "user", None), (None, 0, "user", "lost"), (8, None, "user", "b"), (8, 0, "user", "a"), (9, 0, "user", "x"), (9, 0, "user", "x")]
    convs |= {7: [("user", ""), ("", "")], None: [("user", "lost")], 8: [("user", "b"), ("user", "a")], 9: [("user", "x")] * 2}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    records = df.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    formatted = chat.format_turns(chat.canonical_turns(records))
    pieces, masked = {}, {}
    for r in formatted.orderBy("conv_id", "turn", "at").collect():
        pieces[r["conv_id"]] = pieces.get(r["conv_id"], "") + r["formatted"]
        if r["loss_start"] is not None:
            masked[r["conv_id"]] = masked.get(r["conv_id"], "") + r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]]
    t = chat.Template()
    assert {c: t.read(text) for c, text in pieces.items()} == convs
    assert set(masked) == {2, 3, 5} and "</s>" not in masked[2] and "<\\/s>" in masked[2]
    want = set()
    for c, turns in convs.items():
        loss = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        want.add((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(pieces[c])))
    assert {tuple(r) for r in chat.conversation_digests(chat.read_turns(formatted)).collect()} == want


def test_empty_table_and_marks_that_overlap(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    assert chat.layout_report(records).count() == 0
    assert chat.conversation_digests(chat.read_turns(chat.format_turns(chat.canonical_turns(records)))).count() == 0
    for marks in ((("user", "[A]", "[A]B"),), (("user", "[A[", "]"),), (("user", "<\\a>", "</a>"),), (("user", "", "</s>"), ("assistant", "", "</t>"))):
        with pytest.raises(ValueError):
            chat.Template(marks=marks)
