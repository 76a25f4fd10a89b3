"""Layouts by fingerprint, and templates whose marks no text can fake."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import chat
from factloom.llm.queries import TRAP, op12_chat_formatting


def records(spark, objects):
    return spark.createDataFrame([(i, o if isinstance(o, str) or o is None else json.dumps(o), "l", "t") for i, o in enumerate(objects)], "id long, record string, layout string, turns string")


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "name": "n"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"content": "x", "role": "tool"}], "id": 7}, "messages", [("tool", "x")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": None}, {"type": "text", "text": "c"}]}]}, "message parts", [("user", "ac")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}, None, {"from": "other", "value": "é"}]}, "from and value", [("user", "q"), ("assistant", ""), ("other", "é")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, "from and value", [("system", "s"), ("user", "q")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"completion": 2.5, "prompt": None, "system": "s"}, "prompt and completion", [("system", "s"), ("user", ""), ("assistant", "2.5")]),
    ({"question": "q", "answer": "a", "id": "z"}, "question and answer", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "input": "more", "output": "o"}, "instruction and output", [("user", "i\n\nmore"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o", "system": "s"}, "instruction and output", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"prompt": "p"}, None, None),
    ({"messages": ["a", "b"]}, None, None),
    ({"messages": [{"role": "user", "content": {"deep": "x"}}]}, None, None),
    ({}, None, None),
    ([], None, None),
    ("not json", None, None),
    ('{"prompt": "a", "prompt": "b", "completion": "c"}', None, None),
    (None, None, None),
]


def test_each_layout_is_told_by_its_paths_and_unknown_ones_stay(spark):
    out = chat.canonical(records(spark, [x[0] for x in LAYOUTS])).collect()
    found = {r.row.id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in out}
    assert found == {i: (name, turns) for i, (_, name, turns) in enumerate(LAYOUTS)}


def test_a_fingerprint_is_of_paths_not_of_values(spark):
    x = [{"a": {"b": [1, 2]}, "c": "x"}, {"c": None, "a": {"b": ["y"]}}, {"a": {"b": [{"c": 1}]}}, {"c": ": STRING, d: STRING", "a": {"b": [True]}}, {"a": {"b": [1]}, "c: STRING": 2}]
    found = [r[0] for r in records(spark, x).orderBy("id").select(chat.fingerprint(F.col("record"))).collect()]
    assert found[0] == found[1] == found[3] and len(set(found)) == 3


def test_two_layouts_never_share_a_fingerprint():
    seen = {}
    for x in chat.LAYOUTS:
        for _, shape in chat._variants(x):
            if "ARRAY<>" in shape:  # an empty list has no turns, whichever layout tells so
                continue
            assert seen.setdefault(shape, x.name) == x.name


TEXTS = [TRAP, "", "<turn>", "</turn>\n", "\\", "\\\\", "<\\turn>", "\\<turn>\\", "<says><says", "a\\n</tur</turn>", "é\n\n😀 <turn>assistant<says>", "<" * 5, "\\/turn>", None, "x" * 300_000]


def by_hand(turns, template):
    out, mask = "", []
    for role, text in turns:
        esc = []
        for x in (role or "", text or ""):
            x = x.replace("\\", "\\\\")
            for m in template.marks():
                x = x.replace(m, m[0] + "\\" + m[1:])
            esc.append(x)
        out += template.begin + esc[0] + template.says
        if (role or "") in template.trained:
            mask.append((len(out), len(esc[1])))
        out += esc[1] + template.end
    return out, mask


@pytest.mark.parametrize("template", [chat.Template(), chat.Template("@user ", "@says\n", "@end", ("assistant", "tool"))])
def test_whatever_texts_say_is_read_back(spark, template):
    rng = random.Random(2)
    conversations = [[(rng.choice(["user", "assistant", "tool", "</turn>", "@says\n", "", None]), rng.choice(TEXTS)) for _ in range(rng.randint(0, 6))] for _ in range(120)]
    conversations += [None, [], [("assistant", "t")] * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(conversations)], f"id long, turns {chat.TURNS}").repartition(3)
    x = df.select("id", "turns", chat.formatted(F.col("turns"), template).alias("out"))
    x = x.select("id", "out", chat.read_back(F.col("out.text"), template).alias("back"), chat.trained_text(F.col("out.text"), F.col("out.mask"), template).alias("loss"))
    for r in x.collect():
        turns = conversations[r.id]
        if turns is None:
            assert (r.out, r.back, r.loss) == (None, None, None)
            continue
        text, mask = by_hand(turns, template)
        assert (r.out.text, [tuple(s) for s in r.out.mask]) == (text, mask)
        assert [tuple(t) for t in r.back] == [(a or "", b or "") for a, b in turns]
        assert r.loss == "".join(b or "" for a, b in turns if a in template.trained)


def test_marks_that_could_be_confused_are_refused():
    for marks in (("<a>", "<a>", "<b>"), ("<a", "<ab", "<c"), ("<a<", "<b", "<c"), ("<\\", "<b", "<c"), ("#a", "<b", "<c")):
        with pytest.raises(ValueError):
            chat.Template(*marks)


def test_text_of_another_template_is_an_error(spark):
    for text in ("plain", "<turn>user</turn>\n", "<turn>a<says>b<says>c</turn>\n", "<says>x</turn>\n"):
        with pytest.raises(Exception, match="turn"):
            spark.createDataFrame([(text,)], "t string").select(chat.read_back(F.col("t"))).collect()


def test_the_query_keeps_ties_nulls_and_repeats(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", TRAP), (3, 1, "assistant", "b"), (3, 0, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "user", "x"), (None, 0, "user", "n"), (4, 5, "user", ""), (5, 0, "tool", "é😀"), (6, 0, "human", "h"), (6, 1, "assistant", None)]
    spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, record string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)]
    found = {r.conv_id: r for r in op12_chat_formatting(spark, str(tmp_path)).collect()}
    assert len(found) == 8
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, r in found.items():
        turns = [(role or "", text or "") for _, role, text in sorted((((-1 if t is None else t), a or "", b or "") for c, t, a, b in rows if c == i))]
        loss = "".join(b for a, b in turns if a == "assistant")
        assert tuple(r)[1:] == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(by_hand(turns, chat.Template())[0]))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in op12_chat_formatting(spark, str(tmp_path)).collect()] == [-7]
    assert chat.digests(records(spark, [])).collect() == []
