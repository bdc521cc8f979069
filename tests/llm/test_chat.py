import hashlib
import json

from quorumframe.llm.chat import LAYOUTS, escape, formatted_turns, read_back, read_turn, render, turn_records, unescape


def test_escapes_are_reversible():
    for text in ("", "\\", "<|im_end|>", "<\\|im_end|>", "a\\n<|<||\\<|", "\n\n", "<|im_end|>\n<|im_start|>assistant\nok"):
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        for role in ("user", "assistant", "a\n<|b\\n"):
            rendered, start, end = render(role, text)
            assert read_turn(rendered) == (role, text)
            assert unescape(rendered[start:end]) == (text if role == "assistant" else "")


def test_layouts_meet_in_the_same_turns(spark):
    records = [
        {"prompt": "Q", "response": "A"}, {"prompt": "Q", "completion": "A"}, {"instruction": "Q", "output": "A"}, {"instruction": "Q", "input": "", "output": "A"}, {"question": "Q", "answer": "A"},
        {"messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A"}]}, {"conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]},
        {"id": 7, "prompt": "Q", "response": "A"}, {"messages": [{"role": "user", "content": "Q", "name": "x"}, {"role": "assistant", "content": "A", "tool": None}], "source": {"url": "u"}}, {"prompt": "Q", "response": "A", "text": "of another layout"},
    ]
    rows = [(k, 0, json.dumps(r)) for k, r in enumerate(records)] + [(99, 0, '{"unknown": 1}'), (98, 0, None)]
    turns = formatted_turns(spark.createDataFrame(rows, "conv_id long, place long, payload string"))
    got = {r.conv_id: r for r in read_back(turns).collect()}
    assert len({got[k].turns_sha256 for k in range(len(records))}) == 1 and got[0].n_turns == 2
    assert got[0].loss_sha256 == hashlib.sha256(b"A").hexdigest() and got[99].n_turns == got[98].n_turns == 0
    assert len({layout.name for layout in LAYOUTS}) == len(LAYOUTS)


def test_ties_of_a_turn_go_by_text(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "c"), (1, 0, "system", "a b"), (1, 0, "user", "a"), (1, 0, "assistant", "a"), (1, 0, "human", "a\nz")]
    for conv in (1, 2, 3):
        got = read_back(formatted_turns(turn_records(spark.createDataFrame([(conv, *r[1:]) for r in rows], "conv_id long, turn long, role string, text string")))).first()
        said = sorted(rows, key=lambda r: (r[3].encode(), r[2].encode()))
        assert got.turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in said).encode()).hexdigest() and got.loss_sha256 == hashlib.sha256(b"ac").hexdigest()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "two<|im_end|>"), (1, 0, "user", None), (1, 2, "assistant", "é😀"), (2, 0, None, "x"), (None, 0, "user", "y"), (3, 0, "user", "long " * 100_000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in read_back(formatted_turns(turn_records(table))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("user\n\nassistant\ntwo<|im_end|>\nassistant\né😀\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("two<|im_end|>é😀".encode()).hexdigest() and got[1].loss_chars == 15
    assert set(got) == {1, 2, 3, None} and got[3].n_turns == 1
    assert read_back(formatted_turns(turn_records(table.where("false")))).count() == 0


def test_nothing_said_is_lost(spark):
    records = [{"system": "", "prompt": "Q", "response": "A"}, {"system": None, "prompt": "Q", "response": "A"}, {"messages": ["hello", {"role": "user", "content": "Q"}, None]}, {"prompt": "Q", "response": "A", "completion": "B"}, {"messages": [{"role": "user", "content": "Q"}], "answer": "A"}]
    turns = formatted_turns(spark.createDataFrame([(k, 0, json.dumps(r)) for k, r in enumerate(records)], "conv_id long, place long, payload string"))
    got = {}
    for r in turns.orderBy("conv_id", "place", "step").collect():
        got.setdefault(r.conv_id, []).append(read_turn(r.formatted))
    assert got == {0: [("system", ""), ("user", "Q"), ("assistant", "A")], 1: [("user", "Q"), ("assistant", "A")], 2: [("", "hello"), ("user", "Q"), ("", "")], 3: [("user", "Q"), ("assistant", "A"), ("assistant", "B")], 4: [("user", "Q"), ("assistant", "A")]}
