from __future__ import annotations

import json
import random

from casework.llm import chat


def test_escapes_round_trip_and_hide_control_strings():
    draw = random.Random(1)
    pieces = ["\\", "\\.", ".", "<", "[", "s>", "/", *chat.CONTROL, "INST]", "a", "\n", "é", "[/INST", "</s"]
    for _ in range(20_000):
        turns = [tuple("".join(draw.choice(pieces) for _ in range(draw.randint(0, 6))) for _ in range(2)) for _ in range(draw.randint(0, 3))]
        turns = [("assistant" if draw.random() < 0.5 else r, t) for r, t in turns]
        formatted, loss = chat.render(turns)
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
        assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROL)


def test_layouts_become_the_same_turns():
    want = [("user", "q"), ("assistant", "a")]
    records = [
        {"prompt": "q", "response": "a"}, {"completion": "a", "prompt": "q"}, {"question": "q", "answer": "a", "id": 3},
        {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"turns": [{"speaker": "user", "text": "q"}, {"text": "a", "speaker": "bot"}], "meta": {"x": [1]}},
    ]
    assert [chat.canonical(r)[1] for r in records] == [want] * len(records)
    assert len({chat.fingerprint(r) for r in records}) == len(records)
    assert chat.canonical({"instruction": "q", "input": "x", "output": "a"})[1][0] == ("user", "q\n\nx")
    assert chat.canonical({"messages": []}) == ("messages", [])
    assert chat.canonical({"unknown": 1}) is None and chat.canonical([1]) is None


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, None, None, "late"), (2, 0, "tool", "y"),
        (None, 0, "human", "z"), (3, 0, "system", "s"), (3, 1, "user", "[INST]"), (3, 2, "assistant", "w" * 300_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.records_of_turns(turns)
    assert {r.conv_id: set(json.loads(r.record)) for r in records.collect()} == {1: {"messages"}, 2: {"messages"}, None: {"messages"}, 3: {"conversations"}}
    back = {r.id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_records(records)).collect()}
    assert back == {
        1: [("user", ""), ("assistant", "x"), ("assistant", "x")], 2: [("", "late"), ("tool", "y")], None: [("human", "z")],
        3: [("system", "s"), ("user", "[INST]"), ("assistant", "w" * 300_000)],
    }
    odd = spark.createDataFrame([(1, None), (2, "{"), (3, '{"a": 1}'), (4, "[]")], "conv_id long, record string")
    formatted = chat.format_records(odd)
    assert [r.formatted for r in formatted.collect()] == [None] * 4
    assert [r.turns for r in chat.read_back(formatted).collect()] == [None] * 4
    assert chat.read_back(chat.format_records(chat.records_of_turns(turns.limit(0)))).count() == 0
