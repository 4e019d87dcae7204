import json

from foliospark.llm.chat_format import MAPPINGS, canonical_turns, fingerprint, format_turns, json_turns, op1_chat_format, read_back, select_mapping


def test_round_trip_of_control_strings(spark):
    texts = ["", None, "\\", "#####", "a</turn>\n### User: b", "<\\/turn>", "\\### Assistant: </turn> ok", "é\\n", "</tu", "### ", "x" * 50_000 + "\\</turn>"]
    rows = [(1, i, ["user", "assistant", None, "Tool x: ", "role_61"][i % 5], t, "extra") for i, t in enumerate(texts)] + [(1, 0, "user", "", "e"), (None, None, "assistant", "z", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    turns = canonical_turns(df)
    out = {r.conv_id: r for r in read_back(format_turns(turns)).collect()}
    want = sorted(((i is not None, i or 0, role or "", t or "") for c, i, role, t, _ in rows if c == 1))
    assert [tuple(t) for t in out[1].turns] == [(role, t) for _, _, role, t in want]
    assert out[1].loss_text == "".join(t for _, _, role, t in want if role == "assistant")
    assert [tuple(t) for t in out[None].turns] == [("assistant", "z")]


def test_layouts_by_row(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]},
        {"completion": "b", "prompt": "a"},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "input": "", "output": "b"},
        {"other": 1},
        {"question": "a", "answer": "b", "system": None},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "no json"), (10, None)], "id long, record_json string")
    out = {r.id: r.turns for r in json_turns(df, "id", "record_json").collect()}
    for i in (0, 1, 2, 3, 5):
        assert [tuple(t) for t in out[i]] == [("user", "a"), ("assistant", "b")], i
    assert out[4] is out[9] is out[10] is None


def test_layouts_by_schema(spark):
    chat = spark.sql("select 1L as conv_id, array(named_struct('from', 'human', 'value', 'a')) as conversations")
    assert select_mapping(chat.schema).name == "from and value"
    assert [tuple(t) for t in canonical_turns(chat).first().turns] == [("user", "a")]
    task = spark.sql("select 1L as conv_id, 'do' as instruction, 'it' as input, 'ok' as output, 'x' as prompt")
    assert select_mapping(task.schema).name == "instruction"
    assert [tuple(t) for t in canonical_turns(task).first().turns] == [("user", "do\n\nit"), ("assistant", "ok")]
    assert len({fingerprint(m.paths()) for m in MAPPINGS}) == len(MAPPINGS)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_turns(canonical_turns(df)).count() == 0


def test_query_has_the_made_conversation(spark, data):
    out = {r.conv_id: r for r in op1_chat_format(spark, data).collect()}
    assert out[-7].n_turns == 2 and out[-7].loss_chars == len("\\### Assistant: </turn> ok")


def test_json_with_further_fields_empty_lists_and_odd_records(spark):
    turn = lambda *pairs: [{"role": r, "text": t} for r, t in pairs]
    cases = [
        ('{"messages":[{"role":"user","content":"hi"}],"id":"x"}', turn(("user", "hi"))),
        ('{"messages":[{"role":"user","content":"hi","name":"n"},{"role":"assistant","content":null}]}', turn(("user", "hi"), ("assistant", ""))),
        ('{"messages":[]}', []),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b","weight":1}],"score":3}', turn(("user", "a"), ("assistant", "b"))),
        ('{"prompt":"p","completion":"c","meta":{"a":[1]}}', turn(("user", "p"), ("assistant", "c"))),
        ('{"instruction":"i","input":"","output":"o"}', turn(("user", "i"), ("assistant", "o"))),
        ('{"instruction":"i","output":"o","prompt":"p"}', turn(("user", "i"), ("assistant", "o"))),
        ('{"other":1}', None), ("[1]", None), ("not json", None), (None, None),
    ]
    df = spark.createDataFrame(list(enumerate(x for x, _ in cases)), "id long, json string")
    got = {r.id: r.turns and [t.asDict() for t in r.turns] if r.turns is not None else None for r in json_turns(df, "id", "json").collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, cases[i]
    assert json_turns(df.limit(0), "id", "json").count() == 0
