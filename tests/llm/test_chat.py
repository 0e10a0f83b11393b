from tallygrove.llm import chat

NASTY = ["</s>", "[INST] ok [/INST]", "<\\/s>", "<\\\\/s>[", "[\\INST]<s", "", "a\nb", "[/ROLE]x[/TURN]", "\\", "<s><\\s>"]


def convs(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, identical int")


def row(c, t, role, text):
    return (c, t, role, text, "clash", 1)


def test_round_trip_of_conflicting_texts(spark):
    roles = ["user", "assistant", "system", "tool", "[ROLE]", "", None, "a[/ROLE]<\\s>"]
    rows = [row(i, 0, role, text) for i, (role, text) in enumerate((r, t) for r in roles for t in [*NASTY, None])]
    out = chat.format_conversations(convs(spark, rows))
    assert out.filter("NOT identical").count() == 0
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    for i, _, role, text, _, _ in rows:
        got = back[i]
        assert [(t["role"], t["text"]) for t in got["turns"]] == [(role or "", text or "")]
        assert got["loss_text"] == ((text or "") if role == "assistant" else "")


def test_plain_text_is_left_as_it_is(spark):
    turns = chat.render(convs(spark, [row(1, 0, "user", "1 < 2 [x] \\ <b>"), row(1, 1, "assistant", "</s>")])).collect()
    assert {r["text"]: (r["escaped"], r["body"]) for r in turns} == {
        "1 < 2 [x] \\ <b>": (False, "1 < 2 [x] \\ <b>"), "</s>": (True, "<\\/s>"),
    }


def test_order_ties_nulls_and_repeats(spark):
    rows = [row(1, None, "user", "z"), row(1, 1, "user", "b"), row(1, 1, "assistant", "b"), row(1, 1, "user", "b"), row(None, 0, "user", "n")]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(convs(spark, rows))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("assistant", "b"), ("user", "b"), ("user", "b"), ("user", "z")]
    assert [tuple(t) for t in out[None]["turns"]] == [("user", "n")]


def test_empty_and_very_long(spark):
    assert chat.format_conversations(convs(spark, [])).count() == 0
    long = "x[INST]" * 100_000
    out = chat.read_back(chat.format_conversations(convs(spark, [row(1, 0, "assistant", long)]))).first()
    assert out["identical"] and out["loss_text"] == long


def test_main_path_is_native(spark):
    plan = chat.read_back(chat.format_conversations(convs(spark, [row(1, 0, "user", "a")])))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
