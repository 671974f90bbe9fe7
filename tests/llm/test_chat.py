import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import chat

SCHEMA = "conv_id bigint, seq bigint, kind string, message_id string, role string, text string, formatted string"


@given(st.lists(st.tuples(st.text(alphabet="ab\\n\n<|>é", max_size=6), st.text(alphabet="<|\\im_start>end \n🙂", max_size=40))))
def test_render_reads_back_exactly(messages):
    text, spans = chat.render(messages, learn="a")
    assert chat.read_back(text) == messages
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in messages if r == "a"]


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 5, "delta", "m2", None, "lo"),
        (1, 1, "message", "m1", "user", "hi"),
        (1, 2, "delta", "m2", "assistant", "hel"),
        (1, 6, "edit", "m1", None, "hi!"),
        (1, 7, "message", "m3", "user", "again"),
        (1, 8, "regenerate", "m2", None, None),
        (1, 9, "delta", "m2", None, "new "),
        (1, 10, "delta", "m2", None, "answer"),
        (2, 1, None, None, None, None),
        (2, 2, None, None, "assistant", "x" * 200_000),
        (2, 2, "message", "d", "user", "gone"),
        (2, 3, "delete", "d", None, None),
        (None, None, "message", None, "user", "no id"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in log], SCHEMA)
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.format_chats(df).collect()}
    assert got == {1: [("user", "hi!"), ("assistant", "new answer")], 2: [("", ""), ("assistant", "x" * 200_000)], None: [("user", "no id")]}
    assert chat.format_chats(df.limit(0)).count() == 0
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_unknown_kind():
    with pytest.raises(ValueError):
        chat.Fold().apply("what", "m", "user", "x")


def test_turns_sort_by_number_and_repeat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "system", "s")]
    df = chat.from_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert chat.read_back(chat.format_chats(df).first()["formatted"]) == [("system", "s"), ("user", "a"), ("assistant", "b"), ("assistant", "b")]
