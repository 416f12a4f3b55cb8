"""Chat rendering with tools, calls and results."""

import pytest
from pyspark.sql import functions as F

from mendloom.functions import chat
from mendloom.schemas import MESSAGE


def render(spark, turns, column):
    frame = spark.createDataFrame([(turns,)], f"m array<{MESSAGE}>")
    return frame.select(column.alias("x")).first().x


def turn(role, content=None, calls=None, call_id=None):
    return role, content, calls, call_id


CALL = [("id-123456789", ("f", '{"a": 1}'))]
TALK = [turn("system", "sys"), turn("user", " hi "), turn("assistant", None, CALL), turn("tool", "out", None, "id-123456789"), turn("assistant", "bye")]


def test_headers_with_calls_and_results(spark):
    got = render(spark, TALK, chat.header_format("m", "01 Jan 2025", bos="<b>", prompt=True, with_calls=True))
    head = lambda role: f"<|start_header_id|>{role}<|end_header_id|>\n\n"
    assert got == (
        "<b>" + head("system") + "Cutting Knowledge Date: December 2023\nToday Date: 01 Jan 2025\n\nsys<|eot_id|>" + head("user") + "hi<|eot_id|>" + head("assistant") + '{"name": "f", "parameters": {"a": 1}}<|eot_id|>'
        + head("ipython") + '{"output":"out"}<|eot_id|>' + head("assistant") + "bye<|eot_id|>" + head("assistant")
    )


def test_headers_with_tools(spark):
    got = render(spark, [turn("user", "hi")], chat.header_format("m", "today", tools=["{T}"], default_system="D"))
    assert "Environment: ipython\nCutting" in got and "\n\nD<|eot_id|>" in got and "{T}\n\nhi<|eot_id|>" in got


def test_brackets_with_tools_and_calls(spark):
    got = render(spark, TALK, chat.bracket_format("m", tools=["{T}"], with_calls=True))
    assert got.is_valid and got.text == (
        '<s>[AVAILABLE_TOOLS] [{"type": "function", "function": {T}}][/AVAILABLE_TOOLS][INST]  hi [/INST][TOOL_CALLS] [{"name": "f", "arguments": {"a": 1}, "id": "123456789"}]</s>'
        '[TOOL_RESULTS] {"content": out, "call_id": "123456789"}[/TOOL_RESULTS] bye</s>'
    )


@pytest.mark.parametrize(
    ("turns", "reason"),
    [
        ([turn("assistant", "a")], "alternation"),
        ([turn("user", "a"), turn("user", "b")], "alternation"),
        ([turn("user", "a"), turn("critic", "b")], "role"),
        ([turn("user", "a"), turn("assistant", None, [("short", ("f", "{}"))])], "id"),
        ([turn("system", "s"), turn("user", "a")], None),
    ],
)
def test_reasons_of_broken_conversations(spark, turns, reason):
    got = render(spark, turns, chat.bracket_format("m", with_calls=True))
    assert got.reason == reason and (got.text is None) == (reason is not None)


def test_padding_and_masks(spark):
    padded = lambda turns: [(x.role, x.content) for x in render(spark, turns, chat.padded(F.transform("m", lambda x: chat.message(x["role"], x["content"])), F.lit("p")))]
    assert padded([]) == [("user", "p"), ("assistant", "")] and padded([turn("system", "s")]) == [("system", "s"), ("user", "p"), ("assistant", "")]
    assert render(spark, TALK, chat.loss_mask("m")) == [False, False, True, False, True]
