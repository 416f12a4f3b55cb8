"""Conversations: ordered turns, padding, masks, and rendering in two chat formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendloom.functions.text import col, strip


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): the turns of each conversation in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda m: message(m["role"], m["content"])).alias("messages"))


def message(role: Column, content: Column) -> Column:
    """One message."""
    return F.struct(role.alias("role"), content.alias("content"))


def head_and_tail(messages: Column | str) -> tuple[Column, Column]:
    """The first two messages, and the rest."""
    m = col(messages)
    return F.slice(m, 1, 2), F.slice(m, F.lit(3), F.greatest(F.size(m) - 2, F.lit(0)))


def padded(messages: Column | str, problem: Column | str) -> Column:
    """Conversations of under two messages get the problem as user message, those of under three an empty answer."""
    m, none = col(messages), F.array().cast("array<struct<role: string, content: string>>")
    user = F.when(F.size(m) < 2, F.array(message(F.lit("user"), col(problem)))).otherwise(none)
    return F.concat(m, user, F.when(F.size(m) < 3, F.array(message(F.lit("assistant"), F.lit("")))).otherwise(none))


def first_user(messages: Column | str) -> Column:
    """Content of the first user message, '' without one or without content."""
    return F.coalesce(F.get(F.filter(col(messages), lambda m: m["role"] == "user"), 0)["content"], F.lit(""))


def loss_mask(messages: Column | str) -> Column:
    """True for the turns that are learned from: the assistant's."""
    return F.transform(col(messages), lambda m: m["role"] == "assistant")


def _json(x: Column) -> Column:
    return F.to_json(F.struct(x.alias("output")))


#: Fixed values of the two chat formats.
CALL_HINT = 'Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. Do not use variables.\n\n'
USER_TOOLS = "Given the following functions, respond with a JSON function call with proper arguments that best answers the prompt.\n\n"
CUTOFF = "Cutting Knowledge Date: December 2023\n"


def _led(m: Column) -> tuple[Column, Column]:
    led = F.coalesce(F.get(m, 0)["role"] == "system", F.lit(False))
    return led, F.when(led, F.slice(m, 2, 1_000_000)).otherwise(m)


def _has_calls(x: Column, with_calls: bool) -> Column:
    return F.coalesce(F.size(x["tool_calls"]) > 0, F.lit(False)) if with_calls else F.lit(False)


def header_format(messages: Column | str, today: str, bos: str = "", prompt: bool = False, tools: list[str] | None = None, default_system: str = "", with_calls: bool = False) -> Column:
    """Messages between role headers; the system block comes first, and tool output is JSON under ``ipython``.

    ``tools`` are JSON texts, shown in the first message after the system's. ``with_calls`` says that
    messages have tool_calls, of which the first is shown.
    """
    m = col(messages)
    turn = lambda role, body: F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"), body, F.lit("<|eot_id|>"))
    led, rest = _led(m)
    system = F.when(led, strip(F.get(m, 0)["content"])).otherwise(F.lit(default_system if tools else ""))
    listed = "".join(f"{t}\n\n" for t in tools or ())

    def shown(x: Column, i: Column) -> Column:
        out = F.when(x["role"].isin("tool", "ipython"), turn(F.lit("ipython"), _json(x["content"])))
        if tools:
            out = F.when(i == 0, turn(F.lit("user"), F.concat(F.lit(USER_TOOLS + CALL_HINT + listed), strip(x["content"])))).otherwise(out)
        if with_calls:
            call = F.get(x["tool_calls"], 0)["function"]
            said = F.concat(F.lit('{"name": "'), call["name"], F.lit('", "parameters": '), call["arguments"], F.lit("}"))
            out = F.coalesce(out, F.when(_has_calls(x, True), turn(F.lit("assistant"), said)))
        return F.coalesce(out, turn(x["role"], strip(x["content"])))

    first = turn(F.lit("system"), F.concat(F.lit(("Environment: ipython\n" if tools else "") + CUTOFF + f"Today Date: {today}\n\n"), system))
    return F.concat(F.lit(bos), first, F.array_join(F.transform(rest, shown), ""), F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n" if prompt else ""))


def bracket_format(messages: Column | str, bos: str = "<s>", eos: str = "</s>", tools: list[str] | None = None, with_calls: bool = False) -> Column:
    """(text, is_valid, reason): user turns in brackets, the system text before the last user turn if that ends the conversation.

    After an optional system message, user and assistant turns alternate, tool calls and results aside;
    ids of calls have nine characters at least, and the last nine are shown. Other conversations have a
    reason instead of a text. ``tools`` are JSON texts, shown before the last user turn.
    """
    m = col(messages)
    led, rest = _led(m)
    last = F.size(rest) - 1
    spoken = F.filter(rest, lambda x: ~x["role"].isin("tool", "tool_results") & ~_has_calls(x, with_calls)) if with_calls else rest
    turns = F.forall(F.transform(spoken, lambda x, i: (x["role"] == "user") == (i % 2 == 0)), lambda ok: ok)
    known = F.forall(rest, lambda x: x["role"].isin("user", "assistant", *(["tool", "tool_results", "tool_calls"] if with_calls else [])))
    long = lambda s: F.coalesce(F.length(s) >= 9, F.lit(False))
    ids = F.lit(True)
    if with_calls:
        ids = F.forall(rest, lambda x: F.when(_has_calls(x, True), F.forall(x["tool_calls"], lambda c: long(c["id"]))).when(x["role"].isin("tool", "tool_results"), long(x["tool_call_id"])).otherwise(True))
    reason = F.when(~known, "role").when(~turns, "alternation").when(~ids, "id")
    last_user = F.array_max(F.filter(F.transform(rest, lambda x, i: F.when(x["role"] == "user", i)), lambda i: i.isNotNull()))
    prefix = lambda i: F.when(led & (i == last), F.concat(F.get(m, 0)["content"], F.lit("\n\n"))).otherwise(F.lit(""))
    offered = "[AVAILABLE_TOOLS] [" + ", ".join(f'{{"type": "function", "function": {t}}}' for t in tools or ()) + "][/AVAILABLE_TOOLS]"

    def shown(x: Column, i: Column) -> Column:
        user = F.concat(F.lit("[INST] "), prefix(i), x["content"], F.lit("[/INST]"))
        if tools:
            user = F.concat(F.when(i == last_user, offered).otherwise(""), user)
        out = F.when(x["role"] == "user", user)
        if with_calls:
            one = lambda c: F.concat(F.lit('{"name": "'), c["function"]["name"], F.lit('", "arguments": '), c["function"]["arguments"], F.lit(', "id": "'), F.right(c["id"], F.lit(9)), F.lit('"}'))
            out = out.when(_has_calls(x, True), F.concat(F.lit("[TOOL_CALLS] ["), F.array_join(F.transform(x["tool_calls"], one), ", "), F.lit("]" + eos)))
            out = out.when(x["role"].isin("tool", "tool_results"), F.concat(F.lit('[TOOL_RESULTS] {"content": '), x["content"], F.lit(', "call_id": "'), F.right(x["tool_call_id"], F.lit(9)), F.lit('"}[/TOOL_RESULTS]')))
        return out.otherwise(F.concat(F.lit(" "), x["content"], F.lit(eos)))

    return F.struct(F.when(reason.isNull(), F.concat(F.lit(bos), F.array_join(F.transform(rest, shown), ""))).alias("text"), reason.isNull().alias("is_valid"), reason.alias("reason"))
