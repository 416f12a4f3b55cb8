"""Prompt and answer columns, and the filter on prompt length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendloom.functions.chat import header_format
from mendloom.functions.text import col, strip

REPAIR_SYSTEM = "You repair source code. Reply with search/replace blocks inside <answer> tags."
REPAIR_TASK = "Repair the code above and reply with search/replace blocks only."
CLASSIFY_SYSTEM = "You classify source code. Reply with one label inside <answer> tags."
CLASSIFY_TASK = "Name the label that fits the code above."


def _prompt(code: Column, description: Column | None, task: str) -> Column:
    header = F.lit("")
    if description is not None:
        header = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("Issue:\n"), description, F.lit("\n\n"))).otherwise(F.lit(""))
    return strip(F.concat(header, F.lit("Code:\n```\n"), code, F.lit(f"\n```\n\n{task}")))


def repair_prompt(code: Column | str, description: Column | None = None, task: str = REPAIR_TASK) -> Column:
    """Prompt to repair one file, with the issue first where there is one."""
    return _prompt(col(code), description, task)


def classification_prompt(code: Column | str, description: Column | None = None, task: str = CLASSIFY_TASK) -> Column:
    """Prompt to label a piece of code."""
    return _prompt(col(code), description, task)


def chat(system: str, user: Column | str) -> Column:
    """System and user message."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", col(user)))


def regex_tokens(text: Column) -> Column:
    """Words, and single marks: the token count where no tokenizer is given."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("int")


def templated(messages: Column) -> Column:
    """Messages in the header format, up to where the answer begins."""
    return header_format(messages, "01 Jan 2025", bos="<|begin_of_text|>", prompt=True)


def by_length(df: DataFrame, system: str, most: int, user: str = "user_prompt", count: Callable[[Column], Column] = regex_tokens, template: Callable[[Column], Column] = templated) -> DataFrame:
    """Rows whose system and user message, as a chat template renders them, have ``most`` tokens at most, with tokenized_length.

    ``count`` is the tokenizer's: see ``tokens.id_counter`` for one from a file.
    """
    return df.withColumn("tokenized_length", count(template(chat(system, user)))).where(F.col("tokenized_length") <= most)


def vulnerability_description(cwe: Column | str, description: Column | str) -> Column:
    """Type, as a bracketed list of quoted labels, and description."""
    quoted = F.transform(col(cwe), lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    return F.concat(F.lit("Type: ["), F.array_join(quoted, ", "), F.lit("]\nDescription: "), col(description))


def docstring_description(name: Column | str, start: Column | str, end: Column | str, docstring: Column | str) -> Column:
    """What a masked function should do, and where."""
    return F.concat(F.lit("Write the body of `"), col(name), F.lit("` (lines "), col(start).cast("string"), F.lit("-"), col(end).cast("string"), F.lit("):\n"), col(docstring))
