"""Text functions: tags, fences, unified diffs and markers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that decide which blocks, commands, paths and failures count.
FENCE = r"(?s)```(?:.*?)\n(.*?)```"
SEARCH_COMMAND = r"\b(rg|grep|find)\b"
READ_COMMAND = r"\b(sed|head|tail)\b"
LIST_COMMAND = r"\bls\b"
PRECISE_READ = r"\b(sed\s+-n\s+'?\d+\s*,\s*\d+\s*p'?|head\s+-n\s+\d+|tail\s+-n\s+\d+)\b"
SEARCH_SCOPE = r"(?:^|\s)-(?:n)\b|\b--type=\w+\b"
PATH_TOKEN = r"[\w./-]+\.(py|ts|js|java|go|rs|md|txt|json|yaml|yml|toml|ini)\b|\b(?:src|lib|tests?|docs)/[\w./-]+\b"
FAILED = r"command failed with exit code|command timed out|shell execution failed"


def col(x: Column | str) -> Column:
    """A column, also from its name."""
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of an expression that is computed a single time, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def strip(x: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(x), r"^\s+|\s+\z", "")


def lines(x: Column | str) -> Column:
    """Lines without their ends; a final line end makes no further line, an empty text has none."""
    x = col(x)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, r"\R\z", ""), r"\R", -1))


def occurrences(x: Column | str, token: str) -> Column:
    """How often ``token`` is in a text, without overlaps."""
    x = col(x)
    return ((F.length(x) - F.length(F.replace(x, F.lit(token), F.lit("")))) / len(token)).cast("int")


def answer_tag(x: Column | str) -> Column:
    """Stripped text from the first <answer> to the next </answer>, or the end; N/A without a tag."""
    x = col(x)
    at = F.instr(x, "<answer>")
    return F.when(at > 0, strip(F.substring_index(F.substr(x, at + 8), "</answer>", 1))).otherwise(F.lit("N/A"))


def fenced(x: Column | str) -> Column:
    """Inside of the first fenced block, else the whole text."""
    x = col(x)
    return F.when(F.rlike(x, F.lit(FENCE)), F.regexp_extract(x, FENCE, 1)).otherwise(x)


def all_fenced(x: Column | str) -> Column:
    """Insides of all fenced blocks, else the text alone."""
    x = col(x)
    found = F.regexp_extract_all(x, F.lit(FENCE), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(x))


def file_diffs(x: Column | str) -> Column:
    """A unified diff cut before each ``diff --git`` line; parts stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(col(x), r"(?md)(?=^diff --git)"), strip), lambda p: p != "")


def diff_filename(x: Column | str) -> Column:
    """File name in the first line of one file's diff, '' if there is none."""
    return F.regexp_extract(F.substring_index(col(x), "\n", 1), "diff --git a/(.*) b/", 1)


def reasoning_tags(x: Column | str) -> Column:
    """A quarter for each of four tags that occurs exactly once; text before the first and after the last costs 0.001 a character."""
    x = col(x)
    once = lambda tag: occurrences(x, tag) == 1
    opening = F.when(once("<think>\n"), 0.25 - 0.001 * F.length(F.substring_index(x, "<think>\n", 1))).otherwise(0.0)
    middle = F.when(once("\n</think>\n"), 0.25).otherwise(0.0) + F.when(once("\n<answer>\n"), 0.25).otherwise(0.0)
    closing = F.when(once("\n</answer>"), 0.25 - 0.001 * F.length(F.substring_index(x, "\n</answer>", -1))).otherwise(0.0)
    return F.greatest(F.lit(0.0), opening + middle + closing)


def strict_reasoning(x: Column | str) -> Column:
    """1 if the text is one think block and a one-line answer, else 0."""
    return F.rlike(col(x), F.lit(r"^<think>\n([\s\S]+?)\n</think>\n<answer>\n([^\n]+)\n</answer>\s*\z")).cast("double")


#: Columns that may hold a result's patch, the first that has one counts.
PATCH_COLUMNS = ("generated_diff", "patch", "diff", "model_patch")


def first_full(*options: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(col(o), F.lit("")) for o in options), F.lit(""))


def run_tag(x: Column | str) -> Column:
    """Name made safe for paths: / becomes __, blanks and odd characters _, runs of _ one, none at the ends."""
    swapped = F.regexp_replace(F.replace(F.replace(col(x), F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_")), r"[^A-Za-z0-9._-]", "_")
    return F.regexp_replace(F.regexp_replace(swapped, "_+", "_"), "^_|_$", "")


def command_classes(cmd: Column | str) -> Column:
    """Which kinds of shell command a line holds."""
    cmd = col(cmd)
    named = {"lists": LIST_COMMAND, "searches": SEARCH_COMMAND, "reads": READ_COMMAND, "reads_precisely": PRECISE_READ, "scopes": SEARCH_SCOPE}
    return F.struct(*(F.rlike(cmd, F.lit(p)).alias(k) for k, p in named.items()))


def succeeded(response: Column | str) -> Column:
    """Whether tool output is free of the failure phrases."""
    return ~F.rlike(F.lower(strip(response)), F.lit(FAILED))


def path_tokens(output: Column | str) -> Column:
    """Group 1 of each path in tool output: its extension, or '' for a path under a known folder."""
    return F.regexp_extract_all(col(output), F.lit(PATH_TOKEN), F.lit(1))
