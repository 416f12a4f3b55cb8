"""Tool-use transcripts: calls and responses found in text, joined in order, and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendloom.functions.text import FAILED, LIST_COMMAND, PATH_TOKEN, PRECISE_READ, READ_COMMAND, SEARCH_COMMAND, SEARCH_SCOPE, col, once, path_tokens, strip

#: The two tags of tool calls and their responses.
CALL = r"<tool_call>\s*(\{[\s\S]*?\})\s*</tool_call>"
RESPONSE = r"<tool_response>\s*([\s\S]*?)\s*</tool_response>"


def spans(x: Column | str, pattern: str) -> Column:
    """(start, end, body) of every match: offsets are running sums over the gaps between matches and their lengths."""
    x = F.coalesce(col(x), F.lit(""))
    whole, body = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    sizes = F.zip_with(F.transform(F.split(x, pattern, -1), F.length), F.transform(whole, F.length), lambda g, m: F.struct(g.alias("gap"), F.coalesce(m, F.lit(0)).alias("size")))
    sizes = F.slice(sizes, F.lit(1), F.size(whole))
    step = lambda acc, s: F.struct((acc["at"] + s["gap"] + s["size"]).alias("at"), F.concat(acc["found"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end")))).alias("found"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("found"))
    return F.zip_with(F.aggregate(sizes, zero, step)["found"], body, lambda s, b: F.struct(s["start"].alias("start"), s["end"].alias("end"), b.alias("body")))


def command(json: Column) -> Column:
    """Stripped command of a call's JSON; null if it is missing, blank or no string."""
    parsed = F.try_variant_get(F.try_parse_json(json), "$.arguments.cmd", "variant")
    text = lambda p: F.when(F.schema_of_variant(p) == "STRING", strip(F.try_variant_get(p, "$", "string")))
    return once(once(parsed, text), lambda t: F.when(t != "", t))


def triples(x: Column | str) -> Column:
    """(cmd, ok, response) of the valid calls of a transcript, in order.

    A call's response is the first that starts after the call's end; calls may share one, and one
    without any has failed.
    """
    responses = spans(x, RESPONSE)

    def answered(c: Column) -> Column:
        found = F.get(F.filter(responses, lambda r: r["start"] > c["end"]), 0)["body"]
        return F.struct(command(c["body"]).alias("cmd"), F.coalesce(~F.rlike(F.lower(strip(found)), F.lit(FAILED)), F.lit(False)).alias("ok"), F.coalesce(found, F.lit("")).alias("response"))

    return F.filter(F.transform(spans(x, CALL), answered), lambda t: t["cmd"].isNotNull())


def calls(df: DataFrame, key: str, completion: str = "completion") -> DataFrame:
    """One row per valid call: key, pos from 1, cmd, ok, response."""
    return df.select(key, F.posexplode(triples(completion)).alias("pos", "t")).select(key, (F.col("pos") + 1).alias("pos"), "t.*")


def matches(df: DataFrame, key: str, completion: str, pattern: str, kind: str) -> DataFrame:
    """(key, kind, start, end, body): a row per match, offsets by running sums in the order of matches.

    Tags of ``pattern`` are <tool_``kind``>; a body is what stands between them without white space, so it isn't searched for again.
    """
    x = F.coalesce(F.col(completion), F.lit(""))
    both = F.arrays_zip(F.split(x, pattern, -1).alias("gap"), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)).alias("whole"))
    inner = F.substr("m.whole", F.lit(len(kind) + 8), F.length("m.whole") - (2 * len(kind) + 15))
    found = df.select(key, F.posexplode(both).alias("nth", "m")).select(key, "nth", F.length("m.gap").alias("gap"), F.length("m.whole").alias("size"), F.btrim(inner, F.lit(" \t\n\x0b\f\r")).alias("body"))
    order = Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("gap").over(order) + F.sum("size").over(order)
    return found.where("size is not null").select(key, F.lit(kind).alias("kind"), (end - F.col("size")).alias("start"), end.alias("end"), "body")


def next_value(value: Column, key: str, *order: Column) -> Column:
    """The next value that isn't null, in the order of rows of ``key``, after the row itself.

    ``order`` is the reverse order. Read backwards, the frame only grows, so a key costs time in
    proportion to its rows; the forward form, a frame that shrinks, is worked out anew for every row.
    """
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def calls_by_window(df: DataFrame, key: str, completion: str = "completion") -> DataFrame:
    """The rows of ``calls`` for transcripts of any length: matches become rows, and windows pair them.

    ``calls`` works inside a row, without a shuffle, in time that grows with the square of a transcript.
    """
    asked = matches(df, key, completion, CALL, "call").withColumn("at", F.col("end"))
    said = matches(df, key, completion, RESPONSE, "response").withColumn("at", F.col("start"))
    # of a response that begins where a call ends and that call, the response comes first: it isn't the call's
    both = asked.unionByName(said).withColumn("found", next_value(F.when(F.col("kind") == "response", F.col("body")), key, F.desc("at"), F.asc("kind")))
    valid = both.where("kind = 'call'").withColumn("cmd", command(F.col("body"))).where("cmd is not null")
    ok = F.coalesce(~F.rlike(F.lower(strip("found")), F.lit(FAILED)), F.lit(False))
    return valid.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("pos"), "cmd", ok.alias("ok"), F.coalesce("found", F.lit("")).alias("response"))


def first_response(events: DataFrame, key: str) -> DataFrame:
    """Forward as-of join over (key, pos, kind, value): each call with the first response after it."""
    met = events.withColumn("response", next_value(F.when(F.col("kind") == "response", F.col("value")), key, F.desc("pos")))
    return met.where("kind = 'call'").select(key, "pos", F.col("value").alias("cmd"), "response")


def _any(condition: Column, amount: float) -> Column:
    return F.max(F.when(condition, amount).otherwise(0.0))


def habits(found: DataFrame, key: str) -> DataFrame:
    """(key, habits): an early listing 0.3, an early search 0.4, a read after two calls 0.3, each if it succeeded."""
    ran = lambda p: F.col("ok") & F.rlike("cmd", F.lit(p))
    score = _any(ran(LIST_COMMAND) & (F.col("pos") <= 2), 0.3) + _any(ran(SEARCH_COMMAND) & (F.col("pos") <= 10), 0.4) + _any(ran(READ_COMMAND) & (F.col("pos") > 2), 0.3)
    return found.groupBy(key).agg(F.round(score, 6).alias("habits"))


def _chain(found: DataFrame, key: str) -> DataFrame:
    """``found`` with ``takes_up``: whether a read takes up a path that the first successful search among ten calls named."""
    whole = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    search = F.when(F.col("ok") & F.rlike("cmd", F.lit(SEARCH_COMMAND)) & (F.col("pos") <= 10), F.struct("pos", "response"))
    led = found.withColumn("first_", F.first(search, ignorenulls=True).over(whole))
    named = F.exists(path_tokens("first_.response"), lambda t: F.contains(F.col("cmd"), t))
    reads = F.col("ok") & F.rlike("cmd", F.lit(READ_COMMAND)) & (F.col("pos") > F.col("first_.pos"))
    return led.withColumn("takes_up", F.coalesce(reads & named, F.lit(False))).drop("first_")


def chained(found: DataFrame, key: str) -> DataFrame:
    """Keys whose first successful search among ten calls names a path that a later read takes up."""
    return _chain(found, key).where("takes_up").select(key).distinct()


def depth(found: DataFrame, key: str) -> DataFrame:
    """(key, depth): exploration depth from 0 to 1.

    Chain 0.25, or else precise reads 0.2 and scoped searches 0.15; successes among the first six calls 0.2;
    repeated commands, repeated failures and truncated output cost up to 0.2.
    """
    order = Window.partitionBy(key).orderBy("pos")
    marked = _chain(found, key).withColumns(
        {
            "early": F.col("pos") <= 10,
            "again": ~F.col("ok") & ~F.coalesce(F.lag("ok").over(order), F.lit(True)) & (F.col("cmd") == F.lag("cmd").over(order)),
        }
    )
    scoped = F.rlike("cmd", F.lit(SEARCH_SCOPE)) | F.contains("cmd", F.lit("/")) | F.rlike("response", F.lit(PATH_TOKEN))
    first = F.collect_list(F.when(F.col("early"), F.col("cmd")))
    summed = marked.groupBy(key).agg(
        F.max("takes_up").alias("chain"),
        F.when(F.count("*") >= 6, 0.2 * F.count_if((F.col("pos") <= 6) & F.col("ok")) / 6).otherwise(0.0).alias("success"),
        _any(F.col("ok") & F.rlike("cmd", F.lit(PRECISE_READ)), 0.2).alias("precise"),
        _any(F.col("early") & F.col("ok") & F.rlike("cmd", F.lit(SEARCH_COMMAND)) & scoped, 0.15).alias("scope"),
        F.when(F.size(F.array_distinct(first)) < F.size(first), 0.07).otherwise(0.0).alias("same"),
        _any(F.col("early") & F.col("again"), 0.07).alias("again"),
        F.bool_or(F.col("early") & F.contains(F.lower("response"), F.lit("truncated"))).alias("truncated"),
    )
    precise = F.when(F.col("chain"), 0.0).otherwise(F.col("precise"))
    penalty = F.least(F.col("same") + F.col("again") + F.when((precise == 0) & F.col("truncated"), 0.1).otherwise(0.0), F.lit(0.2))
    total = F.when(F.col("chain"), 0.25).otherwise(F.col("precise") + F.col("scope")) + F.col("success") - penalty
    return summed.select(key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6).alias("depth"))
