"""Inputs of code repair derived from the given tables by expressions: texts, patches, transcripts, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendloom.sources.folders import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_modulus(key: Column, *choices: Column) -> Column:
    """One of the choices, by the key modulo their number."""
    out = choices[-1]
    for i, c in reversed(list(enumerate(choices[:-1]))):
        out = F.when(F.pmod(key, F.lit(len(choices))) == i, c).otherwise(out)
    return out


def say(*parts: Column | str) -> Column:
    """Concatenation of columns and literal strings."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def lang() -> Column:
    """Language of a document, en where unknown."""
    return F.coalesce("lang", F.lit("en"))


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, completion, answer): labels in answer tags, five variants."""
    text = by_modulus(F.col("doc_id"), say("<answer>", lang(), "</answer>"), say("because <answer>\n ", lang(), " \n"), lang(), say("<answer>  ", lang(), "\t</answer> <answer>no</answer>"), F.lit("<answer>xx</answer>"))
    return docs.select("doc_id", text.alias("completion"), lang().alias("answer"))


def reasoned(docs: DataFrame) -> DataFrame:
    """(doc_id, completion): think and answer tags, four variants."""
    whole = say("<think>\n", lang(), "\n</think>\n<answer>\n", F.coalesce("source", F.lit("s")), "\n</answer>")
    return docs.select("doc_id", by_modulus(F.col("doc_id"), whole, say("pre", whole), say("<think>\n", lang(), "\n</think>\n"), say(whole, "12345")).alias("completion"))


def fenced(docs: DataFrame) -> DataFrame:
    """(doc_id, completion): one, two or no fenced blocks."""
    s = F.coalesce("text", F.lit("s"))
    return docs.select("doc_id", by_modulus(F.col("doc_id"), say("see ```py\n", s, "\n``` end"), say("```\n", s, "\n``` and ```js\nx\n```"), say("no ", s)).alias("completion"))


def block(search: Column | str, replace: Column | str) -> Column:
    """One search/replace block."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_col(search).alias("search"), as_col(replace).alias("replace"))


def coded(part: DataFrame) -> DataFrame:
    """(p_partkey, code, blocks): two lines of code and one, two or a useless block."""
    code = say("name = '", F.col("p_name"), "'\nbrand = '", F.col("p_brand"), "'")
    new = say("size ", F.col("p_size").cast("string"))
    blocks = by_modulus(F.col("p_partkey"), F.array(block(F.col("p_brand"), new)), F.array(block("name", "title"), block("brand", "maker")), F.array(block("", new)))
    return part.select("p_partkey", code.alias("code"), blocks.alias("blocks"))


def file_diff(key: Column) -> Column:
    """Unified diff of one file."""
    k = key.cast("string")
    return say("diff --git a/f", k, ".py b/f", k, ".py\n--- a/f", k, ".py\n+++ b/f", k, ".py\n@@ -1,2 +1,2 @@\n same\n-old ", k, "\n+new ", k, "\n")


def patches(docs: DataFrame) -> DataFrame:
    """(problem, patch, generated_diff, test_patch): eight documents a problem, a file each; sides lack some files."""
    k = F.col("doc_id")
    part = lambda keep, name: F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(k.alias("k"), file_diff(k).alias("d"))))), lambda x: x["d"]), ""), F.lit("")).alias(name)
    return docs.groupBy(F.floor(k / 8).cast("long").alias("problem")).agg(part(k % 4 != 3, "patch"), part(k % 4 != 0, "generated_diff"), part(k % 4 == 1, "test_patch"))


#: Event types as shell commands and what they print.
COMMANDS = {
    "view": ("ls", "ok"),
    "click": ("rg -n x src/a.py", "src/a.py: x"),
    "purchase": ("sed -n '1,5p' a.py", "ok"),
    "error": ("rg -n x", "Command failed with exit code 1"),
    "signup": ("echo hi", "output truncated"),
}


def session() -> Column:
    """Key of a transcript: a seventh of a user's events."""
    return F.concat_ws("-", "user_id", F.col("event_id") % 7)


def transcripts(events: DataFrame) -> DataFrame:
    """(session, completion): a user's events as tool calls and responses, in order of time."""
    cmd = F.create_map(*(F.lit(x) for k, (c, _) in COMMANDS.items() for x in (k, c)))[F.col("event_type")]
    out = F.create_map(*(F.lit(x) for k, (_, r) in COMMANDS.items() for x in (k, r)))[F.col("event_type")]
    turn = say("<tool_call>\n", F.to_json(F.struct(F.lit("shell").alias("name"), F.struct(cmd.alias("cmd")).alias("arguments"))), "\n</tool_call>\n<tool_response>\n", out, "\n</tool_response>\n")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", turn.alias("turn"))))
    # Events are small and their texts large, so partitions aren't left to be merged by the bytes of events.
    dealt = spread(events.select("ts", "event_id", "event_type", session().alias("session")), "session")
    return dealt.groupBy("session").agg(F.array_join(F.transform(ordered, lambda t: t["turn"]), "").alias("completion"))


#: SQL of the same calls, straight from the events.
CALLS_SQL = "SELECT concat(user_id, '-', event_id % 7) AS session, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY ts, event_id) AS pos, event_type AS e FROM events"


def source_files(part: DataFrame) -> DataFrame:
    """(file_id, content): a Python file a row; five variants for the filters."""
    k = F.col("p_partkey")
    doc = by_modulus(k, *[say('    """Compute the thing of row ', k.cast("string"), '.\n\n    Args:\n        a: first value of the pair\n        b: second value of the pair\n    """\n')] * 4, F.lit('    """Short."""\n'))
    many = "".join(f"    x{i} = a\n" for i in range(16))
    body = by_modulus(k, F.lit("    x = a\n    y = b\n    return x\n"), F.lit("    x = 'SELECT 1'\n    y = b\n    return x\n"), F.lit(many + "    return a\n"), F.lit("    x = a\n    return x\n"), F.lit("    x = a\n    y = b\n    return x\n"))
    return part.select(k.alias("file_id"), say("import os\n\n\n@staticmethod\ndef f", (k % 7).cast("string"), "(a, b):\n", doc, body, "\n\nz = 1\n").alias("content"))


def odd_sources(part: DataFrame) -> DataFrame:
    """(file_id, content): a file with targets of several kinds, every second one with carriage returns."""
    k = F.col("p_partkey")
    code = F.when(k % 2 == 0, "    for i, j in a:\n        x = i\n    with open(b) as (f, g):\n        y: int = 1\n    return x\n").otherwise("    for i in a:\n        x, z = i\n    with b as f:\n        f[0] = 1\n    return x\n")
    whole = say("import os\n\ndef f(a):\n    'Part ", k.cast("string"), "'\n", code, "\nz = 1\n")
    return part.select(k.alias("file_id"), F.when(k % 2 == 0, F.replace(whole, F.lit("\n"), F.lit("\r\n"))).otherwise(whole).alias("content"))


def vulnerabilities(docs: DataFrame) -> DataFrame:
    """Pairs of functions by hash: even ids are vulnerable; one pair in five is of type Other."""
    k, pair = F.col("doc_id"), F.floor(F.col("doc_id") / 2)
    cwe = F.when(pair % 5 == 4, F.array(F.lit("Other"))).otherwise(F.array(say("CWE-", (pair % 12).cast("string"))))
    return docs.select(F.md5(F.encode(pair.cast("string"), "UTF-8")).alias("hash"), (k % 2 == 0).alias("is_vulnerable"), say("f", k.cast("string"), "()").alias("func"), cwe.alias("cwe"), say("weakness ", pair.cast("string")).alias("cwe_description"))


def rollouts(docs: DataFrame, k: int = 2) -> DataFrame:
    """(instance_id, rollout_no, status, generated_diff, messages): ``k`` rollouts of each problem; some failed."""
    base = patches(docs).select(F.col("problem").cast("string").alias("instance_id"), "patch", "test_patch", "generated_diff")
    many = base.withColumn("rollout_no", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    status = F.when((F.col("instance_id").cast("long") + F.col("rollout_no")) % 5 == 0, "failed").otherwise("ok")
    given = F.when(F.col("rollout_no") == 0, F.col("generated_diff")).otherwise(F.col("patch"))
    talk = F.array(F.struct(F.lit("user").alias("role"), say("fix ", F.col("instance_id")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("done").alias("content")))
    return many.withColumns({"status": status, "generated_diff": given, "messages": talk})
