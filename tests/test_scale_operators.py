"""Operators on hot keys, repeated rows and typed values, and the plans they run on."""

import ast
import difflib
import random
import re
import statistics
import time

import pytest
from pyspark.sql import functions as F

from mendloom.functions import diffs
from mendloom.operators import metrics, mining, selection, transcripts
from mendloom.plans import pipelines
from mendloom.sources import io
from mendloom.streaming import predictions


def test_numbers_take_one_exchange_and_split_a_lone_key(spark, monkeypatch):
    plans = []
    real = selection.written
    monkeypatch.setattr(selection, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    rows = spark.range(40_000).selectExpr("1 AS k", "id", "map('a', id) AS m").repartition(4)
    got = selection.numbered(rows, ["k"])
    assert plans[0].count("Exchange rangepartitioning") == 1 and "Window" not in plans[0]
    assert sorted(r.row_no for r in got.select("row_no").collect()) == list(range(40_000))
    again = {r.id: r.row_no for r in selection.numbered(rows.repartition(7), ["k"]).collect()}
    assert again == {r.id: r.row_no for r in got.collect()}  # whatever the partitions
    ranges = []
    monkeypatch.setattr(selection, "written", lambda df, name: (out := real(df, name), ranges.append(out.select("range_").distinct().count()))[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    try:
        selection.numbered(rows, ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges == [4]


def test_numbers_of_null_keys_repeated_rows_and_nothing(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (2, "b"), (2, "c"), (1, None)], "k int, v string")
    got = sorted((r.row_no, r.k, r.v) for r in selection.numbered(rows, ["k"]).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4] and [g[1] for g in got] == [None, None, 1, 2, 2]
    assert selection.numbered(rows.where("false"), ["k"]).count() == 0


def test_the_next_response_is_found_in_linear_time(spark):
    n = 200_000
    events = spark.range(n).selectExpr("1 AS k", "id AS pos", "if(id % 5 = 4, 'response', 'call') AS kind", "cast(id as string) AS value")
    transcripts.first_response(events.limit(100), "k").collect()
    began = time.time()
    got = transcripts.first_response(events, "k").agg(F.count("*").alias("n"), F.sum(F.col("response").cast("long") - F.col("pos")).alias("gap"), F.count_if(F.col("response").isNull()).alias("none")).first()
    assert time.time() - began < 20
    assert (got.n, got.none) == (n * 4 // 5, 0) and got.gap == n // 5 * (4 + 3 + 2 + 1)


def test_responses_are_those_of_a_plain_loop(spark):
    draw = random.Random(1)
    events = [(k, i, draw.choice(["call", "call", "response", "note"]), draw.choice(["a", None, "c"])) for k in (1, 2, None) for i in range(60)]
    want = []
    for k, i, kind, v in events:
        if kind == "call":
            later = [e for e in events if e[0] == k and e[1] > i and e[2] == "response" and e[3] is not None]
            want.append((k, i, v, later[0][3] if later else None))
    got = [tuple(r) for r in transcripts.first_response(spark.createDataFrame(events, "k int, pos int, kind string, value string"), "k").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hot_hash_makes_as_many_pairs_as_its_rarer_side(spark):
    rows = spark.range(25_000).selectExpr("if(id < 20500, 'h', concat('x', id)) AS hash", "id % 2 = 0 AS v", "id")
    met, left = selection.rank_pairs(rows, "hash", "v", ["id"])
    got = met.selectExpr("hash", "vulnerable.id AS a", "fixed.id AS b").collect()
    assert len(got) == 10_250 and all(r.b == r.a + 1 for r in got)
    assert left.count() == 4_500 and left.where("hash = 'h'").count() == 0


def test_pairs_with_repeats_nulls_and_leftovers(spark):
    rows = spark.createDataFrame([("a", True, 1), ("a", True, 1), ("a", False, 2), (None, True, 3), ("b", None, 4), ("c", False, 5)], "hash string, v boolean, n int")
    met, left = selection.rank_pairs(rows, "hash", "v")
    assert [(r.hash, r.vulnerable.n, r.fixed.n) for r in met.collect()] == [("a", 1, 2)]
    assert sorted((tuple(r) for r in left.collect()), key=str) == sorted([("a", True, 1), (None, True, 3), ("b", None, 4), ("c", False, 5)], key=str)
    met, left = selection.rank_pairs(rows.where("false"), "hash", "v")
    assert met.count() == left.count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 999, 5000])
@pytest.mark.parametrize("kind", ["ties", "doubles", "wide"])
def test_median_is_exact(spark, monkeypatch, n, kind):
    monkeypatch.setattr(metrics, "CUTS", 16)
    draw = random.Random(n)
    make = {"ties": lambda: float(draw.randrange(7)), "doubles": draw.random, "wide": lambda: draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300)}[kind]
    values = [make() for _ in range(n)]
    frame = spark.createDataFrame([(True, v) for v in values] + [(False, 1.0), (True, None)], "ok boolean, v double")
    assert metrics.actions_per_solve(frame, "ok", "v").first()[0] == (statistics.median(values) if n else None)


def test_shares_over_time_with_empty_hours_and_null_commands(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "ls"), ("2024-01-01 00:20:00", None), ("2024-01-01 02:59:59", "rg"), (None, "cat")], "t string, cmd string").selectExpr("cast(t as timestamp) AS t", "cmd")
    got = {(r.bucket.hour, r.cmd): (r.n, r.share) for r in metrics.shares_over_time(rows, "t", "cmd").collect()}
    assert got == {(h, c): (0, 0.0) for h in range(3) for c in ("ls", "rg", None)} | {(0, "ls"): (1, 0.5), (0, None): (1, 0.5), (2, "rg"): (1, 1.0)}
    assert metrics.shares_over_time(rows.where("false"), "t", "cmd").count() == 0


def test_repeated_rollouts_stay_as_many_as_they_are(spark):
    patch = "diff --git a/f b/f\n@@ -1 +1 @@\n-a\n+b\n"
    rows = [("a#1", 2, "ok", patch, patch, patch), ("a", 1, "ok", patch, patch, None), (None, None, "ok", patch, None, patch)] * 2 + [("x", 1, "failed", patch, patch, patch)]
    got = pipelines.curate(spark.createDataFrame(rows, "instance_id string, rollout_no int, status string, patch string, test_patch string, generated_diff string"))
    found = sorted(((r.instance_id, r.reward) for r in got.collect()), key=str)
    assert found == sorted([("a", 0.0), ("a", 0.0), ("a#1", 1.0), ("a#1", 1.0), (None, 0.6), (None, 0.6)], key=str)


def test_last_line_of_a_stream_is_that_of_the_batch_merge(spark, tmp_path):
    for shard, lines in {"shard_2": ['{"instance_id":"a","v":1}'], "shard_10": ['{"instance_id":"a","v":2}', "{bad", "", '{"instance_id":"a","v":3}', '{"instance_id":"0","v":4}', '{"instance_id":0}'], "odd": []}.items():
        (tmp_path / "in" / shard).mkdir(parents=True)
        (tmp_path / "in" / shard / "preds.jsonl").write_text("\n".join(lines))
    stream = predictions.latest(predictions.stream_predictions(spark, str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("latest_lines").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.instance_id: r.line for r in spark.table("latest_lines").collect()} == {"a": '{"instance_id":"a","v":3}', "0": '{"instance_id":"0","v":4}'}


def test_ids_by_their_truth(spark):
    lines = spark.createDataFrame([('{"instance_id": {}}',), ('{"instance_id": 1e-400}',), ('{"instance_id": "x"}',), ("{}",), ("7",)], "line string")
    good, bad = io.scan_predictions(lines)
    assert [r.instance_id for r in good.collect()] == ["x"] and bad.count() == 4


def test_heavy_pairs_have_tasks_of_their_own_and_ratios_stay(spark, monkeypatch):
    monkeypatch.setattr(diffs, "HEAVY", 10_000)
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abc\n") for _ in range(n))
    pairs = [(i, text(draw.randrange(30)), text(draw.randrange(30))) for i in range(400)] + [(1000 + i, text(150 + 10 * i), text(200)) for i in range(12)] + [(2000, None, "a"), (2001, None, None), (2002, "x" * 900, "x" * 900)]
    frame = spark.createDataFrame(pairs, "k long, a string, b string").repartition(3)
    got = {r.k: (r.chars, r.lines) for r in diffs.with_ratios(frame, chars=("a", "b", False), lines=("a", "b", True)).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert got == {k: (ratio(a or "", b or ""), ratio((a or "").splitlines(), (b or "").splitlines())) for k, a, b in pairs}
    heavy = spark.createDataFrame([(i, 10_000 if i else 10**9) for i in range(40)], "k long, cost_ long").repartition(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = diffs.heavy_groups(heavy, 10**8).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.max("cost_").alias("most")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(p.n for p in parts) == 40 and max(p.n for p in parts if p.most == 10**9) <= 8 and len(parts) >= 8
    assert diffs.with_ratios(frame.where("false"), r=("a", "b", False)).count() == 0


def machine(text):
    """Blocks of a loop over lines."""
    out, lines, open_ = [], text.split("\n"), None
    for i, line in enumerate(lines):
        if re.match(r"<{3,}\s*SEARCH", line):
            open_, width, best, at = i, len(re.match("<+", line)[0]), 9, None
        elif open_ is not None and re.match("={5,}", line):
            bare = re.fullmatch(r"=+\s*", line)
            rank = 1 if bare and len(re.match("=+", line)[0]) == width else 2 if bare else 3
            if rank < best:
                best, at = rank, i
        elif open_ is not None and re.match(r">{3,}\s*REPLACE", line):
            if at is not None:
                out.append(("\n".join(lines[open_ + 1 : at]), "\n".join(lines[at + 1 : i])))
            open_ = None
    return out


def test_marker_lines_are_read_as_by_a_loop(spark):
    draw = random.Random(6)
    kinds = ["<<<<<<< SEARCH", "<<<<< SEARCH x", "=======", "=====", "====== x", ">>>>>>> REPLACE", ">>>REPLACE", "code", "", " =======", "<< SEARCH"]
    texts = ["\n".join(draw.choice(kinds) for _ in range(draw.randrange(14))) for _ in range(600)] + [""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: [(b.search, b.replace) for b in r.blocks] for r in frame.select("i", diffs.parse_blocks("t").alias("blocks")).collect()}
    assert got == {i: machine(t) for i, t in enumerate(texts)} | {-1: []}


def tower(levels, n):
    """Functions inside functions, each with names and strings of its own."""
    out = []
    for i in range(levels):
        pad = "  " * i
        out += [f"{pad}@deco('d{i}')", f"{pad}{'async ' if i % 3 == 0 else ''}def f{n}_{i}(a{i}, b=('x', 1)):", f"{pad}  'doc {n} {i}'", f"{pad}  v{i}, w = 'FROM', [1 for q in range(2)]", f"{pad}  with open('p') as h{i}: pass"]
    return "\n".join(out)


def test_functions_hold_what_a_walk_of_each_finds():
    content = "\n".join([*(tower(5, n) for n in range(3)), "class C:\n  x: int = 1\n  def m(self):\n    'doc'\n    for i in 'abc':\n      y: str = 's'\n", "z = 'outer'"])
    found = mining.functions_of(ast.parse(content))
    assert [f.node.name for f in found] == [x.name for x in ast.walk(ast.parse(content)) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
    for f in found:
        assert f.names == {n for x in ast.walk(f.node) for n in mining._assigned(x)}
        assert [v for _, v in sorted(f.literals, key=lambda x: x[0])] == [x.value for x in ast.walk(f.node) if isinstance(x, ast.Constant) and isinstance(x.value, str)]


def test_a_file_of_nested_functions_is_walked_once():
    content = "\n".join(tower(45, n) for n in range(45))
    tree = ast.parse(content)
    began = time.process_time()
    found = mining.functions_of(tree)
    assert len(found) == 45 * 45 and time.process_time() - began < 1.5
