"""Transcript rewards, mining, recovery and readers on small cases."""

import json

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from mendloom.operators import mining, selection, transcripts
from mendloom.plans import derive, pipelines
from mendloom.sources import io


def call(cmd, response="ok"):
    text = f"<tool_call>{json.dumps({'name': 'shell', 'arguments': {'cmd': cmd}})}</tool_call>"
    return text + ("" if response is None else f"\n<tool_response>{response}</tool_response>\n")


def scores(spark, *turns):
    found = transcripts.calls(spark.createDataFrame([(1, "".join(turns))], "id long, completion string"), "id")
    return [(r.habits, d.depth) for r, d in zip(transcripts.habits(found, "id").collect(), transcripts.depth(found, "id").collect(), strict=True)]


FAIL = "command failed with exit code 2"


@pytest.mark.parametrize(
    ("turns", "habits", "depth"),
    [
        ([call("ls")], 0.3, 0.0),
        ([call("echo a"), call("echo b"), call("ls")], 0.0, 0.0),
        ([call("rg x")], 0.4, 0.0),
        ([call("rg x", FAIL)], 0.0, 0.0),
        ([call("echo a"), call("echo b"), call("sed -n '1,2p' f.py")], 0.3, 0.2),
        ([call("rg -n x", "src/a.py: x"), call("sed -n '1,2p' src/a.py")], 0.4, 0.25),
        ([call("echo a"), call("echo b"), call("echo c"), call("x", FAIL), call("y", FAIL), call("z", FAIL)], 0.0, 0.1),
        ([call("rg -n x", "ok")], 0.4, 0.15),
        ([call("echo a", "[truncated]"), call("rg -n x")], 0.4, 0.05),
        ([call("x", FAIL), call("x", FAIL)], 0.0, 0.0),
    ],
)
def test_rewards_of_transcripts(spark, turns, habits, depth):
    assert scores(spark, *turns) == [(pytest.approx(habits), pytest.approx(depth))]


def test_broken_blank_and_numeric_commands_are_no_calls(spark):
    text = "<tool_call>{bad}</tool_call>" + call(" ") + '<tool_call>{"arguments":{"cmd":5}}</tool_call>' + call("ls", None)
    found = transcripts.calls(spark.createDataFrame([(1, text)], "id long, completion string"), "id").collect()
    assert [(r.cmd, r.ok, r.response) for r in found] == [("ls", False, "")]


def test_calls_by_rows_and_by_windows_are_the_same(spark):
    odd = call("ls", None) + "<tool_response>a</tool_response>" + call("rg x", None) + call("cat y", " late ") + "<tool_call>{bad}</tool_call>" + call("end", None)
    rows = spark.createDataFrame([(1, odd), (2, ""), (3, None)], "id long, completion string")
    events = derive.transcripts(derive.table(spark, DATA, "events")).withColumnRenamed("session", "id")
    for frame in (rows, events):
        assert sorted(map(tuple, transcripts.calls(frame, "id").collect())) == sorted(map(tuple, transcripts.calls_by_window(frame, "id").collect()))


def test_functions_are_mined_and_bad_files_skipped(spark):
    good = 'class A:\n    @property\n    def f(self):\n        """Doc."""\n        def g():\n            "inner"\n        return 1\n'
    files = spark.createDataFrame([(1, good), (2, "def ("), (3, None), (4, "")], "file_id long, content string")
    found = mining.mine(files).orderBy("start_line").collect()
    assert [(r.file_id, r.function_name, r.start_line, r.end_line, r.is_property) for r in found] == [(1, "f", 2, 7, True), (1, "g", 5, 6, False)]
    assert found[0].masked_code == "class A:\n# MASKED: f function (lines 2-7)"


@pytest.mark.parametrize(("spec", "count"), [("", 7), (":3", 3), ("2:4", 2), ("5:99", 2), ("3:3", 0)])
def test_slices(spark, spec, count):
    assert selection.sliced(spark.range(7), ["id"], spec).count() == count


@pytest.mark.parametrize("spec", ["-1:3", "4:2"])
def test_bad_slices(spec):
    with pytest.raises(ValueError):
        selection.slice_bounds(spec)


@pytest.mark.parametrize("parts", [1, 8])
def test_numbers_and_shards_do_not_depend_on_partitions(spark, parts):
    got = selection.sharded(spark.range(10).repartition(parts), ["id"], 3).orderBy("id").collect()
    assert [r.shard for r in got] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert [r.row_no for r in got] == list(range(10))


def test_split_is_disjoint_and_complete(spark):
    rows = spark.range(500)
    hold, rest = selection.hash_split(rows, "id", 0.25, True), selection.hash_split(rows, "id", 0.25, False)
    assert hold.count() + rest.count() == 500 and hold.intersect(rest).count() == 0
    assert selection.hash_split(rows, "id", 0.0, True).count() == 0 and selection.hash_split(rows, "id", 1.0, True).count() == 500


def test_history_folders_on_disk(spark, tmp_path):
    for name, files in {"2025-01-02T00.30.00-a": 4, "2025-01-02T00.30.00-b": 3, "2024-01-01-c": 4}.items():
        folder = tmp_path / name
        folder.mkdir()
        texts = {"metadata.json": '{"model":"m"}', "diff.txt": "d", "messages.jsonl": '{"role":"user","content":"hi"}\n{bad\n', "tools.json": "[]"}
        for f, t in list(texts.items())[:files]:
            (folder / f).write_text(t)
    got = pipelines.recover(io.history(spark, str(tmp_path)), F.lit("2025-01-02 01:00:00").cast("timestamp"), 5, "m").collect()
    assert [(r.dir, r.problem_statement, len(r.messages)) for r in got] == [("2025-01-02T00.30.00-a", "hi", 1)]


def test_shards_merge_from_files(spark, tmp_path):
    for shard, lines in {"shard_2": ['{"instance_id":"a","v":1}', "", "{bad"], "shard_10": ['{"instance_id":"a","v":2}', '{"instance_id":"b","v":3}', "[1]"]}.items():
        (tmp_path / shard).mkdir()
        (tmp_path / shard / "preds.jsonl").write_text("\n".join(lines))
    good, bad = io.scan_predictions(io.numbered_lines(spark, f"{tmp_path}/*/preds.jsonl"))
    placed = good.select("instance_id", io.shard_number(F.col("file")).alias("shard"), F.col("line_no").alias("line"), F.get_json_object("line", "$.v").alias("v"))
    assert [(r.instance_id, r.v) for r in pipelines.merge_shards(placed).orderBy("place").collect()] == [("a", "1"), ("b", "3")]
    assert sorted((r.instance_id, r.v) for r in pipelines.merge_shards(placed, "last").collect()) == [("a", "2"), ("b", "3")]
    assert bad.count() == 2


def test_selection_of_nothing_is_an_error(spark):
    with pytest.raises(ValueError):
        pipelines.select_for_training(spark.createDataFrame([(-1.0,)], "reward double"), -1)


def test_stream_of_predictions(spark, tmp_path):
    from mendloom.streaming.predictions import latest, stream_predictions

    (tmp_path / "shard_1").mkdir()
    (tmp_path / "shard_1" / "preds.jsonl").write_text('{"instance_id":"a"}\n{bad\n[1]\n')
    query = latest(stream_predictions(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("merged").start()
    query.processAllAvailable()
    query.stop()
    assert [r.instance_id for r in spark.table("merged").collect()] == ["a"]


def test_lines_are_numbered_over_blocks_of_a_file(spark, tmp_path):
    from mendloom.sources import io

    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(20_000)))
    (tmp_path / "b.txt").write_text("x\n\ny\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = io.numbered_lines(spark, f"file://{tmp_path}")
        assert got.where("line like 'line %' and line <> concat('line ', line_no)").isEmpty() and got.where("file like '%a.txt'").count() == 20_000
        assert [(r.line_no, r.line) for r in got.where("file like '%b.txt'").orderBy("line_no").collect()] == [(0, "x"), (1, ""), (2, "y")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_history_files_over_the_bound_are_named(spark, tmp_path):
    from mendloom.sources import io

    for folder, size in (("d1", 10), ("d2", 5000)):
        (tmp_path / folder).mkdir()
        for name in ("metadata.json", "diff.txt", "messages.jsonl", "tools.json"):
            (tmp_path / folder / name).write_text("x" * (size if name == "diff.txt" else 3))
    root = f"file://{tmp_path}"
    assert [r.dir for r in io.history(spark, root, 1000).collect()] == ["d1"]
    assert [r.bytes for r in io.oversized(spark, root, 1000).collect()] == [5000]


def test_slices_and_patch_columns(spark):
    from mendloom.operators import selection
    from mendloom.plans import pipelines

    ids = spark.range(50).withColumnRenamed("id", "k")
    for spec in ("10:", "5:20", ":7", "45:99", ""):
        a, _, b = spec.partition(":")
        want = list(range(50))[int(a or 0) : int(b) if b else None]
        assert sorted(r.k for r in selection.sliced(ids, ["k"], spec).collect()) == want
    results = spark.createDataFrame([("a", "", None, "d"), ("b", None, None, "")], "instance_id string, generated_diff string, diff string, model_patch string")
    got = pipelines.predictions(results.select("instance_id"), results, "m").orderBy("instance_id").collect()
    assert [r.model_patch for r in got] == ["d", ""]


def test_tokens_of_a_file(spark):
    import pytest

    tokens = pytest.importorskip("public_tokenizers")
    from mendloom.functions.tokens import id_counter
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("hello world",), (None,)], "x string").select(id_counter(spark, tokens.path("byte_bpe_50k.json"))(F.col("x")).alias("n")).collect()
    assert sorted(r.n for r in got) == [0, 2]


def test_small_events_of_large_texts_are_dealt_to_many_tasks(spark, tmp_path):
    from mendloom.plans import derive, registry

    rows = spark.range(700).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id % 5 AS user_id", "'view' AS event_type")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert derive.transcripts(spark.read.parquet(f"{tmp_path}/events.parquet")).rdd.getNumPartitions() >= 16
    for name in ("q9_terminal_habits", "q10_exploration_depth"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == 35


def test_bodies_between_tags_are_those_of_the_pattern(spark):
    from mendloom.operators import transcripts

    pieces = ["<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>", "{", "}", " ", " ", "\x0b\n", "é", '{"arguments":{"cmd":" ls "}}']
    texts = [(i, "".join(pieces[(i * 7919 * (n + 3) + n * n * (i % 13)) % 11] for n in range(60))) for i in range(400)]
    texts += [(400, "<tool_response>\t \n</tool_response><tool_call> \r\n{ a } \x0c</tool_call>"), (401, None)]
    df = spark.createDataFrame(texts, "k long, completion string")
    for kind, pattern in (("call", transcripts.CALL), ("response", transcripts.RESPONSE)):
        got = sorted((r.k, r.start, r.end, r.body) for r in transcripts.matches(df, "k", "completion", pattern, kind).collect())
        want = sorted((r.k, r.s.start, r.s.end, r.s.body) for r in df.select("k", F.explode(transcripts.spans("completion", pattern)).alias("s")).collect())
        assert got == want and len(got) > 10
