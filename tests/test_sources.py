"""Trees, history folders and versioned datasets on disk."""

import json

import pytest
from pyspark.sql import functions as F

from mendloom.plans import pipelines
from mendloom.sources import io


def test_trees_are_listed_in_order(spark, tmp_path):
    for folder, name in {"b/shard_2": "preds.jsonl", "b/shard_10": "preds.jsonl", "a/deep/shard-11": "preds.jsonl", "c/shard_x": "preds.jsonl", "shard_1": "other.txt", "shard_4": None}.items():
        (tmp_path / folder).mkdir(parents=True)
        if name:
            (tmp_path / folder / name).write_text("x\ny\n")
    found = io.discover(spark, str(tmp_path), "preds.jsonl").orderBy("place").collect()
    assert [(r.place, r.folder, r.bytes) for r in found] == [(0, "shard_2", 4), (1, "shard_10", 4), (2, "shard-11", 4), (3, "shard_x", 4)]
    lines = io.discovered_lines(spark, str(tmp_path), "preds.jsonl").orderBy("place", "line_no").collect()
    assert [(r.place, r.line_no, r.line) for r in lines] == [(p, n, v) for p in range(4) for n, v in enumerate("xy")]
    for nothing in (str(tmp_path / "missing"), str(tmp_path / "shard_4")):
        assert io.discover(spark, nothing, "*").count() == io.discovered_lines(spark, nothing, "*").count() == 0


def folder(root, name, messages, model="m1", diff="d", tools="[]", leave_out=()):
    (root / name).mkdir()
    for file, value in {"metadata.json": json.dumps({"model": model}), "diff.txt": diff, "messages.jsonl": messages, "tools.json": tools}.items():
        if file not in leave_out:
            (root / name / file).write_text(value)


def test_a_long_log_among_odd_folders_is_recovered(spark, tmp_path):
    said = [json.dumps({"role": "user", "content": f"fix {'x' * 200} {i}"}) for i in range(40_000)]
    folder(tmp_path, "2025-01-02T00.00.00-1", "\n".join(said[:30_000] + ["", "{bad"] + said[30_000:]))
    folder(tmp_path, "2025-01-02T00.00.00-2", said[0], leave_out=["tools.json"])
    folder(tmp_path, "2025-01-02T00.00.00-3", "{bad\n" + said[0])
    folder(tmp_path, "2025-01-02T00.00.00-4", said[0], diff=" \n")
    folder(tmp_path, "2025-01-02T00.00.00-5", said[0], model="other")
    folder(tmp_path, "2025-01-02T00.00.00-6", said[0], tools="{bad")
    folder(tmp_path, "2020-01-02T00.00.00-7", said[0])
    folder(tmp_path, "notes", said[0])
    folder(tmp_path, "2025-01-02T00.00.00-8", json.dumps({"role": "system", "content": "s"}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # the log is read in several blocks
    try:
        got = pipelines.recover_from(spark, str(tmp_path), F.lit("2025-01-02 01:00:00").cast("timestamp"), 5, "m")
        rows = {r.dir[-1]: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(rows) == {"1", "8"}
    assert [m.content for m in rows["1"].messages] == [json.loads(x)["content"] for x in said[:30_000]]
    assert rows["1"].problem_statement == json.loads(said[0])["content"] and rows["8"].problem_statement == ""


@pytest.mark.parametrize("as_json", [False, True])
def test_versions_keep_their_order(spark, tmp_path, as_json):
    root, schema = str(tmp_path), "k long, v string"
    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "if(id % 7 = 0, null, concat('é', id)) AS v").repartition(4)
    for version in ("v1", "v9", "v10"):
        io.write_version(rows.where(f"k < {4000 + len(version) * 500}"), root, "owner/data set", version, ["k"], as_json)
    assert io.versions(spark, root, "owner/data set") == ["v1", "v9", "v10"]
    got = io.read_version(spark, root, "owner/data set", schema, as_json=as_json).collect()
    assert len(got) == 5000 and all(r.k == r.place for r in got) and sum(r.v is None for r in got) == 715
    assert io.read_version(spark, root, "owner/data set", schema, "v9", as_json).count() == 5000
    with pytest.raises(ValueError, match="already"):
        io.write_version(rows, root, "owner/data set", "v9", ["k"], as_json)
    (tmp_path / "owner_data_set" / "v11" / "data").mkdir(parents=True)  # begun, not finished
    assert io.versions(spark, root, "owner/data set")[-1] == "v10"
    for version in ("v11", "v12"):
        with pytest.raises(ValueError, match="no finished version"):
            io.read_version(spark, root, "owner/data set", schema, version, as_json)
    with pytest.raises(ValueError, match="no finished version"):
        io.read_version(spark, root, "nothing", schema)
    io.write_version(rows.where("false"), root, "empty", "1", ["k"], as_json)
    assert io.read_version(spark, root, "empty", schema, as_json=as_json).count() == 0


def test_thousands_of_history_folders_take_seconds(spark, tmp_path):
    import time

    from mendloom.plans import registry

    turns = spark.range(12_000).selectExpr("id div 4 AS conv_id", "id % 4 AS turn", "concat('r', id) AS role", "'t' AS text")
    turns.where("conv_id % 10 <> 3 or turn <> 2").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.time()
    got = registry.queries()["s6_history_folders"](spark, str(tmp_path)).collect()
    assert time.time() - began < 40
    assert sorted((r.dir, r.diff, r.tools) for r in got) == [(c, f"r{4 * c + 1}", f"r{4 * c + 3}") for c in range(3000) if c % 10 != 3]


def test_files_of_several_lines_and_odd_folders(spark, tmp_path):
    from mendloom.sources import folders

    rows = spark.range(300).selectExpr("concat('d', id % 3) AS dir", "if(id % 2 = 0, 'messages.jsonl', 'diff.txt') AS name", "id AS nth", "if(id = 4, null, concat('é', id)) AS value")
    folders.write_files(rows, f"file://{tmp_path}/h", ["nth"])
    (tmp_path / "h" / ".hidden").mkdir()
    (tmp_path / "h" / "empty").mkdir()
    got = {r.dir: r for r in folders.history_values(spark, f"file://{tmp_path}/h", F.col("dir") != "d2", 500, 400).collect()}
    text = lambda d, odd: "".join(("" if i == 4 else f"é{i}") + "\n" for i in range(300) if i % 3 == d and i % 2 == odd)
    assert set(got) == {"d0", "d1", "empty"} and got["d0"].diff == text(0, 1) and got["empty"].log_bytes is None
    assert [got["d1"].messages, got["d1"].log_bytes] == [text(1, 0) if len(text(1, 0).encode()) <= 400 else None, len(text(1, 0).encode())]
    assert sorted(p.name for p in (tmp_path / "h" / "d0").iterdir()) == ["diff.txt", "messages.jsonl"]
    for bad in ("a/b", "..", None):
        with pytest.raises(Exception, match="names no file"):
            folders.write_files(rows.withColumn("dir", F.lit(bad).cast("string")), f"file://{tmp_path}/bad", ["nth"])


def test_thousands_of_folders_are_recovered_in_seconds(spark, tmp_path):
    import time

    from mendloom.plans import registry

    turns = spark.range(12_000).selectExpr("id div 4 AS conv_id", "id % 4 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t\\n', id) AS text")
    turns.unionByName(turns.limit(1).withColumn("conv_id", F.lit(None).cast("long"))).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.time()
    got = registry.queries()["g10_recovery_from_disk"](spark, str(tmp_path)).collect()
    assert time.time() - began < 40
    want = [(c, 2 if c % 5 == 0 else 4, f"t\n{4 * c}") for c in range(3000) if c % 100 > 50 and c % 3 and c % 2]
    assert sorted((r.conv_id, r.messages, r.problem_statement) for r in got) == want


def test_large_and_small_logs_give_the_same(spark, tmp_path):
    for i in range(12):
        said = [json.dumps({"role": "user", "content": f"é{i} {n}"}) for n in range(1 + 40 * (i % 3))]
        folder(tmp_path, f"d{i}", ("\r\n" if i % 2 else "\n").join([*said, "", *(["{bad", said[0]] if i % 4 == 0 else [])]), leave_out=["diff.txt"] if i == 7 else ["messages.jsonl"] if i == 8 else ())
    folder(tmp_path, "bad", "{bad\n")
    folder(tmp_path, "nothing", "")
    got = [sorted((r.dir, [m.content for m in r.messages]) for r in io.history_folders(spark, f"file://{tmp_path}", F.col("dir") != "d1", most_log=most).collect()) for most in (8 << 20, 500, 0)]
    assert got[0] == got[1] == got[2] and [d for d, _ in got[0]] == sorted(f"d{i}" for i in range(12) if i not in (1, 7, 8))
    assert dict(got[0])["d2"] == [f"é2 {n}" for n in range(81)]
