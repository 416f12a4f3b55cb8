"""The mining queries on a table of one row group."""

import pytest
from pyspark.sql import functions as F

from mendloom.operators import mining
from mendloom.plans import registry

NAMES = [
    "g2_stack_dataset",
    "a8_common_names",
    "t1_mine_forms",
    "f10_docstring_quality",
    "g1_docstring_tasks",
    "a7_task_statistics",
    "a9_quality_funnel",
    "t1_mine_functions",
    "f11_code_quality",
]


@pytest.mark.parametrize("name", NAMES)
def test_files_are_dealt_to_all_tasks_before_they_are_parsed(spark, tmp_path, name):
    spark.range(40).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    lines = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    mined = [i for i, s in enumerate(lines) if "MapInArrow" in s]
    assert len(mined) == 1 and "Repartition" in lines[mined[0] + 1]


DEALT_BY_HASH = [
    "a8_common_names",
    "t1_mine_forms",
    "f10_docstring_quality",
    "g1_docstring_tasks",
    "a7_task_statistics",
    "a9_quality_funnel",
    "t1_mine_functions",
    "f11_code_quality",
]


@pytest.mark.parametrize("name", DEALT_BY_HASH)
def test_files_are_dealt_without_being_sorted(spark, tmp_path, name):
    spark.range(40).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange hashpartitioning(file_id" in plan and "RoundRobin" not in plan


def test_files_of_one_key_are_dealt_to_several_tasks(spark):
    files = spark.range(200).selectExpr("CAST(NULL AS long) AS file_id", "concat('def f():\\n    \"doc ', id, '\"\\n') AS content")
    got = mining.mine(files.coalesce(1)).select(F.spark_partition_id().alias("p"), "docstring").collect()
    assert len({r.docstring for r in got}) == 200 and len({r.p for r in got}) >= 10


def test_whole_files_come_with_their_functions(spark):
    files = spark.createDataFrame([(1, 'def f():\n    "doc"\n\ndef g():\n    "doc"\n'), (2, None), (3, "x = 1"), (4, 'def f():\n    "é"')], "file_id long, content string")
    got = mining.mine(files.coalesce(1), whole=True)
    assert sorted((r.file_id, r.function_name, r.content) for r in got.collect()) == [(1, "f", files.first().content), (1, "g", files.first().content), (4, "f", 'def f():\n    "é"')]
    assert "content" not in mining.mine(files).columns and got.select(F.col("content")).count() == 3
