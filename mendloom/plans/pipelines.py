"""Composed jobs: dataset builds, curation, recovery, selection, prediction write-out and shard merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendloom.functions import chat, diffs, prompts, text
from mendloom.operators import mining, rewards, selection
from mendloom.sources import io


def docstring_tasks(files: DataFrame, least: int = 50, most_vars: int = 15, whole: bool = False) -> DataFrame:
    """Functions of good docstring and code, with a masked file each, and the ``whole`` file if asked for."""
    return mining.mine(files, whole=whole).where(mining.good_docstring(least) & mining.code_reject(most_vars).isNull())


def repair_dataset(pairs: DataFrame, key: str, most: int = 2048, context: int = 0, system: str = prompts.REPAIR_SYSTEM, seed: int = 42) -> DataFrame:
    """From (key, before_code, after_code, description): prompts that fit, diffs as answers, a seeded order column."""
    made = pairs.withColumn("diffs", diffs.render_blocks(diffs.diff_blocks("before_code", "after_code", context)))
    made = made.withColumn("user_prompt", prompts.repair_prompt("before_code", F.col("description")))
    kept = prompts.by_length(made, system, most)
    return kept.withColumns({"prompt": prompts.chat(system, "user_prompt"), "answer": F.col("diffs"), "shuffled": selection.shuffle_key(F.col(key), seed)})


def classification_dataset(rows: DataFrame, key: str, most: int = 2048, system: str = prompts.CLASSIFY_SYSTEM, seed: int = 42) -> DataFrame:
    """From (key, code, label, description): prompts that fit, labels as answers, a seeded order column."""
    made = rows.withColumn("user_prompt", prompts.classification_prompt("code", F.col("description")))
    kept = prompts.by_length(made, system, most)
    return kept.withColumns({"prompt": prompts.chat(system, "user_prompt"), "answer": F.col("label"), "shuffled": selection.shuffle_key(F.col(key), seed)})


def stack_dataset(tasks: DataFrame, key: str, **how) -> DataFrame:
    """Masked file to whole file, described by name, span and docstring."""
    described = prompts.docstring_description("function_name", "start_line", "end_line", "docstring")
    return repair_dataset(tasks.select(key, F.col("masked_code").alias("before_code"), F.col("content").alias("after_code"), described.alias("description")), key, **how)


def vulnerability_repair(rows: DataFrame, **how) -> DataFrame:
    """Vulnerable function to its fix, by hash and place within it; type Other is left out."""
    met, _ = selection.rank_pairs(rows.where(~F.array_contains("cwe", "Other")), "hash", "is_vulnerable")
    described = prompts.vulnerability_description("vulnerable.cwe", "vulnerable.cwe_description")
    return repair_dataset(met.select("hash", F.col("vulnerable.func").alias("before_code"), F.col("fixed.func").alias("after_code"), described.alias("description")), "hash", **how)


def vulnerability_detection(rows: DataFrame, allowed: list[str], **how) -> DataFrame:
    """Vulnerable functions of the allowed types, labelled by type."""
    kept = rows.where(F.col("is_vulnerable") & F.get("cwe", 0).isin(allowed))
    return classification_dataset(kept.select("hash", F.col("func").alias("code"), F.get("cwe", 0).alias("label"), F.lit(None).cast("string").alias("description")), "hash", **how)


def multilingual_mix(a: DataFrame, b: DataFrame, key: str, n_a: int, n_b: int, blocked: str, seed: int = 42) -> DataFrame:
    """First rows of two tables together in a seeded order, without the blocked repository; rows without one stay."""
    both = selection.first_rows(a, [key], n_a).unionByName(selection.first_rows(b, [key], n_b), allowMissingColumns=True)
    return both.where(~F.col("repo").eqNullSafe(blocked)).withColumn("shuffled", selection.shuffle_key(F.col(key), seed))


def curate(rollouts: DataFrame) -> DataFrame:
    """Rollouts that didn't fail, with their rewards: a row for each, whatever its ids and however often it is repeated.

    Rewards depend on the three patches alone, so each combination of patches is scored once and joined by its digest.
    """
    ok = rollouts.where("status = 'ok'").withColumn("key_", F.sha2(F.to_json(F.struct("patch", "test_patch", "generated_diff"), {"ignoreNullFields": "false"}), 256))
    once = ok.select("key_", "patch", "test_patch", "generated_diff").dropDuplicates(["key_"])
    same = rewards.patch_similarity(once, "key_").withColumnRenamed("similarity", "similarity_reward")
    tests = rewards.patch_similarity(once, "key_", "test_patch").withColumnRenamed("similarity", "test_similarity_reward")
    scored = ok.join(same.join(tests, "key_"), "key_").withColumn("file_match_reward", rewards.file_match("patch", "generated_diff"))
    return scored.withColumn("reward", rewards.curation_reward("file_match_reward", "similarity_reward", "test_similarity_reward")).drop("key_")


def recover(folders: DataFrame, as_of: Column, hours: int, model: str) -> DataFrame:
    """Recent rollouts of a model from complete history folders (dir, metadata, diff, messages, tools), with reward -1.

    Messages are the lines before the first bad one; folders with broken JSON, blank diffs or no messages drop out.
    """
    kept = _of_model(folders.where(selection.recent(F.col("dir"), as_of, hours)), model)
    return _recovered(kept.withColumn("messages", io.log_messages("messages")))


def _of_model(folders: DataFrame, model: str) -> DataFrame:
    kept = folders.where(F.try_parse_json("metadata").isNotNull() & F.try_parse_json("tools").isNotNull())
    return kept.where(F.contains(F.coalesce(F.get_json_object("metadata", "$.model"), F.lit("")), F.lit(model)) & (F.length(text.strip("diff")) > 0))


def _recovered(kept: DataFrame) -> DataFrame:
    return kept.where(F.size("messages") > 0).select("dir", "messages", "tools", F.lit(-1.0).alias("reward"), chat.first_user("messages").alias("problem_statement"), F.col("diff").alias("generated_diff"))


def recover_from(spark: SparkSession, root: str, as_of: Column, hours: int, model: str, parts: bool = False) -> DataFrame:
    """``recover`` of the history folders on disk under ``root``: old folders are passed by unread, and message logs may be of any size."""
    return _recovered(_of_model(io.history_folders(spark, root, selection.recent(F.col("dir"), as_of, hours), parts), model))


def select_for_training(rows: DataFrame, reward_min: float = 0.2) -> DataFrame:
    """Rows of a reward above the least; an empty result is an error."""
    kept = rows.where(F.col("reward") > reward_min)
    if kept.isEmpty():
        raise ValueError(f"no row has a reward above {reward_min}")
    return kept


def predictions(inputs: DataFrame, results: DataFrame, model: str, scaffold: str = "agent", spec: str = "") -> DataFrame:
    """A prediction for every input of the slice, empty where no result has a patch."""
    taken = selection.sliced(inputs.select("instance_id"), ["instance_id"], spec)
    joined = taken.join(results, "instance_id", "left")
    patch = text.first_full(*(c for c in text.PATCH_COLUMNS if c in results.columns))
    return joined.select("instance_id", F.lit(f"{scaffold}-{model}").alias("model_name_or_path"), patch.alias("model_patch"))


def merge_shards(lines: DataFrame, keep: str = "first") -> DataFrame:
    """One row per instance from (instance_id, shard, line, ...), first or last, with the place of its first sight."""
    kept = selection.keep_one(lines, "instance_id", ["shard", "line"], keep)
    return selection.numbered(kept, ["first_seen"], "place").drop("first_seen")


def score_task(rows: DataFrame, key: str, scorers: dict[str, tuple[Callable[[DataFrame], Column], float]]) -> DataFrame:
    """Weighted reward of a task's rows from its scorers."""
    named = F.create_map(*(x for name, (score, _) in scorers.items() for x in (F.lit(name), score(rows))))
    return rewards.weighted(rows.select(key, F.explode(named).alias("name", "score")), {n: w for n, (_, w) in scorers.items()}, key)
