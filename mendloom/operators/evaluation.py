"""Evaluation inputs and results: names, run ids, missing shards, summaries and user functions over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendloom.functions.text import col, run_tag


def eval_inputs(df: DataFrame) -> DataFrame:
    """Problems as an evaluation harness takes them; a missing version is empty."""
    version = F.coalesce("version", F.lit("")) if "version" in df.columns else F.lit("")
    return df.select("instance_id", "repo", "base_commit", "problem_statement", "patch", "test_patch", version.alias("version"))


def constant_prompt(df: DataFrame, prompt: str = "Dummy") -> DataFrame:
    """``df`` with one prompt for all rows."""
    return df.withColumn("prompt", F.lit(prompt))


def declared(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in a declared schema: columns by name, safely cast."""
    return df.to(df.sparkSession.createDataFrame([], schema).schema)


def run_id(path: Column | str) -> Column:
    """Model and run of a folder named model__run[__suffix]."""
    return F.array_join(F.slice(F.split(col(path), "__"), 1, 2), "__")


def result_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """(run_id, model) of the runs that a listing of result files holds."""
    folder = F.element_at(F.split(F.col(path), "/"), -2)
    return files.select(folder.alias("run_id"), F.split(folder, "__")[0].alias("model")).distinct()


def repo_url(owner: Column | str, name: Column | str) -> Column:
    """Where a repository is cloned from."""
    return F.concat(F.lit("https://github.com/"), col(owner), F.lit("/"), col(name), F.lit(".git"))


def image_uri(instance_id: Column | str, prefix: str = "eval.x86_64.") -> Column:
    """Image of an instance: lower case, double underscores written out."""
    return F.lower(F.concat(F.lit(prefix), F.replace(col(instance_id), F.lit("__"), F.lit("_1776_"))))


def short_commit(commit: Column | str) -> Column:
    """First seven characters."""
    return F.left(col(commit), F.lit(7))


def dataset_name(owner: str, source: Column | str, model: Column | str, kind: str = "SFT") -> Column:
    """Name of an output dataset from the last parts of its source's and its model's names; a model without one is local."""
    last = lambda x: F.substring_index(col(x), "/", -1)
    return F.concat(F.lit(f"{owner}/{kind}-"), last(source), F.lit("-"), F.coalesce(F.nullif(last(model), F.lit("")), F.lit("local")))


def adapter_tag(base: Column | str, adapter: Column | str) -> Column:
    """Tag of a run: the base model's, and with an adapter base__lora__adapter, the adapter by the last part of its path."""
    own = run_tag(F.substring_index(F.regexp_replace(F.coalesce(col(adapter), F.lit("")), "/+$", ""), "/", -1))
    return F.when(own == "", run_tag(base)).otherwise(F.concat(run_tag(base), F.lit("__lora__"), own))


def missing_shards(shards: DataFrame, found: DataFrame, key: str | list[str]) -> DataFrame:
    """Keys of the shards for which there are no predictions."""
    return shards.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def with_answers(completions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Completions with the reference answer of the same key."""
    return completions.join(answers, key)


def filter_counts(df: DataFrame, condition: Column) -> DataFrame:
    """Rows before a filter and after it."""
    return df.agg(F.count("*").alias("before"), F.count_if(condition).alias("after"))


def patch_count(df: DataFrame, patch: str = "model_patch") -> DataFrame:
    """Rows with a patch, and all rows."""
    return df.agg(F.count_if(F.coalesce(patch, F.lit("")) != "").alias("with_patch"), F.count("*").alias("total"))


def curation_summary(rollouts: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rollouts attempted, their problems, and those that failed."""
    return rollouts.agg(F.count("*").alias("attempted"), F.count_distinct(key).alias("problems"), F.count_if(F.col("status") == "failed").alias("failed"))


def recovery_summary(df: DataFrame, diff: str = "generated_diff", messages: str = "messages") -> DataFrame:
    """Recovered rows, mean length of the diff and mean number of messages."""
    return df.agg(F.count("*").alias("recovered"), F.round(F.avg(F.length(diff)), 6).alias("mean_diff"), F.round(F.avg(F.size(messages)), 6).alias("mean_messages"))


def frames(messages: Column | str, start: int, end: int | None) -> Column:
    """Part of a transcript by place, from 0; to the end without an end."""
    m = col(messages)
    return F.slice(m, F.lit(start + 1), F.greatest(F.size(m) - start, F.lit(0)) if end is None else F.lit(end - start))


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function over batches of rows: it may drop rows, and change, add and remove columns."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(each, schema)


def filter_batches(df: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which a user's function over batches is true."""
    return map_batches(df, lambda batch: batch[keep(batch)], df.schema)
