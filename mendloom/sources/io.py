"""Readers that survive bad lines and missing files, and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendloom.operators.selection import numbered, with_fallback
from mendloom.sources.folders import history_values


def scan_split(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The train split of a table's folder, or test where train is empty."""
    read = lambda split: spark.read.schema(schema).parquet(f"{path}/{split}")
    return with_fallback(read("train"), read("test"))


def numbered_lines(spark: SparkSession, path: str, name: Column | None = None, where: Column | None = None, **options: str) -> DataFrame:
    """(file, line_no, line) of text files, lines numbered from 0; ``name`` is what stands for a file, ``where`` a condition on ``dir``, that name.

    A file is read in blocks, by several tasks if it is large: lines are numbered within blocks, and the
    counts of earlier blocks are added.
    """
    name = F.col("_metadata.file_path") if name is None else name
    files = spark.read.options(**options).text(path)
    files = files if where is None else files.withColumn("dir", name).where(where)
    read = files.select(name.alias("file"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("at_"), F.col("value").alias("line"))
    local = read.withColumn("nth_", F.row_number().over(Window.partitionBy("file", "block_").orderBy("at_")) - 1)
    sizes = read.groupBy("file", "block_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("file").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(sizes.select("file", "block_", before.alias("before_")), ["file", "block_"]).select("file", (F.col("nth_") + F.col("before_")).alias("line_no"), "line")


def json_object(line: Column) -> Column:
    """Whether a line is a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(line))
    return F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))


def truthy(line: Column, path: str) -> Column:
    """Whether a JSON value is there and neither null, false, zero, nor an empty string, list or object."""
    value = F.try_variant_get(F.try_parse_json(line), path, "variant")
    kind, shown = F.schema_of_variant(value), F.to_json(value)
    number = F.rlike(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"))
    return F.coalesce(F.when(number, F.try_variant_get(value, "$", "double") != 0).otherwise((kind != "VOID") & ~shown.isin('""', "false", "[]", "{}")), F.lit(False))


def scan_predictions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good lines (with instance_id), and rejects with the reason; blank lines are neither."""
    full = lines.where(F.rlike("line", F.lit(r"\S")))
    marked = full.withColumn("instance_id", F.when(json_object(F.col("line")), F.get_json_object("line", "$.instance_id")))
    reason = F.when(~json_object(F.col("line")), "not an object").when(~truthy(F.col("line"), "$.instance_id"), "no instance_id")
    marked = marked.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").drop("instance_id")


def until_bad(lines: DataFrame, key: str = "file") -> DataFrame:
    """The lines of each file before its first that isn't JSON; blank lines are skipped."""
    full = lines.where(F.rlike("line", F.lit(r"\S")))
    bad = full.where(F.try_parse_json("line").isNull()).groupBy(key).agg(F.min("line_no").alias("bad_"))
    return full.join(bad, key, "left").where("bad_ is null or line_no < bad_").drop("bad_")


def shard_number(path: Column) -> Column:
    """Number at the end of a shard folder's name, after _ or else -; a billion without one."""
    folder = F.element_at(F.split(path, "/"), -2)
    last = lambda mark: F.try_to_number(F.when(F.contains(folder, F.lit(mark)) & F.rlike(F.substring_index(folder, mark, -1), F.lit("^[0-9]{1,9}$")), F.substring_index(folder, mark, -1)), F.lit("999999999")).cast("long")
    return F.coalesce(last("_"), last("-"), F.lit(1_000_000_000))


def complete_history(files: DataFrame) -> DataFrame:
    """(dir, metadata, diff, messages, tools) of the folders with all four files, from (dir, name, value)."""
    names = {"metadata": "metadata.json", "diff": "diff.txt", "messages": "messages.jsonl", "tools": "tools.json"}
    wide = files.groupBy("dir").agg(*(F.max(F.when(F.col("name") == f, F.col("value"))).alias(k) for k, f in names.items()))
    return wide.where(" and ".join(f"{k} is not null" for k in names))


def history(spark: SparkSession, root: str, most_bytes: int = 64 << 20) -> DataFrame:
    """The complete rollout folders under ``root``. A file is a value, so a folder with one over ``most_bytes`` is incomplete: see ``oversized``."""
    return history_values(spark, root, most_bytes=most_bytes).drop("log_bytes").dropna()


def oversized(spark: SparkSession, root: str, most_bytes: int = 64 << 20) -> DataFrame:
    """(file, bytes) of the history files that are too large to be a value."""
    found = spark.read.format("binaryFile").load(f"{root}/*/*").where(F.col("length") > most_bytes)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, folder, number, bytes, place) of the files under ``root``, at any depth, whose names fit a glob ``pattern``.

    Their order is that of the numbers at the ends of their folders' names, then of their paths; folders
    without a number come last. Spark lists large trees in a job of its own, and no file is opened. A root
    that isn't there has no files.
    """
    found = spark.createDataFrame([], "path string, bytes long")
    if _exists(spark, root):
        tree = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        found = tree.select("path", F.col("length").alias("bytes"))
    folder = F.element_at(F.split("path", "/"), -2)
    return numbered(found.select("path", folder.alias("folder"), shard_number(F.col("path")).alias("number"), "bytes"), ["number", "path"], "place")


def discovered_lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(place, folder, line_no, line): the lines of all discovered files, with the place of their file."""
    files = discover(spark, root, pattern)
    if files.isEmpty():
        return spark.createDataFrame([], "place long, folder string, line_no long, line string")
    lines = numbered_lines(spark, root, recursiveFileLookup="true", pathGlobFilter=pattern)
    tail = lambda x: F.regexp_replace(x, r"^[A-Za-z0-9+.-]+:/*", "/")
    return lines.withColumn("at_", tail(F.col("file"))).join(files.withColumn("at_", tail(F.col("path"))), "at_").select("place", "folder", "line_no", "line")


def _history_place(parts: bool) -> tuple[Column, Column]:
    """Folder and file name of what is read: root/<dir>/<name>, or root/dir=<dir>/name=<name>/<part file> as Spark writes it."""
    at = lambda i: F.element_at(F.split("_metadata.file_path", "/"), -i)
    named = lambda x: F.url_decode(F.substring_index(x, "=", -1))
    return (named(at(3)), named(at(2))) if parts else (F.url_decode(at(2)), at(1))


def log_messages(log: Column | str) -> Column:
    """Messages of a log's lines before the first that isn't JSON, parsed; blank lines are skipped."""
    each = F.filter(F.split(log, r"\r\n|\r|\n", -1), lambda s: F.rlike(s, F.lit(r"\S")))
    bad = F.array_position(F.transform(each, lambda s: F.try_parse_json(s).isNull()), True)
    good = F.when(bad > 0, F.slice(each, F.lit(1), (bad - 1).cast("int"))).otherwise(each)
    return F.transform(good, lambda s: F.from_json(s, "struct<role: string, content: string>"))


def history_messages(spark: SparkSession, root: str, folders: Column | None = None, parts: bool = False) -> DataFrame:
    """(dir, messages array<struct<role, content>>): each message log up to its first bad line, parsed; folders without a good line are left out.

    Logs of any size are read in blocks as numbered lines; what meets in a row is the parsed conversation.
    ``folders`` is a condition on the column ``dir`` and the file's metadata, judged before any file is opened if it is of literals.
    """
    path = f"{root}/*/name=messages.jsonl/*" if parts else f"{root}/*/messages.jsonl"
    lines = numbered_lines(spark, path, _history_place(parts)[0], folders)
    each = until_bad(lines.withColumnRenamed("file", "dir"), "dir").select("dir", "line_no", F.from_json("line", "role string, content string").alias("m"))
    return each.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "m"))), lambda x: x["m"]).alias("messages"))


def history_folders(spark: SparkSession, root: str, folders: Column | None = None, parts: bool = False, most_bytes: int = 64 << 20, most_log: int = 8 << 20) -> DataFrame:
    """(dir, metadata, diff, tools, messages) of the folders under ``root`` with all of their files, whatever the size of a message log.

    Metadata, diff and tools are a value each, of ``most_bytes`` at most; ``oversized`` lists larger ones.
    Logs of ``most_log`` bytes at most are read with the rest of their folder, larger ones in blocks.
    """
    if parts:
        return _history_parts(spark, root, folders, most_bytes)
    whole = history_values(spark, root, folders, most_bytes, most_log).where("metadata is not null and diff is not null and tools is not null and log_bytes is not null")
    small = whole.where("messages is not null").withColumn("messages", log_messages("messages")).where(F.size("messages") > 0)
    out = ["dir", "metadata", "diff", "tools", "messages"]
    if history_values(spark, root, folders, 0).where(F.col("log_bytes") > most_log).isEmpty():  # opens no file
        return small.select(*out)
    heavy = F.col("_metadata.file_size") > most_log
    large = whole.where("messages is null").drop("messages").join(history_messages(spark, root, heavy if folders is None else heavy & folders), "dir")
    return small.select(*out).unionByName(large.select(*out))


def _history_parts(spark: SparkSession, root: str, folders: Column | None, most_bytes: int) -> DataFrame:
    """``history_folders`` as Spark's partitioned writer lays them out: root/dir=<dir>/name=<name>/<part file>."""
    names = {"metadata": "metadata.json", "diff": "diff.txt", "tools": "tools.json"}
    dir_, name = _history_place(True)
    path = f"{root}/*/name={{{','.join(names.values())}}}/*"
    files = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= most_bytes).select(dir_.alias("dir"), name.alias("name"), "value").where(F.col("name").isin(*names.values()))
    files = files if folders is None else files.where(folders)
    wide = files.groupBy("dir").agg(*(F.max(F.when(F.col("name") == f, F.col("value"))).alias(k) for k, f in names.items())).where(" and ".join(f"{k} is not null" for k in names))
    return wide.join(history_messages(spark, root, folders, True), "dir")


def dataset_path(root: str, name: str, version: str) -> str:
    """Where a version of a dataset lies; names keep letters, digits, dots, dashes and underscores."""
    clean = lambda x: re.sub(r"[^A-Za-z0-9._-]+", "_", x).strip("._") or "unnamed"
    return f"{root.rstrip('/')}/{clean(name)}/{clean(version)}"


def write_version(df: DataFrame, root: str, name: str, version: str, order: list[str], as_json: bool = False) -> str:
    """Rows in an order as part files of a new version, as Parquet or JSON lines; the path.

    Part files follow each other in the order, each written by a task of its own; a manifest of their
    first row numbers is written last, all at once. A version without one is unfinished and isn't read;
    one with a manifest isn't written over.
    """
    spark, path = df.sparkSession, dataset_path(root, name, version)
    if _exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"{path} is there already")
    rows = df.orderBy(*order)
    out = rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")) if as_json else rows
    (out.write.mode("overwrite").text if as_json else out.write.mode("overwrite").parquet)(f"{path}/data")
    there = spark.read.text(f"{path}/data") if as_json else spark.read.schema(df.schema).parquet(f"{path}/data")
    files = there.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    files.select("file", first.alias("first"), "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return path


def versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """The finished versions of a dataset, numbers in their names compared as numbers."""
    folder = dataset_path(root, name, "x").rsplit("/", 1)[0]
    if not _exists(spark, folder):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    key = lambda v: [(x.isdigit(), int(x) if x.isdigit() else 0, x) for x in re.findall(r"\d+|\D+", v)]
    return sorted((v for v in found if _exists(spark, f"{folder}/{v}/manifest/_SUCCESS")), key=key)


def read_version(spark: SparkSession, root: str, name: str, schema: str, version: str | None = None, as_json: bool = False) -> DataFrame:
    """The rows of a version, the latest one as a rule, with ``place``: their number from 0 in the order that they were written in."""
    found = versions(spark, root, name)
    if (version or "") not in (found if version else found and [""]):
        raise ValueError(f"no finished version of {name}")
    path = dataset_path(root, name, version or found[-1])
    manifest = spark.read.schema("file string, first long, n long").parquet(f"{path}/manifest")
    if as_json:
        lines = numbered_lines(spark, f"{path}/data", F.col("_metadata.file_name"))
        return lines.join(F.broadcast(manifest), "file").select(F.from_json("line", schema).alias("row"), (F.col("first") + F.col("line_no")).alias("place")).select("row.*", "place")
    read = spark.read.schema(schema).parquet(f"{path}/data").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("nth_"))
    return read.join(F.broadcast(manifest), "file").withColumn("place", F.col("first") + F.col("nth_")).drop("file", "first", "n", "nth_")


def write_table(df: DataFrame, path: str) -> None:
    """A dataset as Parquet, replacing what was there."""
    df.write.mode("overwrite").parquet(path)


def card(df: DataFrame, description: str, **parameters: str) -> DataFrame:
    """One row that describes a dataset: text, parameters, rows."""
    named = F.create_map(*(F.lit(str(x)) for kv in sorted(parameters.items()) for x in kv)) if parameters else F.create_map().cast("map<string,string>")
    return df.agg(F.count("*").alias("rows")).select(F.lit(description).alias("description"), named.alias("parameters"), "rows")


def write_jsonl(df: DataFrame, order: list[str], path: str, one_file: bool = False) -> None:
    """Rows as JSON lines in an order; one file only if asked for, for that is one task's work."""
    rows = df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").text(path)
