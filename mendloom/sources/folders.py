"""Folders of small files: tasks write and read the files, so neither their names nor their contents pass through the driver."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a history folder and their files.
HISTORY = {"metadata": "metadata.json", "diff": "diff.txt", "messages": "messages.jsonl", "tools": "tools.json"}
#: Folders and bytes of a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def spread(df: DataFrame, *by: Column | str) -> DataFrame:
    """``df`` in as many partitions as shuffles have, four a core at least: for rows that are small but dear to work on, or grow.

    Their number is given, since adaptive execution would merge small partitions into few by their bytes.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def write_files(rows: DataFrame, root: str, order: list[str]) -> None:
    """The files ``root``/dir/name from rows (dir, name, value), each value a line, in ``order``.

    A file is written by one task, under a hidden name until it is whole, so a task may run twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        at, made, out, hidden, files = None, None, None, "", 0

        def close() -> None:
            out.close()
            fs.move(hidden, f"{base}/{at[0]}/{at[1]}")

        for batch in batches:
            for key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key[:2] != at:
                    if out is not None:
                        close()
                    if not all(key[:2]) or any("/" in x or x in (".", "..") for x in key[:2]):
                        raise ValueError(f"{key[:2]} names no file")
                    if made != key[0]:
                        fs.create_dir(f"{base}/{key[0]}", recursive=True)
                    at, made, files = key[:2], key[0], files + 1
                    hidden = f"{base}/{key[0]}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(hidden, compression=None)
                out.write((key[2] or "").encode() + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    dealt = spread(rows, "dir").sortWithinPartitions("dir", "name", *order).select("dir", "name", "value")
    dealt.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def folder_names(spark: SparkSession, root: str) -> DataFrame:
    """(dir) of the folders under ``root``, hidden ones left out: one task lists names alone."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for _ in batches:
            found = [f.base_name for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.Directory and f.base_name[0] not in "._"]
            for i in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 10_000], pa.string())], ["dir"])

    return spark.range(1, numPartitions=1).mapInArrow(names, "dir string")


def history_values(spark: SparkSession, root: str, folders: Column | None = None, most_bytes: int = 64 << 20, most_log: int | None = None) -> DataFrame:
    """(dir, metadata, diff, messages, tools, log_bytes): a row for each folder under ``root`` for which the condition ``folders`` on ``dir`` holds.

    A missing file is null, as is one of more than ``most_bytes``, or ``most_log`` for messages. A folder's
    files are opened by one task, and folders are dealt to all tasks.
    """
    most = {c: most_log if c == "messages" and most_log is not None else most_bytes for c in HISTORY}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        found: dict[str, list] = {c: [] for c in ("dir", *HISTORY, "log_bytes")}

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c == "log_bytes" else pa.string()) for c, v in found.items()], list(found))
            for v in found.values():
                v.clear()
            return made

        held = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found["dir"].append(name)
                log_bytes = None
                for c, info in zip(HISTORY, fs.get_file_info([f"{base}/{name}/{f}" for f in HISTORY.values()]), strict=True):
                    there = info.type == pafs.FileType.File
                    log_bytes = info.size if there and c == "messages" else log_bytes
                    value = None
                    if there and info.size <= most[c]:
                        with fs.open_input_stream(info.path, compression=None) as stream:
                            value = stream.read().decode(errors="replace") if info.size else ""
                        held += info.size
                    found[c].append(value)
                found["log_bytes"].append(log_bytes)
                if held >= BATCH_BYTES or len(found["dir"]) >= BATCH_ROWS:
                    yield batch_of()
                    held = 0
        yield batch_of()

    names = folder_names(spark, root)
    names = names if folders is None else names.where(folders)
    return spread(names).mapInArrow(read, "dir string, metadata string, diff string, messages string, tools string, log_bytes long")
