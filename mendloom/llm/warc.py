"""WARC archives: a deterministic sharded writer, and a reader that trusts its manifest only."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendloom.llm.common import materialise

#: Compressed bytes at which a file is full, and payload bytes that a shard should hold.
ROLL, SHARD = 16 << 20, 32 << 20
#: Tasks that a shuffle can well have. Beyond so many shards they grow with the table instead (6.7 TB; 500 MB each at 100 TB).
MOST_SHARDS = 200_000
#: The range of keys is cut into two to so many cells for its first histogram.
CELL_BITS = 10
SMALL = 1000
_FORMAT = "WARC/1.1"


@dataclass(frozen=True)
class Shards:
    """Ranges of keys: first keys and the shard that begins there; a key too heavy for one shard has several, by a hash of the row."""

    starts: np.ndarray
    first: np.ndarray
    many: np.ndarray

    def number(self) -> int:
        return int(self.first[-1] + self.many[-1]) if len(self.starts) else 1

    def of(self, key: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Shard of rows by their key and 16 bits of their own."""
        if not len(self.starts):
            return np.zeros(len(key), np.int64)
        at = np.maximum(np.searchsorted(self.starts, key, side="right") - 1, 0)
        return self.first[at] + (spread.astype(np.int64) * self.many[at] >> 16)

    def parts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last shard of keys."""
        if not len(self.starts):
            return np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at = np.maximum(np.searchsorted(self.starts, key, side="right") - 1, 0)
        return self.first[at], self.first[at] + self.many[at] - 1


def key_ranges(df: DataFrame, key: str, weight: str, target: int, most: int = MOST_SHARDS) -> Shards:
    """Ranges of a long key that hold about ``target`` of ``weight``, found from histograms: the same for equal rows, however partitioned.

    Cells of equal width (a power of two) that are too heavy are cut into sixteen, until they are light or hold
    one key. Null keys come first, as the least long. What reaches the driver follows the number of ranges,
    not that of the rows.
    """
    spark, lowest = df.sparkSession, -(1 << 63)
    low, high, total, nulls = df.agg(F.min(key), F.max(key), F.sum(weight), F.sum(F.when(F.col(key).isNull(), F.col(weight)))).first()
    target = max(target, -(-int(total or 0) // most))
    light = [(lowest, int(nulls))] if nulls else []
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(weight).cast("long").alias("weight"))
    shift = max(0, (high - low).bit_length() - CELL_BITS) if low is not None else 0
    part = rows
    while low is not None:
        heavy = []
        for cell, w in part.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("weight")).collect():
            (heavy if w > target and shift else light).append((cell << shift, w))
        if not heavy:
            break
        named = spark.createDataFrame([(c >> shift,) for c, _ in heavy], "cell long")
        part = rows.withColumn("cell", F.shiftright("key", shift)).join(F.broadcast(named), "cell")
        shift = max(0, shift - 4)
    starts, first, many, filled, at = [], [], [], target, -1
    for start, w in sorted(light):
        if filled >= target or w > target:
            at += many[-1] if many else 1
            starts.append(start)
            first.append(at)
            many.append(max(1, -(-w // target)))
            filled = 0
        filled += w
    return Shards(*(np.array(x, np.int64) for x in (starts, first, many)))


def _urn(page_id) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed: a response with its HTTP head and payload, or a revisit with the head alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    b32 = lambda raw: base64.b32encode(raw).decode()
    head = [
        _FORMAT,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{b32(bytes.fromhex(digest))}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes records as gzip members into numbered files: a temporary name first, the final one, by their digest, once complete."""

    def __init__(self, base: str, shard: int, roll: int):
        self.fs, self.base = pafs.FileSystem.from_uri(base)
        self.shard, self.roll, self.part, self.out = shard, roll, 0, None
        self.done: list[tuple] = []

    def add(self, raw: bytes) -> None:
        packer = zlib.compressobj(4, wbits=31)
        member = packer.compress(raw) + packer.flush()
        if self.out is not None and self.size + len(member) > self.roll:
            self.close()
        if self.out is None:
            self.hidden = f"{self.base}/.shard-{self.shard:06d}-{self.part:05d}.{uuid.uuid4().hex}"
            self.out, self.size, self.count, self.sha = self.fs.open_output_stream(self.hidden, compression=None), 0, 0, hashlib.sha1()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.count += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"shard-{self.shard:06d}-{self.part:05d}-{self.sha.hexdigest()[:16]}.warc.gz"
            self._publish(f"{self.base}/{name}")
            self.done.append((name, self.count, self.size, self.sha.hexdigest()))
            self.out, self.part = None, self.part + 1

    def _publish(self, final: str) -> None:
        """The name holds the digest of the bytes, so a file that has it already, of another attempt, is the same and stays."""
        there = lambda: self.fs.get_file_info(final).type != pafs.FileType.NotFound
        if not there():
            try:
                self.fs.move(self.hidden, final)
                return
            except OSError:
                if not there():
                    raise
        self.fs.delete_file(self.hidden)


def write_archive(pages: DataFrame, base: str, roll: int = ROLL, shard_bytes: int = SHARD, small: int = SMALL) -> DataFrame:
    """Write one record per page under ``base`` and commit the manifest (file, records, bytes, sha1), which is returned.

    Pages are sorted by page_id (null first), then digest and url, into shards of key ranges, a task each; a
    page_id that is too heavy for one shard has several, over which its rows are spread by digest and url.
    Of equal payloads of at least ``small`` bytes the one of largest page_id is the response, the others are
    revisits; among rows of that same page_id and payload the first by url is the response. Null html is
    an empty payload. Payloads are shuffled once: which pages are copies comes as notes, sorted before the
    pages they are about. Rows equal in all three columns stay together in one shard.
    Files become visible only when complete, under names that hold their digest, so attempts can't harm each
    other; readers see only files of the manifest, which Spark's commit makes visible at once. What other
    attempts left is removed after it.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    keyed = rows.withColumns({"key": F.coalesce("page_id", F.lit(-(1 << 63))), "spread": F.shiftrightunsigned(F.xxhash64("digest", "url"), 48)})
    light = materialise(keyed.select("page_id", "key", "url", "digest", (F.col("size") + 512).cast("long").alias("weight")), "payloads")
    shards = key_ranges(light, "page_id", "weight", shard_bytes)
    shard, span = _shard_of(shards), _shards_of(shards)
    large = light.where(F.col("weight") >= small + 512)
    first = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1").select("digest", "response")
    known = large.join(first, "digest").groupBy("key", "page_id", "digest", "response").agg(F.min(F.struct(F.col("url").isNotNull().alias("named"), "url")).alias("least"))
    whole = keyed.select(shard("key", "spread").alias("shard"), "page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("response"))
    notes = known.select(F.explode(span("key")).alias("shard"), "page_id", "digest", F.lit(0).alias("kind"), F.col("least.url").alias("url"), F.lit(None).cast("binary").alias("payload"), "response")
    dealt = whole.unionByName(notes).repartitionById(shards.number(), "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", "kind", F.asc_nulls_first("url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, answered, noted, done = None, False, (None, None, None), []
        for batch in batches:
            for shard_no, page_id, digest, kind, url, body, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    noted, answered = ((page_id, digest), response, url), False
                    continue
                response = noted[1] if noted[0] == (page_id, digest) else None
                if out is None or out.shard != shard_no:
                    if out is not None:
                        out.close()
                        done += out.done
                    out = _Roller(base, shard_no, roll)
                own = response is None or (page_id == response and url == noted[2] and not answered)
                answered = True
                out.add(record(page_id, url, body, digest, None if own else response))
        if out is not None:
            out.close()
            done += out.done
        cols = list(zip(*done, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["file", "records", "bytes", "sha1"])

    fs, folder = pafs.FileSystem.from_uri(base)
    fs.create_dir(folder, recursive=True)
    dealt.mapInArrow(write, "file string, records long, bytes long, sha1 string").write.parquet(f"{base}/manifest")
    sweep(spark, base)
    return spark.read.schema("file string, records long, bytes long, sha1 string").parquet(f"{base}/manifest")


def sweep(spark: SparkSession, base: str) -> int:
    """Remove the archive's files that its manifest doesn't list; how many there were."""
    fs, folder = pafs.FileSystem.from_uri(base)
    listed = {r.file for r in spark.read.parquet(f"{base}/manifest").select("file").toLocalIterator()}
    left = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File and f.base_name not in listed]
    for path in left:
        fs.delete_file(path)
    return len(left)


def _shard_of(shards: Shards):
    @F.pandas_udf("int")
    def of(key: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series(shards.of(key.to_numpy(), spread.to_numpy()).astype("int32"))

    return of


def _shards_of(shards: Shards):
    @F.pandas_udf("array<int>")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(a, b + 1)) for a, b in zip(*shards.parts(key.to_numpy()), strict=True)])

    return of


def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed records of a stream of gzip members, one at a time."""
    inflate, parts, left = zlib.decompressobj(wbits=31), [], b""
    while True:
        data = left or stream.read(piece)
        left = b""
        if not data:
            break
        parts.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(parts)
            left, parts, inflate = inflate.unused_data, [], zlib.decompressobj(wbits=31)
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, whose digest must match."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    named = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[: int(named["content-length"])]
    if named["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"digest of {named['warc-record-id']} does not match")
    return named, block


def read_archive(spark: SparkSession, base: str) -> DataFrame:
    """Records of the files in the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Files are streamed a record at a time, so a task's memory follows the largest record. Block digests are checked.
    """
    files = spark.read.parquet(f"{base}/manifest").select("file")
    number = lambda urn: None if urn == "<urn:page:None>" else int(urn[10:-1])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        named, block = parse(raw)
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = base64.b32decode(named["warc-payload-digest"][5:]).hex()
                        refers = number(named["warc-refers-to"]) if "warc-refers-to" in named else None
                        rows.append((number(named["warc-record-id"]), named["warc-target-uri"], length, digest, named["warc-type"], refers, body if named["warc-type"] == "response" else None))
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(many, "file").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
