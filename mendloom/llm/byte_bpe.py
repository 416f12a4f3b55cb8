"""Byte-level BPE: whole texts to token ids with offsets, and ids back to bytes and text.

The ``tokenizers`` library encodes inside Arrow functions, under the byte-to-character mapping of
byte-level vocabularies; decoding reverses that mapping. Ids are those of tiktoken for the same ranks.
A match of the pattern never runs from a non-space into a space, so a text is cut there into short
units without changing an id, and a unit that was seen before isn't encoded again.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters that the pattern's ``\s`` stands for (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Characters worked on at a time; units kept, and their greatest length.
SLICE, KEPT, SHORT = 1 << 20, 1_000_000, 40


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut where no match can run across."""
    at = 0
    while at < len(text):
        end = _CUT.search(text, at + size) if at + size < len(text) else None
        yield text[at : end.start() if end else len(text)]
        at = end.start() if end else len(text)


class Codec:
    """A vocabulary of ranks (lines of base64 token and rank) with the pattern that splits texts before its merges."""

    def __init__(self, file: bytes, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}
        shown = byte_characters()
        named = {token: "".join(shown[b] for b in token) for token in ranks}
        ordered = sorted(ranks, key=ranks.get)
        merges = [(named[t[:i]], named[t[i:]]) for t in ordered for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.bytes = {rank: token for token, rank in ranks.items()}
        # a match that is a token as a whole is that token, as in tiktoken
        self.library = Tokenizer(models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.library.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.seen: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(b"".join([self._packed(_UNIT.findall(part)) for part in slices(text)]), np.int32)

    def _packed(self, units: list[str]) -> bytes:
        if len(self.seen) > KEPT:
            self.seen.clear()
        new = list(set(units).difference(self.seen))
        if new:
            self.seen.update(zip(new, (array("i", e.ids).tobytes() for e in self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        packed = b"".join(map(self.seen.__getitem__, units))
        for u in new:
            if len(u) > SHORT:
                del self.seen[u]
        return packed

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, and where each token's characters begin and end; a part of a character has that character's place."""
        ids, starts, ends, at = [], [], [], 0
        for part in slices(text):
            units = _UNIT.findall(part)
            found = dict.fromkeys(units)
            found = dict(zip(found, self.library.encode_batch(list(found), add_special_tokens=False), strict=True))
            for u in units:
                places = found[u].offsets
                ids.append(found[u].ids)
                starts.append([at + a for a, _ in places])
                ends.append([at + b for _, b in places])
                at += len(u)
        return tuple(np.fromiter(chain.from_iterable(x), np.int32) for x in (ids, starts, ends))

    def decode(self, ids: list[int]) -> bytes | None:
        """Bytes of ids; None if one of them is unknown."""
        try:
            return b"".join(map(self.bytes.__getitem__, ids))
        except KeyError:
            return None

    def texts(self, ids: list[int]) -> list[str] | None:
        """What each id adds to the text: a character split over tokens comes with the last of them, a broken one as U+FFFD."""
        if any(i not in self.bytes for i in ids):
            return None
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.bytes[i], final=n == len(ids) - 1) for n, i in enumerate(ids)]


@lru_cache(2)
def codec(file: bytes, pattern: str) -> Codec:
    """The vocabulary, built once in a Python worker, whose one core the library must not spread over threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(file, pattern)


def _lists(arrays: list[np.ndarray], values: pa.Array) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _each(lists: pa.Array) -> Iterator[list[int] | None]:
    """Lists of an Arrow array one by one, -1 for null items; item by item, Arrow takes far longer."""
    items, ends, there = lists.values.fill_null(-1).to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
    for i, ok in enumerate(there):
        yield items[ends[i] : ends[i + 1]].tolist() if ok else None


def _whole(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *arrays])


class ByteBPE:
    """Column functions of a vocabulary file; the file's bytes are broadcast (a few megabytes, of a size that no table changes).

    Texts are whole; null is an empty text. Ids come as array<int>; an empty text has none. Decoding
    gives null for null, and for arrays that hold a null or unknown id. Nothing is shuffled.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.file = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def _codec(self) -> Callable[[], Codec]:
        file, pattern = self.file, self.pattern
        return lambda: codec(file.value, pattern)

    def ids(self, text: Column) -> Column:
        """Token ids of a text column."""
        get = self._codec()

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            each = [get().ids(t.as_py() or "") for t in texts]
            return _lists(each, pa.array(_whole(each), pa.int32()))

        return encode(text)

    def tokens(self, text: Column) -> Column:
        """Tokens of a text column with their places in characters: array<struct<id, start, end>>."""
        get = self._codec()

        @F.arrow_udf("array<struct<id:int,start:int,end:int>>")
        def encode(texts: pa.Array) -> pa.Array:
            each = [get().tokens(t.as_py() or "") for t in texts]
            fields = [pa.array(_whole([e[i] for e in each]), pa.int32()) for i in range(3)]
            return _lists([e[0] for e in each], pa.StructArray.from_arrays(fields, ["id", "start", "end"]))

        return encode(text)

    def decoded(self, ids: Column) -> Column:
        """The bytes that ids stand for."""
        get = self._codec()

        @F.arrow_udf("binary")
        def decode(each: pa.Array) -> pa.Array:
            return pa.array([None if ids is None else get().decode(ids) for ids in _each(each)], pa.binary())

        return decode(ids)

    def decoded_texts(self, ids: Column) -> Column:
        """What each id adds to the text, array<string>; joined, they are the text of the bytes."""
        get = self._codec()

        @F.arrow_udf("array<string>")
        def decode(each: pa.Array) -> pa.Array:
            return pa.array([None if ids is None else get().texts(ids) for ids in _each(each)], pa.list_(pa.string()))

        return decode(ids)
