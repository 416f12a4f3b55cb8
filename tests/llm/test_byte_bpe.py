"""Byte-level BPE against tiktoken, byte by byte, and on odd columns."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mendloom.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as file:
    FILE = file.read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.splitlines())}
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MINE = byte_bpe.codec(FILE, public_tokenizers.PATTERN)
LETTERS = "aabtre  \n\t\r\x1c\x1f\x85\xa0 　'sllS19.!é€ß中文😀́"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=LETTERS, max_size=60), st.text(max_size=40)))
def test_ids_are_those_of_tiktoken(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = MINE.ids(text).tolist()
    assert ids == THEIRS.encode_ordinary(text)
    assert MINE.decode(ids) == text.encode()
    assert "".join(MINE.texts(ids)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=40))
def test_offsets_are_those_of_the_bytes(text):
    place = [i for i, c in enumerate(text) for _ in c.encode()]  # of each byte, its character
    at = 0
    for i, start, end in zip(*(x.tolist() for x in MINE.tokens(text)), strict=True):
        n = len(MINE.bytes[i])
        assert (start, end) == (place[at], place[at + n - 1] + 1)
        at += n
    assert at == len(place)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=80), st.integers(1, 9))
def test_slices_change_no_id(text, size):
    parts = list(byte_bpe.slices(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in THEIRS.encode_ordinary(p)] == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 20_000 + "x", "ab" * 9_000, "=" * 9_000, "word " * 300_000, "é" * 5_000], ids=lambda t: t[:3])
def test_very_long_texts(text):
    assert MINE.ids(text).tolist() == THEIRS.encode_ordinary(text)


def test_characters_split_over_tokens():
    whole = "😀".encode()
    ids = [RANKS[whole[i : i + 1]] for i in range(4)]
    assert MINE.texts(ids) == ["", "", "", "😀"]
    assert MINE.texts(ids[:2] + [RANKS[b"a"]])[-1].endswith("a") and "�" in "".join(MINE.texts(ids[:2] + [RANKS[b"a"]]))
    assert "".join(MINE.texts(ids[:3])) == whole[:3].decode("utf-8", "replace")


def test_units_that_are_dropped_are_encoded_again(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    own = byte_bpe.Codec(FILE, public_tokenizers.PATTERN)
    for text in ("one two three four five", "six one seven two", "one two " * 5):
        assert own.ids(text).tolist() == THEIRS.encode_ordinary(text)


def test_columns_with_nulls_clashing_names_and_nothing(spark):
    bpe = byte_bpe.ByteBPE(spark, PATH, public_tokenizers.PATTERN)
    texts = [None, "", "a b", "a b", "ünï cödé 😀"]
    frame = spark.createDataFrame([(i % 3, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, tokens string")
    got = frame.select("*", bpe.ids(F.col("text")).alias("out"), bpe.tokens(F.col("text")).alias("placed")).withColumns({"back": bpe.decoded(F.col("out")), "parts": bpe.decoded_texts(F.col("out"))})
    for r, t in zip(got.collect(), texts, strict=True):
        assert r.out == THEIRS.encode_ordinary(t or "") == [p.id for p in r.placed] and bytes(r.back) == (t or "").encode() and "".join(r.parts) == (t or "") and r.ids == 7
    assert got.where("false").count() == 0
    bad = spark.createDataFrame([(None,), ([1, None],), ([1, 60_000],), ([],)], "ids array<int>")
    assert [r[0] for r in bad.select(bpe.decoded(F.col("ids"))).collect()] == [None, None, None, b""]
    assert [r[0] for r in bad.select(bpe.decoded_texts(F.col("ids"))).collect()] == [None, None, None, []]


def test_query_is_that_of_tiktoken(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, DATA)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.collect()
    assert len(got) == len(texts)
    for r in got:
        ids = THEIRS.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
