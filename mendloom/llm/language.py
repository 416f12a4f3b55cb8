"""Language of whole texts by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendloom.llm.common import fold, hash_share

#: N-grams in a profile; documents per language that profiles are learned from, at most (in expectation).
PROFILE, LEARNED = 300, 4000
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
_BITS = np.uint64(21)


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of letters of the whole text, words being padded by one blank on either side.

    A code point takes 21 bits, so letters of every plane count.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    c = np.where(letter, points, 0).astype(np.uint64)
    c = np.concatenate([[np.uint64(0)], c[(c > 0) | np.r_[True, c[:-1] > 0]], [np.uint64(0)]])
    two = c[:-1] << _BITS | c[1:]
    three = (c[:-2] << np.uint64(42) | c[1:-1] << _BITS | c[2:])[c[1:-1] > 0]
    return np.concatenate([c[c > 0], two[two > 0], three])


def profile(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties to the smaller code."""
    code, many = np.unique(codes, return_counts=True)
    if len(code) > size:
        least = np.partition(many, len(many) - size)[len(many) - size]
        code, many = code[many >= least], many[many >= least]
    return code[np.argsort(-many, kind="stable")][:size]


def learn_profiles(docs: DataFrame, size: int = PROFILE, bound: int = LEARNED) -> dict[str, np.ndarray]:
    """Profile of every language among documents with text and language outside fold 0.

    Learned from a hash sample of about ``bound`` documents of each language; counts are summed by
    Spark, and ``size`` codes a language reach the driver.
    """
    known = docs.where("lang is not null and text is not null").where(fold(F.col("doc_id")) != 0)
    many = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not many:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in many.items() for x in (lang, min(1.0, bound / n))))[F.col("lang")]
    taken = known.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            for lang in np.unique(langs):
                code, n = np.unique(np.concatenate([grams(batch.column(1)[int(i)].as_py()) for i in np.flatnonzero(langs == lang)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    totals = taken.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = totals.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("place") <= size)
    out: dict[str, list] = {}
    for row in best.orderBy("lang", "place").collect():
        out.setdefault(row.lang, []).append(row.code)
    return {lang: np.array(codes, np.int64).view(np.uint64) for lang, codes in out.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, without a shuffle.

    A document's distance to a language is the sum over its profile of how far each n-gram is out of
    place, ``size`` for one that the language lacks. The nearest language wins, ties to the lesser name;
    score is 1 less the distance's share of the largest possible. ``und`` with score 0 is the result for
    null texts, texts without letters, and all texts where no language was learned.
    """
    names = sorted(profiles)
    known = []
    for name in names:
        order = np.argsort(profiles[name])
        known.append((profiles[name][order], order))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for text in texts:
            own = profile(grams(text.as_py() or ""), size)
            if not len(own) or not names:
                langs.append("und")
                scores.append(0.0)
                continue
            far = []
            for code, rank in known:
                at = np.minimum(np.searchsorted(code, own), len(code) - 1)
                far.append(np.where(code[at] == own, np.minimum(np.abs(rank[at] - np.arange(len(own))), size), size).sum())
            best = int(np.argmin(far))
            langs.append(names[best])
            scores.append(1.0 - float(far[best]) / (size * len(own)))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn("judged_", judge(F.col(column))).withColumns({"lang_pred": F.col("judged_.lang_pred"), "score": F.col("judged_.score")}).drop("judged_")
