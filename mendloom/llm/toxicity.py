"""Toxicity of whole texts: boosted trees over dense features, calibrated by isotonic regression.

The lexicon of words and word beginnings comes from the training labels; with it go second-person
pronouns near lexicon words, capitals, punctuation and obfuscation rates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendloom.llm.common import fold, hash_share, materialise
from mendloom.llm.url_filter import bloom_filter, possible_hits
from mendloom.llm.words import ALNUM, plain, runs

#: Labelled rows that the classifier is fitted on, at most; lexicon entries of each kind; length of a word's beginning in bytes.
FITTED, LEXICON, HEAD = 20_000, 2000, 5
#: Forms of address, an input of the proximity feature.
SECOND_PERSON = "you your yours u ur du dich dir dein deine sie ihr euch tu te toi ton vous votre vos tú ti usted ustedes vosotros ты тебя вы вас"
NEAR = 8
FEATURES = 18
#: The kind under which rows themselves are counted, next to words (0) and beginnings (1).
ROWS = 2
_YOU = np.sort(runs(SECOND_PERSON.encode(), ALNUM)[0])
_MARKS = {name: np.isin(np.arange(256), [ord(c) for c in chars]) for name, chars in (("punctuation", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), ("!", "!"), ("?", "?"), ("masks", "*@$#%"), ("digits", "0123456789"), ("capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("small", "abcdefghijklmnopqrstuvwxyz"))}


@dataclass(frozen=True)
class Lexicon:
    """Hashes of words and of word beginnings, ascending, with their weights."""

    words: np.ndarray
    word_weights: np.ndarray
    heads: np.ndarray
    head_weights: np.ndarray


def _weights(found: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(found))
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return np.where(known[at] == found, weights[at], 0.0)


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """The dense features of one whole text; all zero for an empty one."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    word, start, end, head = runs(plain(text.lower()), ALNUM, HEAD)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(word))
    by_word, by_head = _weights(word, lexicon.words, lexicon.word_weights), _weights(head, lexicon.heads, lexicon.head_weights)
    hit = np.maximum(by_word, by_head) > 0
    for k, w in enumerate((by_word, by_head)):
        out[4 * k : 4 * k + 4] = (w > 0).mean() if len(w) else 0, np.log1p((w > 0).sum()), w.max(initial=0), w.sum() / n
    you = np.flatnonzero(np.isin(word, _YOU))
    if len(you) and hit.any():
        at = np.flatnonzero(hit)
        place = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(place, len(you) - 1)]), np.abs(at - you[np.maximum(place - 1, 0)]))
        out[8] = (gap <= NEAR).sum() / n
    out[9] = len(you) / n
    caps, small = int(_MARKS["capitals"][b].sum()), int(_MARKS["small"][b].sum())
    out[10] = caps / max(1, caps + small)
    out[11] = _MARKS["punctuation"][b].mean()
    out[12], out[13] = _MARKS["!"][b].mean(), _MARKS["?"][b].mean()
    alnum, digit, mask = ALNUM[b], _MARKS["digits"][b], _MARKS["masks"][b]
    letter = alnum & ~digit
    if len(b) > 2:
        inner = letter[:-2] & letter[2:]
        out[14], out[15] = (inner & mask[1:-1]).sum() / n, (inner & digit[1:-1]).sum() / n
        out[16] = (letter[2:] & (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2])).sum() / n
    out[17] = np.log1p(n)
    return out


def feature_column(lexicon: Lexicon):
    """``features`` as a function of a text column; null is empty."""

    @F.arrow_udf("array<double>")
    def dense(texts: pa.Array) -> pa.Array:
        flat = np.concatenate([features(t.as_py() or "", lexicon) for t in texts]) if len(texts) else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * FEATURES, pa.int32()), pa.array(flat))

    return dense


def labelled(docs: DataFrame, labels: DataFrame, bound: int | None = FITTED, parts: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents in the given folds: ``bound`` rows at most in expectation, all for None.

    Contradicting labels count as toxic, null labels and texts are dropped. Only a bounded table of labels is broadcast;
    for all of them a Bloom filter of the labelled ids (32 MB at most) keeps unlabelled texts out of the shuffle.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")).isin(*parts)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where("text is not null").where(fold(F.col("doc_id")).isin(*parts)).select("doc_id", "text")
    if bound is None:
        key = F.xxhash64(F.col("doc_id").cast("string"))
        sent = docs.sparkSession.sparkContext.broadcast(bloom_filter(known.select(key.alias("key")), "key"))

        @F.arrow_udf("boolean")
        def possible(keys: pa.Array) -> pa.Array:
            return pa.array(possible_hits(sent.value, keys.to_numpy(zero_copy_only=False).astype(np.int64)))

        return rows.where(possible(key)).join(known, "doc_id")
    known = known.where(hash_share(F.col("doc_id"), min(1.0, bound / max(1, known.count())), 6))
    return rows.join(F.broadcast(known), "doc_id")


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> Lexicon:
    """Words and beginnings that are in at least six toxic rows and far more often than in others; weight is the log odds ratio.

    ``rows`` are read once, however many: tasks count the texts with an item batch by batch, Spark adds the counts.
    The ``size`` items of each kind that tell most make up the lexicon.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], list[np.ndarray]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                word, _, _, head = runs(plain(text.as_py().lower()), ALNUM, HEAD)
                for kind, h in enumerate((word, head)):
                    found.setdefault((kind, toxic), []).append(np.unique(h))
                found.setdefault((ROWS, toxic), []).append(np.zeros(1, np.uint64))
            for (kind, toxic), parts in found.items():
                h, many = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind), pa.int32()), pa.array(h.view(np.int64)), pa.array(many * toxic, pa.int64()), pa.array(many * (1 - toxic), pa.int64())], names=["kind", "item", "toxic", "other"])

    items = rows.select("text", "toxic").mapInArrow(count, "kind int, item long, toxic long, other long").groupBy("kind", "item").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    items = materialise(items, "items")
    totals = items.where(F.col("kind") == ROWS).first()
    bad, good = (float(totals.t), float(totals.o)) if totals else (0.0, 0.0)
    share = bad / max(1.0, bad + good)
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("o") + 0.5) / (good + 1))
    over = F.col("t") - (F.col("t") + F.col("o")) * share
    strong = items.where((F.col("t") >= 6) & (over >= 5 * F.sqrt((F.col("t") + F.col("o")) * share * (1 - share)))).withColumn("weight", odds).where("weight > 1.5")
    tables = []
    for kind in (0, 1):
        top = strong.where(F.col("kind") == kind).orderBy(F.desc(F.col("t") * F.col("weight")), "item").limit(size).collect()
        item, weight = np.array([r.item for r in top], np.int64).view(np.uint64), np.array([r.weight for r in top], float)
        order = np.argsort(item)
        tables += [item[order], weight[order]]
    return Lexicon(*tables)


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon, trees and calibration; ``constant`` is the score where there is nothing to tell classes apart."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float

    def score(self, docs: DataFrame, column: str = "text") -> DataFrame:
        """``docs`` with ``score`` from 0 to 1, without a shuffle; null and empty texts are scored as texts without words.

        Columns named ``score`` or like the model's own (``score_...``) are replaced or dropped.
        """
        taken = ["score_features", "score_margin", "score_raw", "score_probability", "score_class"]
        docs = docs.drop("score", *taken)
        if self.trees is None:
            return docs.withColumn("score", F.lit(self.constant))
        dense = docs.withColumn("score_features", array_to_vector(feature_column(self.lexicon)(F.col(column))))
        scored = self.trees.transform(dense).withColumn("score_margin", vector_to_array("score_raw")[1])
        return self.calibration.transform(scored).drop(*taken)


def fit(docs: DataFrame, labels: DataFrame, bound: int = FITTED, rounds: int = 12, depth: int = 3) -> ToxicityModel:
    """Learn from the labelled rows outside fold 0: lexicon and trees from folds 1 to 3, calibration from fold 4.

    Words are counted over all labelled rows; trees and calibration are fitted on a hash sample of
    ``bound`` labelled rows at most. Scoring covers every row.
    """
    rows = materialise(labelled(docs, labels, bound).repartition(8), "labelled")
    counts = rows.groupBy(fold(F.col("doc_id")) == 4).agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"), F.avg("toxic").alias("mean")).collect()
    if len(counts) < 2 or any(r.low == r.high for r in counts):
        mean = rows.agg(F.avg("toxic")).first()[0]
        return ToxicityModel(Lexicon(*(np.zeros(0, t) for t in ("uint64", float, "uint64", float))), None, None, float(mean or 0.0))
    lexicon = learn_lexicon(labelled(docs, labels, None, (1, 2, 3)))
    dense = rows.select("toxic", fold(F.col("doc_id")).alias("part"), array_to_vector(feature_column(lexicon)(F.col("text"))).alias("score_features"))
    dense = materialise(dense, "features")
    learner = GBTClassifier(labelCol="toxic", featuresCol="score_features", predictionCol="score_class", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=6, checkpointInterval=-1)
    learner.setRawPredictionCol("score_raw").setProbabilityCol("score_probability")
    trees = learner.fit(dense.where("part <> 4").coalesce(4))
    margin = trees.transform(dense.where("part = 4")).select("toxic", vector_to_array("score_raw")[1].alias("score_margin"))
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="score_margin", predictionCol="score").fit(margin.coalesce(1))
    return ToxicityModel(lexicon, trees, calibration, 0.0)
