"""Corpus preparation end to end: toxicity, near-duplicates, personal data, mixture, packing.

Each stage works on all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mendloom.llm import mixing, order_minhash, packing, surrogates, toxicity
from mendloom.llm.common import held, materialise, release, scratch_tables, table
from mendloom.llm.queries import SURROGATE_KEY, mix_levels, mix_weights, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that reach the mixture stage. One epoch: no document is repeated after deduplication.
SHARE, EPOCHS, SEED = 0.9, 1, 10


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, learned from the labels of this stage's own input."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs).where("score < 0.5").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of every near-duplicate class."""
    return order_minhash.drop_near_duplicates(docs).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    return surrogates.replace_entities(docs, SURROGATE_KEY).selectExpr("doc_id", "text", "lang", "source", "cast(coalesce(length(text), 0) as bigint) AS n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the target weights of domains, languages and sources."""
    levels = mix_levels()
    _, _, cut = mixing.mix(docs, levels, mix_weights(), SHARE, EPOCHS, SEED, packing.id_counter(spark, tokenizer_path()))
    keyed = docs.withColumnsRenamed({"lang": "lang_", "source": "source_"}).selectExpr("*", "lang_ AS lang", "source_ AS source")
    return mixing.select(mixing.with_levels(keyed, levels), cut, list(levels), SEED).selectExpr("doc_id", "text", "lang_ AS lang", "source_ AS source", "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all chosen documents in windows of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("mixture", mixture),
    ("packing", packed),
]
#: Trees, sketches and tokens have no SQL. Tests hold each stage against plain Python on a fixture of odd, repeated and clashing rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Columns other than those of documents are left out from the first stage on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = held()
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep=[p for p in scratch_tables(mark) if f"/stage-{name}-" in p])
    return STAGES[-1][1](spark, docs, sf_dir)
