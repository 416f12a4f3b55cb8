"""The registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendloom.llm import byte_bpe, cross_polytope, filter_audit, hard_negatives, language, mixing, order_minhash, packing, surrogates, syncmers, toxicity, url_filter, warc
from mendloom.llm.common import fold, scratch_path, table

#: (host, path, verdict) of the url rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A deployment passes a secret of its own.
SURROGATE_KEY = "surrogates-1"
#: Share of all tokens that a mixture takes, most passes over a source, and the seed of their order.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 3, 10


def tokenizer_path() -> str:
    """Place of the byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def domain_of(source: Column) -> Column:
    """Domain of a source: the crawl, or one of two collections by the source's hash."""
    return F.when(source == "src0", "crawl").when(F.crc32(F.encode(source, "UTF-8")) % 2 == 0, "reference").otherwise("forum")


def mix_levels() -> dict[str, Column]:
    """Domain, language and source of a document."""
    return {"domain": domain_of(F.coalesce(F.col("source"), F.lit(""))), "lang": F.col("lang"), "source": F.col("source")}


def mix_weights() -> list[Column]:
    """Target weights by level: domains 40, 35 and 25; languages 50, 20, 15 and 15, others 5; sources alike."""
    domain = F.when(F.col("domain") == "crawl", 0.40).when(F.col("domain") == "reference", 0.35).otherwise(0.25)
    lang = F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "de", 0.2).when(F.col("lang").isin("fr", "es"), 0.15).otherwise(0.05)
    return [domain, lang, F.lit(1.0)]


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the listed rules on the url of every page."""
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth."""
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files in the shared folder and read again."""
    base = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), base)
    return warc.read_archive(spark, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = language.predict(docs.select("doc_id", "text"), language.learn_profiles(docs))
    return said.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen for a mixture of target weights in ids of the tokenizer, once for each epoch."""
    levels = mix_levels()
    rows, _, cut = mixing.mix(table(spark, sf_dir, "documents"), levels, mix_weights(), MIX_SHARE, MIX_EPOCHS, MIX_SEED, packing.id_counter(spark, tokenizer_path()))
    return mixing.select(rows, cut, list(levels), MIX_SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five positives."""
    vec_id, label = F.col("vec_id"), F.col("label")
    noisy = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id, noisy, F.col("embedding"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of five filters over all documents in every order, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by a byte-level vocabulary and decoded again."""
    import public_tokenizers

    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = table(spark, sf_dir, "documents").select("doc_id", bpe.ids(F.col("text")).alias("ids"))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(bpe.decoded(F.col("ids")), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    named = (op1_syncmer_fingerprints, op2_order_minhash, op3_url_filter, op4_cross_polytope, op5_warc_archive, op6_toxicity, op7_surrogates, op8_language, op9_packing, op10_mixing, op11_hard_negatives, op12_filter_audit, op13_byte_bpe)
    return {f.__name__: f for f in named}


_HOST = "CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express."""
    return {
        "op3_url_filter": f"""
            WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
            f AS (SELECT *, CASE
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
            SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f""",
        "op5_warc_archive": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
            d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
            m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM d)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN first <> page_id THEN first END AS refers_to FROM m""",
        "op11_hard_negatives": """
            WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                       FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
                  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
            p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
            QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10""",
        "op12_filter_audit": r"""
            WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
            w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
            m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
                    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask FROM w),
            c AS (SELECT part, mask, count(*) AS n, count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic
                  FROM m LEFT JOIN labels USING (doc_id) GROUP BY ALL),
            f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
            p AS (SELECT '' AS prefix, 0 AS before, 0 AS bit, '' AS letter
                  UNION ALL SELECT prefix || f.letter, before | p.bit, f.bit, f.letter FROM p, f WHERE (before | p.bit) & f.bit = 0),
            s AS (SELECT part, prefix, letter, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
                    sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
                    sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost
                  FROM p, c WHERE prefix <> '' GROUP BY ALL),
            o AS (SELECT s.*, q.prefix AS filter_order FROM p q JOIN s ON length(q.prefix) = 5 AND starts_with(q.prefix, s.prefix))
            SELECT part, filter_order, length(prefix)::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
                coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
                coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM o""",
    }
