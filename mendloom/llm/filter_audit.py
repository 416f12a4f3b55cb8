"""What each filter of a chain removes, in every order of the filters.

Documents become masks of the filters they fail, and masks become counted cells. A recursive query
extends prefixes of filters by each unused one, joined with the cells, and carries the filters applied
so far as bits: each level of the recursion gives the figures of that step. Texts are read once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendloom.llm.common import materialise

#: Most filters of an audit: the orders are their factorial.
MOST_FILTERS = 8
_WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on a text and its words: A few words, B few distinct ones, C many capitals, D odd marks."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failed(text: Column, filters: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """Bits of the filters that a text fails, the first one's lowest. Its words are a lambda's variable, and so found once."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return F.transform(F.array(words), lambda w: sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters(text, w).values())), F.lit(0)))[0]


def repeated_texts(rows: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """Counts of rows(key, digest, n, ``by``, ``flags``), apart by whether the digest occurs under a smaller key.

    Rows are summed by digest and all else before they meet by digest alone, so a text with a third
    of all rows is a few rows there. A null key is smaller than none and has none smaller.
    """
    summed = rows.groupBy("digest", *by, *flags).agg(
        F.sum("n").alias("n"), F.min("key").alias("first"), F.min_by("n", "key").alias("at_first"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("keyless")
    )
    summed = summed.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    kept = F.col("keyless") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias("repeated"), kept.alias("n")), F.struct(F.lit(True).alias("repeated"), (F.col("n") - kept).alias("n")))
    split = summed.select(*by, *flags, F.explode(both).alias("of"))
    return split.select(*by, *flags, "of.*").where("n > 0")


def mask_cells(docs: DataFrame, labels: DataFrame, key: str, text: str, part: Column, mask: Column, repeats: int | None) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of ``mask`` (bit i: the i-th filter).

    ``mask`` comes from the text; ``repeats`` is the bit of one more filter, that the text is that of a
    document of smaller key. Labels count for a key if any of their rows says so. Rows are summed by key
    first: repeated rows and hot keys meet the labels as few rows, and null keys are spread.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    rows = rows.groupBy("key", "digest", "part", "mask").agg(F.count("*").alias("n"))
    spread = F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(0)
    of = labels.groupBy(F.col(key).alias("key")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    rows = rows.withColumn("spread", spread).join(of.withColumn("spread", F.lit(0).cast("long")), ["key", "spread"], "left")
    rows = rows.select("key", "digest", "part", "mask", "n", F.coalesce("is_good", F.lit(False)).alias("is_good"), F.coalesce("is_toxic", F.lit(False)).alias("is_toxic"))
    if repeats is not None:
        rows = repeated_texts(rows, ["part", "mask"], ["is_good", "is_toxic"]).withColumn("mask", F.col("mask") + F.when(F.col("repeated"), 1 << repeats).otherwise(0))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("is_good"), F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("is_toxic"), F.col("n"))), F.lit(0)).alias("toxic")
    )


_FAILS = "(c.mask & f.bit) <> 0"
_LEFT = "(c.mask & r.applied) = 0"
_LEVELS = f"""
    WITH RECURSIVE prefixes (part, prefix, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
        SELECT part, '', 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
        UNION ALL
        SELECT r.part, concat(r.prefix, f.letter), r.applied | f.bit, f.letter,
            aggregate(p.cells, 0L, (s, c) -> s + if((c.mask & (r.applied | f.bit)) = 0, c.n, 0L)),
            aggregate(p.cells, 0L, (s, c) -> s + if({_FAILS} AND {_LEFT}, c.n, 0L)),
            aggregate(p.cells, 0L, (s, c) -> s + if({_FAILS} AND NOT {_LEFT}, c.n, 0L)),
            aggregate(p.cells, 0L, (s, c) -> s + if(c.mask = f.bit, c.n, 0L)),
            aggregate(p.cells, 0L, (s, c) -> s + if({_FAILS} AND {_LEFT}, c.good, 0L)),
            aggregate(p.cells, 0L, (s, c) -> s + if({_FAILS} AND {_LEFT}, c.toxic, 0L))
        FROM prefixes r JOIN {{cells}} p ON p.part = r.part LATERAL VIEW explode(filter(%filters%, x -> (r.applied & x.bit) = 0)) AS f)
    SELECT part, prefix, length(prefix) AS step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM prefixes WHERE prefix <> ''"""


def prefix_steps(cells: DataFrame, letters: str) -> DataFrame:
    """The last step of every prefix of every order, for each part: ``cells`` are those of ``mask_cells``.

    A part's cells (two to the number of filters at most) are one array. Spark ends a recursion at a
    number of rows set for the session; for the one write of this table it is set to what the parts need.
    """
    spark = cells.sparkSession
    if not re.fullmatch(f"[A-Za-z]{{1,{MOST_FILTERS}}}", letters) or len(set(letters)) != len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with letters of their own")
    by_part = materialise(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "cells")
    filters = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(letters))
    prefixes, n = 1, 1
    for left in range(len(letters), 0, -1):
        n *= left
        prefixes += n
    limit, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set(limit, str(max(int(before), prefixes * max(by_part.count(), 1) + 1)) if int(before) >= 0 else before)
    try:
        return materialise(spark.sql(_LEVELS.replace("%filters%", f"array({filters})"), cells=by_part), "prefixes")
    finally:
        spark.conf.set(limit, before)


def audit_orders(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, filter_order and step, zeros included.

    kept after the step, removed by it, redundant (fails its filter, removed before), unique_fails (fails
    its filter alone), good_lost and toxic_lost (of those removed), shapley (what its filter removes,
    summed over all orders).
    """
    steps = prefix_steps(cells, letters)
    last = steps.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    ways = F.lit(1.0)
    for i in range(1, len(letters)):
        ways = ways * F.when(F.lit(len(letters)) - F.col("step") >= i, i).otherwise(1)
    # a prefix's step is part of as many orders as the unused filters have
    shapley = steps.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways.cast("long")).alias("shapley"))
    each = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))).withColumn("prefix", F.expr("left(filter_order, step)"))
    return each.join(steps, ["part", "prefix", "step"]).join(shapley, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The five filters over whole texts (A to D of ``text_filters``, E: the text of a document of smaller key), by part.

    A null text is empty, a null part the empty string. Rows of null key are no copies and have none.
    Repeated rows count as often as they occur. An empty table gives no rows; other columns are ignored.
    """
    cells = mask_cells(docs, labels, key, text, F.col(part), failed(F.col(text), text_filters), 4)
    return audit_orders(cells, "ABCDE")
