"""Sources mixed to target weights by budgets that flow down a domain-language-source tree."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendloom.llm.common import materialise

#: Hash slices of a leaf, and of the slice in which its budget ends: only one of the 2^24 is ever ordered row by row.
SLICE_BITS = 12


def count_tokens(text: Column) -> Column:
    """Words between white space; 0 for null. For budgets in ids of a tokenizer see ``packing.id_counter``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def water_fill(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``children`` with ``budget``: their parent's budget by weight, what one can't use going to its siblings.

    Needs parent_budget, weight and capacity. In order of capacity per weight the children that are
    full come first; the others share what is left by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))), name)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    marked = children.withColumns({"left_": left, "share_": share}).withColumn("full_", (F.col("weight") > 0) & (F.col("capacity") * F.col("share_") <= F.col("weight") * F.col("left_") * (1 + 1e-12)))
    level = F.min(F.when(~F.col("full_") & (F.col("weight") > 0), F.struct(F.col("share_") * -1, F.col("left_") / F.col("share_")))).over(whole)
    return marked.withColumn("budget", F.when(F.col("full_"), F.col("capacity").cast("double")).otherwise(F.coalesce(F.col("weight") * level["col2"], F.lit(0.0)))).drop("left_", "share_", "full_", "parent_budget")


def leaf_budgets(supply: DataFrame, levels: Sequence[str], weights: Sequence[Column], total: float, epochs: int) -> DataFrame:
    """Leaves with tokens and budget. ``weights[i]`` is the weight of a node of level i, from the level columns.

    Budgets go from the root down. A node takes no more than its leaves can give in ``epochs``, so a
    shortage is spread over siblings first, and over the siblings of an ancestor only when all are full.
    """
    tree = supply.withColumn("capacity", F.col("tokens") * epochs)
    for i, weight in enumerate(weights):
        tree = tree.withColumn(f"weight_{i}", weight.cast("double"))
    usable = F.col("weight_0") > 0
    for i in range(1, len(levels)):
        usable = usable & (F.col(f"weight_{i}") > 0)
    tree = tree.withColumn("capacity", F.when(usable, F.col("capacity")).otherwise(0))
    budgets = None
    for i, name in enumerate(levels):
        path = list(levels[: i + 1])
        nodes = tree.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.max(f"weight_{i}").alias("weight"))
        if budgets is None:
            nodes = nodes.withColumn("parent_budget", F.least(F.lit(float(total)), F.sum("capacity").over(Window.partitionBy(F.lit(0))).cast("double")))
            parent = [F.lit(0)]
        else:
            nodes = nodes.join(budgets.withColumnRenamed("budget", "parent_budget"), path[:-1])
            parent = path[:-1]
        budgets = water_fill(nodes, parent, name).select(*path, "budget")
    return tree.select(*levels, "tokens", *[c for c in ("documents",) if c in tree.columns]).join(budgets, list(levels))


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, key)


def cuts(rows: DataFrame, budgets: DataFrame, levels: Sequence[str], seed: int, epochs: int) -> DataFrame:
    """Per leaf: whole epochs, and the last hash and id of the prefix of the next epoch.

    An epoch orders a leaf by a seeded hash of the id. Sums over hash slices find the slice in which
    the budget ends, and sums over that slice's own slices again; only the last is ordered row by row.
    """
    whole = F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.lit(epochs)).cast("int")
    leaves = budgets.where("tokens > 0").withColumn("whole", whole).withColumn("rest", F.when(F.col("whole") >= epochs, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("budget") - F.col("whole") * F.col("tokens")))).select(*levels, "budget", "whole", "rest")
    hashed = rows.join(leaves.where("rest >= 1"), list(levels)).withColumn("hash", _order(seed, F.col("whole"), F.col("doc_id")))
    inside = hashed.withColumn("before", F.lit(0).cast("long")).select(*levels, "doc_id", "n_tokens", "rest", "hash", "before")
    for level in (1, 2):
        slices = inside.withColumn("slice", F.shiftright("hash", 64 - level * SLICE_BITS))
        sums = slices.groupBy(*levels, "slice", "rest", "before").agg(F.sum("n_tokens").alias("n"))
        earlier = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        last = sums.where("before < rest and before + n >= rest").select(*levels, "slice", "before")
        inside = slices.drop("before").join(last, [*levels, "slice"]).drop("slice")
    ids = inside.groupBy(*levels, "rest", "before", "hash", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    run = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("hash", "doc_id")) - F.col("n_tokens")
    point = ids.withColumn("run", run).where("run < rest").groupBy(*levels).agg(F.max(F.struct("hash", "doc_id")).alias("point"))
    return leaves.join(point, list(levels), "left").select(*levels, F.col("whole").alias("mix_whole_"), F.col("point.hash").alias("mix_hash_"), F.col("point.doc_id").alias("mix_id_"))


def select(docs: DataFrame, cut: DataFrame, levels: Sequence[str], seed: int) -> DataFrame:
    """``docs`` once for every epoch in which they are chosen, with ``epoch``. The leaf table is joined; no text is ordered."""
    own = _order(seed, F.col("mix_whole_"), F.col("doc_id"))
    upto = F.coalesce(F.col("doc_id") <= F.col("mix_id_"), F.col("doc_id").isNull())  # null ids come first
    inside = (own < F.col("mix_hash_")) | ((own == F.col("mix_hash_")) & upto)
    many = F.col("mix_whole_") + F.coalesce(inside, F.lit(False)).cast("int")
    met = docs.join(cut, list(levels)).withColumn("mix_many_", many).where("mix_many_ > 0")
    return met.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("mix_many_") - 1))).drop("mix_many_", "mix_whole_", "mix_hash_", "mix_id_")


def with_levels(docs: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """``docs`` with the level columns as text, null being ''."""
    return docs.withColumns({k: F.coalesce(c.cast("string"), F.lit("")) for k, c in levels.items()})


def mix(docs: DataFrame, levels: dict[str, Column], weights: Sequence[Column], share: float, epochs: int, seed: int, count: Callable[[Column], Column] = count_tokens) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(level columns, doc_id and n_tokens of every row; budgets; cuts) for a total of ``share`` of all tokens.

    ``count`` gives a text's tokens. The prefix ends with the document that reaches the budget, so a leaf exceeds it by less than the
    rows of one id. Null levels are the leaf ''. Null texts have no tokens; documents without an id or
    tokens are chosen in whole epochs and by their hash like others. Rows of equal id share their fate.
    """
    names = list(levels)
    rows = materialise(with_levels(docs, levels).select(*names, F.col("doc_id").cast("long").alias("doc_id"), count(F.col("text")).cast("long").alias("n_tokens")), "tokens")
    supply = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    supply = materialise(supply, "supply")
    total = (supply.agg(F.sum("tokens")).first()[0] or 0) * share
    budgets = materialise(leaf_budgets(supply, names, weights, total, epochs), "budgets")
    return rows, budgets, materialise(cuts(rows, budgets, names, seed, epochs), "cuts")
