"""Search/replace diffs as arrays of (search, replace) blocks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendloom.functions.text import col, lines, occurrences, once, strip
from mendloom.operators.selection import numbered
from mendloom.schemas import BLOCKS
from mendloom.sources.scratch import written

#: Lines that open, part and close a block.
OPENS, PARTS, CLOSES = r"^<{3,}\s*SEARCH", r"^={5,}", r"^>{3,}\s*REPLACE"
PERFECT = r"(?s)<<<<<<< SEARCH\n.*?\n=======\n.*?\n>>>>>>> REPLACE"


def no_blocks() -> Column:
    """An empty list of blocks."""
    return F.array().cast(BLOCKS)


def parse_blocks(x: Column | str, mode: str = "intended") -> Column:
    """All search/replace blocks of a text, without the line end before a marker; none for null.

    A machine over the marker lines: an opener begins a block, and drops one that wasn't closed; a closer
    ends it if it was parted; markers outside of a block are orphans and count for nothing. Of several
    lines that could part a block the first as wide as its opener does, else the first of nothing
    but ``=``, else the first: so a heading underlined in the code parts nothing.

    ``compat`` reads texts by paragraphs instead, and malformed markers by looser patterns: see ``paragraph_blocks``.
    """
    if mode == "compat":
        return paragraph_blocks(x)
    return once(F.split(F.coalesce(col(x), F.lit("")), "\n", -1), _line_blocks)


def _line_blocks(each: Column) -> Column:
    """Blocks of the lines of a text."""
    like = lambda s, p: F.rlike(s, F.lit(p))
    kind = lambda s: F.when(like(s, OPENS), 1).when(like(s, PARTS), 2).when(like(s, CLOSES), 3).otherwise(0)
    width = lambda s: F.length(F.regexp_extract(s, "^[<=]+", 0))
    marks = F.transform(each, lambda s, i: F.struct(i.alias("at"), kind(s).alias("kind"), width(s).alias("width"), like(s, r"^=+\s*$").alias("bare")))
    marks = F.filter(marks, lambda m: m["kind"] > 0)
    state = "struct<open:int,width:int,rank:int,parted:int,found:array<struct<open:int,parted:int,closed:int>>>"
    nothing = F.array().cast("array<struct<open:int,parted:int,closed:int>>")

    def of(open_: Column, width: Column, rank: Column, parted: Column, found: Column) -> Column:
        return F.struct(open_.alias("open"), width.alias("width"), rank.alias("rank"), parted.alias("parted"), found.alias("found")).cast(state)

    def step(acc: Column, m: Column) -> Column:
        rank = F.when(m["bare"] & (m["width"] == acc["width"]), 1).when(m["bare"], 2).otherwise(3)
        closed = F.concat(acc["found"], F.array(F.struct(acc["open"].alias("open"), acc["parted"].alias("parted"), m["at"].alias("closed"))))
        out = F.when(m["kind"] == 1, of(m["at"], m["width"], F.lit(9), F.lit(-1), acc["found"]))
        out = out.when((acc["open"] < 0) | ((m["kind"] == 2) & (rank >= acc["rank"])), acc)
        out = out.when(m["kind"] == 2, of(acc["open"], acc["width"], rank, m["at"], acc["found"]))
        return out.otherwise(of(F.lit(-1), F.lit(0), F.lit(9), F.lit(-1), F.when(acc["parted"] >= 0, closed).otherwise(acc["found"])))

    found = F.aggregate(marks, of(F.lit(-1), F.lit(0), F.lit(9), F.lit(-1), nothing), step)["found"]
    between = lambda a, b: F.array_join(F.slice(each, a + 2, b - a - 1), "\n")
    return F.transform(found, lambda b: F.struct(between(b["open"], b["parted"]).alias("search"), between(b["parted"], b["closed"]).alias("replace")))


#: Patterns for paragraphs whose markers are malformed, from strict to loose. The first that fits gives the block.
PRIMARY = r"(?s)<<<+\s*SEARCH\s*>*\n(.*?)\n=+\n(.*?)\n>>>+\s*REPLACE\s*<*"
NO_SEARCH = r"(?s)<<<+\s*SEARCH\s*>*\n=+\n(.*?)\n>>>+\s*REPLACE\s*<*"
BLANKS = r"(?s)<<<+\s*SEARCH\s+\n(.*?)\n=+\s+\n(.*?)\n>>>+\s*REPLACE\s+"
TRAILING = r"(?s)<<<+\s*SEARCH\s*.*?\n(.*?)\n=+.*?\n(.*?)\n>>>+\s*REPLACE\s*.*?"
NO_DIVIDER = r"(?s)<<+\s*SEARCH\s*>*\n(.*?)>>+\s*REPLACE\s*<*"
MARKERS = r"<*\s*SEARCH\s*>*|\n=+\n|<*\s*REPLACE\s*>*"
WORDS_ONLY = r"(?s)(?:.*?SEARCH.*?[\r\n]+)(.*?)(?:.*?(?:=+|DIVIDER).*?[\r\n]+)(.*?)(?:.*?REPLACE)"


def _loose(s: Column) -> Column:
    """The block of one malformed paragraph, or null: without a divider its lines are parted in the middle, and last
    of all it is cut at marker words wherever they stand, of which the first two full parts count."""
    fits = lambda p: F.rlike(s, F.lit(p))
    pair = lambda search, replace: F.struct(search.alias("search"), replace.alias("replace"))
    groups = lambda p: pair(F.regexp_extract(s, p, 1), F.regexp_extract(s, p, 2))
    inner = lines(F.regexp_extract(s, NO_DIVIDER, 1))
    middle = F.floor(F.size(inner) / 2).cast("int")
    halves = pair(F.array_join(F.slice(inner, F.lit(1), middle), "\n"), F.array_join(F.slice(inner, middle + 1, F.size(inner) - middle), "\n"))
    has = lambda w: F.contains(s, F.lit(w))
    words = has("SEARCH") & has("REPLACE") & (has("=====") | has("DIVIDER"))
    full = F.filter(F.transform(F.split(s, MARKERS, -1), strip), lambda p: p != "")
    out = F.when(fits(PRIMARY), groups(PRIMARY)).when(fits(NO_SEARCH), pair(F.lit(""), F.regexp_extract(s, NO_SEARCH, 1)))
    out = out.when(fits(BLANKS), groups(BLANKS)).when(fits(TRAILING), groups(TRAILING)).when(fits(NO_DIVIDER), halves)
    out = out.when(words & fits(WORDS_ONLY), pair(strip(F.regexp_extract(s, WORDS_ONLY, 1)), strip(F.regexp_extract(s, WORDS_ONLY, 2))))
    return out.when(words & (F.size(full) >= 2), pair(F.get(full, 0), F.get(full, 1)))


def paragraph_blocks(x: Column | str) -> Column:
    """Blocks as paragraphs: one a paragraph at most, both sides stripped; malformed ones by ever looser patterns.

    A text in which a marker line lacks its partners, or a divider line stands before a search marker,
    has none; so has an ordinary text of several blocks, and code with blank lines is cut apart. Blocks
    glued together without a blank line are parted between REPLACE and SEARCH.
    """

    def parsed(x: Column) -> Column:
        has = lambda p: F.rlike(x, F.lit(p))
        orphan = (has("=======") & has("REPLACE") & ~has("SEARCH")) | (has("SEARCH") & ~has("=======") & ~has("REPLACE")) | has(r"(?s)=+\n.*?\n<<<+\s*SEARCH")
        parted = F.split(x, "\n\n", -1)
        glued = F.split(x, r"(?<=REPLACE)\s*(?=<+\s*SEARCH)", -1)
        pieces = F.when((F.size(parted) == 1) & (occurrences(x, "SEARCH") > 1), glued).otherwise(parted)
        piece = r"(?s)SEARCH[^\n]*\n(.*?)=======[^\n]*\n(.*?)[^\n]*REPLACE"
        side = lambda s, i: F.regexp_replace(F.regexp_extract(s, piece, i), r"^\s+|\s+\z", "")
        found = F.transform(pieces, lambda s: F.when(F.rlike(s, F.lit(piece)), F.struct(side(s, 1).alias("search"), side(s, 2).alias("replace"))).otherwise(_loose(s)))
        return F.when(orphan, no_blocks()).otherwise(F.filter(found, lambda b: b.isNotNull()))

    return once(F.coalesce(col(x), F.lit("")), parsed)


def apply_blocks(code: Column | str, blocks: Column | str) -> Column:
    """Code after each block in turn: all places of its search text are replaced; an empty search fills empty code only."""
    step = lambda acc, b: F.when(b["search"] == "", F.when(acc == "", b["replace"]).otherwise(acc)).otherwise(F.replace(acc, b["search"], b["replace"]))
    return F.aggregate(col(blocks), col(code), step)


def render_blocks(blocks: Column | str) -> Column:
    """Blocks as text, an empty line between them."""
    one = lambda b: F.concat(F.lit("<<<<<<< SEARCH\n"), b["search"], F.lit("\n=======\n"), b["replace"], F.lit("\n>>>>>>> REPLACE"))
    return F.array_join(F.transform(col(blocks), one), "\n\n")


def hunk_blocks(x: Column | str) -> Column:
    """One block for each hunk of a unified diff that changes something."""
    hunks = F.slice(F.split(col(x), r"(?md)^@@ .+? @@.*$", -1), 2, 1_000_000)

    def block(h: Column) -> Column:
        keep = lambda marks: F.array_join(F.transform(F.filter(lines(h), lambda s: F.substr(s, F.lit(1), F.lit(1)).isin(*marks)), lambda s: F.substr(s, F.lit(2))), "\n")
        return F.struct(keep(" -").alias("search"), keep(" +").alias("replace"))

    return F.filter(F.transform(F.filter(hunks, lambda h: F.rlike(h, F.lit(r"\S"))), block), lambda b: b["search"] != b["replace"])


def format_quality(x: Column | str, mode: str = "intended") -> Column:
    """How well a text keeps the block format, from 0 to 1; ``mode`` is that of ``parse_blocks``."""
    return once(F.coalesce(col(x), F.lit("")), lambda text: _quality(text, mode))


def _quality(x: Column, mode: str) -> Column:
    has = lambda p: F.rlike(x, F.lit(p))
    n = {w: occurrences(x, w) for w in ("SEARCH", "REPLACE", "=======")}
    both = (n["SEARCH"] > 0) & (n["REPLACE"] > 0)
    cost = lambda amount, when: F.when(when, amount).otherwise(0.0)
    base = 1.0 - cost(0.4, n["SEARCH"] == 0) - cost(0.4, n["REPLACE"] == 0) - cost(0.2, (n["======="] == 0) & ~F.contains(x, F.lit("DIVIDER")))
    perfect = has(PERFECT) & (n["SEARCH"] == 1) & (n["REPLACE"] == 1)
    found = F.size(parse_blocks(x, mode))
    less = (
        cost(0.1, ~F.contains(x, F.lit("<<<<<<< SEARCH")) & has(r"<<+\s*SEARCH"))
        + cost(0.1, ~F.contains(x, F.lit(">>>>>>> REPLACE")) & has(r">>+\s*REPLACE"))
        + cost(0.05, has(r"SEARCH\s+[^\n]"))
        + cost(0.05, has(r"REPLACE\s+[^\n]"))
        + cost(0.15, (n["SEARCH"] > 1) & (n["SEARCH"] != n["======="]))
        + cost(0.15, (n["REPLACE"] > 1) & (n["REPLACE"] != n["======="]))
        + cost(0.1, has(r"(<< SEARCH)|(>> REPLACE)"))
        + cost(0.05, has(r"=+\s+\n"))
        + cost(0.3, has(r"(?s)REPLACE.*?SEARCH") & ~has(r"(?s)SEARCH.*?REPLACE"))
        + cost(0.1, has(r"SEARCH[^\n]") | has(r"REPLACE[^\n]"))
        + F.when(both, F.when(found == 0, 0.2).otherwise(cost(0.1, ~has(PRIMARY)))).otherwise(0.0)
    )
    scored = F.when(base < 0.5, F.greatest(F.lit(0.0), base)).when(perfect, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - less)))
    return F.when(x == "", 0.0).otherwise(F.round(scored, 6))


def diff_blocks(before: Column | str, after: Column | str, context: int = 2) -> Column:
    """Blocks that turn one code into another, each change with ``context`` lines around it."""

    @F.pandas_udf(BLOCKS)
    def changes(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([changed_blocks(a, b, context) for a, b in zip(old, new, strict=True)])

    return changes(col(before), col(after))


def changed_blocks(before: str | None, after: str | None, context: int) -> list[dict]:
    """The blocks of one pair of codes; lines that aren't blank lose trailing white space."""
    before, after = before or "", after or ""
    if before == after:
        return []
    if not before or not after:
        return [{"search": before, "replace": after}]
    tidy = lambda text: [s.rstrip() if s.strip() else s for s in text.splitlines()]
    old, new = tidy(before), tidy(after)
    out = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes():
        pair = {"search": "\n".join(old[max(0, a - context) : b + context]), "replace": "\n".join(new[max(0, c - context) : d + context])}
        if kind != "equal" and any(pair.values()):
            out.append(pair)
    return out or [{"search": before, "replace": after}]


def _ratios(by_line: bool):
    cut = str.splitlines if by_line else str

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, cut(x), cut(y)).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    return ratio


#: Product of two lengths from which on a pair is heavy, and what a task takes of such products.
HEAVY, SHARE = 1 << 24, 1 << 28


def heavy_groups(heavy: DataFrame, share: int = SHARE) -> DataFrame:
    """Pairs with their ``cost_``, one partition for each group of about ``share`` in all, the dearest pairs dealt out first."""
    total, n = heavy.agg(F.sum("cost_"), F.count("*")).first()
    groups = int(max(1, min(n, -(-(total or 0) // share))))
    dealt = numbered(heavy.withColumn("dear_", -F.col("cost_")), ["dear_"], "deal_").withColumn("group_", F.col("deal_") % groups)
    return dealt.repartitionByRange(groups, "group_").drop("dear_", "deal_", "group_")


def with_ratios(pairs: DataFrame, **named: tuple[str, str, bool]) -> DataFrame:
    """``pairs`` with a ``sequence_ratio`` for each name, of (a, b, by_line).

    The time of a ratio grows with the product of the lengths. Pairs of a small product are scored
    where they are; heavy ones are written, and dealt to tasks by their cost, so that a pair of large
    texts keeps no others waiting. Null sides are empty texts.
    """
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("double")
    differ = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.col(b), F.lit("")), 0.0).otherwise(size(a) * size(b))
    cost = sum((differ(a, b) for a, b, _ in named.values()), F.lit(0.0)).cast("long")
    scored = lambda df: df.withColumns({n: sequence_ratio(a, b, by_line) for n, (a, b, by_line) in named.items()})
    heavy = written(pairs.withColumn("cost_", cost).where(F.col("cost_") > HEAVY), "heavy")
    light = scored(pairs.where(cost <= HEAVY))
    return light if heavy.isEmpty() else light.unionByName(scored(heavy_groups(heavy)).drop("cost_"))


def sequence_ratio(a: Column | str, b: Column | str, by_line: bool = False) -> Column:
    """Matched share of two sequences, of characters or lines; the order of the two matters.

    Equal sides are 1 and an empty side 0 without Python, which sees empty texts for those rows.
    """
    a, b = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    plain = (a == b) | (a == "") | (b == "")
    hard = lambda x: F.when(plain, F.lit("")).otherwise(x)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(_ratios(by_line)(hard(a), hard(b)))
