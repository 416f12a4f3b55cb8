"""Documented functions mined from source files, and the filters on their quality."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mendloom.functions.text import col
from mendloom.schemas import TASK
from mendloom.sources.folders import spread

FUNCTIONS, ASSIGNING = (ast.FunctionDef, ast.AsyncFunctionDef), (ast.Assign, ast.AnnAssign, ast.For, ast.With)
#: Values in a syntax tree that add nothing and have nothing below them, or names alone.
LEAVES = {type(None), str, int, ast.Name, *(k for base in (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop) for k in base.__subclasses__())}
#: Words that mark SQL, boilerplate and sections.
SQL_WORDS = ("SELECT", "FROM", "WHERE", "JOIN", "GROUP BY", "ORDER BY", "HAVING", "UNION", "INSERT", "UPDATE", "DELETE", "CREATE TABLE")
BOILERPLATE = ("# noqa", ":rtype:", "Gets the", "Sets the")
SECTIONS = "args:|arguments:|parameters:|params:|returns:|yields:|raises:|example"


def _plain(target: ast.expr | None) -> list[str]:
    return [target.id] if isinstance(target, ast.Name) else []


def _assigned(node: ast.AST) -> list[str]:
    """Names that a statement assigns. Tuples and lists count in plain assignments alone."""
    if isinstance(node, ast.Assign):
        return [n for t in node.targets for e in (t.elts if isinstance(t, ast.Tuple | ast.List) else [t]) for n in _plain(e)]
    if isinstance(node, ast.AnnAssign | ast.For):
        return _plain(node.target)
    return [n for i in node.items for n in _plain(i.optional_vars)] if isinstance(node, ast.With) else []


class _Function:
    """A function with the names and string literals inside it, those of inner functions included; arguments are its own alone."""

    def __init__(self, node: ast.FunctionDef | ast.AsyncFunctionDef, outer: _Function | None):
        self.node, self.outer = node, outer
        self.names: set[str] = set()
        self.literals: list[tuple[int, str]] = []


def functions_of(tree: ast.AST) -> list[_Function]:
    """All functions of a syntax tree, outer before inner: each node is seen once, and what it adds goes from inner to outer functions."""
    found: list[_Function] = []
    level, nth = [(tree, None)], 0
    while level:
        below = []
        for node, owner in level:
            if owner is not None and isinstance(node, ASSIGNING):
                owner.names.update(_assigned(node))
            if isinstance(node, FUNCTIONS):
                owner = _Function(node, owner)
                found.append(owner)
            for name in node._fields:
                value = getattr(node, name, None)
                for child in value if type(value) is list else (value,):
                    kind = type(child)
                    if kind is ast.Constant:
                        nth += 1
                        if owner is not None and isinstance(child.value, str):
                            owner.literals.append((nth, child.value))
                    elif kind not in LEAVES and isinstance(child, ast.AST):
                        below.append((child, owner))
        level = below
    for f in reversed(found):
        if f.outer is not None:
            f.outer.names |= f.names
            f.outer.literals += f.literals
    return found


def documented(content: str) -> Iterator[tuple]:
    """Rows for the documented functions of one Python file, outer before inner, with what the filters need.

    Lines end as the parser ends them, so a file with carriage returns has the same spans.
    """
    try:
        found = functions_of(ast.parse(content))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    rows = re.split(r"\r\n|\r|\n", content)
    for f in found:
        node, docstring = f.node, ast.get_docstring(f.node)
        if not docstring:
            continue
        start, end = min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno
        masked = [*rows[: start - 1], f"# MASKED: {node.name} function (lines {start}-{end})", *rows[end:]]
        decorated = any(isinstance(d, ast.Name) and d.id == "property" for d in node.decorator_list)
        control = any(isinstance(x, ast.If | ast.For | ast.While) for x in node.body)
        variables = len(f.names | {a.arg for a in node.args.args})
        yield node.name, docstring, start, end, "\n".join(rows[start - 1 : end]), "\n".join(masked).removesuffix("\n"), len(node.body), variables, control, decorated, isinstance(node, ast.AsyncFunctionDef), [v for _, v in sorted(f.literals, key=lambda x: x[0])]


def mine(files: DataFrame, key: str = "file_id", content: str = "content", whole: bool = False) -> DataFrame:
    """One row per documented function of each file, with the ``whole`` content last if asked for; a null file has none.

    Files are dealt to all tasks first: parsing costs far more than reading, and a table of many files may be one Parquet row group.
    They are dealt by their hash, since dealing in turn would sort all files that a task reads in its memory.
    """
    read = spread(files.select(key, content), key, content)
    schema = T.StructType([read.schema[key], *T._parse_datatype_string(TASK).fields, *([read.schema[content]] if whole else [])])
    shape = to_arrow_schema(schema)
    n_task = len(shape) - 1 - whole

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, found = [], []
            for i, text in enumerate(batch.column(1)):
                own = list(documented(text.as_py() or ""))
                found += own
                place += [i] * len(own)
            columns = list(zip(*found, strict=True)) or [()] * n_task
            taken = [c.take(pa.array(place, pa.int64())) for c in batch.columns[: 1 + whole]]
            yield pa.RecordBatch.from_arrays([taken[0], *(pa.array(c, f.type) for c, f in zip(columns, list(shape)[1 : 1 + n_task], strict=True)), *taken[1:]], names=shape.names)

    return read.mapInArrow(emit, schema)


def mask_span(content: Column | str, name: Column | str, start: Column | str, end: Column | str) -> Column:
    """The file with a span of lines replaced by a placeholder line."""
    rows = F.split(col(content), "\n", -1)
    mark = F.concat(F.lit("# MASKED: "), col(name), F.lit(" function (lines "), col(start).cast("string"), F.lit("-"), col(end).cast("string"), F.lit(")"))
    after = F.slice(rows, col(end) + 1, F.greatest(F.size(rows) - col(end), F.lit(0)))
    return F.regexp_replace(F.array_join(F.concat(F.slice(rows, F.lit(1), col(start) - 1), F.array(mark), after), "\n"), r"\n\z", "")


def good_docstring(least: int = 50) -> Column:
    """Long enough, of several lines, no boilerplate, no getter, and with sections or three full sentences."""
    d = F.col("docstring")
    bare = F.regexp_replace(d, r"^[\s\"']+|[\s\"']+\z", "")
    full = F.size(F.filter(F.split(d, "\n"), lambda s: F.rlike(s, F.lit(r"\S")))) >= 2
    boilerplate = F.rlike(d, F.lit("|".join(BOILERPLATE)))
    getter = ~F.col("is_async") & (F.col("is_property") | (F.col("n_body") <= 2))
    sentences = F.size(F.filter(F.split(d, r"[.!?]+"), lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+\z", "")) > 10)) >= 3
    return (F.length(d) >= least) & (F.length(bare) >= 0.8 * least) & full & ~boilerplate & ~getter & (F.rlike(F.lower(d), F.lit(SECTIONS)) | sentences)


def code_reject(most: int = 15) -> Column:
    """Why code is rejected: sql, variables, simple; null if it isn't."""
    sql = F.exists("literals", lambda s: F.rlike(F.upper(s), F.lit("|".join(SQL_WORDS))))
    return F.when(sql, "sql").when(F.col("n_vars") > most, "variables").when((F.col("n_body") < 4) & ~F.col("has_control"), "simple")


def task_statistics(tasks: DataFrame) -> DataFrame:
    """Count, mean docstring length and mean implementation length."""
    return tasks.agg(F.count("*").alias("tasks"), F.round(F.avg(F.length("docstring")), 6).alias("docstring_length"), F.round(F.avg(F.length("implementation")), 6).alias("implementation_length"))


def common_names(tasks: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The most frequent function names, ties to the first seen."""
    return tasks.groupBy("function_name").agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(n)


def funnel(functions: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Files, files with an accepted function, and functions rejected by reason; docstring rejects aren't counted."""
    judged = functions.withColumn("reason", F.when(good_docstring(), F.coalesce(code_reject(), F.lit("accepted"))))
    by_file = judged.groupBy(key).agg(*(F.count_if(F.col("reason") == r).alias(r) for r in ("accepted", "sql", "variables", "simple")))
    total = files.agg(F.count_distinct(key).alias("files"))
    sums = by_file.agg(F.count_if(F.col("accepted") > 0).alias("files_accepted"), *(F.coalesce(F.sum(r), F.lit(0)).alias(f"skipped_{r}") for r in ("sql", "variables", "simple")))
    return total.crossJoin(sums).withColumn("share_accepted", F.round(F.col("files_accepted") / F.greatest("files", F.lit(1)), 6))
