"""The audit of filter orders against a plain loop over documents and orders."""

import re
from itertools import permutations

from conftest import DATA, TABLES, rows
from pyspark.sql import functions as F

from mendloom.llm import filter_audit, queries
from mendloom.llm.common import materialise

WORDS = " ".join(f"w{i}" for i in range(250))
TEXTS = [
    None, "", "", " \t\n", "short", "Short #", WORDS, WORDS, WORDS, WORDS + " *", "AB " * 300, "AB " * 300, ("AB " * 300) + "|", "a " * 150, "x" * 5000,
    "w x \x85 \x1c" + WORDS, WORDS.replace("w", "É"), " ".join(f"V{i} v{i}" for i in range(9_000)), WORDS, "short", "Short #", "plain words", None,
]


def by_hand(docs, labels):
    """Rows of a loop over parts, orders and steps."""
    fails = []
    for key, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        said = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        said["E"] = key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in docs)
        good, toxic = (any(k == key and key is not None and v[i] == 1 for k, *v in labels) for i in range(2))
        fails.append((part or "", said, good, toxic))
    out = []
    for part in {f[0] for f in fails}:
        own, total, steps = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            for i, x in enumerate(order):
                before = order[:i]
                there = lambda f: not any(f[1][y] for y in before)  # noqa: B023, E731
                gone = [f for f in own if f[1][x] and there(f)]
                total[x] += len(gone)
                unique = sum(f[1][x] and sum(f[1].values()) == 1 for f in own)
                kept = sum(there(f) and not f[1][x] for f in own)
                steps.append((part, order, i + 1, kept, len(gone), sum(f[1][x] and not there(f) for f in own), unique, sum(f[2] for f in gone), sum(f[3] for f in gone), x))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def audited(spark, docs, labels):
    frame = spark.createDataFrame([(*d, 1, "m", "k") for d in docs], "doc_id long, text string, lang string, n int, mask string, key string")
    said = spark.createDataFrame([(*x, "part") for x in labels], "doc_id long, quality int, toxic int, part string")
    return sorted(map(tuple, filter_audit.audit(frame.repartition(3), said).collect()))


def test_all_orders_are_those_of_a_plain_loop(spark):
    docs = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(TEXTS)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 20, 2)] + [(0, 1, 1), (None, 1, 1), (4, None, None)]
    assert audited(spark, docs, labels) == by_hand(docs, labels)


def test_null_equal_and_hot_keys(spark):
    docs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, TEXTS[i % 9], "en" if i % 5 else None) for i in range(90)]
    docs += [(3, WORDS, "en"), (3, WORDS, "en"), (3, WORDS, "fr"), (2, "tie", "fr"), (2, "tie", "en"), (2, "tie", "en")]
    labels = [(7, 1, 0), (3, 1, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == by_hand(docs, labels)


def test_nothing_to_audit(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    assert audited(spark, [(1, None, None)], []) == by_hand([(1, None, None)], [])


def test_many_parts_pass_the_row_limit_of_recursion(spark):
    cells = materialise(spark.range(2000).selectExpr("cast(id as string) AS part", "cast(id % 4 as int) AS mask", "id AS n", "0L AS good", "0L AS toxic"), "many")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        got = filter_audit.audit_orders(cells, "AB")
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000"
        assert got.count() == 2000 * 2 * 2
        assert {tuple(r)[3:] for r in got.where("part = '1999' AND filter_order = 'BA'").collect()} == {(0, 1999, 0, 0, 0, 0, 1999), (0, 0, 1999, 0, 0, 0, 1999)}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_texts_are_read_once(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    plan = filter_audit.mask_cells(docs, labels, "doc_id", "text", F.col("lang"), filter_audit.failed(F.col("text"), filter_audit.text_filters), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 2 and plan.count("regexp_extract_all") == 1


def test_query_is_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(queries.op12_filter_audit(spark, DATA).toPandas()) == rows(con.sql(queries.oracle_sql()["op12_filter_audit"]).df())
