"""Hard negatives against a plain loop; blocks against what their bounds say."""

import duckdb
import numpy as np
import pytest
from conftest import DATA, TABLES, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mendloom.llm import hard_negatives, queries


def by_hand(vectors, dims, every=100):
    """Rows of a loop over all pairs."""
    table = []
    for key, label, v in vectors:
        if key is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * np.float64(x))) for x in v] + [0] * (dims - len(v))
        if sum(x * x for x in q) <= 1 << 62:
            table.append((key, label, tuple(q)))
    table, out = sorted(set(table)), []
    for key, label, q in (r for r in table if r[0] % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(q, r[2], strict=True)), r[0], r[1]) for r in table if r[0] != key)
        for s, other, _ in [r for r in scored if r[2] == label][:5]:
            fit = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(key, other, i + 1, n, -s, -t) for i, (t, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, vectors, size, every=100):
    frame = spark.createDataFrame([(*v, 1, "q") for v in vectors], "vec_id long, label int, embedding array<double>, block int, q string")
    return sorted(map(tuple, hard_negatives.mine(frame.repartition(3), F.col("vec_id"), F.col("label"), F.col("embedding"), every, size=size).collect()))


def near(centres, n, dims, apart, seed):
    """Vectors around a few centres, labels across them."""
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dims))
    return [(i, int(draw.integers(4)), (apart * middle[i % centres] + draw.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_negatives_are_those_of_a_plain_loop(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "HELD", 200)
    monkeypatch.setattr(hard_negatives, "RUNS", 2)
    vectors = near(5, 700, 9, 1.0, 1)
    assert mined(spark, vectors, size, 10) == by_hand(vectors, 9, 10)


def test_odd_rows(spark):
    draw = np.random.default_rng(2)
    vectors = [(i, i % 3, draw.normal(size=4).tolist()) for i in range(300)]
    hot = [0.5, 0.5, 0.5, 0.5]
    vectors += [(1000 + i, i % 2, hot) for i in range(150)]  # ties, and copies that are anchors
    vectors += vectors[:20] + [(100, 1, hot), (100, 2, [1.0, 0.0, 0.0, 0.0]), (None, 1, hot), (200, None, hot), (300, 1, None), (400, 1, [float("nan")] * 4), (500, 1, [1.0, None, 0.0, 0.0])]
    vectors += [(600, 1, [float("inf"), 0.0, 0.0, 0.0]), (700, 1, [1e300, 0.0, 0.0, 0.0]), (800, 1, [1e6, 1e6, 0.0, 0.0]), (801, 2, [8e5, 9e5, 0.0, 0.0]), (802, 1, [2.0]), (900, 2, []), (-100, 0, [0.0] * 4), (-200, 2, [-1.0] * 4)]
    assert mined(spark, vectors, 32) == by_hand(vectors, 4)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, [], 8) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])], 8) == []
    assert mined(spark, [(100, 1, None)], 8) == []
    assert mined(spark, [(100, 1, [])], 8) == []
    assert mined(spark, [(100, 1, [1.0]), (2, 1, [1.0])], 8) == []


def test_rounds_of_anchors(spark, monkeypatch):
    vectors = near(3, 400, 5, 2.0, 3)
    monkeypatch.setattr(hard_negatives, "ROUND_BYTES", 1)  # 64 anchors a round
    assert mined(spark, vectors, 16, 2) == by_hand(vectors, 5, 2)


@given(st.integers(1, 4), st.integers(1, 3))
@settings(max_examples=12, deadline=None)
def test_the_curve_goes_from_cell_to_neighbour(dims, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    order = sorted(range(len(cells)), key=lambda i, at=hard_negatives.hilbert_index(cells, bits): at[i].tobytes())
    steps = np.abs(np.diff(cells[order], axis=0)).sum(1)
    assert (steps == 1).all()


@given(st.integers(0, 1000), st.sampled_from([1, 1000, 1 << 40]))
@settings(max_examples=60, deadline=None)
def test_bounds_hold_every_score(seed, wide):
    draw = np.random.default_rng(seed)
    a, m = (draw.integers(-wide, wide + 1, (n, 5)).astype(np.int64) for n in (4, 30))
    least, most = hard_negatives.bounds(a, m.min(0)[None], m.max(0)[None])
    exact = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in m] for u in a]
    assert all(least[i, 0] <= min(row) and most[i, 0] >= max(row) for i, row in enumerate(exact))
    if wide < 1 << 40:
        assert hard_negatives.scores(a, m).tolist() == exact


def test_blocks_out_of_reach_are_not_read(spark):
    vectors = near(40, 6000, 8, 8.0, 4)
    frame = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")
    q = hard_negatives.quantised(frame, F.col("vec_id"), F.col("label"), F.col("embedding"), 8)
    blocks = hard_negatives.written_blocks(hard_negatives.pack(q, 8, lambda ids: ids % 100 == 0, 5, 32))
    anchors = hard_negatives.anchors_of(blocks, 8, lambda ids: ids % 100 == 0).orderBy("nth").toPandas()
    assert anchors["nth"].tolist() == list(range(60)) and sorted(anchors["vec_id"]) == list(range(0, 6000, 100))
    own = hard_negatives.Round(anchors["label"].to_numpy(), anchors["vec_id"].to_numpy(), np.array(anchors["q"].tolist()), anchors["floor"].to_numpy()[:, None], np.full((60, 1), 1 << 62), True)
    wanted = hard_negatives.wanted_blocks(blocks, spark.sparkContext.broadcast(own)).toPandas()
    assert wanted["anchors"].sum() < 0.1 * 60 * blocks.count()  # pairs of anchor and block that are read
    spans = hard_negatives.runs(spark.createDataFrame(wanted))
    assert all(any(a <= b <= z for a, z in spans) for b in wanted["block"]) and len(spans) <= hard_negatives.RUNS


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.op11_hard_negatives(spark, DATA).toPandas()
    assert len(got) and rows(got) == rows(con.sql(queries.oracle_sql()["op11_hard_negatives"]).df())
