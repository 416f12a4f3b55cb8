"""The pipeline's stages in order, each on all its predecessor kept, and each against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mendloom.llm.common import materialise, table
from mendloom.llm.queries import tokenizer_path


def test_stages(spark):
    docs, seen = table(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA).persist()
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == before.columns and [t for _, t in docs.dtypes] == [t for _, t in before.dtypes]
    ids = {k: set(v.doc_id) for k, v in seen.items()}
    labels = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    assert len(ids["toxicity"]) > 0.7 * table(spark, DATA, "documents").count()
    assert sum(labels.get(i) == 0 for i in ids["toxicity"]) >= 0.95 * sum(v == 0 for v in labels.values())
    assert ids["near_duplicates"] < ids["toxicity"] and not seen["near_duplicates"].text.duplicated().any()
    assert ids["personal_data"] == ids["near_duplicates"] and not seen["personal_data"].text.str.contains(r"\d@mail\d", na=False).any()
    assert ids["mixture"] <= ids["personal_data"] and not seen["mixture"].doc_id.duplicated().any()
    assert ids["packing"] == ids["mixture"] and (seen["packing"].groupby("sequence_id").length.sum() <= 2048).all()


INSULTS = ["grobnik", "vilemaw", "snarfle"]
MAILS = ["ann.lee@mail.org", "bo_z@site.net"]
EXTRA = {"score": "'s'", "node": "1", "mark": "'m'", "kept_mark": "2", "budget": "3", "epoch": "'e'", "hash": "4", "rank": "5", "entities": "'x'", "part": "6"}


def made():
    """(doc_id, text, lang, source): unrelated texts, near and exact copies, insults, addresses, odd and repeated rows."""
    rng = random.Random(3)
    words = ["".join(rng.choice("bdfklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    texts = [[rng.choice(words) for _ in range(rng.randint(60, 90))] for _ in range(120)]
    near = [[*t[:30], "other", *t[31:]] for t in texts[:15]]
    copies = [t for t in texts[20:24] for _ in range(3)]
    toxic = [[*(rng.choice(words) for _ in range(20)), *rng.sample(INSULTS, 2), *(rng.choice(words) for _ in range(9))] for _ in range(90)]
    told = [[*t[:40], "write", "to", MAILS[i % 2], "now"] for i, t in enumerate([rng.choice(words) for _ in range(50)] for _ in range(8))]
    whole = [" ".join(t) for t in [*texts, *near, *copies, *toxic, *told]] + [texts[30] and "  ".join(texts[30]).upper()]
    odd = [None, "", " \n\t", "lone", " ".join(rng.choice(words) for _ in range(6000))]
    rows = [(1000 + i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src2", "", None])) for i, t in enumerate([*whole, *odd])]
    return [*rows, *rows[50:56], (None, "a text of no id that nothing else is like", "en", "src1")]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """(folder, the rows as documents with columns whose names clash with the operators' own, the rows)."""
    rows, at = made(), str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{at}/documents.parquet")
    labels = sorted({(k, int(any(w in INSULTS for w in (t or "").split()))) for k, t, _, _ in rows if k is not None})
    spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, frame.selectExpr("*", *(f"{v} AS {k}" for k, v in EXTRA.items())), rows


def kept(frame):
    assert frame.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_toxic_documents_go(spark, fixture):
    at, frame, rows = fixture
    want = [(k, t) for k, t, _, _ in rows if not any(w in INSULTS for w in (t or "").split())]
    assert kept(corpus_pipeline.reject_toxic(spark, frame, at)) == sorted(want, key=str)


def aligned(a, b):
    """Longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_one_document_of_each_group_stays(spark, fixture):
    at, frame, rows = fixture
    groups = defaultdict(list)
    for k, t, _, _ in rows:
        groups[tuple(re.findall(r"[^\W_]+", (t or "").lower()))].append((k, t))
    words = list(groups)
    grams = [[w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else [] for w in words]
    root = list(range(len(words)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(grams):
        for j in range(i):
            both = sum((Counter(a) & Counter(grams[j])).values())
            if both >= 0.8 * max(len(a), len(grams[j])) and both:
                m = aligned(a, grams[j])
                if m / (len(a) + len(grams[j]) - m) >= 0.8:
                    root[find(i)] = find(j)
    classes = defaultdict(list)
    for i, w in enumerate(words):
        classes[find(i)] += groups[w]
    least = lambda c: min((x for x in c), key=lambda x: (x[0] is None, x[0] or 0))
    assert kept(corpus_pipeline.one_of_each(spark, frame, at)) == sorted(map(least, classes.values()), key=str)


def test_personal_data_is_replaced_and_nothing_else(spark, fixture):
    at, frame, rows = fixture
    got = corpus_pipeline.without_personal_data(spark, frame, at)
    assert got.columns == corpus_pipeline.COLUMNS
    new = {}
    for r in got.collect():
        assert r.n_chars == len(r.text or "")
        new.setdefault(r.doc_id, []).append(r.text)
    assert sum(map(len, new.values())) == len(rows)
    address, drawn = re.compile("|".join(map(re.escape, MAILS))), defaultdict(set)
    for k, t, _, _ in rows:
        met = address.search(t or "")
        if not met:
            assert set(new[k]) == {t}
            continue
        for n in new[k]:
            head, tail = t[: met.start()], t[met.end() :]
            assert n.startswith(head) and n.endswith(tail)
            drawn[met[0]].add(n[len(head) : len(n) - len(tail)])
    assert set(drawn) == set(MAILS) and all(len(v) == 1 for v in drawn.values())
    spoken = [v.pop() for v in drawn.values()]
    assert len(set(spoken)) == 2 and not set(spoken) & set(MAILS) and all(re.fullmatch(r"[\w.]+@[\w.]+", s) for s in spoken)


def filled(budget, children):
    """Budgets of (weight, capacity) children: full ones leave what they can't use to the others, by weight."""
    out, open_ = [0.0] * len(children), {i for i, (w, c) in enumerate(children) if w > 0}
    while open_:
        share = sum(children[i][0] for i in open_)
        full = {i for i in open_ if children[i][1] <= children[i][0] * budget / share + 1e-9}
        if not full:
            for i in open_:
                out[i] = children[i][0] * budget / share
            break
        for i in full:
            out[i] = float(children[i][1])
        budget -= sum(children[i][1] for i in full)
        open_ -= full
    return out


def test_mixture_is_that_of_plain_water_filling(spark, fixture):
    at, frame, rows = fixture
    encode = Tokenizer.from_file(tokenizer_path()).encode
    keys = spark.createDataFrame([(r[0],) for r in rows], "k long").distinct()
    order = {r.k: r.h for r in keys.select("k", F.xxhash64(F.lit(corpus_pipeline.SEED), F.lit(0), "k").alias("h")).collect()}
    leaves = defaultdict(list)
    for k, t, lang, source in rows:
        s = source or ""
        domain = "crawl" if s == "src0" else "reference" if zlib.crc32(s.encode()) % 2 == 0 else "forum"
        leaves[domain, lang or "", s].append((order[k], k is not None, k or 0, t, len(encode(t or "", add_special_tokens=False).ids) + 1))
    room = {leaf: sum(r[-1] for r in held) for leaf, held in leaves.items()}
    weight = {"crawl": 0.4, "reference": 0.35, "forum": 0.25, "en": 0.5, "de": 0.2}
    budgets, total = {(): sum(room.values()) * corpus_pipeline.SHARE}, {}
    for depth in (1, 2, 3):
        for parent in {leaf[: depth - 1] for leaf in room}:
            below = sorted({leaf[:depth] for leaf in room if leaf[: depth - 1] == parent})
            sizes = [sum(n for leaf, n in room.items() if leaf[:depth] == b) for b in below]
            weights = [1.0 if depth == 3 else weight.get(b[-1], 0.05) for b in below]
            budgets.update(zip(below, filled(budgets[parent], list(zip(weights, sizes, strict=True))), strict=True))
    for leaf, held in leaves.items():
        run, last = 0, None
        for row in sorted(held, key=lambda r: r[:3]):
            if run >= budgets[leaf] - 1e-6:
                break
            run, last = run + row[-1], row[:3]
        total[leaf] = [r for r in held if last is not None and r[:3] <= last]
    want = [(k if known else None, t) for held in total.values() for _, known, k, t, _ in held]
    assert 0.5 * len(rows) < len(want) < len(rows)
    assert kept(corpus_pipeline.mixture(spark, frame, at)) == sorted(want, key=str)


def test_windows_are_those_of_plain_best_fit_decreasing(spark, fixture):
    at, frame, rows = fixture
    encode = Tokenizer.from_file(tokenizer_path()).encode
    want, lengths = [], []
    for k, t, _, _ in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            own = ids[start : start + 2048]
            want.append((k, start, len(own), zlib.crc32(own.tobytes()), len(ids)))
            lengths.append(len(own))
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits, key=left.__getitem__)] -= n
        else:
            left.append(2048 - n)
    got = corpus_pipeline.packed(spark, frame, at).toPandas()
    plain = [(None if k != k else int(k), *map(int, r)) for k, *r in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False)]
    assert sorted(plain, key=str) == sorted(want, key=str)
    used = got.groupby("sequence_id").length.sum()
    assert sorted(2048 - used) == sorted(left)
    for _, window in got.sort_values("offset").groupby("sequence_id"):
        assert window.offset.tolist() == [0, *np.cumsum(window.length)[:-1]]


def test_pipeline_of_nothing(spark, fixture, tmp_path):
    at, _, _ = fixture
    for name in ("documents", "labels"):
        table(spark, at, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_is_its_stages(spark, fixture):
    at, frame, _ = fixture
    docs = frame
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, at), name)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, at)
    assert sorted(whole.select(columns).collect(), key=str) == sorted(docs.select(columns).collect(), key=str)
