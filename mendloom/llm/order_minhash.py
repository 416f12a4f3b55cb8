"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Each of ``m`` hash functions picks the ``l`` least occurrence-labelled word shingles of a text and
keeps them in text order; the ordered tuple is a bucket. Texts that share a bucket are compared:
two texts are near-duplicates if their shingle sequences align (longest common subsequence, in the
band that the threshold allows) with aligned / (n + m - aligned) >= 0.8. With m=16 and l=3 a pair at
exactly 0.8 misses every bucket with probability (1 - 0.8**3)**16, about 1e-5.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendloom.llm.common import connected_components, materialise
from mendloom.llm.url_filter import bloom_filter, possible_hits
from mendloom.llm.words import mix, occurrences, shingles

WIDTH, SIMILAR, FUNCTIONS, PICKED = 5, 0.8, 16, 3
#: Shingles that one task holds of each side of a comparison, every text counting as ``TEXT`` more; larger groups are cut into blocks.
BLOCK, TEXT = 1 << 21, 256
#: Members that all others of a cell are compared with before any further pairs are.
LEADERS = 32
#: Items up to which texts are aligned on whole rows of bits.
SHORT = 1024
#: Pairs of equal items for each item, beyond which texts are aligned by bits.
REPEATED = 4


def sketch(items: np.ndarray, functions: int = FUNCTIONS, picked: int = PICKED) -> np.ndarray:
    """The ``functions`` ordered tuples of ``picked`` least labelled shingles, each as one 64-bit number."""
    seeds = mix(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    labelled = occurrences(items)
    keys = seeds.copy()
    step = max(1, (1 << 18) // len(labelled))
    for at in range(0, functions, step):
        v = labelled[None, :] * seeds[at : at + step, None]
        v ^= v >> np.uint64(31)
        v *= np.uint64(0xFF51AFD7ED558CCD)
        if v.shape[1] > picked:
            place = np.argpartition(v, picked - 1, axis=1)[:, :picked]
            place.sort(axis=1)
        else:
            place = np.broadcast_to(np.arange(v.shape[1]), v.shape)
        for i in range(place.shape[1]):
            keys[at : at + step] = mix(keys[at : at + step]) + labelled[place[:, i]]
    return mix(keys)


def _by_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence by bit-parallel dynamic programming on whole rows of bits: the least work for short texts."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full, open_ = (1 << len(a)) - 1, (1 << 2 * band + 1) - 1
    row = full
    for j, y in enumerate(b.tolist()):
        if hit := at.get(y, 0) & (open_ << j - band if j >= band else open_ >> band - j):
            taken = row & hit
            row = ((row + taken) | (row - taken)) & full
    return len(a) - row.bit_count()


def _by_matches(first: np.ndarray, many: np.ndarray, places: np.ndarray, band: int) -> int:
    """Longest common subsequence from the pairs of equal items in the band: a longest rise of their places in ``b``."""
    i = np.repeat(np.arange(len(many)), many)
    back = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    j = places[np.repeat(first + many - 1, many) - back]
    j = j[np.abs(i - j) <= band]
    if (np.diff(j) > 0).all():
        return len(j)
    ends: list[int] = []
    for x in j.tolist():
        if not ends or x > ends[-1]:
            ends.append(x)
        else:
            ends[bisect_left(ends, x)] = x
    return len(ends)


def _by_bits(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence by bit-parallel dynamic programming over a window of ``2 * band + 1`` items that slides along ``a``."""
    at: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        at.setdefault(x, []).append(i)
    # For each item: the window's start when last seen, its places in that window as bits, how many places were taken in.
    seen = {x: [0, 0, 0] for x in at}
    lo, hi = 0, min(len(a), band + 1)
    row, matched = (1 << hi) - 1, 0
    for j, y in enumerate(b.tolist()):
        low, high = min(len(a), max(0, j - band)), min(len(a), j + band + 1)
        if high > hi:
            row |= ((1 << high - hi) - 1) << hi - lo
        if low > lo:
            gone = low - lo
            matched += gone - (row & (1 << gone) - 1).bit_count()
            row >>= gone
        lo, hi = low, max(hi, high)
        if y in at:
            state, where = seen[y], at[y]
            bits, nth = state[1] >> lo - state[0], state[2]
            while nth < len(where) and where[nth] < hi:
                if where[nth] >= lo:
                    bits |= 1 << where[nth] - lo
                nth += 1
            state[:] = lo, bits, nth
            taken = row & bits
            row = ((row + taken) | (row - taken)) & (1 << hi - lo) - 1
    return matched + hi - lo - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> int:
    """Longest common subsequence within the band that ``similar`` allows; exact for texts that are at least so similar.

    An alignment of at least that similarity has at most (n + m)(1 - s)/(1 + s) unmatched items, so
    none of its matches lies further from the diagonal. In longer texts equal beginnings and ends are aligned at once, and items
    that only one text has are left out: each is unmatched, and narrows the band for the rest. If they
    are too many, nothing is aligned. Where few items repeat, the pairs of equal items are few and decide (n log n);
    else a window of bits slides along the band.
    """
    band = int((len(a) + len(b)) * (1 - similar) / (1 + similar)) + 1
    short = min(len(a), len(b))
    if not short:
        return 0
    if short <= SHORT:
        return _by_words(a, b, band)
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    a, b, short = a[head:], b[head:], short - head
    unlike = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(unlike[0]) if len(unlike) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    both = np.isin(a, b), np.isin(b, a)
    band -= len(a) + len(b) - int(both[0].sum()) - int(both[1].sum())
    if band < 0:
        return 0
    a, b = a[both[0]], b[both[1]]
    places = np.argsort(b, kind="stable")
    held = b[places]
    first = np.searchsorted(held, a)
    many = np.searchsorted(held, a, "right") - first
    if not len(a):
        return head + tail
    return head + tail + (_by_matches(first, many, places, band) if many.sum() <= REPEATED * (len(a) + len(b)) else _by_bits(a, b, band))


def similarity(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> float:
    """aligned / (n + m - aligned); exact wherever it is at least ``similar``."""
    both = aligned(a, b, similar)
    return both / (len(a) + len(b) - both)


def _forest(texts: list[str], left: np.ndarray, right: np.ndarray, width: int, similar: float) -> list[tuple[int, int]]:
    """Links between left and right members that pass ``similar``, as a spanning forest: those inside a component found already are left out.

    First some members lead: each is compared with all of the other side, so a group of near copies is
    one component after a few passes. Then the rest: a member goes on only if enough of its shingles are
    in members of other components, and meets those with which it shares one of its rarest shingles.
    """
    raw = [shingles(t, width) for t in texts]
    labelled = [occurrences(x) for x in raw]
    size = np.array([len(x) for x in raw])
    parent = np.arange(len(texts))
    links: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return int(i)

    def link(i: int, j: int) -> None:
        if root(i) != root(j) and similarity(raw[i], raw[j], similar) >= similar:
            parent[root(i)] = root(j)
            links.append((i, j))

    enough = lambda common, a, b: common * (1 + similar) >= similar * (a + b) - 1e-9
    _, word = np.unique(np.concatenate(labelled), return_inverse=True)
    cuts = np.r_[0, np.cumsum(size)]
    owner = np.repeat(np.arange(len(texts)), size)
    led = np.zeros(len(texts), bool)
    on = {0: np.zeros(len(texts), bool), 1: np.zeros(len(texts), bool)}
    on[0][left], on[1][right] = True, True
    for turn in range(LEADERS):
        mine, other = turn % 2, 1 - turn % 2
        roots = np.array([root(i) for i in range(len(texts))])
        free = np.flatnonzero(on[mine] & ~led)
        if not len(free) or (roots == roots[0]).all():
            break
        leader = free[np.argmin(np.bincount(roots, minlength=len(texts))[roots[free]])] if turn else free[0]
        led[leader] = True
        has = np.zeros(word.max() + 1, bool)
        has[word[cuts[leader] : cuts[leader + 1]]] = True
        common = np.bincount(owner[has[word]], minlength=len(texts))
        for j in np.flatnonzero(on[other] & enough(common, size[leader], size) & (roots != roots[leader])).tolist():
            link(int(leader), j)
    roots, has = np.array([root(i) for i in range(len(texts))]), np.zeros(word.max() + 1, bool)
    low, high = np.full(word.max() + 1, len(texts)), np.full(word.max() + 1, -1)
    np.minimum.at(low, word, roots[owner])
    np.maximum.at(high, word, roots[owner])
    shared = (low != high)[word]
    going = np.bincount(owner[shared], minlength=len(texts)) >= similar * size - 1e-9
    # Two near texts share one of the rarest shingles of either: all but as many as they must have in common, and one more.
    rare = np.bincount(word)[word]
    order = np.lexsort((word, rare, owner))
    nth = np.empty(len(word), int)
    nth[order] = np.arange(len(word)) - np.repeat(cuts[:-1], size)
    prefix = shared & going[owner] & (nth <= (size - np.ceil(similar * size - 1e-9))[owner])
    entry = np.flatnonzero(prefix & on[1][owner])
    entry = entry[np.argsort(word[entry], kind="stable")]
    posting, begin = owner[entry], np.searchsorted(word[entry], np.arange(word.max() + 2))
    for i in np.flatnonzero(going & on[0]).tolist():
        own = word[cuts[i] : cuts[i + 1]]
        mine = own[prefix[cuts[i] : cuts[i + 1]]]
        first, many = begin[mine], begin[mine + 1] - begin[mine]
        met = np.unique(posting[np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]) if len(mine) else mine
        if len(met) > 16:  # in one pass over the cell
            has[own] = True
            met = np.flatnonzero(on[1] & enough(np.bincount(owner[has[word]], minlength=len(texts)), size[i], size))
            has[own] = False
        for j in met[met != i].tolist():
            if root(i) != root(j) and enough(np.isin(own, word[cuts[j] : cuts[j + 1]], assume_unique=True).sum(), size[i], size[j]):
                link(i, j)
    return links


def normalised(text) -> F.Column:
    """Lower case, with single blanks for runs of ASCII white space and control characters; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x20]+", " "))


def text_node(text) -> F.Column:
    """128 bits that stand for a normalised text: the mark of all its copies."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def order_minhash(docs: DataFrame, width: int, functions: int, picked: int) -> DataFrame:
    """(doc_id, mark, n, keys): how many shingles each text has, and its Order MinHash buckets."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, tuple[int, np.ndarray]] = {}
            marks = batch.column(1).to_pylist()
            for mark, text in zip(marks, batch.column(2), strict=True):
                if mark not in seen:
                    items = shingles(text.as_py(), width)
                    seen[mark] = (len(items), sketch(items, functions, picked).view(np.int64) if len(items) else np.zeros(0, np.int64))
            found = [seen[x] for x in marks]
            values = np.concatenate([k for _, k in found]) if found else np.zeros(0, np.int64)
            cuts = np.cumsum([0] + [len(k) for _, k in found])
            keys = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int32()), keys], schema=schema)

    text = normalised(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_node(text).alias("mark"), text.alias("text")).mapInArrow(sketches, "doc_id long, mark binary, n int, keys array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the given nodes, one row each: ``wanted`` has the node, mark and least doc_id.

    A Bloom filter of the wanted marks and ids (32 MB at most) keeps all other texts out of the shuffle;
    the join removes its false positives. Repeated rows, those with null ids too, are one.
    """
    key = F.xxhash64("mark", "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(bloom_filter(wanted.select(key.alias("key")), "key"))

    @F.arrow_udf("boolean")
    def possible(keys: pa.Array) -> pa.Array:
        return pa.array(possible_hits(sent.value, keys.to_numpy(zero_copy_only=False).astype(np.int64)))

    text = normalised(F.col("text"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_node(text).alias("mark"), text.alias("text")).where(possible(key)).alias("w")
    found = whole.join(wanted.alias("n"), (F.col("w.mark") == F.col("n.mark")) & F.col("w.doc_id").eqNullSafe(F.col("n.doc_id")))
    return found.groupBy("n.node").agg(F.any_value("w.text").alias("text"))


def like_pivot(members: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """(pivot, node, linked): whether each member of the given groups is near the group's pivot, whose text goes along with it."""
    pivots = members.select("pivot").distinct().join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("other")), "pivot")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            out = []
            for pivot, text, other in zip(batch.column("pivot").to_pylist(), batch.column("text"), batch.column("other"), strict=True):
                if pivot != last:
                    last, held = pivot, shingles(other.as_py(), width)
                own = shingles(text.as_py(), width)
                both = len(np.intersect1d(occurrences(own), occurrences(held), assume_unique=True))
                out.append(both * (1 + similar) >= similar * (len(own) + len(held)) - 1e-9 and similarity(own, held, similar) >= similar)
            yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("node"), pa.array(out, pa.bool_())], names=["pivot", "node", "linked"])

    met = members.select("pivot", "node").join(texts, "node").join(pivots, "pivot").select("pivot", "node", "text", "other")
    return met.mapInArrow(judge, "pivot long, node long, linked boolean")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, functions: int = FUNCTIONS, picked: int = PICKED) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its near-duplicate class), class_size and mark.

    Classes are the connected components of verified links; exact copies (up to case and white
    space) share a mark and are never paired. Buckets meet under their least member, the pivot. Members of a
    large group are first compared with the pivot alone; those unlike it are then compared with all
    members, in blocks. So a large group of near copies costs as much as it has members, and no link between
    different texts is lost. Inside tasks pairs are found over inverted lists; only a spanning forest leaves a task.
    Null and empty texts are copies of each other. Null ids are kept; a class of null ids only has a
    null class_id. Repeated rows are copies. Further columns are ignored.
    """
    rows = materialise(order_minhash(docs, width, functions, picked), "sketches")
    nodes = rows.groupBy("mark").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("many")).where("many > 1")
    grouped = materialise(members.join(shared, "key").select("pivot", "node", "n").distinct(), "groups")
    weight = F.sum(F.col("n") + TEXT)
    blocks = grouped.groupBy("pivot").agg(F.ceil(weight / BLOCK).cast("int").alias("blocks"))
    placed = grouped.join(blocks, "pivot")

    wanted = materialise(grouped.select("node").distinct().join(nodes.select("node", "mark", F.col("least").alias("doc_id")), "node"), "wanted")
    texts = texts_of(docs, wanted)

    large = placed.where("blocks > 1")
    led = None
    if not large.isEmpty():
        led = materialise(like_pivot(large, texts, width, similar), "led")
        unlike = led.where("not linked").join(nodes.select("node", "n"), "node").groupBy("pivot").agg(F.ceil(weight / BLOCK).cast("int").alias("asking"))
        flags = led.select("pivot", "node", "linked").distinct()
        large = large.join(unlike, "pivot").join(flags, ["pivot", "node"])
        placed = placed.where("blocks = 1").select("*", F.lit(1).alias("asking"), F.lit(False).alias("linked")).unionByName(large)
    else:
        placed = placed.select("*", F.lit(1).alias("asking"), F.lit(False).alias("linked"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    answers = placed.select("pivot", "node", F.lit(False).alias("asks"), every("asking").alias("low"), slot("blocks").alias("high"))
    asks = placed.where("not linked").select("pivot", "node", F.lit(True).alias("asks"), slot("asking").alias("low"), every("blocks").alias("high"))
    cells = answers.unionByName(asks).groupBy("pivot", "low", "high", "node").agg(F.bool_or("asks").alias("asks"), F.bool_or(~F.col("asks")).alias("answers"))

    def verify(group: pa.Table) -> pa.Table:
        seen: dict[int, list] = {}
        for node, asking, answering, text in zip(*(group.column(c).to_pylist() for c in ("node", "asks", "answers", "text")), strict=True):
            seen.setdefault(node, [asking, answering, text])
        names, held = list(seen), list(seen.values())
        left, right = np.flatnonzero([h[0] for h in held]), np.flatnonzero([h[1] for h in held])
        links = _forest([h[2] for h in held], left, right, width, similar) if len(left) and len(right) and len(held) > 1 else []
        return pa.table({"a": pa.array([names[a] for a, _ in links], pa.int64()), "b": pa.array([names[b] for _, b in links], pa.int64())})

    links = cells.join(texts, "node").groupBy("pivot", "low", "high").applyInArrow(verify, "a long, b long")
    if led is not None:
        links = links.unionByName(led.where("linked and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    linked = connected_components(links)
    classes = nodes.select("node", "mark", "least", "copies").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classes.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    return rows.select("doc_id", "mark").join(classes.join(named, "root").select("mark", "class_id", "class_size"), "mark").select("doc_id", "class_id", "class_size", "mark")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without all but the document of least doc_id of every near-duplicate class; a repeated row stays once.

    Where all ids of a class are null, one of its rows stays. Further columns stay as they are.
    """
    kept = near_duplicates(docs, **how).where("doc_id <=> class_id").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")).distinct()
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"), text_node(normalised(F.col("text"))).alias("own_mark"))
    found = keyed.join(kept, (F.col("own_mark") == F.col("kept_mark")) & F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return found.dropDuplicates(["own_mark", "own_id"]).select("doc.*")
