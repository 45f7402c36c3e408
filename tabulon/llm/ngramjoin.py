"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts with equal sets of word shingles are one node. Nodes that agree on a
band of their MinHash signature are candidates; candidates are gathered by
component, and pairs are only formed inside a task, in blocks of bounded size.
There signatures are compared a few values at a time: with m of n values equal,
a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold (uniform prior) is below ``tolerance``. What remains is
verified on the shingle sets themselves, so no reported link is approximate.

A task returns, for each node, its number of links and a spanning forest of the
links, never the pairs: output grows with nodes, not with their squares.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .batches import map_texts
from .components import components
from .store import written

BANDS, ROWS, STEP = 32, 6, 32
#: Nodes, and characters, of one block.
BLOCK, BLOCK_CHARS = 512, 8_000_000
_A = np.random.default_rng(20).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(21).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts end to end, ascending in each text, and where each text's start.

    A text with fewer than ``k`` words, but some, has one shingle of all of them.
    """
    n = len(texts)
    cp, starts = K.decode(texts)
    low = K.lower_table()[cp]
    _, _, doc, h = K.words_of(low, starts, K.word_table())
    w, at = K.window_hashes(h, doc, k)
    d = doc[at]
    per = np.bincount(doc, minlength=n)
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        ends = np.cumsum(per)
        w = np.concatenate((w, K.span_hashes(h, ends[short] - per[short], ends[short])))
        d = np.concatenate((d, short))
    order = np.lexsort((w, d))
    w, d = w[order], d[order]
    if len(w):
        fresh = np.concatenate(([True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])))
        w, d = w[fresh], d[fresh]
    return w, np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n))))


def signatures(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts by hash functions: the least value of each; texts without shingles get the largest."""
    out = np.full((len(_A), len(bounds) - 1), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for i in range(len(_A)):
            out[i, some] = np.minimum.reduceat(((sh * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), bounds[some])
    return out.T


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """Texts by bands."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        h = K.mix(h ^ parts[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
    return h


@lru_cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of ``n`` at which P(similarity >= threshold) is at least ``tolerance``."""
    total = 0.0
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        if total >= tolerance:
            return m
    return n


def _intersections(sh: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of shingle sets, for the pairs (i, j)."""
    size = np.diff(bounds)
    words, slot, df = np.unique(sh, return_inverse=True, return_counts=True)
    used = df > 1
    n, width = len(size), int(used.sum())
    # One matrix product for all pairs where pairs are dense among the texts, else pair by pair; the answer is the same.
    if n and float(n) * n * width < 75.0 * float((size[i] + size[j]).sum()) + 1e5 * len(i):
        doc = np.repeat(np.arange(n), size)
        column = np.cumsum(used) - 1
        keep = used[slot]
        doc, column = doc[keep], column[slot[keep]]
        both = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        for lo in range(0, width, 4096):
            a, b = np.searchsorted(column, (lo, lo + 4096))
            x = np.zeros((n, min(4096, width - lo)), np.float32)
            x[doc[a:b], column[a:b] - lo] = 1
            both += x @ x.T
        return both[i, j].round().astype(np.int64)
    return np.array([len(np.intersect1d(sh[bounds[a] : bounds[a + 1]], sh[bounds[b] : bounds[b + 1]], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)


def node_hashes(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What identifies a text's shingle set."""
    return K.span_hashes(sh, bounds[:-1], bounds[1:], 0xC2B2AE3D27D4EB4F).view(np.int64)


def links(sh: np.ndarray, bounds: np.ndarray, side: np.ndarray | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of shingle sets whose similarity reaches the threshold; with sides, only pairs across them."""
    sig = signatures(sh, bounds)
    bands = band_hashes(sig)
    n = len(bounds) - 1
    near = np.zeros((n, n), bool)
    for b in range(BANDS):
        order = np.argsort(bands[:, b], kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(bands[order, b])) + 1):
            if len(group) > 1:
                near[np.ix_(group, group)] = True
    if side is not None:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    equal = np.zeros(len(i), np.int64)
    for lo in range(0, sig.shape[1], STEP):
        for c in range(lo, lo + STEP):
            equal += sig[i, c] == sig[j, c]
        keep = equal >= least_matches(lo + STEP, threshold, tolerance)
        i, j, equal = i[keep], j[keep], equal[keep]
    if not len(i):
        return i, j
    inter, size = _intersections(sh, bounds, i, j), np.diff(bounds)
    keep = inter >= threshold * (size[i] + size[j] - inter) - 1e-9
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, with_class: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``key, class_id, n_links, n_copies``.

    ``class_id`` is the least key of the class: copies, and what links reach.
    ``n_links`` is the number of other shingle sets with a similarity of
    ``threshold`` or more, ``n_copies`` the number of other rows with the same
    set. A null text, or one without words, is a class of its own with no
    links. Keys are cast to long. Every row counts, also repeated rows and rows that share a key or have none;
    a class that only has rows without a key has a null ``class_id``. Other columns are ignored. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def signed():
        def each(raw: list[str | None], batch: pa.RecordBatch) -> dict:
            sh, bounds = shingles([t or "" for t in raw], k)
            bands = band_hashes(signatures(sh, bounds))
            size = np.diff(bounds)
            node = node_hashes(sh, bounds)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
            return {"id": batch.column("id"), "node": pa.array(node, pa.int64(), mask=size == 0), "chars": [len(t or "") for t in raw], "bands": flat}

        return each

    signed_rows = written(map_texts(rows, "text", signed, "id long, node long, chars long, bands array<long>"), "signatures")
    nodes = written(signed_rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands")), "nodes")
    # Equal nodes have equal bands, whichever row they are taken from.
    banded = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    nodes = nodes.drop("bands")
    hubs = banded.groupBy("band", "h").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    candidates = banded.join(hubs, ["band", "h"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    cluster = components(candidates)
    sized = cluster.join(nodes, "node")
    blocks = sized.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).select("root", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int").alias("nb"))
    members = sized.join(blocks, "root").select("root", "node", "nb", F.col("rep").alias("id"), F.pmod(F.xxhash64("node"), "nb").cast("int").alias("block"))
    # Every block meets every other once: a node goes to nb tasks, and a task holds two blocks.
    # A node's text is that of the row with its least key; rows without a key are found by the node itself.
    named = members.where("id is not null").join(rows, "id").select("root", "node", "nb", "block", "text")

    def hashed():
        def each(raw: list[str | None], batch: pa.RecordBatch) -> dict:
            return {"node": node_hashes(*shingles([t or "" for t in raw], k)), "text": batch.column("text")}

        return each

    keyless = map_texts(rows.where("id is null and text is not null"), "text", hashed, "node long, text string")
    unnamed = members.where("id is null").join(keyless.groupBy("node").agg(F.min("text").alias("text")), "node").select("root", "node", "nb", "block", "text")
    dealt = named.union(unnamed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).alias("side"), "node", "text")
    keys = ["root", "x", "y"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "node")

    def verify(batches):
        held: list[tuple] = []

        def done():
            if len(held) < 2:
                return None
            (_, x, y), *_ = held[0]
            sh, bounds = shingles([t or "" for _, _, t, _ in held], k)
            # Rows that share a key may have other words than the node asked for, and repeated rows come repeatedly.
            own, first = node_hashes(sh, bounds), {}
            for i, (_, node, _, _) in enumerate(held):
                if own[i] == node:
                    first.setdefault(node, i)
            take = np.array(sorted(first.values()), np.int64)
            size = np.diff(bounds)[take]
            sh, bounds = sh[K.ragged(bounds[take], size)], np.concatenate(([0], np.cumsum(size)))
            # Two blocks: pairs across them. One block: pairs inside it.
            i, j = links(sh, bounds, np.array([held[t][3] for t in take.tolist()], bool) if x != y else None, threshold, tolerance)
            degree = np.bincount(i, minlength=len(take)) + np.bincount(j, minlength=len(take))
            root = _forest(len(take), i, j)
            some = np.flatnonzero(degree)
            if not len(some):
                return None
            ids = own[take]
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[np.array(root)[some]]), pa.array(degree[some].astype(np.int64))], names=["a", "b", "links"])

        for batch in batches:
            for r, x, y, side, node, text_ in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != (r, x, y):
                    if (out := done()) is not None:
                        yield out
                    held.clear()
                held.append(((r, x, y), node, text_, side))
        if held and (out := done()) is not None:
            yield out

    found = written(dealt.mapInArrow(verify, "a long, b long, links long"), "links")
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    classes = components(found.select("a", "b"))
    named = nodes.join(classes, "node", "left").select("node", "rep", "rows", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    table = named.join(least, "root").join(degree, "node", "left").select("node", F.col("root").alias("class"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("rows") - 1).alias("n_copies"))
    out = signed_rows.select("id", "node").join(table, "node", "left")
    # Without a node a row is alone; without any key in its class, the class has no number.
    return out.select(F.col("id").alias(key), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"), *([F.col("node"), F.col("class")] if with_class else []))


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row of each class of ``docs``, all columns as they are: the one with the least key.

    Of rows that share that key, one stays. A class whose rows all have no key keeps one of them, a class
    with a key keeps none of those; rows without words and key all stay, as each is a class of its own.

    Texts are dealt by key once, whatever the size; no key is sent to all tasks.
    """
    classes = written(join(docs, text, key, with_class=True, **options), "classes")
    # A key stays if it is the least of the class of any of its rows.
    keys = classes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(key) == F.col("class_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = keys.where(~F.col("stays") | (F.col("n") > 1)).select(F.col(key).alias("__key"), F.col("stays").alias("__stays"))
    held = docs.join(gone.hint("shuffle_hash"), F.col(key).cast("long") == F.col("__key"), "left")
    single = held.where(F.col(key).isNotNull() & F.col("__stays").isNull()).select(docs.columns)
    # Keys with several rows are the exception; only these are brought together to leave one.
    several = held.where("__stays").select(docs.columns)
    one = several.groupBy(key).agg(F.min(F.struct(*[c for c in docs.columns if c != key])).alias("__row")).select(*[F.col(key) if c == key else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    lone = _keyless(docs, classes, text, key, options.get("k", 5))
    return single.union(one).union(lone)


def _keyless(docs: DataFrame, classes: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """The rows without a key that stay."""
    rows = docs.where(F.col(key).isNull())
    columns = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def hashed():
        def each(raw: list[str | None], batch: pa.RecordBatch) -> dict:
            sh, bounds = shingles([t or "" for t in raw], k)
            return {c: batch.column(c) for c in batch.schema.names} | {"__node": pa.array(node_hashes(sh, bounds), pa.int64(), mask=np.diff(bounds) == 0)}

        return each

    marked = map_texts(rows, text, hashed, columns + ", __node long")
    # The least node stands for a class without a key.
    stay = classes.where(F.col("class_id").isNull() & F.col("node").isNotNull()).groupBy("class").agg(F.min("node").alias("__node")).select("__node")
    alone = marked.where("__node is null").select(docs.columns)
    rest = [c for c in docs.columns if c != key]
    kept = marked.join(stay, "__node", "left_semi").groupBy("__node").agg(F.min(F.struct(*rest)).alias("__row"))
    return alone.union(kept.select(*[F.lit(None).cast(dict(docs.dtypes)[key]).alias(key) if c == key else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
