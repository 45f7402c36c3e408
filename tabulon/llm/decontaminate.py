"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item become candidates when they share a run of
``min_match`` words. For each candidate the longest common runs of words are
marked first, none overlapping another in either text, down to runs of
``min_match`` words; the share of the item's words under tiles is its coverage.
Tiles may stand in any order, so a reordered passage is covered all the same.

Shared runs are found by rolling (Karp-Rabin) hashes of word windows. Items are
sent to the tasks in blocks whose size is measured first; a benchmark beyond one
block is run block by block against all texts, and only one block is held at a time.
An item too short for tiling is looked for as a whole: all its words, in order, without a gap.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .batches import map_texts
from .store import written

#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 8_000_000
#: Entries of posting lists that are laid out at once, or those of one text.
EXPAND = 2_000_000
_OUT = "row long, item long, item_words long, covered long, coverage double, n_tiles long, longest long"


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and the text of each."""
    cp, starts = K.decode(texts)
    _, _, doc, h = K.words_of(K.lower_table()[cp], starts, K.word_table())
    return h, doc


def tile(runs: list[tuple[int, int, int]], item_words: int, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (length, start in item, start in text), longest first, from the maximal common runs."""
    heap = [(-n, a, b) for n, a, b in runs]
    heapq.heapify(heap)
    in_item, in_text, out = bytearray(item_words), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free, lo = [], None
        for i in range(-n):
            ok = not in_item[a + i] and b + i not in in_text
            if ok and lo is None:
                lo = i
            if not ok and lo is not None:
                free.append((lo, i))
                lo = None
        if lo == 0:
            out.append((-n, a, b))
            for i in range(-n):
                in_item[a + i] = 1
                in_text.add(b + i)
            continue
        if lo is not None:
            free.append((lo, -n))
        if not free and not _room(in_item, min_match):
            break
        for x, y in free:  # what is left of it competes again at its own length
            if y - x >= min_match:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return out


def _room(marked: bytearray, n: int) -> bool:
    """Whether ``n`` unmarked words are left in a row."""
    return bytes(n) in marked


class Items:
    """The windows of a block of benchmark items, ready for look-up."""

    def __init__(self, ids: list[int | None], texts: list[str], min_match: int, min_item: int = 8):
        self.ids, self.k = ids, min_match
        h, doc = word_hashes(texts)
        self.size = np.bincount(doc, minlength=len(texts))
        self.first = np.cumsum(self.size) - self.size
        long = self.size >= max(min_item, min_match)
        w, at = K.window_hashes(h, doc, min_match)
        w, at = w[long[doc[at]]], at[long[doc[at]]]
        order = np.argsort(w, kind="stable")
        self.words, self.item, self.place = h, doc[at][order], (at - self.first[doc[at]])[order]
        self.grams, self.at, self.n = np.unique(w[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        # Short items by their number of words: hashes of whole items, ascending, and the items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.size[~long & (self.size > 0)]).tolist():
            own = np.flatnonzero(self.size == n)
            whole = K.window_hashes(h, doc, n)
            whole = whole[0][np.searchsorted(whole[1], self.first[own])]
            order = np.argsort(whole, kind="stable")
            self.short[n] = whole[order], own[order]


def _postings(items: Items, d: np.ndarray, j: np.ndarray):
    """Pieces of (text, item, place in item) for the windows ``j`` that texts ``d`` (ascending) have, a bounded number at a time."""
    n = items.n[j]
    starts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    sizes = np.add.reduceat(n, starts)
    lo = size = 0
    for t in range(len(starts) + 1):
        if t == len(starts) or t > lo and size + sizes[t] > EXPAND:
            a, b = starts[lo], starts[t] if t < len(starts) else len(d)
            e = K.ragged(items.at[j[a:b]], n[a:b])
            yield np.repeat(d[a:b], n[a:b]), items.item[e], items.place[e]
            lo, size = t, 0
        if t < len(starts):
            size += int(sizes[t])


def _runs(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, start in a, start in b) of ``k`` words or more, walked along ``a``: memory follows
    the runs and the places of one window, not their product."""
    none = np.zeros(1, np.int64)
    (wa, _), (wb, at) = (K.window_hashes(x, np.zeros(len(x), np.int64), k) for x in (a, b))
    order = np.argsort(wb, kind="stable")
    wb, at = wb[order], at[order]
    lo, hi = np.searchsorted(wb, wa, "left"), np.searchsorted(wb, wa, "right")
    out, diagonals, since = [], none[:0], none[:0]
    for i in range(len(wa) + 1):
        now = np.sort(at[lo[i] : hi[i]]) - i if i < len(wa) else none[:0]
        ended = ~np.isin(diagonals, now, assume_unique=True)
        out += [(i - s + k - 1, s, s + d) for s, d in zip(since[ended].tolist(), diagonals[ended].tolist())]
        begun = np.full(len(now), i)
        keep = np.flatnonzero(~ended)
        begun[np.searchsorted(now, diagonals[keep])] = since[keep]
        diagonals, since = now, begun
    return out


def compare(texts: list[str], items: Items, threshold: float) -> list[tuple]:
    """(text index, item index, item words, words covered, coverage, tiles, longest tile) of each pair that reaches the threshold."""
    h, doc = word_hashes(texts)
    k, out = items.k, []
    for n, (whole, own) in items.short.items():
        w, at = K.window_hashes(h, doc, n)
        lo, hi = np.searchsorted(whole, w, "left"), np.searchsorted(whole, w, "right")
        for x in np.flatnonzero(hi > lo).tolist():
            out += [(int(doc[at[x]]), it, n, n, 1.0, 1, n) for it in own[lo[x] : hi[x]].tolist()]
    out = sorted(set(out))
    w, at = K.window_hashes(h, doc, k)
    maybe = np.flatnonzero(items.bits[(w >> np.uint64(44)).astype(np.int64)])
    if not len(items.grams) or not len(maybe):
        return out
    j = np.minimum(np.searchsorted(items.grams, w[maybe]), len(items.grams) - 1)
    hit = items.grams[j] == w[maybe]
    # The windows of a text that the block has, each once.
    seen = np.unique(doc[at[maybe[hit]]].astype(np.int64) * len(items.grams) + j[hit])
    if not len(seen):
        return out
    first, last = np.searchsorted(doc, np.arange(len(texts))), np.searchsorted(doc, np.arange(len(texts)), "right")
    for d, item, place in _postings(items, seen // len(items.grams), seen % len(items.grams)):
        # No tiling can cover more of an item than all windows found in the text together.
        pair = d * len(items.ids) + item
        order = np.lexsort((place, pair))
        p, q = pair[order], place[order]
        new = np.concatenate((p[1:] != p[:-1], [True]))
        adds = np.where(new, k, np.minimum(k, np.concatenate((q[1:], [0])) - q))
        ids, back = np.unique(p, return_inverse=True)
        most = np.bincount(back, adds)
        for x in ids[most >= threshold * items.size[ids % len(items.ids)] - 1e-9].tolist():
            t, it = divmod(x, len(items.ids))
            size = int(items.size[it])
            tiles = tile(_runs(items.words[items.first[it] : items.first[it] + size], h[first[t] : last[t]], k), size, k)
            covered = sum(n for n, *_ in tiles)
            if covered >= threshold * size - 1e-9:
                out.append((t, it, size, covered, covered / size, len(tiles), tiles[0][0]))
    return out


def _blocks(benchmark: DataFrame, item_text: str, item_key: str):
    """Lists of (item, text), each of about ``BLOCK_CHARS`` characters at most, as measured first; and their number."""
    items = benchmark.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for i in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i)
        yield sorted(((r.item, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), blocks


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", min_match: int = 4, threshold: float = 0.6, min_item: int = 8) -> DataFrame:
    """One row per pair of a text and a benchmark item that it covers: ``key, item_id, item_words, covered, coverage, n_tiles, longest``.

    Coverage of ``threshold`` or more of the item's words counts. Items
    of fewer than ``min_item`` words count where a text has them whole, all words in a row. Null and
    empty texts cover nothing, items without a word are in no text. An item without an id is searched like
    any other and reported with a null id. Repeated rows are reported as often as they
    occur; repeated items likewise. Keys are cast to long and may be null. Other columns are ignored. An empty
    table on either side gives an empty result.
    """
    rows, parts = docs.select(F.col(key).cast("long").alias("row"), F.col(text).cast("string").alias("text")), []
    for block, blocks in _blocks(benchmark, item_text, item_key):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def body(shared=shared):
            table = Items([a for a, _ in shared.value], [b for _, b in shared.value], min_match, min_item)

            def each(raw: list[str | None], batch: pa.RecordBatch) -> dict | None:
                found = compare([t or "" for t in raw], table, threshold)
                if not found:
                    return None
                columns = list(zip(*found))
                return {"row": batch.column("row").take(pa.array(columns[0])), "item": [table.ids[i] for i in columns[1]], "item_words": columns[2], "covered": columns[3], "coverage": columns[4], "n_tiles": columns[5], "longest": columns[6]}

            return each

        part = map_texts(rows, "text", body, _OUT)
        if blocks > 1:  # one block after the other, so that no more than one is held
            part = written(part, "contaminated")
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.union, parts).select(F.col("row").alias(key), F.col("item").alias("item_id"), "item_words", "covered", "coverage", "n_tiles", "longest")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", min_match: int = 4, threshold: float = 0.6, min_item: int = 8) -> DataFrame:
    """The rows of ``docs`` that ``contaminated`` has none of, all columns as they are, in one pass a block without a shuffle."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for block, blocks in _blocks(benchmark, item_text, item_key):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def body(shared=shared):
            table = Items([a for a, _ in shared.value], [b for _, b in shared.value], min_match, min_item)

            def each(raw: list[str | None], batch: pa.RecordBatch) -> dict:
                hit = {row for row, *_ in compare([t or "" for t in raw], table, threshold)}
                kept = batch.take(pa.array([i for i in range(len(raw)) if i not in hit], pa.int64()))
                return {c: kept.column(c) for c in kept.schema.names}

            return each

        docs = map_texts(docs, text, body, schema)
        if blocks > 1:
            docs = written(docs, "clean")
            shared.destroy()
    return docs
