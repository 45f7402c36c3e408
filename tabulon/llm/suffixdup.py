"""Repeated passages by sparse suffix arrays over words.

Suffixes are retained only where content selects them: at the minimisers of
word 4-grams, one in about a dozen words, at the same places of equal passages.
Retained suffixes are sorted across the cluster by their first words; neighbours with
equal beginnings are compared, and each match is extended word by word to the right
and to the left. Every passage of ``min_words`` words or more contains a retained
suffix from which its beginning, its end, or the next such suffix is in reach, so
the matches of a document's suffixes, merged, are its repeated passages.

Suffixes are ordered by 64-bit hashes of their first words, then by the hashes of the words around them: what is
equal stands together, which is all that comparing neighbours needs. In the words around, 31 bits tell words apart.

Sorting is by range over (suffix, document, place): a passage that a third of all
documents share is a long run of equal suffixes, spread over as many tasks as
it has rows for, and no task or driver holds a whole run. Where a task's rows end,
the neighbour is unknown; such rows, and those between whose neighbours a third document may stand, have
the windows around them looked up by hash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .batches import map_texts
from .store import written

GRAM = 4
#: Suffixes that one task sorts, on average.
PER_TASK = 150_000
#: Tasks that rows of one window are dealt over.
DEALS = 32


def _words(raw: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    cp, starts = K.decode([t or "" for t in raw])
    _, _, doc, h = K.words_of(K.lower_table()[cp], starts, K.word_table())
    return h, doc


def minimisers(h: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Places of the least word 4-gram (the first of equals) of any ``window`` places in a row."""
    span = window + GRAM - 1
    if len(h) < span:
        return np.zeros(0, np.int64)
    grams = K.span_hashes(h, at := np.arange(len(h) - GRAM + 1), at + GRAM)
    starts = np.flatnonzero(doc[: len(doc) - span + 1] == doc[span - 1 :])
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    out = [starts[i : i + 65536] + views[starts[i : i + 65536]].argmin(1) for i in range(0, len(starts), 65536)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _across(i: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: pairs (row, nearest earlier row of another document) with equal keys."""
    start = np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
    before = np.maximum.accumulate(np.where(start, i, 0)) - 1
    ok = (before >= 0) & (keys[np.maximum(before, 0)] == keys)
    return i[ok], before[ok]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that two rows of contexts have in common from their start; 0 stands for no word."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _sorted_tasks(df: DataFrame, *order: str) -> DataFrame:
    n = max(1, -(-df.count() // PER_TASK))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _met(rows: DataFrame, few: DataFrame, key: str, *by: str) -> DataFrame:
    """``rows`` joined with ``few``, which has a key once. A passage that very many documents share is one key of very many
    rows; they are dealt over ``DEALS`` tasks, and each of the few is sent to all of those."""
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64(*by), F.lit(DEALS)))
    return dealt.join(few.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long")))), [key, "deal"]).drop("deal")


def _one_text_a_key(rows: DataFrame) -> DataFrame:
    """``rows`` with the least text of each id; texts only move where ids repeat."""
    again = written(rows.groupBy("id").count().where("count > 1").select("id"), "repeated-keys")
    if not again.limit(1).count():
        return rows
    least = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return written(rows.join(again, "id", "left_anti").union(least), "texts")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 50, window: int = 24, texts: bool = False) -> DataFrame:
    """One row per repeated passage: ``key, start_word, end_word, n_words, partner_id`` (and ``start, end, passage``).

    Passages of ``min_words`` words or more that another document has too, word
    for word (case and punctuation aside), merged where they overlap;
    ``partner_id`` is the least document met with one of them. Words count from
    0 and ends are exclusive. Null, empty and shorter texts have no
    passages. Rows with one key are one document, whose text is the least of theirs: repeats inside it do not
    count, nor does a repeated row. Keys are cast to long; rows without a key are left out. Other columns are ignored. An empty table gives an empty result.
    """
    reach, head = window, min_words - window + 1
    rows = _one_text_a_key(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null"))

    def seeds(raw: list[str | None], batch: pa.RecordBatch) -> dict:
        h, doc = _words(raw)
        w, at = K.window_hashes(h, doc, head)
        full = np.full(len(h), -1)
        full[at] = np.arange(len(at))
        p = minimisers(h, doc, window)
        p = p[full[p] >= 0]
        first = np.searchsorted(doc, np.arange(len(raw)))
        return {"k": w[full[p]].view(np.int64), "id": batch.column("id").take(pa.array(doc[p])), "pos": p - first[doc[p]]}

    def neighbours(batches):
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        k, ids = (table.column(c).to_numpy() for c in ("k", "id"))
        a, b = _across(np.arange(len(k)), ids, k)
        keep = np.zeros(len(k), bool)
        keep[a] = keep[b] = True
        # Rows of another document's run, up to the run's other end, and what may have a neighbour in the next task.
        run = np.cumsum(np.concatenate(([True], (ids[1:] != ids[:-1]) | (k[1:] != k[:-1]))))
        keep = np.isin(run, run[keep]) | (k == k[0]) & (run == run[0]) | (run == run[-1])
        for part in table.filter(pa.array(keep)).to_batches(10_000):
            yield part

    kind = "k long, id long, pos long"
    suffixes = written(map_texts(rows, "text", lambda: seeds, kind), "suffixes")
    paired = written(_sorted_tasks(suffixes, "k", "id", "pos").mapInArrow(neighbours, kind), "paired")

    def contexts(raw: list[str | None], batch: pa.RecordBatch) -> dict:
        h, doc = _words(raw)
        h32 = ((h >> np.uint64(32)).astype(np.uint32)) | np.uint32(1)
        at = batch.column("at")
        n = at.value_lengths().to_numpy().astype(np.int64)
        flat = at.flatten()
        pos, k = flat.field("pos").to_numpy(), flat.field("k").to_numpy()
        d = np.repeat(np.arange(len(raw)), n)
        first, last = np.searchsorted(doc, np.arange(len(raw))), np.searchsorted(doc, np.arange(len(raw)), "right")
        p = first[d] + pos
        j = np.arange(reach)
        left, right = p[:, None] - 1 - j, p[:, None] + head + j
        pad = np.append(h32, np.uint32(0))
        l = np.where(left >= first[d][:, None], pad[np.clip(left, 0, len(h32))], 0).astype("<u4")
        r = np.where(right < last[d][:, None], pad[np.clip(right, 0, len(h32))], 0).astype("<u4")
        as_binary = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(reach * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
        return {"k": k, "id": batch.column("id").take(pa.array(d)), "pos": pos, "l": as_binary(l), "r": as_binary(r)}

    own = paired.distinct().groupBy("id").agg(F.collect_list(F.struct("k", "pos")).alias("at"))
    found = written(map_texts(rows.join(own, "id"), "text", lambda: contexts, "k long, id long, pos long, l binary, r binary"), "contexts")

    out = "id long, pos long, k long, best int, a0 long, b0 long, p0 long, a1 long, b1 long, p1 long"

    def extend(by_left: bool):
        def run(batches):
            table = pa.Table.from_batches(batches).combine_chunks()
            n = table.num_rows
            if not n:
                return
            k, ids, pos = (table.column(c).to_numpy() for c in ("k", "id", "pos"))
            l, r = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<u4").reshape(n, reach) for c in ("l", "r"))
            best, found = np.zeros(n, np.int64), []
            for back in (False, True):  # the nearest earlier and the nearest later row of another document
                x, y = _across(np.arange(n), *((ids[::-1], k[::-1]) if back else (ids, k)))
                x, y = (n - 1 - x, n - 1 - y) if back else (x, y)
                a, b = _common(l[x], l[y]), _common(r[x], r[y])
                best[x] = np.maximum(best[x], a if by_left else b)
                x, y, a, b = (v[a + head + b >= min_words] for v in (x, y, a, b))
                rest = np.ones(n, bool)
                rest[x] = False
                for value in (pos[x] - a, pos[x] + head + b, ids[y]):
                    full = np.zeros(n, np.int64)
                    full[x] = value
                    found.append(pa.array(full, mask=rest))
            best[[0, -1]] = reach  # a bound: their neighbours are in other tasks, so their windows are looked up
            yield from pa.Table.from_arrays([pa.array(ids), pa.array(pos), pa.array(k), pa.array(best.astype(np.int32)), *found], names=[x.split()[0] for x in out.split(", ")]).to_batches(10_000)

        return run

    matched, ends = [], {}
    for by_left in (False, True):
        order = ("k", "l", "r", "id", "pos") if by_left else ("k", "r", "l", "id", "pos")
        got = written(_sorted_tasks(found, *order).mapInArrow(extend(by_left), out), "matches")
        ends[by_left] = got
        matched += [got.where(f"a{i} is not null").select("id", F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"p{i}").alias("partner")) for i in (0, 1)]
    # A third document can stand between two that match by a bit of both sides. Where the best right and the
    # best left match together reach further than any neighbour, the windows in reach are looked up themselves.
    need = min_words - head
    spot = ["id", "pos", "k"]
    of = lambda side, name: ends[side].select(*spot, F.col("best").alias(name), F.least("a0", "a1").alias(f"{name}_a"), F.greatest("b0", "b1").alias(f"{name}_b"))
    sides = of(False, "right").join(of(True, "left"), spot).where(F.col("left") + F.col("right") >= need)
    reached = (F.least("left_a", "right_a") <= F.col("pos") - F.least("left", F.lit(need))) & (F.greatest("left_b", "right_b") >= F.col("pos") + head + F.least("right", F.lit(need)))
    sides = written(sides.select(*spot, "left", "right", F.coalesce(~reached, F.lit(True)).alias("open")), "sides")
    opened = _met(sides, sides.where("open").select("k").distinct(), "k", "id", "pos")
    doubtful = found.join(opened, ["id", "pos", "k"])

    def windows(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, pos, k, left, right = (batch.column(c).to_numpy() for c in ("id", "pos", "k", "left", "right"))
            l, r = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(n, reach) for c in ("l", "r"))
            low, high = np.maximum(need - right, 0), np.minimum(left, need)
            count = np.maximum(high - low + 1, 0)
            row, off = np.repeat(np.arange(n), count), K.ragged(low, count)
            words = np.concatenate((l[:, ::-1], r), 1)
            flat = words.ravel().astype(np.uint64)
            start = row * 2 * reach + reach - off
            h = K.mix(K.span_hashes(flat, start, start + need) ^ k[row].view(np.uint64) ^ off.astype(np.uint64))
            whole = (words == 0).cumsum(1)
            whole = np.concatenate((np.zeros((n, 1), int), whole), 1)
            ok = whole[row, reach - off + need] == whole[row, reach - off]
            row, off, h = row[ok], off[ok], h[ok]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(pos[row] - off), pa.array(h.view(np.int64)), batch.column("open").take(pa.array(row))], names=["id", "a", "h", "open"])

    looked = written(doubtful.select("id", "pos", "k", "left", "right", "open", "l", "r").mapInArrow(windows, "id long, a long, h long, open boolean"), "windows")
    shared = looked.groupBy("h").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y")
    matched.append(_met(looked.where("open"), shared, "h", "id", "a").select("id", "a", (F.col("a") + min_words).alias("b"), F.when(F.col("x") == F.col("id"), F.col("y")).otherwise(F.col("x")).alias("partner")))
    matched = reduce(DataFrame.union, matched)
    # Overlapping matches of a document become one passage.
    spans = matched.groupBy("id", "a", "b").agg(F.min("partner").alias("partner"))
    w = Window.partitionBy("id").orderBy("a", "b")
    fresh = F.coalesce((F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    merged = spans.withColumn("g", fresh).withColumn("g", F.sum("g").over(w)).groupBy("id", "g").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min("partner").alias("partner_id"))
    result = merged.select(F.col("id").alias(key), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id")
    if not texts:
        return result

    def cut(raw: list[str | None], batch: pa.RecordBatch) -> dict:
        plain = [t or "" for t in raw]
        cp, starts = K.decode(plain)
        s, e, doc, _ = K.words_of(K.lower_table()[cp], starts, K.word_table())
        first = np.searchsorted(doc, np.arange(len(raw)))
        a, b = (batch.column(c).to_numpy() for c in ("start_word", "end_word"))
        lo, hi = s[first + a] - starts[:-1], e[first + b - 1] - starts[:-1]
        return {c: batch.column(c) for c in ("id", "start_word", "end_word", "n_words", "partner_id")} | {"start": lo, "end": hi, "passage": [t[x:y] for t, x, y in zip(plain, lo.tolist(), hi.tolist())]}

    joined = result.withColumnRenamed(key, "id").join(rows, "id")
    return map_texts(joined, "text", lambda: cut, "id long, start_word long, end_word long, n_words long, partner_id long, start long, end long, passage string").withColumnRenamed("id", key)
