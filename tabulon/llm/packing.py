"""Best-fit packing of tokenised texts into sequences of a fixed capacity.

The texts' pieces only matter by length, so packing is solved on the histogram
of lengths, which has at most ``capacity`` rows however large the corpus is:

* the configuration linear program (how often to use each multiset of lengths)
  is solved by multiplicative weights: every round prices the lengths, and a
  knapsack by dynamic programming finds the configuration of most value;
* the solution is rounded down to whole configurations, which are filled with
  real pieces; what is left is a smaller program, solved and rounded again,
  until rounding places nothing more;
* the few large pieces left, and all pieces too small to be worth a price, go by best fit
  into the room that the configurations have left, then into sequences of their own.

The plan is a list of runs: "the pieces of length L with ranks a to b go, n a
sequence, to the sequences from s on". Ranks are dealt per length and salt, the
number of salts following the length's pieces, so one length that holds a third of
all pieces is spread over many tasks, repeated rows too.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_texts
from .store import written
from .tokens import WordBpe, vocabulary

#: Pieces of one length and salt, on average, and salts that are summed up together.
PER_SALT, SALTS = 250, 1_000
#: Pieces of at most this share of the capacity only fill up what the configurations leave.
SMALL = 1 / 32
#: Share of the volume at which no further program is solved for what rounding left.
LEFT = 0.02


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    bpe, task, made = WordBpe(path), TaskContext.get().partitionId(), 0

    def each(raw: list[str | None], batch: pa.RecordBatch) -> dict:
        nonlocal made
        ids, bounds = bpe.encode([t or "" for t in raw])
        keys, rows = batch.column("id"), {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            own = np.append(ids[a:b].astype("<u4"), np.uint32(end_id))
            for p, at in enumerate(range(0, len(own), capacity)):
                part = own[at : at + capacity]
                for k, v in zip(rows, (i, p, at, len(part), zlib.crc32(part.tobytes()), part if with_ids else None)):
                    rows[k].append(v)
        n = len(rows["row"])
        number, made = np.arange(made, made + n) + (task << 40), made + n
        return {"id": keys.take(pa.array(rows["row"], pa.int64())), "number": number, "piece": rows["piece"], "start": rows["start"], "length": rows["length"], "ids_crc32": rows["crc"], "ids": rows["ids"]}

    return each


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, list[tuple[int, int]]]:
    """The multiset of sizes within capacity of most value (unbounded knapsack by dynamic programming)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    # Weights are filled in blocks no longer than the smallest size, so that a block only needs earlier ones.
    step = max(1, int(sizes.min()))
    for lo in range(step, capacity + 1, step):
        w = np.arange(lo, min(lo + step, capacity + 1))
        room = w[None, :] - sizes[:, None]
        gain = np.where(room >= 0, values[:, None] + best[np.maximum(room, 0)], -1.0)
        pick = gain.argmax(0)
        top = gain[pick, np.arange(len(w))]
        # A weight may also be left unfilled: then it is worth what a lesser one is.
        run = np.maximum.accumulate(np.concatenate(([best[lo - 1]], top)))
        best[w], last[w] = run[1:], np.where(run[1:] > top, -2, pick)
        last[w[top <= 0]] = -2
    out: dict[int, int] = {}
    x = capacity
    while x > 0 and last[x] != -1:
        if last[x] == -2:
            x -= 1
        else:
            out[int(last[x])] = out.get(int(last[x]), 0) + 1
            x -= int(sizes[last[x]])
    return float(best[capacity]), sorted(out.items())


def _classes(hist: dict[int, int], most: int) -> list[list[int]]:
    """Lengths in ascending classes: the lengths themselves, or about ``most`` classes of like volume."""
    lengths = sorted(hist)
    if len(lengths) <= most:
        return [[x] for x in lengths]
    volume = np.cumsum([x * hist[x] for x in lengths])
    slot = np.minimum((volume - 1) * most // volume[-1], most - 1)
    return [[lengths[i] for i in np.flatnonzero(slot == c)] for c in np.unique(slot)]


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, epsilon: float = 0.4) -> dict[tuple[tuple[int, int], ...], float]:
    """The configuration program's solution: configuration ((index of size, number), ...) to how often it is used.

    Multiplicative weights: a size's weight begins with its volume and falls with the share of its demand that the
    chosen configurations have met, so under-served sizes grow dear. The sum of
    the rounds, scaled to the demand's volume, is a nearly optimal fractional cover.
    """
    boost, used = np.ones(len(sizes)), {}
    for _ in range(rounds):
        left, free, config = capacity, np.ones(len(sizes), bool), np.zeros(len(sizes), np.int64)
        while True:  # no configuration takes more of a size than there is; its room is offered to the others
            open_ = np.flatnonzero(free & (sizes <= left))
            if not len(open_):
                break
            _, picked = _price((sizes * boost)[open_], sizes[open_], left)
            if not picked:
                break
            over = False
            for j, n in picked:
                i = open_[j]
                take = min(n, int(demand[i]) - int(config[i]))
                config[i] += take
                left -= take * int(sizes[i])
                if take < n:
                    free[i], over = False, True
            if not over:
                break
        met = config / demand
        key = tuple((int(i), int(config[i])) for i in np.flatnonzero(config))
        used[key] = used.get(key, 0.0) + 1 / met.max()
        boost *= np.exp(-epsilon * met / met.max())
        boost /= boost.max()
    cover = sum(x * sum(int(sizes[i]) * n for i, n in c) for c, x in used.items())
    scale = float(sizes @ demand) / cover
    return {c: x * scale for c, x in used.items()}


def _fill(config: tuple[tuple[int, int], ...], times: int, by_class: list[list[int]], rest: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Up to ``times`` sequences of a configuration, with the largest real pieces of its classes; taken out of ``rest``."""
    out = []
    while times > 0:
        items: dict[int, int] = {}
        for i, n in reversed(config):
            for length in reversed(by_class[i]):
                take = min(n, rest[length] - items.get(length, 0))
                if take > 0:
                    items[length] = items.get(length, 0) + take
                    n -= take
                if not n:
                    break
            if n:
                return out
        room = capacity - sum(a * b for a, b in items.items())
        small = min(items)
        if room and sum(items.values()) > 1:  # classes round up: a larger last piece may fit as well
            lengths = by_class.flat
            for j in range(bisect.bisect_right(lengths, small + room) - 1, -1, -1):
                if lengths[j] <= small:
                    break
                if rest[lengths[j]] > items.get(lengths[j], 0):
                    items[small] -= 1
                    if not items[small]:
                        del items[small]
                    items[lengths[j]] = items.get(lengths[j], 0) + 1
                    break
        many = min(times, *(rest[a] // b for a, b in items.items()))
        for a, b in items.items():
            rest[a] -= many * b
        out.append((sorted(items.items(), reverse=True), many))
        times -= many
    return out


class _ByClass(list):
    """Classes of lengths, and all lengths in order."""

    def __init__(self, classes: list[list[int]]):
        super().__init__(classes)
        self.flat = [x for c in classes for x in c]


def configurations(hist: dict[int, int], capacity: int, rounds: int = 4, classes: int = 128) -> tuple[list[tuple[list[tuple[int, int]], int]], dict[int, int]]:
    """Whole configurations ([(length, number)], times used) for the pieces of ``hist``, and the pieces they leave.

    ``rounds`` are those of the solver for each class of lengths.
    """
    rest, plan = dict(hist), []
    enough = max(LEFT * sum(x * n for x, n in hist.items()), 8 * capacity)
    while True:
        alive = {x: n for x, n in rest.items() if n}
        # What a program over all of it cannot improve by much goes by best fit; the first program is always solved.
        if not alive or plan and sum(x * n for x, n in alive.items()) <= enough:
            break
        by_class = _ByClass(_classes(alive, classes))
        sizes = np.array([c[-1] for c in by_class], np.int64)
        demand = np.array([sum(alive[x] for x in c) for c in by_class], np.int64)
        solution = solve(sizes, demand, capacity, 30 + rounds * len(sizes))
        took, half = 0, int(sizes @ demand) // capacity // 2
        for config, x in sorted(solution.items(), key=lambda c: (-c[1], c[0])):
            # Rounded down; until half of the program is placed, the fractions of nearly full ones are rounded up.
            full = sum(int(sizes[i]) * n for i, n in config) >= 0.98 * capacity
            filled = _fill(config, int(x) if x >= 1 or not full or took > half else 1, by_class, rest, capacity)
            plan += filled
            took += sum(n for _, n in filled)
        if not took:
            break
    return plan, {x: n for x, n in rest.items() if n}


def best_fit(rest: dict[int, int], capacity: int, bins: list[list] | None = None) -> list[tuple[list[tuple[int, int]], int]]:
    """What is left, largest first into the fullest sequence that takes it, in runs of equal sequences.

    State is (free space -> kinds of sequences with that space and their
    number), so it depends on the lengths, not on how many pieces share one.
    """
    free: dict[int, list[list]] = {}
    spaces: list[int] = []

    def put(space: int, items: tuple, n: int) -> None:
        if space not in free:
            bisect.insort(spaces, space)
            free[space] = []
        free[space].append([items, n])

    for space, items, n in bins or []:
        put(space, items, n)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n > 0:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                items, many = free[space].pop()
                if not free[space]:
                    del free[space]
                    del spaces[i]
                each = min(space // length, n) if many == 1 else min(space // length, max(1, n // many))
                take = min(many, n // each)
                if take < many:
                    put(space, items, many - take)
            else:
                each = min(capacity // length, n)
                space, items, take = capacity, (), n // each
            put(space - each * length, (*items, (length, each)), take)
            n -= each * take
    return [(list(items), n) for kinds in free.values() for items, n in kinds]


def plan(hist: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """All sequences as ([(length, number)], times), covering ``hist`` exactly."""
    least = max(1, int(capacity * SMALL))
    whole = {capacity: hist[capacity]} if capacity in hist else {}
    first, rest = configurations({k: v for k, v in hist.items() if least < k < capacity}, capacity)
    rest |= {k: v for k, v in hist.items() if k <= least and k != capacity}
    opened = [[capacity - sum(a * b for a, b in items), tuple(items), times] for items, times in first]
    return [([(capacity, 1)], n) for n in whole.values()] + best_fit(rest, capacity, opened)


def _runs(configs: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, pieces a sequence, offset of the first) in order of rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for items, times in configs:
        offset = 0
        for length, n in items:
            r = ranks.get(length, 0)
            out.setdefault(length, []).append((r, sequence, n, offset))
            ranks[length] = r + n * times
            offset += length * n
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = 4096, end_id: int = 1, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A text's ids are followed by ``end_id``; only longer ones are cut, into
    pieces of ``capacity``. A null or empty text is one piece of ``end_id``.
    Repeated rows are packed as often as they occur; ties of length fall by place in the
    input. Keys are cast to long and may be null. Other columns are ignored. An empty table gives an empty result.
    """
    path = path or vocabulary("word_bpe_49k.json")
    schema = "id long, number long, piece int, start long, length long, ids_crc32 long, ids array<long>"
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    pieces = map_texts(rows, "text", lambda: _cut(path, capacity, end_id, with_ids), schema, 1 << 19)
    pieces = written(pieces if with_ids else pieces.drop("ids"), "pieces")
    hist = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = _runs(plan(hist, capacity))
    # ``number`` tells repeated rows apart, so they don't share a salt.
    salts = docs.sparkSession.createDataFrame([(k, max(1, v // PER_SALT)) for k, v in hist.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("number"), F.col("salts"))).drop("salts")
    # Ranks before a salt: those of earlier thousands of salts, and of the earlier salts of its own.
    counts = written(salted.groupBy("length", "salt").count().withColumn("many", F.floor(F.col("salt") / SALTS)), "salts")
    earlier = lambda column, w: F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    thousands = counts.groupBy("length", "many").agg(F.sum("count").alias("count")).select("length", "many", earlier("count", Window.partitionBy("length").orderBy("many")).alias("base"))
    within = counts.select("length", "many", "salt", earlier("count", Window.partitionBy("length", "many").orderBy("salt")).alias("own"))
    first = within.join(thousands, ["length", "many"]).select("length", "salt", (F.col("base") + F.col("own")).alias("before"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("number")) - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before")).drop("salt", "r", "before", "number")
    # The plan has a row for each length of each kind of sequence: bounded by capacity, not by the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                size = int(length[group[0]])
                run = shared.value[size]
                row = run[np.searchsorted(run[:, 0], rank[group], "right") - 1]
                k = rank[group] - row[:, 0]
                seq[group], off[group] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    keep = [c for c in ranked.columns if c != "rank"]
    kinds = dict(ranked.dtypes)
    out = ranked.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", key)
