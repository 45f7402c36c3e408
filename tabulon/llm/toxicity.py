"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned first, from one part of the labelled rows: words and
stems that toxic texts have far more often than others. The trees see only
dense features of a text, such as the density of lexicon entries, how near they stand
to a second person, capitals, punctuation and disguised spellings, and are
fitted to another part of the labelled rows. Their margins are
calibrated on predictions for rows that the predicting trees have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .batches import map_texts

STEMS = (4, 5, 6, 7)
#: Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself u ya du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
#: Signs that stand for letters in disguised spellings.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
NEAR = 6
#: A lexicon entry is in so many toxic texts at least, and in this share of them.
LEAST = (3, 0.003)
FEATURES = ("log_words", "sum_density", "top_density", "mid_density", "low_density", "distinct", "max_weight", "stem_density", "near_you", "you_density", "disguised_hits", "disguised", "caps", "all_caps", "punct", "bang", "digits", "mean_len", "repeat_chars", "burst")


@dataclass
class Trees:
    """Depth-limited regression trees in arrays: feature, threshold, value by node; children of i are 2i+1, 2i+2."""

    base: float = 0.0
    depth: int = 3
    trees: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 8.0, reg: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    p0 = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(p0 / (1 - p0))), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    f, size = np.full(len(x), model.base), 2 ** (depth + 1) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-6)
        feature, threshold, value = np.zeros(size, int), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(len(x), int)
        for level in range(depth):
            lo, n = 2**level - 1, 2**level
            gain_of, best = np.zeros(n), [None] * n
            tg, th = np.bincount(node - lo, g, n), np.bincount(node - lo, h, n)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                key = (node - lo) * k + code[:, j]
                gl, hl = (np.cumsum(np.bincount(key, v, n * k).reshape(n, k), 1)[:, :-1] for v in (g, h))
                cl = np.cumsum(np.bincount(key, minlength=n * k).reshape(n, k), 1)
                left, right = cl[:, :-1], cl[:, -1:] - cl[:, :-1]
                gain = gl**2 / (hl + reg) + (tg[:, None] - gl) ** 2 / (th[:, None] - hl + reg) - (tg**2 / (th + reg))[:, None]
                gain[(left < least) | (right < least)] = 0
                at = gain.argmax(1)
                for i in range(n):
                    if gain[i, at[i]] > gain_of[i] + 1e-9:
                        gain_of[i], best[i] = gain[i, at[i]], (j, e[at[i]])
            for i, b in enumerate(best):
                if b:
                    feature[lo + i], threshold[lo + i] = b
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        lo, n = 2**depth - 1, 2**depth
        value[lo:] = -rate * np.bincount(node - lo, g, n) / (np.bincount(node - lo, h, n) + reg)
        f += value[node]
        model.trees.append((feature, threshold, value))
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean margin, probability) of a rising line."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t, v in zip(margin[order].tolist(), y[order].tolist(), w[order].tolist()):
        blocks.append([t * v, v, m * v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    words: np.ndarray
    word_weight: np.ndarray
    stems: np.ndarray
    stem_weight: np.ndarray
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]
    prior: float


def _terms(texts: list[str]):
    cp, starts = K.decode(texts)
    low = K.lower_table()[cp]
    s, e, doc, h = K.words_of(low, starts, K.word_table())
    stems = [(k, at := np.flatnonzero(e - s > k), K.mix(K.span_hashes(low, s[at], s[at] + k) ^ np.uint64(k))) for k in STEMS]
    return cp, starts, low, s, e, doc, h, stems


def _weigh(table: np.ndarray, weight: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h))
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[i] == h, weight[i], 0.0)


def dense(texts: list[str], m: Model) -> np.ndarray:
    """Texts by ``FEATURES``; an empty text is a row of zeros."""
    n = len(texts)
    cp, starts, low, s, e, doc, h, stems = _terms(texts)
    count = lambda d, w=None: np.bincount(d, w, n).astype(float)
    words = np.maximum(count(doc), 1)
    weight = _weigh(m.words, m.word_weight, h)
    stem = np.zeros(len(h))
    for _, at, sh in stems:
        stem[at] = np.maximum(stem[at], _weigh(m.stems, m.stem_weight, sh))
    both = np.maximum(weight, stem)
    hit = both > 0
    of_char = lambda mask: count(np.searchsorted(starts, np.flatnonzero(mask), "right") - 1)
    chars = np.maximum(np.diff(starts) - 1, 1)
    kind = K.class_table()[cp]
    upper = low != cp
    letters = np.maximum(of_char(kind == K.LETTER), 1)
    ups = np.concatenate(([0], np.cumsum(upper)))
    shout = (ups[e] - ups[s] == e - s) & (e - s > 1)
    # Disguised words: letters with signs or digits inside, read as the letters they stand for.
    leet = np.arange(0x110000, dtype=np.uint32)
    for a, b in LEET.items():
        leet[ord(a)] = ord(b)
    wide = K.word_table().copy()
    wide[[*map(ord, "@$!|*")]] = True
    ws, we = K.runs(wide[low])
    sums = np.concatenate(([0], np.cumsum(kind != K.LETTER)))
    odd = sums[we] - sums[ws]
    mixed = np.flatnonzero((odd > 0) & (odd < we - ws) & (kind[np.minimum(we - 1, len(cp) - 1)] == K.LETTER))
    folded = leet[low]
    dh = _weigh(m.words, m.word_weight, K.span_hashes(folded, ws[mixed], we[mixed]))
    mdoc = np.searchsorted(starts, ws[mixed], "right") - 1
    # Words to the nearest second person on either side, in the same text.
    you = np.flatnonzero(np.isin(h, _you()))
    near = np.zeros(len(h), bool)
    at = np.flatnonzero(hit)
    if len(you) and len(at):
        j = np.searchsorted(you, at)
        for k in (np.minimum(j, len(you) - 1), np.maximum(j - 1, 0)):
            near[at] |= (np.abs(you[k] - at) <= NEAR) & (doc[you[k]] == doc[at])
    top = np.zeros(n)
    np.maximum.at(top, doc, both)
    pair = np.unique(np.stack([doc[hit], h[hit].astype(np.int64)], 1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
    close = np.zeros(n)
    if len(at) > 1:  # the most lexicon entries within 30 words
        reach = np.searchsorted(at, at + 30)
        limit = np.searchsorted(doc[at], doc[at], "right")
        np.maximum.at(close, doc[at], np.minimum(reach, limit) - np.arange(len(at)))
    same = np.flatnonzero((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (kind[2:] == K.LETTER)) if len(cp) > 2 else np.zeros(0, int)
    columns = (
        np.log1p(count(doc)), count(doc, both) / words, count(doc[both > 2.5]) / words, count(doc[(both > 1.5) & (both <= 2.5)]) / words, count(doc[hit & (both <= 1.5)]) / words, count(pair[:, 0].astype(int)), top,
        count(doc[stem > 0]) / words, count(doc[near]) / words, count(doc[you]) / words, count(mdoc[dh > 0]) / words, count(mdoc) / words, of_char(upper) / letters, count(doc[shout]) / words, of_char(kind == K.OTHER) / chars, of_char(cp == ord("!")) / chars,
        of_char(kind == K.NUMBER) / chars, count(doc, e - s) / words, count(np.searchsorted(starts, same, "right") - 1) / words, close,
    )
    x = np.stack(columns, 1)
    x[count(doc) == 0] = 0
    return x


def _you() -> np.ndarray:
    cp, starts = K.decode(SECOND_PERSON.split())
    return K.words_of(cp, starts, K.word_table())[3]


def _evidence(raw: list[str | None], batch: pa.RecordBatch) -> dict:
    """Each text's distinct words and stems with its label, summed over the batch."""
    *_, doc, h, stems = _terms([t or "" for t in raw])
    toxic = batch.column("y").to_numpy(zero_copy_only=False)
    keys, kinds, docs = [h], [np.zeros(len(h), np.int64)], [doc]
    for k, at, sh in stems:
        keys, kinds, docs = [*keys, sh], [*kinds, np.full(len(at), k)], [*docs, doc[at]]
    h, kind, doc = np.concatenate(keys), np.concatenate(kinds), np.concatenate(docs)
    order = np.lexsort((doc, kind, h))
    h, kind, doc = h[order], kind[order], doc[order]
    if not len(h):
        return {"term": [], "kind": [], "pos": [], "neg": []}
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])))
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1])) | fresh
    g = np.cumsum(fresh) - 1
    y = toxic[doc]
    first = np.flatnonzero(fresh)
    return {"term": h[first].view(np.int64), "kind": kind[first], "pos": np.bincount(g, new_doc & (y == 1)), "neg": np.bincount(g, new_doc & (y == 0))}


def _draw(labels: DataFrame, key: str, label: str, folds: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """At most about ``per_class`` labelled keys of each class outside the held fold, by hash, and the shares drawn."""
    rows = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    rows = rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % folds != held).groupBy("id").agg(F.max("y").alias("y"))
    share = {r.y: min(1.0, per_class / r["count"]) for r in rows.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    return rows.where(draw < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))).limit(3 * per_class), share


def fit(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, folds: int, held: int, per_class: int, lexicon: int) -> Model | None:
    drawn, share = _draw(labels, key, label, folds, held, per_class)
    if len(share) < 2:
        return None
    # Bounded by 3 * per_class keys, so it may be broadcast; the texts are read once, unshuffled.
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)))
    half = map_texts(rows.where("part = 0").select("y", "text"), "text", lambda: _evidence, "term long, kind long, pos double, neg double")
    size = {0: 1, 1: 1} | {r.y: r["count"] for r in rows.where("part = 0").groupBy("y").count().collect()}
    sums = half.groupBy("term", "kind").agg(*[F.sum(c).alias(c) for c in ("pos", "neg")]).where(F.col("pos") >= max(LEAST[0], LEAST[1] * size[1]))
    # Smoothed log-odds of a text that has the term, by the rows read of each class: above 0.7, twice as frequent in toxic texts.
    odds = F.log(((F.col("pos") + 0.5) / size[1]) / ((F.col("neg") + 0.5) / size[0]))
    top = sums.withColumn("w", odds).where("w > 0.7").orderBy(F.desc("w"), F.desc("pos"), "term").limit(lexicon).collect()

    def tables(kinds):
        own = sorted((np.uint64(r.term & (2**64 - 1)), r.w) for r in top if (r.kind == 0) == kinds)
        return np.array([a for a, _ in own], np.uint64), np.array([b for _, b in own], float)

    prior = sum(share.values()) and (1 / share[1]) / (1 / share[1] + 1 / share[0])
    model = Model(*tables(True), *tables(False), Trees(), (np.zeros(1), np.zeros(1)), prior)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def body():
        m = shared.value
        return lambda raw, batch: {"y": batch.column("y"), "x": dense([t or "" for t in raw], m).tolist()}

    got = map_texts(rows.where("part = 1").select("y", "text"), "text", body, "y int, x array<double>").collect()  # numbers only, at most 3 * per_class rows
    if not got:
        return None
    got.sort(key=lambda r: (r.y, r.x))
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    if y.min() == y.max():
        return None
    w = np.where(y == 1, 1 / share[1], 1 / share[0])
    w /= w.mean()
    fold, margin = np.arange(len(y)) % 4, np.zeros(len(y))
    for k in range(4):
        margin[fold == k] = boost(x[fold != k], y[fold != k], w[fold != k]).margin(x[fold == k])
    model.trees, model.knots = boost(x, y, w), isotonic(margin, y, w)
    return model


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 5, held: int = 0, per_class: int = 4000, lexicon: int = 1500) -> DataFrame:
    """One row per row of ``docs``: ``key, held_out, score, predicted``.

    Lexicon, trees and calibration are fitted to at most about ``per_class``
    labelled rows of each class outside the held fold. Null and empty texts are
    scored as texts without words. Without labels of both classes every
    score is 0. Repeated label rows of a key count once, the highest label;
    repeated texts get equal scores; other columns are ignored; an empty
    table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, key, label, folds, held, per_class, lexicon))

    def body():
        m = model.value

        def each(raw: list[str | None], batch: pa.RecordBatch) -> dict:
            out = {c: batch.column(c) for c in ("id", "held_out")}
            if m is None:
                return out | {"score": [0.0] * len(raw), "predicted": [0] * len(raw)}
            p = np.interp(m.trees.margin(dense([t or "" for t in raw], m)), *m.knots)
            return out | {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return each

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == held, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, "text", body, f"id {dict(rows.dtypes)['id']}, held_out boolean, score double, predicted int").withColumnRenamed("id", key)
