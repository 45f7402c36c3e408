"""Language of every word by a linear-chain conditional random field.

Each word of a text has a label, a language. Its emission score sums learned
weights of affixes, character n-grams and lexicon entries; learned transition
scores tie neighbours together, so code-switched text is cut where the
evidence outweighs the cost of a switch. Forward-backward gives each word's
marginal probabilities; a text's language is the one with most letters.

Chains are evaluated in blocks: transfer matrices of all blocks at once, one
short scan over the blocks of a text, then all blocks at once again. Very long
texts therefore cost no more per word than short ones, and nothing is cut off.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .batches import map_texts

#: Weights are hashed to this many slots.
SLOTS = 1 << 16
BLOCK = 32
#: Characters of one training excerpt.
EXCERPT = 1200
UNKNOWN = "und"


@dataclass
class Crf:
    """Weights by slot and label, transition scores, lexicon (sorted word hashes), label names."""

    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    labels: list[str]


def features(low: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots end to end, their number for each word): affixes of 1 to 4, n-grams of 2 to 4, lexicon entry."""
    n, rows, slots = len(s), [], []

    def add(row: np.ndarray, code: np.ndarray, kind: int) -> None:
        rows.append(row)
        slots.append((K.mix(code ^ np.uint64(kind * 0x9E37)) >> np.uint64(48)).astype(np.int64))

    every = np.arange(n)
    for k in (1, 2, 3, 4):
        long = np.flatnonzero(e - s >= k)
        add(long, K.span_hashes(low, s[long], s[long] + k), k)
        add(long, K.span_hashes(low, e[long] - k, e[long]), 16 + k)
        if k > 1:
            inner = np.maximum(e - s - k + 1, 0)
            at = K.ragged(s, inner)
            add(np.repeat(every, inner), K.span_hashes(low, at, at + k), 32 + k)
    known = np.zeros(n, bool)
    if len(lexicon):
        known = lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h
    add(every, np.where(known, h, np.uint64(1)), 64)
    row, slot = np.concatenate(rows), np.concatenate(slots)
    order = np.argsort(row, kind="stable")
    return slot[order], np.bincount(row, minlength=n)


def emissions(crf: Crf, low: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Words by labels, summed over features; each distinct word is scored once."""
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    slot, n = features(low, s[first], e[first], h[first], crf.lexicon)
    at = np.cumsum(n) - n
    # The words are pseudo-independent given their neighbours, but their n-grams overlap: scale by their number.
    return (np.add.reduceat(crf.weights[slot], at, axis=0) / np.sqrt(n)[:, None])[back] if len(first) else np.zeros((0, len(crf.labels)))


def _unit(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def marginals(scores: np.ndarray, transitions: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Forward-backward over all texts: words by labels, each row summing to 1."""
    labels = scores.shape[1]
    if not len(scores):
        return scores
    psi, m = np.exp(scores - scores.max(1, keepdims=True)), np.exp(transitions)
    per = np.bincount(doc, minlength=n_docs)
    blocks = -(-per // BLOCK)
    first_block, first_word = np.cumsum(blocks) - blocks, np.cumsum(per) - per
    place = first_block[doc] * BLOCK + np.arange(len(doc)) - first_word[doc]
    total = int(blocks.sum())
    x, real = np.ones((total * BLOCK, labels)), np.zeros(total * BLOCK, bool)
    x[place], real[place] = psi, True
    x, real = x.reshape(total, BLOCK, labels), real.reshape(total, BLOCK)
    p = np.repeat(np.eye(labels)[None], total, 0)
    for t in range(BLOCK):
        step = _unit((p @ m) * x[:, t, None, :], (1, 2))
        p = np.where(real[:, t, None, None], step, p)
    into, out = np.full((total, labels), 1 / labels), np.full((total, labels), 1 / labels)
    for j in range(1, int(blocks.max())):
        b = first_block[blocks > j] + j
        into[b] = _unit(np.einsum("bi,bij->bj", into[b - 1], p[b - 1]), (1,))
        b = (first_block + blocks)[blocks > j] - 1 - j
        out[b] = _unit(np.einsum("bij,bj->bi", p[b + 1], out[b + 1]), (1,))
    alpha, a = np.empty_like(x), into
    for t in range(BLOCK):
        a = np.where(real[:, t, None], _unit((a @ m) * x[:, t], (1,)), a)
        alpha[:, t] = a
    b = out
    for t in range(BLOCK - 1, -1, -1):
        alpha[:, t] *= b
        b = np.where(real[:, t, None], _unit((x[:, t] * b) @ m.T, (1,)), b)
    return _unit(alpha.reshape(-1, labels)[place], (1,))


def split(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(lower-case code points, text starts, word starts, ends, texts, hashes, letters) of all texts."""
    cp, starts = K.decode(texts)
    low = K.lower_table()[cp]
    s, e, doc, h = K.words_of(low, starts, K.word_table())
    sums = np.concatenate(([0], np.cumsum(K.class_table()[low] == K.LETTER)))
    return low, starts, s, e, doc, h, sums[e] - sums[s]


def train(texts: list[str], langs: list[str], epochs: int = 4, batch: int = 128, length: int = 48, rate: float = 0.3, seed: int = 7) -> Crf:
    """Fit on labelled excerpts; neighbours of other languages are joined to teach the switches."""
    labels = sorted(set(langs))
    y_of = np.array([labels.index(x) for x in langs])
    low, _, s, e, doc, h, letters = split(texts)
    some = letters > 0
    s, e, doc, h = s[some], e[some], doc[some], h[some]
    words, n = np.unique(h, return_counts=True)
    crf = Crf(np.zeros((SLOTS, len(labels)), np.float32), np.eye(len(labels)) * 2.0, words[n >= 3], labels)
    if len(labels) < 2 or not len(s):
        return crf
    # Features of each distinct word once; ``own_word`` leads from a word to them.
    _, at, own_word = np.unique(h, return_index=True, return_inverse=True)
    slot, count = features(low, s[at], e[at], h[at], crf.lexicon)
    first = np.cumsum(count) - count
    rng, n_labels = np.random.default_rng(seed), len(labels)
    grad_w, grad_t = np.full((SLOTS, n_labels), 1e-6, np.float32), np.full((n_labels, n_labels), 1e-6)
    # Pieces of 8 to 24 words of one text; a chain takes whole pieces until it is full.
    ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
    pieces, lo = [], 0
    for hi in ends.tolist():
        while lo < hi:
            step = min(int(rng.integers(8, 25)), hi - lo)
            pieces.append(np.arange(lo, lo + step))
            lo += step
    for _ in range(epochs):
        stream = np.concatenate([pieces[i] for i in rng.permutation(len(pieces))])
        chains = stream[: len(stream) // length * length].reshape(-1, length) if len(stream) >= length else stream[None]
        for at in range(0, len(chains), batch):
            idx = chains[at : at + batch]
            flat = idx.ravel()
            n = count[own_word[flat]]
            take = K.ragged(first[own_word[flat]], n)
            own = np.repeat(np.arange(len(flat)), n)
            scale = 1 / np.sqrt(n)
            emit = np.add.reduceat(crf.weights[slot[take]], np.cumsum(n) - n, axis=0) * scale[:, None]
            b, t = idx.shape
            y = y_of[doc[flat]].reshape(b, t)
            psi = np.exp(emit - emit.max(1, keepdims=True)).reshape(b, t, n_labels).astype(float)
            m = np.exp(crf.transitions)
            alpha, beta = np.empty_like(psi), np.ones_like(psi)
            a = np.full((b, n_labels), 1 / n_labels)
            for i in range(t):
                a = _unit((a @ m) * psi[:, i], (1,))
                alpha[:, i] = a
            for i in range(t - 2, -1, -1):
                beta[:, i] = _unit((psi[:, i + 1] * beta[:, i + 1]) @ m.T, (1,))
            post = _unit(alpha * beta, (2,))
            pair = alpha[:, :-1, :, None] * m * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair = _unit(pair, (2, 3)).sum((0, 1))
            seen = np.bincount((y[:, :-1] * n_labels + y[:, 1:]).ravel(), minlength=n_labels**2).reshape(n_labels, n_labels)
            g = post.reshape(-1, n_labels)
            g[np.arange(len(flat)), y.ravel()] -= 1
            g = (g * scale[:, None])[own]
            gw = np.stack([np.bincount(slot[take], g[:, k], SLOTS) for k in range(n_labels)], 1) / b
            hit = np.flatnonzero(gw.any(1))
            grad_w[hit] += gw[hit] ** 2
            crf.weights[hit] -= rate * gw[hit] / np.sqrt(grad_w[hit])
            gt = (pair - seen) / b
            grad_t += gt**2
            crf.transitions -= rate * 0.3 * gt / np.sqrt(grad_t)
    # A text of one language is the rule outside training: switches cost as much again.
    crf.transitions += np.eye(n_labels) * 1.0
    return crf


def sample(docs: DataFrame, text: str, key: str, lang: str, folds: int, held: int, per_lang: int, max_langs: int = 256) -> DataFrame | None:
    """At most about ``per_lang`` excerpts (lang, text) of each language, chosen by hash, from rows outside the held fold.

    More than ``max_langs`` different labels are refused: they would be no languages, and none may be left unlearned.
    """
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("id").cast("binary")) % folds != held))
    counts = rows.drop("text").groupBy("lang").count().limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"Column {lang!r} has more than {max_langs} different labels")
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(1.0, per_lang / r["count"]))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    start = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.char_length("text") - EXCERPT, F.lit(0)) + 1) + 1
    return rows.where(draw < share[F.col("lang")]).select("lang", F.substring("text", start, F.lit(EXCERPT)).alias("text")).limit(2 * per_lang * len(counts))


def fitted(excerpts: DataFrame | None) -> bytes | None:
    """The pickled model of a bounded sample. One task fits it, so the driver only ever holds the result."""
    if excerpts is None:
        return None

    def fit(batches):
        got = sorted((a, b) for x in batches for a, b in zip(x.column("lang").to_pylist(), x.column("text").to_pylist()))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, t in got], [y for y, _ in got]))], pa.binary())], names=["model"])

    row = excerpts.coalesce(1).mapInArrow(fit, "model binary").first()
    return bytes(row.model) if row else None


def identify(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", folds: int = 4, held: int = 2, per_lang: int = 400, spans: bool = False, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``key, held_out, lang_pred, score`` (and ``spans`` of one language,
    and the columns to ``keep`` as ``kept_<name>``).

    The model is fitted to at most about ``per_lang`` labelled excerpts a
    language, of every label there is; more than 256 different labels raise. Language, source and key never enter a prediction. ``score`` is
    the share of letters that the predicted language has. A null text, or one
    without a letter, is ``und`` with score 0, as is every text where nothing is labelled.
    Repeated rows get equal answers; other columns are ignored; an empty
    table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(sample(docs, text, key, lang, folds, held, per_lang)))

    def body():
        crf = pickle.loads(model.value) if model.value else None

        def each(raw: list[str | None], batch: pa.RecordBatch) -> dict:
            n = len(raw)
            low, starts, s, e, doc, h, letters = split([t or "" for t in raw])
            some = letters > 0
            s, e, doc, h, letters = s[some], e[some], doc[some], h[some], letters[some]
            out = {c: batch.column(c) for c in passed}
            if crf is None:
                return out | {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "spans": [[]] * n}
            post = marginals(emissions(crf, low, s, e, h), crf.transitions, doc, n)
            mass = np.stack([np.bincount(doc, post[:, k] * letters, n) for k in range(len(crf.labels))], 1)
            total, best = mass.sum(1), mass.argmax(1)
            names = np.append(np.array(crf.labels, object), UNKNOWN)
            out |= {"lang_pred": names[np.where(total > 0, best, len(crf.labels))].tolist(), "score": np.minimum(1, mass.max(1) / np.maximum(total, 1))}
            if spans:
                own: list[list] = [[] for _ in range(n)]
                label = post.argmax(1) if len(post) else np.zeros(0, int)
                cut = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])))) if len(s) else []
                for a, b in zip(cut, [*cut[1:], len(s)]):
                    d = int(doc[a])
                    own[d].append({"start": int(s[a] - starts[d]), "end": int(e[b - 1] - starts[d]), "lang": names[label[a]]})
                out["spans"] = own
            return out

        return each

    out_fold = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == held, F.lit(False))
    rows = docs.select(F.col(key).alias("id"), out_fold.alias("held_out"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    passed = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text") + ", lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans
    return map_texts(rows, "text", body, schema).withColumnRenamed("id", key)
