"""Tokeniser fertility as a quality rule.

For each text: characters per token, share of byte-fallback tokens and
entropy of the token distribution, measured with public vocabularies. A text is
kept if every measure lies in the rejection band of its language (or, without
one, of its script). Bands are robust: quartiles of the measures over all
texts of the group and of like length that pass the base rules, widened by ``width`` times the
distance between the quartiles. They cover the whole table, need one row a
group, and are joined back by group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .batches import map_texts
from .store import written
from .tokens import PieceBpe, WordBpe, vocabulary

SYMBOLS = "#*$%&|<>"
MEASURES = ("chars_per_piece", "chars_per_token", "entropy", "byte_share")
#: A group with fewer texts than this uses the bands of its script, then of all texts.
LEAST_GROUP = 30
_STATS = "id long, grp string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_piece double, chars_per_token double, entropy double, byte_share double"
#: First code point and name of the ranges that count as one script.
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32400, "other")]


def _count(doc: np.ndarray, n: int, weight=None) -> np.ndarray:
    return np.bincount(doc, weight, n)


def _entropy(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Entropy of each text's tokens in bits, divided by its largest value at that length."""
    key = np.sort(doc.astype(np.int64) << 20 | ids)
    total = np.maximum(_count(doc, n), 1)
    if not len(key):
        return np.zeros(n)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    c = np.diff(np.append(at, len(key))).astype(float)
    d = key[at] >> 20
    h = np.log2(total) - _count(d, n, c * np.log2(c)) / total
    return h / np.maximum(np.log2(np.maximum(total, 2)), 1)


def _repeats(h: np.ndarray, doc: np.ndarray, k: int = 3) -> np.ndarray:
    """True at words in a k-word window that its text has twice or more."""
    hit = np.zeros(len(h), bool)
    w, at = K.window_hashes(h, doc, k)
    if len(w):
        w = K.mix(w ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        for i in range(k):
            hit[twice + i] = True
    return hit


def measures(piece_path: str, word_path: str):
    """The per-batch function of ``fertility``."""
    piece, word = PieceBpe(piece_path), WordBpe(word_path)
    space = K.ascii_space()
    symbol = np.zeros(0x110000, bool)
    symbol[[*map(ord, SYMBOLS)]] = True
    firsts, names = np.array([a for a, _ in SCRIPTS]), np.array([b for _, b in SCRIPTS])

    def each(raw: list[str | None], batch: pa.RecordBatch) -> dict:
        texts, n = [t or "" for t in raw], len(raw)
        cp, starts = K.decode(texts)
        s, e, doc, h = K.words_of(cp, starts, ~space)
        flat, at, count = piece.cache.lookup("\n".join(texts) + "\n", s, e, h)
        ids = flat[K.ragged(at, count)].astype(np.int64)
        tok_doc = np.repeat(doc, count)
        chars = _count(doc, n, e - s)
        pieces = _count(doc, n, count)
        _, bounds = word.encode(texts)
        dups = np.zeros(n, np.int64)
        for i, t in enumerate(texts):
            if "\n" in t:
                lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
                dups[i] = len(lines) - len(set(lines))
        letter = np.flatnonzero(K.class_table()[cp] == K.LETTER)
        kinds, code = np.unique(names[np.maximum(np.searchsorted(firsts, cp[letter], "right") - 1, 0)], return_inverse=True) if len(letter) else (np.array(["none"]), letter)
        votes = np.bincount((np.searchsorted(starts, letter, "right") - 1) * len(kinds) + code, minlength=n * len(kinds)).reshape(n, len(kinds))
        script = np.where(votes.sum(1) > 0, kinds[votes.argmax(1)], "none")
        return {
            "id": batch.column("id"), "grp": batch.column("grp"), "script": script.tolist(), "n_words": _count(doc, n), "word_chars": chars.astype(np.int64),
            "n_symbols": _count(np.searchsorted(starts, np.flatnonzero(symbol[cp]), "right") - 1, n), "n_dup_lines": dups, "n_repeat_words": _count(doc[_repeats(h, doc)], n),
            "chars_per_piece": chars / np.maximum(pieces, 1), "chars_per_token": chars / np.maximum(np.diff(bounds), 1), "entropy": _entropy(ids, tok_doc, n), "byte_share": _count(tok_doc[piece.is_byte[ids]], n) / np.maximum(pieces, 1),
        }

    return each


def _groups(kind: str, of: str) -> Column:
    """Name of a band group: its kind, value and length class (texts of like length vary alike)."""
    size = F.least(F.floor(F.log2(F.greatest("n_words", F.lit(1))) / 2), F.lit(8)).cast("string")
    return F.concat(F.lit(kind), F.col(of) if of else F.lit(""), F.lit("|"), size)


def bands(stats: DataFrame, width: float) -> DataFrame:
    """Lower and upper limits of each measure by group: ``g, <measure>_lo, <measure>_hi``."""
    sound = stats.where(~F.col("base_failed")).select(F.explode(F.array(_groups("g:", "grp"), _groups("s:", "script"), _groups("*", ""))).alias("g"), *MEASURES).where("g is not null")
    q = sound.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(m, [0.25, 0.75], 2000).alias(m) for m in MEASURES])
    spread = {m: F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(0.01)) * width for m in MEASURES}
    return q.where((F.col("n") >= LEAST_GROUP) | F.col("g").startswith("*")).select("g", *[(F.col(m)[0] - spread[m]).alias(f"{m}_lo") for m in MEASURES], *[(F.col(m)[1] + spread[m]).alias(f"{m}_hi") for m in MEASURES])


def fertility(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str | None = "lang", width: float = 3.0, min_words: int = 50, max_repeat: float = 0.5, piece_path: str | None = None, word_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: counts, measures, ``base_failed``, ``kept``, ``rejected_by``.

    A null or empty text has no words, measures of zero, and fails the base
    rules. A null language falls back to the script. Repeated rows are judged
    alike, each by itself. Other columns of ``docs`` are ignored, whatever their names.
    An empty table gives an empty result.
    """
    piece_path, word_path = piece_path or vocabulary("piece_bpe_32k.model"), word_path or vocabulary("word_bpe_49k.json")
    rows = docs.select(F.col(key).alias("id"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("grp"), F.col(text).cast("string").alias("text"))
    stats = map_texts(rows, "text", lambda: measures(piece_path, word_path), _STATS, 1 << 20)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed), "fertility")
    # As many rows as languages and scripts times six: Spark broadcasts it if it is as small as that.
    table = written(bands(stats, width).coalesce(1), "bands")
    x = stats
    for i, (kind, of) in enumerate((("g:", "grp"), ("s:", "script"), ("*", ""))):
        x = x.withColumn(f"g{i}", _groups(kind, of)).join(table.select(F.col("g").alias(f"g{i}"), F.struct(*table.columns[1:]).alias(f"b{i}")), f"g{i}", "left")
    x = x.withColumn("b", F.coalesce("b0", "b1", "b2"))
    outside = [F.when(~F.col(m).between(F.col("b")[f"{m}_lo"], F.col("b")[f"{m}_hi"]), m) for m in MEASURES[:-1]] + [F.when(F.col("byte_share") > F.col("b")["byte_share_hi"], "byte_share")]
    why = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.concat_ws(",", *outside))
    return x.select(F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (why == "").alias("kept"), F.when(why != "", why).alias("rejected_by"), "script", *MEASURES)
