"""Token ids of public vocabularies, word by word through a bounded cache.

Both vocabularies split words before merging, so a text's ids are its words'
ids end to end. ``path`` gives a vocabulary file; nothing is copied or trained.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from . import kernel as K


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """``word_bpe_49k.json``: NFC, lower case, words by class of character, ends of words marked.

    The ids equal those of ``tokenizers`` with ``add_special_tokens=False``.
    Texts with a special token's string in them go through the library whole.
    """

    SPECIAL = "<|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, letters = self.whole.model, _byte_letters()
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cache = K.WordCache(lambda ws: ([t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(letters))] for w in ws))

    @staticmethod
    def normal(text: str) -> str:
        """As the vocabulary's normaliser; capital sigma becomes a medial one, as there."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    @staticmethod
    def words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters, single digits, runs of other signs; ``'s 't 're 've 'm 'll 'd`` stand alone."""
        kind = K.class_table()[cp]
        begin = kind != K.SPACE
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == K.NUMBER)
        quote = np.flatnonzero(begin & (cp == 0x27))
        if len(quote):
            ext = np.concatenate((cp, np.zeros(3, cp.dtype)))
            a, b = ext[quote + 1], ext[quote + 2]
            pair = [tuple(map(ord, x)) for x in ("re", "ve", "ll")]
            long = np.any([(a == x) & (b == y) for x, y in pair], axis=0)
            short = np.isin(a, [*map(ord, "stmd")]) & ~long
            begin[quote[long | short] + 1] = False
            after = np.concatenate((quote[short] + 2, quote[long] + 3))
            after = after[after < len(cp)]
            begin[after[kind[after] != K.SPACE]] = True
        s = np.flatnonzero(begin)
        stop = np.flatnonzero(np.diff((kind != K.SPACE).view(np.int8), append=np.int8(0)) == -1) + 1
        nxt = np.append(s[1:], len(cp))
        e = np.minimum(nxt, stop[np.searchsorted(stop, s, "right")]) if len(s) else nxt[:0]
        return s, e

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's ids start)."""
        odd = {i: self.whole.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if self.SPECIAL in t and any(x in t for x in self.specials)}
        plain = [self.normal("" if i in odd else t) for i, t in enumerate(texts)]
        cp, starts = K.decode(plain)
        s, e = self.words(cp)
        flat, at, n = self.cache.lookup("\n".join(plain) + "\n", s, e, K.span_hashes(cp, s, e))
        ids = flat[K.ragged(at, n)]
        doc = np.searchsorted(starts, s, "right") - 1
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(doc, n, len(texts)).astype(np.int64), out=bounds[1:])
        if odd:
            parts = [np.asarray(odd[i], np.uint16) if i in odd else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([*map(len, parts)])))
        return ids, bounds


class PieceBpe:
    """``piece_bpe_32k.model``: pieces with byte fallback, word by word."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.cache = K.WordCache(lambda ws: self.model.encode(ws, num_threads=1))
