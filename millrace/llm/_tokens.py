"""Token ids by the tokenizers library, with a bounded cache of what stands between single spaces.

A single space between two non-blank characters is a boundary no pre-tokenizer of these
vocabularies matches across, so " word" has the same ids in every text.  Texts in which a space
touches other white space are encoded whole.  The word vocabulary drops white space, so there
every word has the same ids wherever it stands.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

CACHE = 700_000  # words
# what the word vocabulary cuts alike alone and after a space: no apostrophes, and letters that keep their class when folded and composed
PLAIN = re.compile(r"[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
FOLDS = re.compile(r"[\x00-\u012f\u0131-\u024f]+")  # the vocabulary folds these as str.lower does
SEPARATORS = re.compile(r"[\x1c-\x1f]")
PIECES = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
JOIN = 100  # words encoded as one text
_encoders: dict[str, Encoder] = {}


def vocabulary(name: str) -> str:
    """The path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _gather(flat: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[first[n] : first[n + 1]] for each n, end to end, and where each ends."""
    begin = first[number]
    size = first[number + 1] - begin
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return flat[np.arange(total) + np.repeat(begin - stop + size, size)], stop


class Ids:
    """Id lists end to end, each with a number; what holds them grows by doubling."""

    def __init__(self):
        self.first, self.flat, self.n = np.zeros(1025, np.int64), np.zeros(4096, np.uint32), 0

    def add(self, flat: np.ndarray, ends: np.ndarray) -> int:
        """Appends lists that end at ends in flat; the number of the first."""
        at, number, many = int(self.first[self.n]), self.n, len(ends)
        if self.n + many >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(len(self.first), many), np.int64)])
        if at + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[at : at + len(flat)] = flat
        self.first[self.n + 1 : self.n + 1 + many] = ends + at
        self.n += many
        return number


class Cache(dict):
    """str -> int; -1 for what isn't there."""

    def __missing__(self, word: str) -> int:
        return -1


class Encoder:
    """cache: what stands after a space -> its number in known, which has its ids.  Number 0 marks what must be encoded with its text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # ours takes its place
        vocab = self.tokenizer.get_vocab()
        self.closing = any(t.endswith("</w>") for t in vocab)  # else a token that opens with a space starts a word; in these vocabularies none has a space elsewhere
        self.plain = self.tokenizer
        if self.closing:  # for what its normalizer (composition, single spaces, lower case) leaves as it is
            self.plain = Tokenizer.from_file(path)
            self.plain.model._resize_cache(0)
            self.plain.normalizer = None
        self.border = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.border[[i for t, i in vocab.items() if (t.endswith("</w>") if self.closing else t.startswith("Ġ"))]] = True
        self.forget()

    def forget(self) -> None:
        self.cache = Cache()
        self.known = Ids()
        self.known.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def learn(self, words: list[str]) -> None:
        """Adds words to the cache."""
        if not self.closing:
            flat, at = self.joined([" " + w for w in words], np.ones(len(words), np.int64))
            self.cache.update(zip(words, range(begin := self.known.add(flat, at[1:]), begin + len(words)), strict=True))
            return
        joint = [w for w in words if PLAIN.fullmatch(w) and w.lower() == w]
        lone = list(set(words).difference(joint)) if len(joint) < len(words) else []
        several = np.fromiter((1 if w.isalpha() else len(PIECES.findall(w)) for w in joint), np.int64, len(joint))
        for found, (flat, at) in ((lone, self.many(lone)), (joint, self.joined([" " + w for w in joint], several))):
            self.cache.update(zip(found, range(begin := self.known.add(flat, at[1:]), begin + len(found)), strict=True))

    def raw(self, texts: list[str], plain: bool = False) -> list[list[int]]:
        return [e.ids for e in (self.plain if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, texts: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, end to end, and where each begins."""
        ids = self.raw(texts, plain) if texts else []
        at = np.cumsum(np.fromiter(chain([0], map(len, ids)), np.int64, len(ids) + 1))
        return np.fromiter(chain.from_iterable(ids), np.uint32, at[-1]), at

    def joined(self, words: list[str], several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``many``, for words that each begin with their only space and hold ``several`` border tokens: texts of JOIN words are encoded and cut where words meet.

        If the borders are not as many as that, the words are encoded one by one.
        """
        flat, _ = self.many(["".join(words[i : i + JOIN]) for i in range(0, len(words), JOIN)], True)
        borders = np.flatnonzero(self.border[flat])
        if len(borders) != several.sum():
            return self.many(words)
        if self.closing:
            cuts = borders[np.cumsum(several) - 1] + 1
        else:
            cuts = np.append(borders[1:], len(flat)) if words else borders
        return flat, np.concatenate([[0], cuts]).astype(np.int64)

    def ids(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """Ids of each whole text (null: empty), then the end id."""
        if self.closing:  # white space of any kind is dropped; the separators of ASCII are none for the library
            texts = [t.lower() if t and FOLDS.fullmatch(t) and "<|" not in t else t for t in texts]
            parts = [["", *t.split()] if t and not SEPARATORS.search(t) else [t or ""] for t in texts]
        else:
            parts = [(t or "").split(" ") for t in texts]
        if len(self.cache) > CACHE:
            self.forget()
        words = list(chain.from_iterable(p[1:] for p in parts))
        number = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        unknown = np.flatnonzero(number < 0).tolist()
        new = dict.fromkeys(map(words.__getitem__, unknown))
        good = [w for w in new if w and len(w.strip()) == len(w) and "<|" not in w]
        if len(good) < len(new):
            self.cache.update(dict.fromkeys(new.keys() - set(good), 0))
        self.learn(good)
        number[unknown] = np.fromiter((self.cache[words[i]] for i in unknown), np.int64, len(unknown))

        counts = np.array([len(p) - 1 for p in parts])
        got, stop = _gather(self.known.flat, self.known.first, number)
        word = np.cumsum(np.concatenate([[0], counts]))
        edge = np.concatenate([[0], stop])[word]
        odd = np.concatenate([[0], np.cumsum(number == 0)])[word]
        whole = [odd[i] < odd[i + 1] or "<|" in p[0] or (not self.closing and len(p) > 1 and (not p[0] or p[0][-1].isspace())) for i, p in enumerate(parts)]
        heads, head_at = self.many(["" if w else p[0] for p, w in zip(parts, whole, strict=True)])
        out, tail = [], np.array([end], np.uint32)
        for i, w in enumerate(whole):
            if w:
                out.append(np.array([*self.raw([texts[i]])[0], end], np.uint32))
            else:
                out.append(np.concatenate([heads[head_at[i] : head_at[i + 1]], got[edge[i] : edge[i + 1]], tail]))
        return out


def encoder(path: str) -> Encoder:
    """The worker's own encoder for this vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
