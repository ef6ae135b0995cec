"""Subword ids of whole texts, from ids of words.

The tokenizers used here split at white space first, so a text's ids are those
of its words, one after another.  Words recur, so each process keeps the ids of
the words it has met and asks the tokenizer only for new ones.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np

from .common import tokenizer_path

#: Words whose ids a process keeps; beyond it, those met once since the last time are let go (which changes time, not results).
KEPT_WORDS = 500_000
#: Marks that, after letters, are a piece of their own to the tokenizer.
MARKS = ".,;:!?"


class _Places(dict):
    """A place for each word, in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class WordTokenizer:
    """Ids by a `tokenizers` file that drops white space and splits at it (such as word_bpe_49k.json)."""

    def __init__(self, name: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.marks: dict[str, list[int]] = {}
        self.lowers = self._ids(["A"]) == self._ids(["a"])
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.final[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known = _Places()
        self.begin, self.size, self.used = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.flat = np.zeros(1 << 18, np.int32)
        self.filled = 0

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids_of_letters(self, words: list[str]) -> list[list[int]]:
        """Of words that are letters alone: joined, encoded once and divided where a word ends."""
        ids = self._ids([" ".join(words)])[0]
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids):
            return self._ids(words)
        return [ids[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _put(self, k: int, ids: list[list[int]]) -> None:
        """The ids of the words with the places from k on."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(n.sum())
        while len(self.begin) < k + len(ids):
            self.begin, self.size, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.used))
        while len(self.flat) < self.filled + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.begin[k : k + len(ids)] = self.filled + np.cumsum(n) - n
        self.size[k : k + len(ids)] = n
        self.flat[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.filled += total

    def _learn(self, new: list[bytes], k: int) -> None:
        """New words, which have the places from k on."""
        texts = [w.decode("utf-8", "surrogatepass") for w in new]
        cores = [t.rstrip(MARKS) for t in texts]
        cores = [c.lower() if self.lowers and c.isascii() else c for c in cores]
        simple: dict[str, list[int]] = {}
        fresh = []
        for c in dict.fromkeys(cores):
            if c.isalpha():
                at = self.known.get(c.encode("utf-8", "surrogatepass"), k)
                if at < k:  # met before, without marks or capitals
                    simple[c] = self.flat[self.begin[at] : self.begin[at] + self.size[at]].tolist()
                else:
                    fresh.append(c)
        if fresh:
            simple.update(zip(fresh, self._ids_of_letters(fresh), strict=True))
        other = [t for t, c in zip(texts, cores, strict=True) if c not in simple]
        other = dict(zip(other, self._ids(other), strict=True)) if other else {}
        ids = []
        for t, c in zip(texts, cores, strict=True):
            if c not in simple:
                ids.append(other[t])
            elif len(c) == len(t):
                ids.append(simple[c])
            else:
                marks = t[len(c) :]
                if marks not in self.marks:
                    self.marks[marks] = self._ids([marks])[0]
                ids.append(simple[c] + self.marks[marks])
        self._put(k, ids)

    def _let_go(self) -> None:
        """Keep the words met more than once since this was last done."""
        kept = self.used[: len(self.known)] > 1
        if kept.sum() > KEPT_WORDS // 2:
            kept[:] = False
        words = list(compress(self.known, kept))
        begin, size = self.begin[: len(kept)][kept], self.size[: len(kept)][kept]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(begin - (ends - size), size) + np.arange(total)]
        self.known = _Places()
        self.known.update(zip(words, range(len(words)), strict=True))
        self.begin[: len(words)], self.size[: len(words)], self.flat[:total] = ends - size, size, flat
        self.used[:] = 0
        self.filled = total

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """int32 ids of each text (null: none)."""
        if len(self.known) > KEPT_WORDS:
            self._let_go()
        words = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        words = [w.split() for w in words]
        count = np.fromiter(map(len, words), np.int64, len(words))
        k = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
        new, self.known.new = self.known.new, []
        for a in range(0, len(new), 20_000):
            self._learn(new[a : a + 20_000], k + a)
        self.used[: len(self.known)] += np.bincount(at, minlength=len(self.known))
        n = self.size[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[at] - (ends - n), n) + np.arange(total)]
        stops = np.append(0, ends)[np.cumsum(count)].tolist()
        return [ids[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(name: str) -> WordTokenizer:
    """This process's tokenizer of that name."""
    if name not in _loaded:
        _loaded[name] = WordTokenizer(name)
    return _loaded[name]


def in_slices(texts: list, limit: int = 4 << 20):
    """Runs (from, to) of texts with at most about ``limit`` characters each, so memory follows the limit, not the batch."""
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)
