"""Vectorised pre-tokenization for byte-level BPE: many texts as one flat array of code points.

Word bounds come from character classes with array operations, words are looked up by a 64-bit
hash, and only words that the worker has not met are handed to an encoder. Its ids stay in a pool
of bounded size, from which the ids of whole texts are gathered. The pool holds the words' characters
too: every word of every text is compared with the word whose ids it gets, all of them in one array
operation, and one that only shares the hash is encoded for itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
#: Code points handled at once; texts are never cut, so one long text may exceed it.
CHUNK_CHARS = 1_000_000
#: The cache is emptied beyond so many words, or characters of words.
CACHE_WORDS, CACHE_CHARS = 600_000, 16_000_000
#: White space as Unicode defines it (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class and a random 64-bit number of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    classes[WHITE_SPACE] = SPACE
    classes[0x20] = BLANK
    return classes, np.random.default_rng(20).integers(0, 2**64, 0x110000, np.uint64)


@lru_cache(1)
def _powers() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; grown when a longer chunk comes."""
    return [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held, base = _powers(), 0x9E3779B97F4A7C15
    if len(held[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((base, pow(base, -1, 2**64))):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            held[k] = np.multiply.accumulate(row)
    return held[0][:n], held[1][:n]


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start. points: code points of all texts; first: where each (non-empty) text starts."""
    n, kind = len(points), _tables()[0][points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    blank, white = kind == BLANK, kind >= SPACE
    run = np.where(white, SPACE, kind)
    starts = begins[:n].copy()
    starts[1:] |= run[1:] != run[:-1]
    # The last white space before a word starts anew; a blank there belongs to the word.
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~begins[1:n]) if n > 1 else np.zeros(0, np.int64)
    starts[last] = True
    starts[last[blank[last]] + 1] = False
    # Contractions: an apostrophe that starts a word, then certain lower-case letters.
    at = np.flatnonzero((points == 0x27) & starts)
    at = at[(at + 1 < n)]
    at = at[~begins[at + 1]]
    if len(at):
        one, two = points[at + 1], points[np.minimum(at + 2, n - 1)]
        inside = ~begins[at + 2]
        is_in = lambda c, s: np.isin(c, [ord(x) for x in s])
        size = np.where(is_in(one, "stmd"), 2, np.where(inside & ((is_in(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))), 3, 0))
        at, size = at[size > 0], size[size > 0]
        starts[at + 1] = False
        after = at + size
        after = after[after < n]
        starts[after] |= kind[after] == LETTER
    return np.flatnonzero(starts)


class FlatEncoder:
    """Texts to ids. resolve: the ids of each of some distinct words; special: ids of strings that are no words; most: words kept."""

    def __init__(self, resolve: Callable[[list[str]], list[np.ndarray]], special: dict[str, int], most: int | None = None) -> None:
        self.resolve, self.special, self.most = resolve, special, most
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.reset()

    def reset(self) -> None:
        # Known words: sorted keys and their numbers; by number, where the ids lie in the pool.
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offset, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        # By number, where the word's characters lie and how many there are.
        self.chars, self.filled, self.count = np.zeros(1 << 16, np.uint32), 0, 0
        self.place, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of words by their keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], -1).astype(np.int64)

    def store(self, words: list[str]) -> np.ndarray:
        """Put the ids and characters of new words into the pools; their numbers."""
        ids = self.resolve(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        letters = np.fromiter(map(len, words), np.int64, len(words))
        total, many, start, end = int(sizes.sum()), int(letters.sum()), self.count, self.count + len(ids)
        while len(self.pool) < self.used + total:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.chars) < self.filled + many:
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        while len(self.offset) < end:
            self.offset, self.length, self.place, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length, self.place, self.size))
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        self.chars[self.filled : self.filled + many] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.offset[start:end], self.length[start:end] = self.used + np.cumsum(sizes) - sizes, sizes
        self.place[start:end], self.size[start:end] = self.filled + np.cumsum(letters) - letters, letters
        self.used, self.filled, self.count = self.used + total, self.filled + many, end
        return np.arange(start, end)

    def learn(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """Store new words under their keys; their numbers."""
        numbers = self.store(words)
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys, self.numbers = merged[order], np.concatenate([self.numbers, numbers.astype(np.int32)])[order]
        return numbers

    def checked(self, number: np.ndarray, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """number, after each word has been compared with the known word of its number; others are stored for themselves."""

        def apart(number: np.ndarray, bad: np.ndarray) -> np.ndarray:
            own: dict[str, list[int]] = {}
            for i in np.flatnonzero(bad).tolist():
                own.setdefault(joined[starts[i] : ends[i]], []).append(i)
            number = number.copy()
            for new, where in zip(self.store(list(own)).tolist(), own.values(), strict=True):
                number[where] = new
            return number

        length = ends - starts
        if (bad := self.size[number] != length).any():
            number = apart(number, bad)
        differs = self.chars[np.arange(len(points)) + np.repeat(self.place[number] - starts, length)] != points
        return apart(number, np.logical_or.reduceat(differs, starts)) if differs.any() else number

    def encode(self, many: list[str]) -> list[np.ndarray]:
        """The ids of each text (uint32); the cache is emptied when full, which never changes results."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(many):
            end, size = at, 0
            while end < len(many) and (end == at or size + len(many[end]) <= CHUNK_CHARS):
                size += len(many[end])
                end += 1
            out += self._some(many[at:end])
            at = end
        return out

    def _some(self, many: list[str]) -> list[np.ndarray]:
        marked = [i for i, t in enumerate(many) if self.special and any(s in t for s in self.special)]
        if not marked:
            return self._plain(many)
        pieces = [self.split(t) if i in set(marked) else [t] for i, t in enumerate(many)]
        flat = iter(self._plain([p for ps in pieces for p in ps[::2]]))
        done = []
        for ps in pieces:
            parts = [np.array([self.special[p]], np.uint32) if k % 2 else next(flat) for k, p in enumerate(ps)]
            done.append(np.concatenate(parts))
        return done

    def _plain(self, many: list[str]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, many), np.int64, len(many))
        n = int(sizes.sum())
        if not n:
            return [np.zeros(0, np.uint32) for _ in many]
        joined = "".join(many)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        starts = word_starts(points, begin[sizes > 0])
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_tables()[1][points] * up[:n], out=total[1:])
        ends = np.append(starts[1:], n)
        keys = (total[ends] - total[starts]) * down[starts]
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.count > (self.most or CACHE_WORDS) or self.filled > CACHE_CHARS:
            self.reset()
        number = self.find(distinct)
        new = np.flatnonzero(number < 0)
        if len(new):
            words = [joined[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            number[new] = self.learn(distinct[new], words)
        number = self.checked(number[inverse], joined, points, starts, ends)
        length = self.length[number].astype(np.int64)
        done = np.cumsum(length)
        ids = self.pool[np.repeat(self.offset[number] - done + length, length) + np.arange(done[-1])]
        upto = np.append(0, done)[np.searchsorted(starts, np.append(begin, n))]
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
