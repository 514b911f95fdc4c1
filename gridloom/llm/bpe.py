"""Byte-pair merges for many words at once, as rounds over flat numpy symbol arrays.

A round finds each word's smallest pair rank, merges all leftmost occurrences of it, drops the merged symbols and retires the
words that have no pair left. Words in which a simultaneous merge could differ from merging one by one (a new pair that ranks
no later than the one just merged, next to a second occurrence) are merged again singly.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressed table: (left symbol, right symbol) -> (rank, merged symbol)."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.uint64), np.asarray(right, np.uint64)
        self.rank, self.merged = np.append(np.asarray(rank, np.int32), NONE), np.append(np.asarray(merged, np.int32), np.int32(-1))
        key = (left << np.uint64(32)) | right
        self.bits = max(4, int(len(key) * 8).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(self.mask + 1, np.uint64(2**64 - 1))
        self.slot = np.full(self.mask + 1, len(key), np.int32)
        todo, at = np.arange(len(key)), self._home(key)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slot[at] == len(key)
            first = np.zeros(len(todo), bool)
            _, one = np.unique(at[free], return_index=True)
            first[np.flatnonzero(free)[one]] = True
            self.slot[at[first]], self.keys[at[first]] = todo[first], key[todo[first]]
            todo, at = todo[~first], (at[~first] + 1) & self.mask
        self.pairs = dict(zip(key.tolist(), range(len(key)), strict=True))

    def _home(self, key):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Entry of each pair, or the number of entries (rank NONE) where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._home(key)
        none = np.int32(len(self.rank) - 1)
        out = np.where(self.keys[at] == key, self.slot[at], none)
        open_ = np.flatnonzero((out == none) & (self.slot[at] != none))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            hit = self.keys[at[open_]] == key[open_]
            out[open_[hit]] = self.slot[at[open_[hit]]]
            open_ = open_[~hit & (self.slot[at[open_]] != none)]
        return out

    def singly(self, symbols: list[int]) -> list[int]:
        """The leftmost pair of the smallest rank, again and again."""
        s = list(symbols)
        rank, merged = self.rank, self.merged
        found = [self.pairs.get((a << 32) | b, -1) for a, b in zip(s, s[1:], strict=False)]
        while True:
            best, where = None, -1
            for i, e in enumerate(found):
                if e >= 0 and (best is None or rank[e] < best):
                    best, where = rank[e], i
            if where < 0:
                return s
            s[where : where + 2] = [int(merged[found[where]])]
            del found[where]
            for i in (where - 1, where):
                if 0 <= i < len(s) - 1:
                    found[i] = self.pairs.get((s[i] << 32) | s[i + 1], -1)


def merge_rounds(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of the words after all merges. symbols: all words' one after the other; lengths: of each word, over 0."""
    n = len(lengths)
    done_symbols: list[np.ndarray] = []
    done_words: list[np.ndarray] = []
    done_lengths: list[np.ndarray] = []
    slow: dict[int, np.ndarray] = {}
    first = np.cumsum(lengths) - lengths
    word = np.arange(n)
    sym, size = symbols.astype(np.int64), lengths.astype(np.int64)
    while len(word):
        starts = np.cumsum(size) - size
        entry = np.full(len(sym), len(table.rank) - 1, np.int64)
        entry[:-1] = table.find(sym[:-1], sym[1:])
        entry[starts[1:] - 1] = len(table.rank) - 1
        rank = table.rank[entry]
        least = np.minimum.reduceat(rank, starts)
        live = least != NONE
        if not live.all():
            keep = np.repeat(live, size)
            done_symbols.append(sym[~keep])
            done_words.append(word[~live])
            done_lengths.append(size[~live])
            sym, entry, rank = sym[keep], entry[keep], rank[keep]
            word, size, least = word[live], size[live], least[live]
            if not len(word):
                break
            starts = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(word)), size)
        marked = rank == least[owner]
        both = np.flatnonzero(marked[1:] & marked[:-1])
        if len(both):  # neighbours overlap: of a run of marks every other one holds, from its left end
            at = np.arange(len(marked))
            begin = marked.copy()
            begin[1:] &= ~marked[:-1]
            marked &= (at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 0
        where = np.flatnonzero(marked)
        sym[where] = table.merged[entry[where]]
        keep = np.ones(len(sym), bool)
        keep[where + 1] = False
        count = np.bincount(owner[where], minlength=len(word))
        new_at = (np.cumsum(keep) - 1)[where]
        sym, of = sym[keep], owner[where]
        size = size - count
        starts = np.cumsum(size) - size
        many = count[of] > 1
        if many.any():
            at, of = new_at[many], of[many]
            bad = np.zeros(len(at), bool)
            inner = at > starts[of]
            bad[inner] |= table.rank[table.find(sym[at[inner] - 1], sym[at[inner]])] <= least[of[inner]]
            inner = at < starts[of] + size[of] - 1
            bad[inner] |= table.rank[table.find(sym[at[inner]], sym[at[inner] + 1])] <= least[of[inner]]
            if bad.any():
                out = np.zeros(len(word), bool)
                out[of[bad]] = True
                for w in word[out].tolist():
                    slow[w] = np.asarray(table.singly(symbols[first[w] : first[w] + lengths[w]].tolist()), np.int64)
                keep = ~np.repeat(out, size)
                sym, word, size = sym[keep], word[~out], size[~out]
    if slow:
        done_words.append(np.fromiter(slow, np.int64, len(slow)))
        done_lengths.append(np.fromiter(map(len, slow.values()), np.int64, len(slow)))
        done_symbols.append(np.concatenate(list(slow.values())))
    if not done_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, sizes, flat = np.concatenate(done_words), np.concatenate(done_lengths), np.concatenate(done_symbols)
    order = np.argsort(words)
    from .common import gather

    return flat[gather((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]


class IdStore:
    """Ids of words seen before. At most `most` words are remembered; beyond that it starts anew, which only costs time."""

    def __init__(self, encode, most: int = 400_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Row of each word in starts and lengths (places in flat)."""
        if len(self.known) > self.most:
            self._clear()
        known = self.known
        rows = [known.get(w, -1) for w in words]
        new = [w for w, r in zip(words, rows, strict=True) if r < 0]
        if new:
            flat, lengths = self.encode(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            base = len(known)
            known.update(zip(new, range(base, base + len(new)), strict=True))
            rows = [known[w] if r < 0 else r for w, r in zip(words, rows, strict=True)]
        return np.fromiter(rows, np.int64, len(rows))
