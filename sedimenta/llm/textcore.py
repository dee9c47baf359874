"""Vectorised text primitives for Python workers: spans, span hashes, hash tables.

Texts of a batch are laid end to end as one array of code points (or bytes); tokens are
found as class changes in it and hashed by array passes, with no Python step a token. A hash
sums a mixed value of each character and its place, so no pattern of characters makes two
tokens share one. Where a token's own result hangs on it (token ids, word scores), what was
remembered under a hash is compared with the token's characters too (:class:`Memo`).
"""

from __future__ import annotations

import ctypes
import functools
import unicodedata

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
#: Characters (or bytes) that are handled at once; a longer text is handled alone.
SLICE = 1 << 18


_held: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What this process keeps for an operator; worker processes are reused, so what another one left goes first."""
    if operator not in _held:
        _held.clear()
        trim()
        _held[operator] = {}
    return _held[operator]


def trim() -> None:
    """Hands memory that was freed back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def lean(operator: str, run):
    """``run``, from batches to batches, as a worker's function that leaves little memory behind."""

    def lean_run(batches):
        held(operator)
        try:
            yield from run(batches)
        finally:
            trim()

    return lean_run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all of them."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], the same wherever the span lies."""
    out = mix((ends - starts).astype(U64) * U64(_STEP))
    first = 0
    for last in _portions(ends - starts):
        if last == first + 1:  # one span, however long, in pieces
            for at in range(int(starts[first]), int(ends[first]), SLICE):
                piece = values[at : min(at + SLICE, int(ends[first]))]
                place = np.arange(at - int(starts[first]), at - int(starts[first]) + len(piece), dtype=U64)
                out[first:last] += mix((piece.astype(U64) << U64(43)) | place).sum(keepdims=True, dtype=U64)
        else:
            n = ends[first:last] - starts[first:last]
            at = ragged(starts[first:last], n)
            place = (at - np.repeat(starts[first:last], n)).astype(U64)
            some = np.flatnonzero(n)
            if len(some):
                out[first + some] += np.add.reduceat(mix((values[at].astype(U64) << U64(43)) | place), (np.cumsum(n) - n)[some])
        first = last
    return mix(out)


def _portions(lengths: np.ndarray):
    """Ends of portions of spans with about ``SLICE`` characters each; a longer span is a portion of its own."""
    total = np.cumsum(lengths)
    first, n = 0, len(lengths)
    while first < n:
        before = total[first - 1] if first else 0
        first = max(first + 1, int(np.searchsorted(total, before + SLICE, "right")))
        yield first


def slices(lengths: list[int], limit: int = SLICE):
    """Cuts a batch into (first, last + 1) with at most ``limit`` characters each, if no text alone has more."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts end to end: as a string, as code points, and each one's offset (one more than texts)."""
    whole = "".join(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return whole, np.frombuffer(whole.encode("utf-32-le"), "<u4"), offsets


@functools.cache
def category_table() -> np.ndarray:
    """By code point: 1 letter, 2 number, 0 white space, 3 other."""
    table = np.full(0x110000, 3, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = 1
        elif kind == "N":
            table[i] = 2
    # The Unicode property White_Space.
    for i in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[i] = 0
    return table


@functools.cache
def lower_table() -> np.ndarray:
    """Each code point's lower case, where that is one code point, else itself."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and len(low := chr(i).lower()) == 1:
            table[i] = ord(low)
    return table


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true in ``inside`` that don't cross a text's border: starts, ends, and the text of each."""
    n = len(inside)
    if not n:
        return (np.empty(0, np.int64),) * 3
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Table:
    """An open-addressing map from 64-bit hashes to row numbers, looked up by arrays."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U64)
        self.rows = np.full(1 << bits, -1, np.int32)
        self.size = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        todo, at = np.arange(len(h)), (h & U64(self.mask)).astype(np.int64)
        while len(todo):
            rows = self.rows[at]
            full = rows >= 0
            hit = full & (self.keys[at] == h[todo])
            out[todo[hit]] = rows[hit]
            go = full & ~hit
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        """Adds distinct hashes that the table doesn't have."""
        if (self.size + len(h)) * 2 > self.mask:
            keys, old = self.keys[self.rows >= 0], self.rows[self.rows >= 0]
            self.clear(max(16, int(2 * (len(keys) + len(h))).bit_length()))
            self._put(keys, old)
        self._put(h, rows)

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        self.size += len(h)
        at = (h & U64(self.mask)).astype(np.int64)
        while len(h):
            free = self.rows[at] < 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(h), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.rows[at[take]] = h[take], rows[take]
            h, rows, at = h[~take], rows[~take], (at[~take] + 1) & self.mask


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first[0] .. first[0] + count[0] - 1, first[1] .., end to end."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - count), count)


#: So many characters below 256 fit a 64-bit key with their number.
_SHORT = 7


def memo_keys(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each span, and whether the key tells all of it; else it is a hash."""
    n = ends - starts
    packed, high = n.astype(U64), np.zeros(len(n), values.dtype)
    some = np.flatnonzero(n <= _SHORT)
    for k in range(_SHORT):
        some = some[n[some] > k]
        if not len(some):
            break
        c = values[starts[some] + k]
        packed[some] |= c.astype(U64) << U64(8 * k + 8)
        high[some] |= c
    exact = (n <= _SHORT) & (high < 256)
    h = mix(packed)
    rest = np.flatnonzero(~exact)
    h[rest] = span_hashes(values, starts[rest], ends[rest])
    return h, exact


class Memo:
    """Row numbers of distinct spans of characters: short ones by themselves, others by hash and then by their characters."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.table, self.size, self.used = Table(), 0, 0
        #: Where a span's characters lie, and how many there are; none of those whose key tells all.
        self.first, self.length = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)
        #: Spans whose hash another one has taken.
        self.clash: dict[bytes, int] = {}

    def _grow(self, name: str, n: int) -> None:
        old = getattr(self, name)
        if n > len(old):
            setattr(self, name, np.concatenate((old, np.zeros(max(n - len(old), len(old)), old.dtype))))

    def add(self, h: np.ndarray, exact: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """New row numbers for spans with distinct keys that the table doesn't have."""
        n = np.where(exact, 0, ends - starts)
        rows = np.arange(self.size, self.size + len(h))
        for name in ("first", "length"):
            self._grow(name, self.size + len(h))
        total = int(n.sum())
        self._grow("flat", self.used + total)
        self.first[rows], self.length[rows] = self.used + np.cumsum(n) - n, np.where(exact, -1, n)
        self.flat[self.used : self.used + total] = values[ragged(starts, n)]
        self.size, self.used = self.size + len(h), self.used + total
        self.table.add(h, rows)
        return rows

    def find(self, h: np.ndarray, exact: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each span, -1 where there is none."""
        rows = self.table.find(h)
        known = np.flatnonzero(rows >= 0)
        n = np.where(exact[known], -1, (ends - starts)[known])
        wrong = n != self.length[rows[known]]
        same = np.flatnonzero(~wrong & (n > 0))
        done = 0
        for last in _portions(n[same]):
            at, k = known[same[done:last]], n[same[done:last]]
            differ = values[ragged(starts[at], k)] != self.flat[ragged(self.first[rows[at]], k)]
            wrong[same[done:last]] = np.logical_or.reduceat(differ, np.cumsum(k) - k)
            done = last
        for i in known[wrong].tolist():
            rows[i] = self.clash.get(values[starts[i] : ends[i]].astype("<u4").tobytes(), -1)
        return rows

    def lookup(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each span, -1 where there is none; nothing is learned."""
        return self.find(*memo_keys(values, starts, ends), values, starts, ends)

    def rows(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn, most: int, forget=None) -> np.ndarray:
        """The row of each span. ``learn`` gets the index of one of each new span, whose rows follow on those there are.

        When more than ``most`` would be remembered all are forgotten first, and ``forget`` is called.
        """
        h, exact = memo_keys(values, starts, ends)
        rows = self.find(h, exact, values, starts, ends)
        new = np.flatnonzero(rows < 0)
        if len(new) and self.size and self.size + len(np.unique(h[new])) > most:
            self.forget()
            if forget:
                forget()
            rows[:] = -1
            new = np.arange(len(h))
        if len(new):
            free = new[self.table.find(h[new]) < 0]
            where = free[np.unique(h[free], return_index=True)[1]]
            if len(where):
                learn(where)
                self.add(h[where], exact[where], values, starts[where], ends[where])
            rows[new] = self.find(h[new], exact[new], values, starts[new], ends[new])
            for i in np.flatnonzero(rows < 0).tolist():
                text = values[starts[i] : ends[i]].astype("<u4").tobytes()
                if text not in self.clash:
                    learn(np.array([i]))
                    self.clash[text] = self.size
                    self.size += 1
                    for name in ("first", "length"):
                        self._grow(name, self.size)
                rows[i] = self.clash[text]
        return rows
