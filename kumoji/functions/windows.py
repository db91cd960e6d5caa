"""One short string against many windows of a long one at once: the figures of `similarity`, without a loop for each window.

The windows lie side by side as lanes of one large integer, so a step of the bit-parallel longest common subsequence takes
all of them one character of the short string further. Bits stand for the windows' characters, which gives the figure of
every prefix of a window as well.
"""

from __future__ import annotations

from functools import cached_property
from operator import add

import numpy as np

#: Bits of the lanes' character tables, and places in all, that are held at once.
TABLE_BITS, PLACES = 1 << 23, 1 << 20
_NEVER = np.iinfo(np.int64).max


class Text:
    """A text whose windows are compared; what is prepared depends on it alone."""

    def __init__(self, text: str) -> None:
        self.text, self.size = text, len(text)

    @cached_property
    def _coded(self) -> tuple[dict[str, int], np.ndarray]:
        """A number for each character, and the text in these, with one more at its end that is no character."""
        chars, codes = np.unique(np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
        kind = np.uint8 if len(chars) < 256 else np.uint32
        return {chr(c): i for i, c in enumerate(chars.tolist())}, np.append(codes, len(chars)).astype(kind)

    @cached_property
    def _bigrams(self) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of bigrams; of the bigram that ends at each place its number and where it is in `order`; `order`: places
        by bigram; where in it each bigram begins. There is a last bigram that is none, for the first place and the end."""
        chars, codes = self._coded
        pairs = codes[: max(0, self.size - 1)].astype(np.int64) * (len(chars) + 1) + codes[1 : max(1, self.size)]
        _, first, number = np.unique(pairs, return_index=True, return_inverse=True)
        number = np.concatenate(([len(first)], number, [len(first)])) if self.size else np.zeros(1, np.int64)
        order = np.argsort(number, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        begins = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(first) + 1))))
        return {self.text[i : i + 2]: k for k, i in enumerate(first.tolist())}, number, rank, order, begins

    def _common(self, a: str, starts: np.ndarray, width: int) -> np.ndarray:
        """For each start and place of its window whether the subsequence that a shares with the window grows there."""
        known, codes = self._coded
        present = [c for c in dict.fromkeys(a) if c in known]
        lane = (width // 8 + 1) * 8  # at least one bit more than the window, for the carry
        if not present:
            return np.zeros((len(starts), width), bool)
        at = starts[:, None] + np.arange(lane)
        window = codes[np.minimum(at, self.size, out=at)]
        window[:, width:] = codes[-1]
        numbers = np.array([known[c] for c in present], codes.dtype)
        bits = np.packbits(window[None] == numbers[:, None, None], axis=-1, bitorder="little")
        places = {c: int.from_bytes(bits[i].tobytes(), "little") for i, c in enumerate(present)}
        full = v = int.from_bytes(((1 << width) - 1).to_bytes(lane // 8, "little") * len(starts), "little")
        for here in [places[c] for c in a if c in places]:
            u = v & here
            v = (v + u | v ^ u) & full
        left = np.frombuffer(v.to_bytes(len(starts) * lane // 8, "little"), np.uint8).reshape(len(starts), -1)
        return np.unpackbits(left, axis=1, count=width, bitorder="little") == 0

    def _before(self, a: str, low: int, high: int) -> np.ndarray:
        """For the bigrams that end at the places from low to high: a window that begins at this place or later shares the
        bigram, as fewer of it lie before in the window than a has of it; _NEVER if a has none."""
        known, number, rank, order, begins = self._bigrams
        has = np.bincount([known.get(g, len(known)) for g in map(add, a, a[1:])], minlength=len(begins))
        has[len(known)] = 0
        own = number[low : high + 1]
        most = has[own]
        back = rank[low : high + 1] - most
        before = np.where(back >= begins[own], order[np.maximum(back, 0)], -_NEVER)
        before[most == 0] = _NEVER
        return before

    def _shared(self, a: str, starts: np.ndarray, width: int) -> np.ndarray:
        """For each start and place of its window whether the bigram that ends there is one more that a shares with the window."""
        low, high = int(starts.min()), min(int(starts.max()) + width, self.size)
        at = starts[:, None] + np.arange(width)
        found = self._before(a, low, high)[np.minimum(at, high, out=at) - low] <= starts[:, None]
        found[:, 0] = False
        return found

    def shared(self, a: str, first: int, last: int, width: int) -> np.ndarray:
        """How many bigrams a shares with each window of a width that starts from first to last: a bigram counts for those
        that begin within one stretch. Windows may begin before the text."""
        low, high = max(1, first + 1), min(self.size - 1, last + width - 1)
        before = self._before(a, low, high)
        place = np.flatnonzero(before != _NEVER)
        before, place = before[place], place + low
        until = np.minimum(place, last + 1)
        since = np.minimum(np.maximum(np.maximum(before, place - width + 1), first), until)
        n = last - first + 2
        return np.cumsum(np.bincount(since - first, minlength=n) - np.bincount(until - first, minlength=n))[:-1]

    def prefixes(self, a: str, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(longest common subsequence, shared bigrams) of a and the windows of each length at each start. What lies behind
        the text's end is no character."""
        width, columns = int(lengths[-1]), lengths - 1
        each = max(1, min(TABLE_BITS // ((width + 8) * max(1, len(set(a)))), PLACES // width))
        parts = [starts[i : i + each] for i in range(0, len(starts), each)]
        steps = [np.cumsum(f(a, p, width), axis=1, dtype=np.int32)[:, columns] for f in (self._common, self._shared) for p in parts]
        return np.concatenate(steps[: len(parts)]), np.concatenate(steps[len(parts) :])

    def common(self, a: str, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The longest common subsequence of a and each window."""
        if not (width := int(lengths.max(initial=0))):
            return np.zeros(len(starts), np.int64)
        each = max(1, min(TABLE_BITS // ((width + 8) * len(set(a))), PLACES // width))
        parts = [slice(i, i + each) for i in range(0, len(starts), each)]
        return np.concatenate([(self._common(a, starts[p], width) & (np.arange(width) < lengths[p, None])).sum(axis=1) for p in parts])


class Neighbours:
    """similarity(a, window) for all windows of a width that start within a stretch of a text, or before it: `value` is at
    first only the most that it can be."""

    def __init__(self, text: Text, a: str, first: int, last: int, width: int) -> None:
        self.text, self.a, self.first = text, a, first
        starts = np.arange(first, last + 1)
        self.starts = np.maximum(0, starts)
        self.lengths = np.minimum(text.size, starts + width) - self.starts
        self.known = np.zeros(len(starts), bool)
        self.shared = text.shared(a, first, last, width)
        self.value = mixed(len(a), self.lengths, np.minimum(len(a), self.lengths), self.shared)

    def find(self, starts: np.ndarray) -> None:
        wanted = np.zeros(len(self.known), bool)
        wanted[starts - self.first] = True
        i = np.flatnonzero(wanted & ~self.known)
        if len(i):
            common = self.text.common(self.a, self.starts[i], self.lengths[i])
            self.value[i], self.known[i] = mixed(len(self.a), self.lengths[i], common, self.shared[i]), True


def mixed(n: int, lengths: np.ndarray, common: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The similarity of a string of n characters, not none, and strings of other lengths, by their longest common subsequences and shared bigrams."""
    total = max(1, n - 1) + np.where(lengths > 1, lengths - 1, lengths)
    return np.where((lengths == n) & (common == n), 1.0, 0.65 * (2 * common / (n + lengths)) + 0.35 * (2 * shared / total))
