"""A bidirectional FM-index of a delimited vocabulary in numpy, and search schemes of one error over it.

The text is the sorted distinct words with a delimiter before and after each. One index is of the text, for extending
a pattern to the left; the other is of the words read backward, for extending to the right. A pattern is an interval of
suffix ranks, and an extension by a character maps the interval by the character's ranks in the Burrows-Wheeler
transform. The delimiter is the least character and the words are sorted, so the k-th suffix that starts with it is
that of word k: a whole word between two delimiters is an interval of one rank, which names the word.

The schemes for a word in two halves: match one half exactly from its own end of the word, then extend over the other
half with one error, up to the delimiter. Between them they find every word that differs by one replaced character,
and every word that is one character longer (a shorter one finds this one in turn). As each search starts at a
delimiter and runs to the other end, it never changes direction, so the two intervals need not be kept in step.
"""

from __future__ import annotations

import numpy as np

#: Interval width from which the alphabet is tried instead of the interval's own characters.
WIDE = 64
#: Queries searched at once, states that branch at once, and states with their error that are finished at once.
FRONT, BRANCH, PENDING = 1 << 17, 1 << 14, 1 << 19


class FMIndex:
    """Of distinct words, arrays of codes from 1 up, in sorted order; extends patterns to the left."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        """codes: all words behind one another; starts: where each begins, and the end."""
        n = len(starts) - 1
        lengths = np.diff(starts)
        size = len(codes) + n + 1
        text = np.zeros(size, np.int64)  # 0, word, 0, word, ..., 0
        word = np.repeat(np.arange(n), lengths)
        text[np.arange(len(codes)) + word + 1] = codes
        owner = np.full(size, -1, np.int64)  # of a delimiter: the word behind it; of a character: that behind its word
        owner[starts[:-1] + np.arange(n)] = np.arange(n)
        owner[np.arange(len(codes)) + word + 1] = np.where(word + 1 < n, word + 1, -1)
        order = self._suffixes(text, owner)
        before = text[order - 1]  # the text is a ring: before the first delimiter comes the last
        self.size, self.sigma, self.words, self.bwt = size, int(text.max()) + 1, n, before
        self.at = np.sort(before * size + np.arange(size))  # each character's places in the transform

    @staticmethod
    def _suffixes(text: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Suffixes sorted by what is left of their word, then by the next word: that is by suffix, as words are sorted and distinct."""
        size = len(text)
        rank, step = text.copy(), 1
        ends = np.flatnonzero(text == 0)
        left = ends[np.searchsorted(ends, np.arange(size))] - np.arange(size)  # characters before the delimiter
        distinct = len(np.unique(rank))
        while step <= left.max(initial=0):
            ahead = np.where(left >= step, rank[np.minimum(np.arange(size) + step, size - 1)] + 1, 0)
            rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1]
            now, step = int(rank.max()) + 1, 2 * step
            if now == distinct:
                break
            distinct = now
        return np.lexsort((owner, rank))

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c before what the given intervals stand for."""
        key = c * self.size
        return np.searchsorted(self.at, key + low), np.searchsorted(self.at, key + high)

    def ahead(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, character) of the characters that come before each interval, each once or of a wide one all of the alphabet."""
        width = high - low
        narrow = np.flatnonzero(width <= WIDE)
        n = width[narrow]
        state = np.repeat(narrow, n)
        place = low[state] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.unique(state * self.sigma + self.bwt[place])
        wide = np.flatnonzero(width > WIDE)
        return np.r_[own // self.sigma, np.repeat(wide, self.sigma)], np.r_[own % self.sigma, np.tile(np.arange(self.sigma), len(wide))]


class _States:
    """Searches under way: for each its query, how many characters it has matched from the end, and its interval."""

    def __init__(self, query: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.all = (query, at, low, high)

    def __len__(self) -> int:
        return len(self.all[0])

    def take(self, pick: np.ndarray | slice) -> _States:
        return _States(*(x[pick] for x in self.all))


def near(index: FMIndex, codes: np.ndarray, starts: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): for each query the words that end in its last `exact` characters and have one replaced or one more character before.

    codes, starts: the queries as the index's words, but each from its last character to its first.
    """
    lengths = np.diff(starts)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def matched(states: _States, until: np.ndarray) -> _States:
        """The states extended by their queries' characters up to `until`, without those that die."""
        done = []
        while True:
            ready = states.all[1] >= until
            done.append(states.take(ready))
            states, until = states.take(~ready), until[~ready]
            if not len(states):
                return _States(*(np.concatenate(x) for x in zip(*(d.all for d in done), strict=True)))
            query, at, low, high = states.all
            low, high = index.extend(codes[starts[query] + at], low, high)
            live = low < high
            states, until = _States(query[live], at[live] + 1, low[live], high[live]), until[live]

    def finish(pending: list[_States]) -> None:
        """What has its error is matched to the end; an interval between two delimiters is a word."""
        states = _States(*(np.concatenate(x) for x in zip(*(p.all for p in pending), strict=True)))
        query, _, low, high = matched(states, lengths[states.all[0]]).all
        low, high = index.extend(np.zeros(len(query), np.int64), low, high)
        out.append((query[low < high], low[low < high] - 1))  # the last delimiter's suffix comes first of all
        pending.clear()

    pending: list[_States] = []
    for begin in range(0, len(lengths), FRONT):
        query = np.arange(begin, min(len(lengths), begin + FRONT))
        n = len(query)
        states = matched(_States(query, np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.words + 1)), exact[query])
        while len(states):
            for a in range(0, len(states), BRANCH):
                query, at, low, high = states.take(slice(a, a + BRANCH)).all
                state, c = index.ahead(low, high)
                state, c = state[c > 0], c[c > 0]
                low, high = index.extend(c, low[state], high[state])
                live = low < high
                state, c, low, high = state[live], c[live], low[live], high[live]
                query, at = query[state], at[state]
                inside = at < lengths[query]
                other = inside & (c != codes[np.minimum(starts[query] + at, len(codes) - 1)])
                pending += [_States(query[other], at[other] + 1, low[other], high[other]), _States(query, at, low, high)]
                if sum(map(len, pending)) > PENDING:
                    finish(pending)
            states = states.take(states.all[1] < lengths[states.all[0]])
            states = matched(states, states.all[1] + 1)
    if pending:
        finish(pending)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
