"""Binary-trie self-join of fingerprints in numpy.

A sorted array of distinct fingerprints is an implicit binary trie: a node is a range that shares its upper bits.
Node pairs are walked down together, one bit a level; a pair collects the bits in which its two sides differ and
is dropped once these exceed the budget. Pairs that can only link what is already linked are dropped as well, so a
dense cluster costs about its size and not the square of it.
"""

from __future__ import annotations

import numpy as np

#: Node pairs held at once; wider fronts are cut in two and walked one after the other.
FRONT = 1 << 18


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each class's smallest index) after the links a-b: hooking and pointer jumping."""
    labels = labels.copy()
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def classes(fps: np.ndarray, groups: np.ndarray, budget: int, passes: tuple[int, ...] = (), found: list | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """For each fingerprint the smallest index it is linked to, by chains of pairs in one group with at most `budget` differing bits.

    fps is uint64, with a row of words (most significant first) for each fingerprint if it has more than 64 bits;
    (group, fp) must be sorted and distinct. Small budgets go first, as what they link need not be walked again:
    those of `passes`, by default all.

    found collects (i, j, differing bits) of near pairs, one at least for each two classes that were linked, of the
    fewest bits that the step saw. With start, labels that are linked already, nothing more is linked and found gets every
    near pair of different labels.
    """
    fps = fps.reshape(len(fps), -1)
    n, last = fps.shape[0], 64 * fps.shape[1] - 1
    labels = np.arange(n)
    if start is not None:
        _, first, inverse = np.unique(start, return_index=True, return_inverse=True)
        labels = first[inverse]
    if n < 2:
        return labels
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], n]
    wide = ends - starts > 1
    starts, ends = starts[wide], ends[wide]

    def ones(level: int) -> np.ndarray:
        """How many of the first k fingerprints have the bit, for each k."""
        word = fps[:, -1 - level // 64]
        return np.concatenate([[0], np.cumsum((word >> np.uint64(level % 64)) & np.uint64(1), dtype=np.int64)])

    for most in passes or range(1, budget + 1):
        stack = [(last, starts, ends, starts, ends, np.zeros(len(starts), np.int16))]
        while stack:
            level, al, ah, bl, bh, err = stack.pop()
            changes = np.cumsum(np.r_[False, labels[1:] != labels[:-1]])
            one = (changes[al] == changes[ah - 1]) & (changes[bl] == changes[bh - 1]) & (labels[al] == labels[bl])
            if one.any():
                al, ah, bl, bh, err = (x[~one] for x in (al, ah, bl, bh, err))
            single = (ah - al == 1) & (bh - bl == 1)
            if single.any():
                i, j = al[single], bl[single]
                bits = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int16)
                near = bits <= most
                if found is not None:
                    near &= labels[i] != labels[j]
                    order = np.flatnonzero(near)
                    if start is None:  # the nearest pair of each two classes
                        order = order[np.argsort(bits[order], kind="stable")]
                        x, y = labels[i[order]], labels[j[order]]
                        order = order[np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)[1]]
                    if len(order):
                        found.append((i[order], j[order], bits[order]))
                if start is None:
                    labels = merged(labels, i[near], j[near])
                al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
            if not len(al) or level < 0:
                continue
            if len(al) > FRONT:
                half = len(al) // 2
                stack += [(level, *(x[k] for x in (al, ah, bl, bh, err))) for k in (slice(0, half), slice(half, None))]
                continue
            count = ones(level)
            am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
            fresh = al != bl
            parts = [
                (al, am, bl, bm, err),
                (am, ah, bm, bh, err),
                (al, am, bm, bh, err + 1),
                tuple(x[fresh] for x in (am, ah, bl, bm, err + 1)),  # of a node with itself this is the pair above
            ]
            al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts, strict=True))
            live = (err <= most) & (ah > al) & (bh > bl) & ~((al == bl) & (ah - al == 1))
            stack.append((level - 1, al[live], ah[live], bl[live], bh[live], err[live]))
    return labels
