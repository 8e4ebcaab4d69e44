"""Deep-shallow sorting of text suffixes up to a given depth.

Shallow: multikey quicksort down to ``SHALLOW`` bytes. Its characters are words of 8 bytes, so one level compares 8 bytes
of each suffix; suffixes with equal words so far are a group, and only groups go on to the next level.

Deep: each group that is left shares a long prefix and is ordered by blind tries. A trie holds no common bytes, only
the depth at which a suffix leaves a path and the byte it leaves by. One leaf is compared with all suffixes of its
group, which tells where each leaves that leaf's path; those that leave at the same depth by the same byte are a subtree, a
group of the next round. All groups of a round are handled together, as arrays.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort compares; a multiple of 8.
SHALLOW = 16


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as an unsigned integer that compares as the bytes do; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, 0, (1,)).astype(np.uint64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a value of ``keys`` differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _shared(w: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, start: int) -> np.ndarray:
    """Common bytes of the suffixes a and b, known to share ``start``, up to ``depth``."""
    same = np.full(len(a), start, np.int64)
    open_ = np.arange(len(a))
    for off in range(start, depth, 8):
        x = w[a[open_] + off] ^ w[b[open_] + off]
        # leading bytes in which the words agree
        n = np.zeros(len(x), np.int64)
        for k in range(8):
            n += x < np.uint64(1 << (56 - 8 * k)) if k < 7 else x == 0
        same[open_] = np.minimum(off + n, depth)
        open_ = open_[(n == 8)]
        if not len(open_):
            break
    return same


def deep_shallow_sort(data: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): ``suffixes[order]`` is sorted by the first ``depth`` bytes; new[i] is False where the i-th of them
    shares all ``depth`` bytes with the one before it.

    Every suffix must have ``depth`` bytes in ``data``. Suffixes that are equal so far come in any order.
    """
    n = len(suffixes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    w = words(data)
    shallow = min(SHALLOW, depth // 8 * 8)
    order, new = np.arange(n), np.r_[True, np.zeros(n - 1, bool)]
    for off in range(0, shallow, 8):
        # places of the suffixes that still share all bytes with a neighbour, group by group
        at = np.flatnonzero(~new | np.r_[~new[1:], False])
        if not len(at):
            return order, new
        group, char = np.cumsum(new[at]), w[suffixes[order[at]] + off]
        by = np.argsort(char) if off == 0 else np.lexsort((char, group))
        order[at], new[at] = order[at][by], _runs(group[by], char[by])
    done = np.zeros(n, bool)  # members of a group that share the whole depth
    while True:
        inside = ~new | np.r_[~new[1:], False]
        at = np.flatnonzero(inside & ~done)
        if not len(at):
            return order, new
        first = new[at]
        group = np.cumsum(first) - 1
        pos = suffixes[order[at]]
        leaf = pos[first][group]  # the path of each group's first suffix
        left = _shared(w, pos, leaf, depth, shallow)
        gone = left < depth
        own, its = data[np.minimum(pos + left, len(data) - 1)], data[np.minimum(leaf + left, len(data) - 1)]
        # smaller bytes leave to the left, the deeper the later; greater ones to the right, the deeper the earlier
        place = np.where(own < its, left, 2 * depth + 2 - left) * 256 + own
        place = np.where(gone, place, (depth + 1) * 256)
        by = np.lexsort((place, group))
        order[at], new[at] = order[at][by], _runs(group[by], place[by])
        done[at] = ~gone[by]
