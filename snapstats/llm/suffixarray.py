"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

Suffixes are S (smaller than the next) or L (larger). Leftmost S suffixes (LMS) are sorted first: their
substrings by one induction, then, if some are equal, the string of their ranks recursively. From the
sorted LMS suffixes all L suffixes are induced from left to right, then all S suffixes from right to left.
The scans over few letters go bucket by bucket: what a bucket's entries induce is computed for all of them at
once, again for those that fall in the same bucket. A string of ranks has too many buckets for that to pay;
its scans go entry by entry. Both are linear, and every level of the recursion is induced.
"""

from __future__ import annotations

import numpy as np

#: The most letters for which bucket-wise induction is used.
LETTERS = 1024


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S; the last is the sentinel."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    nearest = differs[np.searchsorted(differs, np.arange(n - 1))]
    return np.append(text[nearest] < text[nearest + 1], True)


def _put(order: np.ndarray, at: np.ndarray, letters: np.ndarray, found: np.ndarray, step: int) -> None:
    """Add suffixes to their buckets in turn: at the front for step 1, at the back for step -1."""
    by = np.argsort(letters, kind="stable")
    letters, found = letters[by], found[by]
    first = np.ones(len(letters), bool)
    first[1:] = letters[1:] != letters[:-1]
    begin = np.flatnonzero(first)
    n = np.diff(np.append(begin, len(letters)))
    order[at[letters] + step * (np.arange(len(letters)) - np.repeat(begin, n))] = found
    at[letters[begin]] += step * n


def _induce(text: np.ndarray, small: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from that of the seeds (LMS suffixes, in order)."""
    order = np.full(len(text), -1, np.int32)
    begins = np.append(0, ends[:-1])
    of_seed = text[seeds]
    bounds = np.searchsorted(of_seed, np.arange(len(ends) + 1))

    def go(now: np.ndarray, letter: int, at: np.ndarray, want: bool, step: int) -> None:
        while len(now):
            before = now[now > 0] - 1
            before = before[small[before] == want]
            if not len(before):
                return
            letters = text[before]
            _put(order, at, letters, before, step)
            now = before[letters == letter]

    front = begins.copy()
    for c in range(len(ends)):
        go(order[begins[c] : front[c]].copy(), c, front, False, 1)
        go(seeds[bounds[c] : bounds[c + 1]], c, front, False, 1)
    back = ends - 1
    for c in range(len(ends) - 1, -1, -1):
        go(order[back[c] + 1 : ends[c]][::-1].copy(), c, back, True, -1)
        go(order[begins[c] : front[c]][::-1].copy(), c, back, True, -1)
    order[0] = len(text) - 1
    return order


def _induce_each(text: np.ndarray, small: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """As ``_induce``, one entry after another. For each suffix the bucket that it puts the one before it in is known before the scan, -1 for none."""
    n = len(text)
    order, back = [-1] * n, ends.tolist()
    for x, c in zip(seeds[::-1].tolist(), text[seeds[::-1]].tolist()):
        back[c] -= 1
        order[back[c]] = x
    moves = np.full(n + 1, -1, np.int32)  # the last entry is for places that are empty
    moves[1:n] = np.where(small[:-1], -1, text[:-1])
    to, front = moves.tolist(), [0, *ends[:-1].tolist()]
    for x in order:  # what is put lies ahead
        c = to[x]
        if c >= 0:
            order[front[c]] = x - 1
            front[c] += 1
    moves[1:n] = np.where(small[:-1], text[:-1], -1)
    to, back = moves.tolist(), ends.tolist()
    for x in reversed(order):
        c = to[x]
        if c >= 0:
            back[c] = at = back[c] - 1
            order[at] = x - 1
    return np.array(order, np.int32)


def suffix_array(letters: np.ndarray, n_letters: int) -> np.ndarray:
    """The suffixes of a sequence of numbers below n_letters in order, without the empty one."""
    n = len(letters)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    induce = _induce if n_letters <= LETTERS else _induce_each
    text = np.append(letters.astype(np.int32) + 1, 0)
    ends = np.cumsum(np.bincount(text, minlength=n_letters + 1)).astype(np.int64)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    seeds = lms[np.argsort(text[lms], kind="stable")]
    if len(lms) > 2:
        is_lms = np.zeros(n + 1, bool)
        is_lms[lms] = True
        order = induce(text, small, ends, seeds)
        ranked = order[is_lms[order]]
        name = _names(text, lms, ranked)
        rank = np.empty(n + 1, np.int32)
        rank[ranked] = name
        if name[-1] + 1 == len(lms):
            seeds = ranked
        else:
            seeds = lms[suffix_array(rank[lms], int(name[-1]) + 1)]
    return induce(text, small, ends, seeds)[1:]


def _names(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """For the sorted LMS substrings the number of smaller distinct ones."""
    after = np.append(lms[1:], lms[-1])
    length = np.empty(len(text), np.int32)
    length[lms] = after - lms + 1
    a, b = ranked[:-1], ranked[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[length[a[live]] > k]
        differs = text[a[live] + k] != text[b[live] + k]
        same[live[differs]] = False
        live, k = live[~differs], k + 1
    return np.append(0, np.cumsum(~same))


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the suffix before it in the order (-1: none), and their longest common prefix.

    Where the letters before both differ, the prefix is compared, eight bytes at a time; elsewhere it is one
    less than that of the position before.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, np.int64)
    if not n:
        return before, prefix
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] <= 0) | (data[:-1] != data[before[1:] - 1])
    at = np.arange(n)
    words = np.ndarray((n,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    live = np.flatnonzero(fresh & (before >= 0))
    while len(live):
        a, b = live + prefix[live], before[live] + prefix[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        equal = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8)
        prefix[live] += np.minimum(equal, n - np.maximum(a, b))
        live = live[equal == 8]
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    return before, np.maximum(0, np.where(before >= 0, prefix[last] - (at - last), 0))
