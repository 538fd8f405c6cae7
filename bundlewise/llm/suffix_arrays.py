"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of text."""

from __future__ import annotations

import numpy as np

#: Text with fewer symbols per distinct symbol than this is induced symbol by symbol; else whole buckets at a time.
BUCKET_WORTH = 40


def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Suffix types: True where a suffix is smaller than the next one; the last suffix, the least, is True."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the text changes decides for a run
    return step[nearest] > 0


def _leftmost(small: np.ndarray) -> np.ndarray:
    """Places of leftmost-smaller suffixes: smaller ones that follow a larger one."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _induce_buckets(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Induce the whole order from sorted leftmost-smaller suffixes, a bucket at a time.

    All suffixes known in a bucket put the suffixes before them in place at once; those that fall into the same bucket
    (a run of one symbol) make up the next wave.
    """
    n = len(text)
    array = np.full(n, -1, np.int64)
    ends = np.cumsum(counts)
    heads = ends - counts
    present = np.flatnonzero(counts)
    large = ~small

    def spread(found: np.ndarray, want: np.ndarray):
        before = found - 1
        before = before[before >= 0]
        before = before[want[before]]
        key = text[before]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        return before[order], key, first, size

    # larger suffixes, from the least bucket up
    seed_key = text[seeds]
    seed_cut = np.searchsorted(seed_key, present)
    seed_end = np.searchsorted(seed_key, present, "right")
    head = heads.copy()
    for b, a, z in zip(present.tolist(), seed_cut.tolist(), seed_end.tolist()):
        lo = int(heads[b])
        while lo < head[b]:
            hi = int(head[b])
            before, key, first, size = spread(array[lo:hi], large)
            if len(key):
                array[np.repeat(head[key[first]], size) + np.arange(len(key)) - np.repeat(first, size)] = before
                head[key[first]] += size
            lo = hi
        if a < z:
            before, key, first, size = spread(seeds[a:z], large)
            if len(key):
                array[np.repeat(head[key[first]], size) + np.arange(len(key)) - np.repeat(first, size)] = before
                head[key[first]] += size
    # smaller suffixes, from the greatest bucket down; each bucket's end is filled from the right
    tail = ends.copy()
    for b in present[::-1].tolist():
        hi = int(ends[b])
        while hi > tail[b]:
            lo = int(tail[b])
            before, key, first, size = spread(array[lo:hi][::-1], small)
            if len(key):
                array[np.repeat(tail[key[first]], size) - 1 - (np.arange(len(key)) - np.repeat(first, size))] = before
                tail[key[first]] -= size
            hi = lo
        lo, hi = int(heads[b]), int(head[b])
        if lo < hi:
            before, key, first, size = spread(array[lo:hi][::-1], small)
            if len(key):
                array[np.repeat(tail[key[first]], size) - 1 - (np.arange(len(key)) - np.repeat(first, size))] = before
                tail[key[first]] -= size
    array[0] = n - 1  # the sentinel, which nothing induces
    return array


def _induce_symbols(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same, one suffix at a time: cheaper where buckets are tiny."""
    t, s = text.tolist(), small.tolist()
    n = len(t)
    array = [-1] * n
    ends = np.cumsum(counts)
    tail = ends.tolist()
    for p in reversed(seeds.tolist()):
        c = t[p]
        tail[c] -= 1
        array[tail[c]] = p
    head = (ends - counts).tolist()
    for k in range(n):
        p = array[k] - 1
        if p >= 0 and not s[p]:
            c = t[p]
            array[head[c]] = p
            head[c] += 1
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        p = array[k] - 1
        if p >= 0 and s[p]:
            c = t[p]
            tail[c] -= 1
            array[tail[c]] = p
    array[0] = n - 1
    return np.array(array, np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text of small non-negative integers that ends with its only 0."""
    n = len(text)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    counts = np.bincount(text)
    small = _smaller_than_next(text)
    left = _leftmost(small)
    induce = _induce_buckets if n >= BUCKET_WORTH * np.count_nonzero(counts) else _induce_symbols
    # sort leftmost-smaller substrings: induce from them in any order within a bucket
    rough = induce(text, small, left[np.argsort(text[left], kind="stable")], counts)
    mark = np.zeros(n, bool)
    mark[left] = True
    ordered = rough[mark[rough]]
    # name equal substrings alike; a substring reaches up to the next leftmost-smaller place
    last = np.append(left[1:], n - 1)
    where = np.zeros(n, np.int64)
    where[left] = np.arange(len(left))
    which = where[ordered]
    size = last[which] - ordered
    new = np.ones(len(ordered), bool)
    same = np.flatnonzero(size[1:] == size[:-1])
    a, b, length = ordered[same], ordered[same + 1], size[same]
    live = np.arange(len(same))
    k = 0
    while len(live):  # compare neighbours symbol by symbol, all at once
        live = live[text[a[live] + k] == text[b[live] + k]]
        done = length[live] == k
        new[same[live[done]] + 1] = False
        live = live[~done]
        k += 1
    names = np.empty(len(left), np.int64)
    names[which] = np.cumsum(new) - 1
    if new.all():
        sorted_left = ordered
    else:
        sorted_left = left[suffix_array(names)]  # the sentinel's name is the only 0
    return induce(text, small, sorted_left, counts)


def common_prefixes(text: np.ndarray, array: np.ndarray, starts: np.ndarray, sizes: np.ndarray, stop: int) -> np.ndarray:
    """Permuted common prefixes: for each place, symbols its suffix shares with the next smaller one, up to a `stop` symbol.

    The text consists of strings (starts, sizes). From one place to the next a common prefix gets shorter by at most one;
    all strings of the shard take each step together.
    """
    n = len(text)
    before = np.full(n, n - 1, np.int64)
    before[array[1:]] = array[:-1]
    out = np.zeros(n, np.int64)
    live = np.arange(len(starts))
    have = np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max()) if len(sizes) else 0):
        live = live[sizes[live] > t]
        place = starts[live] + t
        other = before[place]
        have[live] = np.maximum(have[live] - 1, 0)
        moving = np.arange(len(live))
        while len(moving):
            k = have[live[moving]]
            x = text[place[moving] + k]
            moving = moving[(x == text[np.minimum(other[moving] + k, n - 1)]) & (x != stop) & (x != 0)]
            have[live[moving]] += 1
        out[place] = have[live]
    return out
