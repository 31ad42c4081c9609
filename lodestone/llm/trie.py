"""Walking two binary tries of fingerprints together, within an error budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Node pairs that a step takes together.
FRONTIER = 1 << 17


def close_pairs(a: np.ndarray, b: np.ndarray, bits: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values at most ``bits`` bits apart; a, b sorted and distinct uint64; same: a is b, each pair once."""
    if not len(a) or not len(b):
        return
    todo = [(0, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), bits)))]
    while todo:
        depth, al, ah, bl, bh, left = todo.pop()
        small = (ah - al) * (bh - bl) <= 16
        if small.any():
            s, t = al[small], bl[small]
            n, m = (ah - al)[small], (bh - bl)[small]
            size = n * m
            of = np.repeat(np.arange(len(s)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = s[of] + k // m[of], t[of] + k % m[of]
            near = np.bitwise_count(a[i] ^ b[j]) <= bits
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        big = ~small
        if not big.any():
            continue
        al, ah, bl, bh, left = al[big], ah[big], bl[big], bh[big], left[big]
        bit = np.uint64(1 << (63 - depth))
        above = np.uint64((1 << 64) - (1 << (64 - depth))) if depth else np.uint64(0)
        am = np.searchsorted(a, a[al] & above | bit)
        bm = np.searchsorted(b, b[bl] & above | bit)
        kids = [(al, am, bl, bm, left), (am, ah, bm, bh, left), (al, am, bm, bh, left - 1), (am, ah, bl, bm, left - 1)]
        if same:  # a node with itself: its two children meet once
            own = (al == bl) & (ah == bh)
            kids[3] = tuple(x[~own] for x in kids[3])
        al, ah, bl, bh, left = (np.concatenate(x) for x in zip(*kids))
        alive = (ah > al) & (bh > bl) & (left >= 0)
        parts = [x[alive] for x in (al, ah, bl, bh, left)]
        for i in range(0, len(parts[0]), FRONTIER):
            todo.append((depth + 1, *(x[i : i + FRONTIER] for x in parts)))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i and j: each class is named by its least member."""
    while True:
        x, y = label[i], label[j]
        differ = x != y
        if not differ.any():
            return label
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (deeper := label[label])).any():
            label = deeper
