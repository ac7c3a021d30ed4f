"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

#: Places that carry a common prefix to one another; as many passes go over the text.
CARRY = 64


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first byte highest; zeros follow the end."""
    held = np.zeros(len(raw) + 8, np.uint8)
    held[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(held.view(np.uint8), (len(raw), 8), (1, 1)).copy().view(">u8")[:, 0].astype(np.uint64)


def suffix_order(raw: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Places of raw in the order of their suffixes.

    Suffixes are ranked by eight bytes. Then, with h doubling, only groups of equal rank are sorted
    again, each by the rank of the suffix h further on, until none is left. A rank is the last slot
    before its group, so that what is sorted is one number: the group's and the further one's rank.
    A suffix that ends is less than those that go on: beyond the end, the rank is the less the
    further beyond, so that the zeros which fill the first ranks up decide nothing."""
    n = len(raw)
    first = words8(raw) if words is None else words
    order = np.argsort(first)
    key = first[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    # the last places' words are filled up: they stand with equal ones until they are sorted by their ends
    slots = np.flatnonzero(~(new & np.append(new[1:], True))) if n else np.zeros(0, np.int64)
    while len(slots):
        places = order[slots]
        further = places + h
        inside = further < n
        ahead = np.where(inside, rank[np.minimum(further, n - 1)], n - further - 1) + (n + h + 1)
        key = rank[places].astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64)
        by = np.argsort(key)
        key, places = key[by], places[by]
        order[slots] = places
        changed = np.ones(len(slots), bool)
        changed[1:] = key[1:] != key[:-1]
        rank[places] = np.maximum.accumulate(np.where(changed, slots, 0))
        slots = slots[~(changed & np.append(changed[1:], True))]
        h *= 2
    return order


def common_prefixes(raw: np.ndarray, order: np.ndarray, cap: int, words: np.ndarray | None = None) -> np.ndarray:
    """For each slot of a whole suffix order, the bytes (cap at most) its suffix shares with the slot before.

    Kasai's: where a place shares l bytes with its predecessor in the order, the next place shares
    l - 1 at least with its own. The text is cut into parts of CARRY places; the parts' first places
    are compared from nothing, then all second places from what the first carry over, and so on, eight
    bytes at a time."""
    n = len(raw)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    words = words8(raw) if words is None else words
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    carried = np.zeros(-(-n // CARRY), np.int64)
    for step in range(CARRY):
        place = np.arange(step, n, CARRY)
        left = before[place]
        length = np.maximum(carried[: len(place)] - 1, 0)
        length[left < 0] = 0
        active = np.flatnonzero((left >= 0) & (length < cap))
        while len(active):
            x, y = left[active] + length[active], place[active] + length[active]
            inside = (x < n) & (y < n)
            active, x, y = active[inside], x[inside], y[inside]
            same = equal_bytes(words[x] ^ words[y])
            length[active] += np.minimum(same, n - np.maximum(x, y))
            active = active[(same == 8) & (length[active] < cap)]
        carried[: len(place)] = length
        shared[place] = length
    return np.minimum(shared, cap)[order]


def equal_bytes(differ: np.ndarray) -> np.ndarray:
    """Leading bytes, of eight, in which two words agree, from their exclusive or."""
    same = np.full(len(differ), 8, np.int64)
    odd = np.flatnonzero(differ)
    # float conversion rounds, so the byte is found by halves
    d = differ[odd]
    high = d >> np.uint64(32) != 0
    d32 = np.where(high, d >> np.uint64(32), d & np.uint64(0xFFFFFFFF)).astype(np.float64)
    same[odd] = np.where(high, 3, 7) - np.floor(np.log2(d32)).astype(np.int64) // 8
    return same
