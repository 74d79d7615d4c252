"""Maximal repeats of a few byte strings around a common anchor, from enhanced suffix arrays.

The suffix array is sparse: of each string only the suffix that starts at its anchor. Sorted, with
the lengths of common prefixes of neighbours, it is scanned with a stack, which gives the tree of
common-prefix intervals: sets of suffixes that share a prefix no larger set shares. For the members
of each interval the texts before the anchor, read backwards, are scanned the same way; an interval
of theirs is a set that shares so much on the left that any further byte differs. Where it also spans
two children of the right interval, the set is a repeat that can be extended on neither side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _array(strings: list[bytes]) -> tuple[list[int], list[int]]:
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return order, [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def array(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of strings, and at each place the common prefix with the one before it."""
    order, shared = _array(strings)
    return np.array(order), np.array(shared)


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of two places or more, innermost first."""
    stack = [(0, 0)]
    for i in range(1, len(shared) + 1):
        now, first = (shared[i] if i < len(shared) else -1), i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, all members) of repeats of ``least`` bytes or more.

    ``lefts`` are read backwards from the anchor, ``rights`` forwards from it. Strings that are equal
    on both sides are members of one repeat like any others. An interval inside another shares a longer
    prefix, so no string is in more intervals than it has bytes.
    """
    order, right_shared = _array(rights)
    left_order, left_shared = _array(lefts)
    left_rank, right_rank = [0] * len(lefts), [0] * len(rights)
    for k, (x, y) in enumerate(zip(left_order, order)):
        left_rank[x], right_rank[y] = k, k
    most_left = max(map(len, lefts))
    for right, first, last in intervals(right_shared):
        if last == first or right + most_left < least:
            continue
        ranks = sorted(left_rank[k] for k in order[first : last + 1])
        between = [min(left_shared[a + 1 : b + 1]) for a, b in zip(ranks, ranks[1:])]
        if max(between) + right < least:
            continue
        for left, a, b in intervals([0, *between]):
            if b == a or left + right < least:
                continue
            members = [left_order[k] for k in ranks[a : b + 1]]
            places = [right_rank[k] for k in members]
            if min(right_shared[min(places) + 1 : max(places) + 1]) == right:  # else a child interval has them all
                yield left, right, members
