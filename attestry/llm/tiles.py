"""Exact comparison of 64-bit fingerprints in tiles sorted by population count, on numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    """Union-find over the rows of one group, joined many pairs at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.parent[rows]
        while not np.array_equal(at, up := self.parent[at]):
            at = up
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins pairs; gives the places of pairs that suffice for it, and close no circle."""
        place, used = np.arange(len(a)), []
        while True:
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            if not apart.any():
                return np.concatenate([np.zeros(0, np.int64), *used])
            a, b, place = a[apart], b[apart], place[apart]
            high, first = np.unique(np.maximum(x, y)[apart], return_index=True)  # each root goes below one lesser root
            self.parent[high] = np.minimum(x, y)[apart][first]
            used.append(place[first])


def link(prints: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected at ``radius``: each row and the first of its component.

    Tiles are cut from the order of population counts. A pair of tiles whose counts differ by more
    than the radius has no link; one whose rows are connected already needs none.
    """
    counts = np.bitwise_count(prints)
    order = np.lexsort((prints, counts))
    prints, counts = prints[order], counts[order]
    forest, n = Forest(len(prints)), len(prints)
    for i in range(0, n, tile):
        a = prints[i : i + tile]
        high = int(counts[min(i + tile, n) - 1])
        for j in range(i, n, tile):
            if int(counts[j]) - high > radius:
                break
            b = prints[j : j + tile]
            rows = np.r_[i : i + len(a), j : j + len(b)]
            tops = forest.roots(rows)
            if i != j and (tops == tops[0]).all():
                continue
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            x, y = np.nonzero(near)
            forest.join(x + i, y + j)
    top = forest.roots(np.arange(n))
    moved = np.flatnonzero(top != np.arange(n))
    return prints[moved], prints[top[moved]]


def link_wide(prints: np.ndarray, sizes: np.ndarray, side: np.ndarray, radii: tuple[int, int, int], ratio: float, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of 256-bit fingerprints: a spanning forest of those within the radius.

    Rows of different sides are compared, or all rows where there is one side only. The first 64 and
    128 bits of a pair, at radii of their own, decide whether the others are looked at; the sizes of a
    pair are in the ratio or more.
    """
    first, second, radius = radii
    counts = np.bitwise_count(prints[:, 0])
    order = np.lexsort((counts, side))
    prints, sizes, counts = prints[order], sizes[order], counts[order].astype(int)
    cut, n, found = int(np.searchsorted(side[order], 1)), len(prints), []
    left, right = (range(0, n, tile), None) if cut in (0, n) else (range(0, cut, tile), range(cut, n, tile))
    forest = Forest(n)
    for i in left:
        end = min(i + tile, n if right is None else cut)
        for j in range(i, n, tile) if right is None else right:
            stop = min(j + tile, n)
            if counts[j] - counts[end - 1] > first or counts[i] - counts[stop - 1] > first:
                continue
            x, y = np.nonzero(np.bitwise_count(prints[i:end, None, 0] ^ prints[None, j:stop, 0]) <= first)
            x, y = x + i, y + j
            near = (x != y) & (np.bitwise_count(prints[x, 0] ^ prints[y, 0]) + np.bitwise_count(prints[x, 1] ^ prints[y, 1]) <= second)
            x, y = x[near], y[near]
            apart = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=int)
            near = (apart <= radius) & (np.minimum(sizes[x], sizes[y]) >= ratio * np.maximum(sizes[x], sizes[y]) - 1e-9)
            x, y = x[near], y[near]
            some = forest.join(x, y)
            found.append((x[some], y[some]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate(z) for z in zip(*found))
    return order[x], order[y]


def link_sets(flat: np.ndarray, sizes: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all sets whose Jaccard similarity is reached, as pairs of rows.

    ``flat`` holds the sets end to end. Rows of different sides are compared, or all rows where there is
    one side only. Sets this similar share one of the rarest members of each: these choose what is
    counted. A row that a link has reached is compared once more, with the rows not yet reached.
    """
    n, at = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    members, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    order = np.lexsort((code, often[code], row))
    code = code[order]
    short = sizes - np.ceil(similarity * sizes - 1e-9).astype(int) + 1
    rare = np.flatnonzero(np.arange(len(code)) - at[row] < short[row])
    rare = rare[np.argsort(code[rare], kind="stable")]
    holders, places = row[rare], np.searchsorted(code[rare], np.arange(len(members) + 1))
    apart = len(np.unique(side)) > 1
    left, marked, a, b = np.ones(n, bool), np.zeros(len(members), bool), [], []
    for root in range(n):
        reached = [root] if left[root] else []
        left[root] = False
        while reached:
            x = reached.pop()
            mine = code[at[x] : at[x + 1]]
            maybe = np.zeros(n, bool)
            for c in mine[: short[x]].tolist():
                maybe[holders[places[c] : places[c + 1]]] = True
            maybe &= left & (side != side[x]) if apart else left
            marked[mine] = True
            for y in np.flatnonzero(maybe).tolist():
                both = np.count_nonzero(marked[code[at[y] : at[y + 1]]])
                if both >= similarity * (len(mine) + sizes[y] - both) - 1e-9:
                    a.append(x)
                    b.append(y)
                    left[y] = False
                    reached.append(y)
            marked[mine] = False
    return np.array(a, np.int64), np.array(b, np.int64)
