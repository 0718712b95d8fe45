"""K-squared quadtrees over sparse count matrices, and sums over pairs of their rows.

A matrix of a side that is a power of two falls into four quadrants, each of which falls into four again, down to cells. Only
quadrants that hold a nonzero cell have a node, and a node says where its four children are. Trees are built from the
Morton codes of the nonzero cells: the nodes of a level are the distinct codes without their last pairs of bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

#: Pairs of quadrants that are opened at once.
FRONTIER = 1 << 15


class Tree(NamedTuple):
    """children[k]: for each node of level k, its children (row bit * 2 + column bit) in level k + 1, or -1; level 0 is the root.

    Nodes of the last level are cells, whose counts are `values` in the same order.
    """

    children: list[np.ndarray]
    values: np.ndarray


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2^16, a zero between every two."""
    x = x.astype(np.int64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << shift)) & mask
    return x


def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, depth: int) -> Tree:
    """The tree of a matrix of side 2^depth with these nonzero cells, each given once."""
    codes = (_spread(rows) << 1) | _spread(columns)
    order = np.argsort(codes, kind="stable")
    level, children = codes[order], []
    for _ in range(depth):
        above, inverse = np.unique(level >> 2, return_inverse=True)
        links = np.full((len(above), 4), -1, np.int64)
        links[inverse, level & 3] = np.arange(len(level))
        children.append(links)
        level = above
    return Tree(children[::-1], values[order])


def _halves(node: np.ndarray, links: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
    return np.where(node < 0, -1, links[np.maximum(node, 0), quadrant]) if len(links) else np.full(len(node), -1, np.int64)


def pair_sums(first: Tree, second: Tree, depth: int, heights: tuple[int, int], same: bool, price: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sums, zeros): for every row i of `first` and j of `second` the sum of price(i, j, value, value) over columns where
    either is nonzero, and the number of columns where both are zero.

    Both trees are walked together, a quadrant of one beside the quadrant of the other over the same columns. Where both are
    empty the walk ends: all their columns are counted for all their rows at once. `heights`: the rows that count, from the first;
    `same` leaves out pairs with i >= j. The walk goes depth first over bounded parts of the frontier, so that memory doesn't
    grow with the pairs.
    """
    side = 1 << depth
    sums = np.zeros((side, side), np.int64)
    empty = [np.zeros((1 << k, 1 << k), np.int64) for k in range(depth + 1)]
    root = lambda tree: np.array([0 if len(tree.values) else -1], np.int64)
    origin = np.zeros(1, np.int64)
    stack = [(0, root(first), root(second), origin, origin)]
    offsets = np.arange(8)
    r1, r2, c = offsets >> 2, (offsets >> 1) & 1, offsets & 1
    while stack:
        level, a, b, i, j = stack.pop()
        both = (a < 0) & (b < 0)
        if both.any():
            np.add.at(empty[level], (i[both], j[both]), side >> level)
            a, b, i, j = a[~both], b[~both], i[~both], j[~both]
        if not len(a):
            continue
        if level == depth:
            value = lambda tree, node: np.where(node < 0, 0, tree.values[np.maximum(node, 0)]) if len(tree.values) else np.zeros(len(node), np.int64)
            np.add.at(sums, (i, j), price(i, j, value(first, a), value(second, b)))
            continue
        for part in _parts(len(a)):
            at = np.repeat(np.arange(part.start, part.stop), 8)
            turn = lambda bits, n=part.stop - part.start: np.tile(bits, n)
            ni, nj = 2 * i[at] + turn(r1), 2 * j[at] + turn(r2)
            na = _halves(a[at], first.children[level], 2 * turn(r1) + turn(c))
            nb = _halves(b[at], second.children[level], 2 * turn(r2) + turn(c))
            below = depth - level - 1
            kept = (ni << below < heights[0]) & (nj << below < heights[1])
            if same:
                kept &= ni <= nj if below else ni < nj
            stack.append((level + 1, na[kept], nb[kept], ni[kept], nj[kept]))
    zeros = np.zeros((1, 1), np.int64)
    for k, counts in enumerate(empty):
        zeros = (np.repeat(np.repeat(zeros, 2, 0), 2, 1) if k else zeros) + counts
    return sums, zeros


def _parts(n: int) -> Iterator[slice]:
    for begin in range(0, n, FRONTIER):
        yield slice(begin, min(n, begin + FRONTIER))
