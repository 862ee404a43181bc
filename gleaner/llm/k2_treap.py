"""A K2-treap: a sparse grid of rows and columns as a compressed quadtree with maxima.

A node covers a square of side 2**level. It stores which of its four quarters hold cells,
as four bits, and the largest value of its cells; where a quarter's node stands follows
from the number of bits set before it, so no pointers are kept. Quarters are counted by
the bit of the row, then that of the column. Nodes stand level by level, the root first,
cells last.

``best`` finds the columns of largest weighted sums over some rows. Every row has a path
from the root; the paths go down together through the same range of columns, and the sum
of their maxima bounds what any column of the range can reach. Ranges are opened best
bound first, many at a time, until none can hold a better column than those found.
"""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)
#: Ranges opened at a time.
OPENED = 64


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x (below 2**31) with a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class K2Treap:
    """The grid of cells (row, column, value), each at most once, values above 0."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        side = int(max(rows.max(initial=0), columns.max(initial=0))) + 1
        self.height = max(1, (side - 1).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        code, most = code[order], values[order].astype(np.int64)
        masks, maxima = [np.zeros(len(code), dtype=np.uint8)], [most]
        for _ in range(self.height if len(code) else 0):
            parent = code >> np.uint64(2)
            begin = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            bit = (np.uint64(1) << (code & np.uint64(3))).astype(np.uint8)
            masks.append(np.bitwise_or.reduceat(bit, begin))
            most = np.maximum.reduceat(most, begin)
            maxima.append(most)
            code = parent[begin]
        self.mask = np.concatenate(masks[::-1])
        self.most = np.concatenate(maxima[::-1])
        # Children follow level by level in the order of their parents.
        self.child = np.cumsum(_ONES[self.mask]) - _ONES[self.mask] + 1

    def below(self, node: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """The node of a quarter, -1 where it is empty; node -1 is an empty one."""
        mask = np.where(node >= 0, self.mask[node], 0)
        there = (mask >> quarter) & 1
        before = _ONES[mask & ((1 << quarter) - 1)]
        return np.where(there == 1, self.child[node] + before, -1)

    def best(self, rows: np.ndarray, weights: np.ndarray, keys: np.ndarray, k: int, floor: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """(sum, column) of the k columns of largest sum of weights * values over ``rows``, sums above 0.

        ``keys`` are the columns' keys, ascending; of equal sums the smaller key comes
        first. ``floor`` is a (sum, key) that a column must come before.
        """
        if not len(self.mask) or not len(rows):
            return []
        found_sum, found_column = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        node = np.zeros((1, len(rows)), dtype=np.int64)
        level, column = np.array([self.height]), np.array([0])
        bound = np.array([int(self.most[0]) * int(weights.sum())])
        while len(level):
            if len(level) > OPENED:
                # Ties at the border may be opened in any order; nothing is dropped here.
                part = np.argpartition(-bound, OPENED)
                now, later = part[:OPENED], part[OPENED:]
            else:
                now, later = np.arange(len(level)), np.zeros(0, dtype=np.int64)
            down = level[now] - 1
            bit = (rows[None, :] >> down[:, None]) & 1
            nodes, sums, columns = [], [], []
            for half in (0, 1):
                child = self.below(node[now], 2 * bit + half)
                nodes.append(child)
                sums.append((np.where(child >= 0, self.most[child], 0) * weights).sum(axis=1))
                columns.append(column[now] | (half << down))
            new_node, new_sum, new_column = np.concatenate(nodes), np.concatenate(sums), np.concatenate(columns)
            new_level = np.concatenate([down, down])
            held = new_sum > 0
            single = held & (new_level == 0)
            if single.any():
                found_sum = np.concatenate([found_sum, new_sum[single]])
                found_column = np.concatenate([found_column, new_column[single]])
                if len(found_sum) >= k:
                    order = np.lexsort((found_column, -found_sum))[:k]
                    found_sum, found_column = found_sum[order], found_column[order]
                    last = (int(found_sum[-1]), int(keys[found_column[-1]]))
                    if floor is None or (-last[0], last[1]) < (-floor[0], floor[1]):
                        floor = last
            held &= new_level > 0
            node = np.concatenate([node[later], new_node[held]])
            bound = np.concatenate([bound[later], new_sum[held]])
            level = np.concatenate([level[later], new_level[held]])
            column = np.concatenate([column[later], new_column[held]])
            if floor is not None:
                # The first column of a range has the range's smallest key.
                on = (bound > floor[0]) | ((bound == floor[0]) & (keys[np.minimum(column, len(keys) - 1)] < floor[1]))
                node, bound, level, column = node[on], bound[on], level[on], column[on]
        if floor is not None:
            on = (found_sum > floor[0]) | ((found_sum == floor[0]) & (keys[found_column] <= floor[1]))
            found_sum, found_column = found_sum[on], found_column[on]
        order = np.lexsort((found_column, -found_sum))[:k]
        return list(zip(found_sum[order].tolist(), found_column[order].tolist(), strict=True))
