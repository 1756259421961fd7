"""Where the nodes of a tree lie, without a table of their pairs.

A tree over L variables is an index of O(L log L) numbers on the driver. Meeting points, branches and
paths of any pair are read from it in constant time, or in the length of the path; tasks get it whole, as
it grows with the variables and never with the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


class TreeIndex:
    """A forest, rooted at the smallest name of each part and numbered in preorder.

    The subtree of a node is the range of numbers from its own to ``last``, exclusive.
    """

    def __init__(self, edges: list[tuple[str, str]], nodes: list[str] = ()):
        near: dict[str, list[str]] = {x: [] for x in nodes}
        for u, v in edges:
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        self.near = {x: sorted(ys) for x, ys in near.items()}
        self.name: list[str] = []
        self.number: dict[str, int] = {}
        parent: list[int] = []
        depth: list[int] = []
        for root in sorted(near):
            todo = [] if root in self.number else [(root, -1)]
            while todo:
                x, up = todo.pop()
                k = self.number[x] = len(self.name)
                self.name.append(x)
                parent.append(up)
                depth.append(depth[up] + 1 if up >= 0 else 0)
                todo += [(y, k) for y in reversed(self.near[x]) if up < 0 or y != self.name[up]]
        self.parent, self.depth = np.array(parent, np.int64), np.array(depth, np.int64)
        n = len(self.name)
        last = np.arange(1, n + 1)
        for k in range(n - 1, -1, -1):
            if parent[k] >= 0:
                last[parent[k]] = max(last[parent[k]], last[k])
        self.last = last
        # Minima of (depth, -number) over ranges of 2^j numbers: the topmost node, the last of equals.
        level = self.depth * max(n, 1) + np.arange(n)[::-1]
        self._least = [level]
        while 2 << len(self._least) - 1 <= n:
            half = 1 << len(self._least) - 1
            below = self._least[-1]
            self._least.append(np.minimum(below[:-half], below[half:]))

    @classmethod
    def of(cls, edges: DataFrame) -> TreeIndex:
        """The index of the tree with the edges (u, v)."""
        rows = edges.select("u", "v").toArrow()
        return cls(list(zip(rows.column("u").to_pylist(), rows.column("v").to_pylist())))

    def __len__(self) -> int:
        return len(self.name)

    def topmost(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The node of the smallest depth, and of these the last, in each range of numbers."""
        size = high - low
        j = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(j).tolist():
            at = j == k
            out[at] = np.minimum(self._least[k][low[at]], self._least[k][high[at] - (1 << k)])
        return len(self.name) - 1 - out % max(len(self.name), 1)

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lowest common ancestor of each pair; -1 for nodes of different parts."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = low.copy()
        odd = low < high
        out[odd] = self.parent[self.topmost(low[odd] + 1, high[odd] + 1)]
        return out

    def branch(self, above: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The child of each ``above`` on the way to ``x``, which lies below it."""
        return self.topmost(above + 1, x + 1)

    def path(self, u: str, v: str) -> list[str]:
        """The nodes from u to v; empty if there is no path."""
        a, b = self.number[u], self.number[v]
        top = int(self.meet(np.array([a]), np.array([b]))[0])
        if top < 0:
            return []
        up, down = [], []
        while a != top:
            up.append(a)
            a = int(self.parent[a])
        while b != top:
            down.append(b)
            b = int(self.parent[b])
        return [self.name[k] for k in (*up, top, *reversed(down))]

    def spanned(self, nodes: list[str]) -> list[tuple[str, str]]:
        """The edges on paths between any two of ``nodes``, each once."""
        marked = sorted({self.number[x] for x in nodes if x in self.number})
        used: set[tuple[str, str]] = set()
        for a, b in zip(marked, marked[1:]):
            way = self.path(self.name[a], self.name[b])
            used.update((min(e), max(e)) for e in zip(way, way[1:]))
        return sorted(used)

    def away_from(self, root: str) -> list[tuple[str, str, int]]:
        """(parent, child, depth): edges pointing away from ``root``, by depth and child."""
        out, level, depth = [], [(None, root)], 0
        while level:
            level = sorted(((x, y) for up, x in level for y in self.near.get(x, ()) if y != up), key=lambda e: e[1])
            depth += 1
            out += [(x, y, depth) for x, y in level]
        return out

    def leaves(self) -> list[str]:
        return [x for x, ys in self.near.items() if len(ys) == 1]

    def centroids(self) -> dict[str, list[str]]:
        """For each node the centres of the pieces it is in, from the whole part down to itself.

        The centre of a piece leaves no more than half of the piece on any side once it is taken out, so
        a node is in log2(L) pieces at most. Two nodes are parted by the last centre they share.
        """
        chain: dict[str, list[str]] = {x: [] for x in self.name}
        gone: set[str] = set()
        todo = [self.name[k] for k in np.flatnonzero(self.parent < 0)]
        while todo:
            start = todo.pop()
            order, up = [start], {start: None}
            for x in order:
                for y in self.near[x]:
                    if y != up[x] and y not in gone:
                        up[y] = x
                        order.append(y)
            size = dict.fromkeys(order, 1)
            for x in reversed(order[1:]):
                size[up[x]] += size[x]
            centre, total = start, len(order)
            while True:
                heavy = [y for y in self.near[centre] if y not in gone and up.get(y) == centre and 2 * size[y] > total]
                if not heavy:
                    break
                centre = heavy[0]
            for x in order:
                chain[x].append(centre)
            gone.add(centre)
            todo += [y for y in self.near[centre] if y not in gone]
        return chain
