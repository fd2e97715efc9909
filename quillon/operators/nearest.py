"""Nearest points: a k-d tree whose points are taken out one by one, and one that answers for many places at once."""

from __future__ import annotations

import numpy as np

LEAF = 16


class Remaining:
    """Points in space; ``nearest`` finds those left that are as near as any, within a margin, and ``remove`` takes one out.

    Nodes split their points at the median of the longest side of their bounds, so the depth is logarithmic. A node without points left
    is never entered, and one whose bounds are farther than what has been found is left out.
    """

    def __init__(self, xyz: np.ndarray):
        self.xyz = xyz
        self.left = np.ones(len(xyz), bool)
        self.leaf_of = np.zeros(len(xyz), np.int64)
        self.low: list[tuple] = []
        self.high: list[tuple] = []
        self.count: list[int] = []
        self.parent: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        self.points: list[np.ndarray | None] = []
        todo = [(np.arange(len(xyz)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            node = len(self.count)
            low, high = xyz[own].min(axis=0), xyz[own].max(axis=0)
            self.low.append(tuple(low.tolist()))
            self.high.append(tuple(high.tolist()))
            self.count.append(len(own))
            self.parent.append(parent)
            self.children.append(None)
            self.points.append(None)
            if parent >= 0:
                first, second = self.children[parent] or (-1, -1)
                self.children[parent] = (node, second) if side == 0 else (first, node)
            axis = int((high - low).argmax())
            if len(own) <= LEAF or not high[axis] > low[axis]:
                self.points[node] = own
                self.leaf_of[own] = node
            else:
                parted = own[np.argpartition(xyz[own, axis], len(own) // 2)]
                todo += [(parted[: len(own) // 2], node, 0), (parted[len(own) // 2 :], node, 1)]

    def _apart(self, node: int, at: tuple) -> float:
        """Squared distance from a place to a node's bounds."""
        out = 0.0
        for low, high, a in zip(self.low[node], self.high[node], at, strict=True):
            d = low - a if a < low else a - high if a > high else 0.0
            out += d * d
        return out

    def nearest(self, at: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances) of the points left whose squared distance is within ``margin`` of the least."""
        place, least, found = tuple(at.tolist()), np.inf, []
        todo = [(0.0, 0)]
        while todo:
            apart, node = todo.pop()
            if apart > least + margin or not self.count[node]:
                continue
            if (pair := self.children[node]) is not None:
                near = sorted(((self._apart(c, place), c) for c in pair), reverse=True)
                todo += near  # the nearer one is on top
                continue
            own = self.points[node][self.left[self.points[node]]]
            d = self.xyz[own] - at
            d2 = d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2
            least = min(least, float(d2.min()))
            found.append((own, d2))
        own, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
        tied = d2 <= least + margin
        return own[tied], d2[tied]

    def remove(self, i: int) -> None:
        self.left[i] = False
        node = int(self.leaf_of[i])
        while node >= 0:
            self.count[node] -= 1
            node = self.parent[node]


class Fixed:
    """Points in space, in the order that decides between equals; ``nearest`` finds the first nearest one of each of many places.

    A level halves every node's points, by place in the order along the longest side of its bounds, so all levels are flat arrays. A place
    goes down to the nearer child first and so learns a bound; then all places go down together, into every node within their bounds.
    """

    def __init__(self, xyz: np.ndarray):
        depth = max(0, int(np.ceil(np.log2(max(len(xyz), 1) / LEAF))))
        own, self.low, self.high = np.arange(len(xyz)), [], []
        for d in range(depth + 1):
            self.starts = np.arange(2**d + 1) * len(xyz) // 2**d
            self.low.append(np.minimum.reduceat(xyz[own], self.starts[:-1]))
            self.high.append(np.maximum.reduceat(xyz[own], self.starts[:-1]))
            if d < depth:
                node = np.repeat(np.arange(2**d), np.diff(self.starts))
                side = (self.high[d] - self.low[d]).argmax(axis=1)[node]
                own = own[np.lexsort((xyz[own, side], node))]
        self.xyz, self.own = xyz[own], own

    def _apart(self, d: int, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of places to bounds, rounded as those to points are, so never more than one to a point inside."""
        gap = np.maximum(np.maximum(self.low[d][node] - at, at - self.high[d][node]), 0.0)
        return gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]

    def _scan(self, q: np.ndarray, leaf: np.ndarray, at: np.ndarray, least: np.ndarray, found: np.ndarray, step: int = 1 << 15) -> None:
        """Hold places against all points of leaves."""
        for s in range(0, len(q), step):
            qs, ls = q[s : s + step], leaf[s : s + step]
            near = self._apart(len(self.low) - 1, ls, at[qs]) <= least[qs]
            qs, ls = qs[near], ls[near]
            i = self.starts[ls][:, None] + np.arange(np.diff(self.starts).max())
            inside = i < self.starts[ls + 1][:, None]
            i = np.where(inside, i, 0)
            d = self.xyz[i] - at[qs][:, None]
            d2 = np.where(inside, d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2], np.inf)
            r = d2.min(axis=1)
            first = np.where(d2 == r[:, None], self.own[i], len(self.own)).min(axis=1)
            order = np.lexsort((first, r, qs))
            order = order[np.concatenate([[True], qs[order][1:] != qs[order][:-1]])] if len(order) else order
            qs, r, first = qs[order], r[order], first[order]
            better = (r < least[qs]) | ((r == least[qs]) & (first < found[qs]))
            least[qs[better]], found[qs[better]] = r[better], first[better]

    def nearest(self, at: np.ndarray, within: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, places in the order); infinity, and the number of points, where none is within the squared distance ``within``."""
        least, found = within.astype(float), np.full(len(at), len(self.own))
        q, depth = np.arange(len(at)), len(self.low) - 1
        node = np.zeros(len(at), np.int64)
        for d in range(1, depth + 1):
            node = 2 * node + (self._apart(d, 2 * node + 1, at) < self._apart(d, 2 * node, at))
        self._scan(q, node, at, least, found)
        todo = [(0, q, np.zeros(len(at), np.int64))]
        while todo:
            d, q, node = todo.pop()
            near = self._apart(d, node, at[q]) <= least[q]
            q, node = q[near], node[near]
            if d == depth:
                self._scan(q, node, at, least, found)
            elif len(q) > most:  # memory is bounded however many nodes a place must enter
                half = len(q) // 2
                todo += [(d, q[half:], node[half:]), (d, q[:half], node[:half])]
            else:
                todo.append((d + 1, np.repeat(q, 2), (2 * node[:, None] + np.arange(2)).ravel()))
        return np.where(found < len(self.own), least, np.inf), found
