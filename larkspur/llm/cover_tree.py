"""Cover tree over vectors of whole numbers, norm-augmented, for inner products within windows.

One more component fills every vector up to the greatest norm M, so vectors lie
on a sphere and a larger inner product with a query is a smaller angle.  A node
has a centre, itself one of its vectors, and the radius that covers all of them.
Its children are a net: centres are taken farthest first until they cover the
node within half its radius (or are FANOUT), so the centres of a level are at
least that radius apart; every vector goes to its nearest centre.

For a query q, a node with centre c, covering radius r and covering angle phi:

    q.c - |q| r <= q.x <= q.c + |q| r                     (vectors as they are)
    |q| M cos(theta + phi) <= q.x <= |q| M cos(theta - phi)  (augmented; theta the angle of q and c)

The narrower bounds count, widened for rounding.  The descent opens the node with
the highest upper bound next and skips nodes outside of all windows that are
still open; scores of leaves are exact.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from larkspur.llm.whole import LONG_MAX, LONG_MIN, products

LEAF, FANOUT = 128, 16  # vectors of a leaf; children of a node
ROWS_AT_ONCE = 1_024  # nodes are opened together up to so many vectors in their leaves
_LINEAR_SLACK, _ANGLE_SLACK = 1e-11, 2e-7  # for rounding, in units of |q| times the lengths compared


class Window(NamedTuple):
    """The best ``k`` scores from ``low`` to ``high`` are wanted."""

    low: int
    high: int


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """The component that fills each row up to length ``norm``."""
    return np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0.0))


def score_bounds(
    q: np.ndarray, centres: np.ndarray, lengths: np.ndarray, radius: np.ndarray, chord: np.ndarray, norm: float
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible product of ``q`` with a vector of each node."""
    own = float(np.sqrt(q @ q))
    middle = centres @ q
    slack = _LINEAR_SLACK * own * (lengths + radius) + 0.5
    low, high = middle - own * radius - slack, middle + own * radius + slack
    reach = own * norm
    if reach > 0:
        theta = np.arccos(np.clip(middle / reach, -1.0, 1.0))
        phi = 2 * np.arcsin(np.minimum(chord / (2 * norm), 1.0))
        slack = _ANGLE_SLACK * reach + 0.5
        high = np.minimum(high, reach * np.cos(np.maximum(theta - phi, 0.0)) + slack)
        low = np.maximum(low, reach * np.cos(np.minimum(theta + phi, np.pi)) - slack)
    # scores beyond a long count as the greatest or least long
    return np.minimum(low, LONG_MAX), np.maximum(high, LONG_MIN)


class CoverTree:
    """Rows of ``x`` with an id and a label number each."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm: float | None = None):
        lengths = np.sqrt((x * x).sum(axis=1))
        self.norm = max(norm or 0.0, float(lengths.max(initial=0.0)))
        fill = augmented(x, self.norm)
        order = np.arange(len(x))
        starts, ends, centre, radius, chord, children = [], [], [], [], [], []

        def add(start: int, end: int, at: int, near: np.ndarray, far: np.ndarray) -> int:
            starts.append(start)
            ends.append(end)
            centre.append(at)
            radius.append(float(near.max(initial=0.0)))
            chord.append(float(far.max(initial=0.0)))
            children.append((0, 0))
            return len(starts) - 1

        def distances(rows: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
            squares = ((x[rows] - x[at]) ** 2).sum(axis=1)
            return np.sqrt(squares), np.sqrt(squares + (fill[rows] - fill[at]) ** 2)

        stack = []
        if len(x):
            near, far = distances(order, 0)
            stack.append((add(0, len(x), 0, near, far), near, far))
        while stack:
            node, near, far = stack.pop()
            start, end = starts[node], ends[node]
            if end - start <= LEAF or chord[node] == 0.0:
                continue
            rows = order[start:end]
            near, far = near.copy(), far.copy()
            centres, owner = [centre[node]], np.zeros(len(rows), np.int64)
            while len(centres) < FANOUT and far.max() > chord[node] / 2:
                at = int(rows[far.argmax()])
                own_near, own_far = distances(rows, at)
                closer = own_far < far
                near[closer], far[closer], owner[closer] = own_near[closer], own_far[closer], len(centres)
                centres.append(at)
            by_owner = np.argsort(owner, kind="stable")
            order[start:end] = rows[by_owner]
            cuts = np.searchsorted(owner[by_owner], np.arange(len(centres) + 1))
            first = len(starts)
            for at, a, b in zip(centres, cuts[:-1].tolist(), cuts[1:].tolist()):
                own = by_owner[a:b]
                stack.append((add(start + a, start + b, at, near[own], far[own]), near[own], far[own]))
            children[node] = (first, len(starts))
        self.x, self.ids, self.labels, self.lengths = x[order], ids[order], labels[order], lengths[order]
        self.starts, self.ends = np.array(starts, np.int64), np.array(ends, np.int64)
        self.centres, self.centre_lengths = x[centre], lengths[centre]
        self.radius, self.chord = np.array(radius), np.array(chord)
        self.first, self.last = np.array(children, np.int64).reshape(-1, 2).T
        edges = self.starts
        if len(x):
            self.least_label = np.array([self.labels[a:b].min() for a, b in zip(edges.tolist(), self.ends.tolist())])
            self.most_label = np.array([self.labels[a:b].max() for a, b in zip(edges.tolist(), self.ends.tolist())])
        self.is_leaf, self.sizes = self.first == self.last, self.ends - self.starts
        self.evaluated = 0

    def best(
        self, q: np.ndarray, query_id: int, label: int, same: bool, windows: list[Window], k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window the ids and scores of its best ``k`` rows, ties by id.

        Only rows of the label (``same``) or of other labels count, and none with
        the id of the query.
        """
        none = np.empty(0, np.int64)
        found = [(none, none) for _window in windows]
        if not len(self.x) or not windows:
            return found
        low = np.array([w.low for w in windows], object)
        high = np.array([w.high for w in windows], object)
        floor = low.astype(np.float64)
        ceiling = high.astype(np.float64)
        open_nodes = np.array([0])
        least, most = self._bounds(q, open_nodes)
        while True:
            useful = self._labelled(open_nodes, label, same)
            useful &= ((most[:, None] >= floor) & (least[:, None] <= ceiling)).any(axis=1)
            open_nodes, least, most = open_nodes[useful], least[useful], most[useful]
            if not len(open_nodes):
                return found
            order = np.argsort(-np.minimum(most, ceiling.max()), kind="stable")
            sizes = np.where(self.is_leaf[open_nodes[order]], self.sizes[open_nodes[order]], LEAF // 4)
            taken = int(np.searchsorted(np.cumsum(sizes), ROWS_AT_ONCE)) + 1
            now, later = open_nodes[order[:taken]], order[taken:]
            open_nodes, least, most = open_nodes[later], least[later], most[later]
            is_leaf = self.is_leaf[now]
            if is_leaf.any():
                rows = _ranges(self.starts[now[is_leaf]], self.ends[now[is_leaf]])
                mine = (self.labels[rows] == label) == same
                rows = rows[mine & (self.ids[rows] != query_id)]
                scores, ids = products(self.x[rows], q, self.lengths[rows]), self.ids[rows]
                self.evaluated += len(rows)
                for j, (own_ids, own_scores) in enumerate(found):
                    edge = own_scores[-1] if len(own_scores) == k else max(windows[j].low, LONG_MIN)
                    inside = np.flatnonzero((scores >= edge) & (scores <= min(windows[j].high, LONG_MAX)))
                    if not len(inside):
                        continue
                    if len(inside) > 4 * k:  # ties at the edge stay
                        own_edge = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                        inside = inside[scores[inside] >= own_edge]
                    all_ids = np.concatenate([own_ids, ids[inside]])
                    all_scores = np.concatenate([own_scores, scores[inside]])
                    order = np.lexsort((all_ids, _down(all_scores)))[:k]
                    found[j] = all_ids[order], all_scores[order]
                    if len(order) == k:  # an equal score may still win by its id
                        floor[j] = max(floor[j], float(all_scores[order[-1]]))
            inner = now[~is_leaf]
            if len(inner):
                fresh = _ranges(self.first[inner], self.last[inner])
                fresh_least, fresh_most = self._bounds(q, fresh)
                open_nodes = np.concatenate([open_nodes, fresh])
                least, most = np.concatenate([least, fresh_least]), np.concatenate([most, fresh_most])

    def _labelled(self, nodes: np.ndarray, label: int, same: bool) -> np.ndarray:
        a, b = self.least_label[nodes], self.most_label[nodes]
        return (a <= label) & (label <= b) if same else ~((a == label) & (b == label))

    def _bounds(self, q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return score_bounds(
            q, self.centres[nodes], self.centre_lengths[nodes], self.radius[nodes], self.chord[nodes], self.norm
        )


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to its end."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)


def _down(scores: np.ndarray) -> np.ndarray:
    """Ascending in the order of descending scores, for every long."""
    return ~scores
