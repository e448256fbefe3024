"""Exact reliability of one graph by messages on a junction tree.

Nodes are eliminated in min-fill order; the bag of a node is the node, its neighbours at that time and the source,
its parent the bag of the neighbour that goes next. A table gives each partition of a bag's members its
probability. Tables are dense over all set partitions of the bag: joining an edge, or a partition that a message carries, is one
index map over the whole table, so messages are array operations. Upward messages leave
out the bag's own node; downward messages bring back what the rest of the graph links. Each bag then has the whole graph's
partitions of its members, and with them all nodes and all edges come out of one pass in each direction.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable
from functools import cache

import numpy as np

#: Members of a bag for which all set partitions are listed (10: 115,975).
LARGEST_BAG = 10


class Partitions:
    """All set partitions of ``k`` members as rows of labels in order of first appearance."""

    def __init__(self, k: int):
        self.k = k
        rows = np.zeros((1, 0), dtype=np.int8)
        for _ in range(k):
            top = rows.max(axis=1, initial=-1) + 1
            n = top + 1  # an old label or a new one
            at = np.repeat(np.arange(len(rows)), n)
            label = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            rows = np.concatenate([rows[at], label[:, None].astype(np.int8)], axis=1)
        self.rows = rows
        self.codes = self._code(rows)
        self._pairs: dict[tuple[int, int], np.ndarray] = {}
        self._joins: dict[tuple, np.ndarray] = {}

    @staticmethod
    def _code(rows: np.ndarray) -> np.ndarray:
        code = np.zeros(len(rows), dtype=np.int64)
        for c in range(rows.shape[1]):
            code = code * 16 + rows[:, c]
        return code

    def find(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, self._code(rows))

    def pair(self, a: int, b: int) -> np.ndarray:
        """Where each partition goes when members ``a`` and ``b`` are linked."""
        a, b = min(a, b), max(a, b)
        if (a, b) not in self._pairs:
            low, high = np.minimum(self.rows[:, a], self.rows[:, b])[:, None], np.maximum(self.rows[:, a], self.rows[:, b])[:, None]
            merged = np.where(self.rows == high, low, self.rows - ((self.rows > high) & (low != high)))
            self._pairs[a, b] = self.find(merged)
        return self._pairs[a, b]

    def join(self, links: tuple[tuple[int, int], ...]) -> np.ndarray:
        if links not in self._joins:
            to = np.arange(len(self.rows))
            for a, b in links:
                to = self.pair(a, b)[to]
            self._joins[links] = to
        return self._joins[links]

    @property
    def without_first(self) -> tuple[np.ndarray, np.ndarray]:
        """The partition of the members but the first, and whether the first is alone."""
        if not hasattr(self, "_without"):
            rows = self.rows[:, 1:]
            name = np.full((len(rows), self.k), -1, dtype=np.int8)
            out, used, every = np.zeros_like(rows), np.zeros(len(rows), dtype=np.int8), np.arange(len(rows))
            for c in range(self.k - 1):
                new = name[every, rows[:, c]] < 0
                name[every[new], rows[new, c]] = used[new]
                used += new
                out[:, c] = name[every, rows[:, c]]
            self._without = partitions(self.k - 1).find(out), (self.rows == self.rows[:, :1]).sum(axis=1) == 1
        return self._without


@cache
def partitions(k: int) -> Partitions:
    return Partitions(k)


@cache
def links_of(k: int, index: int, places: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    """A partition of ``k`` members as links between the ``places`` that they have in a bag."""
    row, first, links = partitions(k).rows[index], {}, []
    for label, place in zip(row.tolist(), places, strict=True):
        if label in first:
            links.append((first[label], place))
        else:
            first[label] = place
    return tuple(links)


class Values:
    """Probabilities for a vector of failure probabilities."""

    def __init__(self, width: int):
        self.width, self.one = width, np.ones(width)

    def given(self, p) -> np.ndarray:
        return np.broadcast_to(np.asarray(p, dtype=float), (self.width,))

    @staticmethod
    def times(table: np.ndarray, value: np.ndarray) -> np.ndarray:
        return table * value


class Coefficients:
    """Polynomials in p up to the power ``top``."""

    def __init__(self, top: int):
        self.width = top + 1
        self.one = np.eye(1, self.width)[0]

    def given(self, p) -> np.ndarray:
        out = np.zeros(self.width)
        p = np.atleast_1d(np.asarray(p, dtype=float))[: self.width]
        out[: len(p)] = p
        return out

    @staticmethod
    def times(table: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.zeros_like(table)
        for i in np.flatnonzero(value):
            out[..., i:] += table[..., : table.shape[-1] - i] * value[i]
        return out


def min_fill(near: dict[Hashable, set]) -> list[tuple[Hashable, list]]:
    """``(node, neighbours at that time)`` in an order that adds few links; ties by degree, then by node."""
    near = {n: set(x) - {n} for n, x in near.items()}
    place = {n: i for i, n in enumerate(sorted(near))}

    def cost(n):
        links = list(near[n])
        return sum(b not in near[a] for i, a in enumerate(links) for b in links[i + 1 :]), len(links)

    now = {n: cost(n) for n in near}
    heap = [(*now[n], place[n], n) for n in near]
    heapq.heapify(heap)
    out = []
    while heap:
        fill, degree, _, n = heapq.heappop(heap)
        if n not in near or now[n] != (fill, degree):
            continue
        links = sorted(near.pop(n), key=place.get)
        out.append((n, links))
        touched = set(links)
        for a in links:
            near[a] |= set(links) - {a}
            near[a].discard(n)
            touched |= near[a]
        for a in touched:
            if a in near and (fresh := cost(a)) != now[a]:
                now[a] = fresh
                heapq.heappush(heap, (*fresh, place[a], a))
    return out


class Junction:
    """The tree of one graph; ``edges`` are ``(u, v, p)``, parallel edges and loops allowed."""

    def __init__(self, nodes: list, edges: list[tuple], source):
        self.source, self.edges = source, edges
        near: dict = {n: set() for n in nodes if n != source}
        for u, v, _ in edges:
            if u != v and source not in (u, v):
                near[u].add(v)
                near[v].add(u)
        order = min_fill(near)
        rank = {n: i for i, (n, _) in enumerate(order)}
        self.order = [n for n, _ in order]
        self.members = [[n, *sorted(links, key=rank.get), source] for n, links in order]
        self.parent = [rank[m[1]] if len(m) > 2 else -1 for m in self.members]
        self.children: list[list[int]] = [[] for _ in order]
        for i, parent in enumerate(self.parent):
            if parent >= 0:
                self.children[parent].append(i)
        self.place = [{m: k for k, m in enumerate(members)} for members in self.members]
        self.own: list[list[int]] = [[] for _ in order]
        self.home: list[int | None] = []
        for k, (u, v, _) in enumerate(edges):
            bag = None if u == v else min(rank.get(u, len(order)), rank.get(v, len(order)))
            self.home.append(bag)
            if bag is not None:
                self.own[bag].append(k)
        self.largest = max(map(len, self.members), default=1)

    def _edges_into(self, table: np.ndarray, bag: int, algebra, without: int | None = None) -> np.ndarray:
        space, place = partitions(len(self.members[bag])), self.place[bag]
        for k in self.own[bag]:
            if k == without:
                continue
            u, v, p = self.edges[k]
            p = algebra.given(p)
            linked = np.zeros_like(table)
            np.add.at(linked, space.pair(place[u], place[v]), algebra.times(table, algebra.one - p))
            table = linked + algebra.times(table, p)
        return table

    def _message_into(self, table: np.ndarray, bag: int, members: list, message: np.ndarray, algebra) -> np.ndarray:
        """The table joined with a message over ``members``, all of them in the bag."""
        space, places = partitions(len(self.members[bag])), tuple(self.place[bag][m] for m in members)
        out = np.zeros_like(table)
        for index in np.flatnonzero(np.any(message != 0, axis=1)):
            to = space.join(links_of(len(members), int(index), places))
            np.add.at(out, to, algebra.times(table, message[index]))
        return out

    def _start(self, bag: int, algebra) -> np.ndarray:
        space = partitions(len(self.members[bag]))
        table = np.zeros((len(space.rows), algebra.width))
        table[-1] = algebra.one  # the last partition: all members apart
        return table

    def _up(self, algebra, whole: bool = False) -> list[np.ndarray]:
        """Of each bag the message to its parent; with ``whole``, states in which something has been left apart are dropped."""
        out: list = [None] * len(self.order)
        for bag, members in enumerate(self.members):
            table = self._start(bag, algebra)
            for child in self.children[bag]:
                table = self._message_into(table, bag, self.members[child][1:], out[child], algebra)
            table = self._edges_into(table, bag, algebra)
            to, alone = partitions(len(members)).without_first
            if whole:
                table = np.where(alone[:, None], 0.0, table)
            message = np.zeros((len(partitions(len(members) - 1).rows), algebra.width))
            np.add.at(message, to, table)
            out[bag] = message
        return out

    def beliefs(self, algebra) -> list[np.ndarray]:
        """Of each bag the partitions of its members in the whole graph but for the bag's own edges."""
        up = self._up(algebra)
        down: list = [None] * len(self.order)
        out: list = [None] * len(self.order)
        for bag in reversed(range(len(self.order))):
            base = self._start(bag, algebra)
            if down[bag] is not None:
                base = self._message_into(base, bag, self.members[bag][1:], down[bag], algebra)
            children = self.children[bag]
            # what comes before each child, and then those after it
            before = [base]
            for child in children:
                before.append(self._message_into(before[-1], bag, self.members[child][1:], up[child], algebra))
            out[bag] = before[-1]
            after = None  # the children after the current one, as a table of the bag
            for i in reversed(range(len(children))):
                child = children[i]
                rest = before[i] if after is None else self._message_into(before[i], bag, self.members[bag], after, algebra)
                down[child] = self._onto(self._edges_into(rest, bag, algebra), bag, self.members[child][1:], algebra)
                after = self._message_into(self._start(bag, algebra) if after is None else after, bag, self.members[child][1:], up[child], algebra)
        return out

    def _onto(self, table: np.ndarray, bag: int, members: list, algebra) -> np.ndarray:
        """The bag's table for some of its members only."""
        rows = partitions(len(self.members[bag])).rows[:, [self.place[bag][m] for m in members]]
        name = np.full((len(rows), len(self.members[bag])), -1, dtype=np.int8)
        labels, used, every = np.zeros_like(rows), np.zeros(len(rows), dtype=np.int8), np.arange(len(rows))
        for c in range(rows.shape[1]):
            new = name[every, rows[:, c]] < 0
            name[every[new], rows[new, c]] = used[new]
            used += new
            labels[:, c] = name[every, rows[:, c]]
        out = np.zeros((len(partitions(len(members)).rows), algebra.width))
        np.add.at(out, partitions(len(members)).find(labels), table)
        return out

    def cut_off(self, algebra, beliefs: list[np.ndarray] | None = None) -> dict:
        """Probability that each node is cut off from the source."""
        out = {self.source: algebra.one * 0}
        for bag, base in enumerate(beliefs or self.beliefs(algebra)):
            rows = partitions(len(self.members[bag])).rows
            table = self._edges_into(base, bag, algebra)
            out[self.order[bag]] = table[rows[:, 0] != rows[:, -1]].sum(axis=0)
        return out

    def edge_ends(self, algebra, beliefs: list[np.ndarray] | None = None) -> list[tuple]:
        """For each edge, the probabilities that without it the source reaches neither end, only ``u``, only ``v``, both."""
        beliefs = beliefs or self.beliefs(algebra)
        cut_off = None
        out = []
        for k, (u, v, _) in enumerate(self.edges):
            bag = self.home[k]
            if bag is None:  # a loop changes nothing
                cut_off = cut_off or self.cut_off(algebra, beliefs)
                out.append((cut_off[u], algebra.one * 0, algebra.one * 0, algebra.one - cut_off[u]))
                continue
            rows = partitions(len(self.members[bag])).rows
            table = self._edges_into(beliefs[bag], bag, algebra, without=k)
            reached = lambda n: rows[:, self.place[bag][n]] == rows[:, -1]  # noqa: B023, E731
            ru, rv = reached(u), reached(v)
            out.append(tuple(table[at].sum(axis=0) for at in (~ru & ~rv, ru & ~rv, ~ru & rv, ru & rv)))
        return out

    def apart(self, algebra) -> np.ndarray:
        """Probability that not all nodes are linked."""
        up = self._up(algebra, whole=True)
        whole = algebra.one
        for bag, parent in enumerate(self.parent):
            if parent < 0:
                whole = algebra.times(whole, up[bag][0])
        return algebra.one - whole
