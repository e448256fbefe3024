"""Design and improvement of networks: solvers per point set or graph, one group each.

The solvers are sequential by nature and run in Python per group; everything around
them (weights, candidates, summaries) is in :mod:`gridloom.plans.reference`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.networks import bridges_of


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def target_sizes(n: int, k: int, sigma: float = 0.0, seed: int = 0) -> np.ndarray:
    """Sizes of ``k`` clusters of ``n`` points: even, or spread normally around the mean with at least one each."""
    if sigma <= 0:
        return np.array([n // k + (i < n % k) for i in range(k)])
    rng = np.random.default_rng(seed)
    raw = np.maximum(rng.normal(n / k, sigma, k), 1.0)
    sizes = np.maximum(np.floor(raw * n / raw.sum()).astype(int), 1)
    while sizes.sum() != n:
        i = rng.integers(k)
        if sizes.sum() < n:
            sizes[i] += 1
        elif sizes[i] > 1:
            sizes[i] -= 1
    return sizes


def balanced_clusters(points: np.ndarray, sizes: np.ndarray, rounds: int = 7, tolerance: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(label, centers)``: clusters of the given sizes; points with most to lose choose first, then pairs are swapped."""
    rng = np.random.default_rng(seed)
    k = len(sizes)
    centers = points[[rng.integers(len(points))]]
    while len(centers) < k:  # spread first centers out
        d = _distances(points, centers).min(axis=1) ** 2
        centers = np.vstack([centers, points[rng.choice(len(points), p=d / d.sum() if d.sum() > 0 else None)]])
    label = np.zeros(len(points), dtype=int)
    shift = np.inf
    for _ in range(rounds):
        cost = _distances(points, centers) ** 2
        left = sizes.copy()
        two = np.partition(cost, min(1, k - 1), axis=1)
        for i in np.argsort(-(two[:, min(1, k - 1)] - two[:, 0]), kind="stable"):
            open_ones = np.flatnonzero(left > 0)
            label[i] = open_ones[np.argmin(cost[i, open_ones])]
            left[label[i]] -= 1
        for _ in range(3):
            own = cost[np.arange(len(points)), label]
            changed = False
            for i in np.argsort(-(own - cost.min(axis=1)), kind="stable"):
                gain = cost[i, label[i]] + cost[np.arange(len(points)), label] - cost[i, label] - cost[np.arange(len(points)), label[i]]
                j = int(np.argmax(gain))
                if gain[j] > 1e-12:
                    label[i], label[j] = label[j], label[i]
                    changed = True
            if not changed:
                break
        moved = np.array([points[label == c].mean(axis=0) for c in range(k)])
        step = float(np.abs(moved - centers).sum())
        centers = moved
        if abs(shift - step) < tolerance:
            break
        shift = step
    return label, centers


def short_path(points: np.ndarray, start: int, end: int) -> list[int]:
    """Order of all points from ``start`` to ``end`` (a tour when equal): nearest neighbour, then 2-opt."""
    n = len(points)
    d = _distances(points, points)
    left = set(range(n)) - {start, end}
    path = [start]
    while left:
        path.append(min(left, key=lambda j: (d[path[-1], j], j)))
        left.remove(path[-1])
    path.append(end)
    better = True
    while better:
        better = False
        for i, j in itertools.combinations(range(1, len(path) - 1), 2):
            a, b, c, e = path[i - 1], path[i], path[j], path[j + 1]
            if d[a, c] + d[b, e] < d[a, b] + d[c, e] - 1e-12:
                path[i : j + 1] = path[i : j + 1][::-1]
                better = True
    return path


def edge_connectivity_at_least(n: int, pairs: list[tuple[int, int]], k: int) -> bool:
    """Whether the multigraph stays connected after the removal of any ``k - 1`` edges."""

    def linked(rows: list[tuple[int, int]]) -> bool:
        root = list(range(n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in rows:
            root[find(a)] = find(b)
        return len({find(x) for x in range(n)}) <= 1

    return all(linked([p for i, p in enumerate(pairs) if i not in gone]) for gone in itertools.combinations(range(len(pairs)), k - 1))


def structure(forks: np.ndarray, centers: np.ndarray, seed: int = 0, tries: int = 2000) -> list[tuple[int, int, int]]:
    """Trips ``(fork, fork, chain)``: three at each fork, every chain once, 3-edge-connected, of small total way.

    Starts from a prism over the forks in angular order; pairs of trips exchange ends or chains
    while the way gets shorter and the structure stays 3-edge-connected.
    """
    n = len(forks)
    if n == 2:
        return [(0, 1, c) for c in range(3)]
    around = np.argsort(np.arctan2(*(forks - forks.mean(axis=0)).T[::-1]), kind="stable").tolist()
    pairs = [(around[i], around[(i + 1) % n]) for i in range(n)] + [(around[i], around[i + n // 2]) for i in range(n // 2)]
    d = _distances(forks, centers)
    chains, free = [], set(range(len(centers)))
    for a, b in pairs:
        c = min(free, key=lambda x, a=a, b=b: (d[a, x] + d[b, x], x))
        free.remove(c)
        chains.append(c)
    way = lambda p, c: d[p[0], c] + d[p[1], c]
    rng = np.random.default_rng(seed)
    for _ in range(tries):
        i, j = rng.choice(len(pairs), 2, replace=False)
        (a, b), (x, y) = pairs[i], pairs[j]
        now = way(pairs[i], chains[i]) + way(pairs[j], chains[j])
        for p, q in (((a, b), (x, y)), ((a, x), (b, y)), ((a, y), (b, x))):
            for ci, cj in ((chains[i], chains[j]), (chains[j], chains[i])):
                if way(p, ci) + way(q, cj) >= now - 1e-12:
                    continue
                if (p, q) != (pairs[i], pairs[j]):
                    trial = [p if t == i else q if t == j else z for t, z in enumerate(pairs)]
                    same = len({frozenset(t) for t in trial}) == len(trial) and all(u != v for u, v in trial)
                    if not same or not edge_connectivity_at_least(n, trial, 3):
                        continue
                pairs[i], pairs[j], chains[i], chains[j] = p, q, ci, cj
                now = way(p, ci) + way(q, cj)
                p, q = pairs[i], pairs[j]
    return [(a, b, c) for (a, b), c in zip(pairs, chains, strict=True)]


def network(points: np.ndarray, r: int, sigma: float = 0.0, seed: int = 0) -> list[tuple[int, int, int]]:
    """Edges ``(u, v, chain)`` of a network of redundancy ``r``: 2(r-1) forks of degree 3 and 3(r-1) chains; a ring for r = 1."""
    if r < 1:
        raise ValueError("the redundancy must be at least 1")
    if r == 1:
        path = short_path(points, 0, 0) if len(points) > 1 else [0]
        return [(a, b, 0) for a, b in itertools.pairwise(path) if a != b]
    n_forks, n_chains = 2 * (r - 1), 3 * (r - 1)
    if len(points) < n_forks + n_chains:
        raise ValueError(f"redundancy {r} needs at least {n_forks + n_chains} points")
    # forks near the places where three clusters meet: the points with the least way to their three nearest centers
    _, first = balanced_clusters(points, target_sizes(len(points), n_chains, sigma, seed), seed=seed)
    near = np.sort(_distances(points, first), axis=1)[:, : min(3, n_chains)].sum(axis=1)
    spread = _distances(points, points)
    forks: list[int] = [int(np.argmin(near))]
    scale = np.median(near)
    while len(forks) < n_forks:
        score = near - np.minimum(spread[:, forks].min(axis=1), scale)
        score[forks] = np.inf
        forks.append(int(np.argmin(score)))
    rest = np.array([i for i in range(len(points)) if i not in set(forks)])
    label, centers = balanced_clusters(points[rest], target_sizes(len(rest), n_chains, sigma, seed), seed=seed)
    edges = []
    for a, b, c in structure(points[forks], centers, seed):
        inner = rest[label == c]
        ids = [forks[a], *inner.tolist(), forks[b]]
        order = short_path(points[ids], 0, len(ids) - 1)
        edges += [(ids[x], ids[y], c) for x, y in itertools.pairwise(order)]
    return edges


def design(points: DataFrame, r: int, set_column: str = "set_id", sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """``set_id, u, v, chain, length``: a network over the points (``set_id, id, x, y``) of each set."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates("id")
        xy, ids = pdf[["x", "y"]].to_numpy(float), pdf["id"].to_numpy()
        rows = network(xy, r, sigma, seed)
        return pd.DataFrame([(pdf["set_id"].iloc[0], *sorted((ids[a], ids[b])), c, float(np.hypot(*(xy[a] - xy[b])))) for a, b, c in rows], columns=["set_id", "u", "v", "chain", "length"])

    given = points.select(F.col(set_column).cast("bigint").alias("set_id"), "id", F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null")
    return given.groupBy("set_id").applyInPandas(run, "set_id bigint, u bigint, v bigint, chain int, length double")


def risk(length: float) -> float:
    return (length - 1) * length * (length + 1) / 6


def rewire(chains: list[list], pos: dict, budget: float = 0.3, max_changes: int = 300) -> tuple[list[list], int]:
    """Chains (fork, inner nodes, fork) after moves that shorten the network most per risk added.

    A move lets a fork's end of one chain begin further along another chain of that fork, so that
    the nodes in between change chains. It must shorten the network; the sum of added risk stays within ``budget`` of the first risk.
    """
    chains = [list(c) for c in chains]
    total = sum(risk(len(c) - 1) for c in chains) or 1.0
    dist = lambda a, b: float(np.hypot(pos[a][0] - pos[b][0], pos[a][1] - pos[b][1]))
    spent, changes = 0.0, 0
    while changes < max_changes:
        best = None
        for i, j in itertools.permutations(range(len(chains)), 2):
            for first, second in itertools.product((chains[i], chains[i][::-1]), (chains[j], chains[j][::-1])):
                if first[0] != second[0] or len(first) < 3:
                    continue
                # ``first`` leaves the fork and begins at second[k]: the fork's place moves along ``second``
                for k in range(1, len(second) - 1):
                    gain = dist(first[0], first[1]) - dist(second[k], first[1])
                    l1, l2 = len(first) - 1, len(second) - 1
                    added = (risk(l2 - k) - risk(l2) + risk(l1 + k) - risk(l1)) / total
                    if gain > 1e-12:
                        rate = np.inf if added <= 0 else gain / added
                        if best is None or (rate, gain) > best[0]:
                            best = ((rate, gain), i, j, first, second, k, added)
        if best is None or spent + best[6] > budget:
            break
        _, i, j, first, second, k, added = best
        # the third chain of the fork takes up the nodes that the fork passed
        others = [t for t in range(len(chains)) if t not in (i, j) and second[0] in (chains[t][0], chains[t][-1])]
        if not others:
            break
        t = others[0]
        third = chains[t] if chains[t][-1] == second[0] else chains[t][::-1]
        chains[t] = third + second[1 : k + 1]
        chains[i] = [second[k], *first[1:]]
        chains[j] = second[k:]
        spent += added
        changes += 1
    return chains, changes


def add_chords(edges: list[tuple[int, int]], root: int, candidates: list[tuple[float, int, int]], r: int) -> list[tuple[int, int]]:
    """``r`` chords of a tree, one after the other: most subtree size newly covered per length, as long as there is any."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    parent, order = {root: root}, [root]
    for x in order:
        for y in near.get(x, []):
            if y not in parent:
                parent[y] = x
                order.append(y)
    size = dict.fromkeys(order, 1)
    for x in reversed(order[1:]):
        size[parent[x]] += size[x]

    def up(x: int) -> list[int]:
        way = [x]
        while parent[x] != x:
            x = parent[x]
            way.append(x)
        return way

    cycles = []
    for length, a, b in candidates:
        if a in parent and b in parent and a != b and length > 0:
            wa, wb = set(up(a)), set(up(b))
            cycles.append((length, a, b, wa ^ wb))
    covered: set[int] = set()
    chosen = []
    for _ in range(r):
        benefit = [(sum(size[x] for x in way - covered) / length, -a, -b, way) for length, a, b, way in cycles]
        best = max(benefit, key=lambda t: t[:3], default=None)
        if best is None or best[0] <= 0:
            break
        chosen.append((-best[1], -best[2]))
        covered |= best[3]
    return chosen


def improve_trees(points: DataFrame, r: int, quantile: float = 0.3) -> DataFrame:
    """``set_id, u, v, kind``: minimum spanning tree of each set and ``r`` chords closer than the ``quantile`` of all distances."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates("id")
        xy, ids = pdf[["x", "y"]].to_numpy(float), pdf["id"].to_numpy()
        d = _distances(xy, xy)
        inside, tree = {0}, []
        best, frm = d[0].copy(), np.zeros(len(xy), dtype=int)
        while len(inside) < len(xy):
            masked = best.copy()
            masked[list(inside)] = np.inf
            j = int(np.argmin(masked))
            tree.append((int(frm[j]), j))
            inside.add(j)
            closer = d[j] < best
            best[closer], frm[closer] = d[j][closer], j
        limit = np.quantile(d, quantile)
        have = {frozenset(e) for e in tree}
        candidates = [(d[a, b], a, b) for a, b in itertools.combinations(range(len(xy)), 2) if d[a, b] < limit and frozenset((a, b)) not in have]
        rows = [(*sorted((ids[a], ids[b])), "tree") for a, b in tree] + [(*sorted((ids[a], ids[b])), "chord") for a, b in add_chords(tree, 0, candidates, r)]
        return pd.DataFrame([(pdf["set_id"].iloc[0], *x) for x in rows], columns=["set_id", "u", "v", "kind"])

    return points.select(F.col("set_id").cast("bigint").alias("set_id"), "id", "x", "y").where("x is not null and y is not null").groupBy("set_id").applyInPandas(run, "set_id bigint, u bigint, v bigint, kind string")


def spanning_tree(weights: np.ndarray) -> list[tuple[int, int]]:
    """Minimum spanning tree of a full matrix of weights, node by node."""
    n = len(weights)
    inside, tree = np.zeros(n, dtype=bool), []
    if not n:
        return tree
    inside[0] = True
    best, frm = weights[0].copy(), np.zeros(n, dtype=int)
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        tree.append((int(frm[j]), j))
        inside[j] = True
        closer = weights[j] < best
        best[closer], frm[closer] = weights[j][closer], j
    return tree


def close_loops(weights: np.ndarray, r: int, factor: float = 0.5, seed: int = 0) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """A random spanning tree (weights times ``u * factor + 1 - factor``) and ``r`` chords, each the one whose way through the tree has most nodes not yet covered.

    Ties go to the smaller ends, also once everything is covered.
    """
    n = len(weights)
    drawn = np.triu(np.random.default_rng(seed).random((n, n)), 1)
    tree = spanning_tree(weights * ((drawn + drawn.T) * factor + 1 - factor))
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in tree:
        near[a].append(b)
        near[b].append(a)
    have = {frozenset(e) for e in tree}
    # a row of flags for each pair: the nodes on the way between them, found from every start
    ways: dict[tuple[int, int], np.ndarray] = {}
    for start in range(n):
        way, open_ones = {start: np.eye(1, n, start, dtype=bool)[0]}, [start]
        for x in open_ones:
            for y in near[x]:
                if y not in way:
                    way[y] = way[x] | np.eye(1, n, y, dtype=bool)[0]
                    open_ones.append(y)
                    if start < y and frozenset((start, y)) not in have:
                        ways[start, y] = way[y]
    covered, chords = np.zeros(n, dtype=bool), []
    for _ in range(r):
        best = max(ways, key=lambda c: (int((ways[c] & ~covered).sum()), -c[0], -c[1]), default=None)
        if best is None:
            break
        covered |= ways.pop(best)
        chords.append(best)
    return tree, chords


def random_improvement(degree: dict, candidates: list[tuple], r_list: list[int], start: int) -> list[tuple[int, object, object]]:
    """``(r, u, v)``: of the shuffled ``candidates`` those between two nodes of degree 2, one after the other, with the redundancy that each brings, up to the largest of ``r_list``."""
    degree, out, r = dict(degree), [], start
    for u, v in candidates:
        if r >= max(r_list, default=start):
            break
        if u != v and degree.get(u) == 2 and degree.get(v) == 2:
            degree[u] = degree[v] = 3
            r += 1
            out.append((r, u, v))
    return out


def closed_loops(points: DataFrame, r: int, factor: float = 0.5, seed: int = 0) -> DataFrame:
    """``set_id, u, v, kind``: random spanning tree and ``r`` chords of each set of points."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates("id")
        xy, ids = pdf[["x", "y"]].to_numpy(float), pdf["id"].to_numpy()
        tree, chords = close_loops(_distances(xy, xy), r, factor, seed)
        rows = [(key[0], *sorted((ids[a], ids[b])), kind) for kind, part in (("tree", tree), ("chord", chords)) for a, b in part]
        return pd.DataFrame(rows, columns=["set_id", "u", "v", "kind"])

    return points.select(F.col("set_id").cast("bigint").alias("set_id"), "id", "x", "y").where("x is not null and y is not null").groupBy("set_id").applyInPandas(run, "set_id bigint, u bigint, v bigint, kind string")


def randomly_improved(edges: DataFrame, candidates: DataFrame, r_list: list[int]) -> DataFrame:
    """``set_id, r, u, v``: edges that a random choice adds to each set's network until its redundancy is the largest of ``r_list``.

    ``edges``: ``set_id, u, v``; ``candidates``: ``set_id, place, u, v`` in random order. The networks of smaller redundancy are the rows up to it.
    """
    tagged = edges.select("set_id", F.lit(None).cast("bigint").alias("place"), "u", "v").unionByName(candidates.select("set_id", F.col("place").cast("bigint").alias("place"), "u", "v"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        have, tries = pdf[pdf.place.isna()], pdf[pdf.place.notna()].sort_values("place")
        degree = pd.concat([have.u, have.v]).value_counts().to_dict()
        rows = random_improvement(degree, list(zip(tries.u, tries.v, strict=True)), r_list, len(have) - len(degree) + 1)
        return pd.DataFrame([(key[0], *x) for x in rows], columns=["set_id", "r", "u", "v"])

    return tagged.groupBy("set_id").applyInPandas(run, "set_id bigint, r int, u bigint, v bigint")


def rewired(points: DataFrame, network_edges: DataFrame, budget: float = 0.3, max_changes: int = 300) -> DataFrame:
    """``set_id, u, v, chain``: the networks (``set_id, u, v, chain``, as ``design`` makes them) after moves that shorten them within a budget of risk."""
    none = F.lit(None)
    tagged = network_edges.select("set_id", "u", "v", "chain", none.cast("double").alias("x"), none.cast("double").alias("y")).unionByName(
        points.select(F.col("set_id").cast("bigint").alias("set_id"), F.col("id").alias("u"), none.cast("bigint").alias("v"), none.cast("int").alias("chain"), "x", "y")
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, links = pdf[pdf.v.isna()], pdf[pdf.v.notna()]
        pos = {int(i): (x, y) for i, x, y in zip(at.u, at.x, at.y, strict=True)}
        chains = []
        for _, rows in links.groupby("chain"):
            near: dict[int, list[int]] = {}
            for u, v in zip(rows.u.astype(int), rows.v.astype(int), strict=True):
                near.setdefault(u, []).append(v)
                near.setdefault(v, []).append(u)
            ends = [n for n, x in near.items() if len(x) == 1] or [next(iter(near))]
            way = [min(ends)]
            while (following := [n for n in near[way[-1]] if n not in way[-2:-1] and (n not in way)]):
                way.append(min(following))
            if len(ends) == 1:
                way.append(way[0])
            chains.append(way)
        moved, _ = rewire(chains, pos, budget, max_changes)
        rows = [(key[0], *sorted(e), c) for c, way in enumerate(moved) for e in itertools.pairwise(way)]
        return pd.DataFrame(rows, columns=["set_id", "u", "v", "chain"])

    return tagged.groupBy("set_id").applyInPandas(run, "set_id bigint, u bigint, v bigint, chain int")


def bridges(edges: DataFrame) -> DataFrame:
    """``graph_id, u, v`` of the edges whose loss splits their graph; parallel edges are none. One graph is one group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf.u, pdf.v, strict=True))
        found = [pairs[i] for i in bridges_of(pairs)]
        return pd.DataFrame({"graph_id": key[0], "u": [min(p) for p in found], "v": [max(p) for p in found]})

    return edges.select("graph_id", "u", "v").groupBy("graph_id").applyInPandas(run, "graph_id bigint, u bigint, v bigint")
