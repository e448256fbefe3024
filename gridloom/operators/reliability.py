"""Exact reliability: state enumeration in expressions, and kernels per graph.

Graphs that are enumerated stay in column expressions. All others take the junction tree of
:mod:`gridloom.operators.junction`, and those of too large bags the frontier below, whose tables
hold only the partitions that occur. Neither has a bound on the edges but time and memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.junction import LARGEST_BAG, Coefficients, Junction, Values

#: Graphs with more edges, or with a position above the last bit that a mask has for nodes, take a kernel.
MAX_ENUMERATED, MAX_POSITION = 16, 62


def states(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """All edge states of small graphs: ``graph, state, prob, reach, groups``.

    ``edges`` have ``u, v`` as positions 0..62 and ``prob``; position 0 is the source. ``reach`` is
    the mask of the nodes linked to the source, ``groups`` the masks of all groups of two and more.
    A larger graph is an error; ``saidi_exact``, ``all_terminal``, ``pairwise`` and ``edges_rel`` take graphs of any size.
    """
    e = edges.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct("edge_id", "u", "v", "prob"))).alias("e"))
    fits = (F.size("e") <= MAX_ENUMERATED) & ~F.exists("e", lambda x: F.greatest(x.u, x.v) > MAX_POSITION)
    e = e.withColumn("e", F.when(fits, F.col("e")).otherwise(F.raise_error(F.lit(f"a graph has more than {MAX_ENUMERATED} edges or a position above {MAX_POSITION}"))))
    s = e.select(graph, "e", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("shiftleft(1L, size(e)) - 1"))).alias("state"))
    prob = F.expr("aggregate(e, struct(1.0D as p, 0 as i), (a, x) -> struct(a.p * if((state & shiftleft(1L, a.i)) != 0, 1 - x.prob, x.prob) as p, a.i + 1 as i), a -> a.p)")
    up = F.expr("transform(filter(e, (x, i) -> (state & shiftleft(1L, i)) != 0), x -> shiftleft(1L, int(x.u)) | shiftleft(1L, int(x.v)))")
    merged = F.expr(
        "aggregate(up, cast(array() as array<bigint>), (acc, m) -> concat(filter(acc, x -> (x & m) = 0L), "
        "array(aggregate(filter(acc, x -> (x & m) != 0L), m, (z, x) -> z | x))))"
    )
    return s.withColumn("prob", prob).withColumn("up", up).withColumn("groups", merged).withColumn("reach", F.expr("coalesce(get(filter(groups, x -> (x & 1L) != 0), 0), 1L) | 1L")).select(graph, "state", "prob", "reach", "groups")


# --- frontier kernel ---------------------------------------------------------------


class Numbers:
    """Values over a vector of failure probabilities."""

    def __init__(self, width: int):
        self.one, self.zero = np.ones(width), np.zeros(width)

    @staticmethod
    def mul(a, b):
        return a * b

    @staticmethod
    def add(a, b):
        return a + b

    def edge(self, p):
        p = np.broadcast_to(np.asarray(p, dtype=float), self.one.shape)
        return 1 - p, p


class Polynomials:
    """Polynomials in p; ``max_fail`` drops the powers above it."""

    def __init__(self, max_fail: int | None = None):
        self.one, self.zero, self.max_fail = np.ones(1), np.zeros(1), max_fail

    def mul(self, a, b):
        c = np.convolve(a, b)
        return c if self.max_fail is None else c[: self.max_fail + 1]

    @staticmethod
    def add(a, b):
        n = max(len(a), len(b))
        return np.pad(a, (0, n - len(a))) + np.pad(b, (0, n - len(b)))

    def edge(self, p):
        p = np.atleast_1d(np.asarray(p, dtype=float))
        return self.add(np.ones(1), -p), p


def min_fill_order(nodes: list, edges: list[tuple]) -> list:
    """Elimination order that adds the fewest links at each step; ties by degree, then by node."""
    near = {n: set() for n in nodes}
    for u, v, _ in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    order = []
    while near:
        def cost(n):
            links = list(near[n])
            missing = sum(b not in near[a] for i, a in enumerate(links) for b in links[i + 1 :])
            return missing, len(links), n

        best = min(near, key=cost)
        links = near.pop(best)
        for a in links:
            near[a] |= links - {a}
            near[a].discard(best)
        order.append(best)
    return order


def _in_order(nodes: list, edges: list[tuple]) -> list[tuple]:
    """Edges in elimination order of their nodes, without loops."""
    place = {n: i for i, n in enumerate(min_fill_order(nodes, edges))}
    return sorted((e for e in edges if e[0] != e[1]), key=lambda e: (min(place[e[0]], place[e[1]]), max(place[e[0]], place[e[1]])))


def _joint(ordered: list[tuple], held: set, algebra) -> dict:
    """Probability of each partition of the nodes ``held``, as the set of its blocks of two and more."""
    last = {}
    for i, (u, v, _) in enumerate(ordered):
        last[u] = last[v] = i
    table = {frozenset(): algebra.one}
    for i, (u, v, p) in enumerate(ordered):
        works, fails = algebra.edge(p)
        following = defaultdict(lambda: algebra.zero)
        gone = {n for n in (u, v) if last[n] == i and n not in held}
        for part, value in table.items():
            joined = frozenset({u, v}).union(*(b for b in part if u in b or v in b))
            linked = frozenset([b for b in part if u not in b and v not in b] + [joined])
            for blocks, q in ((linked, works), (part, fails)):
                cut = frozenset(c for c in (b - gone for b in blocks) if len(c) > 1) if gone else blocks
                following[cut] = algebra.add(following[cut], algebra.mul(value, q))
        table = following
    return table


def disconnection(nodes: list, edges: list[tuple], source, algebra, keep: tuple = ()) -> dict:
    """Probability that each node is cut off from ``source``; for ``keep``, the joint partitions of those nodes.

    Edges are taken in elimination order; the table maps a partition of the frontier to its
    probability. A node leaves the frontier with its last edge. Each target is held in
    the frontier from its first edge on, with a pass over the edges for each target.
    """
    ordered = _in_order(nodes, edges)
    if keep:
        return _joint(ordered, set(keep), algebra)
    linked = {n for u, v, _ in ordered for n in (u, v)}
    result = {}
    for target in nodes:
        if target == source:
            result[target] = algebra.zero
            continue
        cut_off = algebra.one if not {source, target} <= linked else algebra.zero
        if {source, target} <= linked:
            for part, value in _joint(ordered, {source, target}, algebra).items():
                if not any(source in b and target in b for b in part):
                    cut_off = algebra.add(cut_off, value)
        result[target] = cut_off
    return result


def edge_ends(nodes: list, edges: list[tuple], source) -> Iterator[tuple[float, float, float, float]]:
    """For each edge, the probabilities that without it the source reaches neither end, only ``u``, only ``v``, both."""
    for k, (u, v, _) in enumerate(edges):
        out = [0.0] * 4
        for part, value in disconnection(nodes, edges[:k] + edges[k + 1 :], source, Numbers(1), keep=(source, u, v)).items():
            near = next((b for b in part if source in b), {source})
            out[(u in near) + 2 * (v in near)] += float(value[0])
        yield tuple(out)


def whole_graph(nodes: list, edges: list[tuple]) -> tuple[float, float]:
    """Probability that the graph falls apart, and the expected share of pairs without link.

    One pass: the table maps a partition of the frontier, single nodes too, to its probability ``q`` and to the first and second
    moments of the sizes of its blocks. A block that leaves the frontier adds its pairs, and the graph stays
    whole only if that is the last one. Without pairs, both are zero.
    """
    if len(nodes) < 2:
        return 0.0, 0.0
    ordered = _in_order(nodes, edges)
    last = {}
    for i, (u, v, _) in enumerate(ordered):
        last[u] = last[v] = i
    begun, seen = [], set()
    for u, v, _ in ordered:
        begun.append([n for n in (u, v) if n not in seen])
        seen |= {u, v}
    alone = len(nodes) - len(seen)
    # key: blocks, whether a block has been closed; value: q, E[size], E[size * size]
    table = {((), alone > 0): (1.0, np.zeros(0), np.zeros((0, 0)))}
    apart, pairs, begun_so_far = (1.0 if alone else 0.0), 0.0, 0
    for i, (u, v, p) in enumerate(ordered):
        begun_so_far += len(begun[i])
        following: dict = {}
        for (blocks, closed), (q0, s0, t0) in table.items():
            sets, s, t = [set(b) for b in blocks], s0, t0
            for n in begun[i]:
                sets.append({n})
                t = np.block([[t, s[:, None]], [s[None, :], np.full((1, 1), q0)]])
                s = np.append(s, q0)
            iu, iv = (next(k for k, b in enumerate(sets) if n in b) for n in (u, v))
            for works, share in ((True, 1 - p), (False, p)):
                if share == 0.0:
                    continue
                # merge as a linear map of sizes
                to, kept = list(range(len(sets))), [set(b) for b in sets]
                if works and iu != iv:
                    low, high = min(iu, iv), max(iu, iv)
                    kept[low] |= kept.pop(high)
                    to = [low if k == high else k - (k > high) for k in to]
                m = np.zeros((len(kept), len(sets)))
                m[to, range(len(sets))] = 1.0
                q, sz, sq = q0 * share, m @ s * share, m @ t @ m.T * share
                for n in (u, v):
                    if last[n] == i:
                        for b in kept:
                            b.discard(n)
                stay = [k for k, b in enumerate(kept) if b]
                ended = closed
                for k, b in enumerate(kept):
                    if not b:
                        pairs += (sq[k, k] - sz[k]) / 2
                        if not ended and (stay or begun_so_far < len(seen) or sum(not x for x in kept) > 1):
                            apart += q
                        ended = True
                stay.sort(key=lambda k: min(kept[k]))
                at = (tuple(tuple(sorted(kept[k])) for k in stay), ended)
                value = (q, sz[stay], sq[np.ix_(stay, stay)])
                following[at] = tuple(x + y for x, y in zip(following[at], value, strict=True)) if at in following else value
        table = following
    return float(apart), float(1 - pairs / (len(nodes) * (len(nodes) - 1) / 2))


def exact(nodes: DataFrame, edges: DataFrame, p_grid: list[float] | None = None, polynomial: bool = False, max_fail: int | None = None) -> DataFrame:
    """``graph_id, node, q``: probability of being cut off, one entry per value of ``p_grid`` or coefficient.

    ``nodes``: ``graph_id, node, is_source``; ``edges``: ``graph_id, u, v, prob``. Several sources become
    one; nodes without path to a source are cut off surely. Without ``p_grid`` the edges'
    own probabilities hold; with it, or as ``polynomial``, every edge fails with p. One graph is one group.
    """
    tagged = nodes.select("graph_id", F.lit(0).alias("kind"), F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"), F.when(F.col("is_source"), 1.0).otherwise(0.0).alias("prob"))
    tagged = tagged.unionByName(edges.select("graph_id", F.lit(1).alias("kind"), "u", "v", F.col("prob").cast("double")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points, links = pdf[pdf.kind == 0], pdf[pdf.kind == 1]
        sources = set(points.u[points.prob > 0])
        source = min(sources) if sources else None
        name = lambda n: source if n in sources else n
        ids = sorted({name(int(n)) for n in points.u} | {name(int(n)) for n in [*links.u, *links.v]})
        given = (lambda p: [0.0, 1.0]) if polynomial else (lambda p: p_grid) if p_grid else (lambda p: p)
        rows = [(name(int(u)), name(int(v)), given(p)) for u, v, p in zip(links.u, links.v, links.prob, strict=True)]
        top = len(rows) if max_fail is None else min(max_fail, len(rows))
        width = top + 1 if polynomial else len(p_grid) if p_grid else 1
        cut_off = lost(ids, rows, source, Coefficients(top) if polynomial else Values(width))
        everyone = sorted({int(n) for n in points.u} | {int(n) for n in [*links.u, *links.v]})
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "node": everyone, "q": [np.asarray(cut_off[name(n)], dtype=float).tolist() for n in everyone]})

    return tagged.groupBy("graph_id").applyInPandas(run, f"graph_id {edges.schema['graph_id'].dataType.simpleString()}, node bigint, q array<double>")


def lost(nodes: list, edges: list[tuple], source, algebra) -> dict:
    """Probability that each node is cut off from ``source``, by the junction tree or, where a bag is too large, by the frontier."""
    if source is None:
        return {n: algebra.one for n in nodes}
    tree = Junction(nodes, edges, source)
    if tree.largest <= LARGEST_BAG:
        return tree.cut_off(algebra)
    frontier = Polynomials(algebra.width - 1) if isinstance(algebra, Coefficients) else Numbers(algebra.width)
    return {n: algebra.given(q) for n, q in disconnection(nodes, edges, source, frontier).items()}


# --- indexes of graphs of any size: states of small ones, the kernel for the others ---


def _divided(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the graphs that ``states`` takes, and those of all others."""
    n = nodes.groupBy(F.col("graph_id").alias("graph_id")).agg(F.max("node").alias("top"), F.count_if("is_source").alias("sources"), F.count_if(F.col("is_source") & (F.col("node") == 0)).alias("first"))
    e = edges.groupBy(F.col("graph_id").alias("graph_id")).agg(F.count("*").alias("m"), F.max(F.greatest("u", "v")).alias("far"), F.min("prob").alias("least"))
    fits = (F.col("m") <= MAX_ENUMERATED) & (F.greatest("top", "far") <= MAX_POSITION) & (F.col("sources") == 1) & (F.col("first") == 1) & (F.col("least") > 0)
    small = n.join(e, "graph_id").where(fits).select("graph_id")
    return *(df.join(small, "graph_id", "left_semi") for df in (nodes, edges)), *(df.join(small, "graph_id", "left_anti") for df in (nodes, edges))


def _kernel(nodes: DataFrame, edges: DataFrame, columns: str, solve) -> DataFrame:
    """``solve(weights, rows of edge_id, u, v, prob, source)`` gives the rows of a graph; several sources become one."""
    none = F.lit(None).cast("bigint")
    tagged = edges.select(F.col("graph_id").alias("graph_id"), F.col("edge_id").cast("bigint").alias("edge_id"), F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), F.col("prob").cast("double").alias("x"), F.lit(False).alias("is_source"))
    tagged = tagged.unionByName(nodes.select("graph_id", none.alias("edge_id"), F.col("node").cast("bigint").alias("u"), none.alias("v"), F.col("weight").cast("double").alias("x"), "is_source"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points, links = pdf[pdf.v.isna()], pdf[pdf.v.notna()].sort_values("edge_id")
        rows = [(int(e), int(u), int(v), float(p)) for e, u, v, p in zip(links.edge_id, links.u, links.v, links.x, strict=True)]
        sources = {int(n) for n in points.u[points.is_source]}
        out = solve({int(n): float(w) for n, w in zip(points.u, points.x, strict=True)}, rows, sources)
        return pd.DataFrame([(key[0], *row) for row in out], columns=["graph_id", *names])

    return tagged.groupBy("graph_id").applyInPandas(run, f"graph_id {edges.schema['graph_id'].dataType.simpleString()}, {columns}")


def _ids(weights: dict, rows: list[tuple]) -> list:
    return sorted({*weights, *(n for _, u, v, _ in rows for n in (u, v))})


def _solve_saidi(weights: dict, rows: list[tuple], sources: set):
    source = min(sources) if sources else None
    name = lambda n: source if n in sources else n
    merged = [(name(u), name(v), p) for _, u, v, p in rows]
    cut_off = lost(sorted({name(n) for n in _ids(weights, rows)}), merged, source, Values(1))
    known = {n: w for n, w in weights.items() if n not in sources}
    total = sum(known.values())
    yield (sum(w * float(cut_off[n][0]) for n, w in known.items()) / total if total else 0.0,)


def _solve_edges(weights: dict, rows: list[tuple], sources: set):
    source = min(sources) if sources else None
    name = lambda n: source if n in sources else n
    merged = [(name(u), name(v), p) for _, u, v, p in rows]
    ids = sorted({name(n) for n in _ids(weights, rows)})
    if source is None:
        yield from ((e, u, v, 1.0, 0.0, 0.0, 0.0) for e, u, v, _ in rows)
    else:
        tree = Junction(ids, merged, source)
        ends = ([float(x[0]) for x in four] for four in tree.edge_ends(Values(1))) if tree.largest <= LARGEST_BAG else edge_ends(ids, merged, source)
        yield from ((e, u, v, *four) for (e, u, v, _), four in zip(rows, ends, strict=True))


def _solve_whole(weights: dict, rows: list[tuple], sources: set):
    ids, links = _ids(weights, rows), [(u, v, p) for _, u, v, p in rows]
    tree = Junction(ids, links, ids[0]) if len(ids) > 1 else None
    # small bags: one pass with the sizes of the blocks; larger ones: every node in turn as source
    if tree is None or tree.largest <= 4 or tree.largest > LARGEST_BAG:
        yield whole_graph(ids, links)
        return
    one = Values(1)
    loss = sum(float(q[0]) for source in ids for q in Junction(ids, links, source).cut_off(one).values())
    yield float(tree.apart(one)[0]), loss / (len(ids) * (len(ids) - 1))


def saidi_exact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, saidi``: expected share of the weight beside the sources that is cut off from them.

    ``nodes``: ``graph_id, node, weight, is_source``; ``edges``: ``graph_id, edge_id, u, v, prob``.
    """
    n, e, large_n, large_e = _divided(nodes, edges)
    w = n.where("node > 0")
    lost = states(e).join(w, "graph_id").where("(shiftright(reach, int(node)) & 1L) = 0").groupBy("graph_id").agg(F.sum(F.col("prob") * F.col("weight")).alias("lost"))
    small = lost.join(w.groupBy("graph_id").agg(F.sum("weight").alias("w")), "graph_id").select("graph_id", (F.col("lost") / F.col("w")).alias("saidi"))
    return small.unionByName(_kernel(large_n, large_e, "saidi double", _solve_saidi))


def all_terminal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, disconnected``: probability that not all nodes are linked. Input as for ``saidi_exact``."""
    n, e, large_n, large_e = _divided(nodes, edges)
    every = n.groupBy("graph_id").agg(F.expr("bit_or(shiftleft(1L, int(node)))").alias("every"))
    apart = F.when((F.col("reach").bitwiseAND(F.col("every"))) != F.col("every"), F.col("prob")).otherwise(0.0)
    small = states(e).join(every, "graph_id").groupBy("graph_id").agg(F.sum(apart).alias("disconnected"))
    large = _kernel(large_n, large_e, "disconnected double, pairwise_loss double", _solve_whole)
    return small.unionByName(large.select("graph_id", "disconnected"))


def pairwise(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, pairwise_loss``: expected share of the pairs of nodes without link. Input as for ``saidi_exact``."""
    n, e, large_n, large_e = _divided(nodes, edges)
    pairs = n.groupBy("graph_id").agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    linked = F.expr("aggregate(groups, 0D, (a, x) -> a + bit_count(x) * (bit_count(x) - 1) / 2)")
    small = states(e).groupBy("graph_id").agg(F.sum(F.col("prob") * linked).alias("linked")).join(pairs, "graph_id").select("graph_id", (1 - F.col("linked") / F.col("pairs")).alias("pairwise_loss"))
    large = _kernel(large_n, large_e, "disconnected double, pairwise_loss double", _solve_whole)
    return small.unionByName(large.select("graph_id", "pairwise_loss"))


def edges_rel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, edge_id, u, v, neither, only_u, only_v, both_ends``: which ends the source reaches without the edge. Input as for ``saidi_exact``."""
    n, e, large_n, large_e = _divided(nodes, edges)
    k = states(e).withColumnRenamed("prob", "state_prob").join(e.withColumn("place", F.expr("row_number() over (partition by graph_id order by edge_id, u, v, prob) - 1")), "graph_id")
    k = k.where("(shiftright(state, int(place)) & 1L) = 0")
    k = k.select("graph_id", "edge_id", "u", "v", (F.col("state_prob") / F.col("prob")).alias("q"), F.expr("shiftright(reach, int(u)) & 1L").alias("ru"), F.expr("shiftright(reach, int(v)) & 1L").alias("rv"))
    share = lambda ru, rv: F.sum(F.when((F.col("ru") == ru) & (F.col("rv") == rv), F.col("q")).otherwise(0.0))
    small = k.groupBy("graph_id", "edge_id", "u", "v").agg(share(0, 0).alias("neither"), share(1, 0).alias("only_u"), share(0, 1).alias("only_v"), share(1, 1).alias("both_ends"))
    return small.unionByName(_kernel(large_n, large_e, "edge_id bigint, u bigint, v bigint, neither double, only_u double, only_v double, both_ends double", _solve_edges))


KINDS = ("saidi", "all_terminal", "pairwise", "edges_rel", "nodes_rel")


def indexes(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``graph_id, kind, key, value``: the indexes named in ``kinds``, all exact. Input as for ``saidi_exact``.

    ``key`` is null for an index of the whole graph, the node for ``nodes_rel`` and ``edge:ends`` for ``edges_rel``, where
    ``ends`` (``none, u, v, uv``) are those that the source reaches without the edge.
    """
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"unknown indexes: {sorted(unknown)}")
    parts = []
    none = F.lit(None).cast("string")
    for kind, f, column in (("saidi", saidi_exact, "saidi"), ("all_terminal", all_terminal, "disconnected"), ("pairwise", pairwise, "pairwise_loss")):
        if kind in kinds:
            parts.append(f(nodes, edges).select("graph_id", F.lit(kind).alias("kind"), none.alias("key"), F.col(column).alias("value")))
    if "nodes_rel" in kinds:
        parts.append(exact(nodes, edges).select("graph_id", F.lit("nodes_rel").alias("kind"), F.col("node").cast("string").alias("key"), F.col("q")[0].alias("value")))
    if "edges_rel" in kinds:
        ends = F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("value")) for n, c in (("none", "neither"), ("u", "only_u"), ("v", "only_v"), ("uv", "both_ends"))])
        each = edges_rel(nodes, edges).select("graph_id", "edge_id", F.explode(ends).alias("x"))
        parts.append(each.select("graph_id", F.lit("edges_rel").alias("kind"), F.concat_ws(":", F.col("edge_id").cast("string"), "x.n").alias("key"), "x.value"))
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part)
    if out is None:
        raise ValueError("no index is asked for")
    return out
