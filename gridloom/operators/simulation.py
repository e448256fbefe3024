"""Monte Carlo simulation of failing edges: windows give the events, a kernel per graph the states between them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REMEMBERED = 100_000


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(2**53))


def arithmetic(*keys: Column | str) -> Column:
    """As :func:`uniform`, by a rule that any SQL engine can follow; of modest quality."""
    factors = (15_485_863, 7_919, 104_729)
    mixed = F.lit(12_345).cast("bigint")
    for key, factor in zip(keys, factors, strict=True):
        mixed = mixed + (F.col(key) if isinstance(key, str) else key).cast("bigint") * F.lit(factor).cast("bigint")
    return (F.pmod(mixed, F.lit(1_000_003)).cast("double") + 0.5) / F.lit(1_000_003.0)


Means = tuple[Column, Column]


def by_cycle(cycle: float) -> Callable[[Column], Means]:
    """Mean times up and down of an edge that fails with p: ``cycle / p`` and ``cycle / (1 - p)``."""
    return lambda p: (F.lit(cycle) / p, F.lit(cycle) / (1 - p))


def by_repair(repair: float) -> Callable[[Column], Means]:
    """Mean times up and down of an edge that fails with p and is repaired in ``repair`` on average."""
    return lambda p: (F.lit(repair) * (1 - p) / p, F.lit(repair) + 0 * p)


def events(edges: DataFrame, horizon: float, cycle: float | Callable[[Column], Means], seed: int = 0, draw: Callable[..., Column] | None = None) -> DataFrame:
    """``graph_id, edge_id, t, up``: alternating exponential times with the means that ``cycle`` gives (a number: see ``by_cycle``).

    The share of time that an edge is down tends to p. Edges start up. Each has as many draws
    as its mean number of changes before the horizon and eight standard deviations more. ``draw`` gives the number in (0, 1)
    of a graph, an edge and a turn.
    """
    draw = draw or (lambda *keys: uniform(*keys, seed=seed))
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-12)), F.lit(1e-12))
    up, down = (by_cycle(cycle) if isinstance(cycle, (int, float)) else cycle)(F.col("p"))
    turns = F.lit(horizon) / (F.col("mean_up") + F.col("mean_down"))
    draws = (2 * F.ceil(turns + 8 * F.sqrt(turns) + 8)).cast("int")
    rows = edges.select("graph_id", "edge_id", p.alias("p")).withColumns({"mean_up": up, "mean_down": down}).withColumn("k", F.explode(F.sequence(F.lit(1), draws)))
    mean = F.when(F.col("k") % 2 == 1, F.col("mean_up")).otherwise(F.col("mean_down"))
    timed = rows.withColumn("dt", -F.log(draw("graph_id", "edge_id", "k")) * mean)
    w = Window.partitionBy("graph_id", "edge_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return timed.select("graph_id", "edge_id", F.sum("dt").over(w).alias("t"), (F.col("k") % 2 == 0).alias("up")).where(F.col("t") < horizon)


def lost_share(weights: dict[int, float], links: list[tuple[int, int]], measure: str) -> float:
    """Of a graph with the edges ``links``: weight cut off from node 0, or share of the pairs without link; without weight or pairs, zero."""
    root = {n: n for n in weights} | {n: n for link in links for n in link}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        if a != b:
            root[b] = a
    if measure == "saidi":
        total = sum(w for n, w in weights.items() if n > 0)
        source = find(0) if 0 in root else None
        return sum(w for n, w in weights.items() if n > 0 and find(n) != source) / total if total else 0.0
    pairs = len(weights) * (len(weights) - 1) / 2
    return 1 - sum(c * (c - 1) / 2 for c in Counter(find(n) for n in weights).values()) / pairs if pairs else 0.0


def simulate(nodes: DataFrame, edges: DataFrame, horizon: float, cycle: float | Callable[[Column], Means], measure: str = "saidi", seed: int = 0, draw: Callable[..., Column] | None = None) -> DataFrame:
    """``graph_id, t0, t1, lost``: the lost share from one event to the next, a single step for a graph without events.

    ``nodes``: ``graph_id, node (0 the source), weight``; ``edges``: ``graph_id, edge_id, u, v, prob``; any number of both.
    ``measure`` is ``saidi`` (weight cut off from the source) or ``pairwise`` (pairs without link).
    One graph is one group. Each event flips its edge's bit of a mask as long as the graph needs;
    connectivity is worked out once for every state that occurs, not for every event, while up to ``REMEMBERED`` states are known.
    """
    if measure not in ("saidi", "pairwise"):
        raise ValueError(measure)
    none = F.lit(None).cast("bigint")
    graph = edges.select(F.col("graph_id").alias("graph_id"), F.col("edge_id").cast("bigint").alias("edge_id"), F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), F.lit(0.0).alias("weight"))
    graph = graph.unionByName(nodes.select("graph_id", none.alias("edge_id"), F.col("node").cast("bigint").alias("u"), none.alias("v"), F.col("weight").cast("double").alias("weight")))

    def run(key: tuple, happened: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        points, links = graph[graph.v.isna()], graph[graph.v.notna()]
        weights = {int(n): float(w) for n, w in zip(points.u, points.weight, strict=True)}
        place = {e: i for i, e in enumerate(sorted(set(links.edge_id)))}
        ends = [(1 << place[e], (int(u), int(v))) for e, u, v in zip(links.edge_id, links.u, links.v, strict=True)]
        happened = happened.sort_values(["t", "edge_id"])
        times, lost, known, down = [0.0, *happened.t], [], {}, 0
        for bit in [0, *(1 << place[e] for e in happened.edge_id)]:
            down ^= bit
            if down not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[down] = lost_share(weights, [link for b, link in ends if not down & b], measure)
            lost.append(known[down])
        return pd.DataFrame({"graph_id": key[0], "t0": times, "t1": [*times[1:], horizon], "lost": lost})

    happened = events(edges, horizon, cycle, seed, draw).select("graph_id", "t", "edge_id")
    kind = edges.schema["graph_id"].dataType.simpleString()
    return happened.groupBy("graph_id").cogroup(graph.groupBy("graph_id")).applyInPandas(run, f"graph_id {kind}, t0 double, t1 double, lost double")


def mean_loss(steps: DataFrame) -> DataFrame:
    return steps.groupBy("graph_id").agg((F.sum(F.col("lost") * (F.col("t1") - F.col("t0"))) / F.sum(F.col("t1") - F.col("t0"))).alias("loss"), F.count("*").alias("changes"))


def cumulative(steps: DataFrame) -> DataFrame:
    """``graph_id, t, value``: the mean of the lost share up to each event; 0 at the start."""
    w = Window.partitionBy("graph_id").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col("lost") * (F.col("t1") - F.col("t0"))).over(w)
    return steps.select("graph_id", F.col("t1").alias("t"), F.when(F.col("t1") > 0, total / F.col("t1")).otherwise(0.0).alias("value"))


def sampled(nodes: DataFrame, edges: DataFrame, p_list: list[float], repair: float, horizon: float, dt: float, seed: int = 0, draw: Callable[..., Column] | None = None) -> DataFrame:
    """``graph_id, p, t, saidi``: the share of the other nodes that is cut off from node 0, every ``dt`` from 0 up to the horizon, for each p.

    All edges fail with p and take ``repair`` to repair on average. All graphs and probabilities are one plan; a graph with
    one p is one group. Each step of the simulation yields the moments that lie in it.
    """
    n = len(p_list)
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(p_list)])).alias("g")
    own = (F.col("graph_id") * n + F.col("g.i")).cast("bigint")
    e = edges.select("graph_id", "edge_id", "u", "v", grid).select(own.alias("graph_id"), "edge_id", "u", "v", F.col("g.p").alias("prob"))
    each = nodes.select("graph_id", "node", grid).select(own.alias("graph_id"), "node", F.lit(1.0).alias("weight"))
    steps = simulate(each, e, horizon, by_repair(repair), "saidi", seed, draw)
    first, after = F.ceil(F.col("t0") / dt), F.ceil(F.col("t1") / dt)
    moments = steps.where(after > first).select("graph_id", "lost", F.explode(F.sequence(first, after - 1)).alias("k"))
    return moments.select(F.floor(F.col("graph_id") / n).alias("graph_id"), F.array(*map(F.lit, map(float, p_list)))[F.pmod("graph_id", F.lit(n)).cast("int")].alias("p"), (F.col("k") * F.lit(dt)).alias("t"), F.col("lost").alias("saidi"))
