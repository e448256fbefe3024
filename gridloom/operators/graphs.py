"""Graph primitives as joins and aggregations over edge tables ``(u, v, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut


def canonical(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Undirected edges with ``u <= v``."""
    return edges.withColumn("__u", F.least(u, v)).withColumn(v, F.greatest(u, v)).withColumn(u, F.col("__u")).drop("__u")


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """Each edge as two rows ``node, other``; a loop as two rows of its node."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))))
    return edges.select(*more, ends.alias("e")).select(*more, "e.node", "e.other")


def degrees(edges: DataFrame, *by: str) -> DataFrame:
    return both_ways(edges, *by).groupBy(*by, "node").agg(F.count("*").alias("degree"))


def components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each node is linked to.

    Alternating large and small stars: every round hangs neighbours on the smallest one
    known, so the number of rounds grows with the logarithm of the diameter. Only minima per
    node are aggregated, a hub is no heavier than its rows.
    """
    links = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    n = -1
    for _ in range(max_rounds):
        # large star: larger neighbours are hung on the smallest neighbour
        two = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = two.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = two.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        # small star: smaller neighbours and the node itself are hung on the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = cut(small)
        # both are sets: equal if they have the same size and one lies in the other
        n, before = small.count(), n
        same = n == before and small.join(links, ["a", "b"], "left_anti").isEmpty()
        links = small
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    every = both_ways(edges).select("node").unionByName(nodes.select("node")) if nodes is not None else both_ways(edges).select("node")
    return every.distinct().join(links.withColumnsRenamed({"a": "node", "b": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """``node, depth`` of the nodes that ``sources`` (``node``) reach; nodes beyond ``max_depth`` levels are an error."""
    links = both_ways(edges).distinct()
    reached = cut(sources.select("node").distinct().withColumn("depth", F.lit(0)))
    front = reached
    for depth in range(1, max_depth + 1):
        found = front.join(links, "node").select(F.col("other").alias("node")).distinct().join(reached, "node", "left_anti")
        front = cut(found.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        reached = cut(reached.unionByName(front)) if depth % 8 == 0 else reached.unionByName(front)
    else:
        raise RuntimeError(f"nodes lie beyond {max_depth} levels")
    return reached


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "u"), "u", "left_semi").join(keep.withColumnRenamed("node", "v"), "v", "left_semi")


def contract(edges: DataFrame, nodes: DataFrame, into: Column | int) -> DataFrame:
    """Edges after the rows of ``nodes`` have become one node; loops that arise are dropped."""
    for end in ("u", "v"):
        gone = nodes.select(F.col("node").alias(end), F.lit(True).alias("gone")).distinct()
        edges = edges.join(gone, end, "left").withColumn(end, F.when(F.col("gone"), F.lit(into)).otherwise(F.col(end))).drop("gone")
    return canonical(edges).where("u <> v")


def merge_parallel(edges: DataFrame, prob: str = "prob") -> DataFrame:
    """Parallel edges fail together only: the product of their probabilities."""
    return canonical(edges).groupBy("u", "v").agg(F.product(prob).alias(prob), F.count("*").alias("n_edges"))


def skeleton(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``chain, a, b, n_edges, fail, length``: maximal paths of inner nodes of degree 2 as single edges.

    Inner nodes of one chain are the components of the nodes of degree 2 without sources;
    the ends are their other neighbours. ``chain`` is the smallest inner node, null
    for an edge between two forks. ``fail`` is the probability that some edge fails.
    ``edges`` need ``edge_id, u, v, prob, length``. Cycles without fork or source vanish.
    """
    inner = degrees(edges).where("degree = 2").select("node")
    if sources is not None:
        inner = inner.join(sources.select("node"), "node", "left_anti")
    inner = cut(inner)
    flags = edges
    for end in ("u", "v"):
        flags = flags.join(inner.select(F.col("node").alias(end), F.lit(True).alias(f"in_{end}")), end, "left")
    flags = cut(flags.withColumns({f"in_{e}": F.coalesce(f"in_{e}", F.lit(False)) for e in ("u", "v")}))
    labels = cut(components(flags.where("in_u and in_v"), inner))
    owner = F.when(F.col("in_u"), F.col("u")).when(F.col("in_v"), F.col("v"))
    owned = flags.withColumn("node", owner).join(labels, "node", "left")
    chained = owned.where("component is not null")
    # a chain has two ends, or none where it is a cycle: the least and the greatest of them are all
    ends = F.array_compact(F.array(F.when(~F.col("in_u"), F.col("u")), F.when(~F.col("in_v"), F.col("v"))))
    chains = chained.groupBy(F.col("component").alias("chain")).agg(
        F.min(F.array_min(ends)).alias("a"), F.max(F.array_max(ends)).alias("b"), F.count("*").alias("n_edges"), (1 - F.product(1 - F.col("prob"))).alias("fail"), F.sum("length").alias("length")
    )
    whole = chains.where("a is not null").select("chain", "a", "b", "n_edges", "fail", "length")
    plain = owned.where("component is null").select(F.lit(None).cast("bigint").alias("chain"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.lit(1).cast("bigint").alias("n_edges"), F.col("prob").alias("fail"), "length")
    return whole.unionByName(plain)


def spanning_tree(edges: DataFrame, weight: str = "weight", max_rounds: int = 40) -> DataFrame:
    """Minimum spanning forest by rounds of cheapest links between components; ties go to the smaller ends."""
    rows = cut(edges.where("u <> v").select("u", "v", F.col(weight).alias("weight")))
    label = cut(both_ways(rows).select("node").distinct().withColumn("component", F.col("node")))
    chosen = None
    for _ in range(max_rounds):
        named = rows.join(label.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u").join(label.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v").where("cu <> cv")
        named = cut(named)
        if named.isEmpty():
            break
        side = named.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("weight", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")).alias("e"))
        best = cut(side.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        picked = best.select("u", "v", "weight")
        chosen = picked if chosen is None else cut(chosen.unionByName(picked))
        joined = components(best.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        label = cut(label.join(joined.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left").select("node", F.coalesce("wider", "component").alias("component")))
        rows = named.drop("cu", "cv")
    else:
        raise RuntimeError(f"the forest did not settle in {max_rounds} rounds")
    return chosen if chosen is not None else rows.limit(0)


#: Points of a grid cell above which its probing points are divided over tasks.
DENSE = 50_000


def range_pairs(points: DataFrame, radius: float) -> DataFrame:
    """``a, b, d``: pairs of ``points`` (``id, x, y``) at most ``radius`` apart, by equi-joins on grid cells.

    A cell of more than ``DENSE`` points is divided by its probing points, each part meeting the whole cell; there is at most
    one such cell for every so many points, so their list is small. Points without position give no row.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    placed = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    dense = cut(placed.groupBy("cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("cx", "cy", F.ceil(F.col("n") / DENSE).cast("int").alias("parts")))
    divided = lambda df: df.join(F.broadcast(dense), ["cx", "cy"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    home = divided(placed.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = placed.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cx").alias("c"), F.col("cy").alias("r"), F.explode(offsets).alias("o"))
    around = divided(around.select("b", "bx", "by", (F.col("c") + F.col("o.i")).alias("cx"), (F.col("r") + F.col("o.j")).alias("cy")))
    around = around.select("b", "bx", "by", "cx", "cy", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return home.join(around, ["cx", "cy", "part"]).where("a < b").select("a", "b", d.alias("d")).where(F.col("d") <= radius)


def nearest(left: DataFrame, right: DataFrame, start: float) -> DataFrame:
    """``a, b, d``: for each point of ``left`` the nearest of ``right``, the smaller id in ties.

    Cells of a grid are joined with those around them; points whose nearest found lies beyond
    the cell size, or that found none, go into the next round with larger cells, until a cell covers all points of both
    sides. For such far points the occupied cells of a grid eight times as fine are weighed first: only points of cells
    that can hold the nearest are joined. Points without position give no row, nor does an empty ``right``.
    """
    known = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    right = cut(right.where(known).select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")))
    open_ones = cut(left.where(known).select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")))
    bounds = right.selectExpr("bx as x", "by as y").unionByName(open_ones.selectExpr("ax as x", "ay as y")).selectExpr("max(x) - min(x) as w", "max(y) - min(y) as h").first()
    extent, done, size, first = max(bounds.w or 0.0, bounds.h or 0.0), None, start, True
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    while True:
        at = lambda c, s: F.floor(F.col(c) / F.lit(s)).cast("bigint")
        probes = open_ones.select("a", "ax", "ay", at("ax", size).alias("c"), at("ay", size).alias("r"), F.explode(offsets).alias("o")).select("a", "ax", "ay", (F.col("c") + F.col("o.i")).alias("cx"), (F.col("r") + F.col("o.j")).alias("cy"))
        if first:
            pairs = probes.join(right.withColumns({"cx": at("bx", size), "cy": at("by", size)}), ["cx", "cy"])
        else:
            fine = size / 8
            cells = right.select(at("bx", fine).alias("fx"), at("by", fine).alias("fy")).distinct().withColumns({"cx": F.floor(F.col("fx") / 8), "cy": F.floor(F.col("fy") / 8)})
            low = lambda p, f: F.greatest(F.col(f) * fine - F.col(p), F.col(p) - (F.col(f) + 1) * fine, F.lit(0.0))  # noqa: E731, B023
            high = lambda p, f: F.greatest(F.abs(F.col(f) * fine - F.col(p)), F.abs((F.col(f) + 1) * fine - F.col(p)))  # noqa: E731, B023
            weighed = probes.join(cells, ["cx", "cy"]).withColumns({"low": F.hypot(low("ax", "fx"), low("ay", "fy")), "high": F.hypot(high("ax", "fx"), high("ay", "fy"))})
            reach = weighed.groupBy("a").agg(F.min("high").alias("reach"))
            held = weighed.join(reach, "a").where(F.col("low") <= F.col("reach") * (1 + 1e-9)).select("a", "ax", "ay", "fx", "fy")
            pairs = held.join(right.withColumns({"fx": at("bx", fine), "fy": at("by", fine)}), ["fx", "fy"])
        best = cut(pairs.groupBy("a").agg(F.min(F.struct(d.alias("d"), "b")).alias("m")).select("a", "m.b", "m.d").where(F.col("d") <= size))
        done = best if done is None else done.unionByName(best)
        # beyond this size every point of right lies within a cell and its neighbours
        if size >= 2 * extent:
            return done
        open_ones = cut(open_ones.join(best, "a", "left_anti"))
        if open_ones.isEmpty():
            return done
        size, first = size * (2 if first else 8), False
