"""Whole networks: from graph cells to their nodes, edges, indexes and summary.

Cells are flattened by :mod:`gridloom.operators.nested`; attaching weights, probabilities and sources, numbering and
summaries are joins and aggregations over all graphs at once. Only exact solvers take a graph as one group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import analysis, nested, reliability
from gridloom.operators.junction import LARGEST_BAG, Junction, Values
from gridloom.session import cut

#: Probability of an edge that states none, and weight of a node that states none.
EDGE_PROB, NODE_WEIGHT = 0.01, 1.0


def graphs_of(networks: DataFrame, edge_prob: float = EDGE_PROB, node_weight: float = NODE_WEIGHT, roots: tuple[str, ...] = ("graph", "optimal_network")) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the top level of all cells, keyed by ``graph_id`` (record and root).

    ``nodes``: ``graph_id, node`` (from 0 in order of label), ``label, weight, is_source, degree``; ``edges``: ``graph_id, edge_id, u, v, prob, length``.
    Sources are the nodes marked as such and those that ``sources`` of the record names; in a graph without any, the first node
    of degree 3 or more, else the first. Ends that the node list lacks are nodes with default attributes; edges without
    one of their ends are left out; a node listed twice counts once, a negative weight as 0.
    """
    key = F.concat_ws("/", F.col("rec_id").cast("string"), "root").alias("graph_id")
    cells = networks.select("rec_id", *roots)
    listed = nested.flatten(cells, "nodes", roots).where("parent is null and node is not null").select(key, F.col("node").alias("label"), "weight", "is_source")
    links = cut(nested.flatten(cells, "edges", roots).where("parent is null and a is not null and b is not null").select(key, F.col("position").cast("bigint").alias("edge_id"), "a", "b", "prob", "length"))
    named = networks.select("rec_id", F.explode(F.array(*map(F.lit, roots))).alias("root"), F.col("sources").cast("array<string>").alias("sources")).select(key, F.explode("sources").alias("label")).where("label is not null")
    ends = links.select("graph_id", F.explode(F.array("a", "b")).alias("label")).groupBy("graph_id", "label").agg(F.count("*").alias("degree"))
    none = F.lit(None)
    rows = listed.select("graph_id", "label", "weight", "is_source", F.lit(0).cast("bigint").alias("degree"), F.lit(True).alias("there"))
    rows = rows.unionByName(ends.select("graph_id", "label", none.cast("double").alias("weight"), none.cast("boolean").alias("is_source"), "degree", F.lit(True).alias("there")))
    rows = rows.unionByName(named.select("graph_id", "label", none.cast("double").alias("weight"), F.lit(True).alias("is_source"), F.lit(0).cast("bigint").alias("degree"), F.lit(False).alias("there")))
    one = rows.groupBy("graph_id", "label").agg(F.max("weight").alias("weight"), F.coalesce(F.bool_or("is_source"), F.lit(False)).alias("marked"), F.max("degree").alias("degree"), F.bool_or("there").alias("there")).where("there")
    graph = Window.partitionBy("graph_id")
    first = F.first("label").over(graph.orderBy(F.col("degree") < 3, "label"))
    nodes = one.select(
        "graph_id", (F.row_number().over(graph.orderBy("label")) - 1).cast("bigint").alias("node"), "label", F.greatest(F.coalesce("weight", F.lit(node_weight)), F.lit(0.0)).alias("weight"),
        F.when(F.bool_or("marked").over(graph), F.col("marked")).otherwise(F.col("label") == first).alias("is_source"), "degree",
    )
    nodes = cut(nodes)
    end = lambda c, name: nodes.select("graph_id", F.col("label").alias(c), F.col("node").alias(name))
    numbered = links.join(end("a", "u"), ["graph_id", "a"]).join(end("b", "v"), ["graph_id", "b"])
    return nodes, numbered.select("graph_id", "edge_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.coalesce(F.when(F.col("prob").between(0, 1), F.col("prob")), F.lit(edge_prob)).alias("prob"), "length")


def validated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges``, with an error for a probability outside 0..1 or an end that is no node of the graph."""
    there = nodes.select("graph_id", F.col("node")).distinct()
    out = edges
    for end in ("u", "v"):
        out = out.join(there.select("graph_id", F.col("node").alias(end), F.lit(True).alias(f"__{end}")), ["graph_id", end], "left")
    fault = F.when(F.col("prob").isNull() | F.isnan("prob") | ~F.col("prob").between(0, 1), F.raise_error(F.concat(F.lit("probability outside 0..1: "), F.coalesce(F.col("prob").cast("string"), F.lit("null")))))
    fault = fault.when(F.col("__u").isNull() | F.col("__v").isNull(), F.raise_error(F.concat(F.lit("unknown end of the edge "), F.col("u").cast("string"), F.lit(" - "), F.col("v").cast("string"))))
    return out.withColumn("prob", F.coalesce(fault.cast("double"), F.col("prob"))).select(edges.columns)


def summary(nodes: DataFrame, edges: DataFrame, p: float = 5e-4) -> DataFrame:
    """``graph_id, n, m, r, rho, chain, length, two_connected, optimal_loss`` of each graph.

    ``r`` is the redundancy m - n + 1, ``rho`` its share of n, ``chain`` the chain length of the best network of that size,
    ``length`` the sum of the stated lengths, ``two_connected`` the share of nodes that lie on a cycle, ``optimal_loss``
    that of the best network if every edge fails with ``p``.
    """
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))
    split = bridges(edges).select("graph_id", "edge_id")
    cyclic = edges.where("u <> v").join(split, ["graph_id", "edge_id"], "left_anti").select("graph_id", F.explode(F.array("u", "v")).alias("node")).distinct().groupBy("graph_id").agg(F.count("*").alias("on_cycles"))
    rows = n.join(m, "graph_id", "left").join(cyclic, "graph_id", "left").select("graph_id", "n", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("length", F.lit(0.0)).alias("length"), (F.coalesce("on_cycles", F.lit(0)) / F.col("n")).alias("two_connected"))
    rows = rows.withColumn("r", F.col("m") - F.col("n") + 1)
    r, size = F.col("r"), F.col("n")
    fits = size - 1 >= F.when(r > 1, 2 * (r - 1)).otherwise(1)
    return rows.select("graph_id", "n", "m", "r", (r / size).alias("rho"), F.when(r > 1, (size - 2 * (r - 1)) / (3 * (r - 1))).otherwise(size).alias("chain"), "length", "two_connected", F.when(fits, analysis.optimal_expression(size, r, p)).alias("optimal_loss"))


def bridges(edges: DataFrame) -> DataFrame:
    """``graph_id, edge_id`` of the edges whose loss splits their graph; loops and parallel edges are none. One graph is one group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = bridges_of(list(zip(pdf.u, pdf.v, strict=True)))
        return pd.DataFrame({"graph_id": key[0], "edge_id": pdf.edge_id.to_numpy()[found]})

    kind = edges.schema["graph_id"].dataType.simpleString()
    return edges.select("graph_id", "edge_id", "u", "v").groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, edge_id bigint")


def bridges_of(pairs: list[tuple]) -> list[int]:
    """Places of the bridges in a list of edges, by depth and low point."""
    near: dict = {}
    for i, (a, b) in enumerate(pairs):
        if a != b:
            near.setdefault(a, []).append((b, i))
            near.setdefault(b, []).append((a, i))
    depth: dict = {}
    low: dict = {}
    found = []
    for root in near:
        if root in depth:
            continue
        depth[root] = low[root] = 0
        stack = [(root, -1, iter(near[root]))]
        while stack:
            x, via, rest = stack[-1]
            for y, i in rest:
                if i == via:
                    continue
                if y in depth:
                    low[x] = min(low[x], depth[y])
                    continue
                depth[y] = low[y] = depth[x] + 1
                stack.append((y, i, iter(near[y])))
                break
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[x])
                    if low[x] == depth[x]:
                        found.append(via)
    return found


def bags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, bag, node, members, parent, edges``: the junction tree of each graph, whose sources count as one node.

    A bag is that of the ``node`` which it eliminates; every edge but loops belongs to one bag, that of its end which goes first.
    """
    tagged = edges.select("graph_id", "edge_id", "u", "v", F.lit(False).alias("is_source")).unionByName(nodes.select("graph_id", F.lit(None).cast("bigint").alias("edge_id"), F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"), "is_source"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points, links = pdf[pdf.v.isna()], pdf[pdf.v.notna()]
        sources = {int(n) for n in points.u[points.is_source]}
        source = min(sources) if sources else None
        name = lambda n: source if n in sources else n
        rows = [(name(int(u)), name(int(v)), 0.0) for u, v in zip(links.u, links.v, strict=True)]
        ids = sorted({name(int(n)) for n in points.u} | {n for u, v, _ in rows for n in (u, v)})
        tree = Junction(ids, rows, source)
        names = links.edge_id.astype("int64").tolist()
        out = [(key[0], k, n, [m for m in tree.members[k] if m is not None], tree.parent[k] if tree.parent[k] >= 0 else None, [names[e] for e in tree.own[k]]) for k, n in enumerate(tree.order)]
        return pd.DataFrame(out, columns=["graph_id", "bag", "node", "members", "parent", "edges"]).astype({"parent": "Int64"})

    kind = edges.schema["graph_id"].dataType.simpleString()
    return tagged.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, bag bigint, node bigint, members array<bigint>, parent bigint, edges array<bigint>")


def edge_components(edges: DataFrame, k: int) -> DataFrame:
    """``graph_id, node, component``: nodes that no loss of fewer than ``k`` edges separates, named by the smallest. One graph is one group.

    For 2, what bridges separate; above, by the tree of smallest cuts (a maximum flow for each node but one).
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf.u.tolist(), pdf.v.tolist(), strict=True))
        ids = sorted({n for p in pairs for n in p})
        if k <= 2:
            gone = set(bridges_of(pairs)) if k == 2 else set()
            links = [p for i, p in enumerate(pairs) if i not in gone]
        else:
            links = [(a, b) for a, b, flow in smallest_cuts(ids, pairs) if flow >= k]
        root = {n: n for n in ids}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return pd.DataFrame({"graph_id": key[0], "node": ids, "component": [find(n) for n in ids]})

    kind = edges.schema["graph_id"].dataType.simpleString()
    return edges.select("graph_id", F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, node bigint, component bigint")


def smallest_cuts(ids: list, pairs: list[tuple]) -> list[tuple]:
    """Edges ``(node, parent, flow)`` of a tree whose least flow on the way between two nodes is the number of edges that separates them."""
    capacity: dict = {n: {} for n in ids}
    for a, b in pairs:
        if a != b:
            capacity[a][b] = capacity[a].get(b, 0) + 1
            capacity[b][a] = capacity[b].get(a, 0) + 1
    parent = {n: ids[0] for n in ids}
    out = []
    for i, s in enumerate(ids[1:], 1):
        t = parent[s]
        room = {n: dict(x) for n, x in capacity.items()}
        flow = 0
        while True:
            seen = {s: None}
            queue = [s]
            for x in queue:
                for y, c in room[x].items():
                    if c > 0 and y not in seen:
                        seen[y] = x
                        queue.append(y)
            if t not in seen:
                break
            y = t
            while seen[y] is not None:
                x = seen[y]
                room[x][y] -= 1
                room[y][x] += 1
                y = x
            flow += 1
        for n in ids[i + 1 :]:
            if n in seen and parent[n] == t:
                parent[n] = s
        out.append((s, t, flow))
    return out


# --- exact indexes by way of the skeleton ------------------------------------------------


def chains_of(nodes: list, edges: list[tuple], source) -> tuple[list, list[tuple]]:
    """``(forks, chains)`` of the part linked to ``source``: a chain is ``(a, inner nodes, b, probabilities)`` between forks.

    Forks are the source and the nodes whose degree is not 2. Loops change nothing and are left out.
    """
    near: dict = {n: [] for n in nodes}
    for k, (u, v, _) in enumerate(edges):
        if u != v:
            near[u].append((v, k))
            near[v].append((u, k))
    reached, open_ones = {source}, [source]
    while open_ones:
        for y, _ in near[open_ones.pop()]:
            if y not in reached:
                reached.add(y)
                open_ones.append(y)
    forks = [n for n in nodes if n in reached and (n == source or len(near[n]) != 2)]
    is_fork, used, chains = set(forks), set(), []
    for a in forks:
        for x, k in near[a]:
            if k in used:
                continue
            used.add(k)
            inner, probs = [], [edges[k][2]]
            while x not in is_fork:
                inner.append(x)
                x, k = next((y, i) for y, i in near[x] if i not in used)
                used.add(k)
                probs.append(edges[k][2])
            chains.append((a, inner, x, probs))
    return forks, chains


def lost_by_skeleton(nodes: list, edges: list[tuple], source, algebra=None) -> dict:
    """Probability that each node is cut off: exact on the skeleton, closed forms along its chains.

    An inner node of a chain is cut off from each end with the product of its edges on that side; which of the ends the
    source reaches without the chain comes from the skeleton.
    """
    algebra = algebra or Values(1)
    one = algebra.one
    if source is None:
        return {n: one for n in nodes}
    forks, chains = chains_of(nodes, edges, source)
    kept = lambda ps: _product(algebra, [one - algebra.given(p) for p in ps])
    links = [(a, b, one - kept(ps)) for a, _, b, ps in chains]
    tree = Junction(forks, links, source)
    if tree.largest > LARGEST_BAG:
        return reliability.lost(nodes, edges, source, algebra)
    beliefs = tree.beliefs(algebra)
    out = {n: one for n in nodes}  # what is not linked to the source is lost
    forked = tree.cut_off(algebra, beliefs)
    out.update({n: forked[n] for n in forks})
    for (_, inner, _, ps), (neither, only_a, only_b, both) in zip(chains, tree.edge_ends(algebra, beliefs), strict=True):
        left = [one]
        for p in ps:
            left.append(algebra.times(left[-1], one - algebra.given(p)))
        right = [one]
        for p in reversed(ps):
            right.append(algebra.times(right[-1], one - algebra.given(p)))
        for i, n in enumerate(inner, 1):
            from_a, from_b = one - left[i], one - right[len(ps) - i]
            out[n] = neither + algebra.times(only_a, from_a) + algebra.times(only_b, from_b) + algebra.times(both, algebra.times(from_a, from_b))
    return out


def _product(algebra, values: list):
    out = algebra.one
    for v in values:
        out = algebra.times(out, v)
    return out


def nodes_rel(nodes: DataFrame, edges: DataFrame, by_skeleton: bool = True) -> DataFrame:
    """``graph_id, node, q``: probability that each node is cut off from the sources of its graph, which count as one."""
    none = F.lit(None)
    tagged = edges.select("graph_id", "u", "v", F.col("prob").alias("p"), F.lit(False).alias("is_source")).unionByName(
        nodes.select("graph_id", F.col("node").alias("u"), none.cast("bigint").alias("v"), none.cast("double").alias("p"), "is_source")
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points, links = pdf[pdf.v.isna()], pdf[pdf.v.notna()]
        sources = {int(n) for n in points.u[points.is_source]}
        source = min(sources) if sources else None
        name = lambda n: source if n in sources else n
        rows = [(name(int(u)), name(int(v)), float(p)) for u, v, p in zip(links.u, links.v, links.p, strict=True)]
        ids = sorted({name(int(n)) for n in points.u} | {n for u, v, _ in rows for n in (u, v)})
        q = lost_by_skeleton(ids, rows, source) if by_skeleton else reliability.lost(ids, rows, source, Values(1))
        everyone = sorted({int(n) for n in points.u})
        return pd.DataFrame({"graph_id": key[0], "node": everyone, "q": [float(q[name(n)][0]) for n in everyone]})

    kind = edges.schema["graph_id"].dataType.simpleString()
    return tagged.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, node bigint, q double")


def saidi(nodes: DataFrame, edges: DataFrame, by_skeleton: bool = True) -> DataFrame:
    """``graph_id, saidi, n``: the weighted mean of the nodes' probabilities, sources without weight; no weight at all gives 0."""
    q = nodes_rel(nodes, edges, by_skeleton).join(nodes.select("graph_id", "node", F.when(F.col("is_source"), 0.0).otherwise(F.col("weight")).alias("w")), ["graph_id", "node"])
    total = F.sum("w")
    return q.groupBy("graph_id").agg(F.when(total > 0, F.sum(F.col("q") * F.col("w")) / total).otherwise(0.0).alias("saidi"), F.count("*").alias("n"))


def improvement(before: DataFrame, after: DataFrame, key: str, *measures: str) -> DataFrame:
    """``key`` and for each measure the share by which ``after`` is smaller; null where there is nothing to compare with."""
    b = before.select(key, *[F.col(m).alias(f"__{m}") for m in measures])
    return after.join(b, key).select(key, *[(1 - F.try_divide(F.col(m), F.col(f"__{m}"))).alias(f"{m}_gain") for m in measures])


def without_middle(edges: DataFrame, middle: DataFrame) -> DataFrame:
    """Edges ``u, v`` after each group of linked ``middle`` nodes (``node``) has become links between all its other neighbours.

    The links of a group are as many as its pairs of neighbours, by the definition of the result.
    """
    from gridloom.operators import graphs

    flagged = edges.select("u", "v")
    for end in ("u", "v"):
        flagged = flagged.join(middle.select(F.col("node").alias(end), F.lit(True).alias(f"m{end}")).distinct(), end, "left")
    flagged = cut(flagged.select("u", "v", F.coalesce("mu", F.lit(False)).alias("mu"), F.coalesce("mv", F.lit(False)).alias("mv")))
    group = graphs.components(flagged.where("mu and mv").select("u", "v"), middle.select("node").distinct())
    crossing = flagged.where("mu <> mv").select(F.when(F.col("mu"), F.col("u")).otherwise(F.col("v")).alias("node"), F.when(F.col("mu"), F.col("v")).otherwise(F.col("u")).alias("other"))
    around = cut(crossing.join(group, "node").select("component", "other").distinct())
    pairs = around.withColumnRenamed("other", "u").join(around.withColumnRenamed("other", "v"), "component").where("u < v").select("u", "v")
    return flagged.where("not mu and not mv").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).unionByName(pairs).distinct()


def sparse(edges: DataFrame, inserted: Column | int, *attributes: str) -> DataFrame:
    """``edge_id, place, u, v``: each edge (``edge_id, u, v``) as a chain with ``inserted`` new nodes.

    A new node is a struct ``edge, place``; ends that were there are ``(null, id)``. With ``ux, uy, vx, vy`` among ``attributes`` the positions of
    both ends come out as ``x0, y0, x1, y1``, interpolated along the edge.
    """
    n = F.lit(inserted) if isinstance(inserted, int) else inserted
    steps = edges.select("edge_id", "u", "v", *attributes, n.alias("__n"), F.explode(F.sequence(F.lit(0), n)).alias("place"))
    old = lambda c: F.struct(F.lit(None).cast("bigint").alias("edge"), F.col(c).cast("bigint").alias("place"))
    new = lambda k: F.struct(F.col("edge_id").cast("bigint").alias("edge"), k.cast("bigint").alias("place"))
    a = F.when(F.col("place") == 0, old("u")).otherwise(new(F.col("place")))
    b = F.when(F.col("place") == F.col("__n"), old("v")).otherwise(new(F.col("place") + 1))
    out = [F.col("edge_id"), "place", a.alias("u"), b.alias("v")]
    if {"ux", "uy", "vx", "vy"} <= set(attributes):
        at = lambda c, k: F.col(f"u{c}") + (F.col(f"v{c}") - F.col(f"u{c}")) * k / (F.col("__n") + 1)
        out += [at(c, F.col("place") + d).alias(f"{c}{d}") for d in (0, 1) for c in ("x", "y")]
    return steps.select(*out)
