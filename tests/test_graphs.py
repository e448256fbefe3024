import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import analysis, design, graphs, junction, reliability, simulation
from gridloom.sources import synthetic

EDGES = "u bigint, v bigint"


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_bfs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(25)]
    nodes = sorted({n for p in pairs for n in p} | {500})
    df = spark.createDataFrame(pairs, EDGES)
    want = groups(pairs, nodes)
    got = {r.node: r.component for r in graphs.components(df, spark.createDataFrame([(n,) for n in nodes], "node bigint")).collect()}
    assert got == want
    depth = {100: 0}
    for k in range(25):
        depth[101 + k] = k + 1
    assert {r.node: r.depth for r in graphs.bfs(df, spark.createDataFrame([(100,)], "node bigint")).collect()} == depth


def test_spanning_tree(spark):
    rng = random.Random(3)
    rows = [(a, b, round(rng.random(), 1)) for a, b in itertools.combinations(range(14), 2)]
    got = graphs.spanning_tree(spark.createDataFrame(rows, "u bigint, v bigint, weight double")).collect()
    root, total = {n: n for n in range(14)}, 0.0
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b, w in sorted(rows, key=lambda r: r[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    assert len(got) == 13 and sum(r.weight for r in got) == pytest.approx(total)


def test_skeleton_of_a_theta_graph(spark):
    # forks 0 and 1, chains 0-2-3-1 and 0-4-1, the edge 0-1, and a tail 1-5-6
    rows = [(0, 0, 2), (1, 2, 3), (2, 3, 1), (3, 0, 4), (4, 4, 1), (5, 0, 1), (6, 1, 5), (7, 5, 6)]
    df = spark.createDataFrame([(i, u, v, 0.1, 1.0) for i, u, v in rows], "edge_id bigint, u bigint, v bigint, prob double, length double")
    got = {(r.a, r.b, r.n_edges): (r.chain, round(r.fail, 9), r.length) for r in graphs.skeleton(df).collect()}
    assert got == {(0, 1, 3): (2, round(1 - 0.9**3, 9), 3.0), (0, 1, 2): (4, round(1 - 0.9**2, 9), 2.0), (0, 1, 1): (None, 0.1, 1.0), (1, 6, 2): (5, round(1 - 0.9**2, 9), 2.0)}


def test_nearest_and_range(spark):
    rng = random.Random(5)
    a = [(i, rng.random(), rng.random()) for i in range(60)]
    b = [(i, rng.random() * 3 - 1, rng.random() * 3 - 1) for i in range(20)]
    da, db = (spark.createDataFrame(x, "id bigint, x double, y double") for x in (a, b))
    d = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    got = {r.a: r.b for r in graphs.nearest(da, db, 0.05).collect()}
    assert got == {p[0]: min(b, key=lambda q: (d(p, q), q[0]))[0] for p in a}
    assert {(r.a, r.b) for r in graphs.range_pairs(da, 0.2).collect()} == {(p[0], q[0]) for p in a for q in a if p[0] < q[0] and d(p, q) <= 0.2}


def brute(nodes, edges, source):
    lost = dict.fromkeys(nodes, 0.0)
    for state in itertools.product([0, 1], repeat=len(edges)):
        p = 1.0
        for s, (_, _, q) in zip(state, edges, strict=True):
            p *= 1 - q if s else q
        root = groups([(a, b) for s, (a, b, _) in zip(state, edges, strict=True) if s], nodes)
        for n in nodes:
            if root[n] != root[source]:
                lost[n] += p
    return lost


@pytest.mark.parametrize("seed", range(6))
def test_exact_against_all_states(seed):
    rng = random.Random(seed)
    nodes = list(range(5))
    edges = [(rng.randrange(5), rng.randrange(5), rng.choice([0.0, 0.1, 0.35, 1.0])) for _ in range(8)]
    want = brute(nodes, edges, 0)
    got = reliability.disconnection(nodes, [(a, b, p) for a, b, p in edges], 0, reliability.Numbers(1))
    assert all(got[n][0] == pytest.approx(want[n], abs=1e-12) for n in nodes)
    poly = reliability.disconnection(nodes, [(a, b, [0.0, 1.0]) for a, b, _ in edges], 0, reliability.Polynomials())
    at = brute(nodes, [(a, b, 0.2) for a, b, _ in edges], 0)
    for n in nodes:
        assert sum(c * 0.2**k for k, c in enumerate(poly[n])) == pytest.approx(at[n], abs=1e-12)


def test_several_sources_and_unreached_nodes(spark):
    nodes = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (1, 3, False)], "graph_id bigint, node bigint, is_source boolean")
    edges = spark.createDataFrame([(1, 0, 1, 0.1), (1, 1, 2, 0.2)], "graph_id bigint, u bigint, v bigint, prob double")
    got = {r.node: r.q[0] for r in reliability.exact(nodes, edges).collect()}
    assert got[0] == got[2] == 0.0 and got[1] == pytest.approx(0.02) and got[3] == 1.0


def test_simulation_tends_to_the_exact_value(spark, small):
    from gridloom.plans import reference

    nodes, edges = reference.region_edges(spark, small)
    exact = {r.graph_id: r.saidi for r in reference.k5_state_enum_saidi(spark, small).collect()}
    chain = edges.where("v = u + 1")  # a path: losses are large enough to compare
    q = {r.graph_id: r.s for r in reliability.exact(nodes, chain).join(nodes, ["graph_id", "node"]).where("node > 0").groupBy("graph_id").agg((F.sum(F.col("q")[0] * F.col("weight")) / F.sum("weight")).alias("s")).collect()}
    steps = simulation.simulate(nodes.select("graph_id", "node", "weight"), chain, 4000.0, 0.5)
    for r in simulation.mean_loss(steps).collect():
        assert r.loss == pytest.approx(q[r.graph_id], rel=0.1) and exact[r.graph_id] < r.loss
    c = simulation.cumulative(steps).groupBy("graph_id").agg(F.max_by("value", "t").alias("v")).collect()
    assert all(r.v == pytest.approx(q[r.graph_id], rel=0.1) for r in c)


def test_solved_rates(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 2.0), (2, 1.0), (3, 0.0)], "k bigint, len double")
    got = {r.k: r.rate for r in analysis.solve_rate(df, "k", "len", 0.3).collect()}
    import math

    assert (2 - math.exp(-0.5 * got[1]) - math.exp(-2 * got[1])) / 2 == pytest.approx(0.3, abs=1e-7)
    assert got[2] == pytest.approx(-math.log(0.7), rel=1e-6) and got[3] == 0.0


@pytest.mark.parametrize("r", [1, 2, 3, 4])
def test_designed_network(spark, r):
    df = synthetic.points(spark, 60, seed=4).withColumn("set_id", F.lit(1))
    rows = design.design(df, r).collect()
    degree = {}
    for e in rows:
        for n in (e.u, e.v):
            degree[n] = degree.get(n, 0) + 1
    assert len(degree) == 60 and len(rows) == 60 + r - 1
    assert sorted(degree.values()) == [2] * (60 - 2 * (r - 1)) + [3] * (2 * (r - 1))
    assert len(set(groups([(e.u, e.v) for e in rows], degree).values())) == 1
    assert design.bridges(spark.createDataFrame([(1, e.u, e.v) for e in rows], "graph_id bigint, u bigint, v bigint")).count() == 0


def test_small_solvers():
    import numpy as np

    rng = np.random.default_rng(1)
    xy = rng.random((40, 2))
    sizes = design.target_sizes(40, 6, 2.0, seed=3)
    label, _ = design.balanced_clusters(xy, sizes)
    assert sizes.sum() == 40 and (np.bincount(label, minlength=6) == sizes).all()
    path = design.short_path(xy[:9], 0, 8)
    assert sorted(path) == list(range(9)) and path[0] == 0 and path[-1] == 8
    assert design.edge_connectivity_at_least(2, [(0, 1)] * 3, 3) and not design.edge_connectivity_at_least(3, [(0, 1), (1, 2), (0, 2)], 3)
    chords = design.add_chords([(0, 1), (1, 2), (0, 3), (3, 4)], 0, [(1.0, 2, 4), (1.0, 1, 3), (5.0, 2, 3)], 2)
    assert chords == [(2, 4)]


def test_rewiring_keeps_nodes_and_shortens():
    import numpy as np

    rng = np.random.default_rng(7)
    pos = {i: tuple(rng.random(2)) for i in range(32)}
    chains = [[0, *range(2, 12), 1], [0, *range(12, 22), 1], [0, *range(22, 32), 1]]
    length = lambda cs: sum(np.hypot(pos[a][0] - pos[b][0], pos[a][1] - pos[b][1]) for c in cs for a, b in itertools.pairwise(c))
    after, changes = design.rewire(chains, pos, budget=1.0, max_changes=5)
    assert changes > 0 and length(after) < length(chains)
    assert {n for c in after for n in c} == set(pos) and sum(len(c) - 1 for c in after) == sum(len(c) - 1 for c in chains)


def test_synthetic(spark):
    assert synthetic.cycle(spark, 5).count() == 5 and synthetic.complete(spark, 6).count() == 15 and synthetic.star(spark, 4).count() == 3
    tree = synthetic.balanced_tree(spark, 2, 3)
    assert tree.count() == 14 and {r.degree for r in graphs.degrees(tree).collect()} == {1, 2, 3}
    assert len(set(r.component for r in graphs.components(synthetic.random_tree(spark, 40)).collect())) == 1
    assert {r.degree for r in graphs.degrees(synthetic.random_regular(spark, 20, 3)).collect()} == {3}


def grid(n):
    across = [(r * n + c, r * n + c + 1, 0.1) for r in range(n) for c in range(n - 1)]
    return list(range(n * n)), across + [(r * n + c, (r + 1) * n + c, 0.1) for r in range(n - 1) for c in range(n)]


def test_junction_trees_of_grids_and_rings():
    ring = list(range(150)), [(i, (i + 1) % 150, 0.01) for i in range(150)]
    q = junction.Junction(*ring, 0).cut_off(junction.Values(1))
    assert all(q[i][0] == pytest.approx((1 - 0.99**i) * (1 - 0.99 ** (150 - i)), abs=1e-12) for i in range(150))
    nodes, edges = grid(5)
    tree = junction.Junction(nodes, edges, 0)
    q = tree.cut_off(junction.Values(1))
    frontier = reliability.disconnection(nodes, edges, 0, reliability.Numbers(1), keep=(0, 24))
    assert q[24][0] == pytest.approx(sum(v[0] for part, v in frontier.items() if not part), abs=1e-12)
    assert tree.apart(junction.Values(1))[0] == pytest.approx(reliability.whole_graph(nodes, edges)[0], abs=1e-12)


@pytest.mark.parametrize("seed", range(8))
def test_junction_tree_against_all_states(seed):
    from test_whole import enumerated

    rng = random.Random(seed)
    nodes = list(range(6))
    edges = [(rng.randrange(6), rng.randrange(6), rng.choice([0.1, 0.35, 0.8, 1.0])) for _ in range(9)]
    tree, one = junction.Junction(nodes, edges, 0), junction.Values(1)
    beliefs = tree.beliefs(one)
    saidi, apart, loss, ends = enumerated(nodes, edges, dict.fromkeys(nodes, 1.0))
    assert sum(q[0] for q in tree.cut_off(one, beliefs).values()) / 5 == pytest.approx(saidi, abs=1e-12)
    assert tree.apart(one)[0] == pytest.approx(apart, abs=1e-12)
    for got, want in zip(tree.edge_ends(one, beliefs), ends, strict=True):
        assert [float(x[0]) for x in got] == pytest.approx(want, abs=1e-12)
    every = junction.Junction(nodes, [(u, v, [0.0, 1.0]) for u, v, _ in edges], 0).cut_off(junction.Coefficients(9))
    same = junction.Junction(nodes, [(u, v, 0.2) for u, v, _ in edges], 0).cut_off(one)
    assert all(sum(c * 0.2**k for k, c in enumerate(every[n])) == pytest.approx(same[n][0], abs=1e-12) for n in nodes)


def test_graphs_of_large_bags_take_the_frontier(monkeypatch):
    nodes, edges = grid(4)
    want = reliability.lost(nodes, edges, 0, junction.Values(2))
    monkeypatch.setattr(reliability, "LARGEST_BAG", 2)
    got = reliability.lost(nodes, edges, 0, junction.Values(2))
    assert all(got[n] == pytest.approx(want[n], abs=1e-12) for n in nodes)
    assert reliability.lost([1, 2], [], None, junction.Values(1)) == {1: 1.0, 2: 1.0}
