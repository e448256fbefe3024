import json
import random

import pytest
from pyspark.sql import functions as F
from test_graphs import brute

from gridloom.operators import graphs, junction, networks, reliability

DDL = "rec_id bigint, sources array<bigint>, graph string, optimal_network string"


@pytest.mark.parametrize("seed", range(12))
def test_skeleton_against_all_states(seed):
    rng = random.Random(seed)
    nodes = list(range(8))
    edges = [(i, i + 1, rng.choice([0.1, 0.4])) for i in range(5)] + [(rng.randrange(7), rng.randrange(7), rng.choice([0.05, 0.3, 1.0])) for _ in range(4)]
    source = rng.randrange(7)
    want = brute(nodes, edges, source)
    got = networks.lost_by_skeleton(nodes, edges, source)
    assert all(float(got[n][0]) == pytest.approx(want[n], abs=1e-12) for n in nodes)
    poly = networks.lost_by_skeleton(nodes, [(u, v, [0.0, 1.0]) for u, v, _ in edges], source, junction.Coefficients(len(edges)))
    plain = reliability.lost(nodes, [(u, v, 0.2) for u, v, _ in edges], source, junction.Values(1))
    assert all(sum(c * 0.2**k for k, c in enumerate(poly[n])) == pytest.approx(float(plain[n][0]), abs=1e-12) for n in nodes)


def test_theta_graph_of_the_survey():
    # three chains of two edges between two forks: 0.0116515 by enumeration
    edges = [(0, 2, 0.1), (2, 1, 0.1), (0, 3, 0.1), (3, 1, 0.1), (0, 4, 0.1), (4, 1, 0.1)]
    q = networks.lost_by_skeleton(list(range(5)), edges, 0)
    want = brute(list(range(5)), edges, 0)
    assert sum(float(x[0]) for x in q.values()) / 4 == pytest.approx(sum(want.values()) / 4, abs=1e-12)


def cell(nodes, edges):
    return json.dumps({"type": "Graph", "graph": {"nodes": nodes, "edges": edges}})


def test_from_cells_to_saidi(spark):
    ring = cell([[0, {"weight": 5.0}], [1, {"weight": 2.0}], [2, {}], [3, {"weight": -1.0}], [3, {}]], [[[0, 1], {"prob": 0.1}], [[1, 2], {}], [[2, 3], {"prob": 7}], [[3, 0], {"length": 2.5}], None, [[0, None], {}]])
    tree = cell([["a", {"is_source": True}], ["b"]], [[["a", "b"], {"prob": 0.25}], [["b", "c"], {"prob": 0.5}]])
    df = spark.createDataFrame([(1, [0], ring, None), (2, None, tree, "not json"), (3, None, cell([[5, {}]], []), None)], DDL)
    nodes, edges = networks.graphs_of(df)
    held = {(r.graph_id, r.label): (r.node, r.weight, r.is_source) for r in nodes.collect()}
    assert held == {
        ("1/graph", "0"): (0, 5.0, True), ("1/graph", "1"): (1, 2.0, False), ("1/graph", "2"): (2, 1.0, False), ("1/graph", "3"): (3, 0.0, False),
        ("2/graph", "a"): (0, 1.0, True), ("2/graph", "b"): (1, 1.0, False), ("2/graph", "c"): (2, 1.0, False), ("3/graph", "5"): (0, 1.0, True),
    }
    assert {(r.graph_id, r.u, r.v, r.prob) for r in edges.collect()} == {("1/graph", 0, 1, 0.1), ("1/graph", 1, 2, 0.01), ("1/graph", 2, 3, 0.01), ("1/graph", 0, 3, 0.01), ("2/graph", 0, 1, 0.25), ("2/graph", 1, 2, 0.5)}
    q = brute([0, 1, 2, 3], [(0, 1, 0.1), (1, 2, 0.01), (2, 3, 0.01), (0, 3, 0.01)], 0)
    for by in (True, False):
        got = {r.graph_id: r.saidi for r in networks.saidi(nodes, edges, by).collect()}
        assert got == {"1/graph": pytest.approx((2 * q[1] + q[2]) / 3), "2/graph": pytest.approx((0.25 + 1 - 0.75 * 0.5) / 2), "3/graph": 0.0}
    rows = {r.graph_id: r for r in networks.summary(nodes, edges).collect()}
    assert (rows["1/graph"].n, rows["1/graph"].m, rows["1/graph"].r, rows["1/graph"].two_connected, rows["1/graph"].length) == (4, 4, 1, 1.0, 2.5)
    assert (rows["2/graph"].r, rows["2/graph"].two_connected, rows["2/graph"].optimal_loss) == (0, 0.0, 0.0) and rows["3/graph"].m == 0


def test_default_source_is_the_first_fork(spark):
    star = cell([], [[["b", "x"], {}], [["b", "y"], {}], [["b", "z"], {}]])
    nodes, _ = networks.graphs_of(spark.createDataFrame([(1, None, star, None)], DDL))
    assert [r.label for r in nodes.where("is_source").collect()] == ["b"]
    assert networks.graphs_of(spark.createDataFrame([], DDL))[0].count() == 0


def test_validation(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 1)], "graph_id bigint, node bigint")
    edges = lambda *rows: spark.createDataFrame(rows, "graph_id bigint, edge_id bigint, u bigint, v bigint, prob double")
    assert networks.validated(nodes, edges((1, 0, 0, 1, 0.5))).count() == 1
    for row, message in (((1, 0, 0, 1, 1.5), "outside"), ((1, 0, 0, 1, None), "outside"), ((1, 0, 0, 7, 0.5), "unknown end")):
        with pytest.raises(Exception, match=message):
            networks.validated(nodes, edges(row)).collect()


def test_middle_nodes_become_cliques(spark):
    # 1 and 2 are linked middle nodes with neighbours 10, 11, 12; 3 has one neighbour
    edges = spark.createDataFrame([(10, 1), (1, 2), (2, 11), (12, 2), (3, 10), (10, 13)], "u bigint, v bigint")
    middle = spark.createDataFrame([(1,), (2,), (3,), (99,)], "node bigint")
    assert {tuple(r) for r in networks.without_middle(edges, middle).collect()} == {(10, 11), (10, 12), (11, 12), (10, 13)}


def test_inserted_nodes(spark):
    edges = spark.createDataFrame([(7, 1, 2, 0.0, 0.0, 3.0, 6.0)], "edge_id bigint, u bigint, v bigint, ux double, uy double, vx double, vy double")
    rows = networks.sparse(edges, 2, "ux", "uy", "vx", "vy").orderBy("place").collect()
    assert [(tuple(r.u), tuple(r.v)) for r in rows] == [((None, 1), (7, 1)), ((7, 1), (7, 2)), ((7, 2), (None, 2))]
    assert [(r.x0, r.y0, r.x1, r.y1) for r in rows] == [(0.0, 0.0, 1.0, 2.0), (1.0, 2.0, 2.0, 4.0), (2.0, 4.0, 3.0, 6.0)]
    assert networks.sparse(edges, 0).count() == 1


def test_skeleton_edges_agree_with_the_distributed_one(spark):
    rows = [(0, 0, 2), (1, 2, 3), (2, 3, 1), (3, 0, 4), (4, 4, 1), (5, 0, 1), (6, 1, 5), (7, 5, 6)]
    df = spark.createDataFrame([(i, u, v, 0.1, 1.0) for i, u, v in rows], "edge_id bigint, u bigint, v bigint, prob double, length double")
    wide = sorted((min(r.a, r.b), max(r.a, r.b), r.n_edges) for r in graphs.skeleton(df).collect())
    _, chains = networks.chains_of(list(range(7)), [(u, v, 0.1) for _, u, v in rows], 0)
    assert wide == sorted((min(a, b), max(a, b), len(ps)) for a, _, b, ps in chains)


def test_improvement(spark):
    before = spark.createDataFrame([(1, 4.0, 0.0)], "k bigint, length double, loss double")
    after = spark.createDataFrame([(1, 3.0, 1.0)], "k bigint, length double, loss double")
    row = networks.improvement(before, after, "k", "length", "loss").select("k", F.col("length_gain"), "loss_gain").first()
    assert tuple(row) == (1, 0.25, None)


def test_edge_components_against_removals(spark):
    import itertools

    from test_graphs import groups

    rng = random.Random(11)
    for seed in range(3):
        nodes = list(range(7))
        pairs = [(rng.randrange(7), rng.randrange(7)) for _ in range(13)]
        ids = sorted({n for p in pairs for n in p})
        df = spark.createDataFrame([("g", i, u, v) for i, (u, v) in enumerate(pairs)], "graph_id string, edge_id bigint, u bigint, v bigint")
        for k in (1, 2, 3):
            same = {(a, b) for a, b in itertools.combinations(ids, 2)}
            for gone in itertools.combinations(range(len(pairs)), k - 1):
                root = groups([p for i, p in enumerate(pairs) if i not in gone], nodes)
                same &= {(a, b) for a, b in same if root[a] == root[b]}
            got = {r.node: r.component for r in networks.edge_components(df, k).collect()}
            assert {(a, b) for a, b in itertools.combinations(ids, 2) if got[a] == got[b]} == same, (seed, k)
            assert all(c == min(n for n in ids if got[n] == c) for c in got.values())


def test_bags_hold_their_edges_and_run_through_the_tree(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(18)]
    nodes = spark.createDataFrame([("g", n, n in (0, 4)) for n in range(9)], "graph_id string, node bigint, is_source boolean")
    edges = spark.createDataFrame([("g", i, u, v, 0.1) for i, (u, v) in enumerate(pairs)], "graph_id string, edge_id bigint, u bigint, v bigint, prob double")
    rows = {r.bag: r for r in networks.bags(nodes, edges).collect()}
    name = lambda n: 0 if n in (0, 4) else n
    assert sorted(r.node for r in rows.values()) == [n for n in range(9) if n not in (0, 4)]
    held = [(e, r) for r in rows.values() for e in r.edges]
    assert sorted(e for e, _ in held) == [i for i, (u, v) in enumerate(pairs) if name(u) != name(v)]
    assert all({name(pairs[e][0]), name(pairs[e][1])} <= set(r.members) for e, r in held)
    for n in range(1, 9):  # the bags of a node are linked: all but one have a parent with the node too
        tops = [r for r in rows.values() if n in r.members and (r.parent is None or n not in rows[r.parent].members)]
        assert len(tops) <= 1


def test_functions_in_sql(spark):
    from gridloom.functions import sql

    sql.register(spark)
    assert spark.sql("SELECT poly_value(array(1D, 2D), 0.5D) AS v").first().v == 2.0 and set(sql.FUNCTIONS) >= {"chain_fail", "mercator_y"}
