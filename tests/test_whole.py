"""Operators do the whole of their job: no limit on moves, edges, nodes or renames."""

import itertools
import random
from collections import Counter

import pytest

from gridloom.operators import graphs, reliability, schema_drift, simulation
from gridloom.plans import reference


def test_every_position_of_a_chain_is_a_candidate(spark, small, monkeypatch):
    monkeypatch.setattr(reference, "POSITIONS", 7)  # chains of several parts
    size = Counter(r.label for r in reference.points(spark, small).collect())
    got = {(r.chain_from, r.chain_to, r.i): r.d_risk for r in reference.rewire_candidates(spark, small).collect()}
    assert set(got) == {(a, b, i) for a in size for b in size if a != b for i in range(1, size[b])}
    assert max(i for _, _, i in got) > 3
    h = lambda x: (x - 1) * x * (x + 1) / 6
    total = sum(h(x) for x in size.values())
    for (a, b, i), d in got.items():
        assert d == pytest.approx((h(size[b] - i) - h(size[b]) + h(size[a] + i) - h(size[a])) / total, abs=2e-9)


RING = "graph_id bigint, edge_id bigint, u bigint, v bigint, prob double"


@pytest.mark.parametrize("measure", ["saidi", "pairwise"])
def test_simulation_of_a_graph_of_over_64_edges(spark, measure):
    n = 80
    ring = [(1, i, i, (i + 1) % n, 0.02) for i in range(n)]
    edges = spark.createDataFrame(ring, RING)
    nodes = spark.createDataFrame([(1, i, 1.0) for i in range(n)], "graph_id bigint, node bigint, weight double")
    happened = sorted((r.t, r.edge_id) for r in simulation.events(edges, 50.0, 0.5).collect())
    assert any(e >= 64 for _, e in happened)
    down, want = set(), [0.0]
    for _, e in happened:
        down ^= {e}
        cuts = sorted(down)
        arcs = [(b - a - 1) % n + 1 for a, b in zip(cuts, cuts[1:] + cuts[:1], strict=True)] if cuts else [n]
        with_source = n if len(cuts) < 2 else (cuts[0] - cuts[-1] - 1) % n + 1
        want.append((n - with_source) / (n - 1) if measure == "saidi" else 1 - sum(c * (c - 1) for c in arcs) / (n * (n - 1)))
    got = simulation.simulate(nodes, edges, 50.0, 0.5, measure).orderBy("t0", "t1").collect()
    assert [r.t0 for r in got] == pytest.approx([0.0, *(t for t, _ in happened)])
    assert [r.lost for r in got] == pytest.approx(want, abs=1e-12) and max(want) > 0


def test_simulation_keeps_graphs_without_events(spark):
    edges = spark.createDataFrame([(1, 0, 0, 1, 0.0)], RING)
    nodes = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0)], "graph_id bigint, node bigint, weight double")
    assert [tuple(r) for r in simulation.simulate(nodes, edges, 10.0, 0.5).collect()] == [(1, 0.0, 10.0, 0.0)]


def link(pairs, nodes):
    root = {n: {n} for n in nodes}
    for a, b in pairs:
        if root[a] is not root[b]:
            whole = root[a] | root[b]
            for n in whole:
                root[n] = whole
    return root


def enumerated(nodes, edges, weights):
    """SAIDI, disconnection, pairwise loss and ends of the edges, by all states; node 0 is the source."""
    saidi = apart = loss = 0.0
    ends = [[0.0] * 4 for _ in edges]
    pairs = list(itertools.combinations(nodes, 2))
    total = sum(weights[n] for n in nodes if n)
    for state in itertools.product([0, 1], repeat=len(edges)):
        q = 1.0
        for up, (_, _, p) in zip(state, edges, strict=True):
            q *= 1 - p if up else p
        if not q:
            continue
        root = link([e[:2] for up, e in zip(state, edges, strict=True) if up], nodes)
        saidi += q * sum(weights[n] for n in nodes if n not in root[0]) / total
        apart += q * (len(root[0]) < len(nodes))
        loss += q * sum(b not in root[a] for a, b in pairs) / len(pairs)
        for k, (u, v, p) in enumerate(edges):
            if not state[k]:
                ends[k][(u in root[0]) + 2 * (v in root[0])] += q / p
    return saidi, apart, loss, ends


@pytest.mark.parametrize("seed", range(6))
def test_kernel_of_whole_graphs_against_all_states(seed):
    rng = random.Random(seed)
    nodes = list(range(6))
    edges = [(rng.randrange(6), rng.randrange(6), rng.choice([0.1, 0.35, 0.8, 1.0])) for _ in range(9)]
    _, apart, loss, ends = enumerated(nodes, edges, dict.fromkeys(nodes, 1.0))
    assert reliability.whole_graph(nodes, edges) == pytest.approx((apart, loss), abs=1e-12)
    for got, want in zip(reliability.edge_ends(nodes, edges, 0), ends, strict=True):
        assert got == pytest.approx(tuple(want), abs=1e-12)


def test_indexes_of_graphs_of_over_16_edges(spark):
    rng = random.Random(1)
    graphs = {1: [(a, b, rng.choice([0.1, 0.3])) for a, b in itertools.combinations(range(4), 2)]}
    graphs[2] = [(a, b, rng.choice([0.1, 0.4])) for a, b in itertools.combinations(range(7), 2)][:17]  # 17 edges
    weights = {g: {n: n + 1.0 for n in range(size)} for g, size in ((1, 4), (2, 7))}
    nodes = spark.createDataFrame([(g, n, w, n == 0) for g, ws in weights.items() for n, w in ws.items()], "graph_id bigint, node bigint, weight double, is_source boolean")
    edges = spark.createDataFrame([(g, i, u, v, p) for g, es in graphs.items() for i, (u, v, p) in enumerate(es)], RING)
    saidi, apart, loss = ({r.graph_id: r[1] for r in f(nodes, edges).collect()} for f in (reliability.saidi_exact, reliability.all_terminal, reliability.pairwise))
    ends = {(r.graph_id, r.edge_id): tuple(r)[4:] for r in reliability.edges_rel(nodes, edges).collect()}
    for g, es in graphs.items():
        want = enumerated(list(weights[g]), es, weights[g])
        assert (saidi[g], apart[g], loss[g]) == pytest.approx(want[:3], abs=1e-9)
        for k, e in enumerate(want[3]):
            assert ends[g, k] == pytest.approx(tuple(e), abs=1e-9)
    with pytest.raises(Exception, match="more than 16 edges"):
        reliability.states(edges).collect()


def test_polynomials_have_all_powers(spark, small):
    got = reference.exact_polynomial(spark, small).collect()
    assert max(r.power for r in got) == 10
    for row in reference.exact_over_p(spark, small).collect():
        value = sum(r.coef * row.p**r.power for r in got if (r.graph_id, r.node) == (row.graph_id, row.node))
        assert value == pytest.approx(row.q, abs=2e-9)


def test_chains_of_renames_of_any_length(spark):
    names = ["saidi", *(f"name{k}" for k in range(9))]
    moved = spark.createDataFrame([(1, a, b) for a, b in [*zip(names, names[1:]), ("other", "another")]], "stream_id bigint, old_path string, new_path string")
    fields = spark.createDataFrame([(s, p) for s in (1, 2) for p in [*names, "n", "other"]], "stream_id bigint, path string")
    got = {(r.stream_id, r.path): r.target for r in schema_drift.aliases(moved, fields, ["saidi", "n"]).collect()}
    assert got == {(1, n): "saidi" for n in names} | {(2, "saidi"): "saidi", (1, "n"): "n", (2, "n"): "n"}


def test_partitions_of_whole_regions(spark, small):
    size = Counter(r.graph_id for r in reference.partition_product(spark, small).collect())
    assert size == dict.fromkeys(range(5), 52)  # all partitions of five nodes


def test_far_points_have_a_nearest(spark):
    a = spark.createDataFrame([(1, 1e9, 0.0), (2, 0.0, 0.0), (3, -3.0, 4e6), (4, None, 1.0)], "id bigint, x double, y double")
    b = spark.createDataFrame([(10, 0.5, 0.5), (11, 1.0, -2.0), (12, 5e5, 1.0), (13, 0.5, 0.5)], "id bigint, x double, y double")
    got = {r.a: (r.b, r.d) for r in graphs.nearest(a, b, 0.01).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 12, 2: 10, 3: 10} and got[1][1] == pytest.approx(1e9 - 5e5)
    assert graphs.nearest(a, b.where("false"), 0.01).count() == 0 and graphs.nearest(a.where("false"), b, 0.01).count() == 0


def test_levels_and_rounds_beyond_the_limit_are_errors(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(8)], "u bigint, v bigint, weight double")
    start = spark.createDataFrame([(0,)], "node bigint")
    assert graphs.bfs(path, start, max_depth=9).count() == 9
    with pytest.raises(RuntimeError, match="beyond 5 levels"):
        graphs.bfs(path, start, max_depth=5)
    with pytest.raises(RuntimeError, match="did not settle"):
        graphs.spanning_tree(path, max_rounds=1)


def test_dense_cells_are_divided(spark, monkeypatch):
    monkeypatch.setattr(graphs, "DENSE", 10)
    rng = random.Random(4)
    points = [(i, rng.random() * (0.1 if i % 3 else 3), rng.random() * (0.1 if i % 3 else 3)) for i in range(150)]
    got = [(r.a, r.b) for r in graphs.range_pairs(spark.createDataFrame(points, "id bigint, x double, y double"), 0.07).collect()]
    want = {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 <= 0.07}
    assert len(got) == len(set(got)) and set(got) == want
