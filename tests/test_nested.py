import json

import pytest

from gridloom.operators import nested
from gridloom.plans import network_queries, problems


def walk(text):
    """Plain recursion: (path, u, v) of every edge."""
    def cell(value, prefix):
        while isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                return
        inner = value.get("graph") if isinstance(value, dict) else None
        for i, e in enumerate((inner.get("edges") if isinstance(inner, dict) else None) or []):
            if e is None:
                continue
            if isinstance(e, list):
                ends, attrs = e[0][:2], e[1] if len(e) > 1 else None
            else:
                ends, attrs = [e.get("source", e.get("u")), e.get("target", e.get("v"))], e.get("attrs")
            a, b = sorted(map(str, ends))
            yield f"{prefix}{i}", a, b
            if isinstance(attrs, dict) and attrs.get("subgraph") is not None:
                yield from cell(attrs["subgraph"], f"{prefix}{i}/")
    if text is not None:
        yield from cell(text, "")


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_against_recursion(spark, medium, levels):
    rows = spark.read.parquet(f"{medium}/networks.parquet").collect()
    want = {(r.rec_id, root, *x) for r in rows for root in ("graph", "optimal_network") for x in walk(r[root])}
    df = nested.flatten(spark.read.parquet(f"{medium}/networks.parquet"), "edges", levels=levels)
    got = [(r.rec_id, r.root, r.path, *sorted([r.a, r.b])) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def graph(edges, nodes=(), **more):
    return {"type": "Graph", "graph": {"nodes": list(nodes), "edges": edges, **more}}


def frame(spark, cells):
    return spark.createDataFrame([(i, c if c is None or isinstance(c, str) else json.dumps(c), None, "x") for i, c in enumerate(cells)], "rec_id bigint, graph string, optimal_network string, path string")


def test_deep_and_odd_cells(spark):
    deep = graph([[["z", "a"], {}]])
    for _ in range(11):
        deep = graph([None, [[1, 2], {"subgraph": deep}]])
    odd = [deep, None, "", "  ", "nope", "[]", "null", '"text"', "{", {"type": "Graph"}, {"graph": None}, graph(None), json.dumps(json.dumps(graph([[[10, 9]]]))), graph([{"source": "b", "target": "a", "attrs": {"subgraph": json.dumps(graph([[["x", "X"], None]]))}}])]
    got = {(r.rec_id, r.path, r.u, r.v) for r in nested.edge_ends(frame(spark, odd)).collect()}
    want = {(0, "/".join(["1"] * k), "1", "2") for k in range(1, 12)} | {(0, "/".join(["1"] * 11 + ["0"]), "a", "z"), (12, "0", "10", "9"), (13, "0", "a", "b"), (13, "0/0", "X", "x")}
    assert got == want


def test_every_row_leads_to_its_parent(spark, medium):
    nets = {(r.rec_id, r.root, r.parent): r for r in network_queries.p3_networks(spark, medium).collect()}
    edges = {(r.rec_id, r.root, r.path) for r in network_queries.p3_edges(spark, medium).collect()}
    assert all(parent is None or (rec, root, parent) in edges for rec, root, parent in nets)
    nodes = network_queries.p3_nodes(spark, medium).collect()
    assert nodes and all((n.rec_id, n.root, n.parent) in nets for n in nodes)


def test_node_forms(spark):
    g = graph([], [[0, {"pos": [1.5, 2.5], "weight": 3, "is_source": True}], {"id": "b", "attrs": {"pos": {"x": 4, "y": 5}}}, [7], None, {"id": 9}])
    rows = {r.position: r for r in nested.flatten(frame(spark, [g]), "nodes").collect()}
    assert [rows[k].node for k in sorted(rows)] == ["0", "b", "7", "9"]
    assert (rows[0].x, rows[0].y, rows[0].weight, rows[0].is_source) == (1.5, 2.5, 3.0, True) and (rows[1].x, rows[1].y) == (4.0, 5.0)


def test_empty_table(spark):
    assert nested.edge_ends(frame(spark, [None]).where("false")).count() == 0


def test_cells_that_only_python_reads(spark):
    twice = '{"type": "Graph", "graph": {"nodes": [[0, {}]], "nodes": [[0, {}], [1, {"weight": NaN}]], "edges": [[[0, 1], {"length": 2.5, "prob": Infinity}], null, [[1, 0], {"subgraph": {"graph": {"nodes": [], "edges": [[[7, 8], {}]]}}}]]}}'
    rows = [(1, twice, None), (2, '{"graph": {"nodes": [', json.dumps(twice)), (3, "  ", "null")]
    df = spark.createDataFrame(rows, "rec_id bigint, graph string, optimal_network string")
    got = sorted((r.rec_id, r.root, r.path, r.u, r.v) for r in nested.edge_ends(df).collect())
    want = [("0", "0", "1"), ("2", "0", "1"), ("2/0", "7", "8")]
    assert got == [(i, root, *w) for i, root in ((1, "graph"), (2, "optimal_network")) for w in want]
    nodes = nested.flatten(df, "nodes").where("rec_id = 1").collect()
    assert sorted((r.node, r.weight) for r in nodes) == [("0", None), ("1", None)]
