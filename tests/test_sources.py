import json

from gridloom.sources import readers

INP = """[TITLE]
;comment
[JUNCTIONS]
;ID Elev Demand
 J1 10 5 ;
 J2 12 -1
 J3 13
[RESERVOIRS]
 R1 100
[PIPES]
 P1 R1 J1 120.5 300 0.01 0 Open ;
 P2 J1 J2 80 200 0.01
[DEMANDS]
 J3 7.5
[COORDINATES]
 J1 1.0 2.0
 R1 0 0
"""

GML = """graph [
  node [
    id 0
    label "Old Town"
    Longitude -1.5
    Internal 1
    Latitude 40
  ]
  node [
    id 1
    label "Bay"
    Internal 0
  ]
  edge [
    source 0
    target 1
    id "e1"
  ]
]
"""


def test_inp(spark, tmp_path):
    (tmp_path / "a.inp").write_text(INP)
    nodes, edges = readers.read_inp(spark, f"{tmp_path}/a.inp")
    got = {r.label: (r.node, r.weight, r.x, r.is_source) for r in nodes.collect()}
    assert got == {"J1": (0, 5.0, 1.0, False), "J2": (1, 0.0, None, False), "J3": (2, 7.5, None, False), "R1": (3, 0.0, 0.0, True)}
    assert {(r.edge, r.u, r.v, r.length, r.diameter) for r in edges.collect()} == {("P1", "R1", "J1", 120.5, 300.0), ("P2", "J1", "J2", 80.0, 200.0)}


def test_gml(spark, tmp_path):
    (tmp_path / "a.gml").write_text(GML)
    nodes, edges = readers.read_gml(spark, f"{tmp_path}/a.gml")
    assert {(r.node, r.label, r.x, r.y, r.internal) for r in nodes.collect()} == {(0, "Old Town", -1.5, 40.0, True), (1, "Bay", None, None, False)}
    assert [(r.u, r.v) for r in edges.collect()] == [(0, 1)]


def test_dss(spark, tmp_path):
    (tmp_path / "Buscoords.dss").write_text("B1 1 2\nb2, 3, 4\nb3 x y\n")
    (tmp_path / "Lines.dss").write_text("New Line.L1 Units=m Length=12.5 bus1=B1.1.2 bus2=b2.1.2 phases=2\n!New Line.L2 bus1=b1 bus2=b2\nNew Line.L3 Length=1 bus1=b1 bus2=b3\n")
    (tmp_path / "Loads.dss").write_text("New Load.a bus1=B2.1 kV=1 kW=3 kvar=1\nNew Load.b bus1=b2.2 kV=1 kW=4.5 kvar=1\n")
    (tmp_path / "Master.dss").write_text("Clear\nNew Circuit.x bus1=b1 basekv=10\n")
    nodes, edges = readers.read_dss(spark, str(tmp_path))
    assert {(r.label, r.weight, r.x, r.is_source) for r in nodes.collect()} == {("b1", 0.0, 1.0, True), ("b2", 4.5, 3.0, False)}
    assert [(r.edge, r.u, r.v, r.length) for r in edges.collect()] == [("L1", "b1", "b2", 12.5)]


def test_nxjson_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, 2.5), (1, 1, None), (2, 0, 1.0)], "graph_id bigint, node bigint, weight double")
    edges = spark.createDataFrame([(1, 0, 1, 7.0)], "graph_id bigint, u bigint, v bigint, length double")
    rows = readers.graph_cell(nodes, edges)
    as_text = {r.graph_id: json.loads(r.cell) for r in rows.collect()}
    assert as_text[1]["graph"]["edges"] == [[[0, 1], {"length": 7.0}]] and as_text[2]["graph"]["nodes"] == [[0, {"weight": 1.0}]]
    out = f"{tmp_path}/cells"
    readers.write_nxjson(rows, out)
    back = readers.read_nxjson(spark, out)
    assert back.count() == 2
    assert sorted((r.node, r.weight) for r in readers.cells(back, "cell", "nodes").collect() if r.weight) == [("0", 1.0), ("0", 2.5)]
    assert [(r.a, r.b, r.length) for r in readers.cells(back, "cell", "edges").collect()] == [("0", "1", 7.0)]
    (tmp_path / "old.json").write_text(json.dumps(json.dumps(as_text[1])))
    assert readers.read_legacy(spark, f"{tmp_path}/old.json", "edges").count() == 1


def test_csv_files_and_resume(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Node , kv ,\n A1 , 12.47 ,\n  , 1 ,\n")
    (tmp_path / "c_temp.csv").write_text("x\n1\n")
    df = readers.read_csv_tidy(spark, f"{tmp_path}/c.csv")
    assert df.columns == ["Node", "kv"] and [(r.Node, r.kv) for r in df.collect()] == [("A1", "12.47"), (None, "1")]
    assert [r.path.split("/")[-1] for r in readers.files(spark, str(tmp_path), ".csv", "_temp").collect()] == ["c.csv"]
    assert [r.kv for r in readers.missing_only(df, df.where("kv = '1'"), ["kv"]).collect()] == ["12.47"]
