import json
from datetime import datetime, timedelta

import pytest

from gridloom.operators import schema_drift as sd
from gridloom.plans import problems

DDL = "line_id bigint, stream_id bigint, file_id bigint, file_name string, written_at timestamp, line_no int, body string, kind string"


def lines(spark, files):
    """files: (stream, file_id, hour, [body])"""
    rows, n = [], 0
    for stream, file, hour, bodies in files:
        for k, body in enumerate(bodies):
            n += 1
            rows.append((n, stream, file, f"f{file}", datetime(2024, 1, 1) + timedelta(hours=hour), k, body if body is None or isinstance(body, str) else json.dumps(body), "clash"))
    return spark.createDataFrame(rows, DDL)


def found(spark, files):
    return sorted((r.file_id, r.field, r.change) for r in sd.changes(lines(spark, files)).select("file_id", "field", "change").distinct().collect())


def test_added_removed_renamed_retyped(spark):
    a = [{"run_id": "r1", "source": [3, 1], "n": 4, "p": 0.5}, {"run_id": "r2", "source": [2], "n": 5, "p": 1e-5}]
    b = [{"run_id": "r1", "sources": "1;3", "n": "4", "prob": 0.5}, {"run_id": "r2", "sources": {"2": 1}, "n": None, "prob": 0.00001}, {"run_id": "r9", "sources": "7", "x": True}]
    assert found(spark, [(1, 20, 0, a), (1, 10, 1, b)]) == [(10, "n", "retyped"), (10, "prob", "renamed"), (10, "sources", "renamed"), (10, "sources", "retyped"), (10, "x", "added")]


def test_one_differing_run_is_no_rename(spark):
    a = [{"run_id": "r1", "f": 1}, {"run_id": "r2", "f": 2}]
    b = [{"run_id": "r1", "g": 1}, {"run_id": "r2", "g": 3}]
    assert found(spark, [(1, 1, 0, a), (1, 2, 1, b)]) == [(2, "f", "removed"), (2, "g", "added")]


def test_lines_that_do_not_count(spark):
    a = [{"run_id": "r1", "f": 1}, "", "   ", None, "[1]", "null", '{"run_id": "r2", "cut', {"run_id": "r3", "f": []}]
    b = [{"run_id": "r1", "f": 1, "g": None, "h": []}, {"run_id": "r1", "f": 1}]
    assert found(spark, [(1, 1, 0, a), (1, 2, 1, b), (2, 3, 0, [{"z": 1}])]) == []
    # a file without records still follows and is followed
    assert found(spark, [(1, 1, 0, a), (1, 2, 1, ["", None]), (1, 3, 2, a)]) == [(2, "f", "removed"), (3, "f", "added")]


def test_kinds_of_elements():
    assert sd.kind_of([]) is None and sd.kind_of(None) is None
    assert sd.kind_of([1, "a", [2], {}, True, None]) == "array<array,boolean,number,object,string>"
    assert sd.kind_of(False) == "boolean"


@pytest.mark.parametrize(
    ("a", "b"),
    [
        (5, "5"), (5, [5]), (["n5"], 5), ({"1": 1, "4": 1}, "4;1"), ([4, 1], ["n1", "n4"]), (0.0292679079, "0.0292679079"), (1e-5, 0.00001),
        ({"type": "Graph", "graph": {"nodes": [[0, {}], [1, {"pos": [1.0, 2.5]}]], "edges": [[[0, 1], {}]], "graph": []}}, [[[0, {}], [1, {"pos": [1, 2.5]}]], [[[0, 1], {}]]]),
        ({"type": "Graph", "graph": {"nodes": [], "edges": []}}, '{"graph": {"edges": [], "nodes": []}}'),
    ],
)
def test_same_content_in_other_forms(a, b):
    assert sd.canonical(a) == sd.canonical(b)


@pytest.mark.parametrize(("a", "b"), [(5, 6), ([1, 2], [1, 3]), ([0.1, 0.2], [0.2, 0.1]), (True, 1), ("x", "y"), ({"total": 1, "unit": "m"}, {"total": 1, "unit": "km"}), (10**17, 10**17 + 1)])
def test_other_content_differs(a, b):
    assert sd.canonical(a) != sd.canonical(b)


def brute(rows):
    """Plain dictionaries, file after file."""
    files = {}
    for r in rows:
        f = files.setdefault((r.stream_id, r.written_at, r.file_id), {"fields": {}, "runs": {}})
        try:
            record = json.loads(r.body or "")
        except ValueError:
            continue
        if not isinstance(record, dict):
            continue
        run = record.pop("run_id", None)
        for k, v in record.items():
            if v is not None and v != []:
                f["fields"].setdefault(k, set()).add(sd.kind_of(v))
                f["runs"].setdefault((run, k), set()).add(sd.canonical(v))
    out, before = set(), None
    for key in sorted(files):
        cur = files[key]
        if before and before[0][0] == key[0]:
            old = before[1]
            ended, begun = set(old["fields"]) - set(cur["fields"]), set(cur["fields"]) - set(old["fields"])
            gone, come = set(), set()
            for e in ended:
                for b in begun:
                    shared = [r for (r, k) in old["runs"] if k == e and (r, b) in cur["runs"]]
                    if shared and all(len(old["runs"][r, e] | cur["runs"][r, b]) == 1 for r in shared):
                        gone.add(e)
                        come.add(b)
                        out.add((key[2], b, "renamed"))
                        if old["fields"][e] != cur["fields"][b]:
                            out.add((key[2], b, "retyped"))
            out |= {(key[2], x, "removed") for x in ended - gone} | {(key[2], x, "added") for x in begun - come}
            out |= {(key[2], x, "retyped") for x in set(old["fields"]) & set(cur["fields"]) if old["fields"][x] != cur["fields"][x]}
        before = (key, cur)
    return out


def test_against_brute_force(spark, medium):
    got = {tuple(r) for r in problems.p2_found(spark, medium).collect()}
    assert got == brute(spark.read.parquet(f"{medium}/sweep_files.parquet").collect())
    assert got


def test_runs_table(spark):
    a = [{"run_id": "r1", "source": [3, 1], "n": "4", "p": 0.5, "rho": "bad"}]
    b = [{"run_id": "r1", "sources": ["n1", "n3"], "n": 4, "p": [0.5], "extra": {"a": 1}}]
    row = sd.runs(lines(spark, [(1, 1, 0, a), (1, 2, 1, b)])).collect()
    assert len(row) == 1
    assert row[0].sources == [1, 3] and row[0].n == 4 and row[0].p == [0.5] and row[0].rho is None
    assert [tuple(x) for x in row[0].failed] == [("rho", '"bad"', "double")] and row[0].extras == {"extra": '{"a":1}'}


def test_values_keep_order_and_text(spark):
    body = {"run_id": "r1", "p": [1.0, 0.0], "name": "A12", "code": "007", "label": "neta", "SAIDI": "0.5", "source": [3, 1], "odd": [2, 1]}
    columns = sd.RUN_COLUMNS | {"name": "string", "code": "string", "label": "string", "odd": "string"}
    row = sd.runs(lines(spark, [(1, 1, 0, [body])]), columns).first()
    assert (row.p, row.name, row.code, row.label, row.saidi, row.sources, row.odd) == ([1.0, 0.0], "A12", "007", "neta", 0.5, [3, 1], "[2,1]")
    assert row.extras == {} and row.failed == []


FORMS = [
    ("sources", "n5", [5]), ("sources", "4; 1", [4, 1]), ("sources", {"10": 1, "9": 1}, [9, 10]), ("sources", 7, [7]), ("sources", ["n3", None, 2], [3, None, 2]), ("sources", "[2,1]", [2, 1]),
    ("p", "0.25", [0.25]), ("p", 1e-5, [1e-5]), ("n", [8], 8), ("n", " 8 ", 8), ("n", 8.0, 8), ("rho", "1e-3", 0.001), ("trial", 9007199254740993, 9007199254740993),
]
FAILED = [("n", 4.7), ("n", True), ("n", [1, 2]), ("n", {"a": 1}), ("sources", ["x", 1]), ("sources", {"a": 1}), ("p", [0.5, "bad"]), ("graph", [1, 2]), ("graph", "plain"), ("saidi", "1.2.3")]


def test_forms_of_columns_and_failed_casts(spark):
    cases = [(f, v) for f, v, _ in FORMS] + FAILED
    got = {int(r.run_id): r for r in sd.runs(lines(spark, [(1, 1, 0, [{"run_id": str(i), f: v} for i, (f, v) in enumerate(cases)])])).collect()}
    for i, (field, value) in enumerate(cases):
        if i < len(FORMS):
            assert got[i][field] == FORMS[i][2] and got[i].failed == [], cases[i]
        else:
            assert [(x.field, json.loads(x.value), x.target) for x in got[i].failed] == [(field, value, sd.RUN_COLUMNS[field])], cases[i]


def test_graphs_in_one_form(spark):
    nodes, edges = [[0, {}], [1, {"pos": [2.5, -1.25]}]], [[[1, 0], {}]]
    cell = {"type": "Graph", "graph": {"nodes": nodes, "edges": edges, "graph": []}}
    forms = [cell, json.dumps(cell), json.dumps(json.dumps(cell)), [nodes, edges], {"nodes": nodes, "edges": edges}, {"type": "Graph", "graph": json.dumps({"nodes": nodes, "edges": edges})}]
    got = sd.runs(lines(spark, [(1, 1, 0, [{"run_id": f"r{i}", "graph": g} for i, g in enumerate(forms)])])).collect()
    assert len(got) == len(forms) and all(json.loads(r.graph) == {"type": "Graph", "graph": {"nodes": nodes, "edges": edges}} for r in got)


def test_renames_hold_for_their_stream_only(spark):
    a, b = [{"run_id": "r1", "saidi": 0.5}], [{"run_id": "r1", "f": 0.5}]
    other = [{"run_id": "q1", "f": 9}]
    files = [(1, 1, 0, a), (1, 2, 1, b), (2, 3, 0, other)]
    got = {r.run_id: r for r in sd.runs(lines(spark, files)).collect()}
    assert got["r1"].saidi == 0.5 and got["q1"].saidi is None and got["q1"].extras == {"f": "9"}
    agreed = {r.run_id: r for r in sd.runs(lines(spark, files), agreed_elsewhere=True).collect()}
    assert agreed["q1"].saidi == 9.0


def test_a_chain_of_six_renames(spark):
    names = ["graph", *"abcdef"]
    files = [(1, k, k, [{"run_id": "r1", n: [[[0, {}]], []]}, {"run_id": f"s{k}", n: [[[k, {}]], []]}]) for k, n in enumerate(names)]
    got = {r.run_id: r for r in sd.runs(lines(spark, files)).collect()}
    assert len(got) == 8 and all(r.graph is not None and not r.extras for r in got.values())


def test_lines_that_only_python_reads(spark):
    a = ['{"run_id": "r1", "f": 1, "f": 2, "x": NaN}', '{"run_id": "r2", "f": 3} tail']
    b = [{"run_id": "r1", "g": 2, "x": 1}]
    assert found(spark, [(1, 1, 0, a), (1, 2, 1, b)]) == [(2, "g", "renamed")]


def test_no_variant_of_a_column_name_is_left_over(spark, medium):
    left = {k for r in problems.p2_runs(spark, medium).collect() for k in r.extras}
    assert not left & {"source", "SAIDI", "Graph", "Sources"}


def test_empty_table(spark):
    none = lines(spark, [(1, 1, 0, [None])]).where("false")
    assert sd.changes(none).count() == 0 and sd.runs(none).count() == 0
