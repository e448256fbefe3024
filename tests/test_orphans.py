import random
from datetime import datetime, timedelta

import pytest

from gridloom.operators import orphans
from gridloom.plans import problems

T0 = datetime(2024, 1, 31)
N = "node_id bigint, graph_id bigint, label string, created_at timestamp_ntz, deleted_at timestamp_ntz, loaded_at timestamp_ntz, kind string"
C = "cap_id bigint, graph_id bigint, node string, recorded_at timestamp_ntz, loaded_at timestamp_ntz, kind string"


def brute(nodes, refs):
    clean = lambda s: s.strip(" \t\r\n").lower() if s else ""
    held = {}
    for n in nodes:
        held.setdefault((n.graph_id, clean(n.label)), []).append(n)
    out = set()
    for table, ref_id, field, graph, label, at in refs:
        if not clean(label):
            continue
        rows = held.get((graph, clean(label)), []) if graph is not None else []
        if at is not None and any(r.created_at is not None and r.created_at <= at and (r.deleted_at is None or at < r.deleted_at) for r in rows):
            continue
        late = at is not None and all(r.created_at is not None and r.created_at > at for r in rows)
        out.add((table, ref_id, field, "missing" if not rows else "late" if late else "deleted"))
    return out


def test_against_brute_force(spark, medium):
    read = lambda t: spark.read.parquet(f"{medium}/{t}.parquet").collect()
    refs = [("capacitors", r.cap_id, "node", r.graph_id, r.node, r.recorded_at) for r in read("capacitors")]
    refs += [("voltage_regulators", r.reg_id, f, r.graph_id, r[f], r.recorded_at) for r in read("voltage_regulators") for f in ("node_a", "node_b")]
    got = [tuple(r) for r in problems.p4_found(spark, medium).collect()]
    assert set(got) == brute(read("nodes"), refs) and len(got) == len(set(got)) and got


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_any_batches(spark, batches):
    rng = random.Random(batches)
    hour = lambda: rng.choice([None, *range(0, 60, 3)])
    at = lambda h: None if h is None else T0 + timedelta(hours=h)
    graphs, labels = [*range(40), None], ["a", " A ", "b", "", "B\t", "c", None]
    n = spark.createDataFrame([(i, rng.choice(graphs), rng.choice(labels), at(hour()), at(hour()), at(hour()), "k") for i in range(250)], N)
    c = spark.createDataFrame([(i, rng.choice(graphs), rng.choice(labels), at(hour()), at(hour()), "k") for i in range(600)], C)
    tracker = orphans.track(orphans.parents_of(n.unionByName(n)), orphans.references_of(c.unionByName(c), "capacitors", "cap_id", ["node"]), batches)
    got = {(r.ref_table, r.ref_id, r.field, r.kind) for r in tracker.open().collect()}
    want = brute(n.collect(), [("capacitors", r.cap_id, "node", r.graph_id, r.node, r.recorded_at) for r in c.collect()])
    assert got == want and {k for *_, k in want} == {"missing", "late", "deleted"}


def test_arrivals_resolve_and_deletions_reopen(spark):
    tracker = orphans.OrphanTracker(spark)
    day = lambda k: T0 + timedelta(days=k)
    node = lambda c, d: orphans.parents_of(spark.createDataFrame([(1, 1, "a", c, d, None, "k")], N))
    none = node(day(0), None).where("false")
    ref = orphans.references_of(spark.createDataFrame([(1, 1, "A", day(5), None, "k")], C), "capacitors", "cap_id", ["node"])
    kinds = lambda: [r.kind for r in tracker.open().collect()]
    tracker.apply(none, ref, "1")
    assert kinds() == ["missing"]
    tracker.apply(node(day(6), None), ref.where("false"), "2")
    assert kinds() == ["late"]
    tracker.apply(node(day(4), None), ref.where("false"), "3")
    assert kinds() == []
    assert [(r.batch, r.as_of, r.kind, r.orphans) for r in tracker.snapshots().orderBy("batch").collect()] == [(1, "1", "missing", 1), (2, "2", "late", 1)]
    assert [x.count() for x in tracker.added] == [1, 1, 1]
    tracker.apply(node(day(4), day(5)), ref.where("false"), "4")
    assert kinds() == []  # another record of the same label is still valid


def test_only_keys_of_the_batch_are_touched(spark):
    tracker = orphans.OrphanTracker(spark)
    parents = orphans.parents_of(spark.createDataFrame([(i, 1, f"n{i}", T0, None, None, "k") for i in range(50)], N))
    refs = orphans.references_of(spark.createDataFrame([(i, 1, f"n{i}", T0, None, "k") for i in range(60)], C), "capacitors", "cap_id", ["node"])
    tracker.apply(parents, refs, "1")
    later = orphans.parents_of(spark.createDataFrame([(99, 1, "n55", T0, None, None, "k")], N))
    tracker.apply(later, refs.where("false"), "2")
    assert [x.count() for x in tracker.added] == [60, 1]
    assert sorted(r.ref_id for r in tracker.open().collect()) == [i for i in range(50, 60) if i != 55]


def test_a_key_with_most_rows_is_split(spark):
    rows = [(i, 1, "hot", T0 + timedelta(minutes=7 * i), T0 + timedelta(minutes=7 * i + 3), None, "k") for i in range(2000)]
    refs = [(i, 1, "HOT ", T0 + timedelta(minutes=i), None, "k") for i in range(14000)]
    n, c = spark.createDataFrame(rows, N), spark.createDataFrame(refs, C)
    tracker = orphans.track(orphans.parents_of(n), orphans.references_of(c, "capacitors", "cap_id", ["node"]))
    # a record lives for three of every seven minutes
    assert {r.ref_id for r in tracker.open().collect()} == {i for i in range(14000) if i % 7 >= 3}


def test_empty_tables(spark):
    n, c = spark.createDataFrame([], N), spark.createDataFrame([], C)
    tracker = orphans.track(orphans.parents_of(n), orphans.references_of(c, "capacitors", "cap_id", ["node"]))
    assert tracker.open().count() == 0 and tracker.counts().count() == 0
