import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, prob
from gridloom.operators import analysis, design, spatial
from gridloom.sources import readers, synthetic


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def poly(*c):
    return F.array(*[F.lit(float(x)) for x in c])


def test_polynomial_division_powers_and_roots(spark):
    rng = random.Random(1)
    for _ in range(6):
        a, b = [rng.randint(-5, 5) for _ in range(rng.randint(1, 6))], [rng.randint(-5, 5) for _ in range(rng.randint(0, 3))] + [rng.choice([1, -2])]
        got = one(spark, prob.poly_divmod(poly(*a), poly(*b)))
        q, r = np.polydiv(np.trim_zeros(a[::-1], "f") or [0], b[::-1])
        assert np.allclose(got.quotient, q[::-1]) and np.allclose(np.trim_zeros(got.remainder, "b"), np.trim_zeros(r[::-1], "b"))
    assert one(spark, prob.poly_divmod(poly(1, 2), poly(0, 0))) is None
    assert one(spark, prob.poly_pow(poly(1, -1), F.lit(0))) == [1.0] and one(spark, prob.poly_pow(poly(1, -1), F.lit(4))) == [1, -4, 6, -4, 1]
    roots = spark.range(1).select(prob.real_roots(poly(6, -5, 1, 0)).alias("a"), prob.real_roots(poly(1, 0, 1)).alias("b"), prob.real_roots(poly(3)).alias("c"), prob.real_roots(poly(1, 2, 1)).alias("d")).first()
    assert roots.a == pytest.approx([2, 3]) and roots.b == [] and roots.c == [] and roots.d == pytest.approx([-1, -1], abs=1e-6)


def ring(*corners):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])


def test_clipping_and_centres(spark):
    box = [F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)]
    area = lambda *c: one(spark, geo.ring_area(geo.clip_box(ring(*c), *box)))
    assert area((-1, -1), (2, -1), (2, 2), (-1, 2)) == pytest.approx(1.0)
    assert area((0.5, -0.5), (1.5, 0.5), (0.5, 1.5), (-0.5, 0.5)) == pytest.approx(1.0)
    assert area((0, 0), (2, 0), (0, 2)) == pytest.approx(1.0) and area((0, 0), (1, 0), (0, 1)) == pytest.approx(0.5)
    assert one(spark, F.size(geo.clip_box(ring((2, 2), (3, 2), (3, 3)), *box))) == 0
    c = one(spark, geo.ring_centroid(ring((0, 0), (3, 0), (0, 6))))
    assert (c.x, c.y) == pytest.approx((1, 2)) and one(spark, geo.ring_centroid(ring((0, 0), (1, 1), (2, 2)))) is None


def test_utm_of_known_places(spark):
    places = [(-122.4194, 37.7749, 10, 551130.77, 4180998.88), (151.2093, -33.8688, 56, 334368.63, 6250948.35), (2.2945, 48.8583, 31, 448251.8, 5411943.8)]
    df = spark.createDataFrame([(lon, lat) for lon, lat, *_ in places], "x double, y double")
    zone = geo.utm_zone(F.col("x"))
    rows = df.select(zone.alias("zone"), geo.to_utm(F.col("x"), F.col("y"), zone)[0].alias("east"), geo.to_utm(F.col("x"), F.col("y"), zone)[1].alias("north")).collect()
    for r, (_, _, zone, east, north) in zip(rows, places, strict=True):
        assert r.zone == zone and r.east == pytest.approx(east, abs=1.0) and r.north == pytest.approx(north, abs=1.0)


def test_hulls(spark):
    rng = np.random.default_rng(2)
    xy = np.r_[rng.random((300, 2)), [[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0], [0, 0]]]
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in xy] + [(2, 5.0, 5.0), (2, 5.0, 5.0), (3, 0.0, 0.0), (3, 2.0, 2.0), (3, 1.0, 1.0), (4, None, 1.0)], "k bigint, x double, y double").repartition(5)
    got = {}
    for r in spatial.convex_hulls(df, "k").orderBy("k", "corner").collect():
        got.setdefault(r.k, []).append((r.x, r.y))
    assert got == {1: [(0, 0), (1, 0), (1, 1), (0, 1)], 2: [(5, 5)], 3: [(0, 0), (2, 2)]}


def test_tables(spark):
    base = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k bigint, l bigint, v string")
    changes = spark.createDataFrame([(1, 2, "x", 1), (1, 2, None, 2), (9, 9, "n", 1)], "k bigint, l bigint, v string, at int")
    assert sorted(map(tuple, analysis.upsert(base, changes, ["k", "l"], "at").collect())) == [(1, 1, "a"), (1, 2, None), (9, 9, "n")]
    rows = spark.createDataFrame([(1, 3, 0.3), (1, 1, None), (2, 1, 0.5)], "k bigint, o int, v double")
    assert {r.k: r.v for r in analysis.implode(rows, ["k"], "o", "v").collect()} == {1: [None, 0.3], 2: [0.5]}
    kinds = spark.createDataFrame([(x,) for x in (" True", "none", "-7", "2.5e3", "a1", ".", "")], "t string").select(analysis.typed_key(F.col("t")).alias("k"))
    assert [(r.k.kind, r.k.number) for r in kinds.collect()] == [("boolean", 1.0), ("null", None), ("bigint", -7.0), ("double", 2500.0), ("string", None), ("string", None), ("string", None)]


def test_closing_loops_and_random_improvement():
    rng = np.random.default_rng(3)
    xy = rng.random((25, 2))
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    tree, chords = design.close_loops(d, 4, 0.0)
    least = design.spanning_tree(d)
    assert {frozenset(e) for e in tree} == {frozenset(e) for e in least} and len(tree) == 24 and len(chords) == 4
    other, _ = design.close_loops(d, 0, 0.9, seed=5)
    assert sum(d[a, b] for a, b in other) >= sum(d[a, b] for a, b in tree) and len({n for e in other for n in e}) == 25
    # a path: one chord between its ends covers everything, the next are the first by their ends
    line = np.abs(np.arange(6)[:, None] - np.arange(6)[None, :]).astype(float)
    assert design.close_loops(line, 3, 0.0)[1] == [(0, 5), (0, 2), (0, 3)] and design.close_loops(line[:2, :2], 1)[1] == []
    added = design.random_improvement(dict.fromkeys(range(6), 2), [(0, 3), (0, 2), (1, 4), (2, 5), (3, 3)], [2, 3], 1)
    assert added == [(2, 0, 3), (3, 1, 4)]


def test_trees_of_codes_and_regular_graphs(spark):
    codes = spark.createDataFrame([(1, [3, 3, 3, 4]), (2, []), (3, None)], "graph_id bigint, code array<bigint>")
    got = {}
    for r in synthetic.trees_of_codes(codes).collect():
        got.setdefault(r.graph_id, set()).add((r.u, r.v))
    assert got == {1: {(0, 3), (1, 3), (2, 3), (3, 4), (4, 5)}, 2: {(0, 1)}}
    random_ones = synthetic.random_codes(spark, 4, 9, seed=2)
    assert synthetic.trees_of_codes(random_ones).count() == 4 * 8
    for n, degree in ((20, 3), (9, 4), (4, 3), (5, 0)):
        rows = [(r.u, r.v) for r in synthetic.random_regular(spark, n, degree, seed=1).collect()]
        assert len(set(rows)) == len(rows) == n * degree // 2 and all(u < v for u, v in rows)
        assert all(sum(x in e for e in rows) == degree for x in range(n))
    with pytest.raises(ValueError):
        synthetic.random_regular(spark, 5, 3)


def test_geojson_csv_and_legacy_files(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "s"}, "geometry": square}, {"type": "Feature", "geometry": None}]}))
    (tmp_path / "b.geojson").write_text(json.dumps(square))
    (tmp_path / "c.geojson").write_text("{ not json")
    rows = sorted((r.file[-9:], r.feature_no, len(spatial.polygons_of(r.geometry)), r.properties) for r in readers.read_geojson(spark, str(tmp_path)).collect())
    assert rows == [("a.geojson", 0, 1, '{"name":"s"}'), ("a.geojson", 1, 0, None), ("b.geojson", 0, 1, None)]
    df = spark.createDataFrame([(1, [0.5, 1.0], "x")], "k bigint, p array<double>, t string")
    readers.write_csv(df, str(tmp_path / "out"))
    back = readers.read_csv_tidy(spark, str(tmp_path / "out")).first()
    assert (back.k, json.loads(back.p), back.t) == ("1", [0.5, 1.0], "x")
    cell = json.dumps({"type": "Graph", "graph": {"nodes": [[0, {}]], "edges": [[[0, 1], {}]]}})
    readers.write_legacy(spark.createDataFrame([(cell,)], "cell string").coalesce(1), str(tmp_path / "old"))
    assert readers.read_legacy(spark, str(tmp_path / "old"), "edges").count() == 1


def test_draws_by_a_rule_are_uniform(spark):
    from gridloom.operators import simulation

    u = [r.u for r in spark.range(20000).select(simulation.arithmetic(F.lit(3), F.col("id") % 7, F.col("id")).alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.01 and math.isclose(np.var(u), 1 / 12, rel_tol=0.05)
