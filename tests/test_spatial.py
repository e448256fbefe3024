import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import spatial
from gridloom.plans import problems


def near_brute(ids, x, y, metres):
    out = set()
    for i in range(len(ids)):
        d = spatial.great_circle(x[i], y[i], x, y)
        for j in np.flatnonzero(d <= metres):
            if ids[i] < ids[j]:
                out.add((int(ids[i]), int(ids[j])))
    return out


def frame(spark, points):
    return spark.createDataFrame([(int(i), x, y, "k") for i, x, y in points], "id bigint, x double, y double, leaf string")


def test_whole_table(spark, medium):
    rows = {r.node_id: r.pos for r in spark.read.parquet(f"{medium}/nodes.parquet").collect() if r.pos is not None}
    fine = {k: p for k, p in rows.items() if p.x is not None and p.y is not None and abs(p.x) <= 180 and abs(p.y) <= 90 and (p.x, p.y) != (0, 0)}
    ids = np.array(sorted(fine))
    x, y = np.array([fine[k].x for k in ids]), np.array([fine[k].y for k in ids])
    want = {("near", a, b) for a, b in near_brute(ids, x, y, 25.0)}
    for box in spark.read.parquet(f"{medium}/boxes.parquet").collect():
        for polygon in spatial.polygons_of(box.geometry):
            want |= {("in", int(k), box.box_id) for k in ids[spatial.contains(x, y, polygon)]}
    got = [tuple(r) for r in problems.p5_found(spark, medium).collect()]
    assert set(got) == want and len(got) == len(set(got))
    assert {k for k, _, _ in got} == {"near", "in"}


@pytest.mark.parametrize("leaf_points", [3, 40])
def test_seams_poles_and_ties(spark, leaf_points):
    rng = np.random.default_rng(3)
    step = math.degrees(25 / spatial.EARTH_M)
    points = []
    for cx, cy in [(180, 10), (-180, 10), (0, 90), (120, 90), (0, -90), (30, 89.9995), (0.001, 0), (45, 0), (-90, 45), (90, -85)]:
        for _ in range(12):
            y = float(np.clip(cy + rng.normal(0, step), -90, 90))
            x = cx + rng.normal(0, step) / max(math.cos(math.radians(y)), 1e-4)
            points.append(((x + 180) % 360 - 180, y))
    points += [(5.0, 5.0)] * 30 + [(180.0, 20.0), (-180.0, 20.0), (180.0, -90.0), (7.0, -90.0)]
    ids = np.arange(len(points))
    x, y = np.array(points).T
    want = near_brute(ids, x, y, 25.0)
    df = frame(spark, [(i, float(a), float(b)) for i, a, b in zip(ids, x, y, strict=True)])
    got = [(r.id_a, r.id_b) for r in spatial.near_and_in(df.unionByName(df), None, 25.0, leaf_points=leaf_points).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_unknown_positions(spark):
    odd = [(1, None, 1.0), (2, float("nan"), 1.0), (3, 0.0, 0.0), (4, 999.0, 999.0), (5, 10.0, 97.5), (6, float("inf"), 0.0), (7, 0.0, 1.0), (8, 0.0, 1.0)]
    got = spatial.near_and_in(frame(spark, odd), None, 25.0).collect()
    assert [tuple(r) for r in got] == [("near", 7, 8)]
    assert spatial.near_and_in(frame(spark, odd).where("false"), None, 25.0).count() == 0


SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10]]
HOLE = [[4, 4, 9.5], [6, 4, 1], [6, 6, 1], [4, 6, 1], [4, 4, 1]]
POLYGON = {"type": "Polygon", "coordinates": [SQUARE, HOLE]}


@pytest.mark.parametrize(
    ("shape", "want"),
    [
        (POLYGON, {1}), ({"coordinates": [SQUARE, HOLE]}, {1}), ([SQUARE], {1, 2}), (json.dumps(POLYGON), {1}),
        ({"type": "Feature", "geometry": POLYGON}, {1}), ({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": POLYGON}, {"type": "Feature", "geometry": None}]}, {1}),
        ({"type": "GeometryCollection", "geometries": [POLYGON, {"type": "Point", "coordinates": [5, 5]}, {"type": "Polygon", "coordinates": [SQUARE]}]}, {1, 2}),
        ({"type": "MultiPolygon", "coordinates": [[SQUARE], [[[20, 20], [30, 20], [30, 30]]]]}, {1, 2, 3}),
        ({"type": "LineString", "coordinates": SQUARE}, set()), ({"type": "Polygon", "coordinates": []}, set()), ({"type": "Polygon", "coordinates": [[[0, 0], [5, 5], [10, 10]]]}, set()), (None, set()), ("nope", set()),
    ],
)
def test_region_forms(spark, shape, want):
    points = frame(spark, [(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 28.0, 22.0), (4, 11.0, 5.0)])
    regions = spark.createDataFrame([(7, shape if shape is None or isinstance(shape, str) else json.dumps(shape))], "id bigint, shape string")
    got = [tuple(r) for r in spatial.near_and_in(points, regions, 25.0, leaf_points=1).collect()]
    assert sorted(got) == sorted(("in", k, 7) for k in want)


@pytest.mark.parametrize("n", [4000, 40000])
def test_leaves_stay_below_their_maximum(spark, n):
    rng = np.random.default_rng(n)
    where = rng.normal([[10, 50]], [[2, 1]], (n, 2))
    where[: n // 3] = rng.normal([[-70, -30]], [[1e-4, 1e-4]], (n // 3, 2))  # a third in one small place
    df = frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(where)])
    tree = spatial.plan_tree(df, leaf_points=200)
    held = np.bincount(tree.leaf(*where.T), minlength=len(tree.starts))
    level_17 = (tree.east - tree.west) < 360 / 2**16
    assert held[~level_17].max() <= 400 and (held[level_17] <= 2 * 2 * 200 * tree.parts[level_17]).all()
    assert len(tree.starts) > n / 400


def test_codes_agree(spark):
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate([(-180, -90), (180, 90), (0.1, 0.1), (-33.3, 71.2), (179.9999, -89.9999)])]
    got = {r.id: r.code for r in frame(spark, points).select("id", spatial.morton(F.col("x"), F.col("y")).alias("code")).collect()}
    tree = spatial.QuadTree({}, 1.0)
    _, x, y = np.array(points).T
    assert [got[i] for i in range(len(points))] == tree.code(x, y).tolist()


def test_distances_larger_than_leaves(spark):
    rng = np.random.default_rng(8)
    ids = np.arange(300)
    x, y = rng.uniform(-180, 180, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))
    got = [(r.id_a, r.id_b) for r in spatial.near_and_in(frame(spark, list(zip(ids, x.tolist(), y.tolist(), strict=True))), None, 900_000.0, leaf_points=2).collect()]
    assert len(got) == len(set(got)) and set(got) == near_brute(ids, x, y, 900_000.0)
