"""Points near other points, and the regions that contain them (problem 5).

A sample of the positions makes a quadtree whose leaves hold at most about ``leaf_points`` points: the sample grows with
the points (``SAMPLE_PER_LEAF`` of each leaf's), it is counted per cell and level by aggregations, and only the cells that
are to be split reach the driver. Every point goes to the leaf it lies in and, as a
replica, to each leaf that its surrounding box of the given distance touches;
every region goes to the leaves that its bounds touch. A leaf is one group: an
R-tree is packed over its points (on the unit sphere, so that neither the date
line nor a pole is special), pairs of tree nodes are descended, and candidate
pairs are refined by their great-circle distance. A pair is emitted only in the
leaf that holds its reference point, the position of the smaller id.

A leaf that cannot be split further (many points in one place) is divided by
the probing points: each part holds all points of the leaf but probes with its own. Over ``MAX_LEAVES * leaf_points``
points the leaves grow with the points, so that the tree that every task gets stays small.

Defined results for odd input: positions that are null, NaN, infinite,
exactly (0, 0) or outside the ranges are unknown and give no row; repeated rows
count once; ids that are null are left out; regions that are null, unreadable
or without area contain nothing; rings close themselves, holes are outside,
of a third coordinate and of points and lines nothing is taken.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

EARTH_M = 6_371_008.8
LEAF_POINTS = 10_000
#: Points of a leaf that are in the sample: a leaf's estimate is off by a tenth on average, so leaves stay below twice ``leaf_points``.
SAMPLE_PER_LEAF = 128
MAX_LEAVES = 100_000
MAX_LEVEL = 17
LEAF_ENTRIES = 16
#: Places of the grid over a surrounding box that is larger than the finest leaf.
GRID_PLACES = 256


# --- regions -----------------------------------------------------------------


def polygons_of(geometry: object, depth: int = 0) -> list[list[np.ndarray]]:
    """The polygons of a GeoJSON value in any wrapping: lists of rings, the outer one first."""
    if depth > 50 or geometry is None:
        return []
    if isinstance(geometry, str):
        try:
            return polygons_of(json.loads(geometry), depth + 1)
        except (ValueError, RecursionError):
            return []
    if isinstance(geometry, list):
        return _from_coordinates(geometry)
    if not isinstance(geometry, dict):
        return []
    kind = geometry.get("type")
    if kind == "Feature" or (kind is None and "geometry" in geometry):
        return polygons_of(geometry.get("geometry"), depth + 1)
    if kind == "FeatureCollection" or (kind is None and "features" in geometry):
        return [p for f in geometry.get("features") or [] for p in polygons_of(f, depth + 1)]
    if kind == "GeometryCollection" or (kind is None and "geometries" in geometry):
        return [p for g in geometry.get("geometries") or [] for p in polygons_of(g, depth + 1)]
    if kind in ("Polygon", "MultiPolygon", None):
        return _from_coordinates(geometry.get("coordinates"))
    return []


def _levels(value: object) -> int:
    n = 0
    while isinstance(value, list):
        n += 1
        value = next((x for x in value if x is not None), None)
    return n


def _from_coordinates(value: object) -> list[list[np.ndarray]]:
    n = _levels(value)
    if n == 3:
        value = [value]
    elif n != 4:
        return []
    found = []
    for polygon in value:
        rings = [r for r in map(_ring, polygon or []) if r is not None]
        if polygon and _ring(polygon[0]) is not None:
            found.append(rings)
    return found


def _ring(points: object) -> np.ndarray | None:
    try:
        ring = np.array([(float(p[0]), float(p[1])) for p in points or []], dtype=float)
    except (TypeError, ValueError, IndexError):
        return None
    if len(ring) < 3 or not np.isfinite(ring).all():
        return None
    x, y = (ring - ring.mean(axis=0)).T
    area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    return ring if area > 0 else None


def in_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of many points against one ring that closes itself."""
    inside = np.zeros(len(x), dtype=bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if ay != by:
            crosses = (ay > y) != (by > y)
            inside ^= crosses & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def contains(x: np.ndarray, y: np.ndarray, polygon: list[np.ndarray]) -> np.ndarray:
    inside = in_ring(x, y, polygon[0])
    for hole in polygon[1:]:
        inside &= ~in_ring(x, y, hole)
    return inside


# --- quadtree ----------------------------------------------------------------


class QuadTree:
    """Leaves as spans of Morton codes at the finest level, over longitude and latitude."""

    def __init__(self, dense: dict[tuple[int, int], float], capacity: float, max_level: int = MAX_LEVEL):
        """``dense``: ``(level, cell)`` of the cells that hold more than ``capacity``, with what they hold; those below ``max_level`` are split."""
        self.max_level = max_level
        leaves: list[tuple[int, int, float]] = []
        stack = [(0, 0)]
        while stack:
            level, cell = stack.pop()
            if level < max_level and (level, cell) in dense:
                stack += [(level + 1, 4 * cell + k) for k in range(4)]
            else:
                leaves.append((cell * 4 ** (max_level - level), level, dense.get((level, cell), 0.0)))
        leaves.sort()
        self.finest = max(level for _, level, _ in leaves)
        self.starts = np.array([s for s, _, _ in leaves], dtype=np.int64)
        self.parts = np.array([max(1, math.ceil(n / (2 * capacity))) for _, _, n in leaves], dtype=np.int64)
        cells = [self._cell(s, level) for s, level, _ in leaves]
        self.west, self.south, self.east, self.north = np.array(cells).T

    def _cell(self, start: int, level: int) -> tuple[float, float, float, float]:
        ix = iy = 0
        for b in range(self.max_level):
            ix |= (start >> (2 * b) & 1) << b
            iy |= (start >> (2 * b + 1) & 1) << b
        w, h = 360 / 2**level, 180 / 2**level
        x, y = ix * 360 / 2**self.max_level - 180, iy * 180 / 2**self.max_level - 90
        return x, y, x + w, y + h

    def code(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = 2**self.max_level
        ix = np.clip(np.floor((x + 180) / 360 * n), 0, n - 1).astype(np.int64)
        iy = np.clip(np.floor((y + 90) / 180 * n), 0, n - 1).astype(np.int64)
        out = np.zeros(len(ix), dtype=np.int64)
        for b in range(self.max_level):
            out |= (ix >> b & 1) << (2 * b) | (iy >> b & 1) << (2 * b + 1)
        return out

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.code(x, y), side="right") - 1

    def touching(self, west: float, south: float, east: float, north: float) -> np.ndarray:
        return np.flatnonzero((self.west <= east) & (self.east >= west) & (self.south <= north) & (self.north >= south))

    def homes(self, x: np.ndarray, y: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(point, leaf, is_home)``: the leaf of each point and those that its surrounding box touches."""
        home = self.leaf(x, y)
        dy = np.degrees(metres / EARTH_M) * 1.001 + 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.sin(metres / EARTH_M) / np.cos(np.radians(y))
            dx = np.where(np.abs(y) + dy >= 90, 180.0, np.degrees(np.arcsin(np.clip(reach, 0, 1)))) * 1.001 + 1e-9
        # every leaf is at least as large as the finest one, so a grid of that width meets each leaf that a box touches
        nx, ny = np.ceil(2 * dx / (360 / 2**self.finest)).astype(np.int64), math.ceil(2 * dy / (180 / 2**self.finest))
        fine = (nx + 1) * (ny + 1) <= GRID_PLACES
        points, leaves = [np.arange(len(x))], [home]
        for width in np.unique(nx[fine]):
            at = np.flatnonzero(fine & (nx == width))
            for sx in np.linspace(-1, 1, width + 1):
                for sy in np.linspace(-1, 1, ny + 1):
                    cx = (x[at] + sx * dx[at] + 180) % 360 - 180
                    points.append(at)
                    leaves.append(self.leaf(cx, np.clip(y[at] + sy * dy, -90, 90)))
        for k in np.flatnonzero(~fine):
            for shift in (-360, 0, 360):
                found = self.touching(x[k] - dx[k] + shift, y[k] - dy, x[k] + dx[k] + shift, y[k] + dy)
                points.append(np.full(len(found), k))
                leaves.append(found)
        # both sides of the date line are the same place
        edge = np.flatnonzero(np.abs(np.abs(x) - 180) <= dx)
        for side in (-180.0, 180.0):
            for sy in (-1, 0, 1):
                points.append(edge)
                leaves.append(self.leaf(np.full(len(edge), side), np.clip(y[edge] + sy * dy, -90, 90)))
        pair = np.unique(np.stack([np.concatenate(points), np.concatenate(leaves)]), axis=1)
        return pair[0], pair[1], home[pair[0]] == pair[1]


# --- R-tree ------------------------------------------------------------------


class RTree:
    """Bulk-loaded by sort-tile-recursion: ``order`` lists the points leaf by leaf, ``levels`` the boxes from the leaves up."""

    def __init__(self, points: np.ndarray, entries: int = LEAF_ENTRIES):
        self.points, self.entries = points, entries
        self.order = self._tile(points, entries)
        sorted_points = points[self.order]
        low, high = self._boxes(sorted_points, sorted_points)
        self.levels = [(low, high)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._boxes(*self.levels[-1]))

    @staticmethod
    def _tile(points: np.ndarray, entries: int) -> np.ndarray:
        n, dims = points.shape
        if n == 0:
            return np.zeros(0, dtype=np.int64)
        parts = [np.arange(n)]
        for d in range(dims):
            following = []
            for part in parts:
                part = part[np.argsort(points[part, d], kind="stable")]
                pages = max(1, math.ceil(len(part) / entries))
                slabs = math.ceil(pages ** (1 / (dims - d))) if d < dims - 1 else 1
                size = max(entries, math.ceil(pages / slabs) * entries)
                following += [part[k : k + size] for k in range(0, len(part), size)]
            parts = following
        return np.concatenate(parts)

    def _boxes(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(low), self.entries)
        return (np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)) if len(low) else (low, high)


def rtree_join(probe: RTree, index: RTree, reach: float, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points of both trees at most ``reach`` apart (straight line), in blocks."""
    if not len(probe.points) or not len(index.points):
        return
    n, m = probe.entries, index.entries

    def close(a: RTree, la: int, i: np.ndarray, b: RTree, lb: int, j: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, np.maximum(b.levels[lb][0][j] - a.levels[la][1][i], a.levels[la][0][i] - b.levels[lb][1][j]))
        return (gap * gap).sum(axis=1) <= reach * reach

    stack = [(len(probe.levels) - 1, len(index.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        keep = close(probe, la, i, index, lb, j)
        i, j = i[keep], j[keep]
        if len(i) > block:
            stack += [(la, lb, i[k : k + block], j[k : k + block]) for k in range(0, len(i), block)]
            continue
        if not len(i):
            continue
        if la == 0 and lb == 0:
            a = (i[:, None, None] * n + np.arange(n)[None, :, None]).repeat(m, axis=2).ravel()
            b = (j[:, None, None] * m + np.arange(m)[None, None, :]).repeat(n, axis=1).ravel()
            there = (a < len(probe.order)) & (b < len(index.order))
            a, b = probe.order[a[there]], index.order[b[there]]
            d = probe.points[a] - index.points[b]
            near = (d * d).sum(axis=1) <= reach * reach
            if near.any():
                yield a[near], b[near]
            continue
        # the higher node is opened; of equal levels both
        if la >= lb:
            size = len(probe.levels[la - 1][0])
            child = (i[:, None] * n + np.arange(n)).ravel()
            i, j = child[child < size], j.repeat(n)[child < size]
        if lb >= la:
            size = len(index.levels[lb - 1][0])
            child = (j[:, None] * m + np.arange(m)).ravel()
            i, j = i.repeat(m)[child < size], child[child < size]
        stack.append((la - (la >= lb), lb - (lb >= la), i, j))


def on_sphere(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(x), np.radians(y)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def great_circle(x1, y1, x2, y2) -> np.ndarray:
    lat1, lat2 = np.radians(y1), np.radians(y2)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(np.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


# --- operator ----------------------------------------------------------------


def known_position(x: Column, y: Column) -> Column:
    fine = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & x.between(-180, 180) & y.between(-90, 90)
    return fine & ~((x == 0) & (y == 0))


_PLACED = "leaf bigint, part bigint, role int, id bigint, x double, y double, shape string"
_OUT = pa.schema([("kind", pa.string()), ("id_a", pa.int64()), ("id_b", pa.int64())])


def _place_points(tree: QuadTree, metres: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            ids, x, y = b["id"].to_numpy(np.int64), b["x"].to_numpy(float), b["y"].to_numpy(float)
            point, leaf, home = tree.homes(x, y, metres)
            parts = tree.parts[leaf]
            own = (ids[point] * 2654435761 >> 7) % parts  # the part of the leaf in which a point probes
            n = np.repeat(np.arange(len(point)), parts)
            part = np.arange(len(n)) - np.repeat(np.cumsum(parts) - parts, parts)
            role = np.where(home[n] & (own[n] == part), 0, 1)
            yield pd.DataFrame({"leaf": leaf[n], "part": part, "role": role.astype(np.int32), "id": ids[point][n], "x": x[point][n], "y": y[point][n], "shape": None})

    return run


def _place_regions(tree: QuadTree):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["id"], b["shape"], strict=True):
                for polygon in polygons_of(text):
                    (west, south), (east, north) = polygon[0].min(axis=0), polygon[0].max(axis=0)
                    leaves = tree.touching(west, south, east, north)
                    parts = tree.parts[leaves]
                    n = np.repeat(np.arange(len(leaves)), parts)
                    part = np.arange(len(n)) - np.repeat(np.cumsum(parts) - parts, parts)
                    shape = json.dumps([r.tolist() for r in polygon])
                    yield pd.DataFrame({"leaf": leaves[n], "part": part, "role": np.int32(2), "id": np.int64(key), "x": 0.0, "y": 0.0, "shape": shape})

    return run


def _search(metres: float):
    reach = 2 * math.sin(metres / EARTH_M / 2) * (1 + 1e-6) + 1e-12

    def rows(kind: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        role = t["role"].to_numpy()
        ids, x, y = (t[c].to_numpy() for c in ("id", "x", "y"))
        points = np.flatnonzero(role < 2)
        # repeated rows: one of each id, the probing one first
        points = points[np.lexsort((role[points], ids[points]))]
        points = points[np.r_[True, ids[points][1:] != ids[points][:-1]]] if len(points) else points
        pid, px, py, probes = ids[points], x[points], y[points], role[points] == 0
        own = np.flatnonzero(probes)
        xyz = on_sphere(px, py)
        if len(own) and len(points) > 1:
            for a, b in rtree_join(RTree(xyz[own]), RTree(xyz), reach):
                a = own[a]
                first = pid[a] < pid[b]
                a, b = a[first], b[first]
                close = great_circle(px[a], py[a], px[b], py[b]) <= metres
                if close.any():
                    yield rows("near", pid[a[close]], pid[b[close]])
        if len(own):
            ox, oy, oid = px[own], py[own], pid[own]
            by_x = np.argsort(ox, kind="stable")
            found: dict[int, list[np.ndarray]] = {}
            for k in np.flatnonzero(role == 2):
                polygon = [np.array(r) for r in json.loads(t["shape"][int(k)].as_py())]
                (west, south), (east, north) = polygon[0].min(axis=0), polygon[0].max(axis=0)
                inside = by_x[np.searchsorted(ox[by_x], west) : np.searchsorted(ox[by_x], east, side="right")]
                inside = inside[(oy[inside] >= south) & (oy[inside] <= north)]
                if len(inside):
                    inside = inside[contains(ox[inside], oy[inside], polygon)]
                    found.setdefault(int(ids[k]), []).append(oid[inside])
            for key, parts in found.items():
                held = np.unique(np.concatenate(parts))
                if len(held):
                    yield rows("in", held, np.full(len(held), key))

    return run


def _spread_bits(v: Column) -> Column:
    """A zero between all bits of a number of up to 32."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def morton(x: Column, y: Column, level: int = MAX_LEVEL) -> Column:
    """The cell of a position at ``level``; that of the level above is its quarter."""
    n = 2**level
    at = lambda v, low, width: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v + F.lit(low)) / F.lit(width) * F.lit(n)))).cast("bigint")
    return _spread_bits(at(x, 180.0, 360.0)).bitwiseOR(F.shiftleft(_spread_bits(at(y, 90.0, 180.0)), 1))


def plan_tree(points: DataFrame, leaf_points: int = LEAF_POINTS, max_level: int = MAX_LEVEL) -> QuadTree:
    """The quadtree of a sample of the positions; the sample only sets the leaves."""
    share = min(1.0, SAMPLE_PER_LEAF / leaf_points)
    sample = points if share == 1.0 else points.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    cells = cut(sample.select(morton(F.col("x"), F.col("y"), max_level).alias("cell")).groupBy("cell").agg((F.count("*") / F.lit(share)).alias("held")))
    total = cells.agg(F.sum("held")).first()[0] or 0.0
    capacity = max(float(leaf_points), total / MAX_LEAVES)
    if total <= capacity:
        return QuadTree({}, capacity, max_level)
    above = F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("level")
    levels = cells.select("cell", "held", above).groupBy("level", F.expr(f"shiftright(cell, 2 * ({max_level} - level))").alias("cell")).agg(F.sum("held").alias("held"))
    # at most one cell in capacity / level holds more than the capacity, so this is bounded by MAX_LEAVES and the levels
    dense = levels.where(F.col("held") > capacity).collect()
    return QuadTree({(r.level, r.cell): r.held for r in dense}, capacity, max_level)


def near_and_in(points: DataFrame, regions: DataFrame | None, metres: float, leaf_points: int = LEAF_POINTS, max_level: int = MAX_LEVEL) -> DataFrame:
    """``kind, id_a, id_b``: ``near`` pairs of ``points`` (``id, x, y``), and ``in`` rows of a point and a region (``id, shape``)."""
    fine = points.where(known_position(F.col("x"), F.col("y")) & F.col("id").isNotNull()).select("id", "x", "y")
    tree = plan_tree(fine, leaf_points, max_level)
    placed = fine.mapInPandas(_place_points(tree, metres), _PLACED)
    if regions is not None:
        placed = placed.unionByName(regions.where("shape is not null and id is not null").select(F.col("id").cast("bigint"), "shape").mapInPandas(_place_regions(tree), _PLACED))
    # one row set per leaf and part; a region given twice or in touching parts counts once
    return placed.groupBy("leaf", "part").applyInArrow(_by_batches(_search(metres)), "kind string, id_a bigint, id_b bigint")


def _by_batches(search):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search(batches)

    return run


# --- hulls ---------------------------------------------------------------------


def hull_of(xy: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull, counterclockwise from the lowest x; of equal points one, none within an edge."""
    order = np.lexsort((xy[:, 1], xy[:, 0])).tolist()

    def half(places: list[int]) -> list[int]:
        out: list[int] = []
        for i in places:
            if out and (xy[out[-1]] == xy[i]).all():
                continue
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = xy[out[-2]], xy[out[-1]], xy[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    low, high = half(order), half(order[::-1])
    return np.array(low[:-1] + high[:-1] if len(low) > 1 else low, dtype=np.int64)


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """``key, corner, x, y``: the hull of each group of ``points`` (``key, x, y``), corners counted from 0.

    Each task first cuts its own points down to their hulls, so a group of any size meets as a few corners.
    """
    kind = points.schema[key].dataType.simpleString()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for k, rows in b.groupby(key, dropna=False):
                xy = rows[["x", "y"]].to_numpy(float)
                xy = np.concatenate([held[k], xy]) if k in held else xy
                held[k] = xy[hull_of(xy)]
        for k, xy in held.items():
            yield pd.DataFrame({key: k, "x": xy[:, 0], "y": xy[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x", "y"]].to_numpy(float)
        xy = xy[hull_of(xy)]
        return pd.DataFrame({key: pdf[key].iloc[0], "corner": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})

    fine = points.select(key, F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return fine.mapInPandas(local, f"`{key}` {kind}, x double, y double").groupBy(key).applyInPandas(whole, f"`{key}` {kind}, corner int, x double, y double")
