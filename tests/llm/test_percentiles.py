import math
from datetime import date, datetime

import numpy as np
import pytest

from gridloom.llm import percentiles as pc

SERIES = "row_id bigint, graph_id bigint, r int, p double, t double, saidi double, run_day date, loaded_at timestamp, measure string"
SWEEP = "sweep_id bigint, graph_id bigint, rel array<double>, p array<double>, run_at timestamp, value string"


def rank_error(values, q, share):
    v = np.sort(values)
    want = max(1, math.ceil(share * len(v) - 1e-9))
    low, high = np.searchsorted(v, q, "left") + 1, np.searchsorted(v, q, "right")
    assert high >= low  # one of the values
    return max(0, low - want, want - high) / len(v)


@pytest.mark.parametrize("shape", ["sorted", "ties", "tail", "constant"])
@pytest.mark.parametrize("n", [1, 15, 16, 1000, 20_011])
def test_buffers_stay_within_their_bound(shape, n):
    rng = np.random.default_rng(n)
    values = {"sorted": np.arange(n) * 1.0, "ties": rng.integers(0, 5, n) * 1.0, "tail": rng.pareto(0.3, n), "constant": np.zeros(n)}[shape]
    parts = []
    for piece in np.array_split(values, 7):
        b = pc.Buffers(16)
        for x in np.array_split(piece, 3):
            b.add(x)
        parts.append(b.state())
    whole = pc.Buffers(16)
    for count, moved, part, levels, full in parts:
        whole.merge(count, moved, part, np.array(levels), full)
    count, moved, part, levels, full = whole.state()
    assert count == n and len(part) < 16 and len(full) == 16 * len(levels)
    assert len(part) + sum(16 * 2**x for x in levels) == n
    assert moved <= n * max(0, math.log2(max(n / 16, 1)) + 1) / 16
    for p, q in zip(pc.PERCENTILES, pc.quantiles(part, np.array(levels), full, np.array(pc.PERCENTILES) / 100, 16), strict=True):
        assert rank_error(values, q, p / 100) <= moved / n + 1e-12


def test_production_bound_is_below_one_per_cent():
    assert math.log2(1e15 / pc.K) / (2 * pc.K) < 0.01


def frames(spark, series, sweep=()):
    return spark.createDataFrame(list(series), SERIES), spark.createDataFrame(list(sweep), SWEEP)


def test_what_is_no_measurement(spark):
    day, at = date(2024, 1, 1), datetime(2024, 1, 1)
    values = [None, float("nan"), float("inf"), -float("inf"), -1.0, -0.0, 3.0, 3.0, 9.0]
    rows = [(i, 1, 0, None, 0.0, v, day, at, "x") for i, v in enumerate(values)]
    sweep = [(1, 1, [0.5, None, float("nan")], None, at, "y"), (2, None, None, [], at, "y"), (3, None, [7.0], [1.0], None, "y")]
    got = {(r.measure, r.period, r.graph_id, r.run_day): r for r in pc.percentiles_of(*frames(spark, [*rows, *rows], [*sweep, *sweep])).collect()}
    assert {k for k in got} == {("series.saidi", "day", 1, day), ("series.saidi", "all", 1, None), ("sweep.rel", "day", 1, day), ("sweep.rel", "all", 1, None)} | {(m, p, None, None) for m in ("sweep.rel", "sweep.p") for p in ("day", "all")}
    row = got["series.saidi", "day", 1, day]
    assert (row.n, row.p01, row.p50, row.p75, row.p99, row.max_rank_error) == (4, 0.0, 3.0, 3.0, 9.0, 0.0)
    assert got["sweep.p", "all", None, None].p50 == 1.0


def test_same_id_with_other_values_is_no_repeat(spark):
    day, at = date(2024, 1, 1), datetime(2024, 1, 1)
    rows = [(1, 1, 0, 1.0, 0.0, None, day, at, "x"), (1, 1, 1, 1.0, 0.0, None, day, at, "x"), (None, 1, 1, 1.0, 0.0, None, day, at, "x"), (None, 1, 1, 1.0, 0.0, None, day, at, "x")]
    got = pc.percentiles_of(*frames(spark, rows)).collect()
    assert {(r.period, r.n) for r in got} == {("day", 3), ("all", 3)}


def test_empty_tables(spark):
    assert pc.percentiles_of(*frames(spark, [])).count() == 0


@pytest.mark.parametrize("k", [8, 2048])
def test_against_sorting_with_a_hot_day(spark, small, k):
    series, sweep = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("series", "sweep"))
    hot = series.where("graph_id = 7").selectExpr("row_id + 1000000 row_id", "graph_id", "r", "p", "t", "saidi", "date'2024-05-05' run_day", "loaded_at")
    series = series.unionByName(hot)
    got = {(r.measure, r.graph_id, r.run_day): r for r in pc.percentiles_of(series, sweep, k).collect()}
    held = {}
    for r in series.dropDuplicates().collect():
        for name in ("saidi", "p"):
            held.setdefault((f"series.{name}", r.graph_id, r.run_day), []).append(r[name])
            held.setdefault((f"series.{name}", r.graph_id, None), []).append(r[name])
    for r in sweep.dropDuplicates().collect():
        for name in ("rel", "p"):
            for v in r[name] or []:
                held.setdefault((f"sweep.{name}", r.graph_id, r.run_at.date()), []).append(v)
                held.setdefault((f"sweep.{name}", r.graph_id, None), []).append(v)
    held = {key: [v for v in x if v is not None and 0 <= v < math.inf] for key, x in held.items()}
    held = {key: np.array(x) for key, x in held.items() if x}
    assert set(got) == set(held)
    for key, row in got.items():
        assert row.n == len(held[key])
        for p in pc.PERCENTILES:
            assert rank_error(held[key], row[f"p{p:02d}"], p / 100) <= row.max_rank_error + 1e-12
    if k == 2048:
        assert max(r.max_rank_error for r in got.values()) <= 0.01


def test_hot_days_get_more_salts(spark, monkeypatch):
    monkeypatch.setattr(pc, "ROWS_PER_SALT", 10)
    monkeypatch.setattr(pc, "COUNTED", 1)
    day, at = date(2024, 1, 1), datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 else i, 0, float(i), 0.0, 1.0, day, at, "x") for i in range(3000)]
    series, sweep = frames(spark, [*rows, (None, None, 0, 1.0, 0.0, 1.0, None, at, "x")])
    assert [tuple(r) for r in pc.hot_groups(series, ["graph_id", "run_day"], "row_id").collect()] == [(1, day, 200)]
    got = {(r.measure, r.graph_id): r for r in pc.percentiles_of(series, sweep).where("period = 'all'").collect()}
    assert got["series.p", 1].n == 2000 and got["series.p", 1].p50 == 1499.0 and got["series.p", None].n == 1


def test_sketches_of_a_hot_group_are_combined_as_they_come(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pc, "HELD_ROWS", 4)
    values = np.random.default_rng(1).permutation(6400) * 1.0
    names = ["graph_id", "n", "moved", "part", "levels", "full"]
    batches = []
    for piece in np.array_split(values, 100):
        b = pc.Buffers(16)
        b.add(piece)
        n, moved, part, levels, full = b.state()
        batches.append(pa.RecordBatch.from_arrays([pa.array([7]), pa.array([n]), pa.array([moved]), pa.array([part.tolist()], pa.list_(pa.float64())), pa.array([levels], pa.list_(pa.int32())), pa.array([full.tolist()], pa.list_(pa.float64()))], names=names))
    seen = [t.num_rows for t in pc._runs(iter(batches), ["graph_id"], 16)]
    assert sum(seen) <= 8
    out = pa.Table.from_batches(list(pc._merge(["graph_id"], 16)(iter(batches)))).to_pylist()
    assert len(out) == 1 and out[0]["n"] == 6400
    row = out[0]
    for p, q in zip(pc.PERCENTILES, pc.quantiles(np.array(row["part"]), np.array(row["levels"]), np.array(row["full"]), np.array(pc.PERCENTILES) / 100, 16), strict=True):
        assert rank_error(values, q, p / 100) <= row["moved"] / 6400
