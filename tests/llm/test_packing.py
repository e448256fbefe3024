import math
import random

import pytest

from gridloom.llm import packing, tokens
from gridloom.llm.queries import QUERIES


def frame(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens int").selectExpr("*", "'x' as bin", "1 as part")


def check(rows, sizes, capacity):
    fills, pieces = {}, {}
    for r in rows:
        fills[r.bin] = fills.get(r.bin, 0) + r.tokens
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(sizes)
    for doc, parts in pieces.items():
        size = max(sizes[doc] or 0, 0)
        parts.sort(key=lambda r: r.piece)
        assert sum(p.tokens for p in parts) == size
        assert [p.start for p in parts] == [k * capacity for k in range(len(parts))] and len(parts) == max(1, math.ceil(size / capacity))
    assert all(f <= capacity for f in fills.values())
    assert all(fills[r.bin] == r.fill for r in rows)
    return fills


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("shape", ["tail", "halves", "tiny", "equal"])
def test_whole_items_and_little_room(spark, partitions, shape):
    rng = random.Random(1)
    sizes = {"tail": [min(int(rng.paretovariate(0.9) * 20), 3000) for _ in range(900)], "halves": [51] * 60 + [50] * 60, "tiny": [1] * 700, "equal": [60] * 90}[shape]
    rows = packing.pack(frame(spark, sizes), "doc_id", "tokens", 100, partitions).collect()
    fills = check(rows, dict(enumerate(sizes)), 100)
    least = {"tail": math.ceil(sum(sizes) / 100), "halves": 90, "tiny": 7, "equal": 90}[shape]
    assert least <= len(fills) <= least * 1.05 + (partitions > 1) * (partitions / 4 + 1)


def test_odd_sizes(spark):
    sizes = [None, -5, 0, 100, 101, 250, 1, 1]
    df = frame(spark, sizes)
    check(packing.pack(df, "doc_id", "tokens", 100, 2).collect(), dict(enumerate(sizes)), 100)
    assert packing.pack(df.where("false"), "doc_id", "tokens", 100, 2).count() == 0
    check(packing.pack(df.where("tokens = 0 or tokens is null"), "doc_id", "tokens", 100, 2).collect(), {0: None, 2: 0}, 100)
    twice = packing.pack(df.unionByName(df), "doc_id", "tokens", 100, 2).collect()
    assert len(twice) == 2 * len(packing.pack(df, "doc_id", "tokens", 100, 2).collect())


@pytest.mark.parametrize("n", [3000, 12000])
def test_no_partition_exceeds_its_maximum(spark, monkeypatch, n):
    monkeypatch.setattr(packing, "ITEMS", 500)
    monkeypatch.setattr(packing, "SMALLEST", 500)
    rng = random.Random(n)
    # a third of the rows has the same id
    rows = [(0 if i % 3 == 0 else i, rng.randint(1, 60)) for i in range(n)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, tokens int"), "doc_id", "tokens", 100).collect()
    assert sum(r.tokens for r in out) == sum(t for _, t in rows)
    held = {}
    for r in out:
        held[r.bin >> 40] = held.get(r.bin >> 40, 0) + 1
    assert len(held) == n // 500 and max(held.values()) <= 2 * 500
    assert len({r.bin for r in out}) <= sum(t for _, t in rows) / 100 * 1.02


def test_every_underfull_bin_can_be_a_host(spark):
    # each of 400 items of 51 needs a bin of its own; the items of 49 and less come last and must find them, whatever the partition
    sizes = [60] * 399 + [51] + [40] * 12
    rows = packing.pack(frame(spark, sizes), "doc_id", "tokens", 100, 16).collect()
    assert len(check(rows, dict(enumerate(sizes)), 100)) == 400
    hosts = [(i, 60, [i]) for i in range(400)] + [(900, 40, [900])]
    done, on = packing._pass_on(hosts, 100)
    assert len(on) == packing.FAN_IN + 1 and len(done) == 400 - packing.FAN_IN


def test_best_fit():
    fit = packing.BestFit(10)
    assert [fit.put(x) for x in (7, 5, 5, 3, 2)] == [0, 1, 1, 0, 2]
    assert fit.room == [0, 0, 8]


def test_whole_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    sizes = {r.doc_id: r.tokens for r in tokens.token_counts(docs).collect()}
    fills = check(QUERIES["p7_containers"](spark, medium).collect(), sizes, packing.CAPACITY)
    assert sum(sizes.values()) / (len(fills) * packing.CAPACITY) > 0.97
