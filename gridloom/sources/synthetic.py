"""Synthetic graphs and points from ranges and arithmetic."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.simulation import uniform


def path(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(n - 1, 0)).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))


def cycle(spark: SparkSession, n: int) -> DataFrame:
    last = spark.range(1).select(F.lit(0).cast("bigint").alias("u"), F.lit(n - 1).cast("bigint").alias("v")).where(F.lit(n > 2))
    return path(spark, n).unionByName(last)


def star(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n).select(F.lit(0).cast("bigint").alias("u"), F.col("id").alias("v"))


def complete(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("u"), F.explode(F.when(F.col("id") + 1 < n, F.sequence(F.col("id") + 1, F.lit(n - 1).cast("bigint")))).alias("v"))


def balanced_tree(spark: SparkSession, branching: int, height: int) -> DataFrame:
    n = sum(branching**k for k in range(height + 1))
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / branching).alias("u"), F.col("id").alias("v"))


def random_tree(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Each node hangs on a random earlier one."""
    return spark.range(1, n).select(F.floor(uniform("id", seed=seed) * F.col("id")).alias("u"), F.col("id").alias("v"))


def trees_of_codes(codes: DataFrame) -> DataFrame:
    """``graph_id, u, v``: the labelled trees of Pruefer codes (``graph_id, code array<bigint>``), of nodes from 0 to the length of the code plus one."""

    def run(batches):
        for pdf in batches:
            for graph, code in zip(pdf.graph_id, pdf.code, strict=True):
                code = [int(x) for x in code]
                degree = [1] * (len(code) + 2)
                for x in code:
                    degree[x] += 1
                leaves = [n for n, d in enumerate(degree) if d == 1]
                heapq.heapify(leaves)
                rows = []
                for x in code:
                    rows.append((graph, *sorted((heapq.heappop(leaves), x))))
                    degree[x] -= 1
                    if degree[x] == 1:
                        heapq.heappush(leaves, x)
                rows.append((graph, *sorted((heapq.heappop(leaves), heapq.heappop(leaves)))))
                yield pd.DataFrame(rows, columns=["graph_id", "u", "v"])

    return codes.select(F.col("graph_id").cast("bigint").alias("graph_id"), F.col("code").cast("array<bigint>").alias("code")).where("code is not null").mapInPandas(run, "graph_id bigint, u bigint, v bigint")


def random_codes(spark: SparkSession, graphs: int, n: int, seed: int = 0) -> DataFrame:
    """Codes of uniformly random labelled trees of ``n`` nodes."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(max(n - 2, 1))), lambda k: F.floor(uniform("graph_id", k, seed=seed) * n))
    return spark.range(graphs).select(F.col("id").alias("graph_id")).select("graph_id", F.slice(digits, 1, n - 2).alias("code"))


def random_regular(spark: SparkSession, n: int, degree: int, seed: int = 0) -> DataFrame:
    """A simple graph in which each of ``n`` nodes has ``degree`` neighbours: ends are paired at random, and pairs that
    are loops or doubles exchange ends with random others until there are none. One graph is one task.
    """
    if n * degree % 2 or degree >= n or degree < 0:
        raise ValueError("n times the degree must be even, and the degree below n")

    def run(batches):
        for _ in batches:
            rng = np.random.default_rng(seed)
            while True:
                ends = rng.permutation(np.repeat(np.arange(n), degree)).reshape(-1, 2)
                for _ in range(200 * len(ends) + 1):
                    key = np.sort(ends, axis=1)
                    order = np.lexsort(key.T)
                    double = np.zeros(len(ends), dtype=bool)
                    double[order[1:]] = (key[order[1:]] == key[order[:-1]]).all(axis=1)
                    bad = np.flatnonzero(double | (ends[:, 0] == ends[:, 1]))
                    if not len(bad):
                        yield pd.DataFrame(key, columns=["u", "v"])
                        return
                    other = rng.integers(0, len(ends), len(bad))
                    for i, j in zip(bad, other, strict=True):
                        ends[i, 1], ends[j, 1] = ends[j, 1], ends[i, 1]

    return spark.range(1, numPartitions=1).mapInPandas(run, "u bigint, v bigint")


def points(spark: SparkSession, n: int, width: float = 1.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (uniform("id", F.lit("x"), seed=seed) * width).alias("x"), (uniform("id", F.lit("y"), seed=seed) * width).alias("y"))
