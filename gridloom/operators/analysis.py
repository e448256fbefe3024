"""Analysis of sweeps and series: crossings, fits, ranks, resampling, renewal processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut


def finite(*columns: str) -> Column:
    test = F.lit(True)
    for c in columns:
        v = F.col(c)
        test = test & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return test


def explode_pairs(sweep: DataFrame, *keys: str) -> DataFrame:
    """A row per entry of the aligned arrays ``p`` and ``rel``; entries that are not finite are left out."""
    rows = sweep.select(*keys, F.inline(F.arrays_zip(F.col("p"), F.col("rel"))))
    return rows.withColumnRenamed("rel", "f").where(finite("p", "f"))


def crossing(rows: DataFrame, keys: list[str], x: str, f: str, p: str, skip: int = 0) -> DataFrame:
    """``keys, crossing``: the first place along ``x`` where the sign of ``f - p`` changes, by linear interpolation.

    ``skip`` leading rows are left out; flat steps give the midpoint; groups without change give no row.
    """
    order = Window.partitionBy(*keys).orderBy(x)
    y = rows.withColumn("y", F.col(f) - F.col(p))
    if skip:
        y = y.withColumn("place", F.row_number().over(order)).where(F.col("place") > skip)
    steps = y.withColumns({"x1": F.lag(x).over(order), "y1": F.lag("y").over(order)}).where(F.signum("y1") != F.signum("y"))
    at = F.when(F.abs(F.col("y") - F.col("y1")) < 1e-15, (F.col("x1") + F.col(x)) / 2).otherwise(F.col("x1") - F.col("y1") * (F.col(x) - F.col("x1")) / (F.col("y") - F.col("y1")))
    return steps.groupBy(*keys).agg(F.min_by(at, F.col(x)).alias("crossing"))


def ratio_fit(rows: DataFrame, keys: list[str], x: str = "p", y: str = "f") -> DataFrame:
    """``b2 = sum(y) / sum(x^2)`` and the root ``pc = 1 / b2`` per group."""
    return rows.groupBy(*keys).agg((F.sum(y) / F.sum(F.col(x) * F.col(x))).alias("b2"), F.count("*").alias("n_rows")).withColumn("pc", F.try_divide(F.lit(1.0), F.col("b2")))


def average_rank(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``avg_rank``, ties sharing the mean of their places.

    Equal values are counted first; the distinct values are divided by ranges of about equal size, so a large group lies in many
    parts: the places before a part are a sum over parts, and only within a part are values put in order.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("ties"))
    parts = cut(counts.repartitionByRange(key, value).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy(key, "part").agg(F.sum("ties").alias("held"))
    before = totals.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    inside = Window.partitionBy(key, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("upto", F.sum("ties").over(inside)).join(before, [key, "part"])
    ranks = placed.select(key, value, (F.col("before") + F.col("upto") - (F.col("ties") - 1) / 2.0).alias("avg_rank"))
    return rows.join(ranks, [key, value])


def resample(rows: DataFrame, keys: list[str], dt: float, t: str = "t", value: str = "value") -> DataFrame:
    """Values at 0, dt, 2dt ... up to the step after each group's last time, by linear interpolation; (0, 0) is added.

    Each step between two given times yields the grid points in it, so only neighbours meet.
    """
    given = rows.groupBy(*keys, t).agg(F.avg(value).alias(value))
    order = Window.partitionBy(*keys).orderBy(t)
    steps = given.withColumns({"t0": F.coalesce(F.lag(t).over(order), F.lit(0.0)), "v0": F.coalesce(F.lag(value).over(order), F.lit(0.0)), "last": F.lead(t).over(order).isNull()})
    first = F.when(F.col("t0") == 0, 0).otherwise(F.floor(F.col("t0") / dt) + 1)
    final = F.when(F.col("last"), F.ceil(F.col(t) / dt)).otherwise(F.floor(F.col(t) / dt))
    grid = steps.where(final >= first).select("*", F.explode(F.sequence(first.cast("int"), final.cast("int"))).alias("k"))
    at = F.col("k") * F.lit(dt)
    share = F.when(F.col(t) > F.col("t0"), (F.least(at, F.col(t)) - F.col("t0")) / (F.col(t) - F.col("t0"))).otherwise(1.0)
    at_zero = F.when((F.col("k") == 0) & (F.col("t0") == 0), F.lit(0.0))
    return grid.select(*keys, at.alias("t"), F.coalesce(at_zero, F.col("v0") + share * (F.col(value) - F.col("v0"))).alias("value"))


def renewal(events: DataFrame, key: str, at: str, order: str, down: Column) -> DataFrame:
    """Steps of a two-state process: ``key, t0, t1, down`` in seconds, from each event to the next."""
    w = Window.partitionBy(key).orderBy(at, order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.select(key, at, order, down.cast("int").alias("down"), micros.alias("m"))
    return rows.select(key, order, "down", (F.col("m") / 1e6).alias("t0"), (F.lead("m").over(w) / 1e6).alias("t1"))


def optimal_expression(n: Column, r: Column, p: float, sources: int = 1) -> Column:
    """Loss of the best network of ``n`` nodes and redundancy ``r``: chains of equal length between forks, none longer than another by two.

    A redundancy of 1 is one ring; without redundancy no chain has inner nodes and the form gives 0.
    """
    further = F.greatest(r - 1, F.lit(0))
    forks, chains = F.greatest(2 * further, F.lit(1)), F.when(further > 0, 3 * further + F.lit(sources - 1)).otherwise(F.lit(1))
    inner = n - F.lit(sources) - forks
    cubic = lambda x: x * (x + 1) * (x + 2)
    length = F.floor(inner / chains).cast("double")
    total = cubic(length) * chains + (cubic(length + 1) - cubic(length)) * F.pmod(inner, chains)
    return F.when(r < 1, 0.0).otherwise(F.lit(p * p / 6) * total / n)


def solve_rate(lengths: DataFrame, key: str, length: str, target: float, rounds: int = 6, grid: int = 48) -> DataFrame:
    """``key, rate`` for which the mean of ``1 - exp(-length * rate)`` of each group is ``target`` (0 < target < 1).

    Each round takes the means at ``grid`` rates in one aggregation of the rows as they are and narrows the
    interval to one step, so a group is only ever summed. Groups without positive length have rate 0.
    """
    rows = cut(lengths.select(key, F.col(length).alias("__len")))
    ends = cut(rows.groupBy(key).agg(F.max("__len").alias("longest"), F.avg((F.col("__len") > 0).cast("double")).alias("share")))
    # mean <= 1 - exp(-longest * rate) bounds the rate from below; the upper end is far above it
    low = -F.log(F.lit(1 - target)) / F.col("longest") / 2
    bounds = cut(ends.where((F.col("longest") > 0) & (F.col("share") > target)).select(key, low.alias("lo"), (low * 2.0**24).alias("hi")))
    rate = lambda i: F.col("lo") * F.pow(F.col("hi") / F.col("lo"), i / F.lit(float(grid)))
    for _ in range(rounds):
        means = [F.avg(1 - F.exp(-F.col("__len") * rate(F.lit(i)))).alias(f"m{i}") for i in range(grid + 1)]
        seen = rows.join(bounds, key).groupBy(key, "lo", "hi").agg(*means)
        below = F.size(F.filter(F.array(*[f"m{i}" for i in range(grid + 1)]), lambda m: m <= target))
        at = seen.select(key, "lo", "hi", F.greatest(F.least(below, F.lit(grid)), F.lit(1)).alias("i"))
        bounds = cut(at.select(key, rate(F.col("i") - 1).alias("lo"), rate(F.col("i")).alias("hi")))
    found = bounds.select(key, F.sqrt(F.col("lo") * F.col("hi")).alias("rate"))
    return ends.select(key).join(found, key, "left").select(key, F.coalesce("rate", F.lit(0.0)).alias("rate"))


def chain_losses(rows: DataFrame, keys: list[str], order: str, p: str) -> DataFrame:
    """``rows`` with ``q_left`` and ``q_right``: the probabilities that some edge before the row, or from the row on, fails.

    A row's edge leads to the next row; ``keys`` make chains, and one chain is put in order in one task.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.product(1 - F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    after = F.product(1 - F.col(p)).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumns({"q_left": 1 - before, "q_right": 1 - after})


def implode(rows: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """``keys`` and each of ``columns`` as an array in order of ``order``: the reverse of exploding aligned arrays. The arrays are as long as their groups."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *columns))).alias("__rows"))
    return held.select(*keys, *[F.col(f"__rows.{c}").alias(c) for c in columns])


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those with the same ``keys``; of several changes the last by ``order`` holds."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in base.columns if c not in keys]), order).alias("__row"))
    return base.join(last.select(*keys), keys, "left_anti").select(base.columns).unionByName(last.select(*keys, "__row.*").select(base.columns))


def close_to(value: Column, wanted: float, absolute: float = 0.1, relative: float = 1e-5) -> Column:
    """Whether a value lies within a tolerance of a wanted one; null is not close."""
    return F.coalesce(F.abs(value - F.lit(wanted)) <= F.lit(absolute + relative * abs(wanted)), F.lit(False))


def in_box(x: Column, y: Column, west: float, south: float, east: float, north: float) -> Column:
    return F.coalesce(x.between(west, east) & y.between(south, north), F.lit(False))


def flagged(rows: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with a column that tells whether the key is among ``members``."""
    there = members.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(there, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def permuted(rows: DataFrame, keys: list[str], draw: Column, tie: str) -> DataFrame:
    """``rows`` with ``place``: a random order within ``keys``, by a number that ``draw`` gives each row."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(draw, tie)))


def typed_key(key: Column) -> Column:
    """A text key as the simplest type it can be read as: truth value, nothing, whole number, number, else text."""
    text = F.lower(F.trim(key))
    whole = F.when(F.trim(key).rlike("^[+-]?[0-9]+$"), F.trim(key).try_cast("bigint"))
    number = F.when(F.trim(key).rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(key).try_cast("double"))
    return F.struct(
        F.when(text.isin("true", "false"), "boolean").when(text.isin("none", "null"), "null").when(whole.isNotNull(), "bigint").when(number.isNotNull(), "double").otherwise("string").alias("kind"),
        F.when(text.isin("true", "false"), F.when(text == "true", 1.0).otherwise(0.0)).otherwise(F.coalesce(whole.cast("double"), number)).alias("number"),
    )
