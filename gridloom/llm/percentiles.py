"""Percentiles of very large columns with bounded rank error (problem 1).

Deterministic buffer collapsing. A sketch of a group holds fewer than ``K`` values
as they are (the part), and at most one full buffer of ``K`` sorted values per level;
a value of a level-``l`` buffer stands for ``2**l`` values. Two buffers of one level
collapse into one of the next: of their merged ``2K`` values every other is kept,
starting in turn with the first and the second. Collapsing is a binary counter,
so a group of ``n`` values has gone through at most ``log2(n / K)`` levels, each of
which moves a rank by at most ``n / 2K``: the rank error is at most
``log2(n / K) / 2K``, for ``K = 2048`` below one per cent up to 10**15 values of a
group, and the sketch reports the exact sum of what its collapses could move.

Sketches of partitions, days or parts merge by the same rule: parts are joined,
full buffers carried up. Merging never needs the values again.

Defined results for odd input: null, NaN, infinite and negative values are no
measurements; repeated rows (all columns equal) count once; a group without
measurements gives no row; groups whose key is null are kept as such; null
arrays and null entries are nothing; -0.0 counts as 0. A percentile is the smallest
value whose rank reaches that share of the group (nearest rank).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 2048
PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
FAN_IN = 32
#: Partitions that the rows of a graph and day are spread over, at least; above ``ROWS_PER_SALT`` rows in each there are more.
SALTS, ROWS_PER_SALT = 16, 1_000_000
#: One of so many rows is counted to find such days.
COUNTED = 64
#: Sketches that a task holds at a time.
HELD_ROWS, HELD_BYTES = 20_000, 64_000_000

#: moved: the sum of the weights of all collapses so far, the bound of the rank error in values
_SKETCH = "n bigint, moved bigint, part array<double>, levels array<int>, full array<double>"


class Buffers:
    """The sketch of one group that is larger than a part."""

    __slots__ = ("full", "k", "loose", "loose_n", "moved", "n", "turn")

    def __init__(self, k: int = K):
        self.k, self.n, self.moved, self.turn = k, 0, 0, 0
        self.full: dict[int, np.ndarray] = {}
        self.loose: list[np.ndarray] = []
        self.loose_n = 0

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._take(values)

    def _take(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.loose_n += len(values)
        if self.loose_n >= self.k:
            whole = np.concatenate(self.loose)
            cut = self.loose_n // self.k * self.k
            for at in range(0, cut, self.k):
                self._carry(0, np.sort(whole[at : at + self.k]))
            self.loose, self.loose_n = [whole[cut:]], self.loose_n - cut

    def _carry(self, level: int, buffer: np.ndarray) -> None:
        while level in self.full:
            merged = np.sort(np.concatenate([self.full.pop(level), buffer]), kind="stable")
            buffer = merged[self.turn :: 2]
            self.turn ^= 1
            self.moved += 1 << level
            level += 1
        self.full[level] = buffer

    def merge(self, n: int, moved: int, part: np.ndarray, levels: np.ndarray, full: np.ndarray) -> None:
        self.n += n
        self.moved += moved
        for i, level in enumerate(levels):
            self._carry(int(level), full[i * self.k : (i + 1) * self.k])
        if len(part):
            self._take(part)

    def state(self) -> tuple[int, int, np.ndarray, list[int], np.ndarray]:
        levels = sorted(self.full)
        part = np.sort(np.concatenate(self.loose)) if self.loose else np.zeros(0)
        return self.n, self.moved, part, levels, np.concatenate([self.full[x] for x in levels]) if levels else np.zeros(0)


def quantiles(part: np.ndarray, levels: np.ndarray, full: np.ndarray, shares: np.ndarray, k: int = K) -> np.ndarray:
    """The weighted nearest-rank values of a sketch."""
    values = np.concatenate([part, full])
    weights = np.concatenate([np.ones(len(part)), np.repeat(2.0 ** np.asarray(levels, dtype=float), k)])
    order = np.argsort(values, kind="stable")
    ranks = np.cumsum(weights[order])
    at = np.searchsorted(ranks, np.ceil(shares * ranks[-1] - 1e-9), side="left")
    return values[order][np.minimum(at, len(values) - 1)]


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    n = len(columns[0])
    change = np.ones(n, dtype=bool)
    change[1:] = False
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _codes(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> list[np.ndarray]:
    """Integer codes of the key columns, null being one of the values; equal only where the keys are."""
    out = []
    for k in keys:
        c = batch.column(k)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if not pa.types.is_string(c.type):
            c = c.cast(pa.int32()).cast(pa.int64()) if pa.types.is_date32(c.type) else c.cast(pa.int64())
            out += [c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)]
        else:
            coded = c.dictionary_encode()
            out.append(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False))
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], k: int) -> Iterator[pa.Table]:
    """Tables of whole groups from sketches sorted by ``keys``; what is held of one group is combined whenever it exceeds ``HELD_BYTES``."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows < HELD_ROWS and size < HELD_BYTES:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = int(_starts(_codes(t, keys))[-1])
        if last:
            yield t.slice(0, last)
            t = t.slice(last)
        elif size >= HELD_BYTES or rows >= HELD_ROWS:
            t = pa.Table.from_batches(list(_sketches(t, keys, k)))
        held, rows, size = t.to_batches(), t.num_rows, t.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _build(keys: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input sorted by ``keys`` and value; the open group of a batch is carried on to the next."""
        open_key, open_group = None, None

        def close() -> pa.RecordBatch:
            n, moved, part, levels, full = open_group.state()
            arrays = [*open_key, pa.array([n]), pa.array([moved]), pa.array([part.tolist()], pa.list_(pa.float64())), pa.array([levels], pa.list_(pa.int32())), pa.array([full.tolist()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "n", "moved", "part", "levels", "full"])

        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(_codes(b, keys))
            ends = np.r_[starts[1:], b.num_rows]
            values = b.column("value").to_numpy()
            key_of = lambda i: [b.column(c).slice(int(i), 1) for c in keys]  # noqa: B023, E731
            first = 0
            if open_group is not None:
                if all(x.equals(y) for x, y in zip(open_key, key_of(0), strict=True)):
                    open_group.add(values[: ends[0]])
                    if len(ends) == 1:
                        continue
                    first = 1
                yield close()
            open_key, open_group = key_of(starts[-1]), Buffers(k)
            open_group.add(values[starts[-1] :])
            s, e = starts[first:-1], ends[first:-1]
            small = e - s < k
            if small.any():
                # groups that fit into a part are taken over as they are, without a loop
                lengths = (e - s)[small]
                rows = np.repeat(s[small], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                offsets = np.r_[0, np.cumsum(lengths)]
                none = np.zeros(len(lengths) + 1, dtype=np.int32)
                at = pa.array(s[small])
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(at) for c in keys], pa.array(lengths, pa.int64()), pa.array(np.zeros(len(lengths), np.int64)), _lists(offsets, values[rows]), _lists(none, np.zeros(0, np.int32), pa.int32()), _lists(none, np.zeros(0))],
                    names=[*keys, "n", "moved", "part", "levels", "full"],
                )
            kept = open_key, open_group
            for i in np.flatnonzero(~small):
                open_key, open_group = key_of(s[i]), Buffers(k)
                open_group.add(values[s[i] : e[i]])
                yield close()
            open_key, open_group = kept
        if open_group is not None:
            yield close()

    return run


def _ints(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column."""
    c = t.column(name).combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    off = c.offsets.to_numpy()
    return off - off[0], c.flatten().to_numpy(zero_copy_only=False)


def _merged(t: pa.Table, keys: list[str], k: int):
    """``(starts, n, moved, part lists, levels lists, full lists)`` of the groups of ``t``, which is sorted by ``keys``."""
    starts = _starts(_codes(t, keys))
    ends = np.r_[starts[1:], t.num_rows]
    n, moved = t.column("n").to_numpy(), t.column("moved").to_numpy()
    po, pv = _ints(t, "part")
    lo, lv = _ints(t, "levels")
    fo, fv = _ints(t, "full")
    part_n = po[ends] - po[starts]
    simple = (part_n < k) & (lo[ends] == lo[starts])
    group = np.repeat(np.arange(len(starts)), part_n)
    total_n, total_moved = np.add.reduceat(n, starts), np.add.reduceat(moved, starts)
    in_simple = simple[group]
    values, group = pv[in_simple], group[in_simple]
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    hard = {}
    for i in np.flatnonzero(~simple):
        buffers = Buffers(k)
        for r in range(starts[i], ends[i]):
            buffers.merge(int(n[r]), int(moved[r]), pv[po[r] : po[r + 1]], lv[lo[r] : lo[r + 1]], fv[fo[r] : fo[r + 1]])
        hard[int(i)] = buffers.state()
    return starts, total_n, total_moved, simple, values, group, hard


def _sketches(t: pa.Table, keys: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """The groups of ``t``, which is sorted by ``keys``, as one sketch each."""
    starts, n, moved, simple, values, group, hard = _merged(t, keys, k)
    names = [*keys, "n", "moved", "part", "levels", "full"]
    at = np.flatnonzero(simple)
    if len(at):
        offsets = np.searchsorted(group, np.r_[at, len(starts)]).astype(np.int32)
        none = np.zeros(len(at) + 1, dtype=np.int32)
        key_columns = [t.column(c).combine_chunks().take(pa.array(starts[at])) for c in keys]
        key_columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in key_columns]
        yield pa.RecordBatch.from_arrays([*key_columns, pa.array(n[at]), pa.array(moved[at]), _lists(offsets, values), _lists(none, np.zeros(0, np.int32), pa.int32()), _lists(none, np.zeros(0))], names=names)
    for i, (hn, hm, part, levels, full) in hard.items():
        key_columns = [t.column(c).slice(int(starts[i]), 1).combine_chunks() for c in keys]
        key_columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in key_columns]
        yield pa.RecordBatch.from_arrays([*key_columns, pa.array([hn]), pa.array([hm]), pa.array([part.tolist()], pa.list_(pa.float64())), pa.array([levels], pa.list_(pa.int32())), pa.array([full.tolist()], pa.list_(pa.float64()))], names=names)


def _merge(keys: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys, k):
            yield from _sketches(t, keys, k)

    return run


def _ask(keys: list[str], shares: tuple[float, ...], k: int):
    fractions = np.array(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys, k):
            starts, n, moved, simple, values, group, hard = _merged(t, keys, k)
            out = np.zeros((len(starts), len(fractions)))
            at = np.flatnonzero(simple)
            if len(at):
                offset = np.searchsorted(group, at)
                rank = np.maximum(np.ceil(fractions[None, :] * n[at][:, None] - 1e-9), 1).astype(np.int64)
                out[at] = values[offset[:, None] + rank - 1]
            for i, (hn, hm, part, levels, full) in hard.items():
                n[i], moved[i] = hn, hm
                out[i] = quantiles(part, np.array(levels), full, fractions, k)
            key_columns = [t.column(c).combine_chunks().take(pa.array(starts)) for c in keys]
            key_columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in key_columns]
            yield pa.RecordBatch.from_arrays([*key_columns, pa.array(n), pa.array(moved), _lists(np.arange(len(starts) + 1) * len(fractions), out.ravel())], names=[*keys, "n", "moved", "values"])

    return run


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)


def measurement(value: Column) -> Column:
    """Whether a value counts: not null, NaN, infinite or negative."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))


def sketch(values: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """A sketch per ``keys`` and partition of ``values``, which has the column ``value``; nothing is shuffled."""
    rows = values.select(*keys, "value").sortWithinPartitions(*keys)
    return rows.mapInArrow(_build(keys, k), f"{_ddl(values, keys)}, {_SKETCH}")


def spread(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches with those of equal ``keys`` in one partition."""
    return sketches.repartition(*keys)


def merge_in_place(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches combined to one per ``keys`` (some or all of the keys that they have) and partition."""
    rows = sketches.select(*keys, "n", "moved", "part", "levels", "full").sortWithinPartitions(*keys)
    return rows.mapInArrow(_merge(keys, k), f"{_ddl(sketches, keys)}, {_SKETCH}")


def merge(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches combined to one per ``keys``: first within partitions, then over ``FAN_IN`` blocks of them, then all."""
    blocks = merge_in_place(sketches, keys, k).withColumn("block", F.spark_partition_id() % FAN_IN)
    fewer = merge_in_place(spread(blocks, [*keys, "block"]), keys, k)
    return merge_in_place(spread(fewer, keys), keys, k)


def ask(sketches: DataFrame, keys: list[str], percentiles: tuple[float, ...] = PERCENTILES, k: int = K) -> DataFrame:
    """Percentiles as columns ``p01 ...`` with ``n`` and the bound of the rank error as a share of ``n``.

    The sketches of equal ``keys`` must lie in one partition (``spread``); they are combined on the way.
    """
    rows = sketches.select(*keys, "n", "moved", "part", "levels", "full").sortWithinPartitions(*keys)
    asked = rows.mapInArrow(_ask(keys, tuple(p / 100 for p in percentiles), k), f"{_ddl(sketches, keys)}, n bigint, moved bigint, values array<double>")
    return asked.select(*keys, "n", *[F.col("values")[i].alias(f"p{p:02d}" if isinstance(p, int) else f"p{p}") for i, p in enumerate(percentiles)], (F.col("moved") / F.col("n")).alias("max_rank_error"))


def hot_groups(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """``keys, salts`` of the groups of more than ``SALTS * ROWS_PER_SALT`` rows, from a count of one in ``COUNTED``.

    There is at most one for every so many rows of the table, so the result is small.
    """
    counted = df.where(F.pmod(F.xxhash64(F.lit("salt"), id_column), F.lit(COUNTED)) == 0).groupBy(*keys).agg((F.count("*") * COUNTED).alias("__n"))
    return counted.where(F.col("__n") > SALTS * ROWS_PER_SALT).select(*keys, F.ceil(F.col("__n") / ROWS_PER_SALT).alias("__salts"))


def _salted(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Distinct rows of ``df``, spread by its keys and a salt.

    Equal rows meet in one partition, so that one shuffle serves both the removal
    of repeats and the sketches; a hot key lies in ``SALTS`` partitions, or as many as its rows need.
    """
    hot = hot_groups(df, keys, id_column).toDF(*[f"__{k}" for k in keys], "__salts")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    counted = df.join(F.broadcast(hot), same, "left").drop(*[f"__{k}" for k in keys])
    salted = counted.withColumn("salt", F.pmod(F.xxhash64(id_column), F.coalesce("__salts", F.lit(SALTS)))).drop("__salts")
    return salted.repartition(*keys, "salt").dropDuplicates()


def measurements(series: DataFrame, sweep: DataFrame) -> list[DataFrame]:
    """``graph_id, run_day, measure, value`` of saidi and p of series, and of rel and p of sweep."""
    digest = lambda df, used: F.xxhash64(*[F.col(c) for c in df.columns if c not in used]).alias("rest")
    used = ["row_id", "graph_id", "run_day", "saidi", "p"]
    points = _salted(series.select(*used, digest(series, used)), ["graph_id", "run_day"], "row_id")
    as_rows = lambda *pairs: F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(c).alias("value")) for name, c in pairs])).alias("m")
    series_values = points.select("graph_id", "run_day", as_rows(("series.saidi", "saidi"), ("series.p", "p")))
    used = ["sweep_id", "graph_id", "run_at", "rel", "p"]
    trials = _salted(sweep.select("sweep_id", "graph_id", F.to_date("run_at").alias("run_day"), "rel", "p", digest(sweep, ["rel", "p"])), ["graph_id", "run_day"], "sweep_id")

    def named(name: str, values: str) -> Column:
        return F.transform(F.coalesce(F.col(values), F.array().cast("array<double>")), lambda x: F.struct(F.lit(name).alias("measure"), x.alias("value")))

    each = F.explode(F.concat(named("sweep.rel", "rel"), named("sweep.p", "p"))).alias("m")
    sweep_values = trials.select("graph_id", "run_day", each)
    return [v.select("graph_id", "run_day", "m.measure", (F.col("m.value") + F.lit(0.0)).alias("value")).where(measurement(F.col("value"))) for v in (series_values, sweep_values)]


def day_sketches(series: DataFrame, sweep: DataFrame, k: int = K) -> DataFrame:
    """Sketches per ``graph_id, run_day, measure`` and partition."""
    built = [sketch(v, ["graph_id", "run_day", "measure"], k) for v in measurements(series, sweep)]
    return built[0].unionByName(built[1])


def percentiles_of(series: DataFrame, sweep: DataFrame, k: int = K) -> DataFrame:
    """Percentiles per graph and day (``period`` = ``day``) and per graph (``all``).

    Both come from one shuffle of the days' sketches: the days are asked, and the
    sketches of each graph are combined over partitions, blocks and the whole.
    """
    graph = ["graph_id", "measure"]
    days = spread(day_sketches(series, sweep, k), ["graph_id", "run_day", "measure"])
    by_day = ask(days, ["graph_id", "run_day", "measure"], k=k).withColumn("period", F.lit("day"))
    in_all = ask(merge(days, graph, k), graph, k=k).withColumn("period", F.lit("all")).withColumn("run_day", F.lit(None).cast("date"))
    columns = ["measure", "period", "graph_id", "run_day", "n", *[f"p{p:02d}" for p in PERCENTILES], "max_rank_error"]
    return by_day.select(columns).unionByName(in_all.select(columns))


def rank_errors(series: DataFrame, sweep: DataFrame, allowed: float | None = 0.01, k: int = K) -> DataFrame:
    """The percentiles held against all values: ``measure, period, graph_id, run_day, n, within``.

    Each value is counted against the percentiles of its groups; ``within`` tells whether the
    true ranks of all of them are at most ``allowed`` of the group away from those asked for; without
    ``allowed``, at most the bound that the sketch of the group carries.
    """
    asked = percentiles_of(series, sweep, k)
    names = [f"p{p:02d}" for p in PERCENTILES]
    values = measurements(series, sweep)
    both = F.explode(F.array(F.struct(F.lit("day").alias("period"), F.col("run_day").alias("run_day")), F.struct(F.lit("all").alias("period"), F.lit(None).cast("date").alias("run_day")))).alias("g")
    rows = values[0].unionByName(values[1]).groupBy("graph_id", "run_day", "measure", "value").agg(F.count("*").alias("c")).select("graph_id", "measure", "value", "c", both)
    key = lambda df: F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("measure", "period", "graph_id", "run_day")])
    rows = rows.select("graph_id", "measure", "g.period", "g.run_day", "value", "c").withColumn("key", key(None)).groupBy("key", "value").agg(F.sum("c").alias("c"))
    groups = asked.withColumn("key", key(None))
    held = rows.join(groups.select("key", *names), "key")
    counts = held.groupBy("key").agg(*[F.sum(F.when(F.col("value") < F.col(p), F.col("c")).otherwise(0)).alias(f"l_{p}") for p in names], *[F.sum(F.when(F.col("value") <= F.col(p), F.col("c")).otherwise(0)).alias(f"h_{p}") for p in names])
    fine = F.lit(True)
    bound = F.round(F.col("n") * F.col("max_rank_error")) if allowed is None else F.col("n") * allowed
    for p, name in zip(PERCENTILES, names, strict=True):
        want = F.greatest(F.ceil(F.lit(p / 100) * F.col("n") - 1e-9), F.lit(1))
        fine = fine & (F.greatest(F.col(f"l_{name}") + 1 - want, want - F.col(f"h_{name}"), F.lit(0)) <= bound)
    return groups.join(counts, "key", "left").select("measure", "period", "graph_id", "run_day", "n", F.coalesce(fine, F.lit(False)).alias("within"))
