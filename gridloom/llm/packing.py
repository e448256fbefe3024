"""Filling containers of fixed capacity with whole items (problem 7).

Hierarchical residual packing. Items are spread over partitions of about ``ITEMS`` items by a hash that does not
depend on equal ids; each partition packs its own by best fit, largest first. Bins that are nearly full are
done. Of the others a partition passes on, as items of their own, its bins of at most
half the capacity and, as hosts, bins with more; partitions are merged by ``FAN_IN`` and packed again, up to one.

Best fit leaves a partition one bin of at most half the capacity at most, for two such would have gone together. So
a merge has at most ``FAN_IN`` bins to place and, of each amount of room, needs no more than ``FAN_IN`` hosts:
with these the merge ends as it would with all underfull bins of its partitions. What a partition passes on is thus
bounded by the capacity, and no bin that could take up another one is left out.

An item larger than the capacity is cut: full containers for its beginning,
the rest an item like others. Items of size 0 take no room and lie in the first
container of their partition.

Defined results for odd input: null sizes count as 0, negative sizes as 0; repeated ids
are items of their own; an empty table gives no row; ties are taken in the order of the
id, so the result depends on the stored rows and ``partitions`` only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

CAPACITY = 2048
FAN_IN = 8
#: Share of the capacity from which a bin counts as nearly full.
NEARLY_FULL = 0.98
#: Items that a partition packs on average; of fewer items, ``SMALLEST`` are enough for a partition of its own.
ITEMS, SMALLEST = 250_000, 25_000


class BestFit:
    """Best fit by stacks of open bins for each amount of room, with one bit for each stack that is not empty."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.room: list[int] = []

    def put(self, size: int) -> int:
        """The bin that takes an item of ``size``: of those with room the one with the least."""
        fit = self.mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            bin_no = self.stacks[room].pop()
            if not self.stacks[room]:
                self.mask &= ~(1 << room)
        else:
            bin_no, room = len(self.room), self.capacity
            self.room.append(room)
        self._open(bin_no, room - size)
        return bin_no

    def add(self, fill: int) -> int:
        """A bin that is already filled so far."""
        self.room.append(0)
        self._open(len(self.room) - 1, self.capacity - fill)
        return len(self.room) - 1

    def _open(self, bin_no: int, room: int) -> None:
        self.room[bin_no] = room
        if room:
            self.stacks[room].append(bin_no)
            self.mask |= 1 << room


_PIECES = "{id} {kind}, piece int, start bigint, tokens int, bin bigint, fill int"


def _pack_items(capacity: int):
    """Input sorted by size, largest first: ``part, item, size``; output one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        part = table.column(0)[0].as_py()
        sizes = table.column(2).to_numpy().astype(np.int64)
        # pieces: those that fill a container, the rests largest first, and the items without size
        whole, rest = sizes // capacity, sizes % capacity
        full_owner = np.repeat(np.arange(len(sizes)), whole)
        full_piece = np.arange(len(full_owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        some = np.flatnonzero(rest)
        some = some[np.lexsort((some, -rest[some]))]
        none = np.flatnonzero(sizes == 0)
        fit = BestFit(capacity)
        full_bins = np.arange(len(full_owner))
        for _ in range(len(full_owner)):
            fit.put(capacity)
        rest_bins = np.fromiter(map(fit.put, rest[some].tolist()), np.int64, len(some))
        if len(none) and not fit.room:
            fit.put(0)
        owner = np.r_[full_owner, some, none]
        piece = np.r_[full_piece, whole[some], np.zeros(len(none), np.int64)]
        tokens = np.r_[np.full(len(full_owner), capacity), rest[some], np.zeros(len(none), np.int64)]
        bins = np.r_[full_bins, rest_bins, np.zeros(len(none), np.int64)]
        fill = capacity - np.array(fit.room, dtype=np.int64)[bins]
        ids = table.column(1)
        for k in range(0, len(owner), 100_000):
            span = slice(k, k + 100_000)
            took = ids.take(pa.array(owner[span])).combine_chunks()
            took = took.chunk(0) if isinstance(took, pa.ChunkedArray) else took
            yield pa.RecordBatch.from_arrays(
                [took, pa.array(piece[span], pa.int32()), pa.array(piece[span] * capacity, pa.int64()), pa.array(tokens[span], pa.int32()), pa.array((part << 40) | bins[span], pa.int64()), pa.array(fill[span], pa.int32())],
                names=["item", "piece", "start", "tokens", "bin", "fill"],
            )

    return run


_BINS = "bin bigint, fill int, members array<bigint>"


def _pass_on(bins: list[tuple[int, int, list[int]]], capacity: int) -> tuple[list, list]:
    """``(done, passed on)`` of the bins of a partition: of each amount of room, as many hosts as bins can come."""
    done, on, of_room = [], [], Counter()
    for b in sorted(bins, key=lambda b: (b[1], b[0])):
        host = 2 * b[1] > capacity
        of_room[b[1]] += host
        (done if host and (b[1] >= NEARLY_FULL * capacity or of_room[b[1]] > FAN_IN) else on).append(b)
    return done, on


def _pack_bins(capacity: int, last: bool):
    """Underfull bins of several partitions, packed as items; ``done`` marks those that go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["bin"], r["fill"], r["members"]) for b in batches for r in b.to_pylist()]
        if not rows:
            return
        rows.sort(key=lambda r: (-r[1], r[0]))
        fit = BestFit(capacity)
        packed: list[tuple[int, list[int]]] = []
        for bin_id, fill, members in rows:
            at = fit.put(fill)
            if at == len(packed):
                packed.append((bin_id, []))
            packed[at][1].extend(members)
        out = [(bin_id, capacity - room, members) for (bin_id, members), room in zip(packed, fit.room, strict=True)]
        done, on = (out, []) if last else _pass_on(out, capacity)
        both = [*((*b, True) for b in done), *((*b, False) for b in on)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b[0] for b in both], pa.int64()), pa.array([b[1] for b in both], pa.int32()), pa.array([b[2] for b in both], pa.list_(pa.int64())), pa.array([b[3] for b in both], pa.bool_())],
            names=["bin", "fill", "members", "done"],
        )

    return run


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """``item, piece, start, tokens, bin, fill``: one row per whole item or piece of one that exceeds ``capacity``.

    Without ``partitions`` their number follows from that of the items, so that none holds much more than ``ITEMS``.
    """
    sized = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int")
    # written once: sizes can be dear, and the place of a row serves as its own id for the spread
    rows = cut(items.select(F.col(item).alias("item"), sized.alias("size")))
    kind = rows.schema["item"].dataType.simpleString()
    if partitions is None:
        n, cores = rows.count(), items.sparkSession.sparkContext.defaultParallelism
        partitions = max(1, -(-n // ITEMS), min(cores, n // SMALLEST))
    own = F.xxhash64("item", F.monotonically_increasing_id())
    spread = rows.withColumn("part", F.pmod(own, F.lit(partitions)).cast("int")).repartitionById(partitions, "part")
    ordered = spread.sortWithinPartitions(F.desc("size"), "item").select("part", "item", "size")
    pieces = cut(ordered.mapInArrow(_pack_items(capacity), _PIECES.format(id="item", kind=kind)))

    # the bins of each partition: most are nearly full, a bounded number of the others goes on
    level = pieces.where(F.col("fill") < NEARLY_FULL * capacity).groupBy("bin").agg(F.max("fill").alias("fill")).select("bin", "fill", F.array("bin").alias("members"), F.shiftright("bin", 40).cast("int").alias("part"))
    moved, width, first = [], partitions, True
    while width > 1 or first:
        # the first round only chooses what each partition passes on
        group = F.col("part") if first else F.floor(F.col("part") / FAN_IN).cast("int")
        width = width if first else max(1, -(-width // FAN_IN))
        at = level.withColumn("part", group).repartitionById(width, "part")
        packed = at.select("bin", "fill", "members").mapInArrow(_pack_bins(capacity, width == 1), f"{_BINS}, done boolean")
        out = cut(packed.withColumn("part", F.spark_partition_id()))
        moved.append(out.where("done and size(members) > 1").select("bin", "fill", "members"))
        level, first = out.where("not done").drop("done"), False
    merged = moved[0]
    for more in moved[1:]:
        merged = merged.unionByName(more)
    joined = merged.select(F.col("bin").alias("new_bin"), F.col("fill").alias("new_fill"), F.explode("members").alias("bin"))
    final = pieces.join(joined, "bin", "left")
    return final.select(F.col("item").alias(item), "piece", "start", "tokens", F.coalesce("new_bin", "bin").alias("bin"), F.coalesce("new_fill", "fill").alias("fill"))
