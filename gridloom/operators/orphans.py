"""References to records that do not exist, as keyed state kept up incrementally (problem 4).

What counts for a reference is, of the parent records of its key (graph and label), how many
are valid at its moment, how many have begun by then and how many there are at all. These three sums are
its state. The log holds every event of a parent and every reference with the batch it arrived in. A batch
adds to the state only what it changes: new references probe the parents known so far, and arriving
parents add to the references that wait under their keys (a creation resolves
orphans or turns ``missing`` into ``late``, a deletion re-opens references after it). Keys that
no new row names are neither probed nor written again; what a batch adds is appended. Counts of
the open orphans after each batch are sums over what was appended up to it.

No reference is paired with the records of its key. Events of a key are summed
by hour, the prefix over the hours is the state each hour starts
from, and only within an hour are events put in order. A key with a third of all
rows is so split over its hours.

Defined results for odd input:

* null and blank references are no cases; null or blank labels match nothing;
* spaces around and letter case do not count, everything else does;
* a record without ``created_at`` or with ``deleted_at <= created_at`` exists but
  is never valid, so it makes an orphan ``deleted``;
* a reference without ``recorded_at`` has no valid record: ``missing`` if there
  is no record at all, else ``deleted``;
* repeated rows change nothing; rows without ``loaded_at`` arrive in the last batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.session import cut

_SPACE = " \t\r\n"
_REF = ["ref_table", "ref_id", "field"]


def label_key(label: Column) -> Column:
    return F.lower(F.btrim(label.cast("string"), F.lit(_SPACE)))


def _key(label: Column) -> Column:
    """Graph and label as one text; a reference without graph gets a key that no record has."""
    return F.concat(F.coalesce(F.col("graph_id").cast("string"), F.lit("")), F.lit("|"), label)


def parents_of(nodes: DataFrame) -> DataFrame:
    named = nodes.select("graph_id", label_key(F.col("label")).alias("label"), "created_at", "deleted_at", "loaded_at").where("label <> '' and graph_id is not null")
    return named.select(_key(F.col("label")).alias("key"), "created_at", "deleted_at", "loaded_at")


def references_of(df: DataFrame, ref_table: str, id_column: str, fields: list[str]) -> DataFrame:
    """A row for each reference of ``df`` that is neither null nor blank."""
    refs = F.array(*[F.struct(F.lit(f).alias("field"), label_key(F.col(f)).alias("label")) for f in fields])
    rows = df.select(F.lit(ref_table).alias("ref_table"), F.col(id_column).alias("ref_id"), "graph_id", "recorded_at", "loaded_at", F.explode(refs).alias("r"))
    return rows.where("r.label <> ''").select("ref_table", "ref_id", "r.field", _key(F.col("r.label")).alias("key"), "recorded_at", "loaded_at")


_LOG = ["key", "t", "live", "begun", "is_ref", "ref", "arrived"]
_EARLY = "0001-01-01 00:00:00"


def _moment(column: str) -> Column:
    return F.coalesce(F.col(column).cast("timestamp_ntz"), F.lit(_EARLY).cast("timestamp_ntz"))


def events_of(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """Both sides as rows of the log: beginnings and ends of parents, and references."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    arrived = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(loaded_at as timestamp_ntz))") if "loaded_at" in parents.columns else F.lit(None).cast("bigint")
    valid = F.col("created_at").isNotNull() & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("created_at")))
    begins = F.struct(_moment("created_at").alias("t"), F.when(valid, one).otherwise(zero).alias("live"), one.alias("begun"))
    ends = F.when(valid & F.col("deleted_at").isNotNull(), F.struct(_moment("deleted_at").alias("t"), F.lit(-1).cast("bigint").alias("live"), zero.alias("begun")))
    probes = refs.select("key", _moment("recorded_at").alias("t"), zero.alias("live"), zero.alias("begun"), F.lit(True).alias("is_ref"), F.struct(*_REF, "recorded_at").alias("ref"), arrived.alias("arrived"))
    rows = parents.select("key", F.explode(F.array_compact(F.array(begins, ends))).alias("e"), arrived.alias("arrived"))
    return rows.select("key", "e.t", "e.live", "e.begun", F.lit(False).alias("is_ref"), F.lit(None).cast(probes.schema["ref"].dataType).alias("ref"), "arrived").unionByName(probes)


def probe(rows: DataFrame) -> DataFrame:
    """What the rows of one batch add to the references among them: ``ref, key, live, begun, total``.

    ``rows`` are log rows with ``is_new``. A new reference gets the sums over all events of its key up to its moment,
    an old one those over the new events only.
    """
    zero = F.lit(0).cast("bigint")
    spread = rows.withColumn("hour", F.date_trunc("hour", F.col("t"))).repartition("key", "hour")
    only_new = lambda c: F.when(F.col("is_new"), F.col(c)).otherwise(zero)
    # the state of each key at the start of each hour
    sums = {"live": F.col("live"), "begun": F.col("begun"), "new_live": only_new("live"), "new_begun": only_new("begun")}
    hours = spread.groupBy("key", "hour").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    key = Window.partitionBy("key")
    before = key.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    state = hours.select("key", "hour", *[F.coalesce(F.sum(c).over(before), zero).alias(f"{c}0") for c in sums], F.sum("begun").over(key).alias("total"), F.sum("new_begun").over(key).alias("new_total"))
    # within an hour: parents' events come before references of the same moment
    so_far = Window.partitionBy("key", "hour").orderBy("t", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    run = spread.select("key", "hour", "is_ref", "is_new", "ref", *[F.sum(c).over(so_far).alias(f"{name}1") for name, c in sums.items()]).where("is_ref")
    seen = run.join(state, ["key", "hour"])
    by_age = lambda c: F.when(F.col("is_new"), F.col(f"{c}0") + F.col(f"{c}1")).otherwise(F.col(f"new_{c}0") + F.col(f"new_{c}1")).alias(c)
    return seen.select("ref", "key", by_age("live"), by_age("begun"), F.when(F.col("is_new"), F.col("total")).otherwise(F.col("new_total")).alias("total"))


class OrphanTracker:
    """The log of all that arrived, and for each batch what it added to the state of the references."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.log: DataFrame | None = None
        self.added: list[DataFrame] = []
        self.labels: list[str] = []

    def apply(self, new_parents: DataFrame, new_refs: DataFrame, label: str) -> None:
        """Take up a batch; it becomes part of the log."""
        rows = cut(events_of(new_parents, new_refs).withColumn("batch", F.lit(len(self.added))))
        self.log = rows if self.log is None else self.log.unionByName(rows)
        self.advance(label)

    def advance(self, label: str) -> None:
        """Work in the rows of the log that belong to the next batch."""
        number = len(self.added)
        rows = self.log.where(F.col("batch") <= number).withColumn("is_new", F.col("batch") == number)
        if number:
            named = rows.where("is_new").groupBy("key").agg(F.bool_or("is_ref").alias("has_ref"), F.bool_or(~F.col("is_ref")).alias("has_event"))
            needed = F.col("is_new") | (F.col("is_ref") & F.col("has_event")) | (~F.col("is_ref") & F.col("has_ref"))
            rows = rows.join(named, "key").where(needed)
        self.added.append(cut(probe(rows)))
        self.labels.append(label)

    def _states(self) -> DataFrame:
        """Of each reference its three sums after each batch, as arrays, and the batch it came with."""
        every = None
        for number, added in enumerate(self.added):
            rows = added.withColumn("batch", F.lit(number))
            every = rows if every is None else every.unionByName(rows)
        upto = lambda c: F.array(*[F.sum(F.when(F.col("batch") <= b, F.col(c)).otherwise(0)).alias("x") for b in range(len(self.added))]).alias(c)
        return every.groupBy("ref", "key").agg(F.min("batch").alias("first"), *[upto(c) for c in ("live", "begun", "total")])

    @staticmethod
    def _kind(at: Column) -> Column:
        known = F.col("ref.recorded_at").isNotNull()
        return F.when(known & (F.get("live", at) > 0), None).when(F.get("total", at) == 0, "missing").when(known & (F.get("begun", at) == 0), "late").otherwise("deleted")

    def open(self) -> DataFrame:
        """``ref_table, ref_id, field, kind, recorded_at`` of the references that are orphans now."""
        kind = self._kind(F.lit(len(self.added) - 1))
        return self._states().select("ref.ref_table", "ref.ref_id", "ref.field", kind.alias("kind"), "ref.recorded_at").where("kind is not null").distinct()

    def counts(self) -> DataFrame:
        """Open orphans per table, field, kind and month of ``recorded_at``."""
        return self.open().groupBy("ref_table", "field", "kind", F.date_format("recorded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orphans"))

    def snapshots(self) -> DataFrame:
        """``batch`` (from 1), ``as_of`` and the counts after each batch, all from one pass over the states."""
        names = F.array(*map(F.lit, self.labels))
        after = self._states().select("ref", F.col("first"), "live", "begun", "total", F.explode(F.sequence(F.col("first"), F.lit(len(self.added) - 1))).alias("b"))
        rows = after.select((F.col("b") + 1).cast("bigint").alias("batch"), F.get(names, F.col("b")).alias("as_of"), "ref.*", self._kind(F.col("b")).alias("kind")).where("kind is not null").distinct()
        return rows.groupBy("batch", "as_of", "ref_table", "field", "kind", F.date_format("recorded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orphans"))


def track(parents: DataFrame, refs: DataFrame, batches: int = 3) -> OrphanTracker:
    """Feed whole tables in order of arrival: ``batches`` equal spans of ``loaded_at``.

    The tables are read once, into the log; the span of arrivals is observed on the way.
    """
    tracker, span = OrphanTracker(parents.sparkSession), Observation()
    log = cut(events_of(parents, refs).observe(span, F.min("arrived").alias("low"), F.max("arrived").alias("high")))
    low, high = span.get["low"], span.get["high"]
    edges = [] if low is None else [low + (high - low) * k // batches for k in range(1, batches)]
    batch = F.lit(len(edges))
    for k, edge in reversed(list(enumerate(edges))):
        batch = F.when(F.col("arrived") < edge, k).otherwise(batch)
    tracker.log = log.withColumn("batch", batch)
    for edge in edges:
        tracker.advance(str(edge))
    tracker.advance("end")
    return tracker
