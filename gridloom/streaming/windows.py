"""Structured Streaming forms of the event operators."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.session import remove_folder, shared_folder


#: Rows of a file that :func:`arrivals` writes, on average.
FILE_ROWS = 2_000_000


def arrivals(spark: SparkSession, sf_dir: str, name: str = "events", batches: int = 4, delay: Column | None = None) -> DataFrame:
    """A table as a stream of ``batches`` micro-batches, each of a file for every ``FILE_ROWS`` rows, in the order in which its rows arrive.

    A row arrives at its ``ts`` plus ``delay`` in seconds (by default up to half an hour by a rule), so rows are out of
    order within and between batches. The files lie in the shared folder until :func:`run_once` has read them.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    late = F.pmod(F.col("event_id") * 7919 + 12345, F.lit(1801)) if delay is None else delay
    arrived = F.unix_micros(F.col("ts").cast("timestamp")) + late.cast("bigint") * 1_000_000
    span = rows.agg(F.min(arrived).alias("low"), F.max(arrived).alias("high"), F.count("*").alias("n")).first()
    files = max(1, -(-span.n // (batches * FILE_ROWS)))
    place = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    low, width = span.low or 0, max((span.high or 0) - (span.low or 0), 1)
    part = F.least(F.floor((arrived - F.lit(low)) * batches / F.lit(width)), F.lit(batches - 1))
    held = rows.withColumn("__part", part)
    for k in range(batches):  # one after the other, so that their times are in order
        held.where(F.col("__part") == k).drop("__part").repartition(files).write.mode("overwrite").parquet(f"{place}/batch={k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(place)


def tumbling_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per type and window; rows later than the watermark are left out."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def down_time(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """``user_id, t, down, lost``: running down time of each user's two-state process, one row per batch and user.

    Events may arrive out of order by up to ``late``: a user's state is what is settled up to the watermark (the last settled event,
    whether it was down, the down time so far) and the events after it, which are put in order anew with each
    batch. So the result does not depend on how the events come in batches. Events behind the settled ones are left out.
    """

    def run_on(last, down: bool, lost: float, rows: list[tuple]) -> tuple:
        for t, _, is_down in rows:
            if last is not None and down:
                lost += t - last
            last, down = t, is_down
        return last, down, lost

    def step(key: tuple, pdfs, state: GroupState):
        last, down, lost, ts, ids, downs = state.get if state.exists else (None, False, 0.0, [], [], [])
        last = None if last is None or pd.isna(last) else last
        came = pd.concat(list(pdfs))
        fresh = [x for x in zip(came.t.tolist(), came.event_id.tolist(), map(bool, came.down), strict=True) if last is None or x[0] > last]
        open_ones = sorted({*zip(ts, ids, downs, strict=True), *fresh})
        settled = state.getCurrentWatermarkMs() / 1000
        done = [x for x in open_ones if x[0] <= settled]
        last, down, lost = run_on(last, down, lost, done)
        rest = open_ones[len(done) :]
        state.update((last, down, float(lost), [x[0] for x in rest], [int(x[1]) for x in rest], [x[2] for x in rest]))
        t, is_down, total = run_on(last, down, lost, rest)
        yield pd.DataFrame({"user_id": [key[0]], "t": [float(t)], "down": [is_down], "lost": [float(total)]})

    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("user_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("t"), (F.col("event_type") == "error").alias("down"))
    held = "last double, down boolean, lost double, ts array<double>, ids array<bigint>, downs array<boolean>"
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, t double, down boolean, lost double", held, "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, into files in the shared folder; then those files.

    In ``update`` mode each micro-batch has a folder of its own, which a repeated attempt writes anew, so a retry never doubles rows;
    ``batch`` tells which one a row is from.
    """
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{place}/out").outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/out/batch={n}"))
    writer.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    remove_folder(spark, f"{place}/state")
    return spark.read.schema(stream.schema).parquet(f"{place}/out") if mode == "append" else spark.read.parquet(f"{place}/out")
