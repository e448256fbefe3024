from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridloom.session import shared_folder
from gridloom.streaming import windows

T0 = datetime(2024, 3, 1)
DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def settled(spark, place, batches, delay):
    out = windows.run_once(windows.down_time(windows.arrivals(spark, place, batches=batches, delay=delay)), "update")
    return {r.user_id: round(r.lost, 6) for r in out.groupBy("user_id").agg(F.max_by("lost", "batch").alias("lost")).collect()}, out


def test_down_time_does_not_depend_on_batches(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=10 * i), i % 2, "error" if (i * 7) % 5 < 2 else "view", 1.0) for i in range(60)]
    place = stored(spark, tmp_path, rows)
    want = {}
    for user in (0, 1):
        mine = [r for r in rows if r[2] == user]
        want[user] = sum((b[1] - a[1]).total_seconds() for a, b in zip(mine, mine[1:]) if a[3] == "error")
    shuffled = F.pmod(F.col("event_id") * 7919, F.lit(3000))  # later by up to 50 minutes, so five neighbours change places
    one, _ = settled(spark, place, 1, shuffled)
    four, out = settled(spark, place, 4, shuffled)
    assert one == four == want and out.select("batch").distinct().count() == 4


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=6 * i), 1, "view", 1.0) for i in range(12)] + [(99, T0 + timedelta(hours=1), 1, "view", 5.0)]
    place = stored(spark, tmp_path, rows)
    delay = F.when(F.col("event_id") == 99, 3 * 86400).otherwise(0)
    out = windows.run_once(windows.tumbling_counts(windows.arrivals(spark, place, batches=4, delay=delay)), "update")
    last = {r.day.day: r.n for r in out.groupBy(F.col("window.start").alias("day")).agg(F.max_by("n", "batch").alias("n")).collect()}
    assert sum(last.values()) == 12 and last[1] == 4


def test_a_repeated_batch_writes_the_same_rows(spark, tmp_path):
    place = f"{shared_folder(spark)}/again"
    df = spark.range(5)
    for _ in range(2):
        df.write.mode("overwrite").parquet(f"{place}/batch=0")
    assert spark.read.parquet(place).count() == 5
