"""Request rates and admission of crowded sensors."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import naive
import pytest
from pyspark.sql import functions as F

from flowtide.config import FreshnessPolicy
from flowtide.operators import sensors

EPOCH = datetime(1970, 1, 1)
MINUTE = 60_000_000


def test_request_rate_counts_each_minute_up_to_its_last_microsecond(spark):
    rng = random.Random(3)
    start = 28_401_000 * MINUTE
    times = [(None, start), (None, start + 5), ("s0", None), ("s2", None), ("s0", -1), ("s0", 0), ("s0", MINUTE - 1), ("s0", MINUTE)]
    for sensor in ("s0", "s1"):
        for _ in range(150):
            at = start + rng.choice([0, 0, 1, 7, MINUTE // 2, MINUTE - 1]) + MINUTE * rng.randrange(6)
            times += [(sensor, at)] * rng.choice([1, 1, 3])
    rows = [(s, None if us is None else EPOCH + timedelta(microseconds=us)) for s, us in times]
    frame = spark.createDataFrame(rows, "sensor_id string, received_at timestamp_ntz")
    known = [(s, us) for s, us in times if us is not None]
    want = {
        (s, us): (n, sum(1 for other, at in known if other == s and us - MINUTE <= at <= us))
        for (s, us), n in Counter(known).items()
    }
    got = sensors.request_rate(frame).collect()
    assert {(r["sensor_id"], r["_us"]): (r["requests_now"], r["requests_last_minute"]) for r in got} == want
    assert len(got) == len(want)


def test_request_rate_of_a_crowded_minute_takes_no_time_by_its_square(spark):
    n = 100_000
    start = 28_401_000 * MINUTE + 1
    frame = spark.range(n).select(
        F.lit("s0").alias("sensor_id"),
        F.timestamp_add("MICROSECOND", F.col("id") * 1000 + start, F.expr("timestamp_ntz'1970-01-01'")).alias("received_at"),
    )
    begun = time.monotonic()
    got = sensors.request_rate(frame).agg(F.count(F.lit(1)).alias("n"), F.sum("requests_last_minute").alias("s"), F.max("requests_last_minute").alias("top")).first()
    assert time.monotonic() - begun < 30
    inside = 60_001
    assert tuple(got) == (n, inside * (inside + 1) // 2 + (n - inside) * inside, inside)


def crowd(spark, n, sensors_, parts, step=40_000):
    """``n`` requests of a few sensors every ``step`` microseconds, read by ``parts`` tasks; sequences rise and fall back."""
    start = 28_401_000 * MINUTE
    return spark.range(n).repartition(parts).select(
        F.col("id").alias("arrival"), F.concat(F.lit("s"), F.col("id") % sensors_).alias("sensor_id"),
        F.timestamp_add("MICROSECOND", F.col("id") * step + start, F.expr("timestamp_ntz'1970-01-01'")).alias("received_at"),
        F.when(F.col("id") % 3 == 0, "heartbeat").otherwise("telemetry").alias("kind"),
        (F.expr("id div 40") + F.col("id") % 2).alias("sequence"), F.concat(F.lit("h"), F.col("id") % 5).alias("batch_hash"),
    )


def plain(frame, limit):
    rows = sorted(((r["sensor_id"], round((r["received_at"] - EPOCH) / timedelta(microseconds=1)), r["arrival"], r["kind"], r["sequence"], r["batch_hash"]) for r in frame.collect()))
    want = {}
    for sensor in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == sensor]
        want.update(zip([r[2] for r in mine], naive.admit([(r[1], *r[3:]) for r in mine], limit)))
    return want


@pytest.fixture
def large_joins(spark):
    """Joins as of larger tables: planned as merges, changed where one side turns out small, and dealt to many tasks."""
    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.openCostInBytes": "64m",
    }
    before = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("most", [100_000, 0])
def test_a_crowded_sensor_has_one_state_however_many_tasks_read_it(spark, large_joins, monkeypatch, tmp_path, most):
    monkeypatch.setattr(sensors, "BROADCAST_SENSORS", most, raising=False)
    crowd(spark, 12_000, 2, 6).write.parquet(f"{tmp_path}/requests")
    frame = spark.read.parquet(f"{tmp_path}/requests")
    got = {r["arrival"]: r["decision"] for r in sensors.admit_telemetry(frame, FreshnessPolicy(requests_per_minute=5)).collect()}
    assert got == plain(frame, 5)


def test_admission_of_calm_and_crowded_sensors_together(spark):
    frame = crowd(spark, 3_000, 2, 4).filter("sensor_id = 's0' or arrival % 101 = 0")
    got = {r["arrival"]: r["decision"] for r in sensors.admit_telemetry(frame, FreshnessPolicy(requests_per_minute=50)).collect()}
    assert got == plain(frame, 50)
    lost = frame.withColumn("received_at", F.lit(None).cast("timestamp_ntz")).unionByName(frame.withColumn("sensor_id", F.lit(None).cast("string")))
    assert sensors.admit_telemetry(lost, FreshnessPolicy(requests_per_minute=50)).collect() == []


def test_admission_reads_requests_only_for_the_kinds_of_sensors_there_are(spark):
    frame = crowd(spark, 1_000, 2, 4)
    for limit, absent in ((1_000_000_000, "MapInPandas"), (5, "Window")):
        decided = sensors.admit_telemetry(frame, FreshnessPolicy(requests_per_minute=limit))
        assert absent not in decided._jdf.queryExecution().optimizedPlan().toString()
        assert {r["arrival"]: r["decision"] for r in decided.collect()} == plain(frame, limit)


def test_admission_in_a_crowded_minute_takes_no_time_by_its_square(spark):
    frame = crowd(spark, 100_000, 1, 4, step=1_000)
    begun = time.monotonic()
    got = {r["arrival"]: r["decision"] for r in sensors.admit_telemetry(frame, FreshnessPolicy(requests_per_minute=1_000_000_000)).collect()}
    assert time.monotonic() - begun < 30
    assert got == plain(frame, 1_000_000_000)
