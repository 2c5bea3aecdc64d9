"""Sensor telemetry: envelopes, admission, freshness, fleet."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.config import (
    ACTIVITY_MEASURES, INTERVAL, MAX_ACTIVITY_PER_ENVELOPE, MAX_SOURCES_PER_WINDOW, MAX_STATES_PER_ENVELOPE, MICROS,
    STATE_FEATURES, FreshnessPolicy,
)
from flowtide.functions.durable import cut
from flowtide.functions.expressions import col, day_text, is_finite, micros, seconds_between
from flowtide.functions.ordered import position, prefix
from flowtide.operators.cleaning import split_valid


# --- A16, B21, B22 -------------------------------------------------------


def build_envelopes(states: DataFrame, sensor: str = "sensor_id", batch_size: int = 6, first_sequence: int = 1) -> DataFrame:
    """Consecutive batches of states per sensor with rising sequence numbers.

    State positions come from counts per day, so a sensor's history is not ordered in one task.
    """
    if not 1 <= batch_size <= MAX_STATES_PER_ENVELOPE:
        raise ValueError(f"batch_size must be 1..{MAX_STATES_PER_ENVELOPE}")
    timed = states.withColumn("_us", micros(F.col("timestamp"))).withColumn(
        "_day", F.floor(F.col("_us") / (86_400 * MICROS)).cast("bigint")
    )
    placed = position(timed, [sensor], ["_day"], [F.col("_us")], "_position")
    entries = [x for f in STATE_FEATURES for x in (F.lit(f), col(f).cast("double"))]
    point = F.struct(F.col("timestamp"), F.col("capture_day"), F.create_map(*entries).alias("features"))
    batches = placed.groupBy(col(sensor), F.floor(F.col("_position") / batch_size).cast("bigint").alias("_batch")).agg(
        F.array_sort(F.collect_list(point), lambda a, b: F.when(a["timestamp"] < b["timestamp"], -1).when(a["timestamp"] > b["timestamp"], 1).otherwise(0)).alias("states")
    )
    return batches.select(
        F.lit("1").alias("schema_version"), col(sensor), (F.col("_batch") + first_sequence).alias("sequence"), "states",
        F.size("states").alias("state_count"),
    )


def batch_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the JSON text of the named columns in fixed order."""
    return F.sha2(F.to_json(F.struct(*[col(c) for c in columns])), 256)


def validate_state_batch(points: DataFrame, sensor: str = "sensor_id", sequence: str = "sequence", index: str = "state_index") -> DataFrame:
    """Verdict per envelope: contiguous steps, one day, right dates, exact feature names.

    ``points`` has one row per state with ``timestamp``, ``capture_day`` and a ``features`` map.
    """
    w = W.partitionBy(col(sensor), col(sequence)).orderBy(col(index))
    step = seconds_between(F.col("timestamp"), F.lag("timestamp").over(w))
    expected = F.array(*[F.lit(f) for f in sorted(STATE_FEATURES)])
    names = F.array_sort(F.map_keys("features"))
    rows = points.withColumns({"_step": step, "_names_ok": names == expected})
    facts = rows.groupBy(col(sensor), col(sequence)).agg(
        F.count(F.lit(1)).alias("state_count"),
        F.count_if(F.col("_step").isNotNull() & (F.col("_step") != INTERVAL)).alias("_gaps"),
        F.count_distinct("capture_day").alias("_days"),
        F.count_if(day_text(F.col("timestamp")) != F.col("capture_day").cast("string")).alias("_off"),
        F.count_if(~F.col("_names_ok")).alias("_names"),
    )
    reason = (
        F.when(F.col("state_count") > MAX_STATES_PER_ENVELOPE, "too_many_states").when(F.col("_names") > 0, "wrong_features")
        .when(F.col("_off") > 0, "outside_capture_day").when(F.col("_days") > 1, "several_days")
        .when(F.col("_gaps") > 0, "not_contiguous")
    )
    return facts.select(col(sensor), col(sequence), "state_count", F.coalesce(reason, F.lit("ok")).alias("reason"))


def validate_source_activity(rows: DataFrame, keys: Sequence[str] = ("sensor_id", "sequence"), interval_seconds: int = INTERVAL):
    """(usable activity rows, rejected rows) of telemetry envelopes."""
    start, end = F.col("interval_start"), F.col("interval_end")
    step = interval_seconds * MICROS
    key_columns = [col(k) for k in keys]
    sizes = rows.groupBy(*key_columns).agg(F.count(F.lit(1)).alias("_envelope_rows"))
    windows = rows.groupBy(*key_columns, "interval_start").agg(F.count_distinct("source_ip").alias("_window_sources"))
    copies = rows.groupBy(*key_columns, "interval_start", "source_ip").agg(F.count(F.lit(1)).alias("_copies"))
    marked = (
        rows.join(sizes, list(keys)).join(windows, [*keys, "interval_start"]).join(copies, [*keys, "interval_start", "source_ip"])
    )
    valid, rejected = split_valid(
        marked,
        [
            ("outside_capture_day", (day_text(start) != F.col("capture_day").cast("string")) | (day_text(end) != F.col("capture_day").cast("string"))),
            ("wrong_length", micros(end) - micros(start) != step),
            ("not_aligned", micros(start) % step != 0),
            *[(f"invalid:{m}", ~is_finite(col(m)) | (col(m) < 0)) for m in ACTIVITY_MEASURES],
            *[(f"more_flags_than_packets:{f}", col(f) > F.col("packet_count")) for f in ("syn_count", "ack_count", "rst_count")],
            ("duplicate_source_window", F.col("_copies") > 1),
            ("too_many_sources", F.col("_window_sources") > MAX_SOURCES_PER_WINDOW),
            ("too_many_rows", F.col("_envelope_rows") > MAX_ACTIVITY_PER_ENVELOPE),
        ],
    )
    helpers = ["_envelope_rows", "_window_sources", "_copies"]
    return valid.drop(*helpers), rejected.drop(*helpers)


# --- K9, K10 -------------------------------------------------------------

#: Sensors sent to every task as a table; requests of more are dealt out by sensor to be told apart.
BROADCAST_SENSORS = 100_000
DECISIONS = ("accepted", "duplicate", "conflict", "rate_limited")


class Admission:
    """Admission state of one sensor: last accepted batch and the admitted times of the last minute."""

    __slots__ = ("sequence", "digest", "times", "limit")

    def __init__(self, limit: int, sequence: int = 0, digest: str = "", times: Sequence[int] = ()) -> None:
        self.limit, self.sequence, self.digest, self.times = limit, sequence, digest, deque(times)

    def decide(self, us: int, kind: str, sequence: int, digest: str) -> str:
        if kind == "telemetry":
            if sequence == self.sequence and digest == self.digest:
                return "duplicate"
            if sequence <= self.sequence:
                return "conflict"
        while self.times and self.times[0] < us - 60 * MICROS:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return "rate_limited"
        self.times.append(us)
        if kind == "telemetry":
            self.sequence, self.digest = sequence, digest
        return "accepted"


def request_rate(requests: DataFrame, sensor: str = "sensor_id", ts: str = "received_at", seconds: int = 60) -> DataFrame:
    """Requests of the same sensor in the minute up to each request.

    Requests shrink to counts per time; each minute block sees its own and the previous block.  A count joins the sum of its
    block at its time and leaves that of the next block a minute later, so a running sum serves and no minute is added up anew
    for each request.
    """
    length = seconds * MICROS
    timed = requests.select(col(sensor), micros(col(ts)).alias("_us")).filter("_us is not null")
    times = timed.groupBy(col(sensor), "_us").agg(F.count(F.lit(1)).alias("_n"))
    home = F.col("_us") - F.pmod(F.col("_us"), F.lit(length))
    joins = F.struct(home.alias("_block"), F.col("_us"), F.col("_n").alias("_change"))
    leaves = F.struct((home + length).alias("_block"), (F.col("_us") + length + 1).alias("_us"), (-F.col("_n")).alias("_change"))
    spread = times.select(col(sensor), F.explode(F.array(joins, leaves)).alias("_c")).select(col(sensor), "_c.*")
    w = W.partitionBy(col(sensor), "_block").orderBy("_us")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    leaving = F.sum(F.when(F.col("_change") < 0, F.col("_change")).otherwise(0)).over(whole)
    counted = spread.withColumn("requests_last_minute", F.sum("_change").over(w) - leaving).filter(F.col("_change") > 0)
    return counted.select(col(sensor), "_us", F.col("_change").alias("requests_now"), "requests_last_minute")


def admit_telemetry(requests: DataFrame, policy: FreshnessPolicy = FreshnessPolicy(), sensor: str = "sensor_id") -> DataFrame:
    """Decision for every telemetry batch and heartbeat in arrival order.

    ``requests``: sensor, received_at, arrival (unique order), kind, sequence, batch_hash.
    The rate limit counts admitted requests only.  A sensor that never has more requests
    per minute than the limit cannot be limited, and then a batch is accepted exactly when
    its sequence exceeds every earlier one: a running maximum, computed in blocks.  Only
    sensors above the limit need the request-by-request rule; their rows go by in order
    through a constant-size state, never held as a group.  The sensors are told apart by a
    job that runs here, so that a table with sensors of one kind only is not read for the other.
    """
    limit = policy.requests_per_minute
    pressured = cut(request_rate(requests, sensor).groupBy(col(sensor)).agg(
        (F.max("requests_last_minute") > limit).alias("_pressured")
    ))
    sensors = {r["_pressured"]: r["count"] for r in pressured.groupBy("_pressured").count().collect()}
    few = sum(sensors.values()) <= BROADCAST_SENSORS
    marked = requests.join(F.broadcast(pressured) if few else pressured, sensor)
    calm = lambda: _admit_calm(marked.filter(~F.col("_pressured")).drop("_pressured"), sensor)
    in_order = lambda: _admit_in_order(marked.filter("_pressured").drop("_pressured"), limit, sensor)
    if True not in sensors:
        return calm()
    return calm().unionByName(in_order()) if False in sensors else in_order()


def _admit_calm(requests: DataFrame, sensor: str) -> DataFrame:
    columns = requests.columns
    batches = requests.withColumns(
        {
            "_batch": F.when((F.col("kind") == "telemetry") & (F.col("sequence") > 0), F.struct("sequence", (-F.col("arrival")).alias("first"), "batch_hash")),
            "_day": F.floor(micros(F.col("received_at")) / (86_400 * MICROS)).cast("bigint"),
            "_minute": F.floor(micros(F.col("received_at")) / (60 * MICROS)).cast("bigint"),
        }
    )
    seen = prefix(batches, [sensor], ["_day", "_minute"], [micros(F.col("received_at")), F.col("arrival")], {"_top": ("max", "_batch")})
    top = F.coalesce(F.col("_top.sequence"), F.lit(0))
    decision = (
        F.when(F.col("kind") != "telemetry", "accepted").when(F.col("sequence") > top, "accepted")
        .when((F.col("sequence") == top) & F.col("batch_hash").eqNullSafe(F.col("_top.batch_hash")), "duplicate")
        .otherwise("conflict")
    )
    return seen.withColumn("decision", decision).select(*[col(c) for c in columns], "decision")


def _admit_in_order(requests: DataFrame, limit: int, sensor: str) -> DataFrame:
    columns = requests.columns
    schema = requests.withColumn("decision", F.lit("")).schema
    # Dealt by a hash: a deal by the sensor itself may be left out behind a join by sensor, which is free to undo it.
    ordered = (
        requests.withColumn("_us", micros(F.col("received_at")))
        .repartition(F.xxhash64(col(sensor))).sortWithinPartitions(col(sensor), "_us", "arrival")
    )

    def run(frames):
        name, state = None, None
        for pdf in frames:
            decisions = []
            rows = zip(pdf[sensor], pdf["_us"], pdf["kind"], pdf["sequence"], pdf["batch_hash"])
            for who, us, kind, sequence, digest in rows:
                if who != name:
                    name, state = who, Admission(limit)
                number = 0 if sequence is None or pd.isna(sequence) else int(sequence)
                decisions.append(state.decide(int(us), kind, number, digest))
            yield pdf[columns].assign(decision=decisions)

    return ordered.mapInPandas(run, schema)


# --- K11-K14, C9, D13 ----------------------------------------------------


def sensor_status(sensors: DataFrame, heartbeats: DataFrame, telemetry: DataFrame, as_of: Column, policy: FreshnessPolicy = FreshnessPolicy()) -> DataFrame:
    """Status and ages of every registered sensor at one moment.

    ``sensors``: sensor_id, registration_state.  ``heartbeats`` and ``telemetry``: sensor_id,
    received_at of admitted requests; later ones than ``as_of`` do not count.
    """
    latest = lambda df, name: df.filter(F.col("received_at") <= as_of).groupBy("sensor_id").agg(F.max("received_at").alias(name))
    rows = sensors.join(latest(heartbeats, "last_heartbeat"), "sensor_id", "left").join(latest(telemetry, "last_telemetry_at"), "sensor_id", "left")
    rows = rows.withColumns(
        {
            "last_seen": F.greatest("last_heartbeat", "last_telemetry_at"),
            "heartbeat_age": seconds_between(as_of, F.col("last_heartbeat")),
            "telemetry_age": seconds_between(as_of, F.col("last_telemetry_at")),
        }
    )
    alive = F.coalesce(F.col("heartbeat_age") <= policy.heartbeat_timeout_seconds, F.lit(False))
    fresh = F.coalesce(F.col("telemetry_age") <= policy.telemetry_stale_seconds, F.lit(False))
    return rows.withColumns(
        {
            "status": F.when(F.col("registration_state") == "DISABLED", "OFFLINE").when(F.col("last_seen").isNull(), "REGISTERED")
            .when(~alive, "OFFLINE").when(fresh, "ONLINE").otherwise("DEGRADED"),
            "agent_status": F.when(F.col("last_heartbeat").isNull(), "UNKNOWN").when(alive, "ONLINE").otherwise("OFFLINE"),
            "telemetry_status": F.when(F.col("last_telemetry_at").isNull(), "UNKNOWN").when(fresh, "FRESH").otherwise("STALE"),
        }
    )


def source_status(sensors: DataFrame, receipts: DataFrame, as_of: Column, policy: FreshnessPolicy = FreshnessPolicy()) -> DataFrame:
    """Source attribution status per sensor (K12). ``receipts``: sensor_id, received_at, candidate_sources."""
    facts = receipts.filter(F.col("received_at") <= as_of).groupBy("sensor_id").agg(
        F.max("received_at").alias("last_received_at"), F.max_by("candidate_sources", "received_at").alias("candidate_sources")
    )
    age = seconds_between(as_of, F.col("last_received_at"))
    status = (
        F.when(F.col("last_received_at").isNull(), "NO_SOURCE_ATTRIBUTION").when(F.col("candidate_sources") == 0, "NO_CANDIDATE_SOURCES")
        .when(age > policy.source_stale_seconds, "SOURCE_DATA_STALE").otherwise("SOURCE_ATTRIBUTION_AVAILABLE")
    )
    return sensors.select("sensor_id").join(facts, "sensor_id", "left").withColumns({"age_seconds": age, "source_status": status})


def latest_forecast(runs: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """Forecast that stands after the newest state of each key.

    ``runs`` are states with ``run_id`` and ``history_length`` from ``contiguous_runs``;
    ``forecasts`` has the keys, ``reference_timestamp``, ``score`` and ``warning``.  Only a
    forecast of the current run stands: a gap or a new day clears it.
    """
    keys = list(keys)
    key_columns = [col(k) for k in keys]
    now = runs.groupBy(*key_columns).agg(
        F.max("timestamp").alias("latest_state_timestamp"),
        F.max_by(F.struct("capture_day", "run_id", "history_length"), "timestamp").alias("_now"),
        F.count(F.lit(1)).alias("state_count"),
    )
    starts = runs.groupBy(*key_columns, "capture_day", "run_id").agg(F.min("timestamp").alias("_run_start"))
    current = now.select(*key_columns, "latest_state_timestamp", "state_count", "_now.*").join(starts, [*keys, "capture_day", "run_id"])
    inside = forecasts.join(current.select(*keys, "_run_start", "latest_state_timestamp"), keys).filter(
        (F.col("reference_timestamp") >= F.col("_run_start")) & (F.col("reference_timestamp") <= F.col("latest_state_timestamp"))
    )
    newest = inside.groupBy(*key_columns).agg(
        F.max("reference_timestamp").alias("reference_timestamp"), F.max_by(F.struct("score", "warning"), "reference_timestamp").alias("_f")
    )
    return current.join(newest, keys, "left").select(
        *key_columns, "latest_state_timestamp", "state_count", "history_length", "reference_timestamp", F.col("_f.score").alias("score"),
        F.coalesce(F.col("_f.warning"), F.lit(False)).alias("latest_warning"),
        F.when(F.col("_f").isNotNull(), "FORECAST_READY").otherwise("BUILDING_HISTORY").alias("forecast_status"),
    )


def pipeline_readiness(stages: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Readiness state and seconds to each first stage.

    ``stages``: keys, stage (start, event, flow, state, forecast), happened_at.
    """
    names = ("start", "event", "flow", "state", "forecast")
    firsts = stages.groupBy(*[col(k) for k in keys]).agg(
        *[F.min(F.when(F.col("stage") == n, F.col("happened_at"))).alias(f"first_{n}") for n in names]
    )
    readiness = (
        F.when(F.col("first_event").isNull(), "INITIALIZING").when(F.col("first_flow").isNull(), "CAPTURING")
        .when(F.col("first_state").isNull(), "BUILDING_FLOW_HISTORY").when(F.col("first_forecast").isNull(), "BUILDING_NETWORK_HISTORY")
        .otherwise("FORECAST_READY")
    )
    base = F.coalesce("first_start", "first_event")
    return firsts.withColumns(
        {"readiness_state": readiness, **{f"seconds_to_{n}": F.greatest(F.lit(0.0), seconds_between(col(f"first_{n}"), base)) for n in names[1:]}}
    )


def fleet_summary(statuses: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Sensors with their latest runtime snapshot."""
    return statuses.join(snapshots, "sensor_id", "left").withColumns(
        {
            "forecast_ready": F.coalesce(F.col("forecast_status") == "FORECAST_READY", F.lit(False)),
            "latest_warning": F.coalesce("latest_warning", F.lit(False)),
            "state_count": F.coalesce("state_count", F.lit(0)),
            "history_length": F.coalesce("history_length", F.lit(0)),
        }
    )


def fleet_health(summary: DataFrame) -> DataFrame:
    """Sensors per status, active warnings and waiting forecasts."""
    of = lambda name: F.count_if(F.col("status") == name)
    return summary.agg(
        F.count(F.lit(1)).alias("sensor_count"),
        of("ONLINE").alias("online_sensor_count"),
        of("DEGRADED").alias("degraded_sensor_count"),
        of("OFFLINE").alias("offline_sensor_count"),
        F.count_if(F.col("latest_warning") & F.col("status").isin("ONLINE", "DEGRADED")).alias("active_warning_count"),
        F.count_if(~F.col("forecast_ready")).alias("forecast_waiting_count"),
    )
