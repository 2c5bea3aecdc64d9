"""Fixed-interval network states (C2, D1-D5, D10, E1, E5, E10, B17, K5/K6 batch forms)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.config import INTERVAL, INTERVALS, STATE_COLUMNS, STATE_FEATURES, STATE_META, STATE_TARGETS
from flowtide.functions.expressions import (
    col, day_text, is_finite, per_second, safe_ratio, seconds_between, slot, slot_start, window_start,
)
from flowtide.functions.ordered import log_bin
from flowtide.operators.cleaning import derive_flow_columns, split_valid, usable_flows

_SUMS = ["flow_count", "byte_sum", "packet_sum", "fwd_bytes", "fwd_packets", "syn", "ack", "rst"]
_MEANS = {
    "mean_duration": "_duration", "mean_iat": "_iat_mean", "iat_std": "_iat_std", "packet_size_mean": "_length_mean",
    "packet_size_std": "_length_std",
}


def _check_interval(seconds: int) -> None:
    if seconds not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}")


def densify(rows: DataFrame, keys: Sequence[str], interval_seconds: int | Column, number: str = "_slot", peek: str | None = None) -> DataFrame:
    """Add the missing interval numbers between the first and last of each key and day.

    Each row opens the gap up to its successor, so the complete index needs one window
    over the aggregated rows (at most one row per interval of a day) and no self-join.
    Added rows have nulls in every other column.  ``peek`` names a column whose value on
    the next interval of the day is wanted as ``_next``: 0 for an added interval, null at
    the end of the day.  ``interval_seconds`` may be a column, one of the keys.
    """
    w = W.partitionBy(*[col(k) for k in keys], F.floor(col(number) * interval_seconds / 86_400)).orderBy(col(number))
    ahead = {"_following": F.coalesce(F.lead(col(number)).over(w), col(number) + 1)}
    if peek:
        ahead["_ahead"] = F.lead(col(peek)).over(w)
    opened = rows.withColumns(ahead).withColumn("_filled", F.explode(F.sequence(col(number), F.col("_following") - 1)))
    real = F.col("_filled") == col(number)
    others = [c for c in rows.columns if c != number and c not in keys]
    looked = [F.when(F.col("_filled") < F.col("_following") - 1, F.lit(0)).otherwise(F.col("_ahead")).alias("_next")] if peek else []
    return opened.select(
        *[col(k) for k in keys], F.col("_filled").alias(number), *[F.when(real, col(c)).alias(c) for c in others], *looked
    )


def network_states(
    flows: DataFrame,
    interval_seconds: int = INTERVAL,
    mode: str = "supervised",
    keys: Sequence[str] = (),
    ts: str = "timestamp_parsed",
    day: str = "capture_date",
) -> DataFrame:
    """Seventeen features per interval, complete inside each capture day.

    ``keys`` adds grouping columns such as a sensor id.  Rows that cannot be used are
    left out; ``usable_flows`` returns them with a reason.
    """
    return granularity_states(flows, [interval_seconds], mode, keys, ts, day).drop("interval_seconds")


def _finish_states(rows: DataFrame, keys: Sequence[str], interval_seconds: int | Column, supervised: bool) -> DataFrame:
    zero = {c: F.coalesce(col(c), F.lit(0)) for c in [*_SUMS, "unique_destination_port_count"]}
    zero.update({c: safe_ratio(col(c), F.col("flow_count")) for c in _MEANS})
    zero["median_duration"] = F.coalesce(col("median_duration"), F.lit(0.0))
    if supervised:
        zero["malicious_flow_count"] = F.coalesce(col("malicious_flow_count"), F.lit(0))
    rows = rows.withColumns(zero)
    start = slot_start(F.col("_slot"), interval_seconds)
    rows = rows.withColumns(
        {
            "timestamp": start,
            "capture_day": day_text(start),
            "byte_sum": F.col("byte_sum").cast("double"),
            "packet_sum": F.col("packet_sum").cast("double"),
            "syn_flow_ratio": safe_ratio(F.col("syn"), F.col("flow_count")),
            "ack_flow_ratio": safe_ratio(F.col("ack"), F.col("flow_count")),
            "rst_flow_ratio": safe_ratio(F.col("rst"), F.col("flow_count")),
            "fwd_byte_share": safe_ratio(F.col("fwd_bytes"), F.col("byte_sum")),
            "fwd_packet_share": safe_ratio(F.col("fwd_packets"), F.col("packet_sum")),
            "bytes_per_second": per_second(F.col("byte_sum"), interval_seconds),
            "packets_per_second": per_second(F.col("packet_sum"), interval_seconds),
        }
    )
    if not supervised:
        return rows.select(*[col(k) for k in keys], *STATE_FEATURES, *STATE_META)
    rows = rows.withColumns(
        {
            "malicious_flow_ratio": safe_ratio(F.col("malicious_flow_count"), F.col("flow_count")),
            "binary_attack_state": F.coalesce("binary_attack_state", F.lit(0)),
            "future_attack_state": F.coalesce("_next", F.lit(-1)),
            "future_target_available": F.col("_next").isNotNull(),
        }
    )
    return rows.select(*[col(k) for k in keys], *STATE_META, *STATE_FEATURES, *STATE_TARGETS)


def future_target(states: DataFrame, keys: Sequence[str] = (), interval_seconds: int = INTERVAL) -> DataFrame:
    """Label of the next state of the same day, -1 and unavailable on the last one."""
    if "_slot" not in states.columns:
        states = states.withColumn("_slot", slot(F.col("timestamp"), interval_seconds))
    per_day = 86_400 // interval_seconds
    w = W.partitionBy(*[col(k) for k in keys], F.floor(F.col("_slot") / per_day)).orderBy("_slot")
    following = F.lead("binary_attack_state").over(w)
    return states.withColumns(
        {"future_attack_state": F.coalesce(following, F.lit(-1)), "future_target_available": following.isNotNull()}
    ).drop("_slot")


def single_window_state(flows: DataFrame, interval_start: str, interval_seconds: int = INTERVAL) -> DataFrame:
    """State of one completed interval (D4); the filter reaches the scan before aggregation."""
    start = F.lit(interval_start).cast("timestamp_ntz")
    end = F.timestamp_add("SECOND", F.lit(interval_seconds), start)
    inside = flows.filter((F.col("timestamp_parsed") >= start) & (F.col("timestamp_parsed") < end))
    return network_states(inside, interval_seconds, "inference")


def _weighted_quantile(counts: DataFrame, keys: Sequence[str], value: str, n: str, quantile: float, name: str):
    return F.percentile(col(value), F.lit(quantile), col(n)).alias(name)


def state_quality(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, empty share, flows per state and attack frequency (D3).

    Quantiles run over (flow_count, states) pairs, so their buffer holds distinct
    flow counts, not states.
    """
    keys = list(keys)
    supervised = "binary_attack_state" in states.columns
    attack = F.sum("binary_attack_state") if supervised else F.lit(0)
    pairs = states.groupBy(*[col(k) for k in keys], F.col("flow_count").cast("bigint").alias("flow_count")).agg(
        F.count(F.lit(1)).alias("n"), attack.alias("attacks")
    )
    busy = F.col("flow_count") > 0
    total = F.sum("n")
    measures = [
        total.alias("total_states"),
        F.coalesce(F.sum(F.when(busy, F.col("n"))), F.lit(0)).alias("nonempty_states"),
        F.coalesce(F.sum(F.when(~busy, F.col("n"))), F.lit(0)).alias("empty_states"),
        F.sum(F.col("flow_count") * F.col("n")).alias("total_flows"),
        _weighted_quantile(pairs, keys, "flow_count", "n", 0.5, "median_flows_per_state"),
        _weighted_quantile(pairs, keys, "flow_count", "n", 0.95, "p95_flows_per_state"),
        F.sum("attacks").alias("attack_states"),
        F.coalesce(F.sum(F.when(busy, F.col("attacks"))), F.lit(0)).alias("attack_nonempty"),
    ]
    out = pairs.groupBy(*[col(k) for k in keys]).agg(*measures)
    out = out.withColumns(
        {
            "empty_state_percentage": F.col("empty_states") * 100.0 / F.col("total_states"),
            "mean_flows_per_state": F.col("total_flows") / F.col("total_states"),
            "mean_flows_per_nonempty_state": F.try_divide("total_flows", "nonempty_states"),
        }
    )
    if supervised:
        out = out.withColumns(
            {
                "attack_frequency_all_states": F.col("attack_states") / F.col("total_states"),
                "attack_frequency_nonempty_states": F.try_divide("attack_nonempty", "nonempty_states"),
            }
        )
    return out.drop("attack_states", "attack_nonempty")


def granularity_states(
    flows: DataFrame, intervals: Sequence[int] = INTERVALS, mode: str = "supervised", keys: Sequence[str] = (), ts: str = "timestamp_parsed", day: str = "capture_date",
) -> DataFrame:
    """The states of several interval lengths at once: ``interval_seconds`` and the columns of ``network_states``.

    Flows are reduced once, to sums per unit (the lengths' greatest common divisor) and port and to counts per unit and
    duration; every length adds up these partial states, so no flow is shuffled once per length.  Partial states meet by
    the lengths' common multiple, inside which every interval lies.  A median comes from counts per unit and logarithmic
    bin, added up the same way: they tell which bins hold the middle, and only the durations of those are ranked.
    """
    for seconds in intervals:
        _check_interval(seconds)
    if mode not in ("supervised", "inference"):
        raise ValueError("mode must be supervised or inference")
    supervised, keys, lengths = mode == "supervised", list(keys), sorted(set(intervals))
    unit, anchor = math.gcd(*lengths), math.lcm(*lengths)
    usable, _ = usable_flows(flows, ts, day)
    derived = derive_flow_columns(usable, supervised).withColumn("_start", window_start(col(ts), unit))
    own = [col(k) for k in keys]
    number, far = slot(F.col("_start"), unit).alias("_unit"), F.floor(F.col("_unit") * unit / anchor).alias("_far")
    each = F.explode(F.array(*[F.lit(i) for i in lengths])).alias("interval_seconds")
    inside = F.floor(F.col("_unit") * unit / F.col("interval_seconds"))
    place = [*own, F.col("_far"), F.col("interval_seconds"), F.col("_slot")]

    sums = {"flow_count": F.lit(1), "byte_sum": col("_bytes"), "packet_sum": col("_packets"), "fwd_bytes": col("_fwd_bytes"), "fwd_packets": col("_fwd_packets"), "syn": col("_syn"), "ack": col("_ack"), "rst": col("_rst")}
    sums |= {name: col(source) for name, source in _MEANS.items()} | ({"malicious_flow_count": col("_malicious")} if supervised else {})
    ports = derived.groupBy(*own, "_start", col("Dst Port").alias("_port")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ports = ports.select("*", number).select("*", far).drop("_start").repartition(*own, "_far")
    rolled = ports.select("*", each).withColumn("_slot", inside).groupBy(*place, "_port").agg(*[F.sum(n).alias(n) for n in sums])
    rolled = rolled.groupBy(*place).agg(*[F.sum(n).alias(n) for n in sums], F.count("_port").alias("unique_destination_port_count"))

    pairs = derived.select(*own, "_start", col("_duration").alias("_v")).groupBy(*own, "_start", log_bin(F.col("_v"), 4).alias("_bin"), "_v").agg(F.count(F.lit(1)).alias("_n"))
    pairs = pairs.select(*own, number, "_bin", "_v", "_n").select("*", far)
    bins = pairs.groupBy(*own, "_far", "_unit", "_bin").agg(F.sum("_n").alias("_n")).repartition(*own, "_far")
    bins = bins.select("*", each).withColumn("_slot", inside).groupBy(*place, "_bin").agg(F.sum("_n").alias("_n"))
    ordered = W.partitionBy(*place)
    bins = bins.withColumns({"_upto": F.sum("_n").over(ordered.orderBy("_bin")), "_all": F.sum("_n").over(ordered)})
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    bins = bins.withColumns({"_before": F.col("_upto") - F.col("_n"), "_low": low, "_high": high}).where("_before <= _high and _upto > _low")
    # A unit lies in one interval of each length, so a pair meets the chosen bins of its common multiple and keeps its own.
    meet = [*keys, "_far", "_bin"]
    near = pairs.join(bins.select(*meet, "interval_seconds", "_slot", "_before", "_low", "_high"), meet).where(inside == F.col("_slot"))
    near = near.groupBy(*place, "_bin", "_v", "_before", "_low", "_high").agg(F.sum("_n").alias("_n"))
    ranked = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(W.partitionBy(*place, "_bin").orderBy("_v")))
    middle = ranked.where("_upto - _n <= _high and _upto > _low").groupBy(*place).agg(((F.min("_v") + F.max("_v")) / 2).alias("median_duration"))

    merged = rolled.join(middle, [*keys, "_far", "interval_seconds", "_slot"]).drop("_far")
    if supervised:
        merged = merged.withColumn("binary_attack_state", (F.col("malicious_flow_count") > 0).cast("int"))
    names = [*keys, "interval_seconds"]
    return _finish_states(densify(merged, names, F.col("interval_seconds"), peek="binary_attack_state" if supervised else None), names, F.col("interval_seconds"), supervised)


def granularity_comparison(flows: DataFrame, intervals: Sequence[int] = INTERVALS) -> DataFrame:
    """State quality of several interval lengths from one scan.

    Flows are counted once per greatest-common interval; every requested length adds up
    those counts, so flows are shuffled once whatever the number of lengths.
    """
    for seconds in intervals:
        _check_interval(seconds)
    usable, _ = usable_flows(flows)
    base = (
        usable.select(
            window_start(F.col("timestamp_parsed"), 1).alias("_start"),
            (~F.col("Label").eqNullSafe(F.lit("Benign"))).cast("int").alias("_malicious"),
        )
        .groupBy("_start")
        .agg(F.count(F.lit(1)).alias("flow_count"), F.sum("_malicious").alias("malicious_flow_count"))
        .withColumn("_second", slot(F.col("_start"), 1))
    )
    lengths = F.explode(F.array(*[F.lit(i) for i in intervals])).alias("interval_seconds")
    rolled = (
        base.select("*", lengths)
        .groupBy("interval_seconds", F.floor(F.col("_second") / F.col("interval_seconds")).alias("_slot"))
        .agg(F.sum("flow_count").alias("flow_count"), F.sum("malicious_flow_count").alias("malicious_flow_count"))
    )
    # A window per (length, day) holds at most 86,400 rows.
    w = W.partitionBy("interval_seconds", F.floor(F.col("_slot") * F.col("interval_seconds") / 86_400)).orderBy("_slot")
    gaps = rolled.withColumn("_gap", F.coalesce(F.lead("_slot").over(w) - F.col("_slot") - 1, F.lit(0)))
    real = gaps.groupBy("interval_seconds", "flow_count").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("malicious_flow_count") > 0).alias("attacks")
    )
    empty = gaps.groupBy("interval_seconds").agg(F.sum("_gap").alias("n")).filter(F.col("n") > 0).select(
        "interval_seconds", F.lit(0).cast("bigint").alias("flow_count"), "n", F.lit(0).cast("bigint").alias("attacks")
    )
    pairs = real.unionByName(empty)
    busy = F.col("flow_count") > 0
    return (
        pairs.groupBy("interval_seconds")
        .agg(
            F.sum("n").alias("total_states"),
            F.sum(F.when(busy, F.col("n")).otherwise(0)).alias("nonempty_states"),
            F.sum(F.when(~busy, F.col("n")).otherwise(0)).alias("empty_states"),
            F.sum(F.col("flow_count") * F.col("n")).alias("total_flows"),
            F.percentile("flow_count", F.lit(0.5), F.col("n")).alias("median_flows_per_state"),
            F.percentile("flow_count", F.lit(0.95), F.col("n")).alias("p95_flows_per_state"),
            F.sum("attacks").alias("attack_states"),
        )
        .withColumns(
            {
                "empty_state_percentage": F.col("empty_states") * 100.0 / F.col("total_states"),
                "mean_flows_per_state": F.col("total_flows") / F.col("total_states"),
                "mean_flows_per_nonempty_state": F.try_divide("total_flows", "nonempty_states"),
                "attack_frequency_all_states": F.col("attack_states") / F.col("total_states"),
                "attack_frequency_nonempty_states": F.try_divide("attack_states", "nonempty_states"),
            }
        )
        .drop("attack_states")
    )


def state_distribution(states: DataFrame) -> DataFrame:
    """States per day and future target value."""
    return states.groupBy("capture_day", "future_attack_state").agg(F.count(F.lit(1)).alias("states"))


def validate_states(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact columns, numeric non-boolean features, valid time inside its day, finite values."""
    if set(states.columns) != set(STATE_COLUMNS):
        missing = sorted(set(STATE_COLUMNS) - set(states.columns))
        extra = sorted(set(states.columns) - set(STATE_COLUMNS))
        raise ValueError(f"state columns differ: missing={missing} unexpected={extra}")
    for name in STATE_FEATURES:
        if not isinstance(states.schema[name].dataType, T.NumericType):
            raise ValueError(f"state feature {name} is not numeric")
    states = states.select(*STATE_COLUMNS)
    ts = F.expr("try_cast(`timestamp` as timestamp_ntz)")
    return split_valid(
        states,
        [
            ("invalid_timestamp", ts.isNull()),
            ("missing_capture_day", F.col("capture_day").isNull()),
            ("outside_capture_day", day_text(ts) != F.col("capture_day").cast("string")),
            *[(f"nonfinite:{c}", ~is_finite(F.col(c))) for c in STATE_FEATURES],
        ],
    )


def check_cadence(states: DataFrame, keys: Sequence[str] = ("capture_day",), interval_seconds: int = INTERVAL) -> DataFrame:
    """Rows that break the fixed cadence of their group in time order (E5)."""
    ts = F.col("timestamp").cast("timestamp_ntz")
    w = W.partitionBy(*[col(k) for k in keys], day_text(ts)).orderBy(ts)
    step = seconds_between(ts, F.lag(ts).over(w))
    reason = F.coalesce(
        F.when(day_text(ts) != F.col("capture_day").cast("string"), F.lit("wrong_day")),
        F.when(F.col("_step") <= 0, F.lit("not_increasing")),
        F.when(F.col("_step") != interval_seconds, F.lit("wrong_step")),
    )
    return states.withColumn("_step", step).withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        *[c for c in states.columns], F.col("_step").alias("step_seconds"), "reason"
    )


def contiguous_runs(states: DataFrame, keys: Sequence[str] = (), length: int = 10, interval_seconds: int = INTERVAL) -> DataFrame:
    """Islands of states exactly one interval apart; history length and readiness per state."""
    ts = F.col("timestamp").cast("timestamp_ntz")
    w = W.partitionBy(*[col(k) for k in keys], "capture_day").orderBy(ts)
    starts = F.coalesce((seconds_between(ts, F.lag(ts).over(w)) != interval_seconds).cast("int"), F.lit(1))
    runs = states.withColumn("_start", starts).withColumn("run_id", F.sum("_start").over(w).cast("bigint"))
    inside = W.partitionBy(*[col(k) for k in keys], "capture_day", "run_id").orderBy(ts)
    index = F.row_number().over(inside)
    return runs.withColumns(
        {"run_index": index, "history_length": F.least(index, F.lit(length)), "ready": index >= length}
    ).drop("_start")


def history_status(states: DataFrame, keys: Sequence[str] = (), length: int = 10, on_gap: str = "reset") -> DataFrame:
    """Buffer status of every state of a time-ordered history (batch form of K5 and K6).

    ``on_gap='wait'`` keeps the old history after a gap, so the rest of that day waits;
    ``on_gap='reset'`` starts again with the state after the gap.  A repeated time of one
    key is rejected.
    """
    if on_gap not in ("wait", "reset"):
        raise ValueError("on_gap must be wait or reset")
    ts = F.col("timestamp").cast("timestamp_ntz")
    # Copies are numbered per task first, so a large group of copies never meets in one task:
    # only the first copy of each task takes part in the second numbering.
    same = [*[col(k) for k in keys], col("capture_day"), ts]
    marked = states.withColumn("_task", F.spark_partition_id())
    marked = marked.withColumn("_local", F.row_number().over(W.partitionBy(*same, "_task").orderBy(F.lit(1))))
    rest = F.when(F.col("_local") == 1, F.lit(-1)).otherwise(F.col("_task"))
    marked = marked.withColumn("_final", F.row_number().over(W.partitionBy(*same, rest).orderBy(F.lit(1))))
    marked = marked.withColumn("_copy", F.greatest("_local", F.when(F.col("_local") == 1, F.col("_final")).otherwise(F.lit(2))))
    marked = marked.drop("_task", "_local", "_final")
    runs = contiguous_runs(marked.filter(F.col("_copy") == 1), keys, length)
    first_day = F.min("capture_day").over(W.partitionBy(*[col(k) for k in keys])) if keys else F.min("capture_day").over(
        W.partitionBy(F.lit(0))
    )
    days = marked.groupBy(*[col(k) for k in keys], "capture_day").agg(F.min(ts).alias("_first_ts"))
    days = days.withColumn("_first_day", first_day)
    runs = runs.join(days, [*keys, "capture_day"])
    opening = (ts == F.col("_first_ts")) & (F.col("capture_day") != F.col("_first_day"))
    stored = F.when(F.col("run_index") >= length, F.lit("ready")).otherwise(F.lit("buffering"))
    if on_gap == "wait":
        status = F.when(opening, F.lit("day_boundary_reset")).when(
            F.col("run_id") > 1, F.lit("waiting_for_next_valid_state")
        ).otherwise(stored)
    else:
        status = F.when(opening, F.lit("day_boundary_reset")).when(
            (F.col("run_index") == 1) & (F.col("run_id") > 1), F.lit("gap_reset")
        ).otherwise(stored)
    kept = runs.withColumn("status", status).drop("_copy", "_first_ts", "_first_day")
    refused = (
        marked.filter(F.col("_copy") > 1)
        .drop("_copy")
        .withColumns(
            {
                "run_id": F.lit(None).cast("bigint"), "run_index": F.lit(None).cast("int"),
                "history_length": F.lit(None).cast("int"), "ready": F.lit(False),
                "status": F.lit("rejected_duplicate"),
            }
        )
    )
    return kept.unionByName(refused)
