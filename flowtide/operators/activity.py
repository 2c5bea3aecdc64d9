"""Source activity, growth, priorities and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.config import ACTIVITY_COLUMNS, ACTIVITY_MEASURES, MICROS, MODE_THRESHOLDS
from flowtide.functions.expressions import (
    canonical_key, col, day_text, fixed2, micros, percent_text, per_second, priority_label, priority_rank,
    recommendation, score_class, seconds_between, window_start,
)
from flowtide.functions.ordered import previous
from flowtide.operators.cleaning import require_columns, split_valid


def source_activity(packets: DataFrame, interval_seconds: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Thirteen measures per (source, interval) of normalized packets.

    Packets are first added up per observed flow, so a busy source reaches the second
    shuffle as one row per flow and the distinct counts run over few rows.  The mean gap
    of sorted times is (last - first) / (n - 1), which needs no sort.
    """
    keys = list(keys)
    key_columns = [col(k) for k in keys]
    has = lambda flag: F.count_if(F.array_contains("tcp_flags", flag))
    rows = packets.withColumn("_start", window_start(F.col("timestamp"), interval_seconds))
    flows = rows.groupBy(
        *key_columns, "_start", "source_ip", "destination_ip", "source_port", "destination_port", "protocol",
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("packet_length").alias("bytes"), F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"), has("SYN").alias("syn"), has("ACK").alias("ack"), has("RST").alias("rst"),
    )
    grouped = flows.withColumn("_flow", canonical_key()).groupBy(*key_columns, "_start", "source_ip").agg(
        F.count_distinct("_flow").alias("flow_count"),
        F.sum("n").alias("packet_count"),
        F.sum("bytes").cast("double").alias("byte_count"),
        F.count_distinct("destination_ip").alias("unique_destinations"),
        F.count_distinct("destination_port").alias("unique_destination_ports"),
        F.min("first").alias("_first"),
        F.max("last").alias("_last"),
        F.sum("syn").alias("syn_count"),
        F.sum("ack").alias("ack_count"),
        F.sum("rst").alias("rst_count"),
    )
    gaps = F.col("packet_count") - 1
    return grouped.withColumns(
        {
            "interval_start": F.col("_start"),
            "interval_end": F.timestamp_add("SECOND", F.lit(interval_seconds), F.col("_start")),
            "capture_day": day_text(F.col("_start")),
            "mean_packet_size": F.col("byte_count") / F.col("packet_count"),
            "mean_iat": F.when(gaps > 0, seconds_between(F.col("_last"), F.col("_first")) / gaps).otherwise(0.0),
            "packet_rate": per_second(F.col("packet_count"), interval_seconds),
            "byte_rate": per_second(F.col("byte_count"), interval_seconds),
        }
    ).select(*key_columns, *ACTIVITY_COLUMNS)


def source_growth(activity: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Relative change to the previous observed interval of the same source.

    The history of a source is cut by day, so a source that is always there is many tasks.
    """
    require_columns(activity, ACTIVITY_COLUMNS)
    measures = {"flow_growth": "flow_count", "packet_growth": "packet_count", "byte_growth": "byte_count"}
    rows = previous(
        activity.withColumn("_day", F.col("interval_start").cast("date")), [*keys, "source_ip"], "_day", [F.col("interval_start")], {f"_before_{c}": c for c in measures.values()}
    )

    def growth(measure: str) -> Column:
        before = F.col(f"_before_{measure}")
        return F.coalesce((col(measure) - before) / F.greatest(before, F.lit(1)), F.lit(0.0)).cast("double")

    return rows.withColumns({name: growth(c) for name, c in measures.items()}).drop("_day", *[f"_before_{c}" for c in measures.values()])


def attach_forecast_context(activity: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest forecast at or before the end of each activity interval.

    ``forecasts`` has ``forecast_time``, ``forecast_score`` and ``network_warning``.  The
    as-of step runs over distinct interval ends of a key, the rows then join by equality.
    """
    keys = list(keys)
    key_columns = [col(k) for k in keys]
    day = F.floor(F.col("_us") / (86_400 * MICROS)).cast("bigint")
    ends = activity.select(*key_columns, micros(F.col("interval_end")).alias("_us")).distinct()
    facts = forecasts.groupBy(*key_columns, micros(F.col("forecast_time")).alias("_us")).agg(
        F.max(F.struct("forecast_score", "network_warning")).alias("_fact")
    )
    events = facts.withColumn("_probe", F.lit(1)).unionByName(
        ends.withColumns({"_fact": F.lit(None).cast(facts.schema["_fact"].dataType), "_probe": F.lit(2)})
    ).withColumn("_day", day)
    inside = W.partitionBy(*key_columns, "_day").orderBy("_us", "_probe")
    events = events.withColumn("_same_day", F.last("_fact", ignorenulls=True).over(inside))
    last = facts.withColumn("_day", day).groupBy(*key_columns, "_day").agg(F.max_by("_fact", "_us").alias("_end_of_day"))
    days = events.select(*key_columns, "_day").distinct().join(last, [*keys, "_day"], "left")
    across = W.partitionBy(*(key_columns or [F.lit(0)])).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(*key_columns, "_day", F.last("_end_of_day", ignorenulls=True).over(across).alias("_earlier"))
    answers = events.filter(F.col("_probe") == 2).join(days, [*keys, "_day"]).select(
        *key_columns, F.col("_us").alias("_end_us"), F.coalesce("_same_day", "_earlier").alias("_context")
    )
    return (
        activity.withColumn("_end_us", micros(F.col("interval_end")))
        .join(answers, [*keys, "_end_us"], "left")
        .withColumns(
            {
                "forecast_available": F.col("_context").isNotNull(),
                "forecast_score": F.col("_context.forecast_score"),
                "network_warning": F.col("_context.network_warning"),
            }
        )
        .drop("_end_us", "_context")
    )


def with_single_forecast(activity: DataFrame, score: float | None, warning: bool | None) -> DataFrame:
    """The same forecast on every activity row."""
    return activity.withColumns(
        {
            "forecast_available": F.lit(score is not None),
            "forecast_score": F.lit(score).cast("double"),
            "network_warning": F.lit(warning).cast("boolean"),
        }
    )


def priority_points(with_growth: DataFrame) -> DataFrame:
    """Points, label and measured reasons of rows with growth and forecast context."""
    growth, packets, volume = F.col("flow_growth"), F.col("packet_rate"), F.col("byte_rate")
    strong = (packets >= 3.0) | (volume >= 5000.0)
    weak = (packets >= 1.0) | (volume >= 1000.0)
    destinations, ports = F.col("unique_destinations"), F.col("unique_destination_ports")
    warned = F.coalesce(F.col("network_warning"), F.lit(False))
    points = (
        F.when(growth >= 0.5, 2).when(growth > 0, 1).otherwise(0)
        + F.when(strong, 2).when(weak, 1).otherwise(0)
        + F.when(destinations >= 3, 1).otherwise(0)
        + F.when(ports >= 3, 1).otherwise(0)
        + F.when(warned, 1).otherwise(0)
    )
    reasons = F.concat_ws(
        "; ",
        F.when(growth > 0, F.concat(F.lit("flow_count growth "), percent_text(growth))),
        F.when(weak | strong, F.concat(F.lit("packet_rate="), fixed2(packets), F.lit("/s, byte_rate="), fixed2(volume), F.lit("/s"))),
        F.when(destinations >= 3, F.concat(F.lit("destinations="), destinations.cast("bigint").cast("string"))),
        F.when(ports >= 3, F.concat(F.lit("destination_ports="), ports.cast("bigint").cast("string"))),
        F.when(warned, F.lit("network forecast is elevated")),
    )
    return with_growth.withColumns(
        {
            "priority_points": points,
            "priority": priority_label(points),
            "measured_reasons": F.when(reasons == "", F.lit("no threshold crossed")).otherwise(reasons),
            "risk_status": F.lit("candidate source"),
        }
    )


def prioritize_sources(activity: DataFrame, forecasts: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Growth, points, label and reasons per source and interval (H2).

    ``forecasts`` may be a forecast table (as-of joined) or None; rows that already
    carry ``network_warning`` keep it.
    """
    grown = source_growth(activity, keys)
    if forecasts is not None:
        grown = attach_forecast_context(grown, forecasts, keys)
    elif "network_warning" not in grown.columns:
        grown = with_single_forecast(grown, None, None)
    return priority_points(grown)


def source_risk(activity: DataFrame) -> DataFrame:
    """Candidate-source records with the measures as one struct (H5)."""
    return activity.select(
        "source_ip", "interval_start", "interval_end", F.struct(*ACTIVITY_MEASURES).alias("activity_features"),
        F.lit("candidate source").alias("risk_status"),
    )


def priorities_with_risk(priorities: DataFrame, risk: DataFrame) -> DataFrame:
    """Priorities with the measures of the same source and interval (C4)."""
    return priorities.join(
        risk.select("source_ip", "interval_start", "activity_features"), ["source_ip", "interval_start"], "left"
    )


def recommendations(priorities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recommendation per row, rows with an unknown priority) (H3)."""
    valid, rejected = split_valid(priorities, [("unsupported_priority", recommendation(F.col("priority")).isNull())])
    return (
        valid.withColumns(
            {
                "priority": F.upper("priority"),
                "recommendation": recommendation(F.col("priority")),
                "automatic_block": F.lit(False),
            }
        ),
        rejected,
    )


def latest_per_source(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Newest row of each source."""
    others = [c for c in rows.columns if c not in (*keys, "source_ip")]
    newest = rows.groupBy(*[col(k) for k in keys], "source_ip").agg(
        F.max_by(F.struct(*[col(c) for c in others]), "interval_start").alias("_row")
    )
    return newest.select(*[col(k) for k in keys], "source_ip", *[F.col("_row")[c].alias(c) for c in others])


def source_first_last_seen(activity: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last seen of each source; ``active`` marks sources of the newest interval."""
    seen = activity.groupBy(*[col(k) for k in keys], "source_ip").agg(
        F.min("interval_start").alias("first_seen"), F.max("interval_end").alias("last_seen"),
        F.max("interval_start").alias("_latest"),
    )
    if keys:
        newest = seen.groupBy(*[col(k) for k in keys]).agg(F.max("_latest").alias("_newest"))
        joined = seen.join(newest, list(keys))
    else:
        newest = seen.agg(F.max("_latest").alias("_newest"))
        joined = seen.withColumn("_one", F.lit(1)).join(newest.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return joined.withColumn("active", F.col("_latest") == F.col("_newest")).drop("_latest", "_newest")


def rank_sources(priorities: DataFrame, with_packets: bool = True) -> DataFrame:
    """Sort by priority, points, packets and address (F1)."""
    order = [priority_rank(F.col("priority")), F.col("priority_points").desc()]
    if with_packets:
        order.append(F.col("packet_count").desc())
    return priorities.orderBy(*order, F.col("source_ip"))


def rate_limit_what_if(rates: DataFrame, rate: str = "packet_rate", limit: str = "recommended_limit") -> tuple[DataFrame, DataFrame]:
    """Allowed and throttled rate of every row for a proposed limit (H1)."""
    bad = lambda c: col(c).isNull() | F.isnan(col(c).cast("double")) | (F.abs(col(c).cast("double")) == float("inf"))
    valid, rejected = split_valid(
        rates, [("rate_not_finite", bad(rate) | bad(limit)), ("negative_rate", (col(rate) < 0) | (col(limit) < 0))]
    )
    allowed = F.least(col(rate).cast("double"), col(limit).cast("double"))
    throttled = col(rate).cast("double") - allowed
    return (
        valid.withColumns(
            {
                "simulated_allowed_rate": allowed,
                "throttled_amount": throttled,
                "percentage_reduction": F.coalesce(F.try_divide(throttled, col(rate).cast("double")) * 100.0, F.lit(0.0)),
            }
        ),
        rejected,
    )


def policy_decisions(scores: DataFrame, mode: str = "balanced", score: str = "score") -> DataFrame:
    """Threshold, state and label of every score under one operating mode (H4)."""
    if mode not in MODE_THRESHOLDS:
        raise ValueError(f"unknown operating mode: {mode}")
    threshold = F.lit(MODE_THRESHOLDS[mode])
    state = score_class(col(score), threshold)
    return scores.withColumns(
        {
            "mode": F.lit(mode),
            "threshold": threshold,
            "state": state,
            "label_text": F.when(state == "warning", F.lit("Predictive warning")).otherwise(F.lit("No predictive warning")),
        }
    )
