"""Packet events: validation, keys, rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.config import DEMO_STATUS, FLOW_NUMERIC, MICROS, PACKET_COLUMNS
from flowtide.functions.expressions import (
    canonical_key, col, day_text, flag_tokens, is_finite, micros, observed_key, source_is_forward,
)
from flowtide.functions.ordered import position, prefix
from flowtide.operators.cleaning import require_columns, split_valid

# Error wording to reject category, tested in this order.
REJECT_CATEGORIES = [
    ("non_ip", ["not ipv4 or ipv6"]),
    ("malformed_metadata", ["missing endpoints", "no capture timestamp"]),
    ("unsupported_protocol", ["unsupported", "protocol"]),
    ("missing_ports", ["port"]),
]


def _bad_port(name: str) -> Column:
    port = F.expr(f"try_cast(`{name}` as double)")
    return ~port.between(0, 65535) | (port % 1 != 0)


def _blank(name: str) -> Column:
    return F.trim(col(name).cast("string")) == ""


def normalize_packets(df: DataFrame, compact_flags: bool = False) -> tuple[DataFrame, DataFrame]:
    """(typed packets with ``tcp_flags`` as an array, rejected rows with a reason)."""
    require_columns(df, PACKET_COLUMNS)
    length = F.expr("try_cast(packet_length as double)")
    valid, rejected = split_valid(
        df,
        [
            ("no capture timestamp", F.expr("try_cast(`timestamp` as timestamp_ntz)").isNull()),
            ("missing endpoints: source_ip", _blank("source_ip")),
            ("missing endpoints: destination_ip", _blank("destination_ip")),
            ("missing protocol", _blank("protocol")),
            ("invalid port: source_port", _bad_port("source_port")),
            ("invalid port: destination_port", _bad_port("destination_port")),
            ("packet_length is not finite", ~is_finite(length)),
            ("packet_length is negative", length < 0),
        ],
    )
    flags = col("tcp_flags")
    if dict(df.dtypes)["tcp_flags"].startswith("array"):
        flags = F.concat_ws(" ", flags)
    typed = valid.withColumns(
        {
            "timestamp": F.expr("try_cast(`timestamp` as timestamp_ntz)"),
            "source_ip": col("source_ip").cast("string"),
            "destination_ip": col("destination_ip").cast("string"),
            "protocol": col("protocol").cast("string"),
            "source_port": F.expr("try_cast(source_port as double)").cast("int"),
            "destination_port": F.expr("try_cast(destination_port as double)").cast("int"),
            "packet_length": length,
            "tcp_flags": flag_tokens(flags, compact_flags),
        }
    )
    return typed, rejected


def with_flow_keys(packets: DataFrame) -> DataFrame:
    """Observed and canonical five-tuple keys and the direction of each packet."""
    forward = source_is_forward()
    pick = lambda yes, no: F.when(forward, col(yes)).otherwise(col(no))
    return packets.withColumns(
        {
            "observed_key": observed_key(),
            "flow_key": canonical_key(),
            "forward_ip": pick("source_ip", "destination_ip"),
            "forward_port": pick("source_port", "destination_port"),
            "reverse_ip": pick("destination_ip", "source_ip"),
            "reverse_port": pick("destination_port", "source_port"),
            "is_forward": forward,
        }
    )


def reject_category(reason: Column) -> Column:
    """Category of an ignored capture observation by its wording."""
    text = F.lower(reason)
    result = F.lit("parser_error")
    for name, words in reversed(REJECT_CATEGORIES):
        test = text.contains(words[0])
        for word in words[1:]:
            test = test | text.contains(word)
        result = F.when(test, F.lit(name)).otherwise(result)
    return result


def live_category(reason: Column) -> Column:
    """Category of an event refused by the live flow builder."""
    return F.when(reason.contains("chronological"), F.lit("out_of_order")).otherwise(F.lit("invalid_flow_event"))


def classify_packet_rejects(rejected: DataFrame) -> DataFrame:
    """Rejected rows per category."""
    return rejected.groupBy(reject_category(F.col("reason")).alias("category")).agg(F.count(F.lit(1)).alias("row_count"))


def packet_quality(valid: DataFrame, rejected: DataFrame, dropped: int = 0) -> DataFrame:
    """Seen, valid and ignored packets with percentages of two decimals."""
    counts = valid.select(F.lit(1).alias("ok")).unionByName(rejected.select(F.lit(0).alias("ok"))).agg(
        F.count(F.lit(1)).alias("packets_seen"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("valid_events"),
    )
    share = lambda part: F.coalesce(F.bround(F.try_divide(F.lit(100.0) * F.col(part), F.col("packets_seen")), 2), F.lit(0.0))
    return counts.withColumn("ignored_events", F.col("packets_seen") - F.col("valid_events")).withColumns(
        {
            "dropped_events": F.lit(dropped).cast("bigint"),
            "valid_percentage": share("valid_events"),
            "ignored_percentage": share("ignored_events"),
        }
    )


def validate_demo_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mixed flow and packet table: time valid, ``capture_day`` equal to the date of the time."""
    ts = F.expr("try_cast(`timestamp` as timestamp_ntz)")
    valid, rejected = split_valid(
        events,
        [
            ("no capture timestamp", ts.isNull()),
            ("missing capture_day", col("capture_day").isNull()),
            ("outside capture_day", day_text(ts) != col("capture_day").cast("string")),
        ],
    )
    packets, bad_packets = normalize_packets(valid)
    columns = rejected.columns
    return packets, rejected.select(*columns).unionByName(bad_packets.select(*columns))


def ordered_demo_events(events: DataFrame, arrival: str) -> tuple[DataFrame, DataFrame]:
    """(events in one stable order, rejected rows with a reason) of a table whose rows are both a flow and a packet.

    Every row carries the columns of a flow and of a packet, and ``demo_status``; a missing column is an error.  A row must
    be marked as demo data, have a valid time and lie on its ``capture_date``.  ``event_position`` counts valid events from 0
    by time, those of one time by ``arrival``, a unique number.  All columns stay.  Positions come from counts per minute,
    time and stretch of arrivals, so neither a table nor a moment with very many events is ordered in one task.
    """
    require_columns(events, ["capture_date", "Label", "Dst Port", *FLOW_NUMERIC, *PACKET_COLUMNS, "demo_status"])
    ts, day = F.expr("try_cast(`timestamp` as timestamp_ntz)"), col("capture_date").cast("string")
    valid, rejected = split_valid(
        events,
        [
            ("not marked as demo data", ~col("demo_status").eqNullSafe(F.lit(DEMO_STATUS))),
            ("no capture timestamp", ts.isNull()),
            ("missing capture_date", day.isNull()),
            ("outside capture_date", day_text(ts) != day),
        ],
    )
    timed = valid.withColumn("timestamp", ts).withColumn("_us", micros(col("timestamp"))).withColumns(
        {"_minute": F.floor(F.col("_us") / (60 * MICROS)).cast("bigint"), "_stretch": F.floor(col(arrival) / 10_000).cast("bigint")}
    )
    placed = position(timed, [], ["_minute", "_us", "_stretch"], [col(arrival)], "event_position")
    return placed.drop("_us", "_minute", "_stretch"), rejected


def order_violations(
    events: DataFrame, keys: Sequence[str], arrival: str, ts: str = "timestamp", interval_seconds: int | None = None
) -> DataFrame:
    """Events that arrive late, repeat the newest time, or (with an interval) leave a gap.

    The newest earlier time of a key is a running maximum over arrival blocks.
    """
    at = events.withColumn("_us", micros(col(ts))).withColumns(
        {"_l1": F.floor(col(arrival) / 10_000_000).cast("bigint"), "_l2": F.floor(col(arrival) / 10_000).cast("bigint")}
    )
    seen = prefix(at, keys, ["_l1", "_l2"], [col(arrival)], {"_newest": ("max", "_us")})
    tests = F.when(F.col("_us") < F.col("_newest"), F.lit("out_of_order"))
    if interval_seconds:
        tests = tests.when(F.col("_us") == F.col("_newest"), F.lit("duplicate")).when(
            F.col("_us") - F.col("_newest") != interval_seconds * MICROS, F.lit("gap")
        )
    return seen.withColumn("reason", tests).filter(F.col("reason").isNotNull()).withColumn(
        "behind_seconds", (F.col("_newest") - F.col("_us")) / float(MICROS)
    ).drop("_us", "_newest", "_l1", "_l2")
