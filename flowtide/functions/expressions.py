"""Scalar expressions; every one is a built-in Spark expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.config import LOW, MEDIUM, HIGH, MICROS, PRIORITY_RANK, RECOMMENDATIONS


def col(name: str) -> Column:
    """Column by literal name; names with spaces, dots or slashes are quoted."""
    return F.col("`" + name.replace("`", "``") + "`")


def epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a naive timestamp, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", epoch(), ts.cast("timestamp_ntz"))


def from_micros(value: Column) -> Column:
    return F.timestamp_add("MICROSECOND", value, epoch())


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS))


def slot(ts: Column, seconds: int) -> Column:
    """Number of the fixed interval a timestamp falls in (half-open intervals)."""
    return F.floor(micros(ts) / F.lit(seconds * MICROS)).cast("bigint")


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed interval; the group key of large tables (cheaper per row than ``slot``)."""
    return F.window(ts, f"{seconds} seconds")["start"]


def slot_start(number: Column, seconds: int | Column) -> Column:
    return from_micros(number * (seconds * F.lit(MICROS) if isinstance(seconds, Column) else F.lit(seconds * MICROS)))


def interval_start(ts: Column, seconds: int) -> Column:
    return slot_start(slot(ts, seconds), seconds)


def interval_end(ts: Column, seconds: int) -> Column:
    return slot_start(slot(ts, seconds) + 1, seconds)


def day_text(ts: Column) -> Column:
    return ts.cast("timestamp_ntz").cast("date").cast("string")


def is_finite(value: Column) -> Column:
    """True for finite numbers, false for null, NaN and infinities."""
    return F.coalesce(value.cast("double") * F.lit(0.0) == F.lit(0.0), F.lit(False))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Numerator over denominator, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def per_second(value: Column, seconds: int | Column) -> Column:
    return value.cast("double") / (seconds.cast("double") if isinstance(seconds, Column) else F.lit(float(seconds)))


def relative_label(seconds_before: Column) -> Column:
    return F.when(seconds_before == 0, F.lit("t")).otherwise(
        F.concat(F.lit("t-"), seconds_before.cast("string"), F.lit("s"))
    )


def score_class(score: Column, threshold: Column) -> Column:
    """``warning`` from the threshold on (inclusive), else ``no_warning``."""
    return F.when(score >= threshold, F.lit("warning")).otherwise(F.lit("no_warning"))


def step_threshold(thresholds: float | Sequence[float], step: Column, horizon: int) -> Column:
    """Threshold of a one-based step: one value for all steps or one value per step."""
    values = [float(thresholds)] * horizon if isinstance(thresholds, (int, float)) else [float(v) for v in thresholds]
    if len(values) != horizon:
        raise ValueError(f"need {horizon} thresholds, got {len(values)}")
    return F.element_at(F.array(*[F.lit(v) for v in values]), step.cast("int"))


def forecast_time(reference: Column, step: Column, interval_seconds: int = 10) -> Column:
    return F.timestamp_add("SECOND", step * F.lit(interval_seconds), reference.cast("timestamp_ntz"))


# --- packets -------------------------------------------------------------


def flag_tokens(value: Column, compact: bool = False) -> Column:
    """Sorted distinct flag names of a textual TCP flag field.

    Compact text such as ``SA`` stays one unknown token unless ``compact`` is set.
    """
    names = {"S": "SYN", "A": "ACK", "R": "RST"}
    if compact:
        names = {**names, "F": "FIN", "P": "PSH", "U": "URG"}
    words = F.filter(F.split(F.trim(F.translate(F.upper(value), "|,/", "   ")), r"\s+"), lambda t: t != "")
    if compact:
        words = F.flatten(
            F.transform(
                words,
                lambda t: F.when(t.rlike("^[SARFPU]+$"), F.filter(F.split(t, ""), lambda x: x != "")).otherwise(F.array(t)),
            )
        )
    lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    named = F.transform(words, lambda t: F.coalesce(F.try_element_at(lookup, t), t))
    return F.coalesce(F.array_sort(F.array_distinct(named)), F.array().cast("array<string>"))


def key_text(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def observed_key() -> Column:
    """Observed-direction five-tuple as text."""
    return key_text(
        F.col("source_ip"), F.col("destination_ip"), F.col("source_port"), F.col("destination_port"),
        F.upper("protocol"),
    )


def source_is_forward() -> Column:
    """True when the sender is the smaller (ip text, port) endpoint."""
    same = F.col("source_ip") == F.col("destination_ip")
    return (F.col("source_ip") < F.col("destination_ip")) | (same & (F.col("source_port") <= F.col("destination_port")))


def canonical_key() -> Column:
    """Direction-independent five-tuple as text."""
    source = F.concat_ws("|", "source_ip", F.col("source_port").cast("string"))
    destination = F.concat_ws("|", "destination_ip", F.col("destination_port").cast("string"))
    protocol = F.upper("protocol")
    return F.when(source_is_forward(), F.concat_ws("|", source, destination, protocol)).otherwise(
        F.concat_ws("|", destination, source, protocol)
    )


# --- priorities ----------------------------------------------------------


def percent_text(value: Column) -> Column:
    """Whole percent, halves to the even neighbour."""
    return F.concat(F.bround(value * 100).cast("bigint").cast("string"), F.lit("%"))


def fixed2(value: Column) -> Column:
    """Two decimals without digit grouping, halves to the even neighbour."""
    return F.bround(value.cast("decimal(38,10)"), 2).cast("string")


def priority_label(points: Column) -> Column:
    return F.when(points >= 5, F.lit(HIGH)).when(points >= 3, F.lit(MEDIUM)).otherwise(F.lit(LOW))


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def priority_rank(priority: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(PRIORITY_RANK), priority), F.lit(3))


def recommendation(priority: Column) -> Column:
    """Recommendation text of a priority, null for an unknown priority."""
    return F.try_element_at(_literal_map(RECOMMENDATIONS), F.upper(priority))


def lookup(values: dict, key: Column, default: str | None = None) -> Column:
    found = F.try_element_at(_literal_map(values), key)
    return found if default is None else F.coalesce(found, F.lit(default))
