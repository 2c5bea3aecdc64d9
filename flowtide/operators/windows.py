"""Context windows with future targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.config import INTERVAL, MICROS, STATE_FEATURES
from flowtide.functions.expressions import col, day_text, is_finite, micros, slot
from flowtide.functions.ordered import position
from flowtide.operators.cleaning import all_of


def _assemble(
    rows: DataFrame, keys: Sequence[str], index: str, length: int, ahead: int, outputs: dict[str, Column],
    future: dict[str, str], features: Sequence[str],
) -> DataFrame:
    """One row per complete window over consecutive values of ``index``.

    Rows are cut into index blocks; each block also receives the rows its windows need
    from the neighbours, so one long group becomes many tasks.  ``future`` maps an output
    name to a column whose next ``ahead`` values are collected.
    """
    size = max(1024, 4 * (length + ahead))
    place = lambda value: F.floor(value / size).cast("bigint")
    at = col(index)
    blocks = F.array_distinct(F.array(place(at - ahead), place(at), place(at + (length - 1))))
    spread = rows.withColumn("_block", F.explode(blocks))
    w = W.partitionBy(*[col(k) for k in keys], "_block").orderBy(at)
    frame = w.rowsBetween(-(length - 1), 0)
    cells = F.array(*[col(f).cast("double") for f in features])
    made = {"_first": F.min(at).over(frame), "_count": F.count(F.lit(1)).over(frame), "features": F.collect_list(cells).over(frame)}
    if ahead:
        made["_last"] = F.lead(at, ahead).over(w)
        for name, source in future.items():
            made[name] = F.array(*[F.lead(col(source), k).over(w) for k in range(1, ahead + 1)])
    complete = (F.col("_count") == length) & (F.col("_first") == at - (length - 1)) & (F.col("_block") == place(at))
    if ahead:
        complete = complete & (F.col("_last") == at + ahead)
    kept = spread.withColumns(made).filter(complete)
    return kept.select(*[col(k) for k in keys], *[c.alias(n) for n, c in outputs.items()], "features",
                       *(list(future) if ahead else []))


def _positive(**values: int) -> None:
    for name, value in values.items():
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} must be a positive integer")


def temporal_windows(
    rows: DataFrame, features: Sequence[str], target: str, length: int, stride: int = 1, horizon: int = 1,
    ts: str = "timestamp", tie: str = "source_row_number", split: str = "split",
) -> DataFrame:
    """Row-based windows inside each split; the target lies ``horizon`` rows later.

    Rows may share a time, the whole number ``tie`` orders them.  Row positions come from
    counts per day, second, time and block of ties, so neither a split nor a crowded second
    is ever ordered in one task.
    """
    _positive(length=length, stride=stride, horizon=horizon)
    kept = [c for c in dict.fromkeys([split, ts, tie, target, *features])]
    timed = rows.select(*[col(c) for c in kept]).withColumn("_us", micros(col(ts))).withColumns(
        {
            "_day": F.floor(F.col("_us") / (86_400 * MICROS)).cast("bigint"),
            "_second": F.floor(F.col("_us") / MICROS).cast("bigint"),
            "_ties": F.floor(col(tie) / 100_000).cast("bigint"),
        }
    )
    placed = position(timed, [split], ["_day", "_second", "_us", "_ties"], [F.col("_us"), col(tie)], "row_position")
    made = _assemble(
        placed, [split], "row_position", length, horizon,
        {"origin": col(ts), "origin_position": F.col("row_position")},
        {"_targets": target, "_target_times": ts}, features,
    )
    start = F.col("origin_position") - (length - 1)
    return made.filter(start % stride == 0).select(
        col(split), "origin", "origin_position", "features", F.element_at("_targets", horizon).alias("target"),
        F.element_at("_target_times", horizon).alias("target_time"),
        (F.col("origin_position") + horizon).alias("target_position"),
    )


def _with_slots(states: DataFrame, group: Sequence[str], interval_seconds: int, stride: int) -> DataFrame:
    rows = states.withColumn("_slot", slot(F.col("timestamp"), interval_seconds))
    if stride == 1:
        return rows.withColumn("_first_slot", F.lit(0).cast("bigint"))
    first = rows.groupBy(*[col(g) for g in group]).agg(F.min("_slot").alias("_first_slot"))
    return rows.join(first, list(group))


def _group_keys(states: DataFrame, group_column: str) -> list[str]:
    return (["split"] if "split" in states.columns else []) + [group_column]


def build_sequences(
    states: DataFrame, target: str = "future_attack_state", length: int = 10, horizon: int = 1, stride: int = 1,
    features: Sequence[str] = STATE_FEATURES, group_column: str = "capture_day", interval_seconds: int = INTERVAL,
) -> DataFrame:
    """Windows with one target inside (split, group) at fixed cadence.

    ``future_attack_state`` is read on the last input row; any other target is read
    ``horizon`` rows later.  The stride counts positions before unavailable targets drop out.
    """
    _positive(length=length, horizon=horizon, stride=stride)
    aligned = target == "future_attack_state"
    if aligned and horizon != 1:
        raise ValueError("future_attack_state is one step ahead already; horizon must be 1")
    group = _group_keys(states, group_column)
    rows = _with_slots(states, group, interval_seconds, stride)
    usable = F.col("future_target_available") if "future_target_available" in states.columns else F.lit(True)
    rows = rows.withColumn("_usable", usable)
    outputs = {"origin": F.col("timestamp"), "_slot": F.col("_slot"), "_first_slot": F.col("_first_slot")}
    if aligned:
        outputs |= {"target": col(target), "target_time": F.col("timestamp"), "_usable": F.col("_usable")}
        made = _assemble(rows, group, "_slot", length, 0, outputs, {}, features)
    else:
        made = _assemble(rows, group, "_slot", length, horizon, outputs,
                         {"_targets": target, "_times": "timestamp", "_usables": "_usable"}, features)
        made = made.withColumns(
            {
                "target": F.element_at("_targets", horizon), "target_time": F.element_at("_times", horizon),
                "_usable": F.element_at("_usables", horizon),
            }
        ).drop("_targets", "_times", "_usables")
    start = F.col("_slot") - (length - 1) - F.col("_first_slot")
    kept = made.filter((start % stride == 0) & F.col("_usable")) if stride > 1 else made.filter(F.col("_usable"))
    return kept.select(*group, "origin", "features", "target", "target_time")


def build_multistep(
    states: DataFrame, length: int = 10, horizon: int = 5, stride: int = 1, target: str = "binary_attack_state",
    features: Sequence[str] = STATE_FEATURES, group_column: str = "capture_day", interval_seconds: int = INTERVAL,
) -> DataFrame:
    """Windows with the next ``horizon`` current-state labels as targets."""
    _positive(length=length, horizon=horizon, stride=stride)
    if target == "future_attack_state":
        raise ValueError("future_attack_state is shifted already; use binary_attack_state")
    group = _group_keys(states, group_column)
    rows = _with_slots(states, group, interval_seconds, stride)
    made = _assemble(
        rows, group, "_slot", length, horizon,
        {"origin": F.col("timestamp"), "_slot": F.col("_slot"), "_first_slot": F.col("_first_slot")},
        {"targets": target, "target_times": "timestamp"}, features,
    ).filter(F.forall("targets", lambda y: y.isin(0, 1)))
    if stride > 1:
        made = made.filter((F.col("_slot") - (length - 1) - F.col("_first_slot")) % stride == 0)
    return made.select(*group, "origin", "features", "targets", "target_times")


def window_report(windows: DataFrame, group: Sequence[str] = ("split", "capture_day")) -> DataFrame:
    """Window count, strictly future and same-time targets per group."""
    last = F.col("target_times")[F.size("target_times") - 1] if "target_times" in windows.columns else F.col("target_time")
    first = F.col("target_times")[0] if "target_times" in windows.columns else F.col("target_time")
    return windows.groupBy(*[col(g) for g in group]).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(first > F.col("origin")).alias("strict_future_targets"),
        F.count_if(first == F.col("origin")).alias("same_time_targets"),
        F.min("origin").alias("first_origin"),
        F.max(last).alias("last_target_time"),
    )


def k1_alignment(windows: DataFrame, states: DataFrame) -> DataFrame:
    """Compare the direct +1 target with the stored next-state label per split."""
    stored = states.select("capture_day", F.col("timestamp").alias("origin"), "future_attack_state")
    joined = windows.select("split", "capture_day", "origin", F.col("targets")[0].alias("direct")).join(
        stored, ["capture_day", "origin"]
    )
    difference = F.abs(F.col("direct") - F.col("future_attack_state"))
    return joined.groupBy("split").agg(
        F.count(F.lit(1)).alias("sequence_count"), F.max(difference).alias("max_absolute_difference")
    ).withColumn("aligned", F.col("max_absolute_difference") == 0)


def validate_sequence(rows: DataFrame, sequence: str = "sequence_id", length: int = 10,
                      features: Sequence[str] = STATE_FEATURES, interval_seconds: int = INTERVAL) -> DataFrame:
    """Verdict per inference sequence: length, one day, exact steps, finite values.

    ``length`` distinct times of equal remainder over a span of ``length - 1`` intervals are
    exactly one interval apart, so no sequence needs sorting.
    """
    us = micros(F.col("timestamp"))
    step = interval_seconds * MICROS
    facts = rows.groupBy(col(sequence)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("capture_day").alias("_days"),
        F.count_if(F.col("capture_day").isNull()).alias("_no_day"),
        F.count_if(F.col("timestamp").isNull()).alias("_no_time"),
        F.count_distinct(us).alias("_times"),
        F.min(us % step).alias("_low"), F.max(us % step).alias("_high"),
        (F.max(us) - F.min(us)).alias("_span"),
        F.count_if(day_text(F.col("timestamp")) != F.col("capture_day").cast("string")).alias("_off_day"),
        F.count_if(~all_of(is_finite(col(f)) for f in features)).alias("_nonfinite"),
    )
    steps = (F.col("_times") == length) & (F.col("_low") == F.col("_high")) & (F.col("_span") == (length - 1) * step)
    reason = (
        F.when(F.col("rows") != length, "wrong_length")
        .when((F.col("_days") != 1) | (F.col("_no_day") > 0), "not_one_day")
        .when(F.col("_nonfinite") > 0, "nonfinite_features")
        .when(F.col("_no_time") > 0, "invalid_timestamp")
        .when(~steps, "wrong_cadence")
        .when(F.col("_off_day") > 0, "outside_capture_day")
    )
    return facts.select(col(sequence), "rows", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"))
