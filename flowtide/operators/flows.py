"""Bidirectional flows from packets (K1, D15, K3, K4, K16), whatever the size of one flow key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.config import MICROS, FlowPolicy
from flowtide.functions.durable import cut
from flowtide.functions.expressions import col, day_text, from_micros, micros
from flowtide.functions.ordered import next_at_or_after, prefix, previous
from flowtide.operators.packets import with_flow_keys
from flowtide.operators.states import network_states

BLOCK_SECONDS = 10


def assign_flows(
    packets: DataFrame, policy: FlowPolicy = FlowPolicy(), keys: Sequence[str] = (), tie: str = "event_id"
) -> DataFrame:
    """Number the flows of each canonical key: adds ``flow_seq`` and ``gap_us`` (K1).

    A packet opens a flow after FIN or RST, after an idle gap, or once the open flow is
    ``active_seconds`` old.  The first two depend on the packet before it and are found in
    parallel time blocks.  The age rule depends on where the flow began; only stretches
    that last longer than the limit need it, and their cuts come from pointer doubling.
    Runs one job that checkpoints the long stretches (mostly none), then one per doubling round.
    """
    keys = list(keys) + ["flow_key"]
    idle, active = policy.idle_seconds * MICROS, policy.active_seconds * MICROS
    order = [F.col("_us"), col(tie)]
    rows = with_flow_keys(packets).withColumn("_us", micros(F.col("timestamp"))).withColumns(
        {
            "_block": F.coalesce(F.floor(F.col("_us") / (BLOCK_SECONDS * MICROS)).cast("bigint"), F.lit(-1)),
            "_day": F.coalesce(F.floor(F.col("_us") / (86_400 * MICROS)).cast("bigint"), F.lit(-1)),
            "_closing": F.array_contains("tcp_flags", "FIN") | F.array_contains("tcp_flags", "RST"),
        }
    )
    rows = previous(rows, keys, "_block", order, {"_last_us": "_us", "_last_closing": "_closing"})
    fresh = F.col("_last_us").isNull() | F.col("_last_closing") | (F.col("_us") - F.col("_last_us") >= idle)
    rows = rows.withColumn("_cut", fresh.cast("int"))
    numbered = prefix(rows, keys, ["_day", "_block"], order, {"_cuts_before": ("sum", "_cut")})
    numbered = numbered.withColumn("_stretch", F.col("_cuts_before") + F.col("_cut"))
    stretches = numbered.groupBy(*[col(k) for k in keys], "_stretch").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_end")
    )
    long = cut(stretches.filter(F.col("_end") - F.col("_first") >= active))
    longest = long.agg(F.max(F.col("_end") - F.col("_first"))).first()[0]
    if longest is not None:
        numbered = _age_cuts(numbered, long, keys, order, active, longest)
    else:
        numbered = numbered.withColumn("flow_seq", F.col("_stretch"))
    same = F.col("_new_flow") == 0 if "_new_flow" in numbered.columns else F.col("_cut") == 0
    gap = F.when(same & (F.col("_us") > F.col("_last_us")), F.col("_us") - F.col("_last_us"))
    return numbered.withColumn("gap_us", gap).drop(
        "_block", "_day", "_cut", "_cuts_before", "_stretch", "_last_us", "_last_closing", "_new_flow"
    )


def _age_cuts(numbered: DataFrame, long: DataFrame, keys: list[str], order, active: int, longest: int) -> DataFrame:
    """Renumber flows with the age limit applied inside the long stretches."""
    names = keys + ["_stretch"]
    times = numbered.join(long.select(*names), names, "left_semi").select(*names, "_us").distinct()
    targets = times.withColumn("_due", F.col("_us") + active)
    jumps = next_at_or_after(targets, times, names, "_due", "_us", "_to").select(*names, F.col("_us").alias("_from"), "_to")
    jumps = cut(jumps.filter(F.col("_to").isNotNull()))
    reached = long.select(*names, F.col("_first").alias("_at"))
    rounds = max(1, math.ceil(math.log2(longest / active + 1)))
    for step in range(rounds):
        moved = reached.join(
            jumps.withColumnRenamed("_from", "_at"), names + ["_at"]
        ).select(*names, F.col("_to").alias("_at"))
        reached = cut(reached.unionByName(moved).distinct())
        if step + 1 < rounds:
            further = jumps.select(*names, F.col("_from").alias("_to"), F.col("_to").alias("_to2"))
            jumps = cut(jumps.join(further, names + ["_to"]).select(*names, "_from", F.col("_to2").alias("_to")))
    starts = reached.select(*names, F.col("_at").alias("_us"), F.lit(1).alias("_due_cut"))
    merged = numbered.join(starts, names + ["_us"], "left")
    # Of several packets at the cut time only the first one opens the flow.
    first_at = F.coalesce(F.col("_last_us") < F.col("_us"), F.lit(True))
    aged = F.when(F.col("_due_cut").isNotNull() & first_at, 1).otherwise(0)
    merged = merged.withColumn("_new_flow", F.greatest(F.col("_cut"), aged)).drop("_due_cut")
    renumbered = prefix(merged, keys, ["_day", "_block"], order, {"_flows_before": ("sum", "_new_flow")})
    return renumbered.withColumn("flow_seq", F.col("_flows_before") + F.col("_new_flow")).drop("_flows_before")


def flow_aggregates(assigned: DataFrame, keys: Sequence[str] = (), tie: str = "event_id") -> DataFrame:
    """One record per flow from numbered packets."""
    names = list(keys) + ["flow_key", "flow_seq"]
    length = F.col("packet_length")
    whole = F.floor(length).cast("bigint")
    has = lambda flag: F.array_contains("tcp_flags", flag)
    flows = assigned.groupBy(*[col(n) for n in names]).agg(
        F.first("forward_ip").alias("source_ip"),
        F.first("reverse_ip").alias("destination_ip"),
        F.first("forward_port").alias("source_port"),
        F.first("reverse_port").alias("destination_port"),
        F.first(F.upper("protocol")).alias("protocol"),
        F.min("_us").alias("_first"),
        F.max("_us").alias("_last"),
        F.count(F.lit(1)).alias("packet_count"),
        F.count_if("is_forward").alias("Tot Fwd Pkts"),
        F.count_if(~F.col("is_forward")).alias("Tot Bwd Pkts"),
        F.coalesce(F.sum(F.when(F.col("is_forward"), whole)), F.lit(0)).alias("TotLen Fwd Pkts"),
        F.coalesce(F.sum(F.when(~F.col("is_forward"), whole)), F.lit(0)).alias("TotLen Bwd Pkts"),
        F.coalesce(F.avg("gap_us"), F.lit(0.0)).alias("Flow IAT Mean"),
        F.coalesce(F.stddev_samp("gap_us"), F.lit(0.0)).alias("Flow IAT Std"),
        F.count_if(has("SYN")).alias("SYN Flag Cnt"),
        F.count_if(has("ACK")).alias("ACK Flag Cnt"),
        F.count_if(has("RST")).alias("RST Flag Cnt"),
        F.avg(length).alias("Pkt Len Mean"),
        F.coalesce(F.stddev_samp(length), F.lit(0.0)).alias("Pkt Len Std"),
        F.max(has("RST")).alias("_rst"),
        F.max(has("FIN")).alias("_fin"),
    )
    return flows.withColumns(
        {
            "timestamp_parsed": from_micros(F.col("_first")),
            "last_packet_timestamp": from_micros(F.col("_last")),
            "Dst Port": F.col("destination_port"),
            "Flow Duration": (F.col("_last") - F.col("_first")).cast("double"),
        }
    ).withColumns({"capture_date": day_text(F.col("timestamp_parsed")), "label_available": F.lit(False)})


def close_flows(flows: DataFrame, packets: DataFrame, policy: FlowPolicy = FlowPolicy(), keys: Sequence[str] = ()) -> DataFrame:
    """Close time and reason of every flow; a timed-out flow ends at the next packet of anyone (K1, K3).

    Flows no later packet can time out are closed by the final flush at their last packet.
    """
    idle, active = policy.idle_seconds * MICROS, policy.active_seconds * MICROS
    open_end = ~(F.col("_rst") | F.col("_fin"))
    due = F.least(F.col("_last") + idle, F.col("_first") + active)
    dated = flows.withColumn("_due", F.when(open_end, due))
    clock = packets.select(*[col(k) for k in keys], micros(F.col("timestamp")).alias("_us"))
    pending = dated.filter(F.col("_due").isNotNull()).select(*[col(k) for k in keys], "_due").distinct()
    answers = next_at_or_after(pending, clock, keys, "_due", "_us", "_closed")
    joined = dated.join(answers, [*keys, "_due"], "left")
    reason = (
        F.when(F.col("_rst"), "rst").when(F.col("_fin"), "fin").when(F.col("_closed").isNull(), "flush")
        .when(F.col("_closed") - F.col("_last") >= idle, "idle_timeout").otherwise("active_timeout")
    )
    return joined.withColumns(
        {"flow_close_reason": reason, "close_timestamp": from_micros(F.coalesce("_closed", "_last"))}
    ).drop("_due", "_closed")


def build_flows(packets: DataFrame, policy: FlowPolicy = FlowPolicy(), keys: Sequence[str] = (), tie: str = "event_id") -> DataFrame:
    """Finished flow records of normalized packets (K1 + D15).

    The records are checkpointed: they are far fewer than the packets, and states, close
    times and audits read them several times.
    """
    flows = cut(flow_aggregates(assign_flows(packets, policy, keys, tie), keys, tie))
    return close_flows(flows, packets, policy, keys).drop("_first", "_last", "_rst", "_fin")


def completion_time_states(flows: DataFrame, interval_seconds: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Label-free states with every flow placed in the interval in which it closed (K3, K4).

    The state index is complete between the first and last closing interval of a day.
    """
    placed = flows.withColumns(
        {"timestamp_parsed": F.col("close_timestamp"), "capture_date": day_text(F.col("close_timestamp"))}
    )
    return network_states(placed, interval_seconds, "inference", keys)


def open_flow_count(flows: DataFrame, policy: FlowPolicy = FlowPolicy(), keys: Sequence[str] = ()) -> DataFrame:
    """Open flows after each opening or closing moment against the tracking limit."""
    change = flows.select(
        *[col(k) for k in keys],
        F.explode(
            F.array(
                F.struct(micros(F.col("timestamp_parsed")).alias("us"), F.lit(1).alias("delta")),
                F.struct(micros(F.col("close_timestamp")).alias("us"), F.lit(-1).alias("delta")),
            )
        ).alias("e"),
    )
    moments = change.groupBy(*[col(k) for k in keys], F.col("e.us").alias("_us")).agg(
        F.sum("e.delta").cast("bigint").alias("_delta"), F.count_if(F.col("e.delta") > 0).alias("opened")
    ).withColumns(
        {
            "_day": F.floor(F.col("_us") / (86_400 * MICROS)).cast("bigint"),
            "_minute": F.floor(F.col("_us") / (60 * MICROS)).cast("bigint"),
        }
    )
    counted = prefix(moments, keys, ["_day", "_minute"], [F.col("_us")], {"_before": ("sum", "_delta")})
    open_now = F.col("_before") + F.col("_delta")
    return counted.select(
        *[col(k) for k in keys], from_micros(F.col("_us")).alias("moment"), "opened", open_now.alias("open_flows"),
        (open_now > policy.max_tracked_flows).alias("over_limit"),
    )
