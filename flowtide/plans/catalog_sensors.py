"""Catalog part three: connection logs, sensors, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.config import STATE_FEATURES, FreshnessPolicy
from flowtide.functions.durable import scratch_path
from flowtide.functions.expressions import col, day_text
from flowtide.functions.ordered import position
from flowtide.operators import cleaning as cl
from flowtide.operators import connections as cx
from flowtide.operators import sensors as sn
from flowtide.operators import states as st
from flowtide.operators import windows as wd
from flowtide.plans import tables as t
from flowtide.plans.catalog import big, num, pick, query, rows_sql, text
from flowtide.plans.catalog_flows import A, P, RAW, S, _KEY, _clean, _split_states
from flowtide.plans.flagship import linear_scorer, replay
from flowtide.sources import readers, writers
from flowtide.streaming import late as stream_late
from flowtide.streaming import serving
from flowtide.streaming import stateful
from flowtide.streaming import windows as stream_windows

# --- connection logs -----------------------------------------------------

ZEEK = """zk as (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_type, user_id, ts, 'C' || (event_id // 2) as uid from events)"""
_ZEEK_FIELDS = {
    "ts": "case when event_id % 19 = 0 then '-' when event_id % 2 = 0 then cast(1700000000 + event_id as string) else concat(substring(cast(ts as string), 1, 10), 'T', substring(cast(ts as string), 12, 8), 'Z') end",
    "uid": "case when event_id % 13 = 0 then '-' else concat('C', event_id div 2) end",
    "id.orig_h": "concat('10.0.0.', user_id % 4)",
    "id.orig_p": "case when event_id % 17 = 0 then '70000' else cast(40000 + user_id % 4 as string) end",
    "id.resp_h": "concat('10.1.0.', k % 3)",
    "id.resp_p": "'443'",
    "proto": "'tcp'",
    "duration": "case when event_id % 7 = 0 then '-' else cast(k / 10D as string) end",
    "orig_bytes": "cast(k * 10 as string)",
    "resp_bytes": "case when event_id % 23 = 0 then '-5' else cast(k * 20 as string) end",
    "orig_pkts": "cast(k as string)",
    "resp_pkts": "cast(k + 1 as string)",
    "conn_state": "'SF'",
    "local_orig": "'-'",
    "local_resp": "'T'",
}


def connection_rows(spark, d):
    rows = t.table(spark, d, "events").select(
        "event_id", "user_id", col("ts").cast("timestamp_ntz").alias("ts"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return rows.selectExpr("event_id", *[f"{e} as `{c}`" for c, e in _ZEEK_FIELDS.items()])


def connections(spark, d):
    rows = connection_rows(spark, d).withColumn("raw_line", F.to_json(F.struct(*[col(c).alias(c.replace(".", "_")) for c in _ZEEK_FIELDS])))
    return cx.normalize_connections(rows.withColumnRenamed("event_id", "line_number"))


_BAD = "event_id % 19 = 0 or event_id % 17 = 0 or event_id % 23 = 0"


@query("b20_normalize_connections", f"""with {ZEEK} select source_ip, count(*) as records, cast(sum(k * 10) as bigint) as forward_bytes, cast(sum(case when event_id % 7 = 0 then 0 else k end) as bigint) as duration_tenths, cast(sum(epoch_us(tt) // 1000000) as bigint) as time_sum
  from (select *, '10.0.0.' || (user_id % 4) as source_ip, case when event_id % 2 = 0 then make_timestamp((1700000000 + event_id) * 1000000) else date_trunc('second', ts) end as tt from zk) where not ({_BAD}) group by 1""")
def _(spark, d):
    from flowtide.functions.expressions import micros

    valid, _ = connections(spark, d)
    return valid.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("records"), F.sum("forward_bytes").alias("forward_bytes"), big(F.round(F.sum("flow_duration") * 10)).alias("duration_tenths"),
        big(F.sum(micros(F.col("event_timestamp")) / 1_000_000)).alias("time_sum"))


@query("k8_dedupe_records", f"""with {ZEEK}, v as (select *, case when event_id % 13 = 0 then 'line' || event_id else uid end as rid from zk where not ({_BAD})) select user_source, count(distinct rid) as records, cast(count(*) - count(distinct rid) as bigint) as copies from (select *, 'all' as user_source from v) group by 1""")
def _(spark, d):
    valid, _ = connections(spark, d)
    kept = cx.dedupe_records(valid, "line_number")
    return kept.groupBy(F.lit("all").alias("user_source")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("copies") - 1).alias("copies"))


@query("k8_late_records", """with e as (select *, max(ts) over (order by (event_id * 7919) % 1000003, event_id rows between unbounded preceding and 1 preceding) as newest from events) select event_type, count(*) filter (ts < newest) as late, count(*) as records from e group by 1""")
def _(spark, d):
    rows = t.table(spark, d, "events").withColumn("arrival", F.expr("((event_id * 7919) % 1000003) * 100000000 + event_id"))
    marked = cx.late_records(rows, "arrival", [], "ts")
    return marked.groupBy("event_type").agg(F.count_if("late").alias("late"), F.count(F.lit(1)).alias("records"))


@query("b24_source_compatibility", """select s.source_type, s.status, count(*) as events, s.missing_count::bigint as missing_count, s.missing_count = 0 as compatible from events join (values (0,'LOCAL_PACKET_CAPTURE','SUPPORTED',0),(1,'REMOTE_AGENT','SUPPORTED',2),(2,'REPLAY','SUPPORTED',3),(3,'MOCK','SUPPORTED',3),(4,'ZEEK','PARTIAL',3),(5,'NETFLOW','UNSUPPORTED',3),(6,'IPFIX','UNSUPPORTED',3)) s(i, source_type, status, missing_count) on s.i = user_id % 7 group by all""")
def _(spark, d):
    names = F.array(*[F.lit(n) for n in ("LOCAL_PACKET_CAPTURE", "REMOTE_AGENT", "REPLAY", "MOCK", "ZEEK", "NETFLOW", "IPFIX")])
    seen = t.table(spark, d, "events").groupBy(F.element_at(names, (F.col("user_id") % 7 + 1).cast("int")).alias("source_type")).agg(F.count(F.lit(1)).alias("events"))
    rows = cx.source_compatibility(seen.join(cx.source_types(spark), "source_type"), ["flow_iat", "packet_size_statistics", "tcp_flags"])
    return rows.select("source_type", "status", "events", big(F.size("missing")).alias("missing_count"), "compatible")


# --- requests ------------------------------------------------------------

REQ = P + """, req as (select event_id as arrival, 'sensor-' || lpad(cast(user_id % 7 as varchar), 16, '0') as sensor_id, "timestamp" as received_at, case when event_id % 3 = 0 then 'heartbeat' else 'telemetry' end as kind, event_id // 40 + (k % 2) as sequence, 'h' || (k % 3) as batch_hash, k, tcp_flags from packets)"""


def requests(spark, d):
    return t.raw_packets(spark, d).selectExpr(
        "event_id as arrival", "concat('sensor-', lpad(cast(user_id % 7 as string), 16, '0')) as sensor_id", "timestamp as received_at",
        "case when event_id % 3 = 0 then 'heartbeat' else 'telemetry' end as kind", "event_id div 40 + (k % 2) as sequence", "concat('h', k % 3) as batch_hash", "k", "tcp_flags")


_CALM = f"""{REQ}, tel as (select *, max(sequence) over (partition by sensor_id order by received_at, arrival rows between unbounded preceding and 1 preceding) as top from req where kind = 'telemetry'),
  firsts as (select sensor_id, sequence, arg_min(batch_hash, arrival) as first_hash from tel group by 1, 2)"""


@query("k9_admit_telemetry", f"""with {_CALM} select sensor_id, decision, count(*) as requests from (select sensor_id, 'accepted' as decision from req where kind = 'heartbeat' union all
  select t.sensor_id, case when t.sequence > coalesce(top, 0) then 'accepted' when t.sequence > 0 and t.sequence = coalesce(top, 0) and batch_hash = first_hash then 'duplicate' else 'conflict' end from tel t left join firsts f on f.sensor_id = t.sensor_id and f.sequence = t.top) group by 1, 2""")
def _(spark, d):
    """Admission where no sensor reaches the rate limit."""
    rows = sn.admit_telemetry(requests(spark, d), FreshnessPolicy(requests_per_minute=1_000_000_000))
    return rows.groupBy("sensor_id", "decision").agg(F.count(F.lit(1)).alias("requests"))


@query("k9_admit_limited")
def _(spark, d):
    """Admission under a limit that every busy sensor crosses."""
    rows = sn.admit_telemetry(requests(spark, d), FreshnessPolicy(requests_per_minute=5))
    return rows.groupBy("sensor_id", "decision").agg(F.count(F.lit(1)).alias("requests"))


@query("k10_request_rate", f"""with {REQ}, q as (select sensor_id, received_at, count(*) over (partition by sensor_id order by received_at range between interval 60 second preceding and current row) as n from req) select sensor_id, cast(received_at as varchar) as received_at, cast(max(n) as bigint) as requests_last_minute, count(*) as requests_now from q group by 1, 2""")
def _(spark, d):
    from flowtide.functions.expressions import from_micros

    rows = sn.request_rate(requests(spark, d)).withColumn("received_at", from_micros(F.col("_us")))
    return pick(rows, ["sensor_id", "received_at"], ["requests_last_minute", "requests_now"])


AS_OF = "2024-01-15 00:03:00"
_LATEST = f"""{REQ}, sen as (select distinct sensor_id, case when sensor_id like '%2' then 'DISABLED' else 'REGISTERED' end as registration_state from req), hb as (select sensor_id, max(received_at) as h from req where kind = 'heartbeat' and sensor_id not like '%4' and sensor_id not like '%5' and received_at <= timestamp '{AS_OF}' group by 1),
  te as (select sensor_id, max(received_at) as t from req where kind = 'telemetry' and sensor_id not like '%5' and received_at <= timestamp '{AS_OF}' group by 1),
  stt as (select sensor_id, registration_state, h, t, case when registration_state = 'DISABLED' then 'OFFLINE' when h is null and t is null then 'REGISTERED' when h is null or h < timestamp '{AS_OF}' - interval 90 second then 'OFFLINE' when t >= timestamp '{AS_OF}' - interval 30 second then 'ONLINE' else 'DEGRADED' end as status,
  case when h is null then 'UNKNOWN' when h >= timestamp '{AS_OF}' - interval 90 second then 'ONLINE' else 'OFFLINE' end as agent_status, case when t is null then 'UNKNOWN' when t >= timestamp '{AS_OF}' - interval 30 second then 'FRESH' else 'STALE' end as telemetry_status from sen left join hb using (sensor_id) left join te using (sensor_id))"""


def _statuses(spark, d):
    rows = requests(spark, d)
    sensors = rows.select("sensor_id").distinct().withColumn("registration_state", F.when(F.col("sensor_id").like("%2"), "DISABLED").otherwise("REGISTERED"))
    heard = rows.filter("sensor_id not like '%5'")
    return sn.sensor_status(sensors, heard.filter("kind = 'heartbeat' and sensor_id not like '%4'"), heard.filter("kind = 'telemetry'"), F.lit(AS_OF).cast("timestamp_ntz"))


@query("k11_sensor_status", f"with {_LATEST} select sensor_id, status, agent_status, telemetry_status, cast(h as varchar) as last_heartbeat from stt")
def _(spark, d):
    return pick(_statuses(spark, d), ["sensor_id", "status", "agent_status", "telemetry_status", "last_heartbeat"])


@query("k12_source_status", f"""with {REQ}, r as (select sensor_id, max(received_at) as m, arg_max(k % 3, received_at) as c from req where kind = 'telemetry' and sensor_id not like '%5' and received_at <= timestamp '{AS_OF}' group by 1), s as (select distinct sensor_id from req)
  select s.sensor_id, case when m is null then 'NO_SOURCE_ATTRIBUTION' when c = 0 then 'NO_CANDIDATE_SOURCES' when m < timestamp '{AS_OF}' - interval 30 second then 'SOURCE_DATA_STALE' else 'SOURCE_ATTRIBUTION_AVAILABLE' end as source_status from s left join r using (sensor_id)""")
def _(spark, d):
    rows = requests(spark, d)
    receipts = rows.filter("kind = 'telemetry' and sensor_id not like '%5'").selectExpr("sensor_id", "received_at", "k % 3 as candidate_sources")
    return pick(sn.source_status(rows.select("sensor_id").distinct(), receipts, F.lit(AS_OF).cast("timestamp_ntz")), ["sensor_id", "source_status"])


@query("k13_latest_forecast", f"""with {S}, q as (select *, 'sensor-' || capture_day as sensor_id, case when (epoch_us("timestamp") - epoch_us(lag("timestamp") over w)) = 10000000 then 0 else 1 end as s from states where flow_count > 0 window w as (partition by capture_day order by "timestamp")),
  r as (select *, sum(s) over (partition by capture_day order by "timestamp") as run_id from q), h as (select *, row_number() over (partition by capture_day, run_id order by "timestamp") as i from r), l as (select sensor_id, max("timestamp") as m, arg_max(run_id, "timestamp") as run_id, arg_max(i, "timestamp") as i, count(*) as n from h group by 1),
  f as (select sensor_id, run_id, max("timestamp") as reference, arg_max(cast(flow_count % 10 as double) / 10, "timestamp") as score from h where i >= 10 group by 1, 2)
  select l.sensor_id, cast(m as varchar) as latest_state_timestamp, n as state_count, cast(least(i, 10) as bigint) as history_length, cast(reference as varchar) as reference_timestamp, round(score, 6) as score, case when score is null then 'BUILDING_HISTORY' else 'FORECAST_READY' end as forecast_status from l left join f using (sensor_id, run_id)""")
def _(spark, d):
    rows = t.states(spark, d, "inference").filter("flow_count > 0").withColumn("sensor_id", F.concat(F.lit("sensor-"), F.col("capture_day")))
    runs = st.contiguous_runs(rows, ["sensor_id"])
    forecasts = runs.filter("ready").select("sensor_id", F.col("timestamp").alias("reference_timestamp"), F.expr("cast(flow_count % 10 as double) / 10D").alias("score"), F.expr("flow_count % 10 >= 5").alias("warning"))
    return pick(sn.latest_forecast(runs, forecasts), ["sensor_id", "latest_state_timestamp", "reference_timestamp", "forecast_status"], ["state_count", "history_length"], ["score"])


@query("k14_pipeline_readiness", """with s as (select user_id % 50 as session_id, case event_type when 'signup' then 'start' when 'click' then 'event' when 'view' then 'flow' when 'purchase' then 'state' else 'forecast' end as stage, ts from events where not (user_id % 50 in (3, 4) and event_type = 'error') and not (user_id % 50 = 4 and event_type = 'purchase')),
  f as (select session_id, min(ts) filter (stage = 'start') as a, min(ts) filter (stage = 'event') as b, min(ts) filter (stage = 'flow') as c, min(ts) filter (stage = 'state') as e, min(ts) filter (stage = 'forecast') as g from s group by 1)
  select session_id, case when b is null then 'INITIALIZING' when c is null then 'CAPTURING' when e is null then 'BUILDING_FLOW_HISTORY' when g is null then 'BUILDING_NETWORK_HISTORY' else 'FORECAST_READY' end as readiness_state, round(greatest(0, (epoch_us(c) - epoch_us(coalesce(a, b))) / 1000000.0), 3) as seconds_to_flow from f""")
def _(spark, d):
    stages = t.table(spark, d, "events").filter("not (user_id % 50 in (3, 4) and event_type = 'error') and not (user_id % 50 = 4 and event_type = 'purchase')").selectExpr(
        "user_id % 50 as session_id", "case event_type when 'signup' then 'start' when 'click' then 'event' when 'view' then 'flow' when 'purchase' then 'state' else 'forecast' end as stage", "ts as happened_at")
    return pick(sn.pipeline_readiness(stages), ["readiness_state"], ["session_id"], ["seconds_to_flow"], 3)


_FLEET = f"""{_LATEST}, snap as (select sensor_id, count(*) filter (kind = 'telemetry') as state_count, arg_max(k >= 50, arrival) as latest_warning from req where sensor_id not like '%6' group by 1),
  fleet as (select stt.sensor_id, status, coalesce(state_count, 0) as state_count, least(coalesce(state_count, 0), 10) as history_length, coalesce(state_count >= 10, false) as forecast_ready, coalesce(latest_warning, false) as latest_warning from stt left join snap using (sensor_id))"""


def _fleet(spark, d):
    rows = requests(spark, d).filter("sensor_id not like '%6'")
    snapshots = rows.groupBy("sensor_id").agg(F.count_if(F.col("kind") == "telemetry").alias("state_count"), F.max_by(F.col("k") >= 50, "arrival").alias("latest_warning"))
    snapshots = snapshots.withColumns({"history_length": F.least("state_count", F.lit(10)), "forecast_status": F.when(F.col("state_count") >= 10, "FORECAST_READY").otherwise("BUILDING_HISTORY")})
    return sn.fleet_summary(_statuses(spark, d), snapshots)


@query("c9_fleet_summary", f"with {_FLEET} select sensor_id, status, state_count, cast(history_length as bigint) as history_length, forecast_ready, latest_warning from fleet")
def _(spark, d):
    return pick(_fleet(spark, d), ["sensor_id", "status"], ["state_count", "history_length"], bools=["forecast_ready", "latest_warning"])


@query("d13_fleet_health", f"""with {_FLEET} select count(*) as sensor_count, count(*) filter (status = 'ONLINE') as online_sensor_count, count(*) filter (status = 'DEGRADED') as degraded_sensor_count, count(*) filter (status = 'OFFLINE') as offline_sensor_count,
  count(*) filter (latest_warning and status in ('ONLINE', 'DEGRADED')) as active_warning_count, count(*) filter (not forecast_ready) as forecast_waiting_count from fleet""")
def _(spark, d):
    return sn.fleet_health(_fleet(spark, d))


# --- envelopes -----------------------------------------------------------


def _envelopes(spark, d):
    rows = t.states(spark, d, "inference").withColumn("sensor_id", F.concat(F.lit("sensor-"), F.lpad(F.translate("capture_day", "-", ""), 16, "0")))
    return sn.build_envelopes(rows, batch_size=7)


_BATCH = f"{S}, nn as (select 'sensor-' || lpad(replace(capture_day, '-', ''), 16, '0') as sensor_id, \"timestamp\", flow_count, (row_number() over (partition by capture_day order by \"timestamp\") - 1) // 7 as b from states)"


@query("a16_build_envelopes", f"with {_BATCH} select sensor_id, cast(b + 1 as bigint) as sequence, count(*) as state_count, cast(min(\"timestamp\") as varchar) as first_state, cast(sum(flow_count) as bigint) as flows from nn group by 1, b")
def _(spark, d):
    total = F.aggregate("states", F.lit(0.0), lambda s, x: s + x["features"]["flow_count"])
    return pick(_envelopes(spark, d), ["sensor_id"], ["sequence", "state_count"], first_state=text(F.col("states")[0]["timestamp"]), flows=big(total))


@query("b22_validate_state_batch", f"with {_BATCH} select sensor_id, 'ok' as reason, count(distinct b) as envelopes, count(*) as states from nn group by 1")
def _(spark, d):
    points = _envelopes(spark, d).select("sensor_id", "sequence", F.posexplode("states").alias("state_index", "s")).select("sensor_id", "sequence", "state_index", "s.*")
    return sn.validate_state_batch(points).groupBy("sensor_id", "reason").agg(F.count(F.lit(1)).alias("envelopes"), F.sum("state_count").alias("states"))


_B21 = f"""{A}, v as (select *, 'sensor-0000000000000001' as sensor_id, epoch_us(interval_start) // 60000000 as sequence, case when epoch_us(interval_start) // 10000000 % 11 = 0 then packet_count + 1 else syn_count end as syn2 from activity)"""


@query("b21_validate_source_activity", f"with {_B21} select capture_day, case when syn2 > packet_count then 'more_flags_than_packets:syn_count' else 'ok' end as reason, count(*) as row_count from v group by 1, 2")
def _(spark, d):
    from flowtide.functions.expressions import slot

    rows = t.activity(spark, d).withColumns({
        "sensor_id": F.lit("sensor-0000000000000001"), "sequence": slot(F.col("interval_start"), 60),
        "syn_count": F.when(slot(F.col("interval_start"), 10) % 11 == 0, F.col("packet_count") + 1).otherwise(F.col("syn_count"))})
    valid, rejected = sn.validate_source_activity(rows)
    both = valid.select("capture_day", F.lit("ok").alias("reason")).unionByName(rejected.select("capture_day", "reason"))
    return both.groupBy("capture_day", "reason").agg(F.count(F.lit(1)).alias("row_count"))


# --- sources and sinks: written to the shared scratch folder, read back --


def _export(spark, d) -> str:
    path = scratch_path(spark, "export")
    t.raw_flows(spark, d).withColumn("Sequence", F.col("source_row_number").cast("string")).drop("source_row_number", "source_file").repartition("Sequence").sortWithinPartitions(
        F.col("Sequence").cast("bigint")).write.option("header", True).option("emptyValue", "").csv(path)
    return path


@query("a1_read_flow_csv", f"with {RAW} select count(*) as row_count, cast(sum(source_row_number) as bigint) as sequence_sum, count(*) filter (\"Label\" = 'Label') as header_rows, 0::bigint as misnumbered from raw")
def _(spark, d):
    rows = readers.read_flow_csv(spark, _export(spark, d), [*t.RAW_COLUMNS, "Sequence"]).withColumn("s", F.col("Sequence").cast("bigint"))
    rows = rows.withColumn("block", F.floor(F.col("s") / 10_000))
    placed = position(rows, ["source_file"], ["block"], [F.col("s")], "before").withColumn("expected", F.col("before") + 1)
    return placed.agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("Sequence").cast("bigint")).alias("sequence_sum"), F.count_if(F.col("Label") == "Label").alias("header_rows"),
        F.count_if(F.col("expected") != F.col("source_row_number")).alias("misnumbered"))


@query("a2_load_flow_csv", f"with {RAW} select count(*) filter (\"Label\" <> 'Bot') as valid_rows, count(*) filter (\"Label\" = 'Bot') as rejected_rows, cast(sum(\"Tot Fwd Pkts\") filter (\"Label\" <> 'Bot') as double) as packets, count(timestamp_parsed) filter (\"Label\" <> 'Bot') as timed_rows from clean")
def _(spark, d):
    raw = readers.read_flow_csv(spark, _export(spark, d), [*t.RAW_COLUMNS, "Sequence"]).drop("Sequence")
    valid, rejected = readers.clean_flows(raw.filter(~cl.is_repeated_header(t.RAW_COLUMNS)))
    kept = valid.select(F.lit(1).alias("ok"), col("Tot Fwd Pkts").alias("p"), "timestamp_parsed").unionByName(rejected.select(F.lit(0).alias("ok"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("timestamp_ntz").alias("timestamp_parsed")))
    return kept.agg(F.sum("ok").alias("valid_rows"), F.count_if(F.col("ok") == 0).alias("rejected_rows"), F.sum("p").alias("packets"), F.count("timestamp_parsed").alias("timed_rows"))


@query("a3_read_states", f"with {S} select capture_day, count(*) as states, cast(sum(flow_count) as bigint) as flows from states group by 1")
def _(spark, d):
    path = scratch_path(spark, "states") + ".parquet"
    writers.write_states(t.states(spark, d, "inference"), path)
    kind, rows, _ = readers.read_replay(spark, path)
    return rows.groupBy("capture_day").agg(F.count(F.lit(1)).alias("states"), big(F.sum("flow_count")).alias("flows"))


@query("a4_read_packet_jsonl", f"with {P} select protocol, count(*) as packets, cast(sum(packet_length) as double) as bytes from packets group by 1")
def _(spark, d):
    path = scratch_path(spark, "packets")
    t.raw_packets(spark, d).withColumn("capture_day", day_text(F.col("timestamp"))).withColumn("timestamp", text("timestamp")).write.json(path)
    valid, _ = readers.read_packet_jsonl(spark, path)
    return valid.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes"))


@query("a5_read_zeek_json", f"with {ZEEK} select count(*) as records, cast(sum(k * 10) as bigint) as forward_bytes from zk where not ({_BAD})")
def _(spark, d):
    path = scratch_path(spark, "connections")
    connection_rows(spark, d).drop("event_id").write.json(path)
    valid, _ = cx.normalize_connections(readers.read_zeek_json(spark, path))
    return valid.agg(F.count(F.lit(1)).alias("records"), F.sum("forward_bytes").alias("forward_bytes"))


@query("a6_read_zeek_tsv", f"with {ZEEK} select count(*) as records, cast(sum(k * 10) as bigint) as forward_bytes from zk where not ({_BAD})")
def _(spark, d):
    import pandas as pd

    path, header = scratch_path(spark, "tables"), "#fields\t" + "\t".join(_ZEEK_FIELDS)

    def with_header(frames):
        yield pd.DataFrame({"value": ["#separator \\x09", header]})
        yield from frames

    lines = connection_rows(spark, d).select(F.concat_ws("\t", *[col(c) for c in _ZEEK_FIELDS]).alias("value"))
    lines.mapInPandas(with_header, "value string").write.text(path)
    rows, _ = readers.read_zeek_tsv(spark, path)
    valid, _ = cx.normalize_connections(rows)
    return valid.agg(F.count(F.lit(1)).alias("records"), F.sum("forward_bytes").alias("forward_bytes"))


@query("a8_flow_replay", f"with {RAW} select count(*) as row_count, count(*) filter (\"Label\" = 'Bot') as unknown_labels from clean")
def _(spark, d):
    path = _export(spark, d)
    raw = readers.read_flow_csv(spark, path, [*t.RAW_COLUMNS, "Sequence"]).drop("Sequence")
    valid, rejected = readers.replay_rows(raw)
    both = valid.select(F.lit("ok").alias("reason")).unionByName(rejected.select("reason"))
    return both.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("reason") == "unknown_label").alias("unknown_labels"))


@query("a7_read_replay", f"with {RAW} select 'flow' as kind, count(*) as row_count, count(*) filter (\"Label\" = 'Bot') as unknown_labels from clean")
def _(spark, d):
    path = scratch_path(spark, "export")
    t.raw_flows(spark, d).drop("source_row_number", "source_file").write.option("header", True).option("emptyValue", "").csv(path)
    kind, valid, rejected = readers.read_replay(spark, path)
    both = valid.select(F.lit("ok").alias("reason")).unionByName(rejected.select("reason"))
    return both.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("reason") == "unknown_label").alias("unknown_labels")).withColumn("kind", F.lit(kind))


@query("a9_read_telemetry_envelopes", f"with {_BATCH} select sensor_id, count(*) as states, cast(sum(flow_count) as double) as flows, cast(max(b) + 1 as bigint) as last_sequence from nn group by 1")
def _(spark, d):
    path = scratch_path(spark, "envelopes")
    writers.write_envelopes(_envelopes(spark, d), path)
    states, _, _ = readers.read_telemetry_envelopes(spark, path)
    return states.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("states"), F.sum(F.col("features")["flow_count"]).alias("flows"), F.max("sequence").alias("last_sequence"))


@query("a10_write_clean_flow", f"with {RAW} select count(*) as row_count, round(sum(\"Flow Duration\"), 3) as duration from clean")
def _(spark, d):
    path = scratch_path(spark, "features")
    writers.write_model_features(_clean(spark, d), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"), num(F.sum(col("Flow Duration")), 3).alias("duration"))


@query("a11_write_multiday", f"with {RAW} select capture_date, count(*) as row_count, cast(sum(\"Tot Fwd Pkts\") as double) as packets, round(sum(\"Flow Duration\"), 3) as duration from clean group by 1")
def _(spark, d):
    path = scratch_path(spark, "days")
    writers.write_multiday([_clean(spark, d)], path)
    rows = spark.read.option("basePath", path).schema("`Tot Fwd Pkts` double, `Flow Duration` double, capture_date string").parquet(path)
    return rows.groupBy("capture_date").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(col("Tot Fwd Pkts")).alias("packets"), num(F.sum(col("Flow Duration")), 3).alias("duration"))


@query("a11_append_days", f"with {RAW} select capture_date, count(*) as row_count, cast(sum(\"Tot Fwd Pkts\") as double) as packets, round(sum(\"Flow Duration\"), 3) as duration from clean group by 1")
def _(spark, d):
    """Half of every day's rows are loaded first; then whole days replace them, the odd ones twice."""
    path, rows = scratch_path(spark, "days"), _clean(spark, d)
    odd = F.expr("coalesce(day(try_cast(capture_date as date)) % 2 = 1, false)")
    for part in (rows.where("`Tot Fwd Pkts` % 2 = 0"), rows.where(odd), rows.where(~odd), rows.where(odd)):
        writers.append_days(part, path)
    stored = spark.read.option("basePath", path).schema("`Tot Fwd Pkts` double, `Flow Duration` double, capture_date string").parquet(path)
    return stored.groupBy("capture_date").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(col("Tot Fwd Pkts")).alias("packets"), num(F.sum(col("Flow Duration")), 3).alias("duration"))


@query("a12_write_states", f"with {S} select capture_day, 'network-state-v1' as schema_version, count(*) as states, cast(sum(flow_count) as bigint) as flows from states group by 1")
def _(spark, d):
    path = scratch_path(spark, "states")
    writers.write_states(t.states(spark, d, "inference"), path)
    rows = spark.read.parquet(path)
    version = rows.schema["timestamp"].metadata["schema_version"]
    return rows.groupBy("capture_day").agg(F.count(F.lit(1)).alias("states"), big(F.sum("flow_count")).alias("flows")).withColumn("schema_version", F.lit(version))


@query("a13_write_state_splits", f"with {S} select split, count(*) as states from states group by 1")
def _(spark, d):
    path = scratch_path(spark, "splits")
    writers.write_state_splits(_split_states(spark, d), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("states"))


@query("a14_write_windows", f"with {S}, q as (select split, row_number() over w as n, lead(\"timestamp\", 5) over w as tt from states window w as (partition by capture_day order by \"timestamp\")) select split, count(*) as windows from q where n >= 10 and tt is not null group by 1")
def _(spark, d):
    path = scratch_path(spark, "windows")
    writers.write_windows(wd.build_multistep(_split_states(spark, d)), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("windows"))


@query("a15_source_manifest")
def _(spark, d):
    return readers.source_manifest(spark, f"{d}/*.parquet").select("source_file", "size_bytes", "sha256", "assigned_role")


@query("a17_write_report", f"with {S} select capture_day, count(*) as total_states from states group by 1")
def _(spark, d):
    path = scratch_path(spark, "report")
    writers.write_report(st.state_quality(t.states(spark, d), ["capture_day"]), path)
    return spark.read.schema("capture_day string, total_states bigint").json(path)


@query("k15_replay")
def _(spark, d):
    _, advice = replay(t.packets(spark, d), linear_scorer())
    return pick(advice, ["source_ip", "interval_start", "priority", "recommendation"], ["priority_points"])


# --- streams: the table arrives as files, completed windows are read back --


def _streamed(spark, rows, time: str, transform):
    """Everything a stream over ``rows`` emits; a copy of one row an hour after the last closes all windows before it."""
    source, sink, state = (scratch_path(spark, n) for n in ("arrivals", "emitted", "offsets"))
    end = rows.agg(F.max(time).alias("_end"))
    closing = rows.limit(1).join(end).withColumn(time, F.expr("_end + interval 1 hour")).drop("_end")
    rows.unionByName(closing).withColumn(time, col(time).cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)


@query("k2_stream_states", f"""with {S} select cast("timestamp" as varchar) as timestamp, cast(flow_count as bigint) as flow_count, cast(unique_destination_port_count as bigint) as unique_destination_port_count, round(byte_sum, 3) as byte_sum, round(fwd_byte_share, 6) as fwd_byte_share from states where flow_count > 0""")
def _(spark, d):
    rows = t.flows(spark, d)
    states = _streamed(spark, rows, "timestamp_parsed", stream_windows.stream_states)
    return pick(states, ["timestamp"], ["flow_count", "unique_destination_port_count"], byte_sum=num("byte_sum", 3), fwd_byte_share=num("fwd_byte_share"))


@query("k7_stream_source_activity", f"""with {A} select source_ip, cast(interval_start as varchar) as interval_start, cast(flow_count as bigint) as flow_count, cast(packet_count as bigint) as packet_count, cast(unique_destination_ports as bigint) as unique_destination_ports, round(byte_count, 3) as byte_count from activity""")
def _(spark, d):
    rows = _streamed(spark, t.packets(spark, d), "timestamp", stream_windows.stream_source_activity)
    return pick(rows, ["source_ip", "interval_start"], ["flow_count", "packet_count", "unique_destination_ports"], byte_count=num("byte_count", 3))


_WHOLE_STATE = [c for c in STATE_FEATURES if c not in ("flow_count", "unique_destination_port_count")]


@query("k2_stream_all_features", f"""with {S} select cast("timestamp" as varchar) as timestamp, {rows_sql(['flow_count', 'unique_destination_port_count'], _WHOLE_STATE)} from states where flow_count > 0""")
def _(spark, d):
    """All features of the streamed states, medians and distinct ports included."""
    states = _streamed(spark, t.flows(spark, d), "timestamp_parsed", stream_windows.stream_states)
    return pick(states, ["timestamp"], ["flow_count", "unique_destination_port_count"], _WHOLE_STATE)


_WHOLE_ACTIVITY = ["mean_packet_size", "mean_iat", "packet_rate", "byte_rate"]
_WHOLE_COUNTS = ["flow_count", "packet_count", "unique_destinations", "unique_destination_ports", "syn_count", "ack_count", "rst_count"]


@query("k7_stream_all_measures", f"""with {A} select source_ip, cast(interval_start as varchar) as interval_start, {rows_sql(_WHOLE_COUNTS, _WHOLE_ACTIVITY, 4)} from activity""")
def _(spark, d):
    rows = _streamed(spark, t.packets(spark, d), "timestamp", stream_windows.stream_source_activity)
    return pick(rows, ["source_ip", "interval_start"], _WHOLE_COUNTS, _WHOLE_ACTIVITY, 4)


# Packets of two sensors arrive in three rounds by time; one in 40 comes a round late, behind the watermark of ten seconds.
_DELAY, _ROUNDS = 10, 3
_ARRIVAL = "cast(least({rounds} - 1, floor(({us} - {first}) * {rounds} / ({last} - {first} + 1)) + case when event_id % 40 = 0 then 1 else 0 end) as integer)"
_ARRIVED = f"""{P}, span as (select min(epoch_us("timestamp")) as lo, max(epoch_us("timestamp")) as hi from packets),
arrived as (select packets.*, 'S' || (event_id % 2) as sensor_id, epoch_us("timestamp") as us, {_ARRIVAL.format(rounds=_ROUNDS, us='epoch_us("timestamp")', first="lo", last="hi")} as arrival from packets, span),
m0 as (select max(us) // 1000 * 1000 - {_DELAY * 1_000_000} as behind from arrived where arrival = 0),
m1 as (select greatest(max(us) // 1000 * 1000 - {_DELAY * 1_000_000}, any_value(m0.behind)) as behind from arrived, m0 where arrival = 0 or (arrival = 1 and us > m0.behind)),
split as (select arrived.*, us <= case arrival when 0 then -1 when 1 then m0.behind else m1.behind end as is_late from arrived, m0, m1)"""


def _arrivals(spark, d):
    rows = t.packets(spark, d).withColumn("sensor_id", F.expr("concat('S', event_id % 2)")).drop("user_id", "k")
    us = F.expr("unix_micros(cast(`timestamp` as timestamp))")
    rows = rows.withColumn("_us", us).crossJoin(F.broadcast(t.packets(spark, d).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))))
    rows = rows.withColumn("arrival", F.expr(_ARRIVAL.format(rounds=_ROUNDS, us="_us", first="_lo", last="_hi")))
    closing = rows.limit(1).withColumns({"sensor_id": F.lit("closing"), "arrival": F.lit(_ROUNDS), "timestamp": F.expr("timestampadd(HOUR, 2, cast(timestamp_micros(_hi) as timestamp_ntz))")})
    return rows.unionByName(closing).drop("_us", "_lo", "_hi").withColumn("timestamp", col("timestamp").cast("timestamp"))


_STREAM_WALK = _ARRIVED + f""", o as (select *, sensor_id || ' ' || {_KEY} as flow_key, tcp_flags like '%FIN%' or tcp_flags like '%RST%' as closing from split where not is_late),
n as (select *, row_number() over (partition by flow_key order by us, event_id) as i from o),
walk as (select flow_key, i, us as first_us, us as last_us, closing as last_closing, 1 as flow_seq from n where i = 1
  union all select flow_key, i, case when brk then us else first_us end, us, closing, flow_seq + cast(brk as integer) from (
    select n.flow_key, n.i, n.us, n.closing, w.first_us, w.flow_seq, w.last_closing or n.us - w.last_us >= 30000000 or n.us - w.first_us >= 300000000 as brk from walk w join n on n.flow_key = w.flow_key and n.i = w.i + 1)),
fl as (select sensor_id, flow_key, flow_seq, min(us) as f, max(us) as l, count(*) as packets, sum(packet_length) as bytes, bool_or(tcp_flags like '%RST%') as rst, bool_or(tcp_flags like '%FIN%') as fin
  from n join walk using (flow_key, i) group by 1, 2, 3)
select sensor_id, flow_key, cast(f as bigint) as first_us, cast(l as bigint) as last_us, packets, cast(bytes as bigint) as bytes, case when rst then 'rst' when fin then 'fin' when l + 30000000 <= f + 300000000 then 'idle_timeout' else 'active_timeout' end as reason,
  cast(case when rst or fin then l else least(l + 30000000, f + 300000000) end as bigint) as close_us from fl"""


def _stream_flows(spark, d):
    make = lambda rows: stateful.stream_flows(rows, watermark=f"{_DELAY} seconds", keys=["sensor_id"])
    return stream_late.replay_arrivals(_arrivals(spark, d), "arrival", "timestamp", _DELAY, make, _ROUNDS + 1)


@query("k1_stream_flows", "with recursive " + _STREAM_WALK)
def _(spark, d):
    """Flows of a packet stream with late packets and restarts between arrivals; late ones are not part of any flow."""
    made, _ = _stream_flows(spark, d)
    us = lambda c: F.expr(f"unix_micros(cast(`{c}` as timestamp))")
    return made.where("sensor_id <> 'closing'").select(
        "sensor_id", F.concat_ws(" ", "sensor_id", "flow_key").alias("flow_key"), us("timestamp_parsed").alias("first_us"), us("last_packet_timestamp").alias("last_us"),
        big("packet_count").alias("packets"), big(col("TotLen Fwd Pkts") + col("TotLen Bwd Pkts")).alias("bytes"), F.col("flow_close_reason").alias("reason"), us("close_timestamp").alias("close_us"),
    )


@query("k17_late_quarantine", f"with {_ARRIVED} select event_id, sensor_id, cast(arrival as bigint) as epoch, 'behind the watermark' as reason from split where is_late")
def _(spark, d):
    """The late packets of the same arrivals: accepted and late ones together are all packets."""
    _, late = _stream_flows(spark, d)
    return late.select("event_id", "sensor_id", big("epoch").alias("epoch"), "reason")


@query("k13_serving_table", f"""with {REQ} select sensor_id, kind, cast(arg_max(arrival, (received_at, arrival)) as bigint) as arrival, cast(max(received_at) as varchar) as received_at, cast(arg_max(k, (received_at, arrival)) as bigint) as k from req group by 1, 2""")
def _(spark, d):
    """The newest request of each sensor and kind; requests arrive in four rounds against the order of time, with restarts."""
    rows = requests(spark, d).select("sensor_id", "kind", "received_at", "arrival", "k", F.expr("cast(3 - (arrival div 100) % 4 as int)").alias("round"))
    return pick(serving.serve_arrivals(rows, "round", ["sensor_id", "kind"], ["received_at", "arrival"], 4), ["sensor_id", "kind", "received_at"], ["arrival", "k"])


@query("k11_status_transitions", f"""with {REQ}, ev as (select sensor_id, epoch_us(received_at) as us, kind = 'heartbeat' as beat from req where kind <> 'heartbeat' or sensor_id not like '%4'),
  points as (select sensor_id, us, case when beat then us end as h, case when not beat then us end as t from ev union all select sensor_id, us + case when beat then 90000001 else 30000001 end, null, null from ev),
  latest as (select distinct sensor_id, us, max(h) over w as h, max(t) over w as t from points window w as (partition by sensor_id order by us range between unbounded preceding and current row)),
  found as (select sensor_id, us, case when h is null or us - h > 90000000 then 'OFFLINE' when us - t <= 30000000 then 'ONLINE' else 'DEGRADED' end as status from latest),
  changes as (select *, coalesce(lag(status) over (partition by sensor_id order by us), 'REGISTERED') as previous from found)
  select sensor_id, cast(us as bigint) as changed_us, previous, status from changes where status <> previous""")
def _(spark, d):
    """Every change of status of every sensor, from a stream: silence shows by timers."""
    rows = requests(spark, d).where("kind <> 'heartbeat' or sensor_id not like '%4'").select("sensor_id", "kind", "received_at")
    return _streamed(spark, rows, "received_at", stateful.status_transitions)
