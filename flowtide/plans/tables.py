"""Telemetry views over the given tables, as Spark frames and as the same SQL text for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.expressions import col
from flowtide.operators.activity import source_activity
from flowtide.operators.packets import normalize_packets
from flowtide.operators.states import network_states

RAW_COLUMNS = [
    "Dst Port", "Protocol", "Timestamp", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts",
    "TotLen Bwd Pkts", "Flow Byts/s", "Flow Pkts/s", "Label",
]
RAW_NUMBERS = [c for c in RAW_COLUMNS if c not in ("Timestamp", "Label")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- flows from lineitem -------------------------------------------------

_FLOW_FIELDS = """
  case l_orderkey % 4 when 0 then '2018-02-14' when 1 then '2018-02-21' when 2 then '2018-02-22' else '2018-02-28' end as capture_date,
  (l_orderkey*37 + l_linenumber*11 + l_partkey*101) % 21600 as off,
  case when l_discount >= 0.09 and l_returnflag = 'R' and l_suppkey % 5 = 0 then 'Infilteration' else 'Benign' end as {q}Label{q},
  case l_suppkey % 5 when 0 then 443 when 1 then 80 when 2 then 22 when 3 then 53 else 8080 end as {q}Dst Port{q},
  cast(l_partkey*1000 as double) as {q}Flow Duration{q},
  cast(floor(l_quantity) as double) as {q}Tot Fwd Pkts{q},
  cast(l_linenumber as double) as {q}Tot Bwd Pkts{q},
  cast(floor(l_extendedprice) as double) as {q}TotLen Fwd Pkts{q},
  cast(l_suppkey*10 as double) as {q}TotLen Bwd Pkts{q},
  cast(l_partkey % 997 as double) as {q}Flow IAT Mean{q},
  cast(l_partkey % 89 as double) as {q}Flow IAT Std{q},
  cast(l_linenumber % 2 as double) as {q}SYN Flag Cnt{q},
  case when l_linestatus = 'O' then 1.0D else 0.0D end as {q}ACK Flag Cnt{q},
  case when l_returnflag = 'R' then 1.0D else 0.0D end as {q}RST Flag Cnt{q},
  cast(l_quantity*10 as double) as {q}Pkt Len Mean{q},
  cast(l_linenumber as double) as {q}Pkt Len Std{q}
"""
FLOWS_SQL = (
    "flows as (select *, cast(capture_date || ' 01:00:00' as timestamp) + to_seconds(off) as timestamp_parsed from (select "
    + _FLOW_FIELDS.format(q='"').replace("1.0D", "cast(1 as double)").replace("0.0D", "cast(0 as double)")
    + " from lineitem) where off not between 5000 and 5399)"
)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished flows of four capture days, with a quiet stretch of 400 seconds in each."""
    fields = [f.strip() for f in _FLOW_FIELDS.format(q="`").strip().split(",\n")]
    rows = table(spark, sf_dir, "lineitem").selectExpr(*fields)
    return rows.filter("off not between 5000 and 5399").withColumn(
        "timestamp_parsed",
        F.expr(
            "timestampadd(SECOND, off, case capture_date when '2018-02-14' then timestamp_ntz'2018-02-14 01:00:00' "
            "when '2018-02-21' then timestamp_ntz'2018-02-21 01:00:00' when '2018-02-22' then timestamp_ntz'2018-02-22 01:00:00' "
            "else timestamp_ntz'2018-02-28 01:00:00' end)"
        ),
    )


# --- packets from events -------------------------------------------------

PACKETS_SQL = """packets as (select *, case when rev then b_ip else a_ip end as source_ip, case when rev then a_ip else b_ip end as destination_ip,
  case when rev then b_port else a_port end as source_port, case when rev then a_port else b_port end as destination_port
  from (select event_id, user_id, k, cast(ts as date) as day,
    cast(cast(ts as date) as timestamp) + to_microseconds((epoch_us(ts) - epoch_us(cast(cast(ts as date) as timestamp))) // 240) as "timestamp",
    '10.0.0.' || (user_id % 4) as a_ip, cast(40000 + user_id % 4 as integer) as a_port,
    '10.1.0.' || (k % 3) as b_ip, cast(case k % 3 when 0 then 443 when 1 then 80 else 53 end as integer) as b_port,
    event_id % 3 = 0 as rev, case when k % 3 = 2 then 'UDP' else 'TCP' end as protocol, cast(40 + k*10 as double) as packet_length,
    case event_type when 'signup' then 'SYN' when 'purchase' then 'FIN,ACK' when 'error' then 'RST' else 'ACK' end as tcp_flags
    from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)))"""


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet events of thirty short capture days; ``event_id`` breaks ties."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", col("ts").cast("timestamp_ntz").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    ).withColumn("_day", F.expr("cast(cast(ts as date) as timestamp_ntz)"))
    rows = rows.withColumn("timestamp", F.expr("timestampadd(MICROSECOND, timestampdiff(MICROSECOND, _day, ts) div 240, _day)"))
    rev = F.expr("event_id % 3 = 0")
    a_ip, a_port = F.expr("'10.0.0.' || (user_id % 4)"), F.expr("cast(40000 + user_id % 4 as int)")
    b_ip, b_port = F.expr("'10.1.0.' || (k % 3)"), F.expr("case k % 3 when 0 then 443 when 1 then 80 else 53 end")
    return rows.select(
        "event_id", "user_id", "k", "timestamp",
        F.when(rev, b_ip).otherwise(a_ip).alias("source_ip"), F.when(rev, a_ip).otherwise(b_ip).alias("destination_ip"),
        F.when(rev, b_port).otherwise(a_port).alias("source_port"), F.when(rev, a_port).otherwise(b_port).alias("destination_port"),
        F.expr("case when k % 3 = 2 then 'UDP' else 'TCP' end").alias("protocol"),
        F.expr("cast(40 + k*10 as double)").alias("packet_length"),
        F.expr("case event_type when 'signup' then 'SYN' when 'purchase' then 'FIN,ACK' when 'error' then 'RST' else 'ACK' end").alias("tcp_flags"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_packets(raw_packets(spark, sf_dir))[0]


# --- dirty text export from events ---------------------------------------

_RAW_BODY = {
    "Dst Port": "cast(k*13 as {s})",
    "Protocol": "cast(case when k % 3 = 2 then 17 else 6 end as {s})",
    "Timestamp": "case when event_id % 53 = 0 then 'not a time' else {stamp} end",
    "Flow Duration": "case when event_id % 41 = 0 then '' when event_id % 43 = 0 then 'abc' when event_id % 47 = 0 then '-5' else cast(k*1000 as {s}) end",
    "Tot Fwd Pkts": "cast(k % 17 as {s})",
    "Tot Bwd Pkts": "cast(k % 11 as {s})",
    "TotLen Fwd Pkts": "cast(k*40 as {s})",
    "TotLen Bwd Pkts": "case when event_id % 71 = 0 then '-1' else cast(k*25 as {s}) end",
    "Flow Byts/s": "case event_id % 10 when 3 then 'NaN' when 7 then 'Infinity' else cast(k*100 as {s}) end",
    "Flow Pkts/s": "case event_id % 10 when 7 then 'Infinity' else cast(k as {s}) end",
    "Label": "case when event_id % 61 = 0 then 'Bot' when event_type = 'error' then 'Infilteration' else 'Benign' end",
}
RAW_SQL = (
    "raw as (select event_id as source_row_number, 'Flows-' || strftime(ts, '%d-%m-%Y') || '.csv' as source_file, "
    + ", ".join(
        f"""case when event_id % 97 = 0 then '{c}' else {e.format(s='varchar', stamp="strftime(shown, '%d/%m/%Y %H:%M:%S')")} end as "{c}" """
        for c, e in _RAW_BODY.items()
    )
    + " from (select *, cast(json_extract_string(props, '$.k') as bigint) as k, "
    "cast(cast(ts as date) as timestamp) + to_seconds((event_id*37) % 86400 + case when event_id % 59 = 0 then 86400 else 0 end) as shown from events)), "
    "clean as (select source_row_number, source_file, "
    "strftime(strptime(regexp_extract(source_file, '\\d{2}-\\d{2}-\\d{4}'), '%d-%m-%Y'), '%Y-%m-%d') as capture_date, "
    "try_strptime(\"Timestamp\", '%d/%m/%Y %H:%M:%S') as timestamp_parsed, \"Label\", "
    + ", ".join(f'case when isfinite(try_cast("{c}" as double)) then try_cast("{c}" as double) end as "{c}"' for c in RAW_NUMBERS)
    + ' from raw where "Label" <> \'Label\')'
)


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow export rows as dirty text: repeated headers, bad numbers, bad times, unknown labels."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type", col("ts").cast("timestamp_ntz").alias("ts"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    ).withColumn(
        "shown",
        F.expr("cast(timestampadd(SECOND, (event_id*37) % 86400 + case when event_id % 59 = 0 then 86400 else 0 end, cast(cast(ts as date) as timestamp_ntz)) as string)"),
    ).withColumn("day", F.expr("cast(cast(ts as date) as string)"))
    stamp = "concat(substring(shown, 9, 2), '/', substring(shown, 6, 2), '/', substring(shown, 1, 4), ' ', substring(shown, 12, 8))"
    fields = [
        f"case when event_id % 97 = 0 then '{c}' else {e.format(s='string', stamp=stamp)} end as `{c}`" for c, e in _RAW_BODY.items()
    ]
    return rows.selectExpr(
        "event_id as source_row_number",
        "concat('Flows-', substring(day, 9, 2), '-', substring(day, 6, 2), '-', substring(day, 1, 4), '.csv') as source_file", *fields,
    )


# --- scores from labels --------------------------------------------------

SCORES_SQL = (
    "scores as (select doc_id, quality as label, cast((doc_id*7919) % 1000 as double)/1000 as score, "
    "case when doc_id % 3 = 0 then 'test' else 'validation' end as split, cast(doc_id % 5 + 1 as integer) as step from labels)"
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "quality as label", "cast((doc_id*7919) % 1000 as double)/1000D as score",
        "case when doc_id % 3 = 0 then 'test' else 'validation' end as split", "cast(doc_id % 5 + 1 as int) as step",
    )


# --- derived frames ------------------------------------------------------


def states(spark: SparkSession, sf_dir: str, mode: str = "supervised", interval: int = 10) -> DataFrame:
    return network_states(flows(spark, sf_dir), interval, mode)


def states_sql(interval: int = 10) -> str:
    """CTEs ``flows`` and ``states`` for checks."""
    us = interval * 1_000_000
    return f"""{FLOWS_SQL}, agg as (
  select capture_date as capture_day, make_timestamp((epoch_us(timestamp_parsed) // {us}) * {us}) as ts, count(*) as n,
    sum("TotLen Fwd Pkts" + "TotLen Bwd Pkts") as b, sum("Tot Fwd Pkts" + "Tot Bwd Pkts") as p, sum("TotLen Fwd Pkts") as fb, sum("Tot Fwd Pkts") as fp,
    avg("Flow Duration") as d, median("Flow Duration") as md, avg("Flow IAT Mean") as im, avg("Flow IAT Std") as isd,
    count(*) filter ("SYN Flag Cnt" > 0) as syn, count(*) filter ("ACK Flag Cnt" > 0) as ack, count(*) filter ("RST Flag Cnt" > 0) as rst,
    count(distinct "Dst Port") as ports, avg("Pkt Len Mean") as pm, avg("Pkt Len Std") as ps, count(*) filter ("Label" <> 'Benign') as mal
  from flows group by all),
idx as (select capture_day, unnest(generate_series(min(ts), max(ts), to_seconds({interval}))) as ts from agg group by capture_day),
base as (select idx.capture_day, idx.ts as "timestamp", coalesce(n,0) as flow_count, coalesce(b,0) as byte_sum, coalesce(p,0) as packet_sum,
  coalesce(d,0) as mean_duration, coalesce(md,0) as median_duration, coalesce(im,0) as mean_iat, coalesce(isd,0) as iat_std,
  coalesce(syn/n,0) as syn_flow_ratio, coalesce(ack/n,0) as ack_flow_ratio, coalesce(rst/n,0) as rst_flow_ratio,
  coalesce(fb/nullif(b,0),0) as fwd_byte_share, coalesce(fp/nullif(p,0),0) as fwd_packet_share, coalesce(ports,0) as unique_destination_port_count,
  coalesce(b,0)/{interval} as bytes_per_second, coalesce(p,0)/{interval} as packets_per_second, coalesce(pm,0) as packet_size_mean, coalesce(ps,0) as packet_size_std,
  coalesce(mal,0) as malicious_flow_count, coalesce(mal/n,0) as malicious_flow_ratio, cast(coalesce(mal,0) > 0 as integer) as binary_attack_state
  from idx left join agg using (capture_day, ts)),
states as (select *, coalesce(lead(binary_attack_state) over w, -1) as future_attack_state, lead(binary_attack_state) over w is not null as future_target_available,
  case capture_day when '2018-02-22' then 'validation' when '2018-02-28' then 'test' else 'train' end as split
  from base window w as (partition by capture_day order by "timestamp"))"""


ACTIVITY_SQL = PACKETS_SQL + """, activity as (select *, packet_count/10.0 as packet_rate, byte_count/10.0 as byte_rate from (
  select source_ip, cast(day as varchar) as capture_day, make_timestamp((epoch_us("timestamp") // 10000000) * 10000000) as interval_start,
    make_timestamp((epoch_us("timestamp") // 10000000 + 1) * 10000000) as interval_end,
    count(distinct least(source_ip || '|' || source_port, destination_ip || '|' || destination_port) || greatest(source_ip || '|' || source_port, destination_ip || '|' || destination_port) || protocol) as flow_count,
    count(*) as packet_count, sum(packet_length) as byte_count, count(distinct destination_ip) as unique_destinations, count(distinct destination_port) as unique_destination_ports,
    avg(packet_length) as mean_packet_size, case when count(*) > 1 then (epoch_us(max("timestamp")) - epoch_us(min("timestamp")))/1000000.0/(count(*)-1) else 0 end as mean_iat,
    count(*) filter (tcp_flags like '%SYN%') as syn_count, count(*) filter (tcp_flags like '%ACK%') as ack_count, count(*) filter (tcp_flags like '%RST%') as rst_count
  from packets group by all))"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_activity(packets(spark, sf_dir))
