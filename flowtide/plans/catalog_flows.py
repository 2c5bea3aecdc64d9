"""Catalog part one: cleaning, states, windows, packets, flows, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.config import DAY_ROLES, DEMO_STATUS, FLOW_NUMERIC, STATE_FEATURES, FlowPolicy
from flowtide.functions.durable import cut
from flowtide.functions.expressions import col, day_text, slot
from flowtide.operators import activity as act
from flowtide.operators import cleaning as cl
from flowtide.operators import flows as fl
from flowtide.operators import packets as pk
from flowtide.operators import states as st
from flowtide.operators import windows as wd
from flowtide.plans import tables as t
from flowtide.plans.catalog import big, num, pick, query, rows_sql, text
from flowtide.sources.readers import clean_flows, limit_events

S = t.states_sql()
RAW = t.RAW_SQL
HEADER = t.RAW_COLUMNS
NUMBERS = t.RAW_NUMBERS


def _clean(spark, d):
    """Clean rows of the dirty export with their labels as they are."""
    return clean_flows(t.raw_flows(spark, d), binary=False)[0]


def _split_states(spark, d, durable: bool = False):
    """States with their split; ``durable`` checkpoints them for plans that read them many times."""
    rows = cl.day_split(t.states(spark, d))[0]
    return cut(rows) if durable else rows


# --- cleaning ------------------------------------------------------------


@query("b1_drop_repeated_headers", f"with {RAW} select source_file, count(*) as row_count, cast(sum(source_row_number) as bigint) as row_number_sum from raw where \"Label\" <> 'Label' group by 1")
def _(spark, d):
    rows = cl.drop_repeated_headers(t.raw_flows(spark, d), HEADER)
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"), F.sum("source_row_number").alias("row_number_sum"))


_norm = ", ".join(
    f'count("{c}") as "n_{i}", round(coalesce(sum("{c}"),0),6) as "s_{i}"' for i, c in enumerate(NUMBERS)
)


@query("b2_normalize_numeric", f"""with {RAW} select c.source_file, {_norm.replace('"Dst', 'c."Dst').replace('("', '(c."').replace('c.c.', 'c.')},
  count(*) filter (r."Flow Byts/s" = 'NaN') as raw_nan from clean c join raw r using (source_row_number) group by 1""")
def _(spark, d):
    rows = cl.normalize_numeric(cl.drop_repeated_headers(t.raw_flows(spark, d), HEADER), NUMBERS)
    measures = []
    for i, c in enumerate(NUMBERS):
        measures += [F.count(col(c)).alias(f"n_{i}"), num(F.coalesce(F.sum(col(c)), F.lit(0.0))).alias(f"s_{i}")]
    return rows.groupBy("source_file").agg(*measures, F.count_if(col("Flow Byts/s__raw") == "NaN").alias("raw_nan"))


_tokens = " union all ".join(
    f"select source_file, '{c}' as \"column\", \"{c}\" as token from raw where \"Label\" <> 'Label' and not coalesce(isfinite(try_cast(\"{c}\" as double)), false)"
    for c in NUMBERS
)


@query("b3_ingestion_stats", f"with {RAW} select \"column\", token, count(*) as nonfinite_count, count(*) filter (token not in ('NaN','Infinity','')) as parse_error_count from ({_tokens}) group by 1, 2")
def _(spark, d):
    _, issues = cl.ingestion_stats(t.raw_flows(spark, d), NUMBERS)
    return pick(issues, ["column", "token"], ["nonfinite_count", "parse_error_count"])


@query("b3_row_stats", f"with {RAW} select source_file, count(*) as raw_record_count, count(*) filter (\"Label\" <> 'Label') as valid_record_count, count(*) filter (\"Label\" = 'Label') as repeated_header_count from raw group by 1")
def _(spark, d):
    rows, _ = cl.ingestion_stats(t.raw_flows(spark, d), NUMBERS, ["source_file"])
    return rows


@query("b4_parse_timestamp", f"with {RAW} select source_row_number, cast(timestamp_parsed as varchar) as timestamp_parsed from clean")
def _(spark, d):
    rows = cl.parse_timestamp(cl.drop_repeated_headers(t.raw_flows(spark, d), HEADER))
    return pick(rows, ["timestamp_parsed"], ["source_row_number"])


@query("b5_timestamp_audit", f"""with {RAW}, s as (select *, lag(timestamp_parsed) over (partition by source_file order by source_row_number) as p from clean)
  select source_file, count(*) filter (timestamp_parsed is null) as missing_or_invalid_count, count(*) filter (timestamp_parsed < p) as chronological_backsteps,
  cast(min(timestamp_parsed) as varchar) as min_timestamp, cast(max(timestamp_parsed) as varchar) as max_timestamp, count(*) filter (timestamp_parsed < p) = 0 as chronologically_ordered from s group by 1""")
def _(spark, d):
    audit = cl.timestamp_audit(_clean(spark, d), ["source_file"], "source_row_number")
    return pick(audit, ["source_file", "min_timestamp", "max_timestamp"], ["missing_or_invalid_count", "chronological_backsteps"], bools=["chronologically_ordered"])


@query("b6_validate_labels", f"with {RAW} select \"Label\" as label, count(*) as row_count, case when \"Label\" in ('Benign','Infilteration') then 'valid' else 'unknown' end as status from clean group by 1")
def _(spark, d):
    return cl.validate_labels(_clean(spark, d))


@query("b7_add_binary_label", f"with {RAW} select capture_date, original_label, binary_label, count(*) as row_count from (select capture_date, \"Label\" as original_label, cast(case \"Label\" when 'Benign' then 0 when 'Infilteration' then 1 end as bigint) as binary_label from clean where \"Label\" <> 'Bot') group by all")
def _(spark, d):
    valid, _ = cl.add_binary_label(_clean(spark, d).drop("original_label"))
    return valid.groupBy("capture_date", "original_label", big("binary_label").alias("binary_label")).agg(F.count(F.lit(1)).alias("row_count"))


@query("b8_explicit_binary_target", f"with {RAW} select capture_date, sum(cast(\"Label\" = 'Infilteration' as bigint))::bigint as positives, count(*) filter (\"Label\" <> 'Bot') as usable, count(*) filter (\"Label\" = 'Bot') as rejected from clean group by 1")
def _(spark, d):
    valid, rejected = cl.explicit_binary_target(_clean(spark, d), ["Infilteration"])
    kept = valid.select("capture_date", "target", F.lit(0).alias("bad")).unionByName(
        rejected.select("capture_date", F.lit(0).alias("target"), F.lit(1).alias("bad")))
    return kept.groupBy("capture_date").agg(
        F.sum("target").alias("positives"), F.count_if(F.col("bad") == 0).alias("usable"), F.sum("bad").alias("rejected"))


_ALLCOLS = ", ".join(f'"{c}"' for c in NUMBERS + ["Label", "timestamp_parsed"])


@query("b9_validate_flows", f"""with {RAW}, g as (select {_ALLCOLS}, count(*) as n from clean group by all)
  select cast(sum(n) as bigint) as row_count, cast(sum(n-1) as bigint) as duplicate_rows,
  (select {' + '.join(f'count(*) filter ("{c}" is null)' for c in NUMBERS + ['Label', 'timestamp_parsed'])} from clean) as null_total,
  (select {' + '.join(f'count(*) filter ("{c}" < 0)' for c in ['Flow Duration', 'Tot Fwd Pkts', 'Tot Bwd Pkts', 'TotLen Fwd Pkts', 'TotLen Bwd Pkts'])} from clean) as negative_total from g""")
def _(spark, d):
    rows = _clean(spark, d).select(*[col(c) for c in NUMBERS + ["Label", "timestamp_parsed"]])
    return pick(cl.validate_flows(rows), bigs=["row_count", "duplicate_rows", "null_total", "negative_total"])


@query("b10_capture_date_from_name", f"with {RAW} select source_file, capture_date, count(*) as row_count from clean group by 1, 2")
def _(spark, d):
    rows = cl.drop_repeated_headers(t.raw_flows(spark, d), HEADER).withColumn("capture_date", cl.capture_date_from_name(F.col("source_file")))
    return rows.groupBy("source_file", "capture_date").agg(F.count(F.lit(1)).alias("row_count"))


@query("b11_exclude_anomalies", f"""with {RAW} select capture_date, count(*) filter (ok) as kept, count(*) filter (not ok) as excluded from (
  select capture_date, coalesce(cast(cast(timestamp_parsed as date) as varchar) = capture_date, false) as ok from clean) group by 1""")
def _(spark, d):
    valid, rejected = cl.exclude_anomalies(_clean(spark, d))
    both = valid.select("capture_date", F.lit(1).alias("ok")).unionByName(rejected.select("capture_date", F.lit(0).alias("ok")))
    return both.groupBy("capture_date").agg(F.sum("ok").alias("kept"), F.count_if(F.col("ok") == 0).alias("excluded"))


_feat = [c for c in NUMBERS if c not in ("Dst Port", "Protocol", "Flow Byts/s", "Flow Pkts/s")]


@query("b12_select_model_features", f"with {RAW} " + " union all ".join(
    f"select '{c}' as feature, count(*) filter (\"{c}\" is null) as nonfinite_count, count(*) filter (\"{c}\" is null) = 0 as selected from clean" for c in _feat))
def _(spark, d):
    report = cl.feature_finiteness(_clean(spark, d))
    return report.select("feature", big(F.coalesce("nonfinite_count", F.lit(0))).alias("nonfinite_count"), "selected")


@query("b13_derive_flow_columns", f"""with {t.FLOWS_SQL} select capture_date, cast(sum("TotLen Fwd Pkts" + "TotLen Bwd Pkts") as double) as byte_sum, cast(sum("Tot Fwd Pkts" + "Tot Bwd Pkts") as double) as packet_sum,
  count(*) filter ("SYN Flag Cnt" > 0) as syn, count(*) filter ("ACK Flag Cnt" > 0) as ack, count(*) filter ("RST Flag Cnt" > 0) as rst, count(*) filter ("Label" <> 'Benign') as malicious from flows group by 1""")
def _(spark, d):
    rows = cl.derive_flow_columns(t.flows(spark, d))
    return rows.groupBy("capture_date").agg(
        F.sum("_bytes").alias("byte_sum"), F.sum("_packets").alias("packet_sum"), F.sum("_syn").alias("syn"), F.sum("_ack").alias("ack"),
        F.sum("_rst").alias("rst"), F.sum("_malicious").alias("malicious"))


@query("b17_validate_states", f"with {S} select capture_day, count(*) as valid_states, 0::bigint as rejected_states from states group by 1")
def _(spark, d):
    valid, rejected = st.validate_states(t.states(spark, d, "inference"))
    both = valid.select("capture_day", F.lit(1).alias("ok")).unionByName(rejected.select("capture_day", F.lit(0).alias("ok")))
    return both.groupBy("capture_day").agg(F.sum("ok").alias("valid_states"), F.count_if(F.col("ok") == 0).alias("rejected_states"))


@query("b18_validate_sequence", f"""with {S}, q as (select *, flow_count > 0 as busy, capture_day || '/' || (epoch_us("timestamp") // 100000000) as sequence_id from states where flow_count > 0)
  select sequence_id, count(*) as "rows", count(*) = 10 as valid, case when count(*) = 10 then 'ok' else 'wrong_length' end as reason from q group by 1""")
def _(spark, d):
    rows = t.states(spark, d, "inference").filter(F.col("flow_count") > 0)
    named = rows.withColumn("sequence_id", F.concat(F.col("capture_day"), F.lit("/"), text(slot(F.col("timestamp"), 100))))
    return wd.validate_sequence(named)


@query("b25_split_integrity", f"""with {S} select 'duplicate_day_timestamp' as rule, (select count(*) - count(distinct (capture_day, "timestamp")) from states)::bigint as violations
  union all select 'day_in_several_splits', (select count(*) from (select capture_day from states group by 1 having count(distinct split) > 1))
  union all select 'nonfinite_feature_rows', (select count(*) from states where not isfinite(mean_duration + mean_iat + byte_sum))
  union all select 'empty_split', (select 3 - count(distinct split) from states) union all select 'unassigned_rows', (select count(*) from states where split is null)""")
def _(spark, d):
    return pick(cl.split_integrity(_split_states(spark, d, durable=True)), ["rule"], ["violations"])


@query("c1_join_features_sidecar", f"""with {RAW}, f as (select source_file, source_row_number, "Flow Duration" from clean where source_row_number % 7 <> 0), s as (select source_file, source_row_number, "Label" from clean where source_row_number % 5 <> 0)
  select coalesce(f.source_file, s.source_file) as source_file, count(*) filter (f.source_row_number is not null and s.source_row_number is not null) as joined,
  count(*) filter (s.source_row_number is null) as features_only, count(*) filter (f.source_row_number is null) as sidecar_only from f full join s using (source_file, source_row_number) group by 1""")
def _(spark, d):
    rows = _clean(spark, d)
    features = rows.filter("source_row_number % 7 <> 0").select("source_file", "source_row_number", "Flow Duration")
    sidecar = rows.filter("source_row_number % 5 <> 0").select("source_file", "source_row_number", "Label")
    joined, alone = cl.join_features_sidecar(features, sidecar)
    both = joined.select("source_file", F.lit("joined").alias("reason")).unionByName(alone.select("source_file", "reason"))
    return both.groupBy("source_file").agg(*[F.count_if(F.col("reason") == n).alias(n) for n in ("joined", "features_only", "sidecar_only")])


@query("c2_densify_states", f"""with {S} select capture_day, count(*) as intervals, count(*) filter (flow_count = 0) as added, cast(min("timestamp") as varchar) as first_interval, cast(max("timestamp") as varchar) as last_interval from states group by 1""")
def _(spark, d):
    from flowtide.functions.expressions import slot_start

    seen = t.flows(spark, d).groupBy("capture_date", slot(F.col("timestamp_parsed"), 10).alias("_slot")).agg(F.count(F.lit(1)).alias("n"))
    full = st.densify(seen, ["capture_date"], 10).withColumn("ts", slot_start(F.col("_slot"), 10))
    return full.groupBy(F.col("capture_date").alias("capture_day")).agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if(F.col("n").isNull()).alias("added"), text(F.min("ts")).alias("first_interval"), text(F.max("ts")).alias("last_interval"))


@query("c5_assign_day_role", f"with {RAW} select capture_date, case when capture_date < '2024-01-16' then 'train' when capture_date < '2024-01-24' then 'validation' else 'unassigned_day' end as split, count(*) as row_count from clean group by 1, 2")
def _(spark, d):
    roles = {f"2024-01-{i:02d}": "train" if i < 16 else "validation" for i in range(1, 24)}
    valid, rejected = cl.assign_day_role(_clean(spark, d), "capture_date", roles)
    both = valid.select("capture_date", "split").unionByName(rejected.select("capture_date", F.col("reason").alias("split")))
    return both.groupBy("capture_date", "split").agg(F.count(F.lit(1)).alias("row_count"))


@query("c6_label_dimension", f"""with {t.FLOWS_SQL}, days as (select capture_date, count(*) as row_count from flows group by 1 union all select cast(cast(ts as date) as varchar), count(*) from events group by 1)
  select capture_date, row_count, case capture_date when '2018-02-14' then 'FTP-BruteForce; SSH-Bruteforce' when '2018-02-21' then 'DDoS-LOIC-UDP; DDoS-HOIC' when '2018-02-22' then 'Brute Force-Web; Brute Force-XSS; SQL Injection' when '2018-02-28' then 'Infiltration' else 'UNKNOWN' end as expected_attack_content,
  case capture_date when '2018-02-22' then 'validation' when '2018-02-28' then 'test' when '2018-02-14' then 'train' when '2018-02-21' then 'train' else 'UNASSIGNED' end as assigned_role from days""")
def _(spark, d):
    known = t.flows(spark, d).groupBy("capture_date").agg(F.count(F.lit(1)).alias("row_count"))
    other = t.table(spark, d, "events").groupBy(day_text(F.col("ts")).alias("capture_date")).agg(F.count(F.lit(1)).alias("row_count"))
    return cl.label_dimension(known.unionByName(other))


_absent = "select capture_date, case when source_row_number % 3 = 0 then 'test' else 'train' end as split, case when source_row_number % 9 = 0 then 'Rare' else \"Label\" end as \"Label\" from clean"


@query("c7_labels_absent_from_train", f"with {RAW}, r as ({_absent}) select \"Label\" as label, split, count(*) as row_count from r where split <> 'train' and \"Label\" not in (select \"Label\" from r where split = 'train') group by 1, 2")
def _(spark, d):
    rows = _clean(spark, d).withColumns(
        {"split": F.expr("case when source_row_number % 3 = 0 then 'test' else 'train' end"),
         "Label": F.expr("case when source_row_number % 9 = 0 then 'Rare' else `Label` end")})
    return cl.labels_absent_from_train(rows)


@query("d7_day_profile", f"""with {RAW}, s as (select source_file, timestamp_parsed < lag(timestamp_parsed) over (partition by source_file order by source_row_number) as back from clean where timestamp_parsed is not null),
  b as (select source_file, count(*) filter (back) as chronological_backsteps from s group by 1)
  select source_file, max(capture_date) as capture_date, count(*) as valid_flow_rows, count(*) filter (timestamp_parsed is null) as invalid_or_missing_count,
  count(*) filter (cast(cast(timestamp_parsed as date) as varchar) <> capture_date) as capture_date_mismatch_count, count(*) filter ("Label" <> 'Benign') as non_benign_rows,
  any_value(chronological_backsteps) as chronological_backsteps, cast(min(timestamp_parsed) as varchar) as min_timestamp, cast(max(timestamp_parsed) as varchar) as max_timestamp, 'UNASSIGNED' as assigned_role
  from clean join b using (source_file) group by 1""")
def _(spark, d):
    profile = cl.day_profile(_clean(spark, d))
    return pick(profile, ["source_file", "capture_date", "min_timestamp", "max_timestamp", "assigned_role"],
                ["valid_flow_rows", "invalid_or_missing_count", "capture_date_mismatch_count", "non_benign_rows", "chronological_backsteps"])


@query("d8_split_report", f"""with {t.FLOWS_SQL}, f as (select *, case capture_date when '2018-02-22' then 'validation' when '2018-02-28' then 'test' else 'train' end as split from flows)
  select split, string_agg(distinct capture_date, ',' order by capture_date) as days, count(*) as row_count, 0::bigint as mismatch_count, count(*) filter ("Label" = 'Benign') as benign,
  cast(min(timestamp_parsed) as varchar) as min_timestamp, cast(max(timestamp_parsed) as varchar) as max_timestamp from f group by 1""")
def _(spark, d):
    rows, _ = cl.assign_day_role(t.flows(spark, d), "capture_date", DAY_ROLES)
    report = cl.split_report(rows)
    benign = F.filter("label_counts", lambda x: x["label"] == "Benign")[0]["n"]
    return pick(report, ["split", "min_timestamp", "max_timestamp"], ["row_count", "mismatch_count"], days=F.concat_ws(",", "days"), benign=big(benign))


@query("d9_diversity_report", f"""with {RAW}, p as (select source_file, capture_date, count(*) as n from clean group by 1, 2) select count(distinct capture_date) as day_count, min(capture_date) as first_day, max(capture_date) as last_day,
  cast(sum(n) as bigint) as total_rows, max(n) as largest_day_rows, min(n) as smallest_day_rows, cast(datediff('day', cast(min(capture_date) as date), cast(max(capture_date) as date)) + 1 as bigint) as span_days from p""")
def _(spark, d):
    report = cl.diversity_report(cl.day_profile(_clean(spark, d)))
    return pick(report, ["first_day", "last_day"], ["day_count", "total_rows", "largest_day_rows", "smallest_day_rows", "span_days"])


@query("g2_missing_features", f"""with {RAW}, p as (select source_file, name from (unpivot (select source_file, {", ".join(f'count("{c}") filter (source_row_number % 97 < 30) as "{c}"' for c in NUMBERS)} from clean where source_row_number % 10 = 7 group by 1) on {", ".join(f'"{c}"' for c in NUMBERS)}) where value > 0)
  select source_file, array_to_string(list_filter([{", ".join(f"'{c}'" for c in NUMBERS)}], lambda x: not list_contains(names, x)), ',') as missing from (select source_file, list(name) as names from p group by 1)""")
def _(spark, d):
    """Number columns of which the rows with infinite rates of each file hold no value at all."""
    rows = _clean(spark, d).where("source_row_number % 10 = 7")
    held = rows.groupBy("source_file").agg(*[F.count(F.when(F.expr("source_row_number % 97 < 30"), col(c))).alias(c) for c in NUMBERS])
    present = F.array_compact(F.array(*[F.when(col(c) > 0, F.lit(c)) for c in NUMBERS]))
    return held.select("source_file", F.array_join(cl.missing_features(present, NUMBERS), ",").alias("missing"))


@query("d7_day_quality", f"""with {RAW}, c as (select source_row_number, source_file, "Label" from clean), r as (select * from raw where "Label" <> 'Label'),
  n as (select source_file, name, value from (unpivot (select source_file, {", ".join(f'coalesce("{c}", chr(0)) as "{c}"' for c in NUMBERS)} from r) on {", ".join(f'"{c}"' for c in NUMBERS)})),
  q as (select source_file, count(*) filter (value = chr(0) or trim(value) = '') as empty_values, count(*) filter (try_cast(value as double) is not null and not isfinite(try_cast(value as double))) as nonfinite_values,
    count(*) filter (value <> chr(0) and trim(value) <> '' and try_cast(value as double) is null) as parse_errors from n group by 1),
  l as (select source_file, string_agg("Label" || '=' || n, ',' order by "Label") as labels from (select source_file, "Label", count(*) as n from c group by 1, 2) group by 1)
  select source_file, empty_values, nonfinite_values, parse_errors, labels from q join l using (source_file)""")
def _(spark, d):
    rows = cl.drop_repeated_headers(t.raw_flows(spark, d), HEADER)
    return pick(cl.day_quality(rows, NUMBERS), ["source_file"], ["empty_values", "nonfinite_values", "parse_errors"], labels=F.array_join(F.transform("label_counts", lambda x: F.concat(x["label"], F.lit("="), x["n"].cast("string"))), ","))


@query("d9_day_details", f"""with {RAW}, l as (select capture_date, "Label", count(*) as n, count(*) filter (cast(cast(timestamp_parsed as date) as varchar) <> capture_date) as m, min(timestamp_parsed) as lo, max(timestamp_parsed) as hi from clean group by 1, 2)
  select capture_date, cast(sum(n) as bigint) as row_count, cast(sum(m) as bigint) as mismatch_count, cast(epoch(max(hi)) - epoch(min(lo)) as bigint) as time_span_seconds, string_agg("Label" || '=' || n, ',' order by "Label") as labels from l group by 1""")
def _(spark, d):
    return pick(cl.day_details(_clean(spark, d)), ["capture_date"], ["row_count", "mismatch_count", "time_span_seconds"], labels=F.array_join(F.transform("label_counts", lambda x: F.concat(x["label"], F.lit("="), x["n"].cast("string"))), ","))


@query("d11_class_distribution", f"""with {S} select split, count(*) as states, count(*) filter (future_target_available) as usable_states, count(*) filter (future_target_available and future_attack_state = 1) as positive,
  count(*) filter (future_target_available and future_attack_state = 0) as negative, string_agg(distinct capture_day, ',' order by capture_day) as capture_days from states group by 1""")
def _(spark, d):
    return pick(cl.class_distribution(_split_states(spark, d)), ["split"], ["states", "usable_states", "positive", "negative"], capture_days=F.concat_ws(",", "capture_days"))


@query("g1_union_days", f"with {RAW} select capture_date, count(*) as row_count, cast(sum(source_row_number) as bigint) as row_number_sum from clean group by 1")
def _(spark, d):
    rows = _clean(spark, d)
    early, late = rows.filter("capture_date < '2024-01-16'"), rows.filter("capture_date >= '2024-01-16'")
    return cl.union_days([early, late]).groupBy("capture_date").agg(F.count(F.lit(1)).alias("row_count"), F.sum("source_row_number").alias("row_number_sum"))


@query("g2_unknown_values", f"with {RAW} select 'label' as kind, \"Label\" as value from clean where \"Label\" not in ('Benign','Infilteration') group by all union all select 'day', capture_date from clean where capture_date > '2024-01-10' group by all")
def _(spark, d):
    rows = _clean(spark, d)
    labels = cl.unknown_values(rows, "Label", ["Benign", "Infilteration"]).select(F.lit("label").alias("kind"), "value")
    days = cl.unknown_values(rows, "capture_date", [f"2024-01-{i:02d}" for i in range(1, 11)]).select(F.lit("day").alias("kind"), "value")
    return labels.unionByName(days)


@query("i18_chronological_split", """select split, count(*) as row_count, cast(min(ts) as varchar) as first_time, cast(max(ts) as varchar) as last_time from (select ts, case when ts >= timestamp '2024-01-02' and ts < timestamp '2024-01-20' then 'train'
  when ts >= timestamp '2024-01-20' and ts < timestamp '2024-01-25' then 'validation' when ts >= timestamp '2024-01-25' and ts < timestamp '2024-01-29' then 'test' else 'outside_ranges' end as split from events) group by 1""")
def _(spark, d):
    valid, rejected = cl.chronological_split(t.table(spark, d, "events"), "ts", "2024-01-02", "2024-01-20", "2024-01-25", "2024-01-29")
    both = valid.select("ts", "split").unionByName(rejected.select("ts", F.col("reason").alias("split")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), text(F.min("ts")).alias("first_time"), text(F.max("ts")).alias("last_time"))


@query("i19_day_split", f"with {S} select split, capture_day, count(*) as states from states group by 1, 2")
def _(spark, d):
    return _split_states(spark, d).groupBy("split", "capture_day").agg(F.count(F.lit(1)).alias("states"))


# --- states --------------------------------------------------------------

_STATE_TEXTS = ["timestamp", "capture_day"]
_TARGETS = ["malicious_flow_count", "binary_attack_state", "future_attack_state"]


@query("d1_network_states", f"with {S} select {rows_sql(_TARGETS, STATE_FEATURES + ['malicious_flow_ratio'], texts=_STATE_TEXTS)}, future_target_available from states")
def d1(spark, d):
    return pick(t.states(spark, d), _STATE_TEXTS, _TARGETS, STATE_FEATURES + ["malicious_flow_ratio"], bools=["future_target_available"])


@query("d2_inference_states", f"with {t.states_sql(60)} select {rows_sql(nums=STATE_FEATURES, texts=_STATE_TEXTS)} from states")
def _(spark, d):
    return pick(t.states(spark, d, "inference", 60), _STATE_TEXTS, nums=STATE_FEATURES)


_QUALITY = ["empty_state_percentage", "mean_flows_per_state", "median_flows_per_state", "p95_flows_per_state", "mean_flows_per_nonempty_state", "attack_frequency_all_states", "attack_frequency_nonempty_states"]
_QCOUNT = ["total_states", "nonempty_states", "empty_states", "total_flows"]
_quality = """count(*) as total_states, count(*) filter (flow_count > 0) as nonempty_states, count(*) filter (flow_count = 0) as empty_states, cast(sum(flow_count) as bigint) as total_flows,
  round(count(*) filter (flow_count = 0) * 100.0 / count(*), 6) as empty_state_percentage, round(avg(flow_count), 6) as mean_flows_per_state, round(quantile_cont(flow_count, 0.5), 6) as median_flows_per_state,
  round(quantile_cont(flow_count, 0.95), 6) as p95_flows_per_state, round(avg(flow_count) filter (flow_count > 0), 6) as mean_flows_per_nonempty_state, round(avg(binary_attack_state), 6) as attack_frequency_all_states,
  round(avg(binary_attack_state) filter (flow_count > 0), 6) as attack_frequency_nonempty_states"""


@query("d3_state_quality", f"with {S} select capture_day, {_quality} from states group by 1")
def _(spark, d):
    return pick(st.state_quality(t.states(spark, d), ["capture_day"]), ["capture_day"], _QCOUNT, _QUALITY)


@query("d4_single_window_state", f"with {S} select {rows_sql(nums=STATE_FEATURES, texts=_STATE_TEXTS)} from states where \"timestamp\" = timestamp '2018-02-21 02:00:00'")
def _(spark, d):
    return pick(st.single_window_state(t.flows(spark, d), "2018-02-21 02:00:00"), _STATE_TEXTS, nums=STATE_FEATURES)


def _granularity_sql() -> str:
    parts = [f"select {i} as interval_seconds, * from (with {t.states_sql(i)} select {_quality} from states)" for i in (1, 5, 10, 30, 60)]
    return "select cast(interval_seconds as bigint) as interval_seconds, * exclude (interval_seconds) from (" + " union all ".join(parts) + ")"


@query("d5_granularity_comparison", _granularity_sql())
def _(spark, d):
    return pick(st.granularity_comparison(t.flows(spark, d)), bigs=["interval_seconds", *_QCOUNT], nums=_QUALITY)


def _all_lengths_sql() -> str:
    parts = [f"select {i} as interval_seconds, * from (with {t.states_sql(i)} select {rows_sql(_TARGETS, STATE_FEATURES + ['malicious_flow_ratio'], texts=_STATE_TEXTS)}, future_target_available from states)" for i in (1, 5, 10, 30, 60)]
    return "select cast(interval_seconds as bigint) as interval_seconds, * exclude (interval_seconds) from (" + " union all ".join(parts) + ")"


@query("d5_granularity_states", _all_lengths_sql())
def _(spark, d):
    return pick(st.granularity_states(t.flows(spark, d)), _STATE_TEXTS, ["interval_seconds", *_TARGETS], STATE_FEATURES + ["malicious_flow_ratio"], bools=["future_target_available"])


@query("d5_quality_of_states", _granularity_sql())
def _(spark, d):
    """State quality of all lengths, from their states."""
    return pick(st.state_quality(st.granularity_states(t.flows(spark, d)), ["interval_seconds"]), bigs=["interval_seconds", *_QCOUNT], nums=_QUALITY)


@query("d10_state_distribution", f"with {S} select capture_day, cast(future_attack_state as bigint) as future_attack_state, count(*) as states from states group by 1, 2")
def _(spark, d):
    return pick(st.state_distribution(t.states(spark, d)), ["capture_day"], ["future_attack_state", "states"])


@query("e1_future_target", f"with {S} select {rows_sql(['future_attack_state'], texts=_STATE_TEXTS)}, future_target_available from states")
def _(spark, d):
    base = t.states(spark, d).drop("future_attack_state", "future_target_available")
    return pick(st.future_target(base), _STATE_TEXTS, ["future_attack_state"], bools=["future_target_available"])


@query("e5_check_cadence", f"""with {S}, q as (select *, epoch_us("timestamp" - lag("timestamp") over (partition by capture_day order by "timestamp")) / 1000000.0 as step from states where flow_count > 0)
  select capture_day, cast("timestamp" as varchar) as "timestamp", cast(step as double) as step_seconds, 'wrong_step' as reason from q where step <> 10""".replace('epoch_us("timestamp" - lag("timestamp") over (partition by capture_day order by "timestamp"))', '(epoch_us("timestamp") - epoch_us(lag("timestamp") over (partition by capture_day order by "timestamp")))'))
def _(spark, d):
    broken = st.check_cadence(t.states(spark, d, "inference").filter(F.col("flow_count") > 0))
    return pick(broken, ["capture_day", "timestamp", "reason"], nums=["step_seconds"])


_RUNS = """, q as (select *, case when (epoch_us("timestamp") - epoch_us(lag("timestamp") over w)) = 10000000 then 0 else 1 end as s from states where flow_count > 0 window w as (partition by capture_day order by "timestamp")),
  r as (select *, sum(s) over (partition by capture_day order by "timestamp") as run_id from q), h as (select *, row_number() over (partition by capture_day, run_id order by "timestamp") as run_index from r)"""


@query("e10_contiguous_runs", f"with {S}{_RUNS} select capture_day, cast(\"timestamp\" as varchar) as \"timestamp\", cast(run_id as bigint) as run_id, cast(run_index as bigint) as run_index, cast(least(run_index, 10) as bigint) as history_length, run_index >= 10 as ready from h")
def _(spark, d):
    runs = st.contiguous_runs(t.states(spark, d, "inference").filter(F.col("flow_count") > 0))
    return pick(runs, ["capture_day", "timestamp"], ["run_id", "run_index", "history_length"], bools=["ready"])


_STATUS = """, z as (select *, min("timestamp") over (partition by capture_day) as f, min(capture_day) over () as d0 from h)"""


@query("k5_history_wait", f"with {S}{_RUNS}{_STATUS} select capture_day, status, count(*) as states from (select capture_day, case when \"timestamp\" = f and capture_day <> d0 then 'day_boundary_reset' when run_id > 1 then 'waiting_for_next_valid_state' when run_index >= 10 then 'ready' else 'buffering' end as status from z) group by 1, 2")
def _(spark, d):
    rows = t.states(spark, d, "inference").filter(F.col("flow_count") > 0)
    return st.history_status(rows, on_gap="wait").groupBy("capture_day", "status").agg(F.count(F.lit(1)).alias("states"))


@query("k6_history_reset", f"with {S}{_RUNS}{_STATUS} select capture_day, status, count(*) as states from (select capture_day, case when \"timestamp\" = f and capture_day <> d0 then 'day_boundary_reset' when run_id > 1 and run_index = 1 then 'gap_reset' when run_index >= 10 then 'ready' else 'buffering' end as status from z) group by 1, 2")
def _(spark, d):
    rows = t.states(spark, d, "inference").filter(F.col("flow_count") > 0)
    return st.history_status(rows, on_gap="reset").groupBy("capture_day", "status").agg(F.count(F.lit(1)).alias("states"))


@query("f3_limit_states", f"with {S} select cast(\"timestamp\" as varchar) as \"timestamp\", capture_day, cast(flow_count as bigint) as flow_count from states order by \"timestamp\" limit 100")
def _(spark, d):
    return pick(limit_events(t.states(spark, d, "inference"), 100), ["timestamp", "capture_day"], ["flow_count"])


# --- windows -------------------------------------------------------------


@query("e2_temporal_windows", """with e as (select *, case when event_id % 10 < 6 then 'train' when event_id % 10 < 8 then 'validation' else 'test' end as split, cast(event_type = 'error' as bigint) as y from events),
  w as (select split, ts, event_id, value, y, row_number() over (partition by split order by ts, event_id) - 1 as p, sum(value) over (partition by split order by ts, event_id rows 4 preceding) as s, lead(y, 2) over (partition by split order by ts, event_id) as target, lead(ts, 2) over (partition by split order by ts, event_id) as tt from e)
  select split, cast(ts as varchar) as origin, cast(p as bigint) as origin_position, round(s, 4) as feature_sum, cast(target as bigint) as target, cast(tt as varchar) as target_time from w where p >= 4 and (p - 4) % 3 = 0 and tt is not null""")
def _(spark, d):
    rows = t.table(spark, d, "events").selectExpr("event_id", "ts", "value", "cast(event_type = 'error' as int) as y",
        "case when event_id % 10 < 6 then 'train' when event_id % 10 < 8 then 'validation' else 'test' end as split")
    made = wd.temporal_windows(rows, ["value"], "y", 5, 3, 2, "ts", "event_id")
    total = F.aggregate("features", F.lit(0.0), lambda s, r: s + r[0])
    return pick(made, ["split", "origin", "target_time"], ["origin_position", "target"], feature_sum=num(total, 4))


_W = 'window w as (partition by split, capture_day order by "timestamp")'


def _flow_total():
    """Flows of the whole context, read from the first feature of each state."""
    return F.aggregate("features", F.lit(0.0), lambda s, r: s + r[0])


@query("e3_build_sequences", f"""with {S}, q as (select split, capture_day, "timestamp", row_number() over w as n, sum(flow_count) over (partition by split, capture_day order by "timestamp" rows 9 preceding) as total, future_attack_state, future_target_available from states {_W})
  select split, capture_day, cast("timestamp" as varchar) as origin, cast("timestamp" as varchar) as target_time, cast(total as double) as flow_total, cast(future_attack_state as bigint) as target from q where n >= 10 and (n - 10) % 3 = 0 and future_target_available""")
def _(spark, d):
    made = wd.build_sequences(_split_states(spark, d), length=10, stride=3)
    return pick(made, ["split", "capture_day", "origin", "target_time"], ["target"], flow_total=_flow_total())


@query("e4_build_multistep", f"""with {S}, q as (select split, capture_day, "timestamp", row_number() over w as n, sum(flow_count) over (partition by split, capture_day order by "timestamp" rows 9 preceding) as total,
  lead(binary_attack_state, 1) over w || ',' || lead(binary_attack_state, 2) over w || ',' || lead(binary_attack_state, 3) over w || ',' || lead(binary_attack_state, 4) over w || ',' || lead(binary_attack_state, 5) over w as targets, lead("timestamp", 5) over w as tt from states {_W})
  select split, capture_day, cast("timestamp" as varchar) as origin, cast(tt as varchar) as last_target_time, cast(total as double) as flow_total, targets from q where n >= 10 and tt is not null""")
def _(spark, d):
    made = wd.build_multistep(_split_states(spark, d))
    return pick(made, ["split", "capture_day", "origin"], last_target_time=text(F.col("target_times")[4]), flow_total=_flow_total(),
                targets=F.concat_ws(",", F.transform("targets", lambda x: x.cast("string"))))


@query("d14_window_report", f"""with {S}, q as (select split, capture_day, "timestamp", row_number() over w as n, lead("timestamp", 5) over w as tt from states {_W})
  select split, capture_day, count(*) as windows, count(*) as strict_future_targets, 0::bigint as same_time_targets, cast(min("timestamp") as varchar) as first_origin, cast(max(tt) as varchar) as last_target_time from q where n >= 10 and tt is not null group by 1, 2""")
def _(spark, d):
    report = wd.window_report(wd.build_multistep(_split_states(spark, d)))
    return pick(report, ["split", "capture_day", "first_origin", "last_target_time"], ["windows", "strict_future_targets", "same_time_targets"])


@query("c8_k1_alignment", f"""with {S}, q as (select split, row_number() over w as n, future_target_available as a from states {_W}) select split, count(*) as sequence_count, 0::bigint as max_absolute_difference, true as aligned from q where n >= 10 and a group by 1""")
def _(spark, d):
    rows = _split_states(spark, d)
    return pick(wd.k1_alignment(wd.build_multistep(rows, horizon=1), rows), ["split"], ["sequence_count", "max_absolute_difference"], bools=["aligned"])


# --- packets and flows ---------------------------------------------------

P = t.PACKETS_SQL


@query("b14_normalize_packets", f"""with {P}, x as (select *, case when event_id % 31 = 0 then 70000 else source_port end as sp, case when event_id % 37 = 0 then '' else source_ip end as sip, case when event_id % 29 = 0 then -1 else packet_length end as pl from packets)
  select reason, count(*) as row_count from (select case when sip = '' then 'missing endpoints: source_ip' when sp > 65535 then 'invalid port: source_port' when pl < 0 then 'packet_length is negative' else 'ok' end as reason from x) group by 1""")
def _(spark, d):
    valid, rejected = pk.normalize_packets(_spoiled(spark, d))
    return valid.select(F.lit("ok").alias("reason")).unionByName(rejected.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"))


def _spoiled(spark, d):
    return t.raw_packets(spark, d).withColumns(
        {
            "source_port": F.expr("case when event_id % 31 = 0 then 70000 else source_port end"),
            "source_ip": F.expr("case when event_id % 37 = 0 then '' else source_ip end"),
            "packet_length": F.expr("case when event_id % 29 = 0 then -1 else packet_length end"),
        }
    )


@query("b15_flag_tokens", f"with {P}, x as (select *, case event_id % 4 when 0 then 's|a' when 1 then replace(tcp_flags, ',', '/') when 2 then lower(tcp_flags) else 'SA' end as f from packets) select f as flags, count(*) as row_count, case f when 's|a' then 'ACK SYN' when 'SA' then 'SA' else replace(replace(case when upper(f) in ('FIN/ACK', 'FIN,ACK') then 'ACK FIN' else upper(f) end, '/', ' '), ',', ' ') end as tokens from x group by all")
def _(spark, d):
    from flowtide.functions.expressions import flag_tokens

    rows = t.raw_packets(spark, d).withColumn("flags", F.expr("case event_id % 4 when 0 then 's|a' when 1 then replace(tcp_flags, ',', '/') when 2 then lower(tcp_flags) else 'SA' end"))
    return rows.groupBy("flags").agg(F.count(F.lit(1)).alias("row_count")).withColumn("tokens", F.concat_ws(" ", flag_tokens(F.col("flags"))))


_KEY = """case when source_ip < destination_ip or (source_ip = destination_ip and source_port <= destination_port) then source_ip || '|' || source_port || '|' || destination_ip || '|' || destination_port
  else destination_ip || '|' || destination_port || '|' || source_ip || '|' || source_port end || '|' || protocol"""


@query("b16_flow_key", f"with {P} select {_KEY} as flow_key, count(distinct source_ip || destination_ip || source_port || destination_port) as observed_keys, count(*) as packets from packets group by 1")
def _(spark, d):
    rows = pk.with_flow_keys(t.packets(spark, d))
    return rows.groupBy("flow_key").agg(F.count_distinct("observed_key").alias("observed_keys"), F.count(F.lit(1)).alias("packets"))


@query("b19_validate_demo_events", f"with {P} select case when event_id % 23 = 0 then 'outside capture_day' else 'ok' end as reason, count(*) as row_count from packets group by 1")
def _(spark, d):
    rows = t.raw_packets(spark, d).withColumn("capture_day", F.when(F.expr("event_id % 23 = 0"), F.lit("1999-01-01")).otherwise(day_text(F.col("timestamp"))))
    valid, rejected = pk.validate_demo_events(rows)
    return valid.select(F.lit("ok").alias("reason")).unionByName(rejected.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"))


_DEMO_BAD = "event_id % 41 = 0 or event_id % 23 = 0"


@query("b19_ordered_demo_events", f"""with {P}, e as (select *, date_trunc('second', "timestamp") as sec from packets) select event_id, cast(row_number() over (order by sec, event_id) - 1 as bigint) as event_position, cast(cast(sec as date) as varchar) as capture_date, cast(k + 1 as double) as forward_packets, cast(packet_length as double) as packet_length from e where not ({_DEMO_BAD})
  union all select -1, cast(-count(*) as bigint), case when event_id % 41 = 0 then 'not marked as demo data' else 'outside capture_date' end, null, null from packets where {_DEMO_BAD} group by 3""")
def _(spark, d):
    """Rows that are a flow and a packet at once, whole seconds with ties; rejected ones as one row a reason, counted below zero."""
    rows = t.raw_packets(spark, d).withColumn("timestamp", F.date_trunc("second", col("timestamp").cast("timestamp")).cast("timestamp_ntz"))
    rows = rows.withColumns({c: F.col("k").cast("double") for c in ["Dst Port", *FLOW_NUMERIC]}).withColumns({
        "Tot Fwd Pkts": (F.col("k") + 1).cast("double"), "Label": F.lit("Benign"),
        "demo_status": F.when(F.expr("event_id % 41 <> 0"), F.lit(DEMO_STATUS)), "capture_date": F.when(F.expr("event_id % 23 = 0"), F.lit("1999-01-01")).otherwise(day_text(col("timestamp")))})
    placed, rejected = pk.ordered_demo_events(rows, "event_id")
    good = placed.select("event_id", "event_position", "capture_date", col("Tot Fwd Pkts").alias("forward_packets"), col("packet_length").cast("double").alias("packet_length"))
    counts = rejected.groupBy("reason").agg((-F.count(F.lit(1))).alias("event_position"))
    empty = lambda kind: F.lit(None).cast(kind)
    return good.union(counts.select(F.lit(-1).cast("bigint"), "event_position", "reason", empty("double"), empty("double")))


@query("b26_classify_packet_rejects", f"""with {P} select category, count(*) as row_count from (select case when event_id % 37 = 0 then 'malformed_metadata' when event_id % 31 = 0 then 'missing_ports' when event_id % 29 = 0 then 'parser_error' end as category from packets) where category is not null group by 1""")
def _(spark, d):
    return pk.classify_packet_rejects(pk.normalize_packets(_spoiled(spark, d))[1])


@query("b26_live_rejects", f"""with {P}, a as (select *, max("timestamp") over (partition by protocol order by event_id % 1000, event_id rows between unbounded preceding and 1 preceding) as seen from packets)
  select 'out_of_order' as category, count(*) as row_count from a where "timestamp" < seen union all
  select 'invalid_flow_event', count(*) from packets where event_id % 37 = 0 or event_id % 31 = 0 or event_id % 29 = 0""")
def _(spark, d):
    """What a live flow builder refuses: events behind the newest of their protocol, and events that are no packets."""
    rows = t.packets(spark, d).withColumn("arrival", F.expr("(event_id % 1000) * 1000000000L + event_id"))
    late = pk.order_violations(rows, ["protocol"], "arrival").select(F.lit("event is not in chronological order").alias("reason"))
    refused = late.unionByName(pk.normalize_packets(_spoiled(spark, d))[1].select("reason"))
    return refused.groupBy(pk.live_category(F.col("reason")).alias("category")).agg(F.count(F.lit(1)).alias("row_count"))


@query("d12_packet_quality", f"""with {P}, q as (select count(*) as n, count(*) filter (event_id % 37 <> 0 and event_id % 31 <> 0 and event_id % 29 <> 0) as v from packets)
  select n as packets_seen, v as valid_events, n - v as ignored_events, 0::bigint as dropped_events, round(100.0*v/n, 2) as valid_percentage, round(100.0*(n-v)/n, 2) as ignored_percentage from q""")
def _(spark, d):
    quality = pk.packet_quality(*pk.normalize_packets(_spoiled(spark, d)))
    return pick(quality, bigs=["packets_seen", "valid_events", "ignored_events", "dropped_events"], nums=["valid_percentage", "ignored_percentage"])


@query("k17_order_violations", f"""with {P}, q as (select *, max("timestamp") over (partition by protocol order by (event_id * 7919) % 1000003, event_id rows between unbounded preceding and 1 preceding) as newest from packets)
  select protocol, 'out_of_order' as reason, count(*) as events from q where "timestamp" < newest group by 1""")
def _(spark, d):
    rows = t.packets(spark, d).withColumn("arrival", F.expr("((event_id * 7919) % 1000003) * 100000000 + event_id"))
    late = pk.order_violations(rows, ["protocol"], "arrival")
    return late.groupBy("protocol", "reason").agg(F.count(F.lit(1)).alias("events"))


# A flow walk as recursion: every key steps through its packets in order.
FLOW_WALK = f"""with recursive {P}, o as (select *, {_KEY} as flow_key, (source_ip < destination_ip or (source_ip = destination_ip and source_port <= destination_port)) as fwd, epoch_us("timestamp") as us,
  tcp_flags like '%FIN%' or tcp_flags like '%RST%' as closing from packets),
n as (select *, row_number() over (partition by flow_key order by us, event_id) as i from o),
walk as (select flow_key, i, us as first_us, us as last_us, closing as last_closing, 1 as flow_seq from n where i = 1
  union all select n.flow_key, n.i, case when brk then n.us else first_us end, n.us, n.closing, flow_seq + cast(brk as integer) from (
    select n.flow_key, n.i, n.us, n.closing, w.first_us, w.flow_seq, w.last_closing or n.us - w.last_us >= IDLE or n.us - w.first_us >= ACTIVE as brk from walk w join n on n.flow_key = w.flow_key and n.i = w.i + 1) n),
a as (select n.*, w.flow_seq, w.first_us from n join walk w using (flow_key, i)), g as (select *, us - lag(us) over (partition by flow_key, flow_seq order by i) as gap from a),
fl as (select flow_key, flow_seq, min(us) as f, max(us) as l, count(*) as packet_count, count(*) filter (fwd) as fp, count(*) filter (not fwd) as bp, coalesce(sum(packet_length) filter (fwd), 0) as fb, coalesce(sum(packet_length) filter (not fwd), 0) as bb,
  coalesce(avg(gap) filter (gap > 0), 0) as iat, coalesce(stddev_samp(gap) filter (gap > 0), 0) as iat_std, count(*) filter (tcp_flags like '%SYN%') as syn, count(*) filter (tcp_flags like '%ACK%') as ack, count(*) filter (tcp_flags like '%RST%') as rst,
  avg(packet_length) as lm, coalesce(stddev_samp(packet_length), 0) as ls, bool_or(tcp_flags like '%RST%') as has_rst, bool_or(tcp_flags like '%FIN%') as has_fin from g group by 1, 2)"""


def flow_walk(idle: int, active: int) -> str:
    return FLOW_WALK.replace("IDLE", str(idle * 1_000_000)).replace("ACTIVE", str(active * 1_000_000))


_FLOW_BIG = ["flow_seq", "packet_count", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "SYN Flag Cnt", "ACK Flag Cnt", "RST Flag Cnt"]
_FLOW_NUM = ["Flow Duration", "Flow IAT Mean", "Flow IAT Std", "Pkt Len Mean", "Pkt Len Std"]
_FLOW_SQL = """select flow_key, cast(make_timestamp(f) as varchar) as timestamp_parsed, cast(flow_seq as bigint) as flow_seq, packet_count, fp as "Tot Fwd Pkts", bp as "Tot Bwd Pkts", cast(fb as bigint) as "TotLen Fwd Pkts", cast(bb as bigint) as "TotLen Bwd Pkts",
  syn as "SYN Flag Cnt", ack as "ACK Flag Cnt", rst as "RST Flag Cnt", cast(l - f as double) as "Flow Duration", round(iat, 2) as "Flow IAT Mean", round(iat_std, 2) as "Flow IAT Std", round(lm, 2) as "Pkt Len Mean", round(ls, 2) as "Pkt Len Std" from fl"""


def _flow_rows(spark, d, policy):
    made = fl.flow_aggregates(fl.assign_flows(t.packets(spark, d), policy))
    return pick(made, ["flow_key", "timestamp_parsed"], _FLOW_BIG, _FLOW_NUM, 2)


@query("d15_flow_aggregates", flow_walk(30, 300) + _FLOW_SQL)
def _(spark, d):
    return _flow_rows(spark, d, FlowPolicy())


@query("k1_flow_age_limit", flow_walk(30, 40) + _FLOW_SQL)
def _(spark, d):
    """Flows under a short age limit, where the age rule cuts many stretches."""
    return _flow_rows(spark, d, FlowPolicy(active_seconds=40))


_CLOSED = flow_walk(30, 300) + """, cl as (select fl.*, (select min(us) from o where us >= least(l + 30000000, f + 300000000)) as nxt from fl),
  done as (select *, case when has_rst then 'rst' when has_fin then 'fin' when nxt is null then 'flush' when nxt - l >= 30000000 then 'idle_timeout' else 'active_timeout' end as reason, case when has_rst or has_fin or nxt is null then l else nxt end as c from cl)"""


@query("k1_flow_sessionize", _CLOSED + " select cast(cast(make_timestamp(f) as date) as varchar) as capture_date, reason as flow_close_reason, count(*) as flows, cast(sum(packet_count) as bigint) as packets, cast(sum(c - l) as bigint) as waited_us from done group by 1, 2")
def _(spark, d):
    from flowtide.functions.expressions import micros

    made = fl.build_flows(t.packets(spark, d))
    waited = micros(F.col("close_timestamp")) - micros(F.col("last_packet_timestamp"))
    return made.groupBy("capture_date", "flow_close_reason").agg(F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets"), F.sum(waited).alias("waited_us"))


@query("k3_completion_time_states", _CLOSED + """, ag as (select cast(make_timestamp(c) as date) as dy, (c // 10000000) as b, count(*) as n, sum(fb + bb) as vol, median(l - f) as md from done group by 1, 2),
  ix as (select dy, unnest(generate_series(min(b), max(b))) as b from ag group by 1) select cast(make_timestamp(ix.b * 10000000) as varchar) as "timestamp", coalesce(n, 0) as flow_count, cast(coalesce(vol, 0) as double) as byte_sum, cast(coalesce(md, 0) as double) as median_duration from ix left join ag using (dy, b)""")
def _(spark, d):
    made = fl.completion_time_states(fl.build_flows(t.packets(spark, d)))
    return pick(made, ["timestamp"], ["flow_count"], ["byte_sum", "median_duration"])


@query("k4_fill_gaps", _CLOSED + """, ag as (select distinct cast(make_timestamp(c) as date) as dy, (c // 10000000) as b from done) select cast(dy as varchar) as capture_day, cast(max(b) - min(b) + 1 as bigint) as states, cast(max(b) - min(b) + 1 - count(*) as bigint) as filled from ag group by 1""")
def _(spark, d):
    made = fl.completion_time_states(fl.build_flows(t.packets(spark, d)))
    return made.groupBy("capture_day").agg(F.count(F.lit(1)).alias("states"), F.count_if(F.col("flow_count") == 0).alias("filled"))


@query("k16_open_flow_count", _CLOSED + """, e as (select f as us, 1 as x from done union all select c, -1 from done), m as (select us, sum(x) as x, count(*) filter (x > 0) as opened from e group by 1)
  select cast(make_timestamp(us) as varchar) as moment, cast(opened as bigint) as opened, cast(sum(x) over (order by us) as bigint) as open_flows, sum(x) over (order by us) > 10000 as over_limit from m""")
def _(spark, d):
    counted = fl.open_flow_count(fl.build_flows(t.packets(spark, d)))
    return pick(counted, ["moment"], ["opened", "open_flows"], bools=["over_limit"])


# --- sources -------------------------------------------------------------

A = t.ACTIVITY_SQL
_A_TEXT = ["source_ip", "capture_day", "interval_start", "interval_end"]
_A_BIG = ["flow_count", "packet_count", "unique_destinations", "unique_destination_ports", "syn_count", "ack_count", "rst_count"]
_A_NUM = ["byte_count", "mean_packet_size", "mean_iat", "packet_rate", "byte_rate"]


@query("d6_source_activity", f"with {A} select {rows_sql(_A_BIG, _A_NUM, 9, texts=_A_TEXT)} from activity")
def _(spark, d):
    return pick(t.activity(spark, d), _A_TEXT, _A_BIG, _A_NUM, 9)


def _growth(c: str) -> str:
    return f"coalesce(({c} - lag({c}) over w) / greatest(lag({c}) over w, 1)::double, 0)"


GROWTH = f"{A}, grown as (select *, {_growth('flow_count')} as flow_growth, {_growth('packet_count')} as packet_growth, {_growth('byte_count')} as byte_growth from activity window w as (partition by source_ip order by interval_start))"


@query("e6_source_growth", f"with {GROWTH} select {rows_sql(nums=['flow_growth', 'packet_growth', 'byte_growth'], texts=['source_ip', 'interval_start'])} from grown")
def _(spark, d):
    return pick(act.source_growth(t.activity(spark, d)), ["source_ip", "interval_start"], nums=["flow_growth", "packet_growth", "byte_growth"])


# Forecasts for the as-of join: one per busy 30-second interval of all packets.
FORECASTS = """fc as (select make_timestamp((epoch_us("timestamp") // 30000000 + 1) * 30000000) as forecast_time, cast(count(*) % 10 as double) / 10 as forecast_score, count(*) % 10 >= 5 as network_warning from packets group by all)"""


def forecasts(spark, d):
    from flowtide.functions.expressions import interval_end

    rows = t.packets(spark, d).groupBy(interval_end(F.col("timestamp"), 30).alias("forecast_time")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("forecast_time", F.expr("cast(n % 10 as double) / 10D").alias("forecast_score"), F.expr("n % 10 >= 5").alias("network_warning"))


CONTEXT = f"{GROWTH}, {FORECASTS}, ctx as (select g.*, fc.forecast_score, fc.network_warning from grown g asof left join fc on g.interval_end >= fc.forecast_time)"
_POINTS = """case when flow_growth >= 0.5 then 2 when flow_growth > 0 then 1 else 0 end + case when packet_rate >= 3 or byte_rate >= 5000 then 2 when packet_rate >= 1 or byte_rate >= 1000 then 1 else 0 end
  + case when unique_destinations >= 3 then 1 else 0 end + case when unique_destination_ports >= 3 then 1 else 0 end + case when coalesce(network_warning, false) then 1 else 0 end"""
PRIORITY = f"""{CONTEXT}, pts as (select *, {_POINTS} as priority_points from ctx), prio as (select *, case when priority_points >= 5 then 'HIGH PRIORITY SOURCE' when priority_points >= 3 then 'MEDIUM PRIORITY SOURCE' else 'LOW PRIORITY SOURCE' end as priority from pts)"""


@query("c3_attach_forecast_context", f"with {CONTEXT} select source_ip, cast(interval_start as varchar) as interval_start, round(forecast_score, 6) as forecast_score, coalesce(network_warning, false) as network_warning from ctx")
def _(spark, d):
    rows = act.attach_forecast_context(t.activity(spark, d), forecasts(spark, d))
    return pick(rows, ["source_ip", "interval_start"], nums=["forecast_score"], network_warning=F.coalesce("network_warning", F.lit(False)))


def priorities(spark, d):
    return act.prioritize_sources(t.activity(spark, d), forecasts(spark, d))


_REASON = """concat_ws('; ', case when flow_growth > 0 then 'flow_count growth ' || cast(cast(round_even(flow_growth*100, 0) as bigint) as varchar) || '%' end,
  case when packet_rate >= 1 or byte_rate >= 1000 then 'packet_rate=' || printf('%.2f', packet_rate) || '/s, byte_rate=' || printf('%.2f', byte_rate) || '/s' end,
  case when unique_destinations >= 3 then 'destinations=' || unique_destinations end, case when unique_destination_ports >= 3 then 'destination_ports=' || unique_destination_ports end,
  case when coalesce(network_warning, false) then 'network forecast is elevated' end)"""


@query("h2_prioritize_sources", f"with {PRIORITY} select source_ip, cast(interval_start as varchar) as interval_start, cast(priority_points as bigint) as priority_points, priority, case when r = '' then 'no threshold crossed' else r end as measured_reasons from (select *, {_REASON} as r from prio)")
def _(spark, d):
    return pick(priorities(spark, d), ["source_ip", "interval_start", "priority", "measured_reasons"], ["priority_points"])


@query("c4_priorities_with_risk", f"with {PRIORITY} select priority, count(*) as row_count, cast(sum(packet_count) as bigint) as packets, cast(sum(byte_count) as double) as bytes from prio group by 1")
def _(spark, d):
    rows = act.priorities_with_risk(priorities(spark, d), act.source_risk(t.activity(spark, d)))
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("row_count"), F.sum("activity_features.packet_count").alias("packets"), F.sum("activity_features.byte_count").alias("bytes"))


@query("h3_recommendations", f"""with {PRIORITY} select source_ip, priority, case priority when 'LOW PRIORITY SOURCE' then 'Monitor source' when 'MEDIUM PRIORITY SOURCE' then 'Consider temporary rate limiting' else 'Consider aggressive rate limiting / investigation' end as recommendation, count(*) as row_count, false as automatic_block from prio group by 1, 2, 3""")
def _(spark, d):
    valid, _ = act.recommendations(priorities(spark, d))
    return valid.groupBy("source_ip", "priority", "recommendation").agg(F.count(F.lit(1)).alias("row_count")).withColumn("automatic_block", F.lit(False))


@query("h5_source_risk", f"with {A} select source_ip, cast(interval_start as varchar) as interval_start, packet_count, round(byte_rate, 6) as byte_rate, 'candidate source' as risk_status from activity")
def _(spark, d):
    risk = act.source_risk(t.activity(spark, d))
    return pick(risk, ["source_ip", "interval_start", "risk_status"], packet_count=F.col("activity_features.packet_count"), byte_rate=num(F.col("activity_features.byte_rate")))


@query("e7_latest_per_source", f"with {A} select source_ip, cast(max(interval_start) as varchar) as interval_start, cast(arg_max(packet_count, interval_start) as bigint) as packet_count from activity group by 1")
def _(spark, d):
    return pick(act.latest_per_source(t.activity(spark, d)), ["source_ip", "interval_start"], ["packet_count"])


@query("e8_source_first_last_seen", f"with {A} select source_ip, cast(min(interval_start) as varchar) as first_seen, cast(max(interval_end) as varchar) as last_seen, max(interval_start) = (select max(interval_start) from activity) as active from activity group by 1")
def _(spark, d):
    return pick(act.source_first_last_seen(t.activity(spark, d)), ["source_ip", "first_seen", "last_seen"], bools=["active"])


@query("f1_rank_sources", f"""with {PRIORITY}, l as (select source_ip, max(interval_start) as m from prio group by 1) select source_ip, priority, cast(priority_points as bigint) as priority_points, cast(packet_count as bigint) as packet_count
  from prio join l using (source_ip) where interval_start = m order by case priority when 'HIGH PRIORITY SOURCE' then 0 when 'MEDIUM PRIORITY SOURCE' then 1 else 2 end, priority_points desc, packet_count desc, source_ip""")
def _(spark, d):
    newest = act.rank_sources(act.latest_per_source(priorities(spark, d)))
    return pick(newest, ["source_ip", "priority"], ["priority_points", "packet_count"])


@query("h1_rate_limit_what_if", f"""with {A} select source_ip, cast(interval_start as varchar) as interval_start, round(least(byte_rate, 500), 6) as simulated_allowed_rate, round(byte_rate - least(byte_rate, 500), 6) as throttled_amount, round((byte_rate - least(byte_rate, 500)) / byte_rate * 100, 6) as percentage_reduction from activity""")
def _(spark, d):
    rows = t.activity(spark, d).withColumn("recommended_limit", F.lit(500.0))
    valid, _ = act.rate_limit_what_if(rows, "byte_rate")
    return pick(valid, ["source_ip", "interval_start"], nums=["simulated_allowed_rate", "throttled_amount", "percentage_reduction"])
