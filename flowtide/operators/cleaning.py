"""Cleaning, labelling, audits and split assignment of flow tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.config import (
    ANOMALY, BYTE_COUNT_COLUMNS, DAY_ATTACKS, DAY_ROLES, FLOW_NUMERIC, LABELS, MODEL_EXCLUDED,
    PACKET_COUNT_COLUMNS, RATE_COLUMNS, STATE_FEATURES,
)
from flowtide.functions.expressions import col, day_text, is_finite, lookup
from flowtide.functions.ordered import previous

# Spellings that mean a non-finite number.
NONFINITE_TOKENS = ["nan", "infinity", "+infinity", "-infinity", "inf", "+inf", "-inf"]
TEXT_COLUMNS = {"Timestamp", "Label"}
ROW_BLOCK = 100_000


def all_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def split_valid(df: DataFrame, reasons: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Split a frame into (valid, rejected); the first reason whose test is true or unknown wins.

    The valid side is a plain conjunction, so single tests can move into the scan.
    """
    valid = df.filter(all_of(~test for _, test in reasons))
    reason = F.coalesce(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in reasons])
    return valid, df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


# --- B1-B3 ---------------------------------------------------------------


def is_repeated_header(columns: Sequence[str]) -> Column:
    return F.coalesce(all_of(col(c) == F.lit(c) for c in columns), F.lit(False))


def drop_repeated_headers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which every field equals its own header name (B1)."""
    return df.filter(~is_repeated_header(columns or df.columns))


def numeric_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in TEXT_COLUMNS
        and not f.name.endswith("__raw") and f.name not in MODEL_EXCLUDED - {"Dst Port", "Protocol", *RATE_COLUMNS}
    ]


def _token(c: str) -> Column:
    return F.lower(F.trim(col(c)))


def as_number(c: str) -> Column:
    """Double value of a text field; not-a-number spellings and overflow give a non-finite value."""
    word = _token(c)
    number = F.expr("try_cast(trim(`" + c.replace("`", "``") + "`) as double)")
    return (
        F.when(word == "nan", F.lit(float("nan")))
        .when(word.isin("infinity", "+infinity", "inf", "+inf"), F.lit(float("inf")))
        .when(word.isin("-infinity", "-inf"), F.lit(float("-inf")))
        .otherwise(F.when(word.rlike("[a-df-z]$"), F.lit(None)).otherwise(number))
    )


def normalize_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text to double, non-finite to null; the rate columns keep their text in ``__raw`` (B2)."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    raw = {f"{c}__raw": col(c) for c in RATE_COLUMNS if c in df.columns}
    clean = {}
    for c in columns:
        number = as_number(c)
        clean[c] = F.when(is_finite(number), number)
    return df.withColumns(raw).withColumns(clean)


def numeric_issues(df: DataFrame, columns: Sequence[str]) -> Column:
    """Array of (column, token, kind) for the fields of a row that are not plain finite numbers."""
    items = []
    for c in columns:
        number = as_number(c)
        spelled = _token(c).isin(NONFINITE_TOKENS)
        error = number.isNull() & col(c).isNotNull() & (col(c) != "") & ~spelled
        nonfinite = ~is_finite(number)
        items.append(
            F.when(nonfinite, F.struct(F.lit(c).alias("column"), F.coalesce(col(c), F.lit("<NA>")).alias("token"),
                                       error.cast("int").alias("parse_error")))
        )
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def ingestion_stats(raw: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(row counts, non-finite counts per column and token) of a raw text table."""
    header = [c for c in raw.columns if c in set(columns) | TEXT_COLUMNS]
    repeated = is_repeated_header(header)
    key_columns = [col(k) for k in keys]
    rows = raw.groupBy(*key_columns).agg(
        F.count(F.lit(1)).alias("raw_record_count"),
        F.count_if(~repeated).alias("valid_record_count"),
        F.count_if(repeated).alias("repeated_header_count"),
    )
    issues = (
        raw.filter(~repeated)
        .select(*key_columns, F.explode(numeric_issues(raw, columns)).alias("i"))
        .groupBy(*key_columns, F.col("i.column").alias("column"), F.col("i.token").alias("token"))
        .agg(F.count(F.lit(1)).alias("nonfinite_count"), F.sum("i.parse_error").alias("parse_error_count"))
    )
    return rows, issues


# --- B4-B8 ---------------------------------------------------------------


def parse_timestamp(df: DataFrame, source: str = "Timestamp", target: str = "timestamp_parsed") -> DataFrame:
    """Naive timestamp from ``dd/MM/yyyy HH:mm:ss``, invalid text to null."""
    text = F.trim(col(source))
    part = lambda n: F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2}):(\d{1,2})$", n)
    iso = F.concat(
        part(3), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit(" "),
        F.lpad(part(4), 2, "0"), F.lit(":"), F.lpad(part(5), 2, "0"), F.lit(":"), F.lpad(part(6), 2, "0"),
    )
    return df.withColumn("_iso", iso).withColumn(target, F.expr("try_cast(_iso as timestamp_ntz)")).drop("_iso")


def timestamp_audit(df: DataFrame, keys: Sequence[str], row: str, ts: str = "timestamp_parsed") -> DataFrame:
    """Invalid count, backsteps in source order, first and last time per key."""
    audited = with_backsteps(df, keys, row, ts)
    return audited.groupBy(*[col(k) for k in keys]).agg(
        F.count_if(col(ts).isNull()).alias("missing_or_invalid_count"),
        F.coalesce(F.sum("_backstep"), F.lit(0)).alias("chronological_backsteps"),
        F.min(col(ts)).alias("min_timestamp"),
        F.max(col(ts)).alias("max_timestamp"),
    ).withColumn("chronologically_ordered", F.col("chronological_backsteps") == 0)


def with_backsteps(df: DataFrame, keys: Sequence[str], row: str, ts: str) -> DataFrame:
    blocked = df.withColumn("_block", F.floor(col(row) / ROW_BLOCK).cast("bigint"))
    seen = previous(blocked, keys, "_block", [col(row)], {"_previous_ts": ts})
    return seen.withColumn("_backstep", F.coalesce((col(ts) < F.col("_previous_ts")).cast("int"), F.lit(0)))


def validate_labels(df: DataFrame, label: str = "Label", known: Mapping[str, int] = LABELS) -> DataFrame:
    """Row count of every label with a status: valid, unknown or missing."""
    return df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "status", F.when(F.col("label").isNull(), "missing").when(F.col("label").isin(list(known)), "valid").otherwise("unknown")
    )


def add_binary_label(df: DataFrame, label: str = "Label", known: Mapping[str, int] = LABELS) -> tuple[DataFrame, DataFrame]:
    """(rows with original_label and binary_label, rows with a missing or unknown label)."""
    valid, rejected = split_valid(
        df, [("missing_label", col(label).isNull()), ("unknown_label", ~col(label).isin(list(known)))]
    )
    return (
        valid.withColumns({"original_label": col(label), "binary_label": lookup(dict(known), col(label))}),
        rejected,
    )


def explicit_binary_target(
    df: DataFrame, positives: Sequence[str], label: str = "Label", benign: str = "Benign"
) -> tuple[DataFrame, DataFrame]:
    """Target 1 for the named labels, 0 for benign; unnamed labels are rejected."""
    known = list(positives) + [benign]
    valid, rejected = split_valid(
        df, [("missing_label", col(label).isNull()), ("unknown_label", ~col(label).isin(known))]
    )
    return valid.withColumn("target", col(label).isin(list(positives)).cast("int")), rejected


# --- B9 ------------------------------------------------------------------


def validate_flows(df: DataFrame, original_columns: Sequence[str] | None = None, label: str = "Label") -> DataFrame:
    """One row of table-wide counts; per-column counts come as (name, count) pairs.

    Copies are counted after a partial aggregation, so a large group of copies
    reaches the shuffle as one row per task.
    """
    original = list(original_columns) if original_columns else [c for c in df.columns if not c.endswith("__raw")]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    nulls = [F.count_if(col(c).isNull() | (F.isnan(col(c)) if c in floats else F.lit(False))).alias(f"null__{c}")
             for c in df.columns]
    infinite = [F.count_if(F.abs(col(c)) == float("inf")).alias(f"inf__{c}") for c in floats]
    negative = [
        F.count_if(F.expr(f"try_cast(`{c}` as double)") < 0).alias(f"neg__{c}")
        for c in ["Flow Duration", *PACKET_COUNT_COLUMNS, *BYTE_COUNT_COLUMNS] if c in df.columns
    ]
    wide = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.count_if(col(label).cast("string") == label) if label in df.columns else F.lit(0)).alias("duplicate_header_rows"),
        *nulls, *infinite, *negative,
    )
    copies = (
        df.groupBy(*[col(c) for c in original]).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    )
    pairs = lambda prefix: F.filter(
        F.array(*[F.struct(F.lit(c[len(prefix):]).alias("column"), col(c).alias("count"))
                  for c in wide.columns if c.startswith(prefix)]).cast("array<struct<column:string,count:bigint>>"),
        lambda x: x["count"] > 0,
    )
    total = lambda prefix: sum((col(c) for c in wide.columns if c.startswith(prefix)), F.lit(0).cast("bigint"))
    summary = wide.select(
        "row_count", "duplicate_header_rows", F.lit(len(df.columns)).alias("column_count"),
        F.lit(len(original)).alias("original_column_count"), F.lit(len(numbers)).alias("numeric_column_count"),
        pairs("null__").alias("null_counts"), total("null__").alias("null_total"),
        pairs("inf__").alias("infinity_counts"), total("inf__").alias("infinity_total"),
        pairs("neg__").alias("negative_counts"), total("neg__").alias("negative_total"),
    )
    return summary.withColumn("_one", F.lit(1)).join(copies.withColumn("_one", F.lit(1)), "_one").drop("_one")


# --- B10-B13 -------------------------------------------------------------


def capture_date_from_name(name: Column) -> Column:
    """ISO date of the first ``dd-MM-yyyy`` in a file name that is not part of a longer number."""
    pattern = r"(?<!\d)(\d{2})-(\d{2})-(\d{4})(?!\d)"
    base = F.element_at(F.split(name, "/"), -1)
    iso = F.concat_ws("-", *[F.regexp_extract(base, pattern, n) for n in (3, 2, 1)])
    return F.when(base.rlike(pattern), iso)


def flag_capture_mismatch(df: DataFrame, ts: str = "timestamp_parsed", day: str = "capture_date") -> DataFrame:
    """Flag rows whose parsed date is not their capture date; a missing time is a mismatch."""
    return df.withColumn(ANOMALY, ~day_text(col(ts)).eqNullSafe(col(day).cast("string")))


def exclude_anomalies(df: DataFrame, ts: str = "timestamp_parsed", day: str = "capture_date") -> tuple[DataFrame, DataFrame]:
    """(usable rows, excluded rows); a mismatch that carries no flag is excluded with its own reason."""
    flagged = F.coalesce(col(ANOMALY).cast("boolean"), F.lit(False)) if ANOMALY in df.columns else F.lit(False)
    return split_valid(
        df,
        [
            ("flagged_anomaly", flagged),
            ("missing_timestamp", col(ts).isNull()),
            ("missing_capture_date", col(day).isNull()),
            ("unflagged_mismatch", day_text(col(ts)) != col(day).cast("string")),
        ],
    )


def candidate_features(df: DataFrame, excluded: Iterable[str] = ()) -> list[str]:
    """Numeric columns that may become model inputs, by schema only."""
    blocked = MODEL_EXCLUDED | set(excluded)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in blocked]
    if not names:
        raise ValueError("no numeric feature column is left after exclusions")
    return names


def feature_finiteness(df: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """One row per candidate feature with its count of missing or non-finite values."""
    names = candidate_features(df, excluded)
    wide = df.agg(*[F.count_if(~is_finite(col(c))).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).alias("nonfinite_count")) for c in names])
    return wide.select(F.explode(pairs).alias("p")).select("p.feature", "p.nonfinite_count").withColumn(
        "selected", F.col("nonfinite_count") == 0
    )


def select_model_features(df: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """Projection to the model-safe feature columns."""
    return df.select(*[col(c) for c in candidate_features(df, excluded)])


def derive_flow_columns(df: DataFrame, supervised: bool = True) -> DataFrame:
    """Measures per flow the state aggregation sums up."""
    number = lambda c: col(c).cast("double")
    derived = {
        "_bytes": number("TotLen Fwd Pkts") + number("TotLen Bwd Pkts"),
        "_packets": number("Tot Fwd Pkts") + number("Tot Bwd Pkts"),
        "_fwd_bytes": number("TotLen Fwd Pkts"),
        "_fwd_packets": number("Tot Fwd Pkts"),
        "_duration": number("Flow Duration"),
        "_iat_mean": number("Flow IAT Mean"),
        "_iat_std": number("Flow IAT Std"),
        "_syn": (number("SYN Flag Cnt") > 0).cast("int"),
        "_ack": (number("ACK Flag Cnt") > 0).cast("int"),
        "_rst": (number("RST Flag Cnt") > 0).cast("int"),
        "_length_mean": number("Pkt Len Mean"),
        "_length_std": number("Pkt Len Std"),
    }
    if supervised:
        derived["_malicious"] = (~col("Label").eqNullSafe(F.lit("Benign"))).cast("int")
    return df.withColumns(derived)


def usable_flows(df: DataFrame, ts: str = "timestamp_parsed", day: str = "capture_date") -> tuple[DataFrame, DataFrame]:
    """Rows the state aggregation may use: anomalies out (B11), every source value finite.

    A finite number times zero is zero, anything else gives NaN or null, so one short
    expression tests all source columns of a row.
    """
    tests = [("flagged_anomaly", F.coalesce(col(ANOMALY).cast("boolean"), F.lit(False)))] if ANOMALY in df.columns else []
    tests.append(("date_mismatch", col(ts).cast("date") != col(day).cast("date")))
    zeros = reduce(lambda a, b: a + b, [col(c).cast("double") * F.lit(0.0) for c in FLOW_NUMERIC])
    return split_valid(df, [*tests, ("nonfinite_source_value", zeros != F.lit(0.0))])


# --- C1, C5-C7, G1, G2 ---------------------------------------------------


def join_features_sidecar(features: DataFrame, sidecar: DataFrame, keys: Sequence[str] = ("source_file", "source_row_number")):
    """(joined rows, rows present on one side only)."""
    keys = list(keys)
    # One full join with a flag for each side answers all three questions.
    both = features.withColumn("_left", F.lit(True)).join(sidecar.withColumn("_right", F.lit(True)), keys, "full")
    joined = both.filter("_left and _right").drop("_left", "_right")
    alone = both.filter("_left is null or _right is null").select(*keys, F.when(F.col("_right").isNull(), "features_only").otherwise("sidecar_only").alias("reason"))
    return joined, alone


def assign_day_role(df: DataFrame, day: str = "capture_day", roles: Mapping[str, str] = DAY_ROLES) -> tuple[DataFrame, DataFrame]:
    """Add ``split`` by capture day; rows of days without a role are rejected."""
    marked = df.withColumn("split", lookup(dict(roles), col(day).cast("string")))
    valid, rejected = split_valid(marked, [("unassigned_day", F.col("split").isNull())])
    return valid, rejected.drop("split")


def label_dimension(days: DataFrame, day: str = "capture_date") -> DataFrame:
    """Expected content and role of each day with defaults for unknown days."""
    text = col(day).cast("string")
    return days.withColumns(
        {
            "expected_attack_content": lookup(DAY_ATTACKS, text, "UNKNOWN"),
            "assigned_role": lookup(DAY_ROLES, text, "UNASSIGNED"),
        }
    )


def labels_absent_from_train(df: DataFrame, label: str = "Label", split: str = "split") -> DataFrame:
    """Labels that occur in validation or test but never in training."""
    seen = df.groupBy(col(label).alias("label"), col(split).alias("split")).agg(F.count(F.lit(1)).alias("row_count"))
    return seen.filter(F.col("split") != "train").join(
        seen.filter(F.col("split") == "train").select("label"), "label", "left_anti"
    )


def union_days(days: Sequence[DataFrame]) -> DataFrame:
    """Union of day tables that must share one header, column for column (G1)."""
    header = days[0].columns
    for other in days[1:]:
        if other.columns != header:
            raise ValueError("day tables have different headers")
    return reduce(lambda a, b: a.unionByName(b), days)


def unknown_values(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Distinct values of a column outside a known list."""
    return df.filter(col(column).isNotNull() & ~col(column).isin(list(known))).select(col(column).alias("value")).distinct()


def missing_features(present: Column, required: Sequence[str]) -> Column:
    """Required names that an array of names lacks."""
    return F.array_except(F.array(*[F.lit(n) for n in required]), present)


# --- D7-D9, D11 ----------------------------------------------------------


def day_profile(flows: DataFrame, file: str = "source_file", row: str = "source_row_number",
                ts: str = "timestamp_parsed", day: str = "capture_date") -> DataFrame:
    """Rows, time range, invalid times, backsteps over valid times and date mismatches per file."""
    timed = with_backsteps(flows.filter(col(ts).isNotNull()).select(col(file), col(row), col(ts)), [file], row, ts)
    steps = timed.groupBy(col(file)).agg(F.sum("_backstep").alias("chronological_backsteps"))
    base = flows.groupBy(col(file)).agg(
        F.max(col(day)).alias("capture_date"),
        F.count(F.lit(1)).alias("valid_flow_rows"),
        F.count_if(col(ts).isNull()).alias("invalid_or_missing_count"),
        F.count_if(day_text(col(ts)) != col(day)).alias("capture_date_mismatch_count"),
        F.min(col(ts)).alias("min_timestamp"),
        F.max(col(ts)).alias("max_timestamp"),
        F.count_if(col("Label") != "Benign").alias("non_benign_rows"),
    )
    joined = base.join(steps, file, "left").withColumn(
        "chronological_backsteps", F.coalesce("chronological_backsteps", F.lit(0))
    )
    return label_dimension(joined)


def _label_counts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """``label_counts`` of each key, sorted by label; labels are counted first."""
    counts = rows.groupBy(col(key), col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(col(key)).agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("label_counts"))


def day_quality(raw: DataFrame, numbers: Sequence[str], file: str = "source_file", label: str = "Label") -> DataFrame:
    """Empty, non-finite and unreadable numbers and the label counts of each file, from rows as text."""
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    empty = lambda c: col(c).isNull() | (F.trim(col(c)) == "")
    tests = {
        "empty_values": empty, "nonfinite_values": lambda c: F.isnan(number(c)) | (F.abs(number(c)) == float("inf")), "parse_errors": lambda c: ~empty(c) & number(c).isNull(),
    }
    count = lambda test: reduce(lambda a, b: a + b, [F.count_if(F.coalesce(test(c), F.lit(False))) for c in numbers])
    return raw.groupBy(col(file)).agg(*[count(test).alias(n) for n, test in tests.items()]).join(_label_counts(raw, file, label), file)


def day_details(flows: DataFrame, day: str = "capture_date", ts: str = "timestamp_parsed", label: str = "Label") -> DataFrame:
    """Rows, date mismatches, time span and label counts per capture day."""
    main = flows.groupBy(col(day)).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(day_text(col(ts)) != col(day)).alias("mismatch_count"), F.min(col(ts)).alias("min_timestamp"), F.max(col(ts)).alias("max_timestamp"),
    )
    span = F.expr("timestampdiff(SECOND, min_timestamp, max_timestamp)")
    return main.withColumn("time_span_seconds", span).join(_label_counts(flows, day, label), day)


def split_report(flows: DataFrame, day: str = "capture_date", ts: str = "timestamp_parsed",
                 split: str = "split", label: str = "Label") -> DataFrame:
    """Days, rows, label counts, mismatches and time range per role."""
    flagged = col(ANOMALY).cast("boolean") if ANOMALY in flows.columns else day_text(col(ts)) != col(day)
    labels = flows.groupBy(col(split), col(label)).agg(F.count(F.lit(1)).alias("n")).groupBy(col(split)).agg(
        F.array_sort(F.collect_list(F.struct(col(label).alias("label"), F.col("n")))).alias("label_counts")
    )
    main = flows.groupBy(col(split)).agg(
        F.array_sort(F.collect_set(col(day))).alias("days"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(flagged).alias("mismatch_count"),
        F.min(col(ts)).alias("min_timestamp"),
        F.max(col(ts)).alias("max_timestamp"),
    )
    return main.join(labels, split)


def diversity_report(profile: DataFrame) -> DataFrame:
    """Day count, span and total rows over the day profiles."""
    return profile.agg(
        F.count_distinct("capture_date").alias("day_count"),
        F.min("capture_date").alias("first_day"),
        F.max("capture_date").alias("last_day"),
        F.sum("valid_flow_rows").alias("total_rows"),
        F.max("valid_flow_rows").alias("largest_day_rows"),
        F.min("valid_flow_rows").alias("smallest_day_rows"),
    ).withColumn("span_days", F.datediff(F.col("last_day").cast("date"), F.col("first_day").cast("date")) + 1)


def class_distribution(states: DataFrame, split: str = "split", target: str = "future_attack_state") -> DataFrame:
    """States, usable states, positives, negatives and days per split."""
    usable = F.col("future_target_available")
    return states.groupBy(col(split)).agg(
        F.count(F.lit(1)).alias("states"),
        F.count_if(usable).alias("usable_states"),
        F.count_if(usable & (col(target) == 1)).alias("positive"),
        F.count_if(usable & (col(target) == 0)).alias("negative"),
        F.array_sort(F.collect_set("capture_day")).alias("capture_days"),
    )


# --- I18, I19, B25 -------------------------------------------------------


def chronological_split(df: DataFrame, ts: str, train_start: str, validation_start: str, test_start: str,
                        end: str) -> tuple[DataFrame, DataFrame]:
    """Half-open time ranges to train, validation and test; rows outside are rejected."""
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    time = col(ts).cast("timestamp_ntz")
    name = (
        F.when((time >= at(train_start)) & (time < at(validation_start)), "train")
        .when((time >= at(validation_start)) & (time < at(test_start)), "validation")
        .when((time >= at(test_start)) & (time < at(end)), "test")
    )
    marked = df.withColumn("split", name)
    valid, rejected = split_valid(marked, [("outside_ranges", F.col("split").isNull())])
    return valid, rejected.drop("split")


def day_split(states: DataFrame, roles: Mapping[str, str] = DAY_ROLES) -> tuple[DataFrame, DataFrame]:
    """Whole capture days to splits."""
    return assign_day_role(states, "capture_day", roles)


def split_integrity(states: DataFrame, features: Sequence[str] = STATE_FEATURES,
                    roles: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Violation count per rule over split states; all zero means the split is sound."""
    copies = states.groupBy("capture_day", "timestamp").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v")
    ).select(F.lit("duplicate_day_timestamp").alias("rule"), "v")
    days = states.groupBy("capture_day").agg(F.count_distinct("split").alias("n"))
    shared = days.agg(F.count_if(F.col("n") > 1).alias("v")).select(F.lit("day_in_several_splits").alias("rule"), "v")
    wrong = states.agg(F.count_if(~all_of(is_finite(col(c)) for c in features)).alias("v")).select(
        F.lit("nonfinite_feature_rows").alias("rule"), "v"
    )
    present = states.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    names = states.sparkSession.createDataFrame([(r,) for r in roles], "split string")
    empty = names.join(present, "split", "left_anti").agg(F.count(F.lit(1)).alias("v")).select(
        F.lit("empty_split").alias("rule"), "v"
    )
    unassigned = states.agg(F.count_if(F.col("split").isNull()).alias("v")).select(
        F.lit("unassigned_rows").alias("rule"), "v"
    )
    return reduce(lambda a, b: a.unionByName(b), [copies, shared, wrong, empty, unassigned]).withColumnRenamed(
        "v", "violations"
    )
