"""Readers for flow exports, states, packets, connection logs and telemetry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.config import (
    ACTIVITY_KEYS, ACTIVITY_MEASURES, PACKET_COLUMNS, PACKET_OPTIONAL, STATE_COLUMNS, STATE_META,
)
from flowtide.functions.expressions import col, day_text, micros
from flowtide.operators import cleaning, packets as packet_ops
from flowtide.operators.connections import LOG_FIELDS
from flowtide.operators.states import validate_states


def _file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def _header_as_written(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"no header in {path}")
    names = [n.strip('"') for n in first[0][0].lstrip("﻿").split(",")]
    if [n.strip() for n in names] == [""]:
        raise ValueError(f"no columns in {path}")
    return names


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Stripped header names of a delimited file without the byte-order mark; reads one line."""
    return [n.strip().strip('"') for n in _header_as_written(spark, path)]


def read_flow_csv(spark: SparkSession, paths: str | Sequence[str], header: Sequence[str] | None = None) -> DataFrame:
    """Flow export as text columns with ``source_file`` and ``source_row_number`` (A1).

    Row numbers start at 1 in each file and count repeated header rows.  A task knows the
    place of a row inside its file split; the rows of the earlier splits of the file are
    added from a per-split count table, so nothing is sorted.  A file whose header differs
    from the first file's (or from ``header``) ends the read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    written = list(header) if header else _header_as_written(spark, paths[0])
    names = [n.strip().strip('"') for n in written]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in written])
    raw = spark.read.csv(paths, schema=schema, header=True, enforceSchema=False, encoding="UTF-8", nullValue="\u0000", emptyValue="")
    tagged = raw.select(
        *[F.coalesce(col(w), F.lit("")).alias(n) for w, n in zip(written, names, strict=True)],
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = tagged.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("_path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("_path", "_start", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # One row per file split; adaptive execution broadcasts it by its real size.
    numbered = tagged.join(splits, ["_path", "_start"])
    return numbered.select(
        *[col(n) for n in names], _file_name(F.col("_path")).alias("source_file"),
        (F.col("_offset") + F.col("_id") - F.col("_first") + 1).alias("source_row_number"),
    )


def clean_flows(raw: DataFrame, binary: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cleaning of a text flow table: headers out, numbers, time, capture date, labels (A2)."""
    header = [c for c in raw.columns if c not in ("source_file", "source_row_number")]
    rows = cleaning.drop_repeated_headers(raw, header)
    numbers = [c for c in header if c not in cleaning.TEXT_COLUMNS]
    rows = cleaning.parse_timestamp(cleaning.normalize_numeric(rows, numbers))
    rows = rows.withColumn("capture_date", cleaning.capture_date_from_name(F.col("source_file")))
    rows = cleaning.flag_capture_mismatch(rows)
    if not binary:
        return rows.withColumn("original_label", F.col("Label")), rows.limit(0).withColumn("reason", F.lit(""))
    return cleaning.add_binary_label(rows)


def load_flow_csv(spark: SparkSession, paths: str | Sequence[str], binary: bool = True):
    """(clean flows, rejected rows, row statistics, numeric issues) of whole exports (A2)."""
    raw = read_flow_csv(spark, paths)
    numbers = [c for c in raw.columns if c not in {*cleaning.TEXT_COLUMNS, "source_file", "source_row_number"}]
    valid, rejected = clean_flows(raw, binary)
    rows, issues = cleaning.ingestion_stats(raw, numbers, ["source_file"])
    return valid, rejected, rows, issues


def read_states(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid states, rejected rows) of a csv, tsv or parquet state table (A3)."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        names = read_header_tsv(spark, path) if suffix == "tsv" else read_header(spark, path)
        types = {c: T.StringType() if c in STATE_META else T.DoubleType() for c in names}
        schema = T.StructType([T.StructField(c, types[c]) for c in names])
        frame = spark.read.csv(path, schema=schema, header=True, sep="\t" if suffix == "tsv" else ",")
    elif suffix == "parquet":
        frame = spark.read.parquet(path)
        frame = frame.select(*[c for c in frame.columns if c in STATE_COLUMNS])
    else:
        raise ValueError(f"unsupported state file: {path}")
    valid, rejected = validate_states(frame)
    return valid.withColumn("timestamp", F.expr("try_cast(`timestamp` as timestamp_ntz)")), rejected


def read_header_tsv(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].lstrip("﻿").split("\t") if first else []


PACKET_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*PACKET_COLUMNS, *PACKET_OPTIONAL, "capture_day"]]
    + [T.StructField("_corrupt_record", T.StringType())]
)


def read_packet_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(packets, rejected lines) of JSON-lines packet events (A4).

    Blank lines are skipped; a ``capture_day`` must be the day of the time.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    schema = T.StructType([f for f in PACKET_SCHEMA.fields if f.name != "_corrupt_record"])
    parsed = lines.select("value", F.from_json("value", PACKET_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    rows = parsed.select("value", *[F.col("j")[f.name].alias(f.name) for f in schema.fields], F.col("j._corrupt_record").alias("_bad"))
    day = F.col("capture_day")
    ts = F.expr("try_cast(`timestamp` as timestamp_ntz)")
    fine, broken = cleaning.split_valid(
        rows,
        [
            ("invalid json", F.col("_bad").isNotNull() | F.coalesce(F.col("timestamp"), F.col("source_ip")).isNull()),
            ("outside capture_day", day.isNotNull() & (ts.isNull() | (day_text(ts) != day))),
        ],
    )
    valid, rejected = packet_ops.normalize_packets(fine.drop("_bad"))
    columns = ["value", "reason"]
    return valid.drop("value"), broken.select(*columns).unionByName(rejected.select(*columns))


def read_zeek_json(spark: SparkSession, path: str, line_filter: bool = True) -> DataFrame:
    """Connection log records of JSON lines as text fields; bad lines keep null fields (A5)."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in LOG_FIELDS])
    lines = spark.read.text(path).select(F.col("value").alias("raw_line"), _file_name(F.col("_metadata.file_path")).alias("source_file"))
    rows = lines.filter((F.trim("raw_line") != "") & ~F.startswith(F.col("raw_line"), F.lit("#")))
    parsed = rows.withColumn("j", F.from_json("raw_line", schema))
    return parsed.select("raw_line", "source_file", *[F.col("j").getField(f).alias(f) for f in LOG_FIELDS])


def read_zeek_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of tab-separated connection logs.

    Each line follows the last ``#fields`` line before it in its own file.  Lines are ordered
    inside their file split; a split hands its last header to the splits after it, so one
    large log is as many tasks as it has splits.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    ).withColumn("_header", F.when(F.startswith(F.col("raw_line"), F.lit("#fields")), F.col("raw_line")))
    inside = W.partitionBy("_path", "_start").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("_path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    carried = lines.groupBy("_path", "_start").agg(F.max_by("_header", F.when(F.col("_header").isNotNull(), F.col("_id"))).alias("_last"))
    carried = carried.select("_path", "_start", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    placed = lines.withColumn("_near", F.last("_header", ignorenulls=True).over(inside)).join(carried, ["_path", "_start"])
    fields = F.split(F.coalesce("_near", "_carried"), "\t")
    data = placed.filter((F.trim("raw_line") != "") & ~F.startswith(F.col("raw_line"), F.lit("#")))
    rows = data.withColumn("_fields", F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0)))).withColumn("_values", F.split("raw_line", "\t"))
    fine, rejected = cleaning.split_valid(
        rows,
        [
            ("missing #fields header", F.col("_fields").isNull()),
            ("field count differs from #fields", F.size("_values") != F.size("_fields")),
        ],
    )
    mapped = fine.withColumn("_m", F.map_from_arrays("_fields", "_values"))
    return (
        mapped.select("raw_line", _file_name(F.col("_path")).alias("source_file"), *[F.try_element_at("_m", F.lit(f)).alias(f) for f in LOG_FIELDS]),
        rejected.select("raw_line", _file_name(F.col("_path")).alias("source_file"), "reason"),
    )


def detect_replay_kind(columns: Iterable[str]) -> str:
    """``state`` for all state columns, ``flow`` for Timestamp and Label."""
    names = set(columns)
    if set(STATE_COLUMNS) <= names:
        return "state"
    if {"Timestamp", "Label"} <= names:
        return "flow"
    raise ValueError("neither a state table nor a flow export")


def read_replay(spark: SparkSession, path: str) -> tuple[str, DataFrame, DataFrame]:
    """(kind, rows, rejected rows) of a replay file."""
    columns = spark.read.parquet(path).columns if path.rstrip("/").endswith(".parquet") else read_header(spark, path)
    kind = detect_replay_kind(columns)
    if kind == "state":
        return kind, *read_states(spark, path)
    return kind, *flow_replay(spark, path)


def flow_replay(spark: SparkSession, path: str, max_events: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(flows, rejected rows) of a flow export replayed in file order."""
    valid, rejected = replay_rows(read_flow_csv(spark, path))
    if max_events is not None:
        valid = limit_events(valid, max_events, "timestamp_parsed", "source_row_number")
    return valid, rejected


def replay_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the right day that are never earlier than the row before; the rest with a reason."""
    rows, bad_labels = clean_flows(raw)
    stepped = cleaning.with_backsteps(rows, ["source_file"], "source_row_number", "timestamp_parsed")
    valid, rejected = cleaning.split_valid(
        stepped,
        [
            ("invalid timestamp", F.col("timestamp_parsed").isNull()),
            ("outside capture day", F.col("timestamp_capture_date_mismatch")),
            ("not in time order", F.col("_backstep") == 1),
        ],
    )
    helpers = ["_block", "_previous_ts", "_backstep"]
    return valid.drop(*helpers), rejected.drop(*helpers).unionByName(bad_labels, allowMissingColumns=True)


def limit_events(rows: DataFrame, n: int, ts: str = "timestamp", *tie: str) -> DataFrame:
    """First n rows by time."""
    return rows.orderBy(col(ts), *[col(t) for t in tie]).limit(n)


STATE_POINT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()), T.StructField("capture_day", T.StringType()),
        T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.StringType()), T.StructField("sensor_id", T.StringType()),
        T.StructField("sequence", T.LongType()), T.StructField("sent_at", T.StringType()),
        T.StructField("states", T.ArrayType(STATE_POINT)), T.StructField("source_schema_version", T.StringType()),
        T.StructField(
            "source_activity",
            T.ArrayType(
                T.StructType(
                    [T.StructField(c, T.StringType()) for c in ACTIVITY_KEYS] + [T.StructField(c, T.DoubleType()) for c in ACTIVITY_MEASURES]
                )
            ),
        ),
    ]
)


def read_telemetry_envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state points, activity rows, rejected envelopes) of nested JSON telemetry."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.col("value").alias("raw_line"), F.from_json("value", ENVELOPE_SCHEMA).alias("j")).select("raw_line", "j.*")
    fine, rejected = cleaning.split_valid(
        parsed,
        [
            ("schema_version is not 1", F.col("schema_version").isNull() | (F.col("schema_version") != "1")),
            ("invalid sensor_id", ~F.coalesce(F.col("sensor_id").rlike("^sensor-[a-f0-9]{16}$"), F.lit(False))),
            ("invalid sequence", F.col("sequence").isNull() | (F.col("sequence") < 1)),
            ("state count not in 1..60", ~F.coalesce(F.size("states").between(1, 60), F.lit(False))),
            ("too many activity rows", F.coalesce(F.size("source_activity") > 120, F.lit(False))),
            ("activity without schema version", F.coalesce(F.size("source_activity") > 0, F.lit(False)) & ~F.col("source_schema_version").eqNullSafe("1")),
        ],
    )
    as_time = lambda c: c.cast("timestamp_ntz")
    states = fine.select("sensor_id", "sequence", F.posexplode("states").alias("state_index", "s")).select(
        "sensor_id", "sequence", "state_index", as_time(F.col("s.timestamp")).alias("timestamp"), F.col("s.capture_day").alias("capture_day"),
        F.col("s.features").alias("features"),
    )
    activity = fine.select("sensor_id", "sequence", F.explode("source_activity").alias("a")).select(
        "sensor_id", "sequence", F.col("a.source_ip").alias("source_ip"), F.col("a.capture_day").alias("capture_day"),
        as_time(F.col("a.interval_start")).alias("interval_start"), as_time(F.col("a.interval_end")).alias("interval_end"),
        *[F.col("a")[m].alias(m) for m in ACTIVITY_MEASURES],
    )
    return states, activity, rejected.select("raw_line", "reason")


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size, SHA-256, capture date, role and expected content of every file.

    Executors stream each file through the digest; nothing but the digest reaches the driver.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").repartition(col("path"))
    schema = "path string, size_bytes bigint, sha256 string"

    def digest(frames: Iterable[pd.DataFrame]):
        from pyarrow import fs

        for pdf in frames:
            sums = []
            for name in pdf["path"]:
                system, inner = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                total = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as stream:
                    while chunk := stream.read(1 << 20):
                        total.update(chunk)
                sums.append(total.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "size_bytes": pdf["length"], "sha256": sums})

    found = files.mapInPandas(digest, schema).withColumn("source_file", _file_name(F.col("path")))
    dated = found.withColumn("capture_date", cleaning.capture_date_from_name(F.col("source_file")))
    return cleaning.label_dimension(dated)
