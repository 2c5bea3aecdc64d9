"""Writers (A10-A14, A17) and telemetry JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.expressions import col, is_finite
from flowtide.operators.cleaning import select_model_features, union_days


def write_clean_flow(flows: DataFrame, path: str, provenance: Mapping[str, str] | None = None, mode: str = "errorifexists") -> None:
    """Snappy parquet of clean flows; provenance becomes column metadata, of the label or else the first column (A10)."""
    _tagged(flows, provenance).write.mode(mode).option("compression", "snappy").parquet(path)


def _tagged(rows: DataFrame, provenance: Mapping[str, str] | None) -> DataFrame:
    if not provenance or not rows.columns:
        return rows
    return rows.withMetadata("Label" if "Label" in rows.columns else rows.columns[0], {"provenance": dict(provenance)})


def write_model_features(
    flows: DataFrame, path: str, excluded: Sequence[str] = (), mode: str = "errorifexists", provenance: Mapping[str, str] | None = None
) -> None:
    """Numeric model-safe columns only, all of them finite or null; anything else ends the write (A10)."""
    features = select_model_features(flows, excluded)
    refused = F.raise_error(F.lit("non-finite value in a model feature"))
    kinds = {f.name: f.dataType for f in features.schema.fields if f.dataType.typeName() in ("float", "double")}
    checked = {c: F.when(col(c).isNotNull() & ~is_finite(col(c)), refused.cast(kind)).otherwise(col(c)) for c, kind in kinds.items()}
    _tagged(features.withColumns(checked), provenance).write.mode(mode).option("compression", "snappy").parquet(path)


def _by_day(rows: DataFrame) -> DataFrame:
    """Numbers as doubles, rebalanced by day: few files for a small day, several tasks for a large one."""
    doubles = {n: col(n).cast("double") for n, t in rows.dtypes if t in ("int", "bigint", "float", "smallint", "tinyint") and n != "source_row_number"}
    return rows.withColumns(doubles).hint("rebalance", "capture_date")


def write_multiday(days: Sequence[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Days of one header, numbers as doubles, one directory per capture date.

    Rows are spread over several files per day, so a large day is not one task.
    """
    _by_day(union_days(days)).write.mode(mode).partitionBy("capture_date").parquet(path)


def append_days(days: DataFrame, path: str) -> None:
    """Add the capture days of ``days`` to the table at ``path``; a day that is there already is replaced as a whole.

    Loading a day twice therefore changes nothing, and other days' files are not touched.  A header or type other than the
    stored one is refused before any job runs.  Without a table yet, this writes the first one; ``days`` without rows changes
    nothing.  Days are replaced when the job commits, one directory after another.
    """
    spark, rows = days.sparkSession, _by_day(days)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        kinds = lambda df: [(n, t) for n, t in df.dtypes if n != "capture_date"]
        stored = spark.read.parquet(path)
        if kinds(stored) != kinds(rows):
            odd = sorted({n for n, _ in set(kinds(stored)) ^ set(kinds(rows))})
            raise ValueError(f"days differ from the stored table in {', '.join(odd) or 'the order of columns'}")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture_date").parquet(path)


def write_states(states: DataFrame, path: str, schema_version: str = "network-state-v1", mode: str = "errorifexists") -> None:
    """State parquet with its schema version in the column metadata."""
    states.withMetadata("timestamp", {"schema_version": schema_version}).write.mode(mode).parquet(path)


def write_state_splits(states: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One directory per split."""
    states.hint("rebalance", "split").write.mode(mode).partitionBy("split").parquet(path)


def write_windows(windows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Windows with their nested arrays, zstd compressed."""
    windows.write.mode(mode).option("compression", "zstd").parquet(path)


def write_report(report: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Small report frame as one JSON or CSV file."""
    if fmt not in ("json", "csv"):
        raise ValueError("report format must be json or csv")
    writer = report.repartition(1).write.mode(mode)
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)


def write_envelopes(envelopes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    envelopes.drop("state_count").write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
