"""Run catalog queries on Spark and on DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return "∅"
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, np.integer, float, np.floating)):
            return float(v)
        return str(v)

    return sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=repr)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    for c in spark_rows.columns:
        kinds = [("O" if k.kind in "OUT" else "b" if k.kind == "b" else "n") for k in (spark_rows[c].dtype, sql_rows[c].dtype)]
        if kinds[0] != kinds[1] and len(spark_rows):
            return f"type of {c}: {spark_rows[c].dtype} != {sql_rows[c].dtype}"
        if {spark_rows[c].dtype.kind, sql_rows[c].dtype.kind} == {"i", "f"}:
            return f"type of {c}: {spark_rows[c].dtype} != {sql_rows[c].dtype}"
    for a, b in zip(canonical(spark_rows), canonical(sql_rows)):
        if a != b:
            return f"first different row {a} != {b} ({sorted(spark_rows.columns)})"
    return None


def main(sf: str, names: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        started = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - started
            if name not in oracles:
                print(f"ROWS {name} {len(got)} {took:.1f}s", flush=True)
                continue
            started = time.time()
            want = con.execute(oracles[name]).df()
            problem = difference(got, want)
            print(f"{'OK' if problem is None else 'DIFF'} {name} {len(got)} {took:.1f}s sql {time.time() - started:.1f}s {problem or ''}"[:700], flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"FAIL {name} {type(error).__name__} {str(error)[:500]!r}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
