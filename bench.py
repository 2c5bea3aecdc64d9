"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads.  Each query runs once to warm
up and is then timed; results go to the no-op sink, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINE = [
    "d1_network_states", "d5_granularity_comparison", "d6_source_activity", "h2_prioritize_sources", "e4_build_multistep",
    "i8_threshold_sweep", "i6_binary_metrics", "d7_day_profile", "k1_flow_sessionize", "k9_admit_telemetry",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="run-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", scratch)
        # Wide aggregates compile to large methods; let the JIT take them.
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from flowtide.operators.states import granularity_comparison, granularity_states, network_states
    from flowtide.plans import catalog, tables

    # The published timings start from a finished flow table, so that form is timed too.
    flows_path = f"{scratch}/flows"
    tables.flows(spark, sf_dir).repartition(int(cpus)).write.parquet(flows_path)
    flows = spark.read.parquet(flows_path)
    # A table of the published size: the same flows in seven periods of forty days.
    many_path = f"{scratch}/many"
    period = flows.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("timestamp_parsed", F.expr("timestamp_parsed + make_interval(0, 0, 0, 40 * _n)"))
    period.withColumn("capture_date", F.date_format("timestamp_parsed", "yyyy-MM-dd")).drop("_n").write.parquet(many_path)
    many = spark.read.parquet(many_path)
    runs = {name: (lambda name=name: catalog.QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    runs["d1_states_10s_from_flow_table"] = lambda: network_states(flows)
    runs["d1_states_60s_from_flow_table"] = lambda: network_states(flows, 60)
    runs["d5_granularity_from_flow_table"] = lambda: granularity_comparison(flows)
    for seconds in (1, 5, 10, 30, 60):
        runs[f"d1_states_{seconds}s_published_size"] = lambda seconds=seconds: network_states(many, seconds)
    runs["d5_states_of_all_lengths_published_size"] = lambda: granularity_states(many)
    times = {}
    for name, build in runs.items():
        for _ in range(2):
            started = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    count, many_count = flows.count(), many.count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "flow_rows": count,
                "states_10s_flows_per_second": round(count / times["d1_states_10s_from_flow_table"]),
                "published_size_flow_rows": many_count, "published_size_flows_per_second": round(many_count / times["d1_states_10s_published_size"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
