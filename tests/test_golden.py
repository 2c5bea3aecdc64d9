"""Known values of single operators."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.config import FLOW_NUMERIC, HIGH, INTERVALS, LOW, MEDIUM, STATE_FEATURES
from flowtide.functions import ordered
from flowtide.operators import activity, cleaning, connections, evaluation, models, packets, states, windows
from flowtide.sources import readers

FLOW = (
    "capture_date string, timestamp_parsed timestamp_ntz, Label string, `Dst Port` int, `Flow Duration` double, `Tot Fwd Pkts` double, `Tot Bwd Pkts` double, "
    "`TotLen Fwd Pkts` double, `TotLen Bwd Pkts` double, `Flow IAT Mean` double, `Flow IAT Std` double, `SYN Flag Cnt` double, `ACK Flag Cnt` double, "
    "`RST Flag Cnt` double, `Pkt Len Mean` double, `Pkt Len Std` double, timestamp_capture_date_mismatch boolean"
)


def flow_frame(spark, flagged=False):
    at = lambda day, s: datetime(2018, 2, day, 0, 0, s)
    rows = [
        ("2018-02-14", at(14, 1), "Benign", 80, 10.0, 2.0, 1.0, 100.0, 50.0, 1.0, 0.0, 1.0, 1.0, 0.0, 50.0, 5.0, flagged),
        ("2018-02-14", at(14, 11), "Attack", 443, 20.0, 4.0, 2.0, 200.0, 100.0, 2.0, 1.0, 0.0, 1.0, 1.0, 100.0, 10.0, False),
        ("2018-02-15", at(15, 1), "Benign", 53, 30.0, 1.0, 1.0, 20.0, 20.0, 3.0, 1.0, 0.0, 1.0, 0.0, 20.0, 2.0, False),
        ("2018-02-15", at(15, 11), "Benign", 53, 40.0, 1.0, 1.0, 20.0, 20.0, 4.0, 1.0, 0.0, 1.0, 0.0, 20.0, 2.0, False),
    ]
    return spark.createDataFrame(rows, FLOW)


def test_states_targets_and_modes(spark):
    rows = states.network_states(flow_frame(spark)).orderBy("timestamp").collect()
    assert [r["binary_attack_state"] for r in rows] == [0, 1, 0, 0]
    assert [r["future_attack_state"] for r in rows] == [1, -1, 0, -1]
    assert [r["future_target_available"] for r in rows] == [True, False, True, False]
    assert (rows[0]["fwd_byte_share"], rows[0]["bytes_per_second"], rows[0]["median_duration"]) == (pytest.approx(2 / 3), 15.0, 10.0)
    plain = states.network_states(flow_frame(spark), mode="inference").orderBy("timestamp").collect()
    assert [[a[f] for f in STATE_FEATURES] for a in plain] == [[b[f] for f in STATE_FEATURES] for b in rows]


def test_empty_intervals_and_anomalies(spark):
    fine = states.network_states(flow_frame(spark), 5).filter("flow_count = 0").collect()
    assert fine and all(r[f] == 0 for r in fine for f in STATE_FEATURES)
    assert states.network_states(flow_frame(spark, flagged=True)).agg(F.sum("flow_count")).first()[0] == 3
    valid, rejected = cleaning.usable_flows(flow_frame(spark).withColumn("Flow Duration", F.when(F.col("Dst Port") == 80, float("nan")).otherwise(1.0)))
    assert (valid.count(), rejected.count()) == (3, 1)
    with pytest.raises(ValueError):
        states.network_states(flow_frame(spark), 7)


def test_quantiles_of_one_huge_group_are_exact(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(8, 3, 4001), -rng.lognormal(3, 2, 500), np.repeat(7.0, 3000)])
    frame = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double").repartition(4)
    got = ordered.group_quantiles(frame, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}).first()
    assert (got["a"], got["b"], got["c"]) == pytest.approx(tuple(np.quantile(values, [0.1, 0.5, 0.95])))
    both = frame.unionByName(frame.limit(11).withColumn("k", F.lit(2)))
    medians = {r["k"]: r["m"] for r in ordered.group_median(both, ["k"], "v", "m").collect()}
    assert set(medians) == {1, 2} and medians[1] == pytest.approx(np.median(values))


def test_ordered_blocks_equal_plain_windows(spark):
    rows = [(None if i % 3 == 0 else i % 3, i // 10, i, (i * 37) % 101) for i in range(300)]
    frame = spark.createDataFrame(rows, "k int, b long, i long, v long")
    got = ordered.prefix(frame, ["k"], ["b"], [F.col("i")], {"s": ("sum", "v"), "m": ("max", "v")})
    got = ordered.previous(got, ["k"], "b", [F.col("i")], {"p": "v"})
    from pyspark.sql import Window as W

    w = W.partitionBy("k").orderBy("i")
    want = frame.select("*", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"),
                        F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("m"), F.lag("v").over(w).alias("p"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_csv_rows_numbers_and_raw_tokens(spark, tmp_path):
    header = "Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Flow Byts/s,Flow Pkts/s,Label"
    lines = ["﻿" + header, "80,6,14/02/2018 08:31:01,10,2,1,100,50,NaN,Infinity,Benign", header, "443,6,14/02/2018 08:31:02,20,2,1,100,50,120000,300,Infilteration"]
    path = tmp_path / "Friday-14-02-2018.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    valid, rejected, stats, issues = readers.load_flow_csv(spark, str(path))
    rows = valid.orderBy("source_row_number").collect()
    assert [r["source_row_number"] for r in rows] == [1, 3] and [r["binary_label"] for r in rows] == [0, 1]
    assert [r["Flow Byts/s"] is None for r in rows] == [True, False] and [r["Flow Byts/s__raw"] for r in rows] == ["NaN", "120000"]
    assert rows[0]["capture_date"] == "2018-02-14" and rejected.count() == 0
    assert stats.first()["repeated_header_count"] == 1 and issues.count() == 2
    assert cleaning.candidate_features(valid) == ["Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts"]


def test_source_activity_golden(spark):
    at = lambda s: datetime(2024, 1, 1, 1, 0, s)
    rows = [(at(s), "10.0.0.1", "10.0.0.2", 1, 2, "TCP", 100.0, "SYN") for s in (1, 0, 1)]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, packet_length double, tcp_flags string")
    got = activity.source_activity(packets.normalize_packets(frame)[0]).collect()
    assert len(got) == 1 and (got[0]["flow_count"], got[0]["packet_count"], got[0]["byte_count"], got[0]["mean_iat"]) == (1, 3, 300.0, 0.5)
    empty = activity.source_activity(packets.normalize_packets(frame.limit(0))[0])
    assert len(empty.columns) == 16 and empty.count() == 0
    bad = frame.withColumn("destination_port", F.lit(65536))
    assert packets.normalize_packets(bad)[1].first()["reason"] == "invalid port: destination_port"


def test_priorities_and_rate_limit(spark):
    at = lambda s: datetime(2024, 1, 1, 1, 0, s)
    raw = [("10.0.0.1", 0, 1, 1, 100.0, 1, 1), ("10.0.0.2", 0, 1, 10, 1000.0, 3, 3), ("10.0.0.3", 0, 1, 1, 100.0, 1, 1), ("10.0.0.3", 10, 2, 10, 10000.0, 3, 3)]
    rows = [(ip, "2024-01-01", at(s), at(s + 10), f, p, b, d, q, b / p, 0.0, 0, 0, 0, p / 10, b / 10) for ip, s, f, p, b, d, q in raw]
    frame = spark.createDataFrame(rows, "source_ip string, capture_day string, interval_start timestamp_ntz, interval_end timestamp_ntz, flow_count long, packet_count long, byte_count double, unique_destinations long, unique_destination_ports long, mean_packet_size double, mean_iat double, syn_count long, ack_count long, rst_count long, packet_rate double, byte_rate double")
    ranked = activity.prioritize_sources(activity.with_single_forecast(frame, 0.5, True)).orderBy("source_ip", "interval_start").collect()
    assert [ranked[i]["priority"] for i in (0, 1, 3)] == [LOW, MEDIUM, HIGH]
    assert "flow_count growth 100%" in ranked[3]["measured_reasons"] and "network forecast is elevated" in ranked[3]["measured_reasons"]
    limited = activity.rate_limit_what_if(spark.createDataFrame([(350.0, 50.0)], "packet_rate double, recommended_limit double"))[0].first()
    assert (limited["simulated_allowed_rate"], limited["throttled_amount"]) == (50, 300) and limited["percentage_reduction"] == pytest.approx(85.7142857)


def test_sweep_and_metrics_golden(spark):
    frame = spark.createDataFrame(list(zip([0, 1, 0, 1, 0], [0.1, 0.2, 0.3, 0.8, 0.9])), "label int, score double")
    rows = {r["threshold"]: r for r in evaluation.threshold_sweep(frame, [0.2, 0.5]).collect()}
    assert rows[0.2]["alert_count"] == 4 and rows[0.2]["alerts_per_minute"] == pytest.approx(4.8) and rows[0.5]["tp"] == 1
    one = evaluation.binary_metrics(frame.filter("label = 1")).first()
    assert one["roc_auc"] is None and one["pr_auc"] is None and one["false_positive_rate"] is None
    got = evaluation.binary_metrics(frame).first()
    assert got["roc_auc"] == pytest.approx(3 / 6) and got["pr_auc"] == pytest.approx(0.5 * 2 / 4 + 0.5 * 1 / 2)


def state_table(spark, groups, n, start=100):
    from datetime import timedelta

    rows = []
    for g, split in enumerate(groups):
        for i in range(n):
            rows.append((split, f"2024-01-0{g + 1}", datetime(2024, 1, g + 1) + timedelta(seconds=10 * i), float(start + i), start + i if g == 0 else i, [1, 0, 1, 0, -1][i % 5], i < n - 1, i % 2))
    return spark.createDataFrame(rows, "split string, capture_day string, timestamp timestamp_ntz, f double, now int, future_attack_state int, future_target_available boolean, binary_attack_state int")


def test_window_golden(spark):
    table = state_table(spark, ["train", "validation", "test"], 5)
    made = windows.build_sequences(table, length=2, features=["f"]).orderBy("capture_day", "origin").collect()
    assert len(made) == 9 and made[0]["target"] == 0
    one = table.filter("capture_day = '2024-01-01'").unionByName(state_table(spark, ["train"], 15).filter("f >= 105"))
    got = windows.build_sequences(one, "now", 2, 2, 2, ["f"]).orderBy("origin").collect()
    assert got[0]["target"] == 103
    with pytest.raises(ValueError):
        windows.build_sequences(table, "future_attack_state", 2, 2, features=["f"])
    with pytest.raises(ValueError):
        windows.build_multistep(table, target="future_attack_state", features=["f"])


def test_long_group_windows_equal_brute_force(spark):
    """One group that spans several index blocks."""
    table = state_table(spark, ["train"], 3000)
    made = windows.build_multistep(table, 10, 5, 7, features=["f"]).select("origin", F.col("features")[0][0].alias("a"), F.col("features")[9][0].alias("z"), "targets").orderBy("origin").collect()
    starts = list(range(0, 3000 - 10 - 5 + 1, 7))
    assert [(r["a"], r["z"]) for r in made] == [(100.0 + s, 109.0 + s) for s in starts]
    assert [r["targets"] for r in made] == [[(s + 9 + k) % 2 for k in range(1, 6)] for s in starts]


def test_ablation_matches_numpy(spark):
    rng = np.random.default_rng(5)
    cubes, labels = rng.normal(size=(60, 10, 17)), rng.integers(0, 2, 60)
    weights, bias = rng.normal(size=(170, 5)), rng.normal(size=5)
    scorer = models.logistic_scorer(weights, bias)
    frame = spark.createDataFrame([(i, c.tolist(), int(y)) for i, (c, y) in enumerate(zip(cubes, labels))], "id int, features array<array<double>>, label int")
    rows = {(r["kind"], r["name"]): r for r in models.ablation(models.ablation_scores(frame, scorer), 0.5).collect()}
    assert len(rows) == 17 + 6 + 10
    masked = cubes.copy()
    masked[:, :, STATE_FEATURES.index("mean_iat")] = 0
    change = scorer(cubes)[:, 0] - scorer(masked)[:, 0]
    assert rows[("feature", "mean_iat")]["mean_signed_score_change"] == pytest.approx(change.mean())
    masked = cubes.copy()
    masked[:, 9, :] = 0
    assert rows[("position", "t")]["mean_absolute_score_change"] == pytest.approx(np.abs(scorer(cubes)[:, 0] - scorer(masked)[:, 0]).mean())
    with pytest.raises(Exception, match="scores must be finite"):
        models.score_windows(frame, lambda cube: np.full((len(cube), 5), 2.0)).collect()


def test_logistic_separates(spark):
    rows = [(float(i % 20), float((i * 7) % 5), int(i % 20 > 12)) for i in range(400)]
    frame = spark.createDataFrame(rows, "a double, b double, y int")
    scaler = models.fit_scaler(frame, ["a", "b"])
    assert scaler.first()["scale__a"] == pytest.approx(np.std([r[0] for r in rows]))
    scaled = models.apply_scaler(frame, scaler, ["a", "b"])
    scored = models.predict_logistic(scaled, models.fit_logistic(scaled, ["a", "b"], "y", balanced=True), ["a", "b"])
    assert evaluation.binary_metrics(scored, 0.5, [], "y").first()["roc_auc"] == pytest.approx(1.0)


def test_connection_golden(spark, tmp_path):
    body = '{"ts":1700000000.0,"uid":"C1","id.orig_h":"10.0.0.1","id.resp_h":"10.0.0.2","id.orig_p":49152,"id.resp_p":443,"proto":"tcp","duration":2.5,"orig_bytes":100,"resp_bytes":200,"orig_pkts":3,"resp_pkts":4,"conn_state":"SF"}'
    (tmp_path / "conn.log").write_text(body + "\n" + body.replace("1700000000.0", '"2023-11-14T23:13:21+01:00"').replace("C1", "C2") + "\n" + body.replace('"ts":1700000000.0,', "") + "\nnot json\n")
    valid, rejected = connections.normalize_connections(readers.read_zeek_json(spark, str(tmp_path / "conn.log")))
    rows = valid.orderBy("record_id").collect()
    assert [r["event_timestamp"] for r in rows] == [datetime(2023, 11, 14, 22, 13, 20), datetime(2023, 11, 14, 22, 13, 21)]
    assert rows[0]["forward_packets"] == 3 and rows[0]["protocol"] == "TCP" and rejected.count() == 2
    late = connections.late_records(valid.withColumn("n", F.when(F.col("record_id") == "C2", 1).otherwise(2)), "n")
    assert {r["record_id"]: r["late"] for r in late.collect()} == {"C2": False, "C1": True}
    names = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto"]
    (tmp_path / "t.log").write_text("#fields\t" + "\t".join(names) + "\n1700000000.5\tU\t1.1.1.1\t1\t2.2.2.2\t2\tudp\nshort\tline\n")
    table, broken = readers.read_zeek_tsv(spark, str(tmp_path / "t.log"))
    assert connections.normalize_connections(table)[0].first()["protocol"] == "UDP" and broken.count() == 1


def test_rank_order_and_duplicate_states(spark):
    rows = [("b", MEDIUM, 3, 5), ("a", HIGH, 5, 1), ("c", MEDIUM, 4, 1), ("d", MEDIUM, 3, 9), ("e", LOW, 0, 99)]
    frame = spark.createDataFrame(rows, "source_ip string, priority string, priority_points int, packet_count long")
    assert [r["source_ip"] for r in activity.rank_sources(frame).collect()] == ["a", "c", "d", "b", "e"]
    table = state_table(spark, ["train"], 12).withColumn("sensor_id", F.lit("s"))
    copied = table.unionByName(table.limit(4)).unionByName(table.limit(1)).repartition(3)
    status = states.history_status(copied, ["sensor_id"], 10).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in status} == {"rejected_duplicate": 5, "buffering": 9, "ready": 3}


def test_metrics_with_crowded_scores(spark):
    rng = np.random.default_rng(9)
    scores = np.concatenate([10.0 ** -rng.uniform(3, 14, 300), 1 - 10.0 ** -rng.uniform(3, 14, 300), rng.uniform(0, 1, 200).round(2), [0.0, 1.0]])
    labels = (rng.uniform(size=len(scores)) < 0.3 + 0.4 * scores).astype(int)
    got = evaluation.binary_metrics(spark.createDataFrame([(int(y), float(v)) for y, v in zip(labels, scores)], "label int, score double")).first()
    pos, neg = scores[labels == 1], scores[labels == 0]
    wins = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    values = np.unique(scores)[::-1]
    hits = np.array([(pos >= v).sum() for v in values])
    alarms = np.array([(neg >= v).sum() for v in values])
    gained = np.diff(np.concatenate([[0], hits])) / len(pos)
    assert got["roc_auc"] == pytest.approx(wins) and got["pr_auc"] == pytest.approx((gained * hits / (hits + alarms)).sum())


def test_states_of_all_lengths_equal_one_run_each(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{i % 2}", f"2018-02-1{4 + i % 2}", int(rng.integers(0, 200)), None if i % 50 == 0 else int(rng.integers(0, 9)), float(rng.choice([0, 5, 5, 1e3, 9e7])), "Bot" if i % 40 == 0 else "Benign") for i in range(900)]
    rows += [("s0", "2018-02-14", 77, 443, float(v), "Benign") for v in rng.integers(0, 10**8, 3001)]  # one crowded second
    frame = spark.createDataFrame(rows, "sensor string, capture_date string, off int, `Dst Port` int, `Flow Duration` double, Label string")
    frame = frame.withColumn("timestamp_parsed", F.expr("timestampadd(SECOND, off, cast(capture_date as timestamp_ntz))"))
    frame = frame.select("*", *[F.col("off").cast("double").alias(c) for c in FLOW_NUMERIC if c != "Flow Duration"])
    whole = states.granularity_states(frame, keys=["sensor"])
    for seconds in INTERVALS:
        own = whole.filter(F.col("interval_seconds") == seconds).drop("interval_seconds")
        alone = states.network_states(frame, seconds, keys=["sensor"])
        assert own.columns == alone.columns and sorted(map(str, own.collect())) == sorted(map(str, alone.collect()))
        durations = [r[4] for r in rows if r[0] == "s0" and r[1] == "2018-02-14" and r[2] // seconds == 77 // seconds]
        at = F.expr(f"timestampadd(SECOND, {77 // seconds * seconds}, timestamp_ntz'2018-02-14 00:00:00')")
        state = own.filter((F.col("sensor") == "s0") & (F.col("timestamp") == at)).first()
        assert (state["flow_count"], state["median_duration"]) == (len(durations), np.median(durations))
    assert states.granularity_states(frame.limit(0)).count() == 0


@pytest.mark.parametrize("balanced", [True, False])
def test_all_horizons_in_one_pass_equal_fits_per_step(spark, balanced):
    from pyspark.ml.functions import array_to_vector

    from flowtide.operators.models import _fit, fit_multi_horizon, forecast_multi_horizon

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4, 3))
    score = x[:, -1] @ [2.0, -1.0, 0.5] + x[:, 0, 0]
    y = [[int(score[i] + rng.normal() > 0.4 * k) for k in range(2)] + [0] for i in range(600)]
    rows = spark.createDataFrame([(i, x[i].tolist(), y[i]) for i in range(600)], "i int, features array<array<double>>, targets array<int>").repartition(5)
    models = fit_multi_horizon(rows, 3, balanced)
    assert models[2] == 0.0
    flat = rows.select(array_to_vector(F.flatten("features")).alias("_vector"), "targets")
    for k in range(2):
        alone = _fit(flat.withColumn("_y", F.col("targets")[k]), "_y", balanced, 1.0, 500)
        assert np.abs(np.array(models[k].coefficients) - alone.coefficients.toArray()).max() < 1e-4
        assert abs(models[k].intercept - alone.intercept) < 1e-4
    assert len(forecast_multi_horizon(rows, models).first()["scores"]) == 3
    with pytest.raises(ValueError, match="no windows"):
        fit_multi_horizon(rows.limit(0), 3)
