"""Headers of exports and logs."""

import pytest
from pyspark.sql import functions as F

from flowtide.operators.cleaning import join_features_sidecar
from flowtide.operators.evaluation import binary_metrics, class_report
from flowtide.sources.readers import read_flow_csv, read_zeek_tsv
from flowtide.sources.writers import append_days, write_clean_flow, write_model_features
from flowtide.streaming.serving import serve_latest, served


def test_every_file_needs_the_same_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Dst Port, Label\n80,Benign\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("Dst Port, Label\n443,Bot\n")
    rows = read_flow_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["Dst Port"], r["Label"], r["source_row_number"]) for r in rows.collect()) == [("443", "Bot", 1), ("80", "Benign", 1)]
    (tmp_path / "c.csv").write_text("Label,Dst Port\nBot,443\n")
    with pytest.raises(Exception, match="header"):
        read_flow_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "c.csv")]).collect()


def test_log_lines_follow_the_header_before_them(spark, tmp_path):
    wide = "\t".join(["ts", "uid", *(f"x{i}" for i in range(1200))])
    (tmp_path / "conn.log").write_text("orphan\n#fields\tts\tuid\n1\tA\n#fields\tuid\tts\nB\t2\nbad\n" + f"#fields\t{wide}\n" + "\t".join(["3", "C", *["-"] * 1200]) + "\n")
    rows, rejected = read_zeek_tsv(spark, str(tmp_path / "conn.log"))
    assert sorted((r["ts"], r["uid"]) for r in rows.collect()) == [("1", "A"), ("2", "B"), ("3", "C")]
    assert sorted((r["raw_line"], r["reason"]) for r in rejected.collect()) == [("bad", "field count differs from #fields"), ("orphan", "missing #fields header")]


def test_one_join_gives_all_sides(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, l string"), spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "k int, r string")
    joined, alone = join_features_sidecar(left, right, ["k"])
    assert joined.collect() == [(2, "b", "c")]
    assert sorted((r["k"] or 0, r["reason"]) for r in alone.collect()) == [(0, "features_only"), (0, "sidecar_only"), (1, "features_only"), (3, "sidecar_only")]


def test_invalid_scores_do_not_count(spark):
    scores = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, float("nan")), (1, 1.5), (None, 0.7), (2, 0.7), (1, None)], "label int, score double")
    row = binary_metrics(scores, 0.5).first()
    assert (row["total"], row["tp"], row["fp"], row["tn"], row["fn"]) == (2, 1, 0, 1, 0)
    assert {r["class"]: (r["f1"], r["support"]) for r in class_report(scores, 0.5).collect()} == {"0": (1.0, 1), "1": (1.0, 1), "macro": (1.0, 2), "weighted": (1.0, 2)}


def test_model_table_is_finite_and_carries_its_origin(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "`Flow Duration` double, `Tot Fwd Pkts` double")
    write_model_features(rows, str(tmp_path / "ok"), provenance={"source": "x"})
    write_clean_flow(rows, str(tmp_path / "clean"), {"source": "y"})
    assert spark.read.parquet(str(tmp_path / "ok")).schema[0].metadata == {"provenance": {"source": "x"}}
    assert spark.read.parquet(str(tmp_path / "clean")).schema[0].metadata == {"provenance": {"source": "y"}}
    bad = spark.createDataFrame([(float("inf"), 2.0)], rows.schema)
    with pytest.raises(Exception, match="non-finite"):
        write_model_features(bad, str(tmp_path / "bad"))


def test_a_day_loaded_again_replaces_itself_and_another_header_is_refused(spark, tmp_path):
    path = str(tmp_path / "days")
    day = lambda date, *packets: spark.createDataFrame([(p, "Benign", date) for p in packets], "packets int, Label string, capture_date string")
    stored = lambda: sorted((str(r["capture_date"]), r["packets"]) for r in spark.read.parquet(path).collect())
    append_days(day("2018-02-14", 1, 2), path)
    append_days(day("2018-02-15", 3), path)
    both = [("2018-02-14", 1.0), ("2018-02-14", 2.0), ("2018-02-15", 3.0)]
    assert stored() == both
    append_days(day("2018-02-15", 3), path)
    append_days(day("2018-02-16").limit(0), path)
    assert stored() == both
    append_days(day("2018-02-14", 7).union(day("2018-02-16", 8)), path)
    changed = [("2018-02-14", 7.0), ("2018-02-15", 3.0), ("2018-02-16", 8.0)]
    assert stored() == changed
    for other in (day("2018-02-17", 1).withColumn("more", F.lit(1)), day("2018-02-17", 1).drop("Label"), day("2018-02-17", 1).select("Label", "packets", "capture_date"), day("2018-02-17", 1).withColumn("packets", F.lit("x"))):
        with pytest.raises(ValueError, match="stored table"):
            append_days(other, path)
    assert stored() == changed


def test_served_rows_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    batches = [[("a", 5, 1.0), ("b", 1, 2.0), (None, 2, 0.0)], [("a", 3, 9.0), ("b", 4, 3.0)], [("a", 5, 2.0), ("c", None, 1.0)], [("b", 4, 3.0), (None, None, 5.0)]]
    schema, want = "sensor string, at int, score double", {("a", 5, 2.0), ("b", 4, 3.0), ("c", None, 1.0), (None, 2, 0.0)}
    for name, order in (("up", (0, 1, 2, 3)), ("down", (3, 2, 1, 0)), ("again", (1, 0, 1, 3, 2, 0))):
        source, folder, marks = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "offsets"))
        assert served(spark, folder, schema).count() == 0
        for k in order:
            spark.createDataFrame(batches[k], schema).write.mode("append").parquet(source)
            serve_latest(spark.readStream.schema(schema).parquet(source), ["sensor"], ["at"], folder, marks).awaitTermination()
        assert {tuple(r) for r in served(spark, folder, schema).collect()} == want and served(spark, folder, schema).count() == 4
    # Without its offsets the stream reads everything again under epochs that are there already.
    serve_latest(spark.readStream.schema(schema).parquet(source), ["sensor"], ["at"], folder, str(tmp_path / "new-offsets")).awaitTermination()
    assert {tuple(r) for r in served(spark, folder, schema).collect()} == want
