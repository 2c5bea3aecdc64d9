"""Catalog part two: score evaluation, models, ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.config import MODE_THRESHOLDS, STATE_FEATURES, SWEEP_THRESHOLDS
from flowtide.functions.expressions import col
from flowtide.operators import activity as act
from flowtide.operators import evaluation as ev
from flowtide.operators import models as md
from flowtide.operators import windows as wd
from flowtide.plans import tables as t
from flowtide.plans.catalog import big, num, pick, query, rows_sql, text
from flowtide.plans.catalog_flows import S, _split_states
from flowtide.plans.flagship import forecast_flows, linear_scorer

SC = t.SCORES_SQL
GRID = [n / 10 for n in range(1, 10)]


def _values(numbers) -> str:
    return "(select unnest([" + ", ".join(f"cast({n!r} as double)" for n in numbers) + "]) as threshold)"


def metrics_sql(source: str, keys: str, threshold: str = "threshold") -> str:
    """CTEs ``cm`` (confusion and ratios), ``auc`` over ``source`` (label, score, keys...)."""
    k = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    part = f"partition by {keys}" if keys else ""
    return f"""cm as (select {k}count(*) as total, count(*) filter (label = 1) as positive, count(*) filter (label = 0) as negative, count(*) filter (label = 1 and score >= {threshold}) as tp, count(*) filter (label = 0 and score >= {threshold}) as fp,
  count(*) filter (label = 0 and score < {threshold}) as tn, count(*) filter (label = 1 and score < {threshold}) as fn, avg((score - label) * (score - label)) as brier_score from {source} {group}),
  ds as (select {k}score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as q from {source} group by {k}score),
  rs as (select *, sum(p) over (w rows between current row and unbounded following) as pge, sum(q) over (w rows between current row and unbounded following) as qge, sum(p) over w2 as pt, sum(q) over w2 as qt from ds window w as ({part} order by score), w2 as ({part})),
  auc as (select {k}sum(q * (pge - p + p / 2.0)) / nullif(max(pt * qt), 0)::double as roc_auc, case when max(pt * qt) > 0 then sum(p * pge / (pge + qge)) / max(pt)::double end as pr_auc from rs {group}),
  met as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as "precision", coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, fp / nullif(fp + tn, 0) as false_positive_rate, (tp + tn) / total as accuracy from cm)"""


_M_BIG = ["total", "positive", "negative", "tp", "fp", "tn", "fn"]
_M_NUM = ["precision", "recall", "f1", "false_positive_rate", "accuracy", "brier_score", "roc_auc", "pr_auc"]


@query("i6_binary_metrics", f"with {SC}, {metrics_sql('scores', 'split', '0.5')} select split, {rows_sql(_M_BIG, _M_NUM)} from met join auc using (split)")
def _(spark, d):
    return pick(ev.binary_metrics(t.scores(spark, d), 0.5, ["split"]), ["split"], _M_BIG, _M_NUM)


@query("i16_metrics_by_step", f"with {SC}, th as (select *, 0.3 + step / 10.0 as threshold from scores), {metrics_sql('th', 'step')} select cast(step as bigint) as step, {rows_sql(_M_BIG, _M_NUM)} from met join auc using (step)")
def _(spark, d):
    return pick(ev.metrics_by_step(t.scores(spark, d), [0.3 + s / 10 for s in range(1, 6)]), [], ["step", *_M_BIG], _M_NUM)


@query("c10_cross_thresholds", f"with {SC} select split, threshold, count(*) as pairs, count(*) filter (score >= threshold) as warnings from scores cross join {_values(GRID)} group by all")
def _(spark, d):
    rows = ev.cross_thresholds(t.scores(spark, d), GRID)
    return rows.groupBy("split", "threshold").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("warning").alias("warnings"))


def sweep_sql(grid) -> str:
    return f"""{SC}, raw_cm as (select threshold, count(*) filter (label = 1 and score >= threshold) as tp, count(*) filter (label = 0 and score >= threshold) as fp, count(*) filter (label = 0 and score < threshold) as tn,
  count(*) filter (label = 1 and score < threshold) as fn, count(*) as n from scores cross join {_values(grid)} group by 1),
  sw as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as "precision", coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, fp / nullif(fp + tn, 0) as false_positive_rate,
  tp + fp as alert_count, (tp + fp) / n as positive_prediction_rate, (tn + fn) / n as negative_prediction_rate, (tp + fp) * 60.0 / (n * 10) as alerts_per_minute, coalesce(fp / nullif(tp + fp, 0), 0) as false_alert_proportion, coalesce(fn / nullif(fn + tp, 0), 0) as missed_positive_proportion from raw_cm)"""


_T_NUM = ["threshold", "precision", "recall", "f1", "false_positive_rate"]
_SW_NUM = _T_NUM + ["positive_prediction_rate", "negative_prediction_rate", "alerts_per_minute", "false_alert_proportion", "missed_positive_proportion"]


@query("i7_threshold_table", f"with {sweep_sql(GRID)} select {rows_sql(['tp', 'fp', 'tn', 'fn'], _T_NUM)} from sw")
def _(spark, d):
    return pick(ev.threshold_table(t.scores(spark, d), GRID), [], ["tp", "fp", "tn", "fn"], _T_NUM)


@query("i8_threshold_sweep", f"with {sweep_sql(SWEEP_THRESHOLDS)} select {rows_sql(['tp', 'fp', 'tn', 'fn', 'alert_count'], _SW_NUM)} from sw")
def _(spark, d):
    return pick(ev.threshold_sweep(t.scores(spark, d)), [], ["tp", "fp", "tn", "fn", "alert_count"], _SW_NUM)


@query("f4_select_threshold", f"with {sweep_sql(GRID)} select {rows_sql(nums=_T_NUM)} from sw order by f1 desc, recall desc, threshold limit 1")
def _(spark, d):
    return pick(ev.select_threshold(ev.threshold_table(t.scores(spark, d), GRID)), nums=_T_NUM)


@query("f5_select_modes", f"""with {sweep_sql(SWEEP_THRESHOLDS)}, se as (select 'sensitive' as mode, * from sw where false_positive_rate <= 0.25 order by recall desc, threshold limit 1),
  b1 as (select 'balanced' as mode, * from sw where false_positive_rate <= 0.10 and recall > 0 order by abs("precision" - recall), "precision" desc, threshold limit 1),
  b2 as (select 'balanced' as mode, * from sw where recall > 0 order by abs("precision" - recall), "precision" desc, threshold limit 1),
  co as (select 'conservative' as mode, * from sw where recall > 0 order by false_positive_rate, "precision" desc, threshold desc limit 1),
  u as (select * from se union all select * from b1 union all select * from b2 where not exists (select 1 from b1) union all select * from co) select mode, {rows_sql(['alert_count'], _T_NUM)} from u""")
def _(spark, d):
    return pick(ev.select_modes(ev.threshold_sweep(t.scores(spark, d))), ["mode"], ["alert_count"], _T_NUM)


# Runs to choose from: one per (doc_id mod 4) share of the scores.
_RUNS = f"{SC}, part as (select *, 'L' || (doc_id % 4) as run from scores), {metrics_sql('part', 'run', '0.4')}"


def _runs(spark, d):
    rows = t.scores(spark, d).withColumn("run", F.expr("'L' || (doc_id % 4)"))
    return ev.binary_metrics(rows, 0.4, ["run"])


@query("f6_choose_class_weight", f"with {_RUNS} select run, round(pr_auc, 6) as pr_auc, round(f1, 6) as f1 from met join auc using (run) order by coalesce(pr_auc, -1) desc, f1 desc, run <> 'L0' limit 1")
def _(spark, d):
    runs = _runs(spark, d).withColumn("class_weight", F.when(F.col("run") != "L0", F.col("run")))
    return pick(ev.choose_class_weight(runs), ["run"], nums=["pr_auc", "f1"])


@query("f7_dominant_run", f"""with {_RUNS}, r as (select run, f1, pr_auc, recall, false_positive_rate as fpr from met join auc using (run)), c as (select a.run from r a where a.pr_auc is not null and
  not exists (select 1 from r b where b.f1 > a.f1 or b.pr_auc > a.pr_auc or b.recall > a.recall or b.fpr < a.fpr) and exists (select 1 from r b where a.f1 > b.f1 or a.pr_auc > b.pr_auc or a.recall > b.recall or a.fpr < b.fpr))
  select case when count(*) = 1 then max(run) else 'NO CLEAR WINNER' end as recommendation from c""")
def _(spark, d):
    return ev.dominant_run(_runs(spark, d))


_EDGES = "[" + ", ".join(repr(e) for e in ev.BIN_EDGES[:-1]) + "]"
_BIN = f"(len(list_filter({_EDGES}::double[], lambda e: e <= score)) - 1)"


@query("i6_class_report", f"""with {SC}, m as (select split, count(*) filter (score >= 0.5 and label = 1) as tp, count(*) filter (score >= 0.5 and label = 0) as fp, count(*) filter (score < 0.5 and label = 0) as tn, count(*) filter (score < 0.5 and label = 1) as fn from scores group by 1),
  c as (select split, '0' as class, coalesce(tn / nullif(tn + fn, 0), 0) as p, coalesce(tn / nullif(tn + fp, 0), 0) as r, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) as f, tn + fp as s from m
    union all select split, '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn from m),
  rep as (select * from c union all select split, 'macro', avg(p), avg(r), avg(f), sum(s) from c group by 1 union all select split, 'weighted', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) from c group by 1)
  select split, class, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, cast(s as bigint) as support from rep""")
def _(spark, d):
    return pick(ev.class_report(t.scores(spark, d), 0.5, ["split"]), ["split", "class"], ["support"], ["precision", "recall", "f1"])


@query("i9_score_summary", f"""with {SC}, s as (select 'all' as scope, * from scores union all select case label when 1 then 'positive' else 'negative' end, * from scores) select scope, count(*) as "count", round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std,
  {', '.join(f'round(quantile_cont(score, {q}), 6) as {n}' for n, q in ev.SUMMARY_QUANTILES.items())}, {', '.join(f'count(*) filter ({_BIN} = {i}) as bin_{i}' for i in range(10))} from s group by 1""")
def _(spark, d):
    return pick(ev.score_summary(t.scores(spark, d)), ["scope"], ["count", *[f"bin_{i}" for i in range(10)]], ["mean", "std", *ev.SUMMARY_QUANTILES])


@query("i10_calibration_bins", f"""with {SC}, b as (select unnest(range(10)) as bin), f as (select split, cast({_BIN} as bigint) as bin, count(*) as n, avg(score) as s, avg(label) as r from scores group by 1, 2), k as (select distinct split from scores)
  select k.split, cast(b.bin as bigint) as bin, coalesce(n, 0) as "count", round(s, 6) as mean_score, round(r, 6) as observed_positive_rate, round(abs(s - r), 6) as absolute_gap from k cross join b left join f on f.split = k.split and f.bin = b.bin""")
def _(spark, d):
    return pick(ev.calibration_bins(t.scores(spark, d), ["split"]), ["split"], ["bin", "count"], ["mean_score", "observed_positive_rate", "absolute_gap"])


@query("i11_compare_splits", f"""with {SC}, f as (select split, {_BIN} as bin, count(*) as n, sum(score) as s, sum(label) as r from scores group by 1, 2), e as (select split, sum(abs(s - r)) / sum(n) as expected_calibration_error, max(abs(s - r) / n) as largest_gap from f group by 1),
  g as (select split, avg((score - label) * (score - label)) as brier_score from scores group by 1), s as (select 'all' as scope, * from scores union all select case label when 1 then 'positive' else 'negative' end, * from scores)
  select split, scope, count(*) as "count", round(avg(score), 6) as mean, round(quantile_cont(score, 0.9), 6) as q90, round(any_value(expected_calibration_error), 6) as expected_calibration_error, round(any_value(brier_score), 6) as brier_score, round(any_value(largest_gap), 6) as largest_gap from s join e using (split) join g using (split) group by 1, 2""")
def _(spark, d):
    rows = ev.compare_splits(t.scores(spark, d)).withColumn("largest_gap", F.array_max(F.col("calibration_bins")["absolute_gap"]))
    return pick(rows, ["split", "scope"], ["count"], ["mean", "q90", "expected_calibration_error", "brier_score", "largest_gap"])


@query("i3_balanced_weights", f"with {SC} select cast(label as bigint) as label, count(*) as class_rows, round((select count(*) from scores) / (2.0 * count(*)), 6) as weight from scores group by 1")
def _(spark, d):
    return pick(ev.balanced_weights(t.scores(spark, d)), [], ["label", "class_rows"], ["weight"])


_LEADS = ", ".join(f"lead(binary_attack_state, {k}) over w as y{k}" for k in range(1, 6))


@query("i3_positive_weights", f"""with {S}, q as (select row_number() over w as n, {_LEADS} from states where split = 'train' window w as (partition by capture_day order by "timestamp")), u as (unpivot (select * from q where n >= 10 and y5 is not null) on y1, y2, y3, y4, y5 into name step_name value y)
  select cast(substr(step_name, 2) as bigint) as step, count(*) filter (y = 1) as positive, count(*) filter (y = 0) as negative, round(count(*) filter (y = 0) / count(*) filter (y = 1), 6) as positive_weight from u group by 1""")
def _(spark, d):
    made = wd.build_multistep(_split_states(spark, d).filter("split = 'train'"))
    return pick(ev.positive_weights(made), [], ["step", "positive", "negative"], ["positive_weight"])


@query("h4_policy_decisions", f"with {SC} select 'balanced' as mode, 0.19::double as threshold, case when score >= 0.19 then 'warning' else 'no_warning' end as state, case when score >= 0.19 then 'Predictive warning' else 'No predictive warning' end as label_text, count(*) as row_count from scores group by all")
def _(spark, d):
    rows = act.policy_decisions(t.scores(spark, d), "balanced")
    return rows.groupBy("mode", "threshold", "state", "label_text").agg(F.count(F.lit(1)).alias("row_count"))


_TRAJ = "tr as (select doc_id, cast((doc_id*7919) % 1000 as double)/1000 as s1, cast((doc_id*104729) % 1000 as double)/1000 as s2, cast((doc_id*31) % 1000 as double)/1000 as s3 from labels)"


def _trajectories(spark, d):
    return t.table(spark, d, "labels").selectExpr("doc_id", "array(cast((doc_id*7919) % 1000 as double)/1000, cast((doc_id*104729) % 1000 as double)/1000, cast((doc_id*31) % 1000 as double)/1000) as scores")


@query("i15_trajectory_summary", f"""with {_TRAJ}, q as (select (s2 - s1 > 1e-9 or s3 - s2 > 1e-9) as up, (s2 - s1 < -1e-9 or s3 - s2 < -1e-9) as down, greatest(abs(s2 - s1), abs(s3 - s2)) >= 0.25 as jump from tr)
  select count(*) as sample_count, count(*) filter (up and not down) as increasing_count, count(*) filter (down and not up) as decreasing_count, count(*) filter (up and down) as oscillating_count, count(*) filter (jump) as unstable_count, round(count(*) filter (jump) / count(*), 6) as unstable_rate from q""")
def _(spark, d):
    summary = ev.trajectory_summary(_trajectories(spark, d), horizon=3)
    return pick(summary, [], ["sample_count", "increasing_count", "decreasing_count", "oscillating_count", "unstable_count"], ["unstable_rate"])


@query("i15_trajectory_steps", f"""with {_TRAJ} select 1::bigint as step, round(avg(s1), 6) as mean_score, round(median(s1), 6) as median_score, round(avg(abs(s2 - s1)), 6) as mean_absolute_change from tr
  union all select 2, round(avg(s2), 6), round(median(s2), 6), round(avg(abs(s3 - s2)), 6) from tr union all select 3, round(avg(s3), 6), round(median(s3), 6), null from tr""")
def _(spark, d):
    return pick(ev.trajectory_steps(_trajectories(spark, d)), [], ["step"], ["mean_score", "median_score", "mean_absolute_change"])


@query("e9_error_cases", f"""with {SC}, c as (select *, case when label = 1 and score >= 0.5 then 'true_positive' when label = 0 and score >= 0.5 then 'false_positive' when label = 1 then 'false_negative' else 'true_negative' end as category from scores),
  r as (select *, row_number() over (partition by category order by case when category = 'true_negative' then score else -score end, doc_id) as n from c) select category, doc_id, round(score, 6) as score from r where n = 1""")
def _(spark, d):
    return pick(ev.error_cases(t.scores(spark, d), 0.5, order="doc_id"), ["category"], ["doc_id"], ["score"])


# --- scaling and models --------------------------------------------------


@query("i1_fit_apply_scaler", f"""with {S}, f as (select avg(flow_count) as m, case when stddev_pop(flow_count) = 0 then 1 else stddev_pop(flow_count) end as s, avg(mean_iat) as m2, stddev_pop(mean_iat) as s2, count(*) as n from states where split = 'train' and future_target_available)
  select split, any_value(n) as fit_row_count, round(avg((flow_count - m) / s), 5) as flow_count_mean, round(max((flow_count - m) / s), 5) as flow_count_max, round(avg((mean_iat - m2) / s2), 5) as mean_iat_mean from states cross join f group by 1""")
def _(spark, d):
    rows = _split_states(spark, d, durable=True)
    scaler = md.fit_scaler(rows.filter("split = 'train'"))
    scaled = md.apply_scaler(rows.withColumn("flow_count", F.col("flow_count").cast("double")), scaler)
    facts = scaled.groupBy("split").agg(num(F.avg("flow_count"), 5).alias("flow_count_mean"), num(F.max("flow_count"), 5).alias("flow_count_max"), num(F.avg("mean_iat"), 5).alias("mean_iat_mean"))
    return facts.join(F.broadcast(scaler.select("fit_row_count")), F.lit(True))


@query("i2_logistic_baseline")
def _(spark, d):
    rows = _split_states(spark, d, durable=True)
    scaler = md.fit_scaler(rows.filter("split = 'train'"))
    scaled = md.apply_scaler(rows.withColumn("flow_count", F.col("flow_count").cast("double")), scaler)
    model = md.fit_logistic(scaled.filter("split = 'train'"), balanced=True, iterations=30)
    scored = md.predict_logistic(scaled.filter("future_target_available"), model).withColumn("label", F.col("future_attack_state"))
    return pick(ev.binary_metrics(scored, 0.5, ["split"]), ["split"], _M_BIG, _M_NUM)


@query("i4_multi_horizon")
def _(spark, d):
    rows = _split_states(spark, d, durable=True)
    scaler = md.fit_scaler(rows.filter("split = 'train'"))
    made = wd.build_multistep(md.apply_scaler(rows.withColumns({f: F.col(f).cast("double") for f in STATE_FEATURES}), scaler))
    models = md.fit_multi_horizon(made.filter("split = 'train'"))
    scored = md.forecast_rows(md.forecast_multi_horizon(made, models), 0.5)
    return pick(ev.binary_metrics(scored, 0.5, ["split", "step"]), ["split"], ["step", *_M_BIG], _M_NUM)


_SCORED = f"""{S}, q as (select split, capture_day, "timestamp" as origin, flow_count, rst_flow_ratio, unique_destination_port_count as ports, row_number() over w as n, {_LEADS} from states window w as (partition by capture_day order by "timestamp")),
  zz as (select *, 0.02*flow_count + 1.5*rst_flow_ratio + 0.1*ports as z from q where n >= 10 and y5 is not null)"""


def _scored(spark, d):
    return md.score_windows(wd.build_multistep(_split_states(spark, d)), linear_scorer())


@query("i5_score_windows", f"with {_SCORED} select split, cast(origin as varchar) as origin, " + ", ".join(f"round(1/(1+exp(-(z - {b}))), 6) as score_{i}" for i, b in ((1, 2.0), (5, 2.8))) + " from zz")
def _(spark, d):
    return pick(_scored(spark, d), ["split", "origin"], score_1=num(F.col("scores")[0]), score_5=num(F.col("scores")[4]))


@query("i12_ablation")
def _(spark, d):
    made = wd.build_multistep(_split_states(spark, d, durable=True)).filter("split = 'validation'").withColumn("label", F.col("targets")[0])
    return pick(md.ablation(md.ablation_scores(made, linear_scorer()), 0.19), ["kind", "name"], ["sample_count"], ["mean_signed_score_change", "mean_absolute_score_change", "delta_f1", "delta_recall"])


_CELLS = f"""{_SCORED}, vs as (select capture_day, origin, z, 1/(1+exp(-(z - 2.0))) as s0, flow_count, rst_flow_ratio, ports from zz where split = 'validation'),
  cells as (select capture_day, origin, 'flow_count' as feature, s0 - 1/(1+exp(-(z - 0.02*flow_count - 2.0))) as c from vs union all select capture_day, origin, 'rst_flow_ratio', s0 - 1/(1+exp(-(z - 1.5*rst_flow_ratio - 2.0))) from vs
  union all select capture_day, origin, 'unique_destination_port_count', s0 - 1/(1+exp(-(z - 0.1*ports - 2.0))) from vs)"""


def _cells(spark, d):
    made = wd.build_multistep(_split_states(spark, d, durable=True)).filter("split = 'validation'")
    return md.contributions(made, linear_scorer(), ["capture_day", "origin"])


@query("i13_contributions", f"""with {_CELLS}, names as (select unnest([{", ".join(f"'{f}'" for f in STATE_FEATURES)}]) as feature), w as (select count(*) as windows from vs)
  select feature, any_value(windows) * 10 as cells, round(coalesce(sum(c), 0), 4) + 0.0 as total, round(coalesce(sum(abs(c)), 0), 4) + 0.0 as sensitivity from names left join cells using (feature) cross join w group by 1""")
def _(spark, d):
    rows = _cells(spark, d).groupBy("feature").agg(F.count(F.lit(1)).alias("cells"), num(F.sum("contribution"), 4).alias("total"), num(F.sum("sensitivity"), 4).alias("sensitivity"))
    return rows


@query("f2_top_contributions", f"with {_CELLS}, r as (select *, row_number() over (partition by capture_day, origin order by abs(c) desc, feature) as n from cells where abs(c) > 1e-9) select n as rank, count(*) as windows, round(sum(abs(c)), 4) as total from r where n <= 2 group by 1")
def _(spark, d):
    rows = md.top_contributions(_cells(spark, d), ["capture_day", "origin"], 2).filter(F.col("sensitivity") > 1e-9)
    return rows.groupBy(big("rank").alias("rank")).agg(F.count(F.lit(1)).alias("windows"), num(F.sum("sensitivity"), 4).alias("total"))


@query("i14_temporal_summary", f"""with {_CELLS}, a as (select origin, sum(c) as c, sum(abs(c)) as m from cells group by 1), p as (select unnest(range(10)) as i)
  select cast(origin as varchar) as origin, cast(i as bigint) as position_index, round(case i when 9 then c else 0 end, 6) + 0.0 as signed_contribution, round(case i when 9 then m else 0 end / 17, 6) + 0.0 as sensitivity from a cross join p""")
def _(spark, d):
    rows = md.temporal_summary(_cells(spark, d), ["capture_day", "origin"])
    return pick(rows, ["origin"], ["position_index"], ["signed_contribution", "sensitivity"])


_FIXED = [0.0001 * (i + 1) for i in range(len(STATE_FEATURES))]
_HEADS = [md.Head(tuple((at + 1) / 10 * w for at in range(10) for w in _FIXED), -1.0 - 0.2 * step) for step in range(1, 6)]


@query("i4_forecast_multi_horizon", f"""with {S}, v as (select split, capture_day, "timestamp" as origin, {" + ".join(f"{w!r} * {f}" for w, f in zip(_FIXED, STATE_FEATURES, strict=True))} as v, row_number() over w as n, {_LEADS} from states window w as (partition by capture_day order by "timestamp")),
  q as (select *, v + {" + ".join(f"{(10 - i) / 10} * lag(v, {i}) over w" for i in range(1, 10))} as z from v window w as (partition by capture_day order by origin)), st as (select unnest([1,2,3,4,5]) as step),
  f as (select split, origin, step, 1/(1+exp(-(z - 1.0 - 0.2*step))) as score, case step when 1 then y1 when 2 then y2 when 3 then y3 when 4 then y4 else y5 end as label from q cross join st where n >= 10 and y5 is not null)
  select split, cast(origin as varchar) as origin, cast(step as bigint) as step, cast(label as bigint) as label, round(score, 6) as score from f""")
def _(spark, d):
    scored = md.forecast_multi_horizon(wd.build_multistep(_split_states(spark, d)), _HEADS)
    return pick(md.forecast_rows(scored, 0.5), ["split", "origin"], ["step", "label"], ["score"])


@query("e9_window_cases", f"""with {S}, q as (select split, "timestamp" as origin, concat_ws('|', cast(lag(flow_count, 2) over w as bigint), cast(lag(flow_count, 1) over w as bigint), cast(flow_count as bigint)) as recent,
    1/(1+exp(-(0.02*flow_count + 1.5*rst_flow_ratio + 0.1*unique_destination_port_count - 2.0))) as score, row_number() over w as n, {_LEADS} from states window w as (partition by capture_day order by "timestamp")),
  c as (select *, case when y1 = 1 and score >= 0.19 then 'true_positive' when y1 = 0 and score >= 0.19 then 'false_positive' when y1 = 1 then 'false_negative' else 'true_negative' end as category from q where n >= 10 and y5 is not null),
  r as (select *, row_number() over (partition by category order by case when category = 'true_negative' then score else -score end, origin) as rank from c)
  select category, split, cast(origin as varchar) as origin, recent, cast(y1 as bigint) as label, round(score, 6) as score from r where rank = 1""")
def _(spark, d):
    scored = _scored(spark, d).select("split", "origin", "features", F.col("targets")[0].alias("label"), F.col("scores")[0].alias("score"))
    at = STATE_FEATURES.index("flow_count")
    recent = F.concat_ws("|", F.transform("recent", lambda s: s[at].cast("bigint").cast("string")))
    return pick(ev.error_cases(scored, 0.19).withColumn("recent", recent), ["category", "split", "origin", "recent"], ["label"], ["score"])


@query("i17_context_length_comparison", f"""with {_SCORED.replace('n >= 10 and', '')}, l as (select unnest([5, 10, 20]) as context_length), st as (select unnest([1,2,3,4,5]) as step),
  w as (select context_length, step, split, case step when 1 then y1 when 2 then y2 when 3 then y3 when 4 then y4 else y5 end as label, 1/(1+exp(-(z - 1.8 - 0.2*step))) as score from zz join l on n >= context_length cross join st), {metrics_sql('w', 'context_length, step', '0.3')}
  select cast(context_length as bigint) as context_length, cast(step as bigint) as step, {rows_sql(_M_BIG, ['recall', 'f1'])} from met""")
def _(spark, d):
    made = md.context_length_comparison(_split_states(spark, d, durable=True), {n: linear_scorer(n) for n in (5, 10, 20)}, threshold=0.3)
    return pick(made, [], ["context_length", "step", *_M_BIG], ["recall", "f1"])


@query("k15_forecast", f"with {_SCORED}, st as (select unnest([1,2,3,4,5]) as step) select cast(step as bigint) as step, count(*) as forecasts, count(*) filter (1/(1+exp(-(z - 1.8 - 0.2*step))) >= 0.19) as warnings, round(avg(1/(1+exp(-(z - 1.8 - 0.2*step)))), 6) as mean_score from zz cross join st group by 1")
def _(spark, d):
    rows = forecast_flows(t.flows(spark, d), linear_scorer())
    return rows.groupBy(big("step").alias("step")).agg(F.count(F.lit(1)).alias("forecasts"), F.count_if("warning").alias("warnings"), num(F.avg("score")).alias("mean_score"))
