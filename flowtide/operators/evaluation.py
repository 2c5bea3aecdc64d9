"""Exact score evaluation.

Scores shrink to distinct (score, positives, negatives) rows before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.config import SWEEP_THRESHOLDS
from flowtide.functions.expressions import col
from flowtide.functions.ordered import group_quantiles, prefix
from flowtide.operators.cleaning import split_valid

# Ten equal bins as binary doubles; the last bin is closed.
BIN_EDGES = [i * 0.1 for i in range(10)] + [1.0]
SUMMARY_QUANTILES = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q100": 1.0}


def validate_scores(scores: DataFrame, label: str = "label", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Labels 0 or 1, scores finite in [0, 1]."""
    s = col(score).cast("double")
    return split_valid(
        scores,
        [
            ("label_not_binary", col(label).isNull() | ~col(label).isin(0, 1)),
            ("score_not_in_range", s.isNull() | F.isnan(s) | (s < 0) | (s > 1)),
        ],
    )


def score_counts(scores: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score; rows that ``validate_scores`` rejects are left out.

    A NaN compares above every threshold and would count as a warning.
    """
    scores, _ = validate_scores(scores, label, score)
    return scores.groupBy(*[col(k) for k in keys], col(score).cast("double").alias("score")).agg(
        F.count_if(col(label) == 1).alias("pos"), F.count_if(col(label) == 0).alias("neg")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _derived(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": F.try_divide(fp.cast("double"), (fp + tn).cast("double")),
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
    }


def binary_metrics(
    scores: DataFrame, threshold: float | Column = 0.5, keys: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """Support, confusion, threshold and ranking metrics per key.

    ROC-AUC counts ties as half, PR-AUC is average precision by distinct score; both are
    null when a class is absent.
    """
    keys = list(keys)
    key_columns = [col(k) for k in keys]
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    s = F.col("score")
    # The last level grows finer towards 0 and 1, where confident scorers crowd their values.
    crowded = F.when(s < 0.5, F.coalesce(F.floor(F.log2(s) * 64), F.lit(-1_000_000))).otherwise(
        F.coalesce(-F.floor(F.log2(1 - s) * 64), F.lit(1_000_000))
    )
    counts = score_counts(scores, keys, label, score).withColumns(
        {"_l1": F.floor(s * 1024).cast("bigint"), "_l2": F.floor(s * 1_048_576).cast("bigint"), "_l3": crowded.cast("bigint")}
    )
    below = prefix(counts, keys, ["_l1", "_l2", "_l3"], [F.col("score")], {"_pos_below": ("sum", "pos"), "_neg_below": ("sum", "neg")})
    totals = counts.groupBy(*key_columns).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    if keys:
        joined = below.join(totals, keys)
    else:
        joined = below.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one")
    above_pos = F.col("_p") - F.col("_pos_below") - F.col("pos")
    from_pos = F.col("_p") - F.col("_pos_below")
    from_neg = F.col("_q") - F.col("_neg_below")
    hit = F.col("score") >= cut
    facts = joined.groupBy(*key_columns).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("total"),
        F.sum("pos").alias("positive"),
        F.sum("neg").alias("negative"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit, F.col("neg"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("fn"),
        F.sum(F.col("pos") * F.pow(F.col("score") - 1, F.lit(2)) + F.col("neg") * F.pow(F.col("score"), F.lit(2))).alias("_squares"),
        F.sum(F.col("neg") * (above_pos + F.col("pos") * 0.5)).alias("_wins"),
        F.sum(F.col("pos") * from_pos / (from_pos + from_neg)).alias("_precision_sum"),
    )
    both = (F.col("positive") > 0) & (F.col("negative") > 0)
    return facts.withColumns(_derived(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))).withColumns(
        {
            "brier_score": F.col("_squares") / F.col("total"),
            "roc_auc": F.when(both, F.col("_wins") / (F.col("positive").cast("double") * F.col("negative"))),
            "pr_auc": F.when(both, F.col("_precision_sum") / F.col("positive")),
        }
    ).drop("_squares", "_wins", "_precision_sum")


def metrics_by_step(scores: DataFrame, thresholds: float | Sequence[float] = 0.5, horizon: int = 5) -> DataFrame:
    """``binary_metrics`` per forecast step, each with its own threshold (I16)."""
    if isinstance(thresholds, (int, float)):
        return binary_metrics(scores, float(thresholds), ["step"])
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    return binary_metrics(scores, F.element_at(values, F.col("step").cast("int")), ["step"])


def class_report(
    scores: DataFrame, threshold: float | Column = 0.5, keys: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """Precision, recall, F1 and support per class with their macro and weighted averages.

    ``class`` is ``0``, ``1``, ``macro`` or ``weighted``.
    """
    keys = list(keys)
    key_columns = [col(k) for k in keys]
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos, neg = F.col("score") >= cut, F.col("pos"), F.col("neg")
    total = lambda test, what: F.coalesce(F.sum(F.when(test, what)), F.lit(0))
    facts = score_counts(scores, keys, label, score).groupBy(*key_columns).agg(
        total(hit, pos).alias("tp"), total(hit, neg).alias("fp"), total(~hit, neg).alias("tn"), total(~hit, pos).alias("fn")
    )

    def one(name: str, right: Column, claimed: Column, actual: Column) -> Column:
        f1 = _ratio(2 * right, claimed + actual)
        return F.struct(F.lit(name).alias("class"), _ratio(right, claimed).alias("precision"), _ratio(right, actual).alias("recall"), f1.alias("f1"), actual.alias("support"))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    both = facts.select(*key_columns, F.array(one("0", tn, tn + fn, tn + fp), one("1", tp, tp + fp, tp + fn)).alias("_c"))

    def average(name: str, weight) -> Column:
        weights = [weight(F.col("_c")[i]) for i in (0, 1)]
        mean = lambda m: _ratio(F.col("_c")[0][m] * weights[0] + F.col("_c")[1][m] * weights[1], weights[0] + weights[1]).alias(m)
        support = F.col("_c")[0]["support"] + F.col("_c")[1]["support"]
        return F.struct(F.lit(name).alias("class"), mean("precision"), mean("recall"), mean("f1"), support.alias("support"))

    rows = F.concat("_c", F.array(average("macro", lambda c: F.lit(1.0)), average("weighted", lambda c: c["support"].cast("double"))))
    return both.select(*key_columns, F.explode(rows).alias("_r")).select(*key_columns, "_r.*")


def cross_thresholds(scores: DataFrame, thresholds: Sequence[float], score: str = "score") -> DataFrame:
    """Every score with every threshold and its inclusive decision."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    return scores.withColumn("threshold", F.explode(grid)).withColumn("warning", col(score) >= F.col("threshold"))


def confusion_by_threshold(scores: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (),
                           label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts per threshold from one pass over the scores.

    Each score falls between two thresholds; counts per gap are added up from the top, so
    no score is repeated per threshold.
    """
    keys = list(keys)
    scores, _ = validate_scores(scores, label, score)
    key_columns = [col(k) for k in keys]
    grid = sorted(float(t) for t in thresholds)
    literal = F.array(*[F.lit(t) for t in grid])
    reached = F.size(F.filter(literal, lambda t: t <= col(score).cast("double")))
    gaps = scores.groupBy(*key_columns, reached.alias("_gap")).agg(
        F.count_if(col(label) == 1).alias("_pos"), F.count_if(col(label) == 0).alias("_neg")
    )
    # One key has at most len(grid) + 1 gaps, whatever the number of scores.
    packed = gaps.groupBy(*key_columns).agg(
        F.map_from_entries(F.collect_list(F.struct("_gap", "_pos"))).alias("_mp"),
        F.map_from_entries(F.collect_list(F.struct("_gap", "_neg"))).alias("_mn"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"),
    )
    numbered = packed.select("*", F.posexplode(literal).alias("_i", "threshold"))
    total = lambda m: F.aggregate(
        F.map_entries(m), F.lit(0).cast("bigint"),
        lambda acc, e: acc + F.when(e["key"] > F.col("_i"), e["value"]).otherwise(F.lit(0)),
    )
    return numbered.withColumns({"tp": total(F.col("_mp")), "fp": total(F.col("_mn"))}).select(
        *key_columns, "threshold", "tp", "fp", (F.col("_q") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn")
    )


def threshold_table(scores: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and false-positive rate per threshold."""
    rows = confusion_by_threshold(scores, thresholds, keys)
    return rows.withColumns(_derived(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, interval_seconds: int = 10,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Operating metrics per threshold; rates count every score as one interval (I8)."""
    rows = threshold_table(scores, thresholds, keys)
    alerts, total = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return rows.withColumns(
        {
            "alert_count": alerts,
            "positive_prediction_rate": _ratio(alerts, total),
            "negative_prediction_rate": _ratio(F.col("tn") + F.col("fn"), total),
            "alerts_per_10_second_state": _ratio(alerts, total),
            "alerts_per_minute": _ratio(alerts * 60, total * interval_seconds),
            "false_alert_proportion": _ratio(F.col("fp"), alerts),
            "missed_positive_proportion": _ratio(F.col("fn"), F.col("fn") + F.col("tp")),
        }
    )


def select_threshold(table: DataFrame, keys: Sequence[str] = (), by_recall: bool = True) -> DataFrame:
    """Best F1, then best recall (baseline rule), then lowest threshold."""
    rank = [F.col("f1")] + ([F.col("recall")] if by_recall else []) + [-F.col("threshold")]
    best = F.max_by(F.struct(*[col(c) for c in table.columns if c not in keys]), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))
    return table.groupBy(*[col(k) for k in keys]).agg(best.alias("_b")).select(*[col(k) for k in keys], "_b.*")


def select_modes(sweep: DataFrame) -> DataFrame:
    """Sensitive, balanced and conservative operating points of a sweep."""
    row = F.struct(*[col(c) for c in sweep.columns])
    recall, fpr, precision, threshold = (F.col(c) for c in ("recall", "false_positive_rate", "precision", "threshold"))
    useful = recall > 0
    quiet = useful & (fpr <= 0.10)
    gap = F.struct(F.abs(precision - recall).alias("a"), (-precision).alias("b"), threshold.alias("c"))
    picks = sweep.agg(
        F.max_by(F.when(fpr <= 0.25, row), F.when(fpr <= 0.25, F.struct(recall.alias("a"), (-threshold).alias("b")))).alias("sensitive"),
        F.coalesce(
            F.min_by(F.when(quiet, row), F.when(quiet, gap)), F.min_by(F.when(useful, row), F.when(useful, gap))
        ).alias("balanced"),
        F.min_by(
            F.when(useful, row),
            F.when(useful, F.struct(fpr.alias("a"), (-precision).alias("b"), (-threshold).alias("c"))),
        ).alias("conservative"),
    )
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("point")) for m in ("sensitive", "balanced", "conservative")])
    return picks.select(F.explode(modes).alias("m")).filter(F.col("m.point").isNotNull()).select("m.mode", "m.point.*")


def choose_class_weight(runs: DataFrame) -> DataFrame:
    """Best PR-AUC (missing counts as -1), then F1, then the unweighted run."""
    return runs.orderBy(
        F.coalesce("pr_auc", F.lit(-1.0)).desc(), F.col("f1").desc(), F.col("class_weight").isNotNull()
    ).limit(1)


def dominant_run(runs: DataFrame, name: str = "run") -> DataFrame:
    """The single run that is nowhere worse and somewhere better, else no clear winner.

    Being nowhere worse means holding every best value, so extremes replace the self-join.
    """
    best = runs.agg(
        *[F.max(c).alias(f"max_{c}") for c in ("f1", "pr_auc", "recall", "false_positive_rate")],
        *[F.min(c).alias(f"min_{c}") for c in ("f1", "pr_auc", "recall", "false_positive_rate")],
    ).withColumn("_one", F.lit(1))
    joined = runs.withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one")
    holds = (F.col("false_positive_rate") <= F.col("min_false_positive_rate"))
    better = F.col("false_positive_rate") < F.col("max_false_positive_rate")
    for c in ("f1", "pr_auc", "recall"):
        holds = holds & (col(c) >= col(f"max_{c}"))
        better = better | (col(c) > col(f"min_{c}"))
    winners = joined.agg(
        F.count_if(holds & better).alias("_n"), F.max(F.when(holds & better, col(name).cast("string"))).alias("_w")
    )
    return winners.select(F.when(F.col("_n") == 1, F.col("_w")).otherwise(F.lit("NO CLEAR WINNER")).alias("recommendation"))


def _bin_index(score: Column) -> Column:
    edges = F.array(*[F.lit(e) for e in BIN_EDGES[:-1]])
    return (F.size(F.filter(edges, lambda e: e <= score)) - 1).cast("int")


def score_summary(scores: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Count, mean, population deviation, quantiles and histogram, over all scores and per class.

    ``scope`` is ``all``, ``negative`` or ``positive``.
    """
    keys = list(keys)
    scores, _ = validate_scores(scores, label, score)
    scopes = F.explode(F.array(F.lit("all"), F.when(col(label) == 1, "positive").otherwise("negative")))
    scoped = scores.select(*[col(k) for k in keys], col(score).cast("double").alias("score"), scopes.alias("scope"))
    names = keys + ["scope"]
    histogram = [F.count_if(_bin_index(F.col("score")) == i).alias(f"bin_{i}") for i in range(10)]
    facts = scoped.groupBy(*names).agg(
        F.count(F.lit(1)).alias("count"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), *histogram
    )
    return facts.join(group_quantiles(scoped, names, "score", SUMMARY_QUANTILES, 4096), names)


def calibration_bins(scores: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Ten bins with mean score, observed rate and gap; empty bins stay with count 0."""
    keys = list(keys)
    scores, _ = validate_scores(scores, label, score)
    key_columns = [col(k) for k in keys]
    value = col(score).cast("double")
    filled = scores.groupBy(*key_columns, _bin_index(value).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("s"), F.avg(col(label).cast("double")).alias("r")
    )
    packed = filled.groupBy(*key_columns).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "s", "r")))).alias("_m")
    )
    bounds = F.array(*[F.struct(F.lit(BIN_EDGES[i]).alias("lower"), F.lit(BIN_EDGES[i + 1]).alias("upper")) for i in range(10)])
    rows = packed.select(*key_columns, "_m", F.posexplode(bounds).alias("bin", "_b"))
    cell = F.try_element_at(F.col("_m"), F.col("bin"))
    return rows.select(
        *key_columns, "bin", "_b.lower", "_b.upper", F.coalesce(cell["n"], F.lit(0)).alias("count"),
        cell["s"].alias("mean_score"), cell["r"].alias("observed_positive_rate"), F.abs(cell["s"] - cell["r"]).alias("absolute_gap"),
    )


def calibration_summary(scores: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Expected calibration error and Brier score."""
    keys = list(keys)
    scores, _ = validate_scores(scores, label, score)
    value, y = col(score).cast("double"), col(label).cast("double")
    filled = scores.groupBy(*[col(k) for k in keys], _bin_index(value).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(y).alias("r"), F.sum(F.pow(value - y, F.lit(2))).alias("b")
    )
    return filled.groupBy(*[col(k) for k in keys]).agg(
        (F.sum(F.abs(F.col("s") - F.col("r"))) / F.sum("n")).alias("expected_calibration_error"),
        (F.sum("b") / F.sum("n")).alias("brier_score"),
    )


def compare_splits(scores: DataFrame, split: str = "split") -> DataFrame:
    """Score summaries of each split, over all scores and per class, with its calibration errors and bins."""
    bins = calibration_bins(scores, [split]).groupBy(col(split)).agg(
        F.sort_array(F.collect_list(F.struct("bin", "lower", "upper", "count", "mean_score", "observed_positive_rate", "absolute_gap"))).alias("calibration_bins")
    )
    return score_summary(scores, [split]).join(calibration_summary(scores, [split]).join(bins, split), split)


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (2 * class size) per class."""
    sizes = rows.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("class_rows"))
    total = F.sum("class_rows").over(W.partitionBy(F.lit(0)))
    return sizes.withColumn("weight", total / (F.lit(2.0) * F.col("class_rows")))


def positive_weights(windows: DataFrame) -> DataFrame:
    """Negatives per positive of each forecast step."""
    rows = windows.select(F.posexplode("targets").alias("_i", "y"))
    return rows.groupBy((F.col("_i") + 1).alias("step")).agg(
        F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative")
    ).withColumn("positive_weight", F.try_divide("negative", "positive"))


def trajectory_summary(scored: DataFrame, scores: str = "scores", horizon: int = 5) -> DataFrame:
    """Direction and stability of score trajectories (I15): one row of counts and rates."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon - 1)), lambda i: F.element_at(col(scores), i + 1) - F.element_at(col(scores), i))
    diffs = scored.select(steps.alias("d"))
    up = F.exists("d", lambda x: x > 1e-9)
    down = F.exists("d", lambda x: x < -1e-9)
    unstable = F.exists("d", lambda x: F.abs(x) >= 0.25)
    facts = diffs.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(up & ~down).alias("increasing_count"),
        F.count_if(down & ~up).alias("decreasing_count"),
        F.count_if(up & down).alias("oscillating_count"),
        F.count_if(unstable).alias("unstable_count"),
    )
    return facts.withColumns(
        {f"{n}_rate": F.try_divide(F.col(f"{n}_count"), F.col("sample_count")) for n in ("increasing", "decreasing", "oscillating", "unstable")}
    )


def trajectory_steps(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """Mean and median score and mean absolute change to the next step, per step."""
    rows = scored.select(F.posexplode(col(scores)).alias("_i", "score"), col(scores).alias("_all")).withColumns(
        {"step": F.col("_i") + 1, "change": F.abs(F.try_element_at("_all", F.col("_i") + 2) - F.col("score"))}
    ).select("step", "score", "change")
    means = rows.groupBy("step").agg(F.avg("score").alias("mean_score"), F.avg("change").alias("mean_absolute_change"))
    return means.join(group_quantiles(rows, ["step"], "score", {"median_score": 0.5}, 4096), "step")


def error_cases(scored: DataFrame, threshold: float, label: str = "label", score: str = "score", order: str = "origin") -> DataFrame:
    """The strongest true positive, false positive, false negative and the weakest true negative.

    Ties go to the earliest row; windows keep their last three states as ``recent``.
    """
    hit = col(score) >= threshold
    category = (
        F.when((col(label) == 1) & hit, "true_positive").when((col(label) == 0) & hit, "false_positive")
        .when(col(label) == 1, "false_negative").otherwise("true_negative")
    )
    strength = F.when(category == "true_negative", -col(score)).otherwise(col(score))
    rows = scored.withColumns({"category": category, "_strength": strength})
    best = rows.groupBy("category").agg(F.max("_strength").alias("_strength"))
    tied = rows.join(F.broadcast(best), ["category", "_strength"])
    payload = F.struct(*[col(c) for c in scored.columns])
    picked = tied.groupBy("category").agg(F.min_by(payload, col(order)).alias("_p")).select("category", "_p.*")
    if "features" in scored.columns:
        picked = picked.withColumn("recent", F.slice("features", -3, 3)).drop("features")
    return picked
