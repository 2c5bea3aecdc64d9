"""Scaling, distributed baselines, batch scoring and ablation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.config import FEATURE_GROUPS, STATE_FEATURES
from flowtide.functions.durable import cut
from flowtide.functions.expressions import col, forecast_time, relative_label, step_threshold
from flowtide.operators.evaluation import binary_metrics
from flowtide.operators.windows import build_multistep

ScoreFunction = Callable[[np.ndarray], np.ndarray]


# --- I1 ------------------------------------------------------------------


def fit_scaler(train: DataFrame, features: Sequence[str] = STATE_FEATURES) -> DataFrame:
    """One row with mean and population deviation per feature (0 becomes 1).

    Only rows with an available target take part.
    """
    rows = train.filter(F.col("future_target_available")) if "future_target_available" in train.columns else train
    wide = rows.agg(
        F.count(F.lit(1)).alias("fit_row_count"),
        *[F.avg(col(f)).alias(f"mean__{f}") for f in features],
        *[F.stddev_pop(col(f)).alias(f"scale__{f}") for f in features],
    )
    return wide.withColumns({f"scale__{f}": F.when(col(f"scale__{f}") == 0, 1.0).otherwise(col(f"scale__{f}")) for f in features})


def apply_scaler(rows: DataFrame, scaler: DataFrame, features: Sequence[str] = STATE_FEATURES) -> DataFrame:
    """Standardized features; the one-row scaler travels as a broadcast."""
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(scaler.withColumn("_one", F.lit(1))), "_one")
    scaled = {f: (col(f) - col(f"mean__{f}")) / col(f"scale__{f}") for f in features}
    return joined.withColumns(scaled).select(*[col(c) for c in rows.columns])


# --- I2, I4 --------------------------------------------------------------


def _class_weight(rows: DataFrame, label: str) -> tuple[float, float, int]:
    n, positive = rows.agg(F.count(F.lit(1)), F.count_if(col(label) == 1)).first()
    if positive in (0, n):
        raise ValueError("training rows need both classes")
    return n / (2.0 * (n - positive)), n / (2.0 * positive), n


def _fit(rows: DataFrame, label: str, balanced: bool, strength: float, iterations: int) -> LogisticRegressionModel:
    negative, positive, n = _class_weight(rows, label)
    weight = F.when(col(label) == 1, positive).otherwise(negative) if balanced else F.lit(1.0)
    model = LogisticRegression(
        featuresCol="_vector", labelCol="_label", weightCol="_weight", regParam=1.0 / (strength * n),
        standardization=False, maxIter=iterations, tol=1e-8,
    )
    return model.fit(rows.select("_vector", col(label).cast("double").alias("_label"), weight.alias("_weight")))


def fit_logistic(
    train: DataFrame, features: Sequence[str] = STATE_FEATURES, label: str = "future_attack_state", balanced: bool = False,
    strength: float = 1.0, iterations: int = 100,
) -> LogisticRegressionModel:
    """L2 logistic baseline on the rows with an available target (I2). Runs Spark jobs."""
    rows = train.filter(F.col("future_target_available")) if "future_target_available" in train.columns else train
    vectors = rows.withColumn("_vector", array_to_vector(F.array(*[col(f).cast("double") for f in features])))
    return _fit(vectors, label, balanced, strength, iterations)


def predict_logistic(rows: DataFrame, model: LogisticRegressionModel, features: Sequence[str] = STATE_FEATURES) -> DataFrame:
    vectors = rows.withColumn("_vector", array_to_vector(F.array(*[col(f).cast("double") for f in features])))
    scored = model.transform(vectors)
    return scored.withColumn("score", vector_to_array(F.col("probability"))[1]).select(*[col(c) for c in rows.columns], "score")


@dataclass(frozen=True)
class Head:
    """The logistic model of one future step."""

    coefficients: tuple[float, ...]
    intercept: float


#: Numbers of one head's sums that travel and are added up together.
_SUM_BLOCK = 4096


def _head_sums(rows: DataFrame, betas: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of all heads over all rows ``(x, y)``, in one job; a row of numbers per head.

    A task adds up its Arrow batches; the partial sums, whose size depends on features and heads only, are added up block by
    block, and the totals reach the driver.
    """
    heads, size = betas.shape
    width = 1 + size + size * size

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((heads, width)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "y"))
            x = np.column_stack([x, np.ones(len(x))])
            for k in range(heads):
                z = x @ betas[k]
                p = 0.5 * (1 + np.tanh(z / 2))
                w = np.where(y[:, k] == 1, weights[k, 1], weights[k, 0])
                sums[k, 0] += (w * (np.logaddexp(0, z) - y[:, k] * z)).sum()
                sums[k, 1 : 1 + size] += x.T @ (w * (p - y[:, k]))
                sums[k, 1 + size :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
        if seen:
            at = [(k, i) for k in range(heads) for i in range(0, width, _SUM_BLOCK)]
            values = [sums[k, i : i + _SUM_BLOCK].astype("<f8").tobytes() for k, i in at]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in at], pa.int32()), pa.array([i for _, i in at], pa.int32()), pa.array(values, pa.binary())], names=["head", "at", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                added[k, i] = added.get((k, i), 0.0) + np.frombuffer(values, "<f8")
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in added], pa.int32()), pa.array([i for _, i in added], pa.int32()), pa.array([v.tobytes() for v in added.values()], pa.binary())], names=["head", "at", "sums"]
        )

    schema = "head int, at int, sums binary"
    out = np.zeros((heads, width))
    for row in rows.mapInArrow(partial, schema).repartition("head", "at").mapInArrow(total, schema).collect():
        values = np.frombuffer(row["sums"], "<f8")
        out[row["head"], row["at"] : row["at"] + len(values)] = values
    return out


def fit_multi_horizon(
    windows: DataFrame, horizon: int = 5, balanced: bool = True, strength: float = 1.0, iterations: int = 50, tolerance: float = 1e-9
) -> list[Head | float]:
    """One logistic model per future step on the flattened window (I4), all steps in one pass a round.

    Minimises, as ``fit_logistic`` does, the mean weighted loss plus ``1 / (2 * strength * n)`` of the squared coefficients,
    the intercept free.  Each round is one job over all rows: Newton steps of all heads from partial sums, halved where a
    loss would grow.  A step whose targets have a single class gets its constant rate.  ``iterations`` bounds the rounds; no
    windows are an error.  Runs jobs; the flattened windows are checkpointed.
    """
    target = F.transform(F.slice("targets", 1, horizon), lambda y: y.cast("double"))
    rows = cut(windows.select(F.flatten("features").alias("x"), target.alias("y")))
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), *[F.avg(F.col("y")[k]) for k in range(horizon)]).first()
    n, size, rates = facts[0], facts[1], np.array(facts[2:], dtype=object)
    if not n:
        raise ValueError("no windows to fit")
    free = [k for k in range(horizon) if rates[k] not in (0.0, 1.0)]
    models: list[Head | float] = [float(x) for x in rates]
    if not free:
        return models
    rows = rows.select("x", F.array(*[F.col("y")[k] for k in free]).alias("y"))
    share = rates[free].astype(float)
    weights = np.column_stack([0.5 / (1 - share), 0.5 / share]) if balanced else np.ones((len(free), 2))
    ridge = np.append(np.full(size, 1.0 / (strength * n)), 0.0)
    best = np.zeros((len(free), size + 1))
    step = np.zeros_like(best)
    loss, open_ = np.full(len(free), np.inf), np.ones(len(free), bool)
    for _ in range(iterations):
        tried = best + step
        sums = _head_sums(rows, tried, weights) / n
        for k in np.flatnonzero(open_):
            now = sums[k, 0] + 0.5 * (ridge * tried[k] ** 2).sum()
            if now > loss[k] + 1e-12:
                step[k] /= 2
            else:
                best[k], loss[k] = tried[k], now
                slope = sums[k, 1 : size + 2] + ridge * best[k]
                curve = sums[k, size + 2 :].reshape(size + 1, size + 1) + np.diag(ridge + 1e-12)
                step[k] = -np.linalg.solve(curve, slope)
            open_[k] = np.abs(step[k]).max() > tolerance
            if not open_[k]:
                step[k] = 0.0
        if not open_.any():
            break
    for k, beta in zip(free, best, strict=True):
        models[k] = Head(tuple(beta[:-1].tolist()), float(beta[-1]))
    return models


def forecast_multi_horizon(windows: DataFrame, models) -> DataFrame:
    """Scores of all steps as one array column (I4); plain Spark expressions, no Python worker."""
    flat = F.flatten("features")
    scores = []
    for model in models:
        if isinstance(model, float):
            scores.append(F.lit(model))
            continue
        weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
        product = F.aggregate(F.zip_with(flat, weights, lambda a, b: a * b), F.lit(float(model.intercept)), lambda s, x: s + x)
        scores.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-product)))
    return windows.withColumn("scores", F.array(*scores))


def forecast_rows(scored: DataFrame, thresholds: float | Sequence[float], horizon: int = 5, interval_seconds: int = 10) -> DataFrame:
    """Scores as one row per step with horizon, time and warning."""
    others = [c for c in scored.columns if c not in ("scores", "features", "targets", "target_times")]
    labels = [F.col("targets")[F.col("_i")].alias("label")] if "targets" in scored.columns else []
    rows = scored.select(
        *[col(c) for c in others], *([col("targets")] if labels else []), F.posexplode("scores").alias("_i", "score")
    )
    step = F.col("_i") + 1
    return rows.select(
        *[col(c) for c in others], step.alias("step"), (step * interval_seconds).alias("horizon_seconds"),
        forecast_time(F.col("origin"), step, interval_seconds).alias("forecast_timestamp"), "score",
        (F.col("score") >= step_threshold(thresholds, step, horizon)).alias("warning"), *labels,
    )


# --- I5 ------------------------------------------------------------------


def _cube(column: pa.Array | pa.ChunkedArray, length: int, width: int) -> np.ndarray:
    """(rows, length, width) view of a list column of flattened windows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, length, width)


def _checked(scores: np.ndarray, rows: int, horizon: int) -> np.ndarray:
    scores = np.asarray(scores, dtype="float64").reshape(rows, -1)
    if scores.shape[1] != horizon:
        raise ValueError(f"scorer returned {scores.shape[1]} columns, expected {horizon}")
    if not np.isfinite(scores).all() or ((scores < 0) | (scores > 1)).any():
        raise ValueError("scores must be finite and inside [0, 1]")
    return scores


def score_windows(windows: DataFrame, score_fn: ScoreFunction, length: int = 10, width: int = len(STATE_FEATURES), horizon: int = 5) -> DataFrame:
    """Add ``scores`` from any batch scorer ``(n, length, width) -> (n, horizon)``."""
    flat = windows.withColumn("_flat", F.flatten("features"))
    schema = T.StructType([*windows.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])
    names = windows.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cube = _cube(batch.column("_flat"), length, width)
            scores = _checked(score_fn(cube), len(cube), horizon)
            offsets = pa.array(np.arange(len(cube) + 1) * horizon, pa.int32())
            made = pa.ListArray.from_arrays(offsets, pa.array(scores.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], names=[*names, "scores"])

    return flat.mapInArrow(run, schema)


def logistic_scorer(weights: np.ndarray, bias: np.ndarray) -> ScoreFunction:
    """Plain NumPy scorer: weights (length * width, horizon), bias (horizon)."""
    weights, bias = np.asarray(weights, dtype="float64"), np.asarray(bias, dtype="float64")
    return lambda cube: 1.0 / (1.0 + np.exp(-(cube.reshape(len(cube), -1) @ weights + bias)))


# --- I12-I14, F2, I17 ----------------------------------------------------


def ablation_variants(features: Sequence[str], length: int, groups: Mapping[str, Sequence[str]] = FEATURE_GROUPS):
    """(kind, name, feature positions or None, time positions or None) of every mask."""
    index = {f: i for i, f in enumerate(features)}
    variants = [("feature", f, [i], None) for f, i in index.items()]
    variants += [("group", g, [index[f] for f in fs], None) for g, fs in groups.items() if all(f in index for f in fs)]
    for p in range(length):
        back = (length - 1 - p) * 10
        variants.append(("position", "t" if back == 0 else f"t-{back}s", None, [p]))
    return variants


def ablation_scores(
    windows: DataFrame, score_fn: ScoreFunction, features: Sequence[str] = STATE_FEATURES, length: int = 10, horizon: int = 5,
    step: int = 1, mask: float = 0.0, label: str = "label",
) -> DataFrame:
    """One narrow row per window and mask: label, base score, masked score."""
    width = len(features)
    variants = ablation_variants(features, length)
    flat = windows.select(col(label).cast("int").alias("label"), F.flatten("features").alias("_flat"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cube = _cube(batch.column("_flat"), length, width)
            base = _checked(score_fn(cube), len(cube), horizon)[:, step - 1]
            for kind, name, columns, positions in variants:
                masked = cube.copy()
                if columns is not None:
                    masked[:, :, columns] = mask
                else:
                    masked[:, positions, :] = mask
                changed = _checked(score_fn(masked), len(cube), horizon)[:, step - 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(cube)), pa.array([name] * len(cube)), batch.column("label"),
                        pa.array(base), pa.array(changed),
                    ],
                    names=["kind", "name", "label", "base_score", "masked_score"],
                )

    return flat.mapInArrow(run, "kind string, name string, label int, base_score double, masked_score double")


def ablation(masked: DataFrame, threshold: float) -> DataFrame:
    """Score changes and metric deltas per mask from ``ablation_scores``."""
    change = F.col("base_score") - F.col("masked_score")
    moved = masked.groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(change).alias("mean_signed_score_change"),
        F.avg(F.abs(change)).alias("mean_absolute_score_change"),
    )
    names = ["f1", "pr_auc", "roc_auc", "recall", "false_positive_rate"]
    keys = ["kind", "name"]
    base = binary_metrics(masked, threshold, keys, "label", "base_score").select(*keys, *[col(n).alias(f"base_{n}") for n in names])
    after = binary_metrics(masked, threshold, keys, "label", "masked_score").select(*keys, *[col(n).alias(f"masked_{n}") for n in names])
    joined = moved.join(base, keys).join(after, keys)
    return joined.withColumns({f"delta_{n}": col(f"masked_{n}") - col(f"base_{n}") for n in names}).drop(
        *[f"base_{n}" for n in names], *[f"masked_{n}" for n in names]
    )


def contributions(
    windows: DataFrame, score_fn: ScoreFunction, keys: Sequence[str], features: Sequence[str] = STATE_FEATURES,
    length: int = 10, horizon: int = 5, step: int = 1, mask: float = 0.0,
) -> DataFrame:
    """Signed score change of every (position, feature) cell of every window."""
    width, keys = len(features), list(keys)
    flat = windows.select(*[col(k) for k in keys], F.flatten("features").alias("_flat"))
    fields = [windows.schema[k] for k in keys]
    schema = T.StructType(
        [
            *fields, T.StructField("position_index", T.IntegerType()), T.StructField("feature_index", T.IntegerType()),
            T.StructField("base_score", T.DoubleType()), T.StructField("masked_score", T.DoubleType()),
        ]
    )

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cube = _cube(batch.column("_flat"), length, width)
            n = len(cube)
            base = _checked(score_fn(cube), n, horizon)[:, step - 1]
            for p in range(length):
                for f in range(width):
                    kept = cube[:, p, f].copy()
                    cube[:, p, f] = mask
                    changed = _checked(score_fn(cube), n, horizon)[:, step - 1]
                    cube[:, p, f] = kept
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(k) for k in keys], pa.array(np.full(n, p, "int32")), pa.array(np.full(n, f, "int32")),
                            pa.array(base), pa.array(changed),
                        ],
                        names=[*keys, "position_index", "feature_index", "base_score", "masked_score"],
                    )

    names = F.array(*[F.lit(f) for f in features])
    back = (F.lit(length - 1) - F.col("position_index")) * 10
    change = F.col("base_score") - F.col("masked_score")
    return flat.mapInArrow(run, schema).withColumns(
        {
            "feature": F.element_at(names, F.col("feature_index") + 1),
            "contribution": change,
            "sensitivity": F.abs(change),
            "seconds_before_origin": back,
            "time_position": relative_label(back),
        }
    )


def top_contributions(cells: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The n strongest cells of each window (F2); a window has length * width cells."""
    w = W.partitionBy(*[col(k) for k in keys]).orderBy(F.col("sensitivity").desc(), "position_index", "feature_index")
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def temporal_summary(cells: DataFrame, keys: Sequence[str], width: int = len(STATE_FEATURES)) -> DataFrame:
    """Signed and mean absolute contribution per position; the strongest one is marked."""
    rows = cells.groupBy(*[col(k) for k in keys], "position_index", "time_position").agg(
        F.sum("contribution").alias("signed_contribution"), (F.sum("sensitivity") / width).alias("sensitivity")
    )
    w = W.partitionBy(*[col(k) for k in keys]).orderBy(F.col("sensitivity").desc(), "position_index")
    return rows.withColumn("dominant", F.row_number().over(w) == 1)


def context_length_comparison(
    states: DataFrame, scorers: Mapping[int, ScoreFunction], horizon: int = 5, threshold: float = 0.5,
    features: Sequence[str] = STATE_FEATURES,
) -> DataFrame:
    """Step-wise metrics of several context lengths over the same states."""
    result = None
    for length, score_fn in scorers.items():
        scored = score_windows(build_multistep(states, length, horizon, features=features), score_fn, length, len(features), horizon)
        metrics = binary_metrics(forecast_rows(scored, threshold, horizon), threshold, ["step"])
        metrics = metrics.withColumn("context_length", F.lit(length))
        result = metrics if result is None else result.unionByName(metrics)
    return result
