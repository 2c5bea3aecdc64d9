"""End-to-end plan: flows to states to windows to scores to source priorities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.durable import cut
from flowtide.config import MODE_THRESHOLDS, STATE_FEATURES
from flowtide.operators.activity import prioritize_sources, recommendations, source_activity
from flowtide.operators.flows import build_flows
from flowtide.operators.models import apply_scaler, fit_scaler, forecast_rows, score_windows
from flowtide.operators.states import network_states
from flowtide.operators.windows import build_multistep, build_sequences

# A small linear scorer for checks, weights on the newest state only.
CHECK_BIAS = [-2.0, -2.2, -2.4, -2.6, -2.8]
CHECK_WEIGHTS = {"flow_count": 0.02, "rst_flow_ratio": 1.5, "unique_destination_port_count": 0.1}


def linear_scorer(length: int = 10, features: Sequence[str] = STATE_FEATURES) -> Callable[[np.ndarray], np.ndarray]:
    """Scores that depend on three features of the newest state; easy to repeat in SQL."""
    weights = np.zeros((length, len(features), len(CHECK_BIAS)))
    for name, value in CHECK_WEIGHTS.items():
        weights[length - 1, list(features).index(name), :] = value
    flat, bias = weights.reshape(-1, len(CHECK_BIAS)), np.asarray(CHECK_BIAS)
    return lambda cube: 1.0 / (1.0 + np.exp(-(cube.reshape(len(cube), -1) @ flat + bias)))


def forecast_flows(flows: DataFrame, score_fn: Callable[[np.ndarray], np.ndarray], mode: str = "balanced", scale: bool = False) -> DataFrame:
    """Step-wise forecasts with warnings for every ready window of a flow table."""
    states = network_states(flows)
    rows = apply_scaler(states, fit_scaler(states)) if scale else states
    scored = score_windows(build_multistep(rows, horizon=5), score_fn)
    return forecast_rows(scored, MODE_THRESHOLDS[mode])


def replay(packets: DataFrame, score_fn: Callable[[np.ndarray], np.ndarray], mode: str = "balanced") -> tuple[DataFrame, DataFrame]:
    """(forecasts, source recommendations) of a packet history: the whole live path as one batch plan.

    Packets become flows, flows become states placed at their first packet, ready contexts
    are scored, and the first-step forecast feeds the source priorities.  States and
    forecasts, a few rows per interval, are checkpointed because several steps read them.
    """
    states = cut(network_states(build_flows(packets), mode="inference"))
    scored = score_windows(build_contexts(states), score_fn)
    forecasts = cut(forecast_rows(scored, MODE_THRESHOLDS[mode]))
    first = forecasts.filter("step = 1").select(
        F.timestamp_add("SECOND", F.lit(10), F.col("origin")).alias("forecast_time"), F.col("score").alias("forecast_score"),
        F.col("warning").alias("network_warning"),
    )
    advice, _ = recommendations(prioritize_sources(source_activity(packets), first))
    return forecasts, advice


def build_contexts(states: DataFrame, length: int = 10) -> DataFrame:
    """Every complete context, also those whose future is not known yet."""
    blind = states.withColumns({"future_attack_state": F.lit(0), "future_target_available": F.lit(True)})
    return build_sequences(blind, length=length).drop("target", "target_time")
