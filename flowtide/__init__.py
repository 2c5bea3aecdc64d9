"""Network-telemetry analytics on Spark: packets, flows, states, windows, scores, sources, sensors."""

__version__ = "0.1.0"
