"""Contracts and policies: column sets, limits and fixed lookup values."""

from __future__ import annotations

from dataclasses import dataclass

INTERVALS = (1, 5, 10, 30, 60)
INTERVAL = 10
MICROS = 1_000_000

# The 17 state features in contract order.
STATE_FEATURES = [
    "flow_count", "byte_sum", "packet_sum", "mean_duration", "median_duration",
    "mean_iat", "iat_std", "syn_flow_ratio", "ack_flow_ratio", "rst_flow_ratio",
    "fwd_byte_share", "fwd_packet_share", "unique_destination_port_count",
    "bytes_per_second", "packets_per_second", "packet_size_mean", "packet_size_std",
]
STATE_META = ["timestamp", "capture_day"]
STATE_COLUMNS = STATE_FEATURES + STATE_META
STATE_TARGETS = [
    "malicious_flow_count", "malicious_flow_ratio", "binary_attack_state",
    "future_attack_state", "future_target_available",
]

# Feature groups used by the ablation report.
FEATURE_GROUPS = {
    "volume_traffic": ["flow_count", "byte_sum", "packet_sum", "bytes_per_second", "packets_per_second"],
    "timing": ["mean_duration", "median_duration", "mean_iat", "iat_std"],
    "tcp_behavior": ["syn_flow_ratio", "ack_flow_ratio", "rst_flow_ratio"],
    "forward_backward_ratios": ["fwd_byte_share", "fwd_packet_share"],
    "diversity_fan_out": ["unique_destination_port_count"],
    "packet_size_statistics": ["packet_size_mean", "packet_size_std"],
}

# Flow export columns the state aggregation needs.
FLOW_NUMERIC = [
    "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "Flow IAT Mean", "Flow IAT Std", "SYN Flag Cnt", "ACK Flag Cnt", "RST Flag Cnt",
    "Pkt Len Mean", "Pkt Len Std",
]
ANOMALY = "timestamp_capture_date_mismatch"
RATE_COLUMNS = ["Flow Byts/s", "Flow Pkts/s"]
PACKET_COUNT_COLUMNS = ["Tot Fwd Pkts", "Tot Bwd Pkts", "Subflow Fwd Pkts", "Subflow Bwd Pkts", "Fwd Act Data Pkts"]
BYTE_COUNT_COLUMNS = ["TotLen Fwd Pkts", "TotLen Bwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Byts"]

# Columns that never become model inputs.
MODEL_EXCLUDED = {
    "Label", "original_label", "binary_label", "Timestamp", "timestamp_parsed", "Dst Port",
    "Protocol", "Flow Byts/s", "Flow Pkts/s", "Flow Byts/s__raw", "Flow Pkts/s__raw",
    "source_row_number", "source_file", "capture_date", ANOMALY,
}

# Label map (source spelling kept), day roles, day content.
LABELS = {"Benign": 0, "Infilteration": 1}
DAY_ROLES = {
    "2018-02-14": "train",
    "2018-02-21": "train",
    "2018-02-22": "validation",
    "2018-02-28": "test",
}
DAY_ATTACKS = {
    "2018-02-14": "FTP-BruteForce; SSH-Bruteforce",
    "2018-02-21": "DDoS-LOIC-UDP; DDoS-HOIC",
    "2018-02-22": "Brute Force-Web; Brute Force-XSS; SQL Injection",
    "2018-02-28": "Infiltration",
}

PACKET_COLUMNS = [
    "timestamp", "source_ip", "destination_ip", "source_port", "destination_port",
    "protocol", "packet_length", "tcp_flags",
]
# Fixed value: the mark of demo events.
DEMO_STATUS = "DEMO / TEST DATA - NOT RESEARCH DATA"
PACKET_OPTIONAL = ["ttl", "ip_fragment", "tcp_window", "payload_length"]
ACTIVITY_KEYS = ["source_ip", "capture_day", "interval_start", "interval_end"]
ACTIVITY_MEASURES = [
    "flow_count", "packet_count", "byte_count", "unique_destinations", "unique_destination_ports",
    "mean_packet_size", "mean_iat", "syn_count", "ack_count", "rst_count", "packet_rate", "byte_rate",
]
ACTIVITY_COLUMNS = ACTIVITY_KEYS + ACTIVITY_MEASURES

# Priority names, their rank and the recommendation for each.
HIGH, MEDIUM, LOW = "HIGH PRIORITY SOURCE", "MEDIUM PRIORITY SOURCE", "LOW PRIORITY SOURCE"
PRIORITY_RANK = {HIGH: 0, MEDIUM: 1, LOW: 2}
RECOMMENDATIONS = {
    LOW: "Monitor source",
    MEDIUM: "Consider temporary rate limiting",
    HIGH: "Consider aggressive rate limiting / investigation",
}

# Operating modes selected on validation scores.
MODE_THRESHOLDS = {"sensitive": 0.09, "balanced": 0.19, "conservative": 0.26}
SWEEP_THRESHOLDS = [n / 100 for n in range(5, 96)]

MAX_STATES_PER_ENVELOPE = 60
MAX_ACTIVITY_PER_ENVELOPE = 120
MAX_SOURCES_PER_WINDOW = 256

# What every telemetry source type carries and what can be derived from it.
SOURCE_TYPES = [
    ("LOCAL_PACKET_CAPTURE", "SUPPORTED",
     ["packet_timestamp", "ip_endpoints", "transport_ports", "protocol", "packet_length", "tcp_flags",
      "ttl", "tcp_window", "payload_length", "fragmentation"],
     ["bidirectional_flows", "flow_duration", "packet_counts", "byte_counts", "flow_iat",
      "packet_size_statistics", "10_second_network_state"]),
    ("REMOTE_AGENT", "SUPPORTED",
     ["approved_17_feature_state", "state_timestamp", "capture_day", "sensor_id", "telemetry_sequence",
      "source_ip", "destination_ip", "transport_ports", "protocol", "packet_length", "tcp_flags",
      "source_activity_10_second_windows"],
     ["source_flow_counts", "source_packet_counts", "source_byte_counts", "source_growth",
      "candidate_source_priority"]),
    ("REPLAY", "SUPPORTED", ["approved_state_or_replay_event", "event_timestamp"], []),
    ("MOCK", "SUPPORTED", ["test_events"], []),
    ("ZEEK", "PARTIAL",
     ["event_timestamp", "ip_endpoints", "transport_ports", "protocol", "flow_duration", "packet_counts",
      "byte_counts", "connection_metadata"],
     ["bidirectional_flow_record"]),
    ("NETFLOW", "UNSUPPORTED", [], []),
    ("IPFIX", "UNSUPPORTED", [], []),
]


@dataclass(frozen=True)
class FlowPolicy:
    """Flow lifecycle limits in seconds."""

    idle_seconds: int = 30
    active_seconds: int = 300
    max_tracked_flows: int = 10_000


@dataclass(frozen=True)
class FreshnessPolicy:
    """Sensor freshness and rate limits."""

    heartbeat_timeout_seconds: int = 90
    telemetry_stale_seconds: int = 30
    source_stale_seconds: int = 30
    requests_per_minute: int = 60
