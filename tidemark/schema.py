"""The data model: record schemas, closed vocabularies and constant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TELEMETRY = "ts timestamp, site string, device string, role string, metric_name string, value double, kind string, site_type string, unit string, labels map<string,string>, source string"
SYSLOG = "ts timestamp, site string, device string, role string, severity int, facility string, mnemonic string, message string, labels map<string,string>"
ROUTING = "ts timestamp, site string, device string, role string, protocol string, event_type string, peer string, prefix string, vrf string, as_path_len int, labels map<string,string>"
FLOW = "ts timestamp, site string, device string, src_addr string, dst_addr string, src_port int, dst_port int, protocol string, bytes long, packets long, in_iface string, out_iface string, vrf string, dscp int, labels map<string,string>"
TUNNEL = "ts timestamp, site string, device string, role string, tunnel_id string, peer_site string, loss_pct double, jitter_ms double, latency_ms double, rekey_interval_s double, rekey_count int, oper_up boolean, labels map<string,string>"
LABEL = "label string, scenario string, issue string, node string, precursor_us long, fault_us long, fault_end_us long"
SCHEMAS = {"TelemetryRecord": TELEMETRY, "SyslogEvent": SYSLOG, "RoutingEvent": ROUTING, "FlowRecord": FLOW, "TunnelStat": TUNNEL}

# Closed vocabularies.
ROLES = ("PE", "P", "RR", "CE", "host", "controller")
PROTOCOLS = ("bgp", "ospf")
SEVERITIES = ("P1", "P2", "P3", "INFO")
ISSUES = ("interface_congestion", "latency_drift", "bgp_route_flap", "ospf_convergence_stress", "tunnel_degradation", "mpls_underlay_failure", "policy_drift", "path_asymmetry", "none")

# Metric, threshold, whether a breach is above it, and the issue that it speaks for.
PRECURSORS = [
    ("if_util_pct", 90.0, True, "interface_congestion"),
    ("latency_ms", 150.0, True, "latency_drift"),
    ("jitter_ms", 30.0, True, "latency_drift"),
    ("loss_pct", 5.0, True, "interface_congestion"),
    ("if_out_discards", 80.0, True, "interface_congestion"),
    ("tunnel_loss_pct", 5.0, True, "tunnel_degradation"),
    ("tunnel_jitter_ms", 30.0, True, "tunnel_degradation"),
    ("tunnel_rekey_interval_s", 2500.0, False, "tunnel_degradation"),
    ("bgp_update_rate", 30.0, True, "bgp_route_flap"),
    ("bgp_flap_penalty", 2000.0, True, "bgp_route_flap"),
    ("adj_flap_count", 0.5, True, "bgp_route_flap"),
    ("ospf_lsa_rate", 20.0, True, "ospf_convergence_stress"),
    ("config_drift_score", 0.5, True, "policy_drift"),
]

# Metric, level, noise, floor, ceiling, whether it follows the day, whether noise adds, how far it follows the day, whether it scales with the site.
BASELINES = [
    ("if_util_pct", 42.0, 0.06, 0.5, 100.0, True, False, 0.9, True),
    ("if_out_discards", 0.3, 0.8, 0.0, 1e6, True, True, 0.7, True),
    ("if_in_errors", 0.05, 0.3, 0.0, 1e6, False, True, 1.0, False),
    ("latency_ms", 18.0, 0.04, 1.0, 2000.0, True, False, 0.35, False),
    ("jitter_ms", 2.5, 0.12, 0.1, 500.0, True, False, 0.4, False),
    ("loss_pct", 0.05, 0.5, 0.0, 100.0, True, True, 0.3, False),
    ("queue_depth", 6.0, 0.15, 0.0, 1e5, True, False, 0.8, True),
    ("bgp_update_rate", 1.2, 0.9, 0.0, 1e5, True, True, 0.5, False),
    ("bgp_withdraw_rate", 0.2, 0.6, 0.0, 1e5, False, True, 1.0, False),
    ("bgp_flap_penalty", 0.0, 0.0, 0.0, 1e4, False, True, 1.0, False),
    ("adj_flap_count", 0.0, 0.0, 0.0, 1e4, False, True, 1.0, False),
    ("ospf_lsa_rate", 0.8, 0.7, 0.0, 1e4, False, True, 1.0, False),
    ("ospf_spf_rate", 0.3, 0.5, 0.0, 1e4, False, True, 1.0, False),
    ("path_asymmetry", 0.02, 0.4, 0.0, 1.0, False, True, 1.0, False),
    ("tunnel_loss_pct", 0.08, 0.5, 0.0, 100.0, True, True, 0.3, False),
    ("tunnel_jitter_ms", 3.0, 0.14, 0.1, 500.0, True, False, 0.4, False),
    ("tunnel_rekey_interval_s", 3600.0, 0.01, 60.0, 86400.0, False, False, 1.0, False),
    ("config_drift_score", 0.0, 0.0, 0.0, 1.0, False, True, 1.0, False),
]
INTERFACE = ("if_util_pct", "if_out_discards", "if_in_errors", "latency_ms", "jitter_ms", "loss_pct", "queue_depth")
TUNNELS = ("tunnel_loss_pct", "tunnel_jitter_ms", "tunnel_rekey_interval_s")
PEERS = ("bgp_update_rate", "bgp_withdraw_rate", "bgp_flap_penalty", "adj_flap_count", "ospf_lsa_rate", "ospf_spf_rate", "path_asymmetry")
# Share of a site's load.
SITE_LOAD = {"dc": 1.0, "hub": 0.8, "br1": 0.45, "br2": 0.4, "br3": 0.5, "core": 0.9}


def valid(kind: str) -> Column:
    """Whether a record of this type keeps its bounds; rows for which this isn't true belong in quarantine."""
    c = F.col
    rules = {
        "SyslogEvent": c("severity").between(0, 7),
        "RoutingEvent": c("protocol").isin(*PROTOCOLS),
        "FlowRecord": (c("bytes") >= 0) & (c("packets") >= 0) & F.coalesce(c("dscp").between(0, 63), F.lit(True)) & F.coalesce(c("src_port").between(0, 65535), F.lit(True)),
        "TunnelStat": F.coalesce(c("loss_pct").between(0, 100), F.lit(True)),
    }
    present = c("ts").isNotNull() & c("site").isNotNull() & c("device").isNotNull()
    return F.coalesce(present & rules.get(kind, F.lit(True)), F.lit(False))


def split_valid(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep their bounds, and the quarantine."""
    return df.where(valid(kind)), df.where(~valid(kind))
