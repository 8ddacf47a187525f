"""Synthetic telemetry of a small network with labelled faults, generated in the executors.

A stream is a row of a catalog; its ticks are exploded from a sequence, and noise is a hash of (seed,
entity, metric, tick), so a value does not depend on how the work is dealt out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import clip
from tidemark.schema import BASELINES, INTERFACE, PEERS, SITE_LOAD, TUNNELS

#: name, site, type of site, role, interfaces, tunnels to sites, peers
DEVICES = [
    ("p1", "core", "core", "P", ("e1", "e2"), (), ()),
    ("p2", "core", "core", "P", ("e1", "e2"), (), ()),
    ("rr1", "core", "core", "RR", ("e1",), (), ("pe-dc", "pe-hub")),
    ("pe-dc", "dc", "dc", "PE", ("e1", "e2"), (), ("pe-hub",)),
    ("pe-hub", "hub", "hub", "PE", ("e1", "e2"), (), ("pe-dc",)),
    ("ce-dc", "dc", "dc", "CE", ("e1",), (), ()),
    ("ce-br1", "br1", "branch", "CE", ("e1",), ("hub",), ()),
    ("ce-br2", "br2", "branch", "CE", ("e1",), ("hub",), ()),
    ("ce-br3", "br3", "branch", "CE", ("e1",), ("hub",), ()),
    ("ctl1", "dc", "dc", "controller", (), (), ()),
]
#: source, target, whether the far end depends on the near one
LINKS = [
    ("p1", "p2", False), ("p1", "pe-dc", True), ("p2", "pe-hub", True), ("pe-dc", "ce-dc", True), ("pe-hub", "ce-br1", True), ("pe-hub", "ce-br2", True),
    ("pe-hub", "ce-br3", True), ("rr1", "pe-dc", True), ("rr1", "pe-hub", True), ("ctl1", "pe-dc", True), ("ctl1", "pe-hub", True),
]
#: scenario, issue, target entity, start of the precursor, of the fault, and its end as shares of the run
SCENARIOS = [
    ("congestion", "interface_congestion", "hub:pe-hub:PE:e1", 0.12, 0.28, 0.45),
    ("route_flap", "bgp_route_flap", "core:rr1:RR:pe-dc", 0.30, 0.40, 0.55),
    ("tunnel", "tunnel_degradation", "br1:ce-br1:CE:tunnel-hub", 0.50, 0.62, 0.80),
    ("policy_drift", "policy_drift", "dc:ctl1:controller", 0.70, 0.78, 0.92),
]
DRIFT_FANOUT = ("dc:pe-dc:PE:e2", "hub:pe-hub:PE:e2", "dc:pe-dc:PE:pe-hub")


@dataclass(frozen=True)
class Config:
    duration_s: float = 900.0
    step_s: float = 10.0
    seed: int = 1337
    start_us: int = 1_735_722_000_000_000  # 2025-01-01 09:00 UTC
    scenarios: tuple[str, ...] = tuple(s[0] for s in SCENARIOS)

    def __post_init__(self):
        if self.duration_s <= 0 or self.step_s <= 0:
            raise ValueError("duration and step must be positive")
        if unknown := set(self.scenarios) - {s[0] for s in SCENARIOS}:
            raise ValueError(f"unknown scenarios: {sorted(unknown)}")

    @property
    def n_ticks(self) -> int:
        return int(self.duration_s // self.step_s) + 1


def node_id(name: str) -> str:
    d = next(d for d in DEVICES if d[0] == name)
    return f"{d[1]}:{d[0]}:{d[3]}"


def nodes(spark: SparkSession) -> DataFrame:
    from tidemark.operators.graph import criticality

    rows = [(node_id(d[0]), i, d[1], d[0], d[3], d[2], ["CORP", "OT"] if d[3] == "PE" else []) for i, d in enumerate(DEVICES)]
    n = spark.createDataFrame(rows, "id string, node_seq int, site string, device string, role string, site_type string, services array<string>")
    return n.withColumn("criticality", criticality(F.col("role"), F.col("site_type")))


def edges(spark: SparkSession) -> DataFrame:
    rows = [(node_id(a), node_id(b)) for a, b, _ in LINKS] + [(node_id(b), node_id(a)) for a, b, directed in LINKS if not directed]
    tunnels = [(node_id(d[0]), node_id("pe-hub")) for d in DEVICES for t in d[5]]
    return spark.createDataFrame(rows + tunnels, "source string, target string")


def streams(spark: SparkSession) -> DataFrame:
    """entity, site, metric and its baseline: a row for each stream."""
    out = []
    for name, site, _, role, ifaces, tunnels, peers in DEVICES:
        base = f"{site}:{name}:{role}"
        out += [(f"{base}:{i}", site, m) for i in ifaces for m in INTERFACE]
        out += [(f"{base}:tunnel-{t}", site, m) for t in tunnels for m in TUNNELS]
        out += [(f"{base}:{p}", site, m) for p in peers for m in PEERS]
        if role == "controller":
            out.append((base, site, "config_drift_score"))
    cat = spark.createDataFrame(out, "entity string, site string, metric string")
    b = spark.createDataFrame(BASELINES, "metric string, base double, sigma double, lo double, hi double, seasonal boolean, additive boolean, gain double, by_site boolean")
    return cat.join(F.broadcast(b), "metric")


def labels(spark: SparkSession, cfg: Config) -> DataFrame:
    at = lambda share: cfg.start_us + int(share * cfg.duration_s * 1e6)
    rows = [(f"{s}-{cfg.seed}", s, issue, target, ":".join(target.split(":")[:3]), at(a), at(b), at(c)) for s, issue, target, a, b, c in SCENARIOS if s in cfg.scenarios]
    return spark.createDataFrame(rows, "label string, scenario string, issue string, entity string, node string, precursor_us long, fault_us long, fault_end_us long")


def noise(seed: int, *key: Column) -> Column:
    """A standard normal variate that is a function of the key."""
    u = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *key), 11) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))


def diurnal(us: Column, peak_hour: float = 15.0) -> Column:
    """Load over the day: a sine with its peak in the afternoon, a dip at lunch, less on weekends."""
    h = F.pmod(us, F.lit(86_400_000_000)) / 3.6e9
    wave = 0.55 + 0.42 * F.sin((h - peak_hour + 6) / 24 * 2 * math.pi - math.pi / 2) - 0.1 * F.exp(-F.pow(h - 13, F.lit(2)) / (2 * 0.8**2))
    weekday = F.pmod(F.floor(us / 86_400_000_000) + 3, F.lit(7))
    return F.least(F.lit(1.05), F.greatest(F.lit(0.18), wave) * F.when(weekday >= 5, 0.7).otherwise(1.0))


def ramp(t: Column, a: Column | float, b: Column | float) -> Column:
    return clip((t - a) / (b - a))


def smooth(x: Column) -> Column:
    return x * x * (3 - 2 * x)


def injection(cfg: Config, t: Column, entity: Column, metric: Column, z: Column) -> Column:
    """What the scenarios add to a stream at t seconds: a precursor that grows, the fault, and its end."""
    total = F.lit(0.0)
    for name, _, target, a, b, c in SCENARIOS:
        if name not in cfg.scenarios:
            continue
        pre0, fault, end = (x * cfg.duration_s for x in (a, b, c))
        pre, on = ramp(t, pre0, fault), (t >= fault) & (t < end)
        inside = F.when(on, 1.0).otherwise(0.0)
        fade = lambda s, end=end: 1 - ramp(t, end, end + s)
        pulse = lambda period, duty, on=on, fault=fault: F.when(on & (F.pmod(t - fault, F.lit(period)) < period * duty), 1.0).otherwise(0.0)
        at = entity == target
        if name == "congestion":
            hit = ramp(t, fault, fault + 90)
            add = {
                "if_util_pct": (smooth(pre) * 55 + hit * 30) * (1 + 0.02 * z), "queue_depth": F.pow(smooth(pre), F.lit(2)) * 80 + hit * 120, "if_out_discards": F.greatest(F.lit(0.0), pre - 0.4) * 40 + hit * 200,
                "latency_ms": smooth(pre) * 22 + hit * 60, "jitter_ms": smooth(pre) * 4 + hit * 12 + 1.5 * pre * z, "loss_pct": F.greatest(F.lit(0.0), pre - 0.85) * 6 + hit * 9,
            }
            gone = fade(60)
        elif name == "route_flap":
            flap = pulse(80.0, 0.35)
            rest = inside * (1 - flap)
            add = {
                "bgp_flap_penalty": smooth(pre) * 800 + 1500 * flap + 400 * rest, "bgp_update_rate": F.greatest(F.lit(0.0), smooth(pre) * 15 + 90 * flap + 10 * rest + 4 * (pre + inside) * z),
                "bgp_withdraw_rate": 25 * flap + 2 * rest + F.greatest(F.lit(0.0), pre - 0.5) * 8, "adj_flap_count": flap, "ospf_spf_rate": 6 * flap + rest + F.greatest(F.lit(0.0), pre - 0.6) * 3,
                "ospf_lsa_rate": 10 * flap + 1.5 * rest + F.greatest(F.lit(0.0), pre - 0.6) * 4, "path_asymmetry": F.least(F.lit(1.0), smooth(pre) * 0.4 + 0.5 * flap),
            }
            gone = fade(45)
        elif name == "tunnel":
            burst = pulse(40.0, 0.25)
            rest = inside * (1 - burst)
            add = {
                "tunnel_loss_pct": F.greatest(F.lit(0.0), smooth(pre) * 1.8 + 12 * burst + 2 * rest + 0.6 * (pre + inside) * z), "tunnel_jitter_ms": smooth(pre) * 8 + 25 * burst + 6 * rest + 2 * (pre + inside) * z,
                "tunnel_rekey_interval_s": smooth(pre) * -900 + 120 * pre * z - 1500 * burst, "latency_ms": smooth(pre) * 10 + 40 * burst,
            }
            gone = fade(60)
        else:
            step = smooth(ramp(t, fault - 15, fault + 15))
            add = {"config_drift_score": F.least(F.lit(1.0), step * 0.9) + F.when(step > 0, 0.01 * z).otherwise(0.0), "if_util_pct": step * 12 * ramp(t, fault, fault + 240), "path_asymmetry": F.least(F.lit(1.0), step * 0.35)}
            gone, at = fade(30), at | entity.isin(*DRIFT_FANOUT)
        part = F.lit(0.0)
        for m, x in add.items():
            part = F.when(metric == m, x).otherwise(part)
        total = total + F.when(at, part * gone).otherwise(0.0)
    return total


def telemetry(spark: SparkSession, cfg: Config = Config()) -> DataFrame:
    """seq, us, t (seconds), entity, metric, value of all streams and ticks."""
    s = streams(spark).withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_ticks - 1))))
    s = s.withColumn("t", F.col("tick") * cfg.step_s).withColumn("us", (F.lit(cfg.start_us) + F.col("t") * 1e6).cast("long"))
    load = F.create_map(*(F.lit(x) for kv in SITE_LOAD.items() for x in kv))
    level = F.col("base") * F.when(F.col("by_site"), F.coalesce(F.try_element_at(load, F.col("site")), F.lit(1.0))).otherwise(1.0)
    level = level * F.when(F.col("seasonal"), 1 - F.col("gain") + F.col("gain") * diurnal(F.col("us"))).otherwise(1.0)
    key = (F.col("entity"), F.col("metric"), F.col("tick"))
    z = noise(cfg.seed, *key)
    plain = F.when(F.col("additive"), level + F.col("sigma") * z).otherwise(level * (1 + F.col("sigma") * z))
    plain = F.least(F.col("hi"), F.greatest(F.col("lo"), plain))
    value = F.least(F.col("hi"), F.greatest(F.col("lo"), plain + injection(cfg, F.col("t"), F.col("entity"), F.col("metric"), noise(cfg.seed + 1, *key))))
    return s.select(F.xxhash64("tick", "entity", "metric").alias("seq"), "us", "t", "entity", "metric", value.alias("value"))


def events(telemetry: DataFrame) -> DataFrame:
    """us, entity, kind, detail: what devices log when a value calls for it.

    A short rekey interval and an adjacency flap write to the system log; many updates and a flap are
    routing events; a first rise of the drift score is a change of policy.
    """
    t, m, v = telemetry, F.col("metric"), F.col("value")
    log = t.where(((m == "tunnel_rekey_interval_s") & (v < 3000)) | ((m == "adj_flap_count") & (v >= 0.5)))
    log = log.select("us", "entity", F.lit("SyslogEvent").alias("kind"), F.when(m == "adj_flap_count", "ADJCHANGE neighbor down").otherwise("IKE rekey early").alias("detail"))
    route = t.where(((m == "bgp_update_rate") & (v > 30)) | ((m == "adj_flap_count") & (v >= 0.5)))
    route = route.select("us", "entity", F.lit("RoutingEvent").alias("kind"), F.when(m == "adj_flap_count", "adjacency_down").otherwise("bgp_update").alias("detail"))
    drift = t.where((m == "config_drift_score") & (v >= 0.3)).groupBy("entity").agg(F.min("us").alias("us")).select("us", "entity", F.lit("SyslogEvent").alias("kind"), F.lit("policy differs from the golden baseline").alias("detail"))
    return log.unionByName(route).unionByName(drift)


def flows(telemetry: DataFrame, cfg: Config = Config()) -> DataFrame:
    """us, device, flow, bytes, packets, vrf: every half minute a few flows of each PE, more when its links are busy."""
    every = max(1, int(30 // cfg.step_s)) * cfg.step_s
    util = telemetry.where((F.col("metric") == "if_util_pct") & F.col("entity").contains(":PE:") & (F.pmod(F.col("t"), F.lit(every)) == 0))
    busy = util.groupBy("us", F.split_part("entity", F.lit(":"), F.lit(2)).alias("device")).agg(F.max("value").alias("util"))
    n = busy.withColumn("flow", F.explode(F.sequence(F.lit(0), F.lit(1) + F.floor(F.col("util") / 25).cast("int"))))
    size = F.pmod(F.xxhash64(F.lit(cfg.seed), "us", "device", "flow"), F.lit(900_000)) + 100_000
    return n.select("us", "device", "flow", size.alias("bytes"), F.floor(size / 900).alias("packets"), F.when(F.col("flow") % 3 == 0, "OT").otherwise("CORP").alias("vrf"))
