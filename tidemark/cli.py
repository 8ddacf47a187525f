"""Command line: generate telemetry, stream it, or run the scenarios to their evaluation."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.plans.situation import PROFILES

# Short names of the scenarios.
ALIASES = {"a": "congestion", "b": "route_flap", "c": "tunnel", "d": "policy_drift"}


def _scenarios(text: str) -> tuple[str, ...]:
    from tidemark.sources.generator import SCENARIOS

    names = [s[0] for s in SCENARIOS]
    if text == "all":
        return tuple(names)
    if text == "none":
        return ()
    out = tuple(ALIASES.get(x.strip().lower(), x.strip().lower()) for x in text.split(","))
    if unknown := set(out) - set(names):
        raise argparse.ArgumentTypeError(f"unknown scenarios: {', '.join(sorted(unknown))}")
    return out


def _start(text: str) -> int:
    """A time in ISO form, in UTC unless it names a zone, as microseconds."""
    at = datetime.fromisoformat(text)
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1e6)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("generate", "write telemetry, labels and a manifest"), ("stream", "print records as JSON lines"), ("demo", "run scenarios and evaluate them; fails unless all are detected")):
        c = sub.add_parser(name, help=text)
        c.add_argument("--scenarios", type=_scenarios, default=_scenarios("all"))
        c.add_argument("--duration", type=float, default=900.0)
        c.add_argument("--step", type=float, default=10.0)
        c.add_argument("--seed", type=int, default=1337)
        c.add_argument("--start", type=_start, help="first tick, such as 2025-01-01T09:00")
        c.add_argument("--profile", choices=sorted(PROFILES), default="fast")
    sub.choices["generate"].add_argument("--out", required=True)
    sub.choices["generate"].add_argument("--format", choices=("parquet", "jsonl"), default="parquet")
    for flag, what in (("--no-flows", "leave out flow records"), ("--no-syslog", "leave out log and routing events")):
        sub.choices["generate"].add_argument(flag, action="store_true", help=what)
    sub.choices["stream"].add_argument("--limit", type=int)
    sub.choices["stream"].add_argument("--speed", type=float, help="wait between records as their times do, so many times faster")
    sub.choices["stream"].add_argument("--count-only", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    from tidemark.operators.serving import summary
    from tidemark.plans.situation import situation
    from tidemark.sources import generator as g
    from tidemark.sources import records

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    cfg = g.Config(duration_s=a.duration, step_s=a.step, seed=a.seed, scenarios=a.scenarios, **({"start_us": a.start} if a.start is not None else {}))
    telemetry, labels = g.telemetry(spark, cfg), g.labels(spark, cfg)
    if a.command == "generate":
        if a.format == "parquet":
            records.write_parquet(telemetry, f"{a.out}/telemetry", partition_by=("metric",))
        else:
            records.write_lines(telemetry, "TelemetryRecord", f"{a.out}/telemetry", mode="overwrite")
        counts = {"TelemetryRecord": telemetry.count(), "ScenarioLabel": labels.count()}
        for name, rows, left_out in (("events", g.events(telemetry), a.no_syslog), ("flows", g.flows(telemetry, cfg).withColumn("kind", F.lit("FlowRecord")), a.no_flows)):
            if not left_out:
                if a.format == "parquet":
                    records.write_parquet(rows, f"{a.out}/{name}")
                else:
                    records.write_tagged(rows, "kind", f"{a.out}/{name}")
                counts |= {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
        records.write_lines(labels, "ScenarioLabel", f"{a.out}/labels", mode="overwrite")
        spark.createDataFrame([(json.dumps(counts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/manifest")
        print(json.dumps(counts))
        return 0
    if a.command == "stream":
        if a.count_only:
            print(telemetry.count())
            return 0
        rows = telemetry.orderBy("us", "seq")
        rows = rows.limit(a.limit) if a.limit else rows
        if a.speed is not None:
            from tidemark.sources.feeds import paced

            for r in paced(rows, speed=a.speed):
                print(json.dumps({"_type": "TelemetryRecord"} | {k: v for k, v in r.asDict().items() if k != "pause_s"}), flush=True)
            return 0
        for r in records.encode(rows, F.lit("TelemetryRecord")).toLocalIterator():
            print(r.record)
        return 0
    rows = summary(situation(telemetry, g.nodes(spark), g.edges(spark), labels, PROFILES[a.profile])["evaluation"]).collect()
    for r in rows:
        print(r.json)
    return 0 if rows and all(r.detected for r in rows) else 1


if __name__ == "__main__":
    sys.exit(main())
