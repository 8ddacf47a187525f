from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import kernels as K
from tidemark.operators.fold import keyed_fold
from tidemark.plans.situation import situation
from tidemark.sources import generator as g
from tidemark.sources import records
from tidemark.streaming import stateful as S


def test_generator_is_deterministic(spark):
    cfg = g.Config(duration_s=200)
    a, b = (g.telemetry(spark, cfg).select(F.sum(F.round("value", 6)), F.count("*")).first() for _ in range(2))
    assert a == b and a[1] == g.streams(spark).count() * cfg.n_ticks
    other = g.telemetry(spark, g.Config(duration_s=200, seed=7)).select(F.sum(F.round("value", 6)), F.count("*")).first()
    assert other[1] == a[1] and other[0] != a[0]
    with pytest.raises(ValueError):
        g.Config(step_s=0)


def test_four_scenarios_are_foreseen(spark):
    cfg = g.Config()
    out = situation(g.telemetry(spark, cfg), g.nodes(spark), g.edges(spark), g.labels(spark, cfg))
    ev = {r.scenario: r for r in out["evaluation"].collect()}
    assert len(ev) == 4 and all(r.detected and r.lead_s > 0 for r in ev.values())
    assert {"bgp_route_flap", "tunnel_degradation", "interface_congestion"} <= {r.issue for r in out["peaks"].collect()}
    assert out["incidents"].count() >= 1 and out["answers"].first().answer.startswith("P")


def test_quiet_run_has_no_incident(spark):
    cfg = g.Config(scenarios=())
    out = situation(g.telemetry(spark, cfg), g.nodes(spark), g.edges(spark), g.labels(spark, cfg))
    assert out["peaks"].count() <= 2 and out["evaluation"].count() == 0


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", 1.5)], "site string, value double")
    records.write_lines(df, "TelemetryRecord", str(tmp_path / "r"))
    spark.createDataFrame([("not json",), ('{"tunnel_id": "t"}',), ('{"message": "m", "severity": 3}',), ('{"event_type": "x", "protocol": "bgp"}',), ('{"src_addr": "a", "dst_addr": "b"}',)], "value string").write.mode("append").text(str(tmp_path / "r"))
    lines = records.read_lines(spark, str(tmp_path / "r"))
    assert {r.kind: r.n for r in records.manifest(lines).collect()} == {k: 1 for k in records.TYPES}
    assert records.parse(lines, "TelemetryRecord", "site string, value double").collect() == df.collect()
    records.write_parquet(spark.createDataFrame([({"a": "b"},)], "labels map<string,string>"), str(tmp_path / "p"), json_maps=True)
    assert spark.read.parquet(str(tmp_path / "p")).first().labels == '{"a":"b"}'


def test_quarantine(spark):
    df = spark.createDataFrame([(None, "s", "d", 3), ("2025-01-01", "s", "d", 9), ("2025-01-01", "s", "d", 3)], "ts string, site string, device string, severity int").withColumn("ts", F.to_timestamp("ts"))
    good, bad = schema.split_valid(df, "SyslogEvent")
    assert good.count() == 1 and bad.count() == 2


@pytest.mark.parametrize("make,out", [(K.LevelDrift, "a double, b double"), (K.Cusum, "a double, b double, c boolean"), (K.Slope, "a double")])
def test_stream_equals_batch(spark, tmp_path, make, out):
    rows = [(f"k{i % 3}", i, float((i * 37) % 101)) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    src = str(tmp_path / "src")
    for lo in (0, 30, 60):
        df.where(f"i >= {lo} and i < {lo + 30}").coalesce(1).write.mode("append").parquet(src)
    S.ready(spark)
    stream = S.replay(spark, src, df.schema)
    got = S.drain(S.keyed_stream(stream, ["k"], ["i"], make, out), f"t{make.__name__.lower()}")
    want = keyed_fold(df, ["k"], ["i"], make, out)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    shutil.rmtree(src)


def test_replay_needs_a_pace(spark, tmp_path):
    with pytest.raises(ValueError):
        S.replay(spark, str(tmp_path), "a int", files_per_trigger=0)


def test_generated_events_and_flows(spark):
    cfg = g.Config()
    t = g.telemetry(spark, cfg)
    kinds = {(r.kind, r.detail): r.n for r in g.events(t).groupBy("kind", "detail").agg(F.count("*").alias("n")).collect()}
    assert kinds[("SyslogEvent", "policy differs from the golden baseline")] == 1 and kinds[("RoutingEvent", "adjacency_down")] > 0
    f = g.flows(t, cfg)
    assert f.select("us").distinct().count() == 31 and f.agg(F.min("bytes")).first()[0] >= 100_000
    quiet = g.events(g.telemetry(spark, g.Config(scenarios=())))
    assert quiet.where("detail <> 'IKE rekey early'").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from tidemark import cli

    assert cli.parser().parse_args(["demo", "--scenarios", "a,D"]).scenarios == ("congestion", "policy_drift")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["demo", "--scenarios", "x"])
    assert cli.main(["generate", "--duration", "60", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o/telemetry")).count() == g.streams(spark).count() * 7
    assert cli.main(["stream", "--duration", "20", "--limit", "3"]) == 0
    assert capsys.readouterr().out.count("TelemetryRecord") >= 3


def test_corpus_and_topology_files(spark, tmp_path):
    from tidemark.sources import corpus

    (tmp_path / "a.md").write_text("---\ntitle: Link full\nissue_type: interface_congestion\n---\n# Symptoms\nutil rises\n# Fix\nreroute\n")
    (tmp_path / "i").mkdir()
    (tmp_path / "i/x.json").write_text('{"incident_id": "X", "issue_type": "policy_drift", "summary": "drift"}')
    (tmp_path / "t").mkdir()
    (tmp_path / "t/topology.json").write_text('{"nodes": [{"id": "s:a", "site": "s", "criticality": 0.9}], "edges": [{"src": "s:a", "dst": "s:b"}, {"u": "s:b", "v": "z:c", "directed": true}]}')
    md = corpus.markdown_chunks(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [m.metadata["section"] for m in md] == ["Symptoms", "Fix"] and md[0].text.startswith("[Link full — Symptoms]")
    assert corpus.filtered(corpus.json_chunks(spark, str(tmp_path / "i"), "incident"), issue_type="policy_drift").count() == 1
    nodes, edges = corpus.topology(spark, str(tmp_path / "t"))
    assert {r.id: r.criticality for r in nodes.collect()} == {"s:a": 0.9, "s:b": 0.5, "z:c": 0.5}
    assert {tuple(r) for r in edges.collect()} == {("s:a", "s:b"), ("s:b", "s:a"), ("s:b", "z:c")}
    assert corpus.markdown_chunks(spark, str(tmp_path / "none")).count() == 0


def test_alert_stream(spark, tmp_path):
    rows = [("e", f"2025-01-01 00:0{i // 6}:{i % 6}0", ["d:m", "d:n"] if i in (1, 2, 9) else []) for i in range(12)]
    df = spark.createDataFrame(rows, "entity string, ts string, triggered array<string>").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "f"))
    S.ready(spark)
    out = S.drain(S.alerts(S.replay(spark, str(tmp_path / "f"), df.schema)), "alerts_test").collect()
    assert len(out) == 2 and {r.detector for r in out} == {"d"}


def test_sink_is_exactly_once(spark, tmp_path):
    df = spark.range(10)
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    for _ in range(2):
        q = S.to_batches(S.replay(spark, str(tmp_path / "src"), df.schema), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
