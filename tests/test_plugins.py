"""Registries, errors of packets, drop rates, exports and layers."""

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from packetlake.operators import decoders, plugins, reports, store
from packetlake.sources.pcap import with_protocol
from packetlake.streaming import live
from tests.test_capture import frame, load, question, sip_message


def test_decoders_and_rules_are_enabled_in_order(spark, tmp_path):
    packets = load(spark, tmp_path, [(0, frame("10.0.0.1", "8.8.8.8", 1000, 53, question("a.b.c", 1))), (1, frame("10.0.0.1", "10.0.0.2", 5060, 5060, sip_message("INVITE sip:b@x SIP/2.0", "c1")))])
    registry = plugins.protocol_registry()
    for name, _ in registry.listed():
        if name not in ("dns", "sip"):
            registry.disable(name)
    assert registry.names() == ["sip", "dns"] and {r.type for r in registry.run(packets).collect()} == {"SIP", "DNS"}
    registry.register("dns", lambda p: decoders.dns(p).withColumn("type", F.lit("NAMES")), first=True)
    assert registry.names() == ["dns", "sip"] and {r.type for r in registry.run(packets).collect()} == {"SIP", "NAMES"}
    registry.disable("sip")
    registry.disable("dns")
    with pytest.raises(ValueError, match="nothing is enabled"):
        registry.run(packets)
    registry.enable("sip")
    assert registry.names() == ["sip"]
    with pytest.raises(KeyError):
        registry.enable("morse")
    rules = plugins.rule_registry()
    assert len(rules.names()) == 39 and len(rules.listed()) == 45
    rules.enable("pdu_session_flood")
    assert "pdu_session_flood" in rules.names()


def test_what_can_not_be_decoded_becomes_an_event(spark, tmp_path):
    rows = [frame("10.0.0.1", "8.8.8.8", 1000, 53, b"\0" * 5), frame("10.0.0.1", "8.8.8.8", 1000, 53, question("a.b.c", 1)), frame("10.0.0.1", "8.8.8.8", 1000, 8805, b"\x21"), frame("10.0.0.1", "8.8.8.8", 1000, 9999, b"\x21")]
    packets = decoders.with_errors(with_protocol(load(spark, tmp_path, [(i, f) for i, f in enumerate(rows)])))
    found = {r.frame_number: r for r in live.packet_events(packets).collect()}
    assert found.keys() == {1, 3} and found[1].title == "DNS message can't be decoded" and found[1].severity == "warning" and found[1].protocol == "DNS"


def test_drop_rates_of_agents(spark):
    rows = [("a", 90, 900, 10, "2024-01-01 00:00:10"), ("a", 10, 100, 0, "2024-01-01 00:00:50"), ("a", 0, 0, 0, "2024-01-01 00:01:01"), ("b", 1, 10, 2, "2024-01-01 00:00:00"), ("b", 0, 0, 5, None)]
    df = spark.createDataFrame(rows, "agent_id string, packets long, bytes long, dropped long, at string").withColumn("timestamp", F.to_timestamp("at"))
    assert sorted((r.agent_id, r.packets, r.dropped, r.drop_pct) for r in live.drop_rates(df).collect()) == [("a", 0, 0, 0.0), ("a", 100, 10, 9.09), ("b", 1, 2, 66.67)]


def test_calls_as_csv(spark, tmp_path):
    calls = spark.createDataFrame([(1, "c1", 'a "x", y', "b", "2024-01-01 00:00:00", "2024-01-01 00:00:01.5", 4.1, "Good", "normal", "", 0.5)], "job_id long, call_id string, from_uri string, to_uri string, s string, e string, mos double, quality string, end_type string, root_cause string, confidence double")
    calls = calls.withColumns({"start_time": F.col("s").cast("timestamp_ntz"), "end_time": F.col("e").cast("timestamp_ntz")}).drop("s", "e")
    legs = spark.createDataFrame([(1, "c1", 3.0, 4), (1, "c1", 0.0, 7)], "job_id long, call_id string, jitter_ms double, max_seq_gap long")
    reports.write_calls_csv(calls, legs, f"{tmp_path}/cdr")
    (file,) = Path(tmp_path).glob("cdr/job_id=1/*.csv")
    head, row = csv.reader(file.read_text().replace('\\"', '""').splitlines())
    assert len(head) == 14 and head[0] == "call_id" and head[-1] == "confidence"
    assert row == ["c1", 'a "x", y', "b", "2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z", "1.50", "4.100", "Good", "3.00", "7", "0.00", "normal", "", "0.5000"]


def test_layers_of_a_packet(spark):
    df = spark.sql("""select 0L job_id, 7L frame_number, timestamp_ntz '2024-01-01 00:00:00' timestamp, 'a' src_ip, 'b' dst_ip, 1 src_port, 2 dst_port, 'UDP' protocol, 'DNS' app_protocol, 80L length,
      map('zone', repeat('z', 300), 'reply_code', 'NOERROR', 'query_name', 'x.y', 'a-b_c', '1', 'ttl', '64') metadata""")
    layers = store.layer_tree(df).first().layers
    assert [x.name for x in layers] == ["Frame 7", "Internet Protocol Version 4", "User Datagram Protocol", "Domain Name System"]
    assert [f.name for f in layers[3].fields] == ["Query Name", "Reply Code", "A B C", "Ttl", "Zone"] and layers[3].fields[4].value == "z" * 200 + "…" and layers[1].fields[3].value == "64"
    assert layers[0].fields[3].value == "eth:ip:udp:DNS" and len(store.layer_tree(df.withColumn("app_protocol", F.lit("UDP"))).first().layers) == 3
