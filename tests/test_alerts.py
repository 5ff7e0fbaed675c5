"""Descriptions and metadata of the alerts that the query of texts leaves out."""

from datetime import datetime, timedelta

from packetlake.operators import detect
from packetlake.operators.alert_texts import DESCRIPTIONS, METADATA

START = datetime(2024, 5, 1, 10)
SCHEMA = "flow_id string, type string, src_ip string, src_port int, dst_ip string, dst_port int, start_time timestamp_ntz, end_time timestamp_ntz, packets long, method string, response string, end_type string, query_name string, answers array<string>, rst_authenticity string, details map<string,string>"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def flow(**values):
    row = {"flow_id": "f", "type": "SIP", "src_ip": "10.0.0.1", "src_port": 5060, "dst_ip": "10.0.0.2", "dst_port": 5060, "start_time": START, "end_time": START + timedelta(seconds=5), "packets": 1, **values}
    return tuple(row.get(n) for n in NAMES)


def alerts(spark, rows, *rules, **settings):
    found = detect.run(spark.createDataFrame(rows, SCHEMA), list(rules), **settings)
    assert found.columns == ["rule", "severity", "protocol", "title", "description", "flow_id", "subject", "value", "metadata"]
    return sorted((r.description, r.metadata) for r in found.collect())


def test_resets_and_dropped_calls(spark):
    rows = [
        flow(flow_id="t", type="TCP", rst_authenticity="suspicious", details={"rst_reason": "ttl jump", "rst_delta": "20"}),
        flow(flow_id="c", method="INVITE", response="200 OK", end_type="BYE"),
        flow(flow_id="d", method="INVITE", response="486 Busy Here"),
    ]
    texts = alerts(spark, rows, "suspicious_rst", "call_drop")
    assert texts[0] == ("SIP call c terminated with BYE after 5.0s — possible call drop or failed handoff", {"end_type": "BYE", "duration_ms": "5000"})
    assert texts[1] == ("SIP call d returned 486 Busy Here (Busy Here) — call not established", {"sip_response": "486 Busy Here", "reason": "Busy Here"})
    assert texts[2][0].startswith("TCP connection 10.0.0.1:5060 -> 10.0.0.2:5060 was closed by an RST") and "(ttl jump)" in texts[2][0]
    assert texts[2][1] == {"rst_ttl": "", "rst_ttl_baseline": "", "rst_ttl_delta": "20", "reason": "ttl jump", "attack_type": "injected_rst"}


def test_hijacked_calls_and_odd_names(spark):
    rows = [flow(flow_id="c", method="INVITE", response="200 OK"), flow(flow_id="c", method="BYE", src_ip="6.6.6.6", start_time=START + timedelta(seconds=9))]
    assert alerts(spark, rows, "sip_hijack") == [
        ("SIP BYE for call c sent from 6.6.6.6 — not a participant (original: 10.0.0.1 ↔ 10.0.0.2)", {"hijack_ip": "6.6.6.6", "original_src": "10.0.0.1", "original_dst": "10.0.0.2", "method": "BYE", "attack_type": "sip_call_hijack"})
    ]
    [(text, metadata)] = alerts(spark, [flow(type="DNS", query_name="abcdefghijklmnop.xyz")], "dns_dga")
    assert text == "Domain abcdefghijklmnop.xyz shows DGA/C2 indicators (score=7): high entropy label (4.00 bits); suspicious TLD (.xyz); long label (16 chars); queried only once (DGA pattern)"
    assert metadata == {"domain": "abcdefghijklmnop.xyz", "label": "abcdefghijklmnop", "entropy": "4.0", "tld": "xyz", "dga_score": "7", "query_count": "1", "attack_type": "dns_c2"}
    [(text, metadata)] = alerts(spark, [flow(type="DNS", query_name="a.b.com", answers=[f"9.9.9.{i}"], start_time=START + timedelta(seconds=i)) for i in range(5)], "dns_fast_flux")
    assert text == "Domain b.com resolved to 5 different IPs — fast-flux botnet C2 pattern. Sample: 9.9.9.0, 9.9.9.4" and metadata["unique_ips"] == "5"


def test_bursts_and_volumes(spark):
    rows = [flow(flow_id=str(i), start_time=START + timedelta(seconds=i)) for i in range(9)] + [flow(flow_id="x", packets=90) for _ in range(20)]
    assert alerts(spark, rows, "traffic_burst", traffic_burst={"times": 2}) == [("At 2024-05-01T10:00:00Z: 21 flows started (avg 3.2/sec), >2x average rate", {})]
    texts = alerts(spark, [flow(packets=1) for _ in range(99)] + [flow(flow_id="big", packets=901)], "volume_spike")
    assert texts == [("SIP flow big has 901 packets (avg 10), >10x average", {})]
    assert alerts(spark, [flow(packets=None, response=None)], "volume_spike", "sip_errors", "traffic_burst") == []


def test_every_rule_has_texts():
    assert set(detect.RULES) <= set(DESCRIPTIONS) and set(METADATA) <= set(DESCRIPTIONS)
