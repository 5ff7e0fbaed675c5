"""Lines of a job: details of flows, limits, nulls; orders of small tables."""

from datetime import datetime, timedelta

from packetlake.operators import context, reports, store

START = datetime(2024, 5, 1, 10)
FLOWS = "job_id long, flow_id string, type string, src_ip string, dst_ip string, is_error boolean, message_type string, jitter_ms double, details map<string,string>"
CALLS = "job_id long, call_id string, from_uri string, to_uri string, mos double, quality string, end_type string, root_cause string, duration_sec double"
EVENTS = "job_id long, event_id long, timestamp timestamp_ntz, severity string, protocol string, title string, description string"
PACKETS = "job_id long, frame_number long, timestamp timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, app_protocol string"


def tables(spark, flows=(), calls=(), events=(), packets=()):
    return [spark.createDataFrame(list(rows), schema) for rows, schema in ((flows, FLOWS), (calls, CALLS), (events, EVENTS), (packets, PACKETS))]


def shown(lines):
    return [(r.section, r.line) for r in lines.orderBy("place", "section", "line").collect()]


def test_fields_of_flows_come_from_columns_and_details(spark):
    flows = [
        (1, "r", "RTP", "a", "b", None, None, 12.0, {"ssrc": "7"}),
        (1, "g", "GTP", "a", "b", True, "Create Session Request", None, {"apn": "not this", "tai": "t", "rat_type": ""}),
        (1, "s", "SNMP", "a", "b", True, None, None, {"version": "v2c", "error_status": "noSuchName"}),
        (1, "t", "TCP", "a", "b", None, None, None, None),
        (1, "n", "SIP", "a", "b", None, None, None, None),
    ]
    got = shown(context.job_lines(*tables(spark, flows)))
    assert got == [
        ("SIP Flows", "- Flow n | a -> b"),
        ("RTP Flows", "- Flow r | a -> b | SSRC: 7 | Jitter: 12ms"),
        ("GTP Flows", "- Flow g | a -> b | MessageType: Create Session Request | TAI: t | ERROR"),
        ("SNMP Flows", "- Flow s | a -> b | Version: v2c | ERROR: noSuchName"),
        ("Summary", "- Total Calls: 0"), ("Summary", "- Total Events: 0"), ("Summary", "- Total Flows: 5"), ("Summary", "- Total Packets: 0"),
    ]


def test_limits_are_by_job_and_nulls_are_empty(spark):
    events = [(j, i, START + timedelta(seconds=i), "error", "DNS", f"t{i}", None) for j in (1, 2) for i in range(5)]
    packets = [(1, i, START, "a", "b", 1, None, "UDP", "DNS" if i % 2 else "") for i in range(5)] + [(1, 9, START, None, "b", None, 2, None, None)]
    calls = [(2, "c", None, None, None, None, None, None, None)]
    got = context.job_lines(*tables(spark, (), calls, events, packets), n_events=2, n_packets=3).cache()
    assert shown(got.where("job_id = 1 and place < 16")) == [
        ("Events/Alerts", "- [error] DNS: t3 - "), ("Events/Alerts", "- [error] DNS: t4 - "),
        ("DNS Packets (1 total)", "- Frame #1 [2024-05-01T10:00:00] a:1 -> b:0 | DNS"),
        ("UDP Packets (2 total)", "- Frame #0 [2024-05-01T10:00:00] a:1 -> b:0 | UDP"), ("UDP Packets (2 total)", "- Frame #2 [2024-05-01T10:00:00] a:1 -> b:0 | UDP"),
    ]
    assert ("Calls", "- Call c | From:  | To:  | MOS: 0.000 | Quality:  | EndType:  | RootCause: ") in shown(got.where("job_id = 2"))
    assert context.job_lines(*tables(spark)).count() == 0


def test_report_of_nothing(spark):
    flows = spark.createDataFrame([], "type string, start_time timestamp_ntz, end_time timestamp_ntz, packets long, status_code int, response string, is_error boolean, result_code long, reply_code string, setup_latency_ms double, latency_ms double, cause_code long")
    rows = {(r.section, r.name): (r.value, r.note) for r in reports.report(flows, tables(spark)[1]).collect()}
    assert rows["totals", "flows"] == rows["totals", "seconds"] == rows["totals", "calls"] == rows["calls", "success"] == rows["calls", "avg_mos"] == (0.0, "")
    assert rows["kpi", "DNS Success Rate"] == (100.0, "good") and not any(s in ("protocol", "cause") for s, _ in rows)


def test_small_tables_have_an_order(spark):
    runs = spark.createDataFrame([(1, 5, "a"), (2, 9, "b"), (3, 9, "a")], "id long, started_at long, status string")
    assert [r.id for r in store.listed(runs, "capture_sessions").collect()] == [2, 3, 1]
    assert [r.id for r in store.listed(runs, "capture_sessions", status="a", limit=1).collect()] == [3]
    legs = spark.createDataFrame([(2, "c", 1), (1, "c", 2), (1, "c", 1), (1, "d", 1)], "job_id long, call_id string, leg long")
    full = legs.selectExpr("*", *[f"cast(null as string) as {c}" for c in ("src_ip", "src_port", "dst_ip", "dst_port", "ssrc", "packet_count", "jitter_ms", "max_seq_gap", "start_time", "end_time")])
    assert [(r.job_id, r.leg) for r in store.legs_of_call(full, "c").collect()] == [(1, 1), (1, 2), (2, 1)]
