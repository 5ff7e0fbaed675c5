"""Operators whose rules the SQL of the queries doesn't reach."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from packetlake.functions import quality as q
from packetlake.operators import detect, store, tracker, user_rules
from packetlake.operators.joins import interval_join

T0 = dt.datetime(2024, 1, 1)


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(9)
    make = lambda n, p: [(f"{p}{i}", rng.randrange(3), T0 + dt.timedelta(seconds=(s := rng.randrange(20_000))), T0 + dt.timedelta(seconds=s + int(10 ** rng.uniform(0, 7)))) for i in range(n)]
    a, b = make(60, "a"), make(60, "b")
    schema = "id string, job long, start_time timestamp_ntz, end_time timestamp_ntz"
    got = interval_join(spark.createDataFrame([*a, ("n", 0, None, T0)], schema), spark.createDataFrame(b, schema), 4, 5, ["job"])
    pairs = [(r.l_id, r.r_id) for r in got.collect()]
    pad = dt.timedelta(seconds=4)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] + pad and y[2] < x[3] + pad)
    assert sorted(pairs) == want and want
    for limit in (1, 7):  # all buckets, or some, are split
        assert sorted((r.l_id, r.r_id) for r in interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 4, 5, ["job"], pairs=limit).collect()) == want


def test_private_addresses(spark):
    ips = {"10.1.2.3": True, "172.15.0.1": False, "172.31.255.1": True, "192.168.1.1": True, "100.64.0.1": True, "100.63.0.1": False, "127.0.0.1": True, "8.8.8.8": False, "::1": True, "fd00::1": True, "fe80::1": True, "2001:db8::1": False, "nonsense": True, "300.1.1.1": True, "": True}
    df = spark.createDataFrame([(k,) for k in ips], "ip string")
    assert {r.ip: r.p for r in df.select("ip", store.is_private(F.col("ip")).alias("p")).collect()} == ips


def test_entropy_and_scores(spark):
    row = spark.range(1).select(
        q.entropy(F.lit("xk3mq9p2r7n5t8y")).alias("e"), q.entropy(F.lit("")).alias("none"), q.mos(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("best"), q.mos(F.lit(50.0), F.lit(0.0), F.lit(0.0)).alias("worst"),
        q.tcp_score(F.lit(0.0), F.lit(0.0)).alias("clean"), q.tcp_score(F.lit(10.0), F.lit(3.0)).alias("three"), q.tcp_score(F.lit(900.0), F.lit(50.0)).alias("bad"),
    ).first()
    assert row.e == pytest.approx(3.9069, abs=1e-4) and row.none == 0 and row.best == 4.428 and row.worst == 1.0
    assert (row.clean, row.three, row.bad) == (100, 70, 0)
    sweep = spark.range(0, 200).select(q.tcp_score(F.lit(20.0), F.col("id") / 10.0).alias("s"), "id").orderBy("id").collect()
    assert all(a.s >= b.s for a, b in zip(sweep, sweep[1:], strict=False))


PACKET = "frame_number long, timestamp timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, payload_len long, seq long, ack long, flags int, ttl int, ip_id int"


def packets(spark, *rows):
    """(ms, forward, flags, payload, seq, ack, ttl) of one TCP flow."""
    return spark.createDataFrame([(i, T0 + dt.timedelta(milliseconds=ms), *(("10.0.0.1", "10.0.0.2", 4000, 80) if f else ("10.0.0.2", "10.0.0.1", 80, 4000)), "TCP", n, s, a, fl, ttl, 1) for i, (ms, f, fl, n, s, a, ttl) in enumerate(rows)], PACKET)


@pytest.mark.parametrize(("ttls", "want"), [((64, 64), "genuine"), ((64, 40), "suspicious"), ((64, 62), "genuine"), ((None, 40), "unknown")])
def test_reset_authenticity(spark, ttls, want):
    rows = [(0, True, 2, 0, 1, 0, 50)] + ([(1, False, 18, 0, 1, 2, ttls[0])] if ttls[0] else []) + [(2, False, 4, 0, 2, 2, ttls[1]), (3, False, 4, 0, 2, 2, 99)]
    assert tracker.resets(packets(spark, *rows)).first().rst_authenticity == want


def test_a_flow_with_everything(spark):
    top = (1 << 32) - 50
    df = packets(
        spark, (0, True, 2, 0, top - 1, 0, 64), (10, False, 18, 0, 99, top, 64), (20, True, 24, 100, top, 100, 64), (30, True, 24, 100, 50, 100, 64), (35, True, 24, 100, 50, 100, 64),
        (60, False, 16, 0, 100, 150, 64), (80, True, 17, 0, 150, 100, 64),
    )
    r = tracker.track(df).first()
    assert (r.flow_id, r.fwd_packets, r.rev_packets, r.fwd_bytes, r.tcp_flags, r.close_reason) == ("flow-10.0.0.1:4000-10.0.0.2:80-TCP", 5, 2, 300, "SYN ACK PSH FIN", "FIN")
    assert (r.handshake_ms, r.retransmissions, r.loss_pct) == (20.0, 1, 14.29)
    assert r.samples == 3 and r.data_rtt_ms == pytest.approx(31.67) and r.rtt_ms == r.data_rtt_ms and r.trend == [2400.0]


def test_pings_either_way_are_one_flow(spark):
    rows = [(i, T0, a, b, 8, 0, "ICMP", 10, 0, 0, 0, 64, 1) for i, (a, b) in enumerate([("10.0.0.9", "10.0.0.1"), ("10.0.0.1", "10.0.0.9"), ("10.0.0.9", "10.0.0.1"), ("10.0.0.9", "10.0.0.3")])]
    got = {r.flow_id: r.fwd_packets + r.rev_packets for r in tracker.volumes(spark.createDataFrame(rows, PACKET)).collect()}
    assert got == {"flow-10.0.0.1:0-10.0.0.9:0-ICMP": 3, "flow-10.0.0.3:0-10.0.0.9:0-ICMP": 1}


def test_jitter_of_a_known_stream(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), "a", "b", 1, 2, 7, i, 160 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "frame_number long, timestamp timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, ssrc long, rtp_seq long, rtp_time long")
    assert tracker.rtp_jitter(df).first().jitter == pytest.approx(593.547, abs=1e-3)
    assert tracker.rtp_gaps(df).first().max_seq_gap == 1


def test_unusual_ports_count_repeats(spark):
    flows = [("SIP", "a", 1, "b", 2)] * 500 + [("SIP", "a", 1, "b", 3), ("SIP", "a", 1, "b", 5060), ("DNS", "a", 53, "b", 9)]
    df = spark.createDataFrame([(f"f{i}", *f, T0) for i, f in enumerate(flows)], "flow_id string, type string, src_ip string, src_port int, dst_ip string, dst_port int, start_time timestamp_ntz")
    assert sorted((r.title, r.value) for r in detect.unusual_port(df).collect()) == [("Unusual SIP Port (1 -> 2)", 500.0), ("Unusual SIP Port (1 -> 3)", 1.0)]


def test_streams_without_another_one_back(spark):
    rows = [("r1", "a", "b", 60), ("r2", "b", "a", 10), ("r3", "c", "d", 60), ("r4", "d", "c", 11), ("r5", "e", "e", 60), ("r6", "f", "f", 60), ("r7", "f", "f", 11), ("r8", "g", "g", 60), ("r9", "g", "g", 9), ("s1", "b", None, 99)]
    df = spark.createDataFrame([(i, "RTP" if i[0] == "r" else "SIP", a, b, n) for i, a, b, n in rows], "flow_id string, type string, src_ip string, dst_ip string, packets long")
    assert sorted(r.flow_id for r in detect.one_way_audio(df).collect()) == ["r1", "r5", "r8"]


def test_all_rules_read_the_flows_three_times(spark, tmp_path):
    rows = [(f"f{i}", ("SIP", "DNS", "RTP", "TCP")[i % 4], f"10.0.0.{i % 5}", f"10.0.1.{i % 60}", 60 + i, f"x{i % 3}.evil.top" if i % 4 == 1 else None, "BYE" if i % 8 == 0 else "INVITE", T0 + dt.timedelta(seconds=i)) for i in range(400)]
    spark.createDataFrame(rows, "flow_id string, type string, src_ip string, dst_ip string, packets long, query_name string, method string, start_time timestamp_ntz").write.parquet(f"{tmp_path}/flows")
    flows = spark.read.parquet(f"{tmp_path}/flows")
    found = detect.run(flows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/flows") <= 2  # and once for the counts, which are written before
    each = [r for n in detect.CORE for r in detect.RULES[n](flows).collect()]
    assert sorted(map(str, found.collect())) == sorted(map(str, each)) and len({r.rule for r in each}) >= 3


def test_user_rules_skip_what_they_do_not_know():
    for bad in ("{", "[]", '{"conditions": []}', '{"match": "any"}'):
        with pytest.raises(ValueError):
            user_rules.compile_rule(bad)


def test_user_rules_without_known_conditions(spark):
    row = spark.range(1).select(*[user_rules.compile_rule('{"match": "%s", "conditions": [{"field": "x", "operator": ">", "value": 1}]}' % m).alias(m) for m in ("all", "any", "some")]).first()
    assert (row["all"], row["any"], row["some"]) == (True, False, False)


def test_dispatch_by_severity(spark):
    found = spark.createDataFrame([("a", "info"), ("b", "error"), ("c", "critical")], "rule string, severity string")
    got = sorted((r.rule, r.target) for r in detect.dispatch(found, spark.createDataFrame([("all", "info"), ("few", "critical")], "name string, min_severity string")).collect())
    assert got == [("a", "all"), ("b", "all"), ("c", "all"), ("c", "few")]


def test_jitter_in_runs_is_that_of_the_whole_stream(spark):
    rows = [(i, i * 21 + (i * 7919) % 13, i * 160 % (1 << 32)) for i in range(5000)]
    df = spark.createDataFrame(rows, "frame_number long, ms long, rtp_time long").select(
        F.lit("a").alias("src_ip"), F.lit(1).alias("src_port"), F.lit("b").alias("dst_ip"), F.lit(2).alias("dst_port"), F.lit(7).alias("ssrc"), "frame_number", "rtp_time", F.timestamp_millis("ms").alias("timestamp")
    )
    j, every = 0.0, []
    for k, (_, ms, ticks) in enumerate(rows):
        d = abs((ms - rows[k - 1][1]) - (ticks - rows[k - 1][2])) if k else 0.0
        j += (d - j) / 16
        every.append(j)
    for run in (1024, 4096, 10_000):
        r = tracker.rtp_jitter(df, run).first()
        assert (r.jitter, r.jitter_min, r.jitter_max, r.jitter_avg) == pytest.approx((every[-1], min(every[1:]), max(every), sum(every) / (len(every) - 1)), abs=1e-3)  # the first packet makes no step
