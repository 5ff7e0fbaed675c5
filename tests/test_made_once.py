"""Packets of a stream are made, carried and walked once."""

import struct

from packetlake.operators import decoders, reassembly
from packetlake.plans.wire_queries import exchanges
from tests.test_capture import frame, load

SF = "/root/testdata/sf0.001"


def command(n, size=0):
    return b"\x01" + (20 + size).to_bytes(3, "big") + b"\x80" + (316).to_bytes(3, "big") + struct.pack(">III", 16777251, n, n) + bytes(size)


def test_packets_in_two_jobs_are_made_from_one_reading_each(spark):
    made = exchanges()["diameter_pairs"][0](spark.read.parquet(f"{SF}/events.parquet"))
    plan = reassembly.with_messages(made)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 2  # packets that are reassembled, and others
    assert not [line for line in plan.toString().splitlines() if "Generate" in line and "unhex" in line]  # what payloads share is evaluated once


def test_what_no_decoder_reads_is_not_carried(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(decoders, "stored", lambda df: seen.append(df.columns) or df)
    packets = load(spark, tmp_path, [(0, frame("10.0.0.1", "10.0.0.2", 5000, 3868, command(1), 6, 24, 1))])
    assert decoders.decode(packets, ["diameter", "transport"]).count() == 2
    monkeypatch.setitem(decoders.DECODERS, "hops", lambda p: decoders.conform(p.withColumn("cause_code", p.ttl)))
    assert [r.cause_code for r in decoders.decode(packets, ["hops"]).collect()] == [packets.first().ttl]
    assert not set(seen[0]) & {"length", "ack", "flags", "ttl", "ip_id"} and set(packets.columns) - {"raw_packet"} < set(seen[1])


def test_messages_over_batches_are_those_of_one(spark, tmp_path):
    rows = []
    for port in range(5000, 5006):
        data = b"lost" + b"".join(command(n, 4 * n) for n in range(12))
        rows += [(k / 100, frame("10.0.0.1", "10.0.0.2", port, 3868, data[k : k + 31], 6, 24, 1 + k)) for k in range(0, len(data), 31) if k != 31 * (port - 5000)]  # a gap in each but one
    packets = load(spark, tmp_path, rows).cache()
    found = {}
    for size in (1, 2, 5, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            found[size] = sorted(map(str, reassembly.messages(packets).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found[1]) > 60 and all(x == found[1] for x in found.values())
