"""Ended flows of a stream against the tracked flows of the whole capture."""

import random

import pytest

from packetlake.operators import tracker
from packetlake.sources.pcap import read_pcap, stream_pcap
from packetlake.streaming.flows import ended_flows
from tests.test_capture import frame, pcap


def traffic(seed=3, flows=6):
    """Connections with handshakes, pushed data, repeats and acknowledgements, closed or reset or left open; and datagrams."""
    rng, rows = random.Random(seed), []
    for k in range(flows):
        a, b, t = ("10.0.0.1", "10.0.0.2", 4000 + k, 80), ("10.0.0.2", "10.0.0.1", 80, 4000 + k), k * 1.5
        seq, ack, ttl = rng.choice([1, (1 << 32) - 30]), 100, 60
        rows += [(t, frame(*a, proto=6, flags=2, seq=(seq - 1) % (1 << 32), ttl=ttl)), (t + 0.02, frame(*b, proto=6, flags=18, seq=ack - 1, ack=seq, ttl=50))]
        for i in range(8):
            t += 0.3 + rng.random()
            data = bytes(rng.randrange(1, 60))
            rows.append((t, frame(*a, data, 6, 24, seq, ack, ttl)))
            if i % 3 == 2:
                rows.append((t + 0.05, frame(*a, data, 6, 24, seq, ack, ttl)))
            seq = (seq + len(data)) % (1 << 32)
            rows.append((t + 0.1, frame(*b, b"ok" if i % 2 else b"", 6, 24 if i % 2 else 16, ack, seq, 50)))
            ack += 2 * (i % 2)
        end = {0: 17, 1: 4}.get(k % 3)
        if end:
            rows.append((t + 0.4, frame(*(b if k % 2 else a), proto=6, flags=end, seq=ack if k % 2 else seq, ttl=50 - 20 * (k % 4 == 1))))
        rows += [(k + i * 0.9, frame("10.0.0.3", "10.0.0.4", 7000 + k, 53, bytes(20 + i))) for i in range(4)]
    return sorted(rows, key=lambda r: r[0])


def shown(rows):
    return sorted(str(sorted(r.asDict().items())) for r in rows)


COLUMNS = ["flow_id", "start_time", "end_time", "fwd_packets", "rev_packets", "fwd_bytes", "rev_bytes", "tcp_flags", "close_reason", "throughput_bps", "handshake_ms", "retransmissions", "loss_pct",
           "samples", "data_rtt_ms", "rst_authenticity", "rst_delta", "rst_reason", "trend", "rtt_ms", "sla_score", "sla_verdict"]


def wanted(spark, folder):
    return shown(tracker.track(read_pcap(spark, folder)).select(*COLUMNS).collect())


def drained(spark, spool, tmp_path, files):
    """All files of the spool so far, from the checkpoint on; rows are those that the sink has in all."""
    out = ended_flows(stream_pcap(spark, spool, files_per_batch=files)).select(*COLUMNS)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    return spark.read.parquet(f"{tmp_path}/out").collect()


@pytest.mark.parametrize("late", [False, True])
def test_each_flow_once_with_the_values_of_the_whole_capture(spark, tmp_path, late):
    rows = traffic()
    whole, spool = tmp_path / "whole", tmp_path / "spool"
    whole.mkdir()
    spool.mkdir()
    (whole / "x.pcap").write_bytes(pcap(rows))
    if late:  # some packets come up to 8 seconds later than those after them
        rng = random.Random(1)
        rows = [r for _, r in sorted((r[0] + rng.random() * 8, r) for r in rows)]
    third = len(rows) // 3
    for k in range(2):
        (spool / f"{k}.pcap").write_bytes(pcap(rows[k * third : (k + 1) * third]))
    first = drained(spark, str(spool), tmp_path, 1)
    (spool / "2.pcap").write_bytes(pcap(rows[2 * third :]))
    (spool / "3.pcap").write_bytes(pcap([(500, frame("9.9.9.9", "8.8.8.8", 1, 2, b"x"))]))  # time goes on
    (spool / "4.pcap").write_bytes(pcap([(900, frame("9.9.9.9", "8.8.8.7", 1, 2, b"x"))]))
    second = [r for r in drained(spark, str(spool), tmp_path, 1) if "9.9.9.9" not in r.flow_id]
    assert len(first) < len(second) and shown(second) == wanted(spark, str(whole))


def test_idle_flows_end_and_new_connections_start(spark, tmp_path):
    a, b = ("10.0.0.1", "10.0.0.2", 1, 2), ("10.0.0.1", "10.0.0.2", 3, 80)
    rows = [(0, frame(*a, b"x")), (59, frame(*a, b"y")), (130, frame(*a, b"z")), (131, frame(*b, proto=6, flags=2)), (132, frame(*b, proto=6, flags=17)), (132.5, frame(*b, proto=6, flags=2)), (133, frame(*b, proto=6, flags=16))]
    (tmp_path / "x.pcap").write_bytes(pcap(rows))
    found = ended_flows(read_pcap(spark, str(tmp_path))).orderBy("start_time").collect()
    assert [(r.port_a, r.fwd_packets, r.close_reason) for r in found] == [(1, 2, None), (1, 1, None), (3, 2, "FIN"), (3, 2, "timeout")]
