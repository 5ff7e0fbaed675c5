"""Streams of captures against the same measures in batch, and changes to tables."""

from collections import Counter

from packetlake.operators import lifecycle
from packetlake.sources.pcap import read_pcap, stream_pcap, with_protocol
from packetlake.streaming import live
from tests.test_capture import frame, pcap, question


def spool(folder):
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.pcap").write_bytes(pcap([(60 * k + i / 2, frame("10.0.0.1", "8.8.8.8", 10000 + i, 53 if i % 2 else 9999, question("a.b.c", i + 1))) for i in range(6)]))
    return str(folder)


def drained(df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
    query.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def test_streamed_rates_are_those_of_the_batch_up_to_the_watermark(spark, tmp_path):
    path = spool(tmp_path / "spool")
    whole = {tuple(r) for r in live.rates(read_pcap(spark, path)).collect()}
    seen = {tuple(r) for r in drained(live.rates(stream_pcap(spark, path, files_per_batch=1)), "rates", "append", tmp_path)}
    last = max(r[1] for r in whole)
    assert len(whole) == 9
    assert {r for r in whole if (last - r[1]).total_seconds() > 15} <= seen <= whole


def test_streamed_totals(spark, tmp_path):
    path = spool(tmp_path / "spool")
    rows = drained(live.protocol_totals(with_protocol(stream_pcap(spark, path))), "totals", "complete", tmp_path)
    assert [tuple(r) for r in rows] == [("DNS", 9)]


def test_batches_written_again_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 6)], "job_id long, x long")
    write = live.batch_writer(f"{tmp_path}/out", "job_id")
    write(df, 0), write(df, 0), write(df.where("x = 5"), 1)
    assert Counter(r.x for r in spark.read.parquet(f"{tmp_path}/out").collect()) == {5: 2, 6: 1}


def test_agents_and_errors(spark):
    agents = spark.createDataFrame([("a", 5, 50, 0, "2024-01-01 00:00:00"), ("a", 5, 50, 1, "2024-01-01 00:00:50"), ("b", 1, 1, 0, "2024-01-01 00:00:01")], "agent_id string, packets long, bytes long, dropped long, timestamp string")
    found = live.with_staleness(live.agent_totals(agents), "2024-01-01 00:01:00").collect()
    assert {(r.agent_id, r.packets, r.dropped, r.is_stale) for r in found} == {("a", 10, 1, False), ("b", 1, 0, True)}
    packets = spark.createDataFrame([(1, "t", "DNS", 4, ["x", "y"]), (1, "t", "DNS", 5, None)], "job_id long, timestamp string, app_protocol string, frame_number long, errors array<string>")
    assert [r.title for r in live.packet_events(packets).collect()] == ["x", "y"]


def test_changes_to_tables(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "job_id long, k long, v long")
    stored, incoming = rows((1, 1, 1), (2, 2, 2)), rows((1, 1, 9), (1, 1, 10), (3, 3, 3))
    assert {tuple(r) for r in lifecycle.upserted(stored, incoming, "job_id", "k", order="v").collect()} == {(1, 1, 10), (2, 2, 2), (3, 3, 3)}
    assert [r.job_id for r in lifecycle.new_rows(stored, incoming, "job_id", "k").collect()] == [3]
    assert [r.job_id for r in lifecycle.without_jobs(stored, 1).collect()] == [2]
    lifecycle.replace_jobs(stored, f"{tmp_path}/t")
    lifecycle.replace_jobs(rows((2, 7, 7)), f"{tmp_path}/t")
    assert {(r.job_id, r.k) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, 1), (2, 7)}
    states = spark.createDataFrame([(1, "running", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:00:00"), (2, "completed", "2024-01-01 00:10:00")], "job_id long, status string, changed_at string")
    assert {(r.job_id, r.status) for r in lifecycle.job_states(states, "2024-01-01 02:00:00").collect()} == {(1, "failed"), (2, "completed")}
