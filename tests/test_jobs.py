"""Processing of jobs under manifests, and counters of runs."""

import time

import pytest
from pyspark.sql import functions as F

from packetlake.operators import correlate, detect, jobs
from packetlake.sources.pcap import read_pcap, stream_pcap, with_protocol
from packetlake.streaming.metrics import RunMetrics, exposition
from tests.test_capture import frame, pcap, question

SOME = {"flows": lambda flows: flows, "alerts": lambda flows: detect.run(flows, ["dns_errors"]), "calls": correlate.calls_from_flows}


def packets(spark, folder, n, job):
    folder.mkdir(exist_ok=True)
    (folder / "x.pcap").write_bytes(pcap([(i, frame("10.0.0.1", "8.8.8.8", 1000 + i, 53, question("a.b.c", i + 1))) for i in range(n)]))
    return read_pcap(spark, str(folder), job)


def test_a_failed_run_leaves_the_whole_run_before(spark, tmp_path):
    path = f"{tmp_path}/store"
    jobs.process(packets(spark, tmp_path / "a", 3, 1), path, SOME, ["dns"])
    jobs.process(packets(spark, tmp_path / "b", 2, 2), path, SOME, ["dns"])
    count = lambda table: {r.job_id: r["count"] for r in jobs.current(spark, path, table).groupBy("job_id").count().collect()}
    assert count("flows") == count("alerts") == {1: 3, 2: 2}

    def killed(flows):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):  # after flows and alerts are written
        jobs.process(packets(spark, tmp_path / "c", 5, 1), path, SOME | {"calls": killed}, ["dns"])
    with pytest.raises(Exception, match="broken"):  # within a write
        jobs.process(packets(spark, tmp_path / "c", 5, 1), path, {"flows": lambda f: f.withColumn("type", F.raise_error(F.lit("broken")))}, ["dns"])
    assert count("flows") == count("alerts") == {1: 3, 2: 2}
    assert len(jobs.clean(spark, path)) == 2 and jobs.clean(spark, path) == []
    run = jobs.process(packets(spark, tmp_path / "c", 5, 1), path, SOME, ["dns"])
    assert count("flows") == count("alerts") == {1: 5, 2: 2} and run in {r["run"] for r in jobs.manifest(spark, path)[1].values()}
    jobs.delete(spark, path, 2)
    assert count("flows") == {1: 5} and jobs.manifest(spark, path)[0] == 4
    with pytest.raises(ValueError, match="no job has a table nothing"):
        jobs.current(spark, path, "nothing")


def test_counters_of_a_batch_and_of_a_stream(spark, tmp_path):
    for k in range(3):
        (tmp_path / "spool").mkdir(exist_ok=True)
        (tmp_path / "spool" / f"{k}.pcap").write_bytes(pcap([(60 * k + i, frame("10.0.0.1", "8.8.8.8", 1000 + i, 53 if i % 2 else 9999, question("a.b.c", i + 1))) for i in range(6)]))
    metrics = RunMetrics(spark, ("app_protocol=DNS",))
    whole = with_protocol(read_pcap(spark, f"{tmp_path}/spool"))
    metrics.watch(whole, "packets").write.format("noop").mode("overwrite").save()
    size = whole.agg(F.sum("length")).first()[0]
    assert metrics.totals() == {"packets": {"rows": 18, "bytes": size, "app_protocol=DNS": 9}}
    watched = metrics.watch(with_protocol(stream_pcap(spark, f"{tmp_path}/spool", files_per_batch=1)), "live")
    for _ in range(2):  # started again, it counts nothing twice
        query = watched.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(60)
    for _ in range(50):  # listeners are told a little later
        if metrics.totals().get("live", {}).get("rows") == 18:
            break
        time.sleep(0.2)
    assert metrics.totals()["live"] == {"rows": 18, "bytes": size, "app_protocol=DNS": 9}
    assert 'packetlake_live_total{counter="rows"} 18\n' in exposition(metrics.totals())
    spark.streams.removeListener(metrics)
