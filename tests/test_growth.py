"""What queries pass on grows no faster than their input."""

from datetime import datetime, timedelta
from random import Random

from packetlake.operators import correlate, store
from packetlake.operators.joins import interval_join


def written(spark, df):
    """(rows of ``df``, records that its shuffles wrote)."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def records():
        context.listenerBus().waitUntilEmpty()
        none = gateway.jvm.java.util.ArrayList()
        stages = context.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    rows = df.collect()
    return rows, records() - before


FLOW = "job_id long, flow_id string, type string, src_ip string, src_port int, dst_ip string, dst_port int, media_ip string, media_port int, start_time timestamp_ntz, end_time timestamp_ntz, packet_loss_pct double, jitter_ms double"
T = datetime(2024, 1, 1)


def flow(flow_id, kind, src, dst=("z", 1), media=(None, None), at=0):
    return (1, flow_id, kind, *src, *dst, *media, T + timedelta(seconds=at), T + timedelta(seconds=at + 9), float(at % 7), float(at % 50))


def test_calls_dont_meet_the_streams_of_their_endpoint_one_by_one(spark):
    flows = spark.createDataFrame([flow(f"c{i}", "SIP", ("a", 5060), media=("m", 40000), at=i) for i in range(300)] + [flow(f"r{i}", "RTP", ("m", 40000), at=i) for i in range(300)], FLOW)
    members = spark.createDataFrame([], "job_id long, imsi string, flow_id string, type string, via string")
    rows, n = written(spark, correlate.ims_sessions(flows, members))
    assert len(rows) == 300 and {r.streams for r in rows} == {300}
    assert n < 300 * 300 / 4


def test_streams_at_several_endpoints_of_a_call_count_once(spark):
    random = Random(5)
    end = lambda: (f"m{random.randrange(3)}", 40000 + random.randrange(2))
    calls = [flow(f"c{random.randrange(25)}", "SIP", ("a", 5060), media=end() if random.random() < 0.9 else (None, None), at=i) for i in range(60)]
    streams = [flow(f"r{random.randrange(150)}", "RTP", end(), end(), at=random.randrange(3)) for i in range(200)]  # some differ in their ends only
    members = spark.createDataFrame([], "job_id long, imsi string, flow_id string, type string, via string")
    got = {r.call_id: (r.streams, r.start_time, r.end_time) for r in correlate.ims_sessions(spark.createDataFrame(calls + streams, FLOW), members).collect()}
    want = {}
    for name in {c[1] for c in calls}:
        own = [c for c in calls if c[1] == name]
        ends = {(c[7], c[8]) for c in own}
        met = {(s[1], *s[9:]) for s in streams if ends & {(s[3], s[4]), (s[5], s[6])}}
        want[name] = len(met), min([c[9] for c in own] + [m[1] for m in met]), max([c[10] for c in own] + [m[2] for m in met])
    assert got == want and any(n > 20 for n, _, _ in got.values())


def test_each_address_is_judged_once(spark):
    flows = spark.createDataFrame([(f"8.8.8.{i % 5}", "10.0.0.1") for i in range(50)], "src_ip string, dst_ip string")
    df = store.to_enrich(flows, spark.createDataFrame([("8.8.8.3",)], "ip string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    judged = next(i for i, line in enumerate(plan.splitlines()) if "RLIKE" in line)
    assert judged < next(i for i, line in enumerate(plan.splitlines()) if "Aggregate" in line)
    assert sorted(r.ip for r in df.collect()) == ["8.8.8.0", "8.8.8.1", "8.8.8.2", "8.8.8.4"]


def test_an_interval_stands_in_few_buckets(spark):
    def spans(name, n):
        return spark.createDataFrame([(f"{name}{i}", T + timedelta(seconds=1000 * i), T + timedelta(seconds=1000 * i + 75)) for i in range(n)], "id string, start_time timestamp_ntz, end_time timestamp_ntz")

    rows, n = written(spark, interval_join(spans("a", 300), spans("b", 300), 5, 10))
    assert sorted((r.l_id, r.r_id) for r in rows) == sorted((f"a{i}", f"b{i}") for i in range(300))
    assert n < 600 * 5


def test_members_are_dealt_to_more_tasks_as_flows_grow(spark, monkeypatch):
    ids = ", imsi string, msisdn string, apn string, ue_ip string, teid string"
    flows = spark.createDataFrame([(*flow(f"g{i}", "GTP", ("a", 2123), at=i), f"00101{i % 3}", None, None, None, None) for i in range(100)], FLOW + ids)
    monkeypatch.setattr(correlate, "ROWS", 10, raising=False)
    members = correlate.sessions(flows)
    assert members.count() == 100 and members.rdd.getNumPartitions() == 10
