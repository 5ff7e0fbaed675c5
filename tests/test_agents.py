"""Frames of agents: the codec, sessions over several files, streams that are started again."""

import base64

import pytest

from packetlake.sources import agents
from packetlake.streaming import live
from tests.test_capture import T0, frame, question

GREETING = {"version": "1", "agent": {"id": "a1", "hostname": "edge", "iface": "eth0"}, "can_compress": True, "link_type": 1}


def batch(k, n=3, agent="a1", drops=0):
    frames = [frame("10.0.0.1", "8.8.8.8", 1000 + k, 53, question("a.b.c", i)) for i in range(n)]
    return {"agent_id": agent, "seq": k, "drops": drops, "packets": [{"ts_ns": int((T0 + k + i / 10) * 1e9), "cap_len": len(f), "len": len(f) + 4, "link_type": 1, "data": base64.b64encode(f).decode()} for i, f in enumerate(frames)]}


def session(batches, compress=True):
    return agents.encode(GREETING) + b"".join(agents.encode(b, compress and k % 2 == 0) for k, b in enumerate(batches))


def spooled(folder, name, data, cuts):
    folder.mkdir(exist_ok=True)
    edges = [0, *cuts, len(data)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        (folder / f"{name}.{k}").write_bytes(data[a:b])
    return str(folder)


def test_codec():
    assert agents.decode(agents.encode({"a": 1})[4:]) == agents.decode(agents.encode({"a": 1}, True)[4:]) == {"a": 1}
    for bad in (b"", b"{", b"[1]", b"x\x9cnot compressed", agents.encode({"a": 1}, True)[4:-3], b"\xff\xfe"):
        with pytest.raises(ValueError):
            agents.decode(bad)


@pytest.mark.parametrize("part", ["1", "100000000"])
def test_sessions_over_files_in_any_parts(spark, tmp_path, part):
    data = session([batch(k, k) for k in range(5)])
    path = spooled(tmp_path / "s", "one", data, [2, 90, 91, 400, len(data) - 1])
    spooled(tmp_path / "s", "two", session([batch(9, 2, "a2", 7)], False), [])
    rows = agents.read_agents(spark, path, partBytes=part)
    assert sorted((r.session, r.seq, r.dropped, len(r.packets), r.agent_id, r.agent_host, r.interface, r.error) for r in rows.collect()) == [("one", k, 0, k, "a1", "edge", "eth0", None) for k in range(5)] + [("two", 9, 7, 2, "a2", "edge", "eth0", None)]
    found = agents.packets(rows).orderBy("job_id", "frame_number").collect()
    assert len(found) == 12 and len({(r.job_id, r.frame_number) for r in found}) == 12 and {r.src_port for r in found if r.agent_id == "a1"} == {1001, 1002, 1003, 1004}
    one = [r for r in found if r.agent_id == "a1"]
    assert [r.timestamp for r in one] == sorted(r.timestamp for r in one) and {r.agent_host for r in found} == {"edge"} and one[0].length == len(one[0].raw_packet)
    totals = {r.agent_id: (r.packets, r.dropped) for r in live.agent_totals(agents.totals(rows)).collect()}
    assert totals == {"a1": (10, 0), "a2": (2, 7)}


def test_broken_frames_are_listed_and_the_others_read(spark, tmp_path):
    bad = (5).to_bytes(4, "big") + b"{oops"
    path = spooled(tmp_path / "s", "one", agents.encode(GREETING) + bad + agents.encode({"agent_id": "a1", "seq": 3, "packets": [{"data": "AA=="}]}) + agents.encode(batch(1)), [])
    spooled(tmp_path / "s", "large", agents.encode(GREETING) + agents.encode(batch(1)) + (agents.LARGEST + 1).to_bytes(4, "big") + agents.encode(batch(2)), [])
    spooled(tmp_path / "s", "empty", bytes(4) + agents.encode(batch(2)), [])
    spooled(tmp_path / "s", "cut", agents.encode(GREETING) + agents.encode(batch(4))[:-5], [])
    rows = agents.read_agents(spark, path)
    assert sorted((r.session, r.error.split(":")[0]) for r in agents.broken(rows).collect()) == [("empty", "empty message"), ("large", "message too large"), ("one", "'ts_ns'"), ("one", "Expecting property name enclosed in double quotes")]
    assert sorted((r.session, r.seq) for r in rows.where("error is null").collect()) == [("large", 1), ("one", 1)]


def test_a_stream_goes_on_within_a_frame(spark, tmp_path):
    data, path = session([batch(k) for k in range(6)]), str(tmp_path / "s")
    cut = len(session([batch(k) for k in range(3)])) - 7  # within the third batch
    (tmp_path / "s").mkdir()

    def drained():
        query = agents.packets(agents.stream_agents(spark, path)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.job_id, r.frame_number) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (tmp_path / "s" / "one.0").write_bytes(data[:cut])
    assert len(drained()) == 6
    (tmp_path / "s" / "one.1").write_bytes(data[cut : cut + 3])
    assert len(drained()) == 6
    (tmp_path / "s" / "one.2").write_bytes(data[cut + 3 :])
    (tmp_path / "s" / "two.5").write_bytes(session([batch(1)]))
    whole = drained()
    assert whole == sorted((r.job_id, r.frame_number) for r in agents.packets(agents.read_agents(spark, path)).collect()) and len(whole) == 21
