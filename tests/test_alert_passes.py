"""Rules read flows, whatever makes them, once."""

from packetlake.operators import detect

SCHEMA = "flow_id string, type string, src_ip string, dst_ip string, packets long, query_name string, method string, response string"
RULES = ["volume_spike", "sip_errors", "source_fan_out", "dns_query_flood", "dns_dga", "one_way_audio"]


def test_flows_are_made_once_for_all_rules(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(str(i), ("SIP", "DNS", "RTP")[i % 3], "a", f"b{i}", 60, "abcdefghijklmnop.xyz" if i % 3 == 1 else None, "INVITE", "486") for i in range(60)]
    found = detect.run(spark.createDataFrame(rows, SCHEMA).mapInArrow(run, SCHEMA), RULES, texts=False).collect()
    counts = {n: sum(r.rule == n for r in found) for n in RULES}
    assert counts == {"volume_spike": 0, "sip_errors": 20, "source_fan_out": 1, "dns_query_flood": 1, "dns_dga": 20, "one_way_audio": 20}
    assert made.value == len(rows)
    assert "facts" not in found[0] and "description" not in found[0]


def test_sums_are_made_of_the_kinds_that_read_them(spark):
    rows = [("1", "SIP", "a", "b", 3, None, None, None), ("2", "SIP", "a", None, 4, None, None, None), ("3", "DNS", None, "b", 5, "x.y", None, None)]
    found = detect.counted(spark.createDataFrame(rows, SCHEMA), ["all", "source", "query"], only={"source": ["packets"]}).collect()
    assert sorted((r.kind, r.key, r.n, r.subs, r.packets) for r in found) == [("all", "", 3, 0, None), ("query", "x.y", 1, 0, None), ("source", "a", 2, 1, 7)]
