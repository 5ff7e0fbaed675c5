"""Stored-table queries by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import store as s
from .catalog import named

named("top_talkers", """
SELECT ip, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets FROM (
  SELECT src_ip AS ip, sum(length) AS bytes, count(*) AS packets FROM v_packets GROUP BY 1 UNION ALL
  SELECT dst_ip, sum(length), count(*) FROM v_packets GROUP BY 1) GROUP BY ip ORDER BY bytes DESC, ip LIMIT 10
""", s.top_talkers, "packets")
named("packet_page", "SELECT * FROM v_packets WHERE app_protocol = 'DNS' AND src_ip = '10.0.0.3' ORDER BY frame_number LIMIT 50 OFFSET 1",
      lambda p: s.query_packets(p, app_protocol="DNS", src_ip="10.0.0.3", limit=50, offset=1), "packets")
named("packet_by_id", "SELECT * FROM v_packets WHERE frame_number = 77", lambda p: s.equal_to(p, frame_number=77), "packets")
named("packet_count", "SELECT count(*) AS packets FROM v_packets WHERE protocol = 'UDP' AND job_id = 2", lambda p: s.packet_count(p, 2, "UDP"), "packets")
named("protocol_counts", "SELECT app_protocol, count(*) AS packets FROM v_packets WHERE app_protocol <> '' GROUP BY 1", s.protocol_counts, "packets")
named("event_page", "SELECT * FROM v_events WHERE severity = 'error' AND protocol = 'SIP' ORDER BY timestamp DESC, event_id DESC LIMIT 100", lambda e: s.query_events(e, "error", "SIP"), "events")
named("stats_summary_sets", """
SELECT 'total' AS by, '' AS value, count(*) AS n FROM v_events UNION ALL SELECT 'protocol', protocol, count(*) FROM v_events GROUP BY 2
UNION ALL SELECT 'severity', severity, count(*) FROM v_events GROUP BY 2
""", s.stats_summary, "events")
named("bandwidth_1s", """
SELECT date_trunc('second', timestamp) AS timestamp, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, CAST(sum(length) * 8 AS DOUBLE) AS bps FROM v_packets GROUP BY 1
""", s.traffic_stats, "packets")
named("bandwidth_last_n", """
SELECT date_trunc('hour', timestamp) AS timestamp, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, CAST(sum(length) * 8 AS DOUBLE) / 3600 AS bps
FROM v_packets GROUP BY 1 ORDER BY 1 DESC LIMIT 30
""", lambda p: s.last_stats(s.traffic_stats(p, "1 hour"), 30), "packets")
named("call_entities_page", """
SELECT *, (SELECT count(*) FROM v_calls WHERE quality = 'good') AS total FROM v_calls WHERE quality = 'good' ORDER BY start_time DESC, call_id LIMIT 25 OFFSET 10
""", lambda c: s.list_calls(c, quality="good", limit=25, offset=10), "calls")
named("call_entities_job", "SELECT * FROM v_calls WHERE job_id = 1", lambda c: s.calls_of_job(c, 1), "calls")
named("call_by_id", "SELECT * FROM v_calls WHERE call_id = '7'", lambda c: s.call_by_id(c, "7"), "calls")
named("metrics_long", """
SELECT call_id, start_time AS timestamp, 'jitter_ms' AS metric, jitter_ms AS value FROM v_legs UNION ALL
SELECT call_id, start_time, 'packets', CAST(packet_count AS DOUBLE) FROM v_legs UNION ALL SELECT call_id, end_time, 'mos', mos FROM v_calls WHERE mos > 0
""", s.metrics_of_calls, "calls", "legs")
named("events_of_call", "SELECT * FROM v_events WHERE upper(protocol) = 'SIP' AND contains(description, 'call 12')", lambda e: s.events_of_call(e, "call 12", "sip"), "events")
named("callflow", """
SELECT row_number() OVER (ORDER BY part, timestamp, id) AS step, timestamp, id, type, detail FROM (
  SELECT 0 AS part, start_time AS timestamp, flow_id AS id, type, src_ip || ' -> ' || dst_ip AS detail FROM v_flows WHERE flow_id = '12' OR flow_id LIKE '12-%' UNION ALL
  SELECT 1, timestamp, CAST(event_id AS STRING), protocol, description FROM v_events WHERE contains(description, '12'))
""", lambda f, e: s.call_flow(f, e, "12"), "flows", "events")
named("callflow_participants", "SELECT DISTINCT ip FROM (SELECT src_ip AS ip FROM v_flows WHERE flow_id LIKE '12-%' UNION ALL SELECT dst_ip FROM v_flows WHERE flow_id LIKE '12-%')", lambda f: s.participants(f, "12"), "flows")
named("job_flows", "SELECT flow_id, type, start_time, packets FROM v_flows WHERE job_id = 3 AND type = 'DNS'", lambda f: s.flows_of_job(f, 3, "DNS").select("flow_id", "type", "start_time", "packets"), "flows")
named("job_summary", """
SELECT job_id, 'protocol' AS part, type AS key, count(*) AS n FROM v_flows GROUP BY 1, 3 UNION ALL SELECT job_id, 'quality', quality, count(*) FROM v_calls GROUP BY 1, 3
UNION ALL SELECT job_id, 'severity', severity, count(*) FROM v_events GROUP BY 1, 3
""", s.job_summary, "flows", "calls", "events")
named("geo_summary", "SELECT country, region, count(*) AS ips FROM v_enrichment GROUP BY 1, 2 ORDER BY ips DESC, country LIMIT 20", s.geo_summary, "enrichment")
named("flagged_ips", """
SELECT ip, source_id, country, abuse_score, is_tor, is_abusive FROM v_enrichment WHERE is_tor OR is_abusive OR abuse_score >= 50 ORDER BY abuse_score DESC, is_tor DESC, source_id LIMIT 100
""", s.flagged_ips, "enrichment")
named("fresh_enrichment", "SELECT ip, source_id, last_checked FROM v_enrichment WHERE last_checked >= TIMESTAMP '2024-01-24 00:00:00'",
      lambda e: s.fresh_enrichment(e, "2024-01-31 00:00:00").select("ip", "source_id", "last_checked"), "enrichment")
named("latest_enrichment", "SELECT ip, source_id, country FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY last_checked DESC, source_id DESC) AS r FROM v_enrichment) WHERE r = 1",
      lambda e: s.latest_enrichment(e).select("ip", "source_id", "country"), "enrichment")
named("flows_by_country", """
SELECT country AS src_country, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_flows LEFT JOIN (
  SELECT ip, country, row_number() OVER (PARTITION BY ip ORDER BY last_checked DESC, source_id DESC) AS r FROM v_enrichment) ON ip = src_ip AND r = 1 GROUP BY 1
""", lambda f, e: s.enrich(f, e).groupBy("src_country").agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes")), "flows", "enrichment")
# Addresses of private and public ranges, made of the flows' numbers.
BYTES = "SELECT [10, 127, 172, 192, 100, 169, 224, 8, 203][CAST(packets % 9 + 1 AS INT)] AS a, CAST(CASE packets % 9 WHEN 3 THEN 168 WHEN 5 THEN 254 WHEN 6 THEN 0 WHEN 2 THEN 10 + src_port % 30 WHEN 4 THEN 50 + src_port % 90 ELSE src_port % 200 END AS INT) AS b, CAST(src_port % 2 AS INT) AS c, CAST(dst_port % 4 AS INT) AS d FROM v_flows"
MADE = f"SELECT a, b, c, a || '.' || b || '.' || c || '.' || d AS ip FROM ({BYTES})"
PRIVATE = "a IN (10, 127) OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 169 AND b = 254 OR a = 224 AND b = 0 AND c = 0"


def made_ip() -> Column:
    n = lambda c, m: F.col(c) % m
    a = F.element_at(F.array(*map(F.lit, (10, 127, 172, 192, 100, 169, 224, 8, 203))), (n("packets", 9) + 1).cast("int"))
    kind = n("packets", 9)
    b = F.when(kind == 3, 168).when(kind == 5, 254).when(kind == 6, 0).when(kind == 2, 10 + n("src_port", 30)).when(kind == 4, 50 + n("src_port", 90)).otherwise(n("src_port", 200))
    return F.concat_ws(".", a.cast("string"), b.cast("string"), n("src_port", 2).cast("string"), n("dst_port", 4).cast("string"))


def made_ips(flows: DataFrame) -> DataFrame:
    return flows.select(made_ip().alias("ip"))


named("private_ips", f"SELECT ip, {PRIVATE} AS private, count(*) AS flows FROM ({MADE}) GROUP BY ALL", lambda f: made_ips(f).groupBy("ip", s.is_private(F.col("ip")).alias("private")).agg(F.count("*").alias("flows")), "flows")
named("ips_to_enrich", f"""
SELECT DISTINCT ip FROM (SELECT a, b, c, ip FROM ({MADE}) UNION ALL SELECT 8, 8, 8, replace(src_ip, '10.0.0.', '8.8.8.') FROM v_flows WHERE src_ip LIKE '10.0.0.%') WHERE NOT ({PRIVATE})
  AND ip NOT IN (SELECT replace(ip, '10.0.0.', '8.8.8.') FROM v_enrichment WHERE last_checked >= TIMESTAMP '2024-01-30 00:00:00')
""", lambda f, e: s.to_enrich(
    f.select(made_ip().alias("src_ip"), F.when(F.col("src_ip").like("10.0.0.%"), F.replace("src_ip", F.lit("10.0.0."), F.lit("8.8.8."))).otherwise(F.lit("127.0.0.1")).alias("dst_ip")),
    s.fresh_enrichment(e, "2024-01-31 00:00:00", 1).withColumn("ip", F.replace("ip", F.lit("10.0.0."), F.lit("8.8.8."))),
), "flows", "enrichment")
CASES = lambda rows, key, other: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rows.items()) + f" ELSE {other} END"
named("layer_tree", f"""
WITH l AS (SELECT frame_number, unnest([
  {{'i': 0, 'name': 'Frame ' || frame_number, 'color': '{s.GREY}', 'f': [['Arrival Time', strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f')], ['Frame Number', frame_number::varchar], ['Frame Length', length || ' bytes'],
    ['Protocols in Frame', concat_ws(':', 'eth:ip', lower(protocol), CASE WHEN app_protocol <> '' THEN app_protocol END)]]}},
  {{'i': 1, 'name': 'Internet Protocol Version 4', 'color': '{s.INDIGO}', 'f': [['Source Address', src_ip], ['Destination Address', dst_ip], ['Protocol', protocol]]}},
  {{'i': 2, 'name': CASE protocol WHEN 'UDP' THEN 'User Datagram Protocol' ELSE 'Transmission Control Protocol' END, 'color': '{s.SKY}', 'f': [['Source Port', src_port::varchar], ['Destination Port', dst_port::varchar]]}},
  {{'i': CASE WHEN app_protocol <> '' THEN 3 END, 'name': {CASES(s.FULL_NAMES, 'app_protocol', 'app_protocol')}, 'color': {CASES(s.COLOURS, 'app_protocol', "'" + s.GREY + "'")}, 'f': [['K', json_extract_string(metadata, '$.k')]]}}]) AS x FROM v_packets)
SELECT frame_number, x.i::int AS layer, x.name, x.color, f[1] AS field, f[2] AS value FROM (SELECT frame_number, x, unnest(x.f) AS f FROM l WHERE x.i IS NOT NULL)
""", lambda p: s.layer_tree(p.withColumn("metadata", F.from_json("metadata", "map<string,string>"))).select("frame_number", F.posexplode("layers").alias("layer", "l")).select("frame_number", "layer", "l.name", "l.color", F.explode("l.fields").alias("f")).select("frame_number", "layer", "name", "color", F.col("f.name").alias("field"), "f.value"), "packets")
named("conversation_matrix", """
SELECT least(src_ip, dst_ip) AS a, greatest(src_ip, dst_ip) AS b, app_protocol, count(*) FILTER (src_ip <= dst_ip) AS fwd_packets, count(*) FILTER (src_ip > dst_ip) AS rev_packets,
  CAST(coalesce(sum(length) FILTER (src_ip <= dst_ip), 0) AS BIGINT) AS fwd_bytes, CAST(coalesce(sum(length) FILTER (src_ip > dst_ip), 0) AS BIGINT) AS rev_bytes,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen, CAST(sum(length) AS BIGINT) AS bytes FROM v_packets GROUP BY 1, 2, 3
""", s.conversation_matrix, "packets")
named("sample3_per_type", "SELECT type, flow_id, bytes, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY bytes DESC, flow_id) AS rank FROM v_flows) WHERE rank <= 3",
      lambda f: s.ranked_per(f, "type", F.desc("bytes"), F.col("flow_id")).select("type", "flow_id", "bytes", "rank"), "flows")
named("event_groups", "SELECT title, severity, count(*) AS n, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM v_events GROUP BY 1, 2 ORDER BY n DESC, title, severity LIMIT 20", s.event_groups, "events")
named("hex_rows", """
SELECT frame_number, o * 16 AS "offset", rtrim(regexp_replace(hex(CAST(substr(metadata, CAST(o * 16 + 1 AS BIGINT), 16) AS BLOB)), '(..)', '\\1 ', 'g')) AS hex, substr(metadata, CAST(o * 16 + 1 AS BIGINT), 16) AS ascii
FROM (SELECT frame_number, metadata, unnest(generate_series(0, (length(metadata) - 1) // 16)) AS o FROM v_packets)
""", lambda p: s.hex_rows(p.withColumn("raw_packet", F.col("metadata").cast("binary"))), "packets")
named("bpf_ports", "SELECT frame_number, src_port, dst_port FROM v_packets WHERE src_port IN (5060, 1030) OR dst_port IN (5060, 1030)", lambda p: s.port_filter(p, "5060, 1030").select("frame_number", "src_port", "dst_port"), "packets")
named("legs_of_call", "SELECT job_id, leg, src_ip, src_port, dst_ip, dst_port, ssrc, packet_count, jitter_ms, max_seq_gap, start_time, end_time FROM v_legs WHERE call_id = '7'", lambda x: s.legs_of_call(x, "7"), "legs")
named("sip_flow_of_call", "SELECT flow_id, method, response, src_ip, dst_ip, start_time, setup_latency_ms FROM v_flows WHERE flow_id = '1036-4' AND type = 'SIP' ORDER BY job_id, start_time LIMIT 1",
      lambda f: s.sip_flow_of_call(f, "1036-4").select("flow_id", "method", "response", "src_ip", "dst_ip", "start_time", "setup_latency_ms"), "flows")
named("chat_messages", "SELECT * FROM v_chat WHERE conversation_id = 1 ORDER BY created_at, id", lambda m: s.listed(m, "messages", conversation_id=1), "chat")
named("chat_list", "SELECT conversation_id AS id, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS messages FROM v_chat GROUP BY 1 ORDER BY updated_at DESC, id LIMIT 50",
      lambda m: s.listed(m.groupBy(F.col("conversation_id").alias("id")).agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("messages")), "chats", limit=50), "chat")
