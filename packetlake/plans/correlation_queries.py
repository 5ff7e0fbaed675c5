"""Correlation and user rules by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate as c
from ..operators import store
from ..operators import user_rules as u
from .catalog import STATEMENTS, named

named("calls_sip_rtp", """
WITH s AS (SELECT job_id, flow_id, first({'a': start_time, 'b': end_time, 'm': media_ip, 'p': media_port} ORDER BY start_time, src_ip, media_ip) AS s FROM v_flows WHERE type = 'SIP' AND media_ip IS NOT NULL GROUP BY 1, 2),
k AS (SELECT s.job_id, s.flow_id, count(*) AS legs, sum(packets) AS packets, max(jitter_ms) AS jitter_ms, max(max_seq_gap) AS max_seq_gap FROM s JOIN v_flows r ON r.type = 'RTP' AND r.job_id = s.job_id AND (r.src_ip = s.s.m OR r.dst_ip = s.s.m) AND (r.src_port = s.s.p OR r.dst_port = s.s.p) GROUP BY 1, 2)
SELECT s.job_id, s.flow_id AS call_id, s.s.a AS start_time, s.s.b AS end_time, s.s.m AS media_ip, s.s.p AS media_port, coalesce(legs, 0) AS legs, CAST(coalesce(packets, 0) AS BIGINT) AS packets, jitter_ms, max_seq_gap FROM s LEFT JOIN k ON s.job_id = k.job_id AND s.flow_id = k.flow_id
""", c.calls_from_flows, "flows")
PROFILE = """profile AS (SELECT job_id, imsi, first(msisdn ORDER BY k, start_time, flow_id) FILTER (msisdn <> '') AS msisdn, first(apn ORDER BY k, start_time, flow_id) FILTER (apn <> '') AS apn, first(ue_ip ORDER BY k, start_time, flow_id) FILTER (ue_ip <> '') AS ue_ip,
  min(start_time) AS first_seen, max(end_time) AS last_seen, coalesce(list_sort(list(DISTINCT teid) FILTER (teid IS NOT NULL)), []) AS teids, count(*) AS flows
  FROM (SELECT *, CASE type WHEN 'NGAP' THEN 0 WHEN 'GTP' THEN 1 ELSE 2 END AS k FROM v_flows WHERE imsi IS NOT NULL) GROUP BY 1, 2)"""
named("subscriber_profiles", f"WITH {PROFILE} SELECT * FROM profile", c.subscribers, "flows")
named("subscriber_lookup", f"WITH {PROFILE} SELECT job_id, 'imsi' AS kind, imsi AS id, imsi FROM profile UNION ALL SELECT job_id, 'msisdn', msisdn, imsi FROM profile WHERE msisdn IS NOT NULL UNION ALL SELECT job_id, 'ue_ip', ue_ip, imsi FROM profile WHERE ue_ip IS NOT NULL UNION ALL SELECT job_id, 'teid', unnest(teids), imsi FROM profile",
      lambda f: c.lookup_index(c.subscribers(f)), "flows")
WITHIN = "f.start_time < p.last_seen + INTERVAL 30 SECOND AND f.end_time > p.first_seen - INTERVAL 30 SECOND"
MEMBERS = f"""{PROFILE},
calls AS (SELECT p.job_id, p.imsi, f.flow_id, f.type, f.media_ip, f.media_port FROM v_flows f JOIN profile p ON p.job_id = f.job_id AND (p.ue_ip = f.src_ip OR p.ue_ip = f.dst_ip)
  WHERE f.imsi IS NULL AND f.type = 'SIP' AND {WITHIN}),
members AS (SELECT job_id, imsi, flow_id, type, min(via) AS via FROM (
  SELECT job_id, imsi, flow_id, type, 'imsi' AS via FROM v_flows WHERE imsi IS NOT NULL UNION ALL
  SELECT p.job_id, p.imsi, f.flow_id, f.type, 'teid' FROM v_flows f JOIN profile p ON p.job_id = f.job_id AND list_contains(p.teids, f.teid) WHERE f.imsi IS NULL AND f.type = 'GTPU' AND {WITHIN} UNION ALL
  SELECT p.job_id, p.imsi, f.flow_id, f.type, 'ue_ip' FROM v_flows f JOIN profile p ON p.job_id = f.job_id AND p.ue_ip = f.ue_ip WHERE f.imsi IS NULL AND f.type IN ('PFCP', 'GTP') AND {WITHIN} UNION ALL
  SELECT job_id, imsi, flow_id, type, 'end' FROM calls UNION ALL
  SELECT c.job_id, c.imsi, r.flow_id, r.type, 'media' FROM calls c JOIN v_flows r ON r.job_id = c.job_id AND r.src_ip = c.media_ip AND r.src_port = c.media_port WHERE r.type = 'RTP' AND r.imsi IS NULL UNION ALL
  SELECT c.job_id, c.imsi, r.flow_id, r.type, 'media' FROM calls c JOIN v_flows r ON r.job_id = c.job_id AND r.dst_ip = c.media_ip AND r.dst_port = c.media_port WHERE r.type = 'RTP' AND r.imsi IS NULL
) GROUP BY 1, 2, 3, 4)"""
named("sessions_imsi", f"WITH {MEMBERS} SELECT * FROM members", c.sessions, "flows")
SCORE = "round(min(CASE WHEN type = 'RTP' THEN greatest(4.5 - 0.05 * least(packet_loss_pct, 100) - 0.01 * jitter_ms, 1.0) END) * 100) / 100 AS mos"
QUALITY = "CASE WHEN mos IS NULL THEN NULL WHEN mos >= 4 THEN 'good' WHEN mos >= 3 THEN 'fair' ELSE 'poor' END AS quality"
named("sessions_by_time", f"""
WITH {MEMBERS}, near AS (SELECT p.job_id, p.imsi, f.flow_id, f.type, 'time' AS via FROM v_flows f JOIN profile p ON p.job_id = f.job_id WHERE f.imsi IS NULL AND f.type IN ('NGAP', 'Diameter', 'RTP') AND {WITHIN.replace('30 SECOND', '2 SECOND')})
SELECT job_id, imsi, flow_id, type, min(via) AS via FROM (SELECT * FROM members UNION ALL SELECT * FROM near) GROUP BY 1, 2, 3, 4
""".replace("INTERVAL 30 SECOND", "INTERVAL 2 SECOND"), lambda f: c.sessions(f, 2.0, ("NGAP", "Diameter", "RTP")), "flows")
named("session_summary", f"""
WITH {MEMBERS}, e AS (SELECT job_id, imsi, min(start_time) AS start_time, max(end_time) AS end_time, list_sort(list(DISTINCT type)) AS layers, count(*) AS flows, {SCORE}
  FROM (SELECT m.imsi, f.* EXCLUDE (imsi) FROM members m JOIN v_flows f ON m.job_id = f.job_id AND m.flow_id = f.flow_id AND m.type = f.type) GROUP BY 1, 2)
SELECT *, {QUALITY}, list_has_all(layers, ['NGAP', 'GTP', 'SIP', 'RTP']) AS complete FROM e
""", lambda f: c.session_summary(f, c.sessions(f)), "flows")
TELECOM = f"""
SELECT e.job_id, 'imsi-' || e.imsi AS session_id, e.imsi, p.msisdn, p.apn, p.ue_ip, e.start_time, e.end_time, mos, quality, list_contains(layers, 'NGAP') AS has_ngap, list_contains(layers, 'GTP') AS has_gtpc, list_contains(layers, 'PFCP') AS has_pfcp,
  list_contains(layers, 'GTPU') AS has_gtpu, list_contains(layers, 'SIP') AS has_sip, list_contains(layers, 'RTP') AS has_rtp, list_contains(layers, 'Diameter') AS has_diameter, complete AS is_complete, layers, p.teids
FROM ({STATEMENTS['session_summary']}) e JOIN (WITH {PROFILE} SELECT * FROM profile) p ON e.job_id = p.job_id AND e.imsi = p.imsi"""
named("telecom_list_all", f"SELECT * FROM ({TELECOM}) ORDER BY job_id DESC, start_time, session_id LIMIT 100", lambda f: store.telecom_list(c.telecom_sessions(f, c.sessions(f)), limit=100), "flows")
named("telecom_list_job", f"SELECT * FROM ({TELECOM}) WHERE job_id = 1 ORDER BY start_time, session_id LIMIT 500", lambda f: store.telecom_list(c.telecom_sessions(f, c.sessions(f)), 1), "flows")
named("ims_sessions", f"""
WITH {MEMBERS}, lone AS (SELECT * FROM v_flows WHERE type = 'SIP' AND (job_id, flow_id) NOT IN (SELECT (job_id, flow_id) FROM members WHERE type = 'SIP')),
own AS (SELECT job_id, flow_id AS call_id, type, start_time, end_time, packet_loss_pct, jitter_ms FROM lone UNION ALL
  SELECT job_id, call_id, type, start_time, end_time, packet_loss_pct, jitter_ms FROM (SELECT DISTINCT s.job_id, s.flow_id AS call_id, r.flow_id, r.type, r.start_time, r.end_time, r.packet_loss_pct, r.jitter_ms FROM lone s JOIN v_flows r ON r.type = 'RTP' AND s.job_id = r.job_id AND s.media_ip = r.src_ip AND s.media_port = r.src_port)),
e AS (SELECT job_id, 'ims-' || call_id AS session_id, call_id, min(start_time) AS start_time, max(end_time) AS end_time, count(*) FILTER (type = 'RTP') AS streams, {SCORE} FROM own GROUP BY job_id, call_id)
SELECT *, {QUALITY} FROM e
""", lambda f: c.ims_sessions(f, c.sessions(f)), "flows")
NAME = "coalesce(CASE type WHEN 'SIP' THEN method WHEN 'Diameter' THEN command ELSE message_type END, '')"
STEP = "CASE type " + " ".join(f"WHEN '{k}' THEN CASE {NAME} " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in names.items()) + f" ELSE '{c.PREFIXES[k]}' || {NAME} END" for k, names in c.STEPS.items()) + " " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in c.SINGLE.items()) + " END"
STATE = "CASE step " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in c.MILESTONES.items()) + " END"
LIFE = f"""{MEMBERS}, steps AS (SELECT m.job_id, m.imsi, f.flow_id, {STEP.replace(' type ', ' f.type ')} AS step, start_time AS tick FROM members m JOIN v_flows f ON m.job_id = f.job_id AND m.flow_id = f.flow_id AND m.type = f.type),
begun AS (SELECT job_id, imsi, min(tick) AS begun FROM steps WHERE step IS NOT NULL GROUP BY 1, 2),
life AS (SELECT job_id, imsi, step, tick, (epoch_us(tick) - epoch_us(begun)) / 1000 AS delta_ms, state FROM (SELECT job_id, imsi, step, {STATE} AS state, min(tick) AS tick FROM steps GROUP BY ALL) JOIN begun USING (job_id, imsi) WHERE state IS NOT NULL)"""
named("session_steps", f"WITH {LIFE} SELECT job_id, imsi, flow_id, step, tick AS \"at\" FROM steps WHERE step IS NOT NULL", lambda f: c.session_steps(f, c.sessions(f)), "flows")
named("session_lifecycle", f"WITH {LIFE} SELECT job_id, imsi, step, tick AS \"at\", delta_ms, state FROM life", lambda f: c.lifecycle(f, c.sessions(f)), "flows")
named("session_state", f"WITH {LIFE} SELECT job_id, imsi, last(state ORDER BY tick, step) AS state FROM life GROUP BY 1, 2", lambda f: c.final_state(c.lifecycle(f, c.sessions(f))), "flows")
NEAR = "a.start_time - INTERVAL 2.5 SECOND < b.end_time + INTERVAL 2.5 SECOND AND b.start_time - INTERVAL 2.5 SECOND < a.end_time + INTERVAL 2.5 SECOND"
named("cross_interval_5s", f"""
SELECT a.flow_id AS anchor, b.flow_id, b.type FROM v_flows a JOIN v_flows b ON a.type = 'SIP' AND b.type IN ('Diameter', 'RTP', 'GTP', 'PFCP', 'S1AP', 'NGAP') AND a.job_id = b.job_id AND {NEAR}
WHERE b.type NOT IN ('Diameter', 'RTP') OR a.src_ip IN (b.src_ip, b.dst_ip) OR a.dst_ip IN (b.src_ip, b.dst_ip)
""", c.cross_protocol, "flows")
named("gtp_pfcp_interval", f"SELECT a.flow_id AS gtp, b.flow_id AS pfcp FROM v_flows a JOIN v_flows b ON a.type = 'GTP' AND b.type = 'PFCP' AND a.job_id = b.job_id AND {NEAR}", c.gtp_pfcp, "flows")
RANK = "CASE f.type WHEN {anchor} THEN -1 WHEN 'Diameter' THEN 1 WHEN 'GTP' THEN 2 WHEN 'PFCP' THEN 3 WHEN 'RTP' THEN 4 WHEN 'S1AP' THEN 5 ELSE 6 END"
TOLD = """list_transform(list_sort(list(DISTINCT {'r': rank, 't': type})), lambda x: x.t) AS protocols, count(*) AS flows, last(teid ORDER BY start_time, flow_id) FILTER (type = 'GTP') AS teid,
  first(imsi ORDER BY rank, start_time, flow_id) FILTER (imsi <> '') AS imsi, first(msisdn ORDER BY rank, start_time, flow_id) FILTER (msisdn <> '') AS msisdn"""
FIELDS = "b.flow_id, b.type, b.start_time, b.end_time, b.imsi, b.msisdn, b.teid"
ANCHOR = "a.job_id, a.type AS kind, a.flow_id AS anchor, a.start_time AS begun, a.end_time AS ended"
named("cross_sessions", f"""
WITH n AS (
  SELECT {ANCHOR}, {FIELDS} FROM v_flows a JOIN v_flows b ON a.job_id = b.job_id AND {NEAR} AND (a.type = 'SIP' AND (b.type IN ('GTP', 'PFCP', 'S1AP', 'NGAP')
    OR b.type IN ('Diameter', 'RTP') AND (a.src_ip IN (b.src_ip, b.dst_ip) OR a.dst_ip IN (b.src_ip, b.dst_ip))) OR a.type = 'GTP' AND b.type = 'PFCP')
  UNION ALL SELECT {ANCHOR}, {FIELDS.replace('b.', 'a.')} FROM v_flows a WHERE type IN ('SIP', 'GTP')),
c AS (SELECT job_id, kind, anchor, begun, CASE WHEN kind = 'SIP' THEN greatest(max(end_time), ended) ELSE ended END AS end_time, {TOLD} FROM (SELECT f.*, {RANK.format(anchor="f.kind")} AS rank FROM n f)
  GROUP BY job_id, kind, anchor, begun, ended HAVING kind = 'SIP' OR count(DISTINCT type) > 1)
SELECT job_id, CASE kind WHEN 'SIP' THEN 'session-' ELSE 'session-gtp-' END || anchor AS session_id, CASE kind WHEN 'SIP' THEN anchor END AS call_id, begun AS start_time, end_time, protocols, flows, imsi, msisdn, teid FROM c
""", lambda f: c.cross_sessions(f).drop("diameter_session", "seid"), "flows")
named("teid_normal", "SELECT flow_id, '0x' || lpad(lower(regexp_replace(teid, '^0[xX]', '')), 8, '0') AS teid FROM v_flows WHERE teid IS NOT NULL", lambda f: f.where("teid is not null").select("flow_id", c.normal_teid(F.col("teid")).alias("teid")), "flows")
named("rtcp_to_call", """
SELECT r.job_id, r.ip, r.port, r.flow_id, m.call_id FROM (SELECT job_id, src_ip AS ip, src_port AS port, flow_id FROM v_flows WHERE type = 'RTP') r LEFT JOIN (
  SELECT job_id, ip, port, min(call_id) AS call_id FROM (SELECT job_id, src_ip AS ip, src_port AS port, call_id FROM v_legs UNION ALL SELECT job_id, dst_ip, dst_port, call_id FROM v_legs) GROUP BY 1, 2, 3
) m ON r.job_id = m.job_id AND r.ip = m.ip AND r.port = m.port
""", lambda f, legs: c.media_lookup(f.where("type = 'RTP'").select("job_id", F.col("src_ip").alias("ip"), F.col("src_port").alias("port"), "flow_id"), legs), "flows", "legs")

ANY = '{"match": "any", "conditions": [{"field": "total_flows", "operator": "<", "value": 0}, {"field": "flow_count.SIP", "operator": ">=", "value": 10}, {"field": "nothing", "operator": ">", "value": 0}]}'
ALL = '{"match": "all", "conditions": [{"field": "sip_401_max", "operator": ">", "value": 0}, {"field": "error_count.DNS:SERVFAIL", "operator": ">", "value": 0}, {"field": "dns_query_max", "operator": ">=", "value": 1}]}'
named("user_rule_any", "SELECT 'many' AS rule, 'warning' AS severity, '*' AS protocol, 'total_flows < 0 OR flow_count.SIP >= 10 OR nothing > 0' AS description FROM (SELECT count(*) AS n, count(*) FILTER (type = 'SIP') AS s FROM v_flows) WHERE n < 0 OR s >= 10",
      lambda f: u.run_user_rules(f, [{"name": "many", "condition_json": ANY}, {"name": "off", "condition_json": ANY, "enabled": False}]), "flows")
named("user_rule_all", "SELECT 'every' AS rule, 'error' AS severity, 'SIP' AS protocol, 'told' AS description FROM (SELECT count(*) FILTER (type = 'SIP' AND contains(response, '401')) AS a, count(*) FILTER (type = 'DNS' AND is_error AND error_type = 'SERVFAIL') AS b FROM v_flows) WHERE a > 0 AND b > 0",
      lambda f: u.run_user_rules(f, [{"name": "every", "condition_json": ALL, "severity": "error", "protocol": "SIP", "description": "told"}]), "flows")
named("user_rule_figures", """
SELECT count(*) AS total_flows, CAST(sum(packets) AS BIGINT) AS total_packets, (epoch_us(max(end_time)) - epoch_us(min(start_time))) / 1000000 AS capture_window_secs,
  (SELECT max(n) FROM (SELECT count(DISTINCT dst_ip) AS n FROM v_flows GROUP BY src_ip)) AS source_fan_out_max, (SELECT max(n) FROM (SELECT count(*) AS n FROM v_flows WHERE type = 'DNS' GROUP BY query_name)) AS dns_query_max FROM v_flows
""", lambda f: u.figures(f).select("total_flows", "total_packets", "capture_window_secs", "source_fan_out_max", "dns_query_max"), "flows")
