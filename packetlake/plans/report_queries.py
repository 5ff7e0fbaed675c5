"""Quality, indicators and reports by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as q
from ..operators import context
from ..operators import kpi as k
from ..operators import reports as r
from .catalog import STATEMENTS, named


def status(low: str, critical: str, empty: str) -> str:
    return f"CASE WHEN v IS NULL THEN '{empty}' WHEN v {critical} THEN 'critical' WHEN v {low} THEN 'warning' ELSE 'good' END AS status"


def kpi(key, name, unit, value, source, empty, empty_status, warning, critical, build, *views):
    sql = f"SELECT '{name}' AS name, round(coalesce(v, {empty}) * 100) / 100 AS value, '{unit}' AS unit, {status(warning, critical, empty_status)} FROM (SELECT {value} AS v FROM {source})"
    named(key, sql, build, *views)
    return sql


def pct(condition: str) -> str:
    return f"100.0 * count(*) FILTER ({condition}) / CASE WHEN count(*) > 0 THEN CAST(count(*) AS DOUBLE) END"


KPIS = [
    kpi("kpi_cssr", "Call Setup Success Rate", "%", pct("quality NOT IN ('', 'Failed')"), "v_calls", "0.0", "warning", "< 95", "< 90", k.call_setup_success, "calls"),
    kpi("kpi_drop_rate", "Call Drop Rate", "%", pct("end_type IN ('abnormal', 'dropped')"), "v_calls", "0.0", "good", "> 2", "> 5", k.call_drop_rate, "calls"),
    kpi("kpi_avg_mos", "Average MOS", "score", "avg(mos) FILTER (mos > 0)", "v_calls", "0.0", "warning", "< 3.5", "< 3.0", k.average_mos, "calls"),
    kpi("kpi_setup_time", "Average Setup Time", "s", "avg(setup_latency_ms / 1000) FILTER (type = 'SIP' AND setup_latency_ms > 0)", "v_flows", "0.0", "good", "> 3", "> 6", k.setup_time, "flows"),
    kpi("kpi_dns_success", "DNS Success Rate", "%", pct("reply_code IN ('NOERROR', '')"), "v_flows WHERE type = 'DNS'", "100.0", "good", "< 98", "< 95", k.dns_success, "flows"),
    kpi("kpi_dns_latency", "DNS Average Latency", "ms", "avg(latency_ms) FILTER (latency_ms > 0)", "v_flows WHERE type = 'DNS'", "0.0", "good", "> 100", "> 500", k.dns_latency, "flows"),
    kpi("kpi_diameter_success", "Diameter Success Rate", "%", pct("result_code BETWEEN 2001 AND 2002"), "v_flows WHERE type = 'Diameter' AND result_code IS NOT NULL", "100.0", "good", "< 98", "< 95", k.diameter_success, "flows"),
    kpi("kpi_gtp_success", "GTP Success Rate", "%", pct("coalesce(cause_code, 16) IN (0, 16)"), "v_flows WHERE type = 'GTP'", "100.0", "good", "< 98", "< 95", lambda f: k.cause_success(f, "GTP", 16), "flows"),
    kpi("kpi_pfcp_success", "PFCP Success Rate", "%", pct("coalesce(cause_code, 1) IN (0, 1)"), "v_flows WHERE type = 'PFCP'", "100.0", "good", "< 98", "< 95", lambda f: k.cause_success(f, "PFCP", 1), "flows"),
    kpi("kpi_active_protocols", "Active Protocols", "count", "CAST(count(DISTINCT type) AS DOUBLE)", "v_flows", "0.0", "good", "< -1", "< -1", k.active_protocols, "flows"),
]
named("kpi_all", " UNION ALL ".join(f"({s})" for s in KPIS), k.all_kpis, "flows", "calls")

MOS = "round(least(greatest(1 + 0.035 * r + r * (r - 60) * (100 - r) * 0.000007, 1.0), 4.5) * 1000) / 1000"
R = "least(greatest(94.2 - 2.5 * {loss} - 0.1 * {jitter} - CASE WHEN {delay} > 177.3 THEN 0.024 * {delay} + 0.11 * ({delay} - 177.3) ELSE 0 END, 0.0), 100.0)"
QUALITY = "CASE WHEN {m} >= 4 THEN 'excellent' WHEN {m} >= 3.6 THEN 'good' WHEN {m} >= 3.1 THEN 'fair' WHEN {m} >= 2.6 THEN 'poor' ELSE 'bad' END"
VERDICT = "CASE WHEN {s} >= 80 THEN 'good' WHEN {s} >= 60 THEN 'acceptable' WHEN {s} >= 40 THEN 'poor' ELSE 'critical' END"
TCP = "greatest(0, 100 - CASE WHEN rtt_ms > 0 THEN least(CAST(trunc(rtt_ms / 500 * 40) AS INT), 40) ELSE 0 END - CASE WHEN p <= 0 THEN 0 WHEN p <= 3 THEN CAST(trunc(p / 3 * 30) AS INT) ELSE least(30 + CAST(trunc((p - 3) / 3 * 20) AS INT), 90) END)"

named("mos", f"SELECT flow_id, m AS mos, {QUALITY.format(m='m')} AS quality FROM (SELECT flow_id, {MOS} AS m FROM (SELECT flow_id, {R.format(loss='packet_loss_pct', jitter='jitter_ms', delay='rtt_ms')} AS r FROM v_flows WHERE type = 'RTP'))",
      lambda f: f.where("type = 'RTP'").select("flow_id", q.mos(F.col("packet_loss_pct"), F.col("jitter_ms"), F.col("rtt_ms")).alias("mos")).withColumn("quality", q.quality_of_mos(F.col("mos"))), "flows")
named("sla_tcp", f"SELECT flow_id, s AS score, {VERDICT.format(s='s')} AS verdict FROM (SELECT flow_id, {TCP} AS s FROM (SELECT *, packet_loss_pct AS p FROM v_flows WHERE type = 'TCP'))",
      lambda f: f.where("type = 'TCP'").select("flow_id", q.tcp_score(F.col("rtt_ms"), F.col("packet_loss_pct")).alias("score")).withColumn("verdict", q.verdict(F.col("score"))), "flows")
named("sla_rtp", f"SELECT flow_id, s AS score, {VERDICT.format(s='s')} AS verdict FROM (SELECT flow_id, greatest(0, 100 - least(CAST(trunc(jitter_ms / 100 * 40) AS INT), 40) - least(CAST(trunc(packet_loss_pct / 5 * 60) AS INT), 60)) AS s FROM v_flows WHERE type = 'RTP')",
      lambda f: f.where("type = 'RTP'").select("flow_id", q.rtp_score(F.col("jitter_ms"), F.col("packet_loss_pct")).alias("score")).withColumn("verdict", q.verdict(F.col("score"))), "flows")
named("call_analysis", f"""
WITH each AS (
  SELECT job_id, call_id, count(*) AS legs, min(CASE WHEN packet_count > 0 THEN {MOS} END) AS worst, coalesce(arg_min(coalesce(loss, -1.0), leg * 100000000000 + ssrc), 0.0) AS loss0, arg_min(jitter_ms, leg * 100000000000 + ssrc) AS jitter
  FROM (SELECT *, {R.format(loss='loss', jitter='jitter_ms', delay='0.0')} AS r FROM (SELECT *, CASE WHEN packet_count > 0 THEN 100.0 * max_seq_gap / packet_count END AS loss FROM v_legs)) GROUP BY 1, 2),
j AS (SELECT c.job_id, c.call_id, is_on_hold, legs, coalesce(worst, 0.0) AS mos, CASE WHEN loss0 < 0 THEN 0.0 ELSE loss0 END AS loss, jitter FROM v_calls c LEFT JOIN each e ON c.job_id = e.job_id AND c.call_id = e.call_id)
SELECT job_id, call_id, mos, CASE WHEN legs IS NULL THEN 'abnormal' ELSE 'normal' END AS end_type,
  CASE WHEN is_on_hold THEN 'user_hold' WHEN legs IS NULL THEN 'no_media' WHEN mos > 0 AND mos < 2.6 AND loss > 10 THEN 'high_packet_loss' WHEN mos > 0 AND mos < 2.6 AND jitter > 100 THEN 'excessive_jitter' WHEN mos > 0 AND mos < 2.6 THEN 'media_quality' ELSE 'normal_release' END AS root_cause,
  CAST(CASE WHEN is_on_hold THEN 0.95 WHEN legs IS NULL THEN 0.8 WHEN mos > 0 AND mos < 2.6 AND (loss > 10 OR jitter > 100) THEN 0.9 WHEN mos > 0 AND mos < 2.6 THEN 0.85 ELSE 0.9 END AS DOUBLE) AS confidence FROM j
""", k.analyse_calls, "calls", "legs")
named("call_summary", """
SELECT count(*) AS total, count(*) FILTER (lower(quality) IN ('good', 'excellent')) AS good, count(*) FILTER (lower(quality) = 'fair') AS fair, count(*) FILTER (lower(quality) IN ('poor', 'bad')) AS poor,
  count(*) FILTER (lower(quality) NOT IN ('good', 'excellent', 'fair', 'poor', 'bad')) AS failed, count(*) FILTER (lower(quality) IN ('good', 'excellent', 'fair', 'poor', 'bad')) AS successful,
  count(*) FILTER (end_type IN ('dropped', 'abnormal')) AS dropped, round(avg(mos) FILTER (mos > 0) * 100) / 100 AS avg_mos, round(avg(duration_sec) FILTER (duration_sec > 0) * 100) / 100 AS avg_duration FROM v_calls
""", r.call_summary, "calls")
ERROR = """(coalesce(status_code >= 400, false) OR coalesce(TRY_CAST(regexp_extract(response, '^(?:SIP/2\\.0 )?(\\d{3})', 1) AS INT) >= 400, false) OR coalesce(is_error, false)
  OR coalesce(result_code NOT BETWEEN 2001 AND 2002, false) OR coalesce(reply_code NOT IN ('NOERROR', ''), false))"""
named("protocol_stats", f"SELECT type, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, count(*) FILTER ({ERROR}) AS errors FROM v_flows GROUP BY 1", r.protocol_stats, "flows")
named("root_causes", "SELECT CASE WHEN root_cause = '' THEN 'unknown' ELSE root_cause END AS root_cause, count(*) AS calls FROM v_calls GROUP BY 1", r.root_causes, "calls")
named("report_span", "SELECT *, date_sub('second', first, last) AS seconds FROM (SELECT min(start_time) AS first, max(end_time) AS last, count(*) AS flows FROM v_flows)", r.report_span, "flows")
named("rfc2544_throughput", "SELECT max(throughput_bps) AS max_bps, round(avg(coalesce(throughput_bps, 0)) * 100) / 100 AS avg_bps, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_flows", r.throughput, "flows")
named("rfc2544_latency", """
WITH s AS (SELECT rtt_ms, row_number() OVER (ORDER BY rtt_ms) - 1 AS i, count(*) OVER () AS n FROM v_flows WHERE rtt_ms > 0)
SELECT min(rtt_ms) AS min_ms, round(avg(rtt_ms) * 100) / 100 AS avg_ms, max(rtt_ms) AS max_ms, max(rtt_ms) FILTER (i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)) AS p95_ms, max(rtt_ms) FILTER (i = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)) AS p99_ms FROM s
""", r.latency, "flows")
named("rfc2544_loss", """
SELECT CAST(sum(packets) AS BIGINT) AS frames, CAST(sum(CAST(round(packet_loss_pct / 100 * packets) AS BIGINT)) AS BIGINT) AS lost, round(avg(packet_loss_pct) * 10000) / 10000 AS avg_loss_pct, CAST(sum(retransmissions) AS BIGINT) AS retransmissions FROM v_flows
""", r.frame_loss, "flows")
named("rfc2544_b2b", "SELECT max(packets) AS max_burst, round(avg(packets) FILTER (packets > 0) * 100) / 100 AS avg_burst FROM v_flows WHERE packets > 0", r.back_to_back, "flows")
named("rfc2544_by_proto", f"""
SELECT type, count(*) AS flows, round(avg(throughput_bps) * 100) / 100 AS avg_bps, round(avg(rtt_ms) FILTER (rtt_ms > 0) * 100) / 100 AS avg_rtt_ms, round(avg(packet_loss_pct) * 10000) / 10000 AS avg_loss_pct,
  count(*) FILTER (v = 'good') AS good, count(*) FILTER (v = 'acceptable') AS acceptable, count(*) FILTER (v = 'poor') AS poor, count(*) FILTER (v = 'critical') AS critical
FROM (SELECT *, {VERDICT.format(s='s')} AS v FROM (SELECT *, CASE WHEN type = 'TCP' THEN {TCP} ELSE 100 END AS s FROM (SELECT *, packet_loss_pct AS p FROM v_flows))) GROUP BY 1
""", lambda f: r.by_protocol(f, q.verdict(F.when(F.col("type") == "TCP", q.tcp_score(F.col("rtt_ms"), F.col("packet_loss_pct"))).otherwise(100))), "flows")
named("rfc2544_load_sweep", """
WITH s AS (SELECT throughput_bps AS v, row_number() OVER (ORDER BY throughput_bps) - 1 AS i, count(*) OVER () AS n FROM v_flows WHERE throughput_bps > 0),
b AS (SELECT *, (SELECT max(k) FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE floor(n * k / 5) <= i) AS band FROM s)
SELECT CAST(band AS BIGINT) AS band, count(*) AS flows, min(v) AS min_bps, max(v) AS max_bps, round(sum(v) / count(*) * 100) / 100 AS avg_bps FROM b GROUP BY 1
""", r.load_sweep, "flows")
named("y1564_services", """
WITH limits AS (SELECT * FROM (VALUES ('Voice (RTP)', 'RTP', 150.0, 30.0, 1.0), ('SIP Signaling', 'SIP', 500.0, 0.0, 0.1), ('Data (TCP)', 'TCP', 500.0, 0.0, 0.5), ('DNS', 'DNS', 100.0, 0.0, 0.0)) t(service, type, md, mj, ml)),
ref AS (SELECT type, src_ip AS reference FROM (SELECT type, src_ip, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, src_ip) AS k FROM v_flows GROUP BY 1, 2) WHERE k = 1),
seen AS (SELECT f.*, l.service, md, mj, ml, unnest(['ALL', CASE WHEN f.src_ip = reference THEN 'DL' ELSE 'UL' END]) AS direction FROM v_flows f JOIN limits l ON f.type = l.type JOIN ref ON ref.type = f.type),
means AS (SELECT service, direction, md, mj, ml, count(*) AS flows, round(avg(rtt_ms) FILTER (rtt_ms > 0) * 100) / 100 AS delay, round(avg(jitter_ms) FILTER (jitter_ms > 0) * 100) / 100 AS jitter, round(avg(packet_loss_pct) * 10000) / 10000 AS loss FROM seen GROUP BY 1, 2, 3, 4, 5)
SELECT service, direction, flows, delay, jitter, loss,
  concat_ws(',', CASE WHEN md > 0 AND delay > md THEN 'delay' END, CASE WHEN mj > 0 AND jitter > mj THEN 'jitter' END, CASE WHEN loss > ml THEN 'loss' END) AS violations,
  CASE WHEN coalesce(md > 0 AND delay > md * 1.2, false) OR coalesce(mj > 0 AND jitter > mj * 1.2, false) OR loss > ml * 1.2 THEN 'FAIL' WHEN coalesce(md > 0 AND delay > md, false) OR coalesce(mj > 0 AND jitter > mj, false) OR loss > ml THEN 'WARN' ELSE 'PASS' END AS verdict FROM means
""", r.service_report, "flows")
named("y1564_overall", f"SELECT count(*) AS services, CASE WHEN count(*) FILTER (verdict = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS overall FROM ({STATEMENTS['y1564_services']}) WHERE direction = 'ALL'", lambda f: r.overall_verdict(r.service_report(f)), "flows")
named("cdr_table", """
SELECT c.job_id, c.call_id, from_uri, to_uri, strftime(start_time, '%Y-%m-%dT%H:%M:%SZ') AS start_time, strftime(end_time, '%Y-%m-%dT%H:%M:%SZ') AS end_time, printf('%.2f', greatest(0.0, (epoch_us(end_time) - epoch_us(start_time)) / 1000000.0)) AS duration_sec,
  printf('%.3f', mos) AS mos, quality, printf('%.2f', round(coalesce(jitter, 0.0), 2)) AS jitter_ms, CAST(coalesce(gap, 0) AS STRING) AS max_seq_gap, '0.00' AS packet_loss_pct, end_type, root_cause, '0.0000' AS confidence
FROM v_calls c LEFT JOIN (SELECT job_id, call_id, avg(jitter_ms) FILTER (jitter_ms > 0) AS jitter, max(max_seq_gap) AS gap FROM v_legs GROUP BY 1, 2) l ON c.job_id = l.job_id AND c.call_id = l.call_id
""", r.call_table, "calls", "legs")
named("cdr", """
SELECT c.job_id, c.call_id, from_uri, to_uri, start_time, end_time, greatest(date_sub('second', start_time, end_time), 0) AS seconds, mos, quality, end_type, root_cause, coalesce(legs, 0) AS legs, coalesce(packets, 0) AS packets, coalesce(jitter_ms, 0.0) AS jitter_ms, coalesce(max_gap, 0) AS max_gap
FROM v_calls c LEFT JOIN (SELECT job_id, call_id, count(*) AS legs, CAST(sum(packet_count) AS BIGINT) AS packets, round(avg(jitter_ms) FILTER (jitter_ms > 0) * 100) / 100 AS jitter_ms, max(max_seq_gap) AS max_gap FROM v_legs GROUP BY 1, 2) l ON c.job_id = l.job_id AND c.call_id = l.call_id
""", r.call_records, "calls", "legs")
named("job_context", f"""
SELECT job_id, 'protocols' AS section, type || ': ' || count(*) || ' flows, ' || sum(packets) || ' packets, ' || count(*) FILTER ({ERROR}) || ' errors' AS line FROM v_flows GROUP BY job_id, type UNION ALL
SELECT job_id, 'calls', CASE WHEN quality = '' THEN 'unknown' ELSE lower(quality) END || ': ' || count(*) || ' calls' FROM v_calls GROUP BY job_id, CASE WHEN quality = '' THEN 'unknown' ELSE lower(quality) END UNION ALL
SELECT job_id, 'events', severity || ': ' || title || ' (' || count(*) || ' times)' FROM v_events WHERE severity IN ('error', 'critical') GROUP BY job_id, severity, title
""", r.job_context, "flows", "calls", "events")
named("report", f"""
WITH c AS (SELECT count(*) AS total, count(*) FILTER (q IN ('good', 'excellent')) AS good, count(*) FILTER (q = 'fair') AS fair, count(*) FILTER (q IN ('poor', 'bad')) AS poor, count(*) FILTER (q NOT IN ('good', 'excellent', 'fair', 'poor', 'bad')) AS failed,
  count(*) FILTER (end_type IN ('dropped', 'abnormal')) AS dropped, round(avg(mos) FILTER (mos > 0) * 100) / 100 AS avg_mos, round(avg(duration_sec) FILTER (duration_sec > 0) * 100) / 100 AS avg_duration FROM (SELECT *, lower(quality) AS q FROM v_calls)),
k AS ({" UNION ALL ".join(f"({s})" for s in KPIS)}),
p AS (SELECT type, count(*) AS flows, count(*) FILTER ({ERROR}) AS errors FROM v_flows GROUP BY 1)
SELECT 'totals' AS section, 'flows' AS name, CAST(count(*) AS DOUBLE) AS value, '' AS note FROM v_flows UNION ALL
SELECT 'totals', 'seconds', (epoch_us(max(end_time)) - epoch_us(min(start_time))) / 1000000.0, '' FROM v_flows UNION ALL
SELECT 'totals', 'calls', total, '' FROM c UNION ALL
SELECT 'calls', 'success', round(100.0 * (total - failed) / total * 100) / 100, '' FROM c UNION ALL
{" UNION ALL ".join(f"SELECT 'calls', '{n}', {n}, '' FROM c" for n in ("avg_mos", "avg_duration", "dropped", "good", "fair", "poor", "failed"))} UNION ALL
SELECT 'kpi', name, value, status FROM k UNION ALL
SELECT 'protocol', type, flows, 'flows' FROM p UNION ALL SELECT 'protocol', type, errors, 'errors' FROM p UNION ALL SELECT 'protocol', type, round(100.0 * (flows - errors) / flows * 100) / 100, 'success' FROM p UNION ALL
SELECT 'cause', CASE WHEN root_cause = '' THEN 'unknown' ELSE root_cause END, count(*), '' FROM v_calls GROUP BY 1, 2
""", r.report, "flows", "calls")


def told(label: str, value: str, unit: str = "") -> str:
    return f"'{label}: ' || NULLIF(CAST({value} AS STRING), '') || '{unit}'"


LINES = {
    "SIP": ["SIP Flows", told("Method", "method"), told("Response", "response"), told("MediaIP", "media_ip"), told("MediaPort", "media_port")],
    "RTP": ["RTP Flows", told("PacketCount", "packets"), told("Jitter", "regexp_replace(CAST(jitter_ms AS STRING), '\\.0$', '')", "ms"), told("MaxSeqGap", "max_seq_gap")],
    "DNS": ["DNS Flows", told("Query", "query_name"), told("Type", "query_type"), told("ReplyCode", "reply_code"), told("Answers", "replace(answer_list, ',', ' ')"), told("Latency", "regexp_replace(CAST(latency_ms AS STRING), '\\.0$', '')", "ms"), "CASE WHEN is_error THEN 'ERROR: ' || NULLIF(error_type, '') END"],
    "HTTP": ["HTTP Flows", told("Method", "method"), told("Status", "status_code"), "CASE WHEN is_error THEN 'ERROR' END"],
    "TLS": ["TLS/HTTPS Flows", told("SNI", "sni"), told("Version", "tls_version"), told("Cipher", "cipher_suite")],
    "Diameter": ["Diameter Flows", told("Command", "command"), told("ResultCode", "result_code"), told("IMSI", "imsi"), told("MSISDN", "msisdn"), "CASE WHEN is_error THEN 'ERROR' END"],
    "GTP": ["GTP Flows", told("MessageType", "message_type"), told("TEID", "teid"), told("CauseCode", "cause_code"), told("IMSI", "imsi"), told("MSISDN", "msisdn"), told("APN", "apn"), "CASE WHEN is_error THEN 'ERROR' END"],
    "PFCP": ["PFCP Flows", told("MessageType", "message_type"), told("CauseCode", "cause_code"), "CASE WHEN is_error THEN 'ERROR' END"],
    "AJP": ["AJP Flows", told("Method", "method"), told("Status", "status_code"), "CASE WHEN is_error THEN 'ERROR' END"],
    "SNMP": ["SNMP Flows"],
    "S1AP": ["S1AP Flows"],
    "NGAP": ["NGAP Flows", told("Procedure", "message_type"), told("IMSI", "imsi")],
    "SCTP": ["SCTP Flows"],
}
FLOW_LINES = " UNION ALL ".join(
    f"SELECT job_id, {i} AS place, '{section}' AS section, concat_ws(' | ', '- Flow ' || flow_id, src_ip || ' -> ' || dst_ip{''.join(', ' + f for f in fields)}) AS line FROM v_flows WHERE type = '{kind}'" for i, (kind, (section, *fields)) in enumerate(LINES.items())
)
named("job_lines", f"""
WITH e AS (SELECT * FROM v_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, event_id DESC) <= 200),
p AS (SELECT *, CASE WHEN app_protocol <> '' THEN app_protocol ELSE protocol END AS kind FROM v_packets QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY frame_number) <= 500)
{FLOW_LINES} UNION ALL
SELECT job_id, 13, 'Calls', '- Call ' || call_id || ' | From: ' || from_uri || ' | To: ' || to_uri || ' | MOS: ' || printf('%.3f', round(mos * 1000) / 1000) || ' | Quality: ' || quality || ' | EndType: ' || end_type || ' | RootCause: ' || root_cause FROM v_calls UNION ALL
SELECT job_id, 14, 'Events/Alerts', '- [' || severity || '] ' || protocol || ': ' || title || ' - ' || description FROM e UNION ALL
SELECT job_id, 15, kind || ' Packets (' || count(*) OVER (PARTITION BY job_id, kind) || ' total)', '- Frame #' || frame_number || ' [' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '] ' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port || ' | ' || kind FROM p UNION ALL
SELECT job_id, 16, 'Summary', '- Total ' || k || ': ' || coalesce(n, 0) FROM (SELECT DISTINCT job_id FROM (SELECT job_id FROM v_flows UNION ALL SELECT job_id FROM v_calls UNION ALL SELECT job_id FROM e UNION ALL SELECT job_id FROM p)) j
  CROSS JOIN (SELECT unnest(['Flows', 'Calls', 'Events', 'Packets']) AS k) t
  LEFT JOIN (SELECT job_id, 'Flows' AS k, count(*) AS n FROM v_flows GROUP BY ALL UNION ALL SELECT job_id, 'Calls', count(*) FROM v_calls GROUP BY ALL UNION ALL SELECT job_id, 'Events', count(*) FROM e GROUP BY ALL UNION ALL SELECT job_id, 'Packets', count(*) FROM p GROUP BY ALL) c USING (job_id, k)
""", context.job_lines, "flows", "calls", "events", "packets")
