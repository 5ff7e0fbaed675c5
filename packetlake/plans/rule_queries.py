"""Detection rules by name. Thresholds are set so that rules fire on the tables' ranges."""

from __future__ import annotations

from ..operators import detect as d
from .catalog import named

CODE = r"TRY_CAST(regexp_extract(response, '^(?:SIP/2\.0 )?(\d{3})', 1) AS INT)"
SECONDS = "(epoch_us(end_time) - epoch_us(start_time)) / 1000000.0"


#: SQL and thresholds of the rules, by name.
STATEMENTS: dict[str, str] = {}
SETTINGS: dict[str, dict] = {}
#: What the SQL of a rule reads.
SOURCES: dict[str, str] = {}
#: The columns that each rule's query gives; ``alert_texts`` has the others.
SHOWN = ["rule", "severity", "protocol", "title", "flow_id", "subject", "value"]


def bands(v: str, *least: tuple[float, str], op: str = ">=") -> str:
    return "CASE " + " ".join(f"WHEN {v} {op} {b} THEN '{s}'" for b, s in sorted(least, reverse=True)) + " END"


def ruled(name: str, protocol: str, severity: str, title: str, source: str, flow_id: str = "NULL", subject: str = "NULL", value: str = "NULL", **settings) -> None:
    sql = f"SELECT '{name}' AS rule, {severity} AS severity, {protocol} AS protocol, {title} AS title, CAST({flow_id} AS STRING) AS flow_id, CAST({subject} AS STRING) AS subject, CAST({value} AS DOUBLE) AS value FROM {source}"
    named(f"rule_{name}", sql, lambda f: d.RULES[name](f, **settings).select(*SHOWN), "flows")
    STATEMENTS[name], SETTINGS[name], SOURCES[name] = sql, settings, source


def only(type_: str, more: str = "true", columns: str = "*") -> str:
    return f"(SELECT {columns} FROM v_flows WHERE type = '{type_}' AND {more})"


def grouped(key: str, where: str, value: str = "count(*)", having: str = "true") -> str:
    return f"(SELECT {key}, {value} AS n FROM v_flows WHERE {where} GROUP BY ALL) WHERE {having}"


ruled("sip_errors", "'SIP'", "CASE WHEN c >= 500 THEN 'error' ELSE 'warning' END", "'SIP Error: ' || response", only("SIP", f"{CODE} BETWEEN 400 AND 699", f"*, {CODE} AS c"), "flow_id", "src_ip", "c")
LOSS = only("RTP", "packets > 0", "*, 100.0 * max_seq_gap / packets AS v")
ruled("rtp_loss", "'RTP'", bands("v", (5, "warning"), (15, "error"), op=">"), "printf('High Packet Loss (%.1f%%)', round(v * 10) / 10)", f"{LOSS} WHERE v > 5", "flow_id", "src_ip", "v")
ruled("rtp_jitter", "'RTP'", bands("jitter_ms", (30, "warning"), (100, "error"), op=">"), "printf('High Jitter (%.1fms)', round(jitter_ms * 10) / 10)", only("RTP", "jitter_ms > 30"), "flow_id", "src_ip", "jitter_ms")
ruled("dns_errors", "'DNS'", "CASE WHEN error_type = 'SERVFAIL' THEN 'error' ELSE 'warning' END", "'DNS ' || error_type || ': ' || query_name", only("DNS", "is_error"), "flow_id", "query_name")
ruled("diameter_failures", "'Diameter'", "'error'", "'Diameter ' || command || ' Failed (RC=' || result_code || ')'", only("Diameter", "is_error"), "flow_id", "src_ip")
ruled("gtp_failures", "'GTP'", "'error'", "'GTP ' || message_type || ' Failed (Cause=' || cause_code || ')'", only("GTP", "is_error"), "flow_id", "src_ip")
ruled("pfcp_failures", "'PFCP'", "'error'", "'PFCP ' || message_type || ' Failed (Cause=' || cause_code || ')'", only("PFCP", "is_error"), "flow_id", "src_ip")
ruled("one_way_audio", "'RTP'", "'warning'", "'Possible One-Way Audio'", "v_flows a WHERE type = 'RTP' AND packets > 40 AND NOT EXISTS (SELECT 1 FROM v_flows b WHERE b.type = 'RTP' AND b.src_ip = a.dst_ip AND b.dst_ip = a.src_ip AND b.packets > 10)", "flow_id", "src_ip", "packets", least=40)
ruled("volume_spike", "type", "'warning'", "'Packet Volume Spike (' || packets || ' pkts)'", "v_flows WHERE packets >= 45 AND packets > 1.8 * (SELECT avg(packets) FROM v_flows)", "flow_id", "src_ip", "packets", least=45, times=1.8)
ruled("oversized_packets", "type", "'warning'", "'Oversized ' || type || ' Packet (' || max_packet_size || ' bytes)'", "v_flows WHERE max_packet_size > CASE type WHEN 'RTP' THEN 400 WHEN 'DNS' THEN 512 WHEN 'SIP' THEN 4000 END", "flow_id", "src_ip", "max_packet_size")
ruled("packet_flood", "'*'", "'error'", "'Packet Flood from ' || src_ip", grouped("src_ip", "true", "sum(packets)", "n >= 1000 AND n > 0.04 * (SELECT sum(packets) FROM v_flows)"), "NULL", "src_ip", "n", share=0.04)
ruled("syn_flood", "'TCP'", bands("n", (2, "warning"), (5, "error"), (9, "critical")), "'TCP SYN Flood: ' || src_ip || ' (' || n || ' half-open connections)'", grouped("src_ip", "contains(tcp_flags, 'SYN') AND NOT contains(tcp_flags, 'ACK')", having="n >= 2"), "NULL", "src_ip", "n", warning=2, error=5, critical=9)
ruled("icmp_flood", "'ICMP'", bands("n", (5, "warning"), (15, "error"), (20, "critical")), "'ICMP Flood: ' || src_ip || ' (' || n || ' ICMP flows)'", grouped("src_ip", "flow_id LIKE '%-ICMP' OR flow_id LIKE '%-ICMPv6'", having="n >= 5"), "NULL", "src_ip", "n", warning=5, error=15, critical=20)
STANDARD = "CASE type WHEN 'SIP' THEN [5060, 5061] WHEN 'DNS' THEN [53] WHEN 'Diameter' THEN [3868] WHEN 'GTP' THEN [2123, 2152] WHEN 'PFCP' THEN [8805] END"
ruled("unusual_port", "type", "'warning'", "'Unusual ' || type || ' Port (' || src_port || ' -> ' || dst_port || ')'", f"(SELECT type, src_ip, src_port, dst_ip, dst_port, count(*) AS n, first(flow_id ORDER BY start_time, flow_id) AS f FROM v_flows WHERE type IN ('SIP', 'DNS', 'Diameter', 'GTP', 'PFCP') AND NOT list_contains({STANDARD}, src_port) AND NOT list_contains({STANDARD}, dst_port) GROUP BY ALL)", "f", "src_ip", "n")
OWNER = "CASE port WHEN 5060 THEN 'SIP' WHEN 5061 THEN 'SIP' WHEN 53 THEN 'DNS' WHEN 3868 THEN 'Diameter' WHEN 2123 THEN 'GTP' WHEN 2152 THEN 'GTP' WHEN 8805 THEN 'PFCP' END"
ruled("protocol_mismatch", "type", "'error'", "'Protocol Mismatch (port ' || port || ')'", f"(SELECT type, flow_id, src_ip, unnest([src_port, dst_port]) AS port FROM v_flows) WHERE {OWNER} <> type", "flow_id", "src_ip", "port")
ruled("source_fan_out", "'*'", bands("n", (20, "warning"), (50, "error")), "'Source Fan-Out: ' || src_ip || ' (' || n || ' destinations)'", grouped("src_ip", "true", "count(DISTINCT dst_ip)", "n >= 20"), "NULL", "src_ip", "n")
ruled("traffic_concentration", "'*'", "'warning'", "'Traffic Concentration: ' || ip || ' (' || side || ')'", "(SELECT src_ip AS ip, 'source' AS side, count(*) AS n FROM v_flows GROUP BY 1 UNION ALL SELECT dst_ip, 'destination', count(*) FROM v_flows GROUP BY 1) WHERE n > 0.03 * (SELECT count(*) FROM v_flows)", "NULL", "ip", "n", share=0.03)
ruled("repeated_failures", "split_part(key, ':', 1)", bands("n", (5, "warning"), (20, "error")), "'Repeated Failures: ' || key || ' (' || n || ' times)'", grouped("type || ':' || error_type AS key", "is_error", having="n >= 5"), "NULL", "key", "n")
ruled("register_flood", "'SIP'", bands("n", (20, "warning"), (50, "error")), "'SIP REGISTER Flood (' || n || ' requests)'", "(SELECT count(*) AS n FROM v_flows WHERE type = 'SIP' AND method = 'REGISTER') WHERE n >= 20", value="n")
ruled("dns_query_flood", "'DNS'", bands("n", (2, "warning"), (5, "error")), "'DNS Query Flood: ' || query_name || ' (' || n || ' queries)'", grouped("query_name", "type = 'DNS'", having="n >= 2"), "NULL", "query_name", "n", warning=2, error=5)
ruled("long_duration", "type", "'warning'", "'Long Duration ' || type || ' Flow (' || CAST(v AS BIGINT) || 's)'", f"(SELECT *, {SECONDS} AS v FROM v_flows) WHERE v > CASE type WHEN 'DNS' THEN 30 WHEN 'Diameter' THEN 300 WHEN 'PFCP' THEN 300 WHEN 'GTP' THEN 600 WHEN 'RTP' THEN 7200 WHEN 'SIP' THEN 7200 END", "flow_id", "src_ip", "v")
ruled("traffic_burst", "'*'", "'warning'", "'Traffic Burst (' || n || ' flows/sec)'", "(SELECT date_trunc('hour', start_time) AS tick, count(*) AS n FROM v_flows GROUP BY 1) WHERE n > 2 * (SELECT avg(k) FROM (SELECT count(*) AS k FROM v_flows GROUP BY date_trunc('hour', start_time)))", "NULL", "strftime(tick, '%Y-%m-%d %H:%M:%S')", "n", times=2, width="hour")
ruled("jitter_variance", "'RTP'", bands("v", (50, "warning"), (200, "error"), op=">"), "printf('High Jitter Variance (%.1fms spread)', round(v * 10) / 10)", only("RTP", "jitter_avg_ms > 0 AND jitter_max_ms - jitter_min_ms > 3 * jitter_avg_ms AND jitter_max_ms - jitter_min_ms > 50", "*, jitter_max_ms - jitter_min_ms AS v"), "flow_id", "src_ip", "v")
ruled("dns_slow", "'DNS'", bands("latency_ms", (500, "warning"), (2000, "error"), op=">"), "printf('Slow DNS Response (%.0fms)', round(latency_ms))", only("DNS", "latency_ms > 500"), "flow_id", "query_name", "latency_ms")
ruled("sip_slow_setup", "'SIP'", bands("setup_latency_ms", (3000, "warning"), (10000, "error"), op=">"), "printf('Slow SIP Setup (%.1fs)', round(setup_latency_ms / 1000 * 10) / 10)", only("SIP", "setup_latency_ms > 3000"), "flow_id", "src_ip", "setup_latency_ms")
QOS = "(SELECT *, least(greatest(1 + 0.035 * r + r * (r - 60) * (100 - r) * 0.000007, 1.0), 4.5) AS v FROM (SELECT *, least(greatest(94.2 - 2.5 * (100.0 * max_seq_gap / packets) - 0.1 * jitter_ms, 0.0), 100.0) AS r FROM v_flows WHERE type = 'RTP' AND packets > 0))"
ruled("qos_degradation", "'RTP'", "CASE WHEN v < 2.6 THEN 'error' ELSE 'warning' END", "printf('QoS Degradation (est. MOS %.1f)', round(v * 10) / 10)", f"{QOS} WHERE v < 3.6", "flow_id", "src_ip", "v")
ruled("sip_brute_force", "'SIP'", bands("n", (1, "warning"), (3, "error"), (6, "critical")), "'SIP Brute Force: ' || src_ip || ' (' || n || ' × 401)'", grouped("src_ip", f"type = 'SIP' AND {CODE} = 401"), "NULL", "src_ip", "n", warning=1, error=3, critical=6)
BASE = "CASE WHEN contains(query_name, '.') THEN array_to_string(list_slice(string_split(query_name, '.'), -2, -1), '.') END"
TUNNEL = f"""(SELECT *, CASE WHEN l > 3 THEN 3 ELSE 0 END + CASE WHEN t > 2 THEN 2 ELSE 0 END + CASE WHEN labels / total > 0.8 AND total >= 10 THEN 3 ELSE 0 END + CASE WHEN nx > 5 THEN 2 ELSE 0 END AS score FROM (
  SELECT {BASE} AS base, count(*) AS total, count(*) FILTER (length(query_name) > 52) AS l, count(*) FILTER (query_type IN ('TXT', 'NULL')) AS t, count(*) FILTER (reply_code = 'NXDOMAIN') AS nx, count(DISTINCT split_part(query_name, '.', 1)) AS labels
  FROM v_flows WHERE type = 'DNS' GROUP BY 1) WHERE total >= 5)"""
ruled("dns_tunneling", "'DNS'", bands("score", (3, "warning"), (4, "error"), (6, "critical")), "'DNS Tunneling: ' || base || ' (score=' || score || ')'", f"{TUNNEL} WHERE score >= 3", "NULL", "base", "score")
REASON = "CASE c WHEN 480 THEN 'Temporarily Unavailable' WHEN 486 THEN 'Busy Here' WHEN 487 THEN 'Request Cancelled' WHEN 503 THEN 'Service Unavailable' WHEN 504 THEN 'Server Timeout' END"
ruled("call_drop", "'SIP'", "'warning'", "t", f"""(SELECT flow_id, src_ip, v, printf('VoIP Call Drop (%.1fs)', round(v * 10) / 10) AS t FROM (SELECT *, {SECONDS} AS v FROM v_flows WHERE type = 'SIP' AND end_type IN ('BYE', 'CANCEL')) WHERE v > 0 AND v < 30 UNION ALL
  SELECT flow_id, src_ip, c, 'VoIP Call Drop: ' || {REASON} || ' (' || c || ')' FROM (SELECT *, {CODE} AS c FROM v_flows WHERE type = 'SIP') WHERE {REASON} IS NOT NULL)""", "flow_id", "src_ip", "v")
VERSION = "replace(replace(tls_version, 'SSL 3.0', 'SSLv3'), 'TLS 1.', 'TLSv1.')"
ruled("tls_downgrade", "'TLS'", "CASE ver WHEN 'SSLv3' THEN 'critical' WHEN 'TLSv1.0' THEN 'error' ELSE 'warning' END", "'TLS Downgrade: ' || ver || CASE ver WHEN 'SSLv3' THEN ' (POODLE)' WHEN 'TLSv1.0' THEN ' (BEAST/POODLE)' ELSE ' (deprecated — IETF RFC 8996)' END", only("TLS", f"{VERSION} IN ('SSLv3', 'TLSv1.0', 'TLSv1.1')", f"*, {VERSION} AS ver"), "flow_id", "sni")
METHOD = "(SELECT src_ip, count(DISTINCT dst_ip) AS dst, count(*) FILTER (type = 'SIP' AND method = '{}') AS n FROM v_flows GROUP BY 1)"
ruled("sip_options_scan", "'SIP'", "CASE WHEN n >= 50 OR dst >= 20 THEN 'error' ELSE 'warning' END", "'SIP Endpoint Scanning: ' || src_ip || ' (' || n || ' OPTIONS)'", METHOD.format("OPTIONS") + " WHERE n >= 5 AND dst >= 5", "NULL", "src_ip", "n", least=5)
ruled("sip_invite_flood", "'SIP'", "CASE WHEN dst >= 10 THEN 'critical' WHEN n >= 50 THEN 'error' ELSE 'warning' END", "'SIP INVITE Flood: ' || src_ip || ' (' || n || ' INVITEs)'", METHOD.format("INVITE") + " WHERE n >= 15", "NULL", "src_ip", "n")
HIJACK = f"""(WITH s AS (SELECT split_part(flow_id, '-', 1) AS id, method, src_ip, dst_ip, start_time, {CODE} AS c, response FROM v_flows WHERE type = 'SIP'),
  last AS (SELECT id, last({{'s': src_ip, 'd': dst_ip}} ORDER BY start_time, src_ip, dst_ip) AS p FROM s WHERE method = 'INVITE' AND (c = 200 OR response = '') GROUP BY 1)
  SELECT s.id, method, src_ip FROM s JOIN last ON s.id = last.id WHERE method IN ('BYE', 'CANCEL') AND src_ip <> p.s AND src_ip <> p.d)"""
named("rule_sip_hijack", f"SELECT 'sip_hijack' AS rule, 'critical' AS severity, 'SIP' AS protocol, 'SIP Call Hijack: ' || method || ' from unexpected IP ' || src_ip AS title, id AS flow_id, src_ip AS subject, CAST(NULL AS DOUBLE) AS value FROM {HIJACK}",
      lambda f: d.sip_hijack(f.withColumn("flow_id", d.F.split("flow_id", "-")[0])).select(*SHOWN), "flows")
ENTROPY = "(SELECT sum(-p * log2(p)) FROM (SELECT count(*) / CAST(length({0}) AS DOUBLE) AS p FROM (SELECT unnest(string_split({0}, '')) AS c) GROUP BY c))"
DGA = f"""(SELECT f.flow_id, f.query_name, score FROM v_flows f JOIN (
  SELECT query_name, CASE WHEN e >= 3.5 THEN 3 ELSE 0 END + CASE WHEN lower(list_extract(string_split(query_name, '.'), -1)) IN ('xyz', 'top', 'club', 'gq', 'cf', 'ga', 'ml', 'tk', 'pw', 'work', 'click', 'download', 'stream', 'zip', 'mov') THEN 2 ELSE 0 END
    + CASE WHEN length(label) >= 16 THEN 1 ELSE 0 END + CASE WHEN q <= 2 THEN 1 ELSE 0 END AS score
  FROM (SELECT query_name, label, q, {ENTROPY.format('label')} AS e FROM (SELECT query_name, split_part(query_name, '.', 1) AS label, count(*) AS q FROM v_flows WHERE type = 'DNS' AND length(query_name) >= 8 AND contains(query_name, '.') GROUP BY 1, 2))) s
  ON f.query_name = s.query_name WHERE f.type = 'DNS' AND score >= 3)"""
ruled("dns_dga", "'DNS'", bands("score", (3, "warning"), (4, "error"), (5, "critical")), "'Suspected DGA/C2 Domain: ' || query_name", DGA, "flow_id", "query_name", "score")
ruled("dns_fast_flux", "'DNS'", bands("n", (5, "warning"), (8, "error"), (15, "critical")), "'DNS Fast-Flux: ' || base || ' (' || n || ' IPs)'", f"(SELECT base, count(DISTINCT a) AS n FROM (SELECT {BASE} AS base, unnest(string_split(answer_list, ',')) AS a FROM v_flows WHERE type = 'DNS') WHERE base IS NOT NULL GROUP BY 1) WHERE n >= 5", "NULL", "base", "n")
BROKEN = "len(list_filter(['NULL', 'EXPORT', 'ANON', 'RC4', '_DES_', '3DES', 'RC2', 'IDEA', 'KRB5'], lambda x: contains(upper(cipher_suite), x)))"
ruled("tls_weak_cipher", "'TLS'", "CASE WHEN broken > 0 THEN 'critical' ELSE 'warning' END", "CASE WHEN broken > 0 THEN 'Broken Cipher: ' ELSE 'No Forward Secrecy: ' END || cipher_suite", f"(SELECT *, {BROKEN} AS broken FROM v_flows WHERE type = 'TLS') WHERE broken > 0 OR NOT contains(upper(cipher_suite), 'DHE')", "flow_id", "sni", "broken")
JA3 = "CASE ja3_hash WHEN 'e7d705a3286e19ea42f587b344ee6865' THEN 'Mirai botnet C2' WHEN '6bea65232d2734571b057466a576d801' THEN 'Agent Tesla' END"
ruled("tls_ja3", "'TLS'", "'critical'", f"'Malicious JA3: ' || substr(ja3_hash, 1, 8) || ' (' || {JA3} || ')'", only("TLS", f"{JA3} IS NOT NULL"), "flow_id", "ja3_hash")
ruled("tls_self_signed", "'TLS'", "CASE WHEN dst_port IN (443, 8443) THEN 'error' ELSE 'warning' END", "'Self-Signed Cert: ' || sni || ' (' || dst_ip || ')'", only("TLS", "cert_self_signed AND NOT regexp_matches(sni, '\\.(local|internal|lan)$')"), "flow_id", "sni")
ruled("suspicious_rst", "'TCP'", "'warning'", "'Suspicious RST: ' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port", "v_flows WHERE rst_authenticity = 'suspicious'", "flow_id", "src_ip")
ruled("nas_auth_failures", "'NAS5G'", "'critical'", "'NAS Authentication Failure Storm'", grouped("src_ip", "type = 'NAS5G'", "sum(auth_failures + CASE WHEN message_type IN ('Authentication Failure', 'Authentication Reject') THEN 1 ELSE 0 END)", "n > 10"), "NULL", "src_ip", "n")
ruled("pdu_session_flood", "'NAS5G'", "'warning'", "'PDU Session Establishment Flood'", "(SELECT count(*) AS n FROM v_flows WHERE type = 'NAS5G' AND message_type = 'PDU Session Establishment Request') WHERE n > 20", value="n", most=20)
ruled("pfcp_drop_rate", "'PFCP'", "'warning'", "'PFCP High DROP Action Rate'", "(SELECT count(*) AS total, count(*) FILTER (contains(apply_action, 'DROP')) AS n FROM v_flows WHERE type = 'PFCP') WHERE n * 2 > total", value="floor(n * 100 / total)")
ruled("sbi_error_rate", "'SBI'", "'error'", "'SBI High 5xx Error Rate'", "(SELECT count(*) AS total, sum(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END + error_count) AS n FROM v_flows WHERE type = 'SBI') WHERE n * 5 > total", value="n")
ruled("gtpu_tunnel_flood", "'GTPU'", "'warning'", "'GTP-U Tunnel Flood'", "(SELECT count(DISTINCT teid) AS n FROM v_flows WHERE type = 'GTPU') WHERE n > 30", value="n", most=30)
ruled("nf_registration_storm", "'SBI'", "'warning'", "'NF Registration Storm'", "(SELECT count(*) AS n FROM v_flows WHERE type = 'SBI' AND nf_type = 'NRF' AND service_name = 'nnrf-nfm' AND method IN ('PUT', 'POST')) WHERE n > 50", value="n")
# Here calls are told apart by the whole flow id.
STATEMENTS["sip_hijack"] = f"SELECT 'sip_hijack' AS rule, 'critical' AS severity, 'SIP' AS protocol, 'SIP Call Hijack: ' || method || ' from unexpected IP ' || src_ip AS title, id AS flow_id, src_ip AS subject, CAST(NULL AS DOUBLE) AS value FROM {HIJACK.replace("split_part(flow_id, '-', 1)", 'flow_id')}"
named("alerts_all", " UNION ALL ".join(f"SELECT * FROM ({STATEMENTS[n]})" for n in d.RULES), lambda f: d.run(f, list(d.RULES), texts=False, **SETTINGS).select(*SHOWN), "flows")
named("flow_figures", f"""
SELECT 'type' AS kind, type AS key, count(*) AS n, CAST(sum(packets) AS BIGINT) AS packets FROM v_flows GROUP BY ALL UNION ALL
SELECT 'sip_method', method, count(*), CAST(sum(packets) AS BIGINT) FROM v_flows WHERE type = 'SIP' GROUP BY ALL UNION ALL
SELECT 'sip_response', CAST({CODE} AS STRING), count(*), CAST(sum(packets) AS BIGINT) FROM v_flows WHERE type = 'SIP' GROUP BY ALL UNION ALL
SELECT 'diameter_command', command, count(*), CAST(sum(packets) AS BIGINT) FROM v_flows WHERE type = 'Diameter' GROUP BY ALL UNION ALL
SELECT 'failure', type || ':' || error_type, count(*), CAST(sum(packets) AS BIGINT) FROM v_flows WHERE is_error GROUP BY ALL
""", d.figures_by_key, "flows")
named("alerts_default", " UNION ALL ".join(f"SELECT * FROM ({STATEMENTS[n]})" for n in d.CORE if not SETTINGS.get(n)), lambda f: d.run(f, [n for n in d.CORE if not SETTINGS.get(n)], texts=False).select(*SHOWN), "flows")
