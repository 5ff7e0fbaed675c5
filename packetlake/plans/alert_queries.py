"""What alerts say, by name: descriptions and metadata of the rules whose queries ``rule_queries`` has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as d
from .catalog import named
from .rule_queries import CODE, SECONDS, SETTINGS, SOURCES, STANDARD


def digits(n: int, x: str) -> str:
    return f"printf('%.{n}f', round(({x}) * {10**n}.0) / {10**n}.0)"


ALL = "(SELECT count(*) FROM v_flows)"
ALL_PACKETS = "(SELECT sum(packets) FROM v_flows)"
ENDS = "src_ip || ':' || src_port || '{}' || dst_ip || ':' || dst_port"
LONGEST = "CASE type WHEN 'DNS' THEN 30 WHEN 'Diameter' THEN 300 WHEN 'PFCP' THEN 300 WHEN 'GTP' THEN 600 WHEN 'RTP' THEN 7200 WHEN 'SIP' THEN 7200 END"
PORT_OWNER = "CASE port WHEN 5060 THEN 'SIP' WHEN 5061 THEN 'SIP' WHEN 53 THEN 'DNS' WHEN 3868 THEN 'Diameter' WHEN 2123 THEN 'GTP' WHEN 2152 THEN 'GTP' WHEN 8805 THEN 'PFCP' END"
WHY = "CASE ver WHEN 'SSLv3' THEN 'POODLE' WHEN 'TLSv1.0' THEN 'BEAST/POODLE' ELSE 'deprecated — IETF RFC 8996' END"
BROKEN = "array_to_string(list_filter(['NULL', 'EXPORT', 'ANON', 'RC4', '_DES_', '3DES', 'RC2', 'IDEA', 'KRB5'], lambda x: contains(upper(cipher_suite), x)), ', ')"
MALWARE = "CASE ja3_hash WHEN 'e7d705a3286e19ea42f587b344ee6865' THEN 'Mirai botnet C2' ELSE 'Agent Tesla' END"

#: By rule: the description, and the metadata as (name, value), over the rows of the rule's own SQL.
TEXTS: dict[str, tuple[str, dict[str, str]]] = {
    "sip_errors": ("'SIP call ' || flow_id || ' received error response ' || response", {}),
    "rtp_loss": (f"'RTP stream ' || flow_id || ' has ' || {digits(1, 'v')} || '% packet loss (' || max_seq_gap || ' gaps in ' || packets || ' packets)'", {}),
    "rtp_jitter": (f"'RTP stream ' || flow_id || ' has jitter of ' || {digits(1, 'jitter_ms')} || 'ms'", {}),
    "dns_errors": ("'DNS lookup for ' || query_name || ' returned ' || error_type", {}),
    "diameter_failures": ("'Diameter ' || command || ' returned result code ' || result_code", {}),
    "gtp_failures": ("'GTP ' || message_type || ' failed with cause ' || cause_code", {}),
    "pfcp_failures": ("'PFCP ' || message_type || ' failed with cause ' || cause_code", {}),
    "one_way_audio": ("'RTP stream ' || src_ip || ' -> ' || dst_ip || ' has ' || packets || ' packets but no return stream detected'", {}),
    "oversized_packets": ("type || ' flow ' || flow_id || ' has packets up to ' || max_packet_size || ' bytes (expected max ' || CASE type WHEN 'RTP' THEN 400 WHEN 'DNS' THEN 512 ELSE 4000 END || ')'", {}),
    "protocol_mismatch": (f"'Flow ' || flow_id || ' on port ' || port || ' is ' || type || ' but expected ' || {PORT_OWNER}", {}),
    "long_duration": (f"type || ' flow ' || flow_id || ' lasted ' || {digits(0, SECONDS)} || ' seconds (max expected ' || {LONGEST} || 's)'", {}),
    "jitter_variance": (f"'RTP stream ' || flow_id || ' has jitter spread ' || {digits(1, 'v')} || 'ms (min=' || {digits(1, 'jitter_min_ms')} || ', max=' || {digits(1, 'jitter_max_ms')} || ', avg=' || {digits(1, 'jitter_avg_ms')} || ')'", {}),
    "dns_slow": (f"'DNS query for ' || query_name || ' took ' || {digits(0, 'latency_ms')} || 'ms (flow ' || flow_id || ')'", {}),
    "sip_slow_setup": (f"'SIP call ' || flow_id || ' took ' || {digits(1, 'setup_latency_ms / 1000')} || 's from INVITE to 200 OK'", {}),
    "qos_degradation": (f"'RTP stream ' || flow_id || ': estimated MOS ' || {digits(2, 'v')} || ' (loss=' || {digits(1, '100.0 * max_seq_gap / packets')} || '%, jitter=' || {digits(1, 'jitter_ms')} || 'ms)'", {}),
    "packet_flood": (f"'Source ' || src_ip || ' contributes ' || n || ' packets (' || {digits(0, f'100 * n / {ALL_PACKETS}')} || '% of total ' || {ALL_PACKETS} || ')'", {}),
    "syn_flood": (
        "'Source ' || src_ip || ' opened ' || n || ' TCP connections that never completed the handshake (SYN sent, ACK never received) — possible SYN flood DoS attack'",
        {"attack_type": "'syn_flood'", "src_ip": "src_ip", "syn_only_flows": "n"},
    ),
    "icmp_flood": ("'Source ' || src_ip || ' generated ' || n || ' ICMP flows — possible ping flood or ICMP-based DoS attack'", {"attack_type": "'icmp_flood'", "icmp_flows": "n", "src_ip": "src_ip"}),
    "unusual_port": (
        f"type || ' traffic ' || {ENDS.format(' -> ')} || ' uses non-standard ports (expected [' || array_to_string({STANDARD}, ' ') || '])' || CASE WHEN n > 1 THEN ' — seen across ' || n || ' messages/flows in this capture' ELSE '' END",
        {"occurrence_count": "n"},
    ),
    "source_fan_out": ("'Source ' || src_ip || ' communicates with ' || n || ' unique destinations, possible scanning activity'", {}),
    "traffic_concentration": (f"CASE side WHEN 'source' THEN 'Source ' ELSE 'Destination ' END || ip || ' appears in ' || n || ' of ' || {ALL} || ' flows (' || {digits(0, f'100 * n / {ALL}')} || '%)'", {}),
    "repeated_failures": ("'Error pattern ' || key || ' occurred ' || n || ' times across flows'", {}),
    "register_flood": ("'Detected ' || n || ' SIP REGISTER requests, possible registration flood attack'", {}),
    "dns_query_flood": ("'Domain ' || query_name || ' queried ' || n || ' times, possible DNS flood or amplification'", {}),
    "sip_brute_force": (
        "'Source ' || src_ip || ' received ' || n || ' SIP 401 Unauthorized responses (' || r || ' REGISTER attempts) — credential brute-force attack'",
        {"attack_type": "'sip_brute_force'", "count_401": "n", "count_register": "r", "src_ip": "src_ip"},
    ),
    "dns_tunneling": (
        f"'Domain ' || base || ' shows DNS tunneling indicators: ' || array_to_string(list_filter([CASE WHEN l > 3 THEN l || ' long subdomains (>52 chars)' END, CASE WHEN t > 2 THEN t || ' TXT/NULL queries' END, CASE WHEN labels / total > 0.8 AND total >= 10 THEN {digits(0, '100 * labels / total')} || '% unique subdomains (high entropy)' END, CASE WHEN nx > 5 THEN nx || ' NXDOMAIN responses' END], lambda x: x IS NOT NULL), '; ')",
        {"base_domain": "base", "long_queries": "l", "nxdomain_count": "nx", "total_queries": "total", "tunnel_score": "score", "txt_queries": "t", "unique_labels": "labels"},
    ),
    "tls_downgrade": (
        f"'Flow ' || flow_id || ' uses deprecated ' || ver || ' between ' || {ENDS.format(' ↔ ')} || ' — ' || {WHY}",
        {"attack": WHY, "dst_ip": "dst_ip", "dst_port": "dst_port", "src_ip": "src_ip", "src_port": "src_port", "tls_version": "ver"},
    ),
    "sip_options_scan": (
        "'Source ' || src_ip || ' sent ' || n || ' SIP OPTIONS probes to ' || dst || ' distinct destinations — active SIP endpoint enumeration'",
        {"attack_type": "'sip_scanning'", "options_count": "n", "src_ip": "src_ip", "unique_dests": "dst"},
    ),
    "sip_invite_flood": (
        "'Source ' || src_ip || ' sent ' || n || ' SIP INVITE requests to ' || dst || ' destinations' || CASE WHEN dst >= 10 THEN ' — suspected toll fraud (mass outbound calling)' WHEN n >= 50 THEN ' — possible SIP DoS / call flood' ELSE '' END",
        {"attack_type": "CASE WHEN dst >= 10 THEN 'toll_fraud' ELSE 'sip_invite_flood' END", "invite_count": "n", "src_ip": "src_ip", "unique_dests": "dst"},
    ),
    "tls_weak_cipher": (
        f"'TLS flow ' || flow_id || ' (' || {ENDS.format('→')} || ') ' || CASE WHEN broken > 0 THEN 'negotiated broken cipher ' || cipher_suite || ' — algorithms: ' || {BROKEN} ELSE 'uses ' || cipher_suite || ' — no forward secrecy (RSA key exchange only)' END",
        {"attack_type": "'weak_cipher'", "cipher_suite": "cipher_suite", "dst_ip": "dst_ip", "has_forward_secrecy": "contains(upper(cipher_suite), 'DHE')", "src_ip": "src_ip", "weak_algorithms": BROKEN},
    ),
    "tls_ja3": (
        f"'TLS flow ' || flow_id || ' (' || src_ip || '→' || dst_ip || ' SNI=\"' || sni || '\") matches known malicious JA3 ' || ja3_hash || ' — ' || {MALWARE}",
        {"attack_type": "'malicious_ja3'", "dst_ip": "dst_ip", "ja3_hash": "ja3_hash", "ja3_string": "''", "malware": MALWARE, "sni": "sni", "src_ip": "src_ip"},
    ),
    "nas_auth_failures": ("'UE ' || src_ip || ' has ' || n || ' authentication failures — possible SIM cloning, DoS, or brute force attack'", {"auth_failures": "n", "threshold": "10", "ue_ip": "src_ip"}),
    "pdu_session_flood": ("n || ' PDU session establishment requests detected — possible session flood or misconfigured UE'", {"pdu_session_requests": "n", "threshold": "20"}),
    "pfcp_drop_rate": (
        "CAST(floor(n * 100 / total) AS INT) || '% of PFCP sessions (' || n || '/' || total || ') have DROP action — possible misconfiguration or traffic blocking policy'",
        {"drop_count": "n", "drop_pct": "CAST(floor(n * 100 / total) AS INT)", "threshold": "50", "total_pfcp": "total"},
    ),
    "sbi_error_rate": (
        "CAST(floor(n * 100 / total) AS INT) || '% of SBI calls (' || n || '/' || total || ') returned 5xx errors — possible NF overload or configuration issue'",
        {"error_count": "n", "error_pct": "CAST(floor(n * 100 / total) AS INT)", "threshold": "20", "total_sbi": "total"},
    ),
    "gtpu_tunnel_flood": ("n || ' unique GTP tunnels (TEIDs) detected — possible tunnel exhaustion or attack'", {"threshold": "30", "unique_teids": "n"}),
    "nf_registration_storm": ("n || ' NF registration calls to NRF detected — possible NF registration loop or attack'", {"nrf_registrations": "n", "threshold": "50"}),
}
#: Rows with more columns than the rule's own query needs.
WIDER = {
    "protocol_mismatch": f"(SELECT type, flow_id, src_ip, unnest([src_port, dst_port]) AS port FROM v_flows) WHERE {PORT_OWNER} <> type",
    "sip_brute_force": f"(SELECT src_ip, count(*) FILTER ({CODE} = 401) AS n, count(*) FILTER (method = 'REGISTER') AS r FROM v_flows WHERE type = 'SIP' GROUP BY ALL) WHERE n >= 1",
}


def statement(name: str) -> str:
    text, metadata = TEXTS[name]
    joined = " || ',' || ".join(f"'{k}=' || ({v})" for k, v in metadata.items()) or "''"
    return f"SELECT '{name}' AS rule, {text} AS description, {joined} AS metadata FROM {WIDER.get(name, SOURCES[name])}"


def texts(flows: DataFrame) -> DataFrame:
    entries = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return d.run(flows, list(TEXTS), **SETTINGS).select("rule", "description", F.array_join(entries, ",").alias("metadata"))


named("alert_texts", " UNION ALL ".join(f"SELECT * FROM ({statement(n)})" for n in TEXTS), texts, "flows")
