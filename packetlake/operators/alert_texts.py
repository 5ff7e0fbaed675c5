"""What alerts say: descriptions, and metadata by name.

Templates are rows of data: a name in braces stands for a fact of the alert, which its rule gives as text.
Alerts are far fewer than flows, so texts are made of alerts, after rules have found them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts of the alerts, and the names of what goes with them. {flow_id}, {subject}, {protocol} are the alert's own.
DESCRIPTIONS = {
    "sip_errors": "SIP call {flow_id} received error response {response}",
    "rtp_loss": "RTP stream {flow_id} has {loss}% packet loss ({gap} gaps in {packets} packets)",
    "rtp_jitter": "RTP stream {flow_id} has jitter of {jitter}ms",
    "dns_errors": "DNS lookup for {subject} returned {error}",
    "diameter_failures": "Diameter {what} returned result code {code}",
    "gtp_failures": "GTP {what} failed with cause {code}",
    "pfcp_failures": "PFCP {what} failed with cause {code}",
    "one_way_audio": "RTP stream {subject} -> {dst_ip} has {packets} packets but no return stream detected",
    "volume_spike": "{protocol} flow {flow_id} has {packets} packets (avg {mean}), >{times}x average",
    "oversized_packets": "{protocol} flow {flow_id} has packets up to {size} bytes (expected max {limit})",
    "packet_flood": "Source {subject} contributes {packets} packets ({share}% of total {total})",
    "syn_flood": "Source {subject} opened {n} TCP connections that never completed the handshake (SYN sent, ACK never received) — possible SYN flood DoS attack",
    "icmp_flood": "Source {subject} generated {n} ICMP flows — possible ping flood or ICMP-based DoS attack",
    "unusual_port": "{protocol} traffic {subject}:{src_port} -> {dst_ip}:{dst_port} uses non-standard ports (expected [{ports}]){seen}",
    "protocol_mismatch": "Flow {flow_id} on port {port} is {protocol} but expected {expected}",
    "source_fan_out": "Source {subject} communicates with {n} unique destinations, possible scanning activity",
    "traffic_concentration": "{side} {subject} appears in {n} of {total} flows ({share}%)",
    "repeated_failures": "Error pattern {subject} occurred {n} times across flows",
    "register_flood": "Detected {n} SIP REGISTER requests, possible registration flood attack",
    "dns_query_flood": "Domain {subject} queried {n} times, possible DNS flood or amplification",
    "long_duration": "{protocol} flow {flow_id} lasted {seconds} seconds (max expected {limit}s)",
    "traffic_burst": "At {at}: {n} flows started (avg {mean}/sec), >{times}x average rate",
    "jitter_variance": "RTP stream {flow_id} has jitter spread {spread}ms (min={min}, max={max}, avg={avg})",
    "dns_slow": "DNS query for {subject} took {latency}ms (flow {flow_id})",
    "sip_slow_setup": "SIP call {flow_id} took {seconds}s from INVITE to 200 OK",
    "qos_degradation": "RTP stream {flow_id}: estimated MOS {mos} (loss={loss}%, jitter={jitter}ms)",
    "sip_brute_force": "Source {subject} received {n} SIP 401 Unauthorized responses ({registers} REGISTER attempts) — credential brute-force attack",
    "dns_tunneling": "Domain {subject} shows DNS tunneling indicators: {reasons}",
    "call_drop": "SIP call {flow_id} terminated with {end_type} after {seconds}s — possible call drop or failed handoff",
    "call_refused": "SIP call {flow_id} returned {response} ({reason}) — call not established",
    "tls_downgrade": "Flow {flow_id} uses deprecated {version} between {src_ip}:{src_port} ↔ {dst_ip}:{dst_port} — {attack}",
    "suspicious_rst": "TCP connection {src_ip}:{src_port} -> {dst_ip}:{dst_port} was closed by an RST whose TTL is inconsistent with this flow's established network path ({reason}) — possible middlebox/IPS/firewall-injected reset rather than a genuine peer close",
    "sip_options_scan": "Source {subject} sent {n} SIP OPTIONS probes to {subs} distinct destinations — active SIP endpoint enumeration",
    "sip_invite_flood": "Source {subject} sent {n} SIP INVITE requests to {subs} destinations{suspicion}",
    "sip_hijack": "SIP {method} for call {flow_id} sent from {subject} — not a participant (original: {src} ↔ {dst})",
    "dns_dga": "Domain {subject} shows DGA/C2 indicators (score={score}): {reasons}",
    "dns_fast_flux": "Domain {subject} resolved to {n} different IPs — fast-flux botnet C2 pattern. Sample: {sample}",
    "broken_cipher": "TLS flow {flow_id} ({src_ip}:{src_port}→{dst_ip}:{dst_port}) negotiated broken cipher {cipher} — algorithms: {broken}",
    "tls_weak_cipher": "TLS flow {flow_id} ({src_ip}:{src_port}→{dst_ip}:{dst_port}) uses {cipher} — no forward secrecy (RSA key exchange only)",
    "tls_ja3": 'TLS flow {flow_id} ({src_ip}→{dst_ip} SNI="{sni}") matches known malicious JA3 {subject} — {malware}',
    "tls_self_signed": 'TLS connection to {subject} ({dst_ip}:{dst_port}) presents a self-signed certificate (Subject="{cert_subject}") — possible MITM proxy or malware C2',
    "nas_auth_failures": "UE {subject} has {n} authentication failures — possible SIM cloning, DoS, or brute force attack",
    "pdu_session_flood": "{n} PDU session establishment requests detected — possible session flood or misconfigured UE",
    "pfcp_drop_rate": "{share}% of PFCP sessions ({dropped}/{total}) have DROP action — possible misconfiguration or traffic blocking policy",
    "sbi_error_rate": "{share}% of SBI calls ({n}/{total}) returned 5xx errors — possible NF overload or configuration issue",
    "gtpu_tunnel_flood": "{n} unique GTP tunnels (TEIDs) detected — possible tunnel exhaustion or attack",
    "nf_registration_storm": "{n} NF registration calls to NRF detected — possible NF registration loop or attack",
}
METADATA = {
    "syn_flood": {"src_ip": "{subject}", "syn_only_flows": "{n}", "attack_type": "syn_flood"},
    "icmp_flood": {"src_ip": "{subject}", "icmp_flows": "{n}", "attack_type": "icmp_flood"},
    "unusual_port": {"occurrence_count": "{n}"},
    "sip_brute_force": {"src_ip": "{subject}", "count_401": "{n}", "count_register": "{registers}", "attack_type": "sip_brute_force"},
    "dns_tunneling": {"base_domain": "{subject}", "long_queries": "{long}", "txt_queries": "{txt}", "unique_labels": "{subs}", "total_queries": "{total}", "nxdomain_count": "{nx}", "tunnel_score": "{score}"},
    "call_drop": {"end_type": "{end_type}", "duration_ms": "{millis}"},
    "call_refused": {"sip_response": "{response}", "reason": "{reason}"},
    "tls_downgrade": {"tls_version": "{version}", "src_ip": "{src_ip}", "dst_ip": "{dst_ip}", "src_port": "{src_port}", "dst_port": "{dst_port}", "attack": "{attack}"},
    "suspicious_rst": {"rst_ttl": "{ttl}", "rst_ttl_baseline": "{baseline}", "rst_ttl_delta": "{delta}", "reason": "{reason}", "attack_type": "injected_rst"},
    "sip_options_scan": {"src_ip": "{subject}", "options_count": "{n}", "unique_dests": "{subs}", "attack_type": "sip_scanning"},
    "sip_invite_flood": {"src_ip": "{subject}", "invite_count": "{n}", "unique_dests": "{subs}", "attack_type": "{attack}"},
    "sip_hijack": {"hijack_ip": "{subject}", "original_src": "{src}", "original_dst": "{dst}", "method": "{method}", "attack_type": "sip_call_hijack"},
    "dns_dga": {"domain": "{subject}", "label": "{label}", "entropy": "{entropy}", "tld": "{tld}", "dga_score": "{score}", "query_count": "{n}", "attack_type": "dns_c2"},
    "dns_fast_flux": {"domain": "{subject}", "unique_ips": "{n}", "sample_ips": "{sample}", "attack_type": "dns_fast_flux"},
    "broken_cipher": {"cipher_suite": "{cipher}", "has_forward_secrecy": "{forward}", "weak_algorithms": "{broken}", "src_ip": "{src_ip}", "dst_ip": "{dst_ip}", "attack_type": "weak_cipher"},
    "tls_weak_cipher": {"cipher_suite": "{cipher}", "has_forward_secrecy": "{forward}", "weak_algorithms": "{broken}", "src_ip": "{src_ip}", "dst_ip": "{dst_ip}", "attack_type": "weak_cipher"},
    "tls_ja3": {"ja3_hash": "{subject}", "ja3_string": "{ja3_string}", "malware": "{malware}", "src_ip": "{src_ip}", "dst_ip": "{dst_ip}", "sni": "{sni}", "attack_type": "malicious_ja3"},
    "tls_self_signed": {"cert_subject": "{cert_subject}", "cert_issuer": "{cert_issuer}", "sni": "{subject}", "dst_ip": "{dst_ip}", "dst_port": "{dst_port}", "attack_type": "self_signed_cert"},
    "nas_auth_failures": {"ue_ip": "{subject}", "auth_failures": "{n}", "threshold": "{threshold}"},
    "pdu_session_flood": {"pdu_session_requests": "{n}", "threshold": "{threshold}"},
    "pfcp_drop_rate": {"drop_count": "{dropped}", "total_pfcp": "{total}", "drop_pct": "{share}", "threshold": "50"},
    "sbi_error_rate": {"error_count": "{n}", "total_sbi": "{total}", "error_pct": "{share}", "threshold": "20"},
    "gtpu_tunnel_flood": {"unique_teids": "{n}", "threshold": "{threshold}"},
    "nf_registration_storm": {"nrf_registrations": "{n}", "threshold": "{threshold}"},
}


def _parts(template: str) -> Column:
    """A template as an array of (text, name of the fact behind it)."""
    cut = re.split(r"\{(\w+)\}", template) + [""]
    return F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).alias("fact")) for a, b in zip(cut[::2], cut[1::2], strict=True)])


def _table(rows: dict[str, Column]) -> Column:
    return F.create_map(*[c for k, v in rows.items() for c in (F.lit(k), v)])


def with_texts(alerts: DataFrame) -> DataFrame:
    """Alerts of (…, said, facts) with ``description`` and ``metadata``, a map, in place of these two.

    ``said`` names the texts, ``facts`` holds what they tell; a fact that is missing or null is
    empty in a text. Metadata are empty for rules that have none.
    """
    own = F.create_map(*[c for k in ("flow_id", "subject", "protocol") for c in (F.lit(k), F.coalesce(k, F.lit("")))])
    facts = F.map_concat("facts", own)
    filled = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.coalesce(F.try_element_at(F.col("_facts"), p["fact"]), F.lit("")))), "")
    texts = _table({k: _parts(v) for k, v in DESCRIPTIONS.items()})
    names = _table({k: _table({n: _parts(t) for n, t in v.items()}) for k, v in METADATA.items()})
    metadata = F.transform_values(F.try_element_at(names, F.col("said")), lambda _, parts: filled(parts))
    told = alerts.withColumn("_facts", facts).withColumns({"description": filled(F.try_element_at(texts, F.col("said"))), "metadata": F.coalesce(metadata, F.create_map().cast("map<string,string>"))})
    return told.drop("said", "facts", "_facts")
