"""Columns of the canonical views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = """job_id long, frame_number long, timestamp timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, length long, payload binary, payload_len long,
seq long, ack long, flags int, ttl int, ip_id int, raw_packet binary"""

FLOW = """flow_id string, job_id long, type string, src_ip string, src_port int, dst_ip string, dst_port int, start_time timestamp_ntz, end_time timestamp_ntz, packets long, bytes long, is_error boolean, error_type string,
method string, response string, end_type string, setup_latency_ms double, max_seq_gap long, jitter_ms double, jitter_min_ms double, jitter_max_ms double, jitter_avg_ms double, max_packet_size long, packet_loss_pct double, rtt_ms double,
retransmissions long, throughput_bps double, query_name string, query_type string, reply_code string, answers array<string>, latency_ms double, command string, result_code long, message_type string, cause_code long,
tls_version string, cipher_suite string, ja3_hash string, sni string, cert_self_signed boolean, tcp_flags string, rst_authenticity string, imsi string, msisdn string, apn string, ue_ip string, teid string, media_ip string, media_port int,
auth_failures long, apply_action string, status_code int, error_count long, nf_type string, service_name string, details map<string,string>"""


def columns(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a schema text."""
    return [tuple(c.split(None, 1)) for c in " ".join(schema.split()).split(", ")]


def conform(df: DataFrame, schema: str = FLOW) -> DataFrame:
    """The schema's columns in order and of its types; null where ``df`` has none."""
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns(schema)])
