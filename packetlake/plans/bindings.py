"""The canonical views over the star-schema tables.

Each view is one SELECT that Spark and DuckDB read alike, so that a query and the SQL it is held against
start from the same rows. Operators don't know these tables: they take any DataFrame with the columns of
a view, such as the flows decoded from captures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PACKETS = """
SELECT event_id AS frame_number, CAST(event_id % 5 AS BIGINT) AS job_id, ts AS timestamp,
  '10.0.' || CAST(CAST(floor(user_id / 64) AS BIGINT) AS STRING) || '.' || CAST(user_id % 64 AS STRING) AS src_ip,
  '192.168.0.' || CAST(event_id % 32 AS STRING) AS dst_ip,
  CAST(1024 + user_id AS INT) AS src_port,
  CASE event_type WHEN 'signup' THEN 5060 WHEN 'purchase' THEN 3868 WHEN 'error' THEN 53 WHEN 'click' THEN 80 ELSE 443 END AS dst_port,
  CASE WHEN event_type = 'error' THEN 'UDP' ELSE 'TCP' END AS protocol,
  CASE event_type WHEN 'signup' THEN 'SIP' WHEN 'purchase' THEN 'Diameter' WHEN 'error' THEN 'DNS' WHEN 'click' THEN 'HTTP' ELSE '' END AS app_protocol,
  CAST(floor(value) AS BIGINT) + 64 AS length, props AS metadata
FROM {events}
"""

EVENTS = """
SELECT event_id, CAST(event_id % 5 AS BIGINT) AS job_id, ts AS timestamp,
  CASE WHEN event_id % 17 = 0 THEN 'critical' WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'warning' ELSE 'info' END AS severity,
  CASE event_type WHEN 'signup' THEN 'SIP' WHEN 'purchase' THEN 'Diameter' WHEN 'error' THEN 'DNS' WHEN 'click' THEN 'HTTP' ELSE 'TLS' END AS protocol,
  event_type || ' ' || CAST(user_id % 20 AS STRING) AS title, 'call ' || CAST(event_id % 900 AS STRING) || ' of user ' || CAST(user_id AS STRING) AS description
FROM {events}
"""

#: All protocols' flows; columns that a protocol has not are null.
FLOWS = """
SELECT flow_id, job_id, type, src_ip, src_port, dst_ip, dst_port, start_time, start_time + INTERVAL '1' SECOND * span AS end_time,
  packets, bytes, is_error, CASE WHEN is_error THEN CASE a % 3 WHEN 0 THEN 'SERVFAIL' WHEN 1 THEN 'NXDOMAIN' ELSE 'TIMEOUT' END END AS error_type,
  CASE WHEN type = 'SIP' THEN CASE a % 5 WHEN 0 THEN 'REGISTER' WHEN 1 THEN 'OPTIONS' WHEN 2 THEN 'BYE' ELSE 'INVITE' END
       WHEN type = 'SBI' THEN CASE a % 3 WHEN 0 THEN 'PUT' WHEN 1 THEN 'POST' ELSE 'GET' END
       WHEN type = 'HTTP' THEN CASE a % 2 WHEN 0 THEN 'GET' ELSE 'POST' END END AS method,
  CASE WHEN type = 'SIP' THEN CASE b % 8 WHEN 0 THEN 'SIP/2.0 401 Unauthorized' WHEN 1 THEN '486' WHEN 2 THEN 'SIP/2.0 503 Service Unavailable' WHEN 3 THEN '' ELSE 'SIP/2.0 200 OK' END END AS response,
  CASE WHEN type = 'SIP' THEN CASE b % 4 WHEN 0 THEN 'BYE' WHEN 1 THEN 'CANCEL' ELSE '' END END AS end_type,
  CASE WHEN type = 'SIP' THEN CAST((a * 37) % 14000 AS DOUBLE) END AS setup_latency_ms,
  CASE WHEN type = 'RTP' THEN CAST(b % 9 AS BIGINT) END AS max_seq_gap,
  CASE WHEN type = 'RTP' THEN CAST((a * 13) % 150 AS DOUBLE) END AS jitter_ms,
  CASE WHEN type = 'RTP' THEN CAST(a % 10 AS DOUBLE) END AS jitter_min_ms,
  CASE WHEN type = 'RTP' THEN CAST(a % 10 + (b * 7) % 300 AS DOUBLE) END AS jitter_max_ms,
  CASE WHEN type = 'RTP' THEN CAST(a % 10 + b % 60 AS DOUBLE) END AS jitter_avg_ms,
  CAST(60 + (a * 31) % 4400 AS BIGINT) AS max_packet_size,
  packet_loss_pct, rtt_ms, CAST(b % 6 AS BIGINT) AS retransmissions, CAST(CASE WHEN b % 10 = 0 THEN 0 ELSE bytes * 8 END AS DOUBLE) AS throughput_bps,
  CASE WHEN type = 'DNS' THEN CASE WHEN b % 4 = 0 THEN substr(md5(CAST(a AS STRING)), 1, 16) || CASE WHEN b % 8 = 0 THEN '.xyz' ELSE '.example.org' END
       WHEN b % 4 = 1 THEN md5(CAST(a AS STRING)) || substr(md5(CAST(b AS STRING)), 1, 24) || '.tunnel' || CAST(b % 5 AS STRING) || '.net' ELSE 'host' || CAST(a % 40 AS STRING) || '.corp' || CAST(b % 7 AS STRING) || '.com' END END AS query_name,
  CASE WHEN type = 'DNS' THEN CASE a % 6 WHEN 0 THEN 'TXT' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'NULL' ELSE 'A' END END AS query_type,
  CASE WHEN type = 'DNS' THEN CASE WHEN is_error THEN CASE a % 3 WHEN 0 THEN 'SERVFAIL' WHEN 1 THEN 'NXDOMAIN' ELSE '' END ELSE 'NOERROR' END END AS reply_code,
  CASE WHEN type = 'DNS' AND b % 3 <> 0 THEN '203.0.113.' || CAST(a % 50 AS STRING) || ',198.51.100.' || CAST(b % 9 AS STRING) END AS answer_list,
  CASE WHEN type = 'DNS' THEN CAST((b * 17) % 2600 AS DOUBLE) END AS latency_ms,
  CASE WHEN type = 'Diameter' THEN CASE a % 3 WHEN 0 THEN 'Update-Location' WHEN 1 THEN 'Authentication-Information' ELSE 'Credit-Control' END END AS command,
  CASE WHEN type = 'Diameter' THEN CAST(CASE WHEN is_error THEN 5001 ELSE 2001 END AS BIGINT) END AS result_code,
  CASE type WHEN 'GTP' THEN CASE a % 2 WHEN 0 THEN 'Create Session Request' ELSE 'Modify Bearer Request' END WHEN 'PFCP' THEN 'Session Establishment Request'
    WHEN 'NAS5G' THEN CASE a % 4 WHEN 0 THEN 'Authentication Failure' WHEN 1 THEN 'PDU Session Establishment Request' ELSE 'Registration Request' END WHEN 'NGAP' THEN 'InitialUEMessage' END AS message_type,
  CASE WHEN type IN ('GTP', 'PFCP') THEN CAST(CASE WHEN is_error THEN 72 WHEN type = 'GTP' THEN 16 ELSE 1 END AS BIGINT) END AS cause_code,
  CASE WHEN type = 'TLS' THEN CASE b % 6 WHEN 0 THEN 'TLS 1.0' WHEN 1 THEN 'TLSv1.1' WHEN 2 THEN 'SSL 3.0' ELSE 'TLS 1.3' END END AS tls_version,
  CASE WHEN type = 'TLS' THEN CASE a % 5 WHEN 0 THEN 'TLS_RSA_WITH_RC4_128_SHA' WHEN 1 THEN 'TLS_RSA_WITH_AES_128_CBC_SHA' WHEN 2 THEN 'TLS_RSA_WITH_3DES_EDE_CBC_SHA' ELSE 'TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384' END END AS cipher_suite,
  CASE WHEN type = 'TLS' THEN CASE a % 7 WHEN 0 THEN 'e7d705a3286e19ea42f587b344ee6865' WHEN 1 THEN '6bea65232d2734571b057466a576d801' ELSE md5(CAST(a AS STRING)) END END AS ja3_hash,
  CASE WHEN type = 'TLS' THEN CASE a % 4 WHEN 0 THEN 'files.local' ELSE 'www' || CAST(a % 30 AS STRING) || '.example.com' END END AS sni,
  CASE WHEN type = 'TLS' THEN b % 5 = 0 END AS cert_self_signed,
  CASE WHEN type = 'TCP' THEN CASE a % 4 WHEN 0 THEN 'SYN' WHEN 1 THEN 'SYN ACK PSH FIN' WHEN 2 THEN 'SYN ACK RST' ELSE 'ACK' END END AS tcp_flags,
  CASE WHEN type = 'TCP' AND a % 4 = 2 THEN CASE c % 3 WHEN 0 THEN 'suspicious' WHEN 1 THEN 'genuine' ELSE 'unknown' END END AS rst_authenticity,
  CASE WHEN type IN ('GTP', 'Diameter', 'NGAP') AND b % 5 <> 0 THEN '00101' || CAST(1000000000 + c % 40 AS STRING) END AS imsi,
  CASE WHEN type IN ('GTP', 'Diameter') AND a % 3 = 0 THEN '4477' || CAST(10000000 + c % 40 AS STRING) END AS msisdn,
  CASE WHEN type = 'GTP' AND a % 2 = 0 THEN CASE c % 2 WHEN 0 THEN 'internet' ELSE 'ims' END END AS apn,
  CASE WHEN type IN ('GTP', 'PFCP') AND c % 40 < 30 THEN '172.16.0.' || CAST(c % 40 AS STRING) END AS ue_ip,
  CASE WHEN type IN ('GTP', 'GTPU') THEN '0x' || substr(md5(CAST(c % 40 AS STRING)), 1, 8) END AS teid,
  CASE WHEN type = 'SIP' AND b % 3 <> 0 THEN '10.0.0.' || CAST(a % 25 AS STRING) END AS media_ip,
  CASE WHEN type = 'SIP' AND b % 3 <> 0 THEN CAST(49152 + 2 * (c % 20) AS INT) END AS media_port,
  CASE WHEN type = 'NAS5G' THEN CAST(b % 4 AS BIGINT) END AS auth_failures,
  CASE WHEN type = 'PFCP' THEN CASE a % 3 WHEN 0 THEN 'FORW' ELSE 'DROP' END END AS apply_action,
  CASE WHEN type IN ('HTTP', 'SBI') THEN CAST(CASE b % 4 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS INT) END AS status_code,
  CASE WHEN type = 'SBI' THEN CAST(b % 2 AS BIGINT) END AS error_count,
  CASE WHEN type = 'SBI' THEN CASE a % 2 WHEN 0 THEN 'NRF' ELSE 'AMF' END END AS nf_type,
  CASE WHEN type = 'SBI' THEN CASE a % 2 WHEN 0 THEN 'nnrf-nfm' ELSE 'namf-comm' END END AS service_name
FROM (
  SELECT *, CASE WHEN type = 'SIP' AND b % 3 = 1 THEN '172.16.0.' || CAST(c % 40 AS STRING) ELSE '10.0.0.' || CAST(s % 25 AS STRING) END AS src_ip, '10.1.' || CAST(a % 3 AS STRING) || '.' || CAST(b % 40 AS STRING) AS dst_ip,
    CAST(CASE WHEN type = 'SIP' AND a % 3 = 0 THEN 5060 WHEN type = 'RTP' THEN 49152 + 2 * (c % 20) ELSE 10000 + b % 500 END AS INT) AS src_port,
    CAST(CASE type WHEN 'SIP' THEN CASE a % 4 WHEN 0 THEN 5070 ELSE 5060 END WHEN 'DNS' THEN 53 WHEN 'Diameter' THEN 3868 WHEN 'GTP' THEN 2123 WHEN 'GTPU' THEN 2152 WHEN 'PFCP' THEN 8805
      WHEN 'TLS' THEN 443 WHEN 'HTTP' THEN 80 WHEN 'RTP' THEN 40000 + a % 50 WHEN 'ICMP' THEN 0 ELSE 8000 + a % 20 END AS INT) AS dst_port
  FROM (
    SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || CASE WHEN (l_orderkey + l_linenumber) % 16 = 10 THEN '-ICMP' ELSE '' END AS flow_id,
      CAST(l_orderkey % 4 AS BIGINT) AS job_id, l_suppkey AS s, l_partkey AS a, l_orderkey * 3 + l_linenumber AS b, l_partkey + l_suppkey AS c,
      CASE (l_orderkey + l_linenumber) % 16 WHEN 0 THEN 'SIP' WHEN 1 THEN 'RTP' WHEN 2 THEN 'DNS' WHEN 3 THEN 'Diameter' WHEN 4 THEN 'GTP' WHEN 5 THEN 'PFCP' WHEN 6 THEN 'TLS' WHEN 7 THEN 'TCP'
        WHEN 8 THEN 'UDP' WHEN 9 THEN 'HTTP' WHEN 10 THEN 'ICMP' WHEN 11 THEN 'NAS5G' WHEN 12 THEN 'SBI' WHEN 13 THEN 'GTPU' WHEN 14 THEN 'NGAP' ELSE 'SIP' END AS type,
      o_orderdate + INTERVAL '1' SECOND * ((l_partkey * 7 + l_suppkey) % 86400) AS start_time, (l_partkey * 11) % 700 AS span,
      CAST(l_quantity AS BIGINT) AS packets, CAST(floor(l_extendedprice) AS BIGINT) AS bytes, l_returnflag = 'R' AS is_error,
      floor(l_discount * 1000) / 10 AS packet_loss_pct, floor(l_tax * 10000) / 10 AS rtt_ms
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) AS keys) AS ends
"""

CALLS = """
SELECT CAST(o_orderkey % 4 AS BIGINT) AS job_id, CAST(o_orderkey AS STRING) AS call_id, c_name AS from_uri, 'sip:' || CAST(o_custkey % 97 AS STRING) || '@example.com' AS to_uri,
  o_orderdate AS start_time, o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 1900) AS end_time, CAST(o_orderkey % 1900 AS DOUBLE) AS duration_sec,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(10 + o_orderkey % 36 AS DOUBLE) / 10 END AS mos,
  CASE o_orderkey % 7 WHEN 0 THEN 'Excellent' WHEN 1 THEN 'good' WHEN 2 THEN 'Fair' WHEN 3 THEN 'poor' WHEN 4 THEN 'bad' WHEN 5 THEN '' ELSE 'Good' END AS quality,
  o_orderkey % 9 = 0 AS is_on_hold,
  CASE o_orderstatus WHEN 'F' THEN 'normal' WHEN 'O' THEN 'abnormal' ELSE 'dropped' END AS end_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'no_media' WHEN '2-HIGH' THEN 'high_packet_loss' WHEN '3-MEDIUM' THEN '' ELSE 'normal_release' END AS root_cause
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

LEGS = """
SELECT CAST(l_orderkey % 4 AS BIGINT) AS job_id, CAST(l_orderkey AS STRING) AS call_id, CAST(l_linenumber AS BIGINT) AS leg,
  '10.0.0.' || CAST(l_suppkey % 25 AS STRING) AS src_ip, CAST(49152 + 2 * (l_partkey % 20) AS INT) AS src_port, '10.1.0.' || CAST(l_partkey % 40 AS STRING) AS dst_ip, CAST(40000 + l_partkey % 50 AS INT) AS dst_port,
  l_partkey * 65536 + l_suppkey AS ssrc, CAST(l_quantity AS BIGINT) * 20 - 20 AS packet_count, floor(l_tax * 20000) / 10 AS jitter_ms, CAST(floor(l_discount * 100) AS BIGINT) AS max_seq_gap,
  l_shipdate AS start_time, l_shipdate + INTERVAL '1' SECOND * (l_partkey % 300) AS end_time
FROM {lineitem}
"""

ENRICHMENT = """
SELECT '10.0.0.' || CAST(s_suppkey % 25 AS STRING) AS ip, CAST(s_suppkey AS BIGINT) AS source_id, n_name AS country, r_name AS region, 'isp' || CAST(s_suppkey % 6 AS STRING) AS isp,
  s_suppkey % 7 = 0 AS is_hosting, s_suppkey % 13 = 0 AS is_tor, s_suppkey % 5 = 0 AS is_proxy, CAST(floor(abs(s_acctbal)) AS BIGINT) % 101 AS abuse_score,
  CAST(floor(abs(s_acctbal)) AS BIGINT) % 101 >= 75 AS is_abusive, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' DAY * (s_suppkey % 15) AS last_checked
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

#: Transport headers of packets in order of frame_number, and RTP headers of others.
SEGMENTS = """
SELECT event_id AS frame_number, CAST(event_id % 2 AS BIGINT) AS job_id, ts AS timestamp, CASE WHEN rev THEN b ELSE a END AS src_ip, CASE WHEN rev THEN a ELSE b END AS dst_ip,
  CAST(CASE WHEN rev THEN 443 ELSE 1000 + user_id % 20 END AS INT) AS src_port, CAST(CASE WHEN rev THEN 1000 + user_id % 20 ELSE 443 END AS INT) AS dst_port,
  CASE user_id % 4 WHEN 0 THEN 'UDP' WHEN 3 THEN 'ICMP' ELSE 'TCP' END AS protocol, CAST(floor(value) AS BIGINT) % 400 AS payload_len,
  (event_id * 53) % 4000 + 4294966000 AS seq, (event_id * 61) % 4400 + 4294966000 AS ack,
  CASE event_id % 11 WHEN 0 THEN 2 WHEN 3 THEN 18 WHEN 6 THEN 4 WHEN 9 THEN 17 ELSE 24 END AS flags, CAST(CASE WHEN event_id % 17 = 0 THEN 0 ELSE 50 + user_id % 3 + event_id % 8 END AS INT) AS ttl, CAST(event_id % 5 AS INT) AS ip_id,
  user_id * 7 AS ssrc, (event_id * 3) % 65536 AS rtp_seq, (event_id * 160 + user_id * 5) % 4294967296 AS rtp_time
FROM (SELECT *, event_id % 3 = 0 AS rev, '10.0.0.' || CAST(user_id % 20 AS STRING) AS a, '10.2.0.' || CAST(user_id % 7 AS STRING) AS b FROM {events}) AS ends
"""

#: Messages of chats; a message's turn stands for its time.
CHAT = "SELECT turn AS id, conv_id AS conversation_id, role, text AS content, turn AS created_at FROM {conversations}"

VIEWS = {"segments": SEGMENTS, "packets": PACKETS, "events": EVENTS, "flows": FLOWS, "calls": CALLS, "legs": LEGS, "enrichment": ENRICHMENT, "chat": CHAT}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view; ``flows`` also has its answers as an array."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in VIEWS[name]}
    df = spark.sql(VIEWS[name], **used)
    if name == "enrichment":
        df = df.withColumn("last_checked", F.col("last_checked").cast("timestamp_ntz"))
    return df.withColumn("answers", F.split("answer_list", ",")) if name == "flows" else df


def oracle(sql: str) -> str:
    """DuckDB SQL of ``sql`` over the views it names with a v_ before."""
    used = [n for n in VIEWS if f"v_{n}" in sql]
    heads = [f"v_{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in used]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(heads)}, {body[5:]}"
    return f"WITH {', '.join(heads)} {body}"
