"""Decoders by name, over packets whose bytes are made of known fields.

Each event gives the messages of one exchange. The SQL gives the fields that they were made of, so that
what a decoder reads from the bytes is held against them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decoders as d
from ..operators import reassembly
from .catalog import ORACLES, QUERIES

def bytes_of(text: str | Column) -> Column:
    return (F.lit(text) if isinstance(text, str) else text).cast("binary")


def raw(digits: str) -> Column:
    return F.unhex(F.lit(digits.replace(" ", "")))


def number(value: Column | int, size: int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def counted(value: Column, size: int) -> Column:
    """The value after its length in ``size`` bytes."""
    return F.concat(number(F.length(value), size), value)


def ie(kind: int, value: Column) -> Column:
    return F.concat(number(kind, 1), number(F.length(value), 2), raw("00"), value)


def ie2(kind: int, value: Column) -> Column:
    return F.concat(number(kind, 2), counted(value, 2))


def host() -> Column:
    E = F.col("event_id")
    return F.concat(F.lit("10.3."), (E % 50).cast("string"), F.lit("."), (E % 200).cast("string"))


HOST = "'10.3.' || CAST(event_id % 50 AS STRING) || '.' || CAST(event_id % 200 AS STRING)"
PEER = "10.4.0.1"
#: Events after which the ends of ``packets`` come again.
ENDS = 40_000


def packets(events: DataFrame, protocol: str, port: int, *payloads: tuple[bool, int, Column, Column | None]) -> DataFrame:
    """Packets between a host and a peer: (from the peer, milliseconds after the event, payload, only where).

    Each event is a connection of its own: events that share their ends are in different jobs.
    """
    E = F.col("event_id")
    # Payloads are columns before they are exploded: a projection evaluates what they share once, a generator each time it occurs.
    made = events.select("event_id", "ts", *[F.when(F.lit(True) if where is None else where, payload).alias(f"payload{n}") for n, (_, _, payload, where) in enumerate(payloads)])
    each = [F.struct(F.lit(n).alias("n"), F.lit(back).alias("back"), F.lit(ms).alias("ms"), F.col(f"payload{n}").alias("payload")) for n, (back, ms, _, _) in enumerate(payloads)]
    rows = made.select("event_id", "ts", F.explode(F.array(*each)).alias("p")).where("p.payload is not null")
    port_of = F.lit(20000) + E % ENDS
    pick = lambda a, b: F.when(F.col("p.back"), a).otherwise(b)
    fields = {
        "job_id": E % 5 + 5 * F.floor(E / ENDS), "frame_number": E * 8 + F.col("p.n"), "timestamp": F.col("ts").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, p.ms / 1000.0)"),
        "src_ip": pick(F.lit(PEER), host()), "dst_ip": pick(host(), F.lit(PEER)), "src_port": pick(F.lit(port), port_of).cast("int"), "dst_port": pick(port_of, F.lit(port)).cast("int"),
        "protocol": F.lit(protocol), "payload": F.col("p.payload"), "payload_len": F.length("p.payload").cast("long"), "length": F.length("p.payload").cast("long") + 54,
        "seq": F.lit(1000).cast("long") + F.col("p.n") * 100_000, "ack": F.lit(0).cast("long"), "flags": F.lit(24), "ttl": F.lit(64), "ip_id": F.lit(0), "raw_packet": F.lit(None).cast("binary"),
    }
    return rows.select(*[v.alias(k) for k, v in fields.items()])


def in_five_jobs(sent: DataFrame) -> DataFrame:
    """The packets in jobs 0 to 4: connections of the same host and port have different peers instead."""
    again = F.floor(F.col("frame_number") / (8 * ENDS))
    peer = F.concat_ws(".", F.lit("10.4"), F.floor(again / 250).cast("string"), (1 + again % 250).cast("string"))
    own = lambda side: F.when(F.col(side) == PEER, peer).otherwise(F.col(side))
    return sent.withColumns({"job_id": F.col("job_id") % 5, "src_ip": own("src_ip"), "dst_ip": own("dst_ip")})


#: What each decoder must read, by name.
SQL = {
    "dns": """
SELECT 'dns-' || CAST(event_id % 65536 AS STRING) || '-' || {host} || ':' || CAST(20000 + event_id % 40000 AS STRING) AS flow_id, 'host' || CAST(event_id % 70 AS STRING) || '.example.com' AS query_name, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'MX' END AS query_type,
  CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS reply_code, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(40 AS DOUBLE) END AS latency_ms, event_id % 3 = 0 OR event_id % 7 = 0 AS is_error,
  CASE WHEN event_id % 3 = 0 THEN 'TIMEOUT' WHEN event_id % 7 = 0 THEN 'NXDOMAIN' END AS error_type,
  CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 2 = 0 THEN ['203.0.113.' || CAST(event_id % 250 AS STRING)] ELSE ['10 mail.host' || CAST(event_id % 70 AS STRING) || '.example.com'] END END AS answers FROM {e}
""",
    "dns_errors": """
SELECT 'dns-' || CAST(event_id % 65536 AS STRING) || '-' || {host} || ':' || CAST(20000 + event_id % 40000 AS STRING) AS flow_id, unnest(CASE WHEN event_id % 3 = 0 THEN ['DNS_TIMEOUT'] ELSE CASE WHEN event_id % 7 = 0 THEN ['DNS_NXDOMAIN', 'DNS_SLOW'] ELSE ['DNS_SLOW'] END END) AS code FROM {e}
""",
    "http": """
SELECT 'http-' || CAST(event_id * 8 AS STRING) AS flow_id, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CAST(CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 ELSE 200 END AS INT) AS status_code, event_id % 4 IN (1, 2) OR event_id % 4 = 3 AS is_error,
  CASE event_id % 4 WHEN 1 THEN '404' WHEN 2 THEN '500' WHEN 3 THEN 'SOAP_FAULT' END AS error_type, CAST(25 AS DOUBLE) AS latency_ms, '/item/' || CAST(event_id AS STRING) AS uri, 'www' || CAST(event_id % 9 AS STRING) || '.example.com' AS host, 'probe/1.0' AS user_agent,
  CASE WHEN event_id % 4 = 3 THEN 'GetPrice' END AS soap_operation, CASE WHEN event_id % 4 = 3 THEN 'Server' END AS soap_fault_code FROM {e}
""",
    "sip": """
SELECT 'call' || CAST(event_id AS STRING) AS flow_id, 'INVITE' AS method, CASE WHEN event_id % 3 = 0 THEN 'SIP/2.0 486 Busy Here' ELSE 'SIP/2.0 200 OK' END AS response, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(300 AS DOUBLE) END AS setup_latency_ms, '10.9.0.' || CAST(event_id % 250 AS STRING) AS media_ip,
  CAST(30000 + 2 * (event_id % 1000) AS INT) AS media_port, '<sip:u' || CAST(event_id % 30 AS STRING) || '@x>' AS "from", CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END AS hold_count, CASE WHEN event_id % 2 = 0 THEN 'sendonly' END AS direction FROM {e}
""",
    "tls": """
SELECT 'tls-' || {host} || ':' || CAST(20000 + event_id % 40000 AS STRING) || '-{peer}:443' AS flow_id, {host} AS src_ip, CAST(443 AS INT) AS dst_port, 'www' || CAST(event_id % 40 AS STRING) || '.example.org' AS sni, 'TLS 1.2' AS tls_version,
  CASE event_id % 3 WHEN 0 THEN 'TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256' WHEN 1 THEN 'TLS_RSA_WITH_AES_128_CBC_SHA' ELSE '0x0005' END AS cipher_suite, event_id % 4 < 2 AS cert_self_signed, CASE event_id % 3 WHEN 0 THEN 'A' ELSE 'C' END AS cipher_strength, 'h2' AS alpn,
  md5('771,49199-4865,0-16,,') AS ja3_hash FROM {e}
""",
    "diameter": """
SELECT 'diameter-' || CAST(event_id * 8 + k AS STRING) AS flow_id, 'Update-Location' AS command, CASE WHEN k = 1 THEN CAST(CASE WHEN event_id % 5 = 0 THEN 5001 ELSE 2001 END AS BIGINT) END AS result_code, k = 1 AND event_id % 5 = 0 AS is_error,
  CASE WHEN k = 0 THEN '00101' || lpad(CAST(event_id % 1000 AS STRING), 10, '0') END AS imsi, 'S6a' AS app_name, CASE WHEN k = 0 THEN 'mme.example' END AS origin_host FROM {e}, (SELECT unnest([0, 1]) AS k)
""",
    "gtp": """
SELECT 'gtp-' || CAST(event_id * 8 + k AS STRING) AS flow_id, 'GTP' AS type, CASE WHEN k = 0 THEN 'Create Session Request' ELSE 'Create Session Response' END AS message_type, '0x' || lpad(lower(to_hex(event_id % 1000)), 8, '0') AS teid, CASE WHEN k = 1 THEN CAST(CASE WHEN event_id % 6 = 0 THEN 72 ELSE 16 END AS BIGINT) END AS cause_code,
  k = 1 AND event_id % 6 = 0 AS is_error, CASE WHEN k = 0 THEN '00101' || lpad(CAST(event_id % 1000 AS STRING), 10, '0') END AS imsi, CASE WHEN k = 0 THEN 'ims.net' END AS apn, CASE WHEN k = 1 THEN '172.20.0.' || CAST(event_id % 250 AS STRING) END AS ue_ip,
  CASE WHEN k = 0 THEN 'E-UTRAN' END AS rat_type, CASE WHEN k = 0 THEN '001-01' END AS serving_network, CASE WHEN k = 0 THEN '001-01-TAC:258' END AS tai, CASE WHEN k = 1 THEN 'ebi=5,qci=9,fteid=1:0x00000abc:10.4.0.1' END AS bearers FROM {e}, (SELECT unnest([0, 1]) AS k)
""",
    "gtpu": """
SELECT 'gtp-' || CAST(event_id * 8 AS STRING) AS flow_id, 'GTPU' AS type, 'G-PDU' AS message_type, '10.5.0.' || CAST(event_id % 250 AS STRING) AS inner_src_ip, 'UDP' AS inner_protocol, CAST(1000 + event_id % 100 AS STRING) AS inner_src_port FROM {e}
""",
    "pfcp": """
SELECT 'pfcp-' || CAST(event_id * 8 + k AS STRING) AS flow_id, CASE WHEN k = 0 THEN 'Session Establishment Request' ELSE 'Session Establishment Response' END AS message_type, CASE WHEN k = 1 THEN CAST(CASE WHEN event_id % 4 = 0 THEN 64 ELSE 1 END AS BIGINT) END AS cause_code, k = 1 AND event_id % 4 = 0 AS is_error,
  CASE WHEN k = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'DROP' ELSE 'FORW+NOCP' END END AS apply_action, CASE WHEN k = 0 THEN '10.6.0.' || CAST(event_id % 250 AS STRING) END AS ue_ip, CASE WHEN k = 0 THEN '10.4.0.9' END AS node_id, CASE WHEN k = 0 THEN '1' END AS far_count, CAST(7 + event_id % 100 AS STRING) AS seid FROM {e}, (SELECT unnest([0, 1]) AS k)
""",
    "ngap": """
SELECT 'ngap-' || CAST(event_id * 8 AS STRING) AS flow_id, CASE event_id % 2 WHEN 0 THEN 'InitialUEMessage' ELSE 'UplinkNASTransport' END AS message_type, CASE WHEN event_id % 2 = 0 THEN '00101' || lpad(CAST(event_id % 1000 AS STRING), 10, '0') END AS imsi FROM {e}
""",
    "s1ap": "SELECT 's1ap-' || CAST(event_id * 8 AS STRING) AS flow_id, CASE event_id % 2 WHEN 0 THEN 'InitialUEMessage' ELSE 'S1Setup' END AS message_type FROM {e}",
    "nas5g": """
SELECT 'nas5g-' || CAST(event_id * 8 AS STRING) AS flow_id, CASE event_id % 4 WHEN 0 THEN 'Authentication Failure' WHEN 1 THEN 'PDU Session Establishment Request' WHEN 2 THEN 'Registration Request' ELSE 'Security Mode Complete' END AS message_type, event_id % 4 = 0 AS is_error,
  CASE WHEN event_id % 4 = 0 THEN CAST(21 AS BIGINT) END AS cause_code, CASE WHEN event_id % 4 = 1 THEN '5' END AS pdu_session_id, CASE event_id % 4 WHEN 3 THEN '2' ELSE '0' END AS security_header FROM {e}
""",
    "http2": """
SELECT 'http2-' || CAST(event_id * 8 + k AS STRING) AS flow_id, CASE WHEN k = 0 AND event_id % 2 = 0 THEN 'SBI' ELSE 'HTTP2' END AS type, CASE WHEN k = 0 THEN 'PUT' END AS method, CASE WHEN k = 1 THEN CAST(CASE WHEN event_id % 5 = 0 THEN 503 ELSE 201 END AS INT) END AS status_code, CASE WHEN k = 0 AND event_id % 2 = 0 THEN 'NRF' END AS nf_type,
  CASE WHEN k = 0 AND event_id % 2 = 0 THEN 'nnrf-nfm' END AS service_name, CAST(CASE WHEN k = 1 AND event_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS error_count, CASE WHEN k = 0 AND event_id % 2 = 0 THEN 'v1' END AS api_version, CASE WHEN k = 1 THEN '3' ELSE '0' END AS data_bytes FROM {e}, (SELECT unnest([0, 1]) AS k)
""",
    "snmp": """
SELECT 'snmp-' || CAST(event_id * 8 AS STRING) AS flow_id, 'GetResponse' AS message_type, event_id % 4 = 0 AS is_error, 'v2c' AS version, 'public' AS community, CAST(event_id % 30000 AS STRING) AS request_id, ['1.3.6.1.2.1.1.5'] AS oids, 'sw' || CAST(event_id % 50 AS STRING) AS name FROM {e}
""",
    "ajp": """
SELECT 'ajp-' || CAST(event_id * 8 AS STRING) AS flow_id, 'GET' AS method, CAST(CASE WHEN event_id % 3 = 0 THEN 503 ELSE 200 END AS INT) AS status_code, event_id % 3 = 0 AS is_error, '/app/' || CAST(event_id AS STRING) AS req_uri, 'shop' AS server_name, '8080' AS server_port, CAST(30 AS DOUBLE) AS latency_ms FROM {e}
""",
    "websocket": """
SELECT 'ws-' || {host} || ':' || CAST(20000 + event_id % 40000 AS STRING) || '-{peer}:8080' AS flow_id, CAST(2 AS BIGINT) AS packets, '5' AS text_bytes, '3' AS bin_bytes FROM {e}
""",
    "rtcp": "SELECT event_id * 8 AS frame_number, {host} AS ip, CAST(17 AS BIGINT) AS reporter, event_id % 1000 AS source, CAST((event_id % 256) / 256 AS DOUBLE) AS fraction_lost, event_id % 500 AS jitter FROM {e}",
    "rtp": """
SELECT {host} AS src_ip, CAST(20000 + event_id % 40000 AS INT) AS src_port, CAST(3 AS BIGINT) AS packets, CAST(5 AS BIGINT) AS max_seq_gap, round(4 / 7.0 * 10000) / 100 AS packet_loss_pct, CAST(36 AS BIGINT) AS bytes FROM {e}
""",
    "dns_records": """
SELECT 'dns-' || CAST(event_id % 65536 AS STRING) || '-' || {host} || ':' || CAST(20000 + event_id % 40000 AS STRING) AS flow_id, CASE WHEN event_id % 2 = 0 THEN 'SOA' ELSE 'NAPTR' END AS query_type,
  CASE WHEN event_id % 2 = 0 THEN ['ns.host' || CAST(event_id % 70 AS STRING) || '.example.com admin.host' || CAST(event_id % 70 AS STRING) || '.example.com ' || CAST(event_id AS STRING) || ' 7200 600 86400 60']
    ELSE ['100 ' || CAST(event_id % 50 AS STRING) || ' "S" "SIP+D2U" "" _sip.host' || CAST(event_id % 70 AS STRING) || '.example.com'] END AS answers FROM {e}
""",
    "diameter_pairs": """
SELECT event_id % 5 + 5 * j AS job_id, 'diameter-' || CAST(event_id * 8 AS STRING) || CASE k WHEN 0 THEN '' ELSE '.' || CAST(k AS STRING) END AS flow_id, '00101' || lpad(CAST(event_id % 1000 + k AS STRING), 10, '0') AS imsi
FROM {e}, (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest([0, 1]) AS j)
""",
    "midway": """
SELECT 'http-' || CAST(event_id * 8 AS STRING) || '.1' AS flow_id, CAST(200 AS INT) AS status_code, '/m/' || CAST(event_id AS STRING) AS uri, CAST(30 AS DOUBLE) AS latency_ms, 'hello' AS body FROM {e} UNION ALL
SELECT 'http-resp-' || CAST(event_id * 8 + 1 AS STRING) || '.2', 404, NULL, NULL, NULL FROM {e}
""",
    "gtp_off_port": "SELECT 'gtp-' || CAST(event_id * 8 AS STRING) AS flow_id, 'Echo Request' AS message_type FROM {e} WHERE event_id % 2 = 0",
    "segments": """
SELECT event_id * 8 + CASE k WHEN 0 THEN 0 ELSE 1 END AS frame_number, CASE k WHEN 0 THEN 'POST /f/' || CAST(event_id AS STRING) || ' HTTP/1.1' || chr(13) || chr(10) || 'Content-Length: 20' || chr(13) || chr(10) || chr(13) || chr(10) || 'abcdefghijklmnopqrst'
  ELSE 'GET /g/' || CAST(event_id AS STRING) || ' HTTP/1.1' || chr(13) || chr(10) || chr(13) || chr(10) END AS message FROM {e}, (SELECT unnest([0, 1]) AS k)
""",
}


def exchanges() -> dict[str, tuple]:
    """(packets of the events, their decoder, columns) by name; columns need a session, so they are made when asked for."""
    out: dict[str, tuple] = {}

    def decoded(name: str, make, decode, *columns) -> None:
        out[name] = make, decode, columns

    E = F.col("event_id")
    detail = lambda k: F.try_element_at("details", F.lit(k)).alias(k)

    # Names and addresses.
    NAME = F.concat(F.lit("host"), (E % 70).cast("string"))
    QUESTION = F.concat(counted(bytes_of(NAME), 1), raw("07 6578616d706c65 03 636f6d 00"))
    decoded("dns", lambda e: packets(e, "UDP", 53,
        (False, 0, F.concat(number(E % 65536, 2), raw("0100 0001 0000 0000 0000"), QUESTION, F.when(E % 2 == 0, raw("0001")).otherwise(raw("000f")), raw("0001")), None),
        (True, 40, F.concat(number(E % 65536, 2), F.when(E % 7 == 0, raw("8183 0001 0000 0000 0000")).otherwise(raw("8180 0001 0001 0000 0000")), QUESTION, F.when(E % 2 == 0, raw("0001")).otherwise(raw("000f")), raw("0001"),
            F.when(E % 7 == 0, raw("")).when(E % 2 == 0, F.concat(raw("c00c 0001 0001 0000003c 0004 cb0071"), number(E % 250, 1))).otherwise(F.concat(raw("c00c 000f 0001 0000003c 0009 000a 04 6d61696c c00c")))), E % 3 != 0)),
        d.dns, "flow_id", "query_name", "query_type", "reply_code", "latency_ms", "is_error", "error_type", "answers")
    decoded("dns_errors", lambda e: packets(e, "UDP", 53,
        (False, 0, F.concat(number(E % 65536, 2), raw("0100 0001 0000 0000 0000"), QUESTION, raw("0001 0001")), None),
        (True, 640, F.concat(number(E % 65536, 2), F.when(E % 7 == 0, raw("8183")).otherwise(raw("8180")), raw("0001 0000 0000 0000"), QUESTION, raw("0001 0001")), E % 3 != 0)),
        lambda p: d.dns_errors(d.dns(p)), "flow_id", "code")

    # Texts.
    TEXT = lambda *parts: reduce(lambda a, b: F.concat(a, b), [bytes_of(p) if isinstance(p, str) else bytes_of(p.cast("string")) for p in parts])
    decoded("http", lambda e: packets(e, "TCP", 80,
        (False, 0, TEXT(F.when(E % 2 == 0, "GET").otherwise("POST"), " /item/", E, " HTTP/1.1\r\nHost: www", E % 9, ".example.com\r\nUser-Agent: probe/1.0\r\n", F.when(E % 4 == 3, 'SOAPAction: "x"\r\n\r\n<s:Envelope><s:Body><m:GetPrice/></s:Body></s:Envelope>').otherwise("\r\n")), None),
        (True, 25, TEXT("HTTP/1.1 ", F.when(E % 4 == 1, "404 Not Found").when(E % 4 == 2, "500 Error").otherwise("200 OK"), "\r\n\r\n", F.when(E % 4 == 3, "<s:Envelope><s:Body><s:Fault><faultcode>Server</faultcode></s:Fault></s:Body></s:Envelope>").otherwise("")), None)),
        d.http, "flow_id", "method", "status_code", "is_error", "error_type", "latency_ms", detail("uri"), detail("host"), detail("user_agent"), detail("soap_operation"), detail("soap_fault_code"))
    CALL = lambda *lines: TEXT(*[x for line in lines for x in ((*line, "\r\n") if isinstance(line, tuple) else (line, "\r\n"))], "\r\n")
    decoded("sip", lambda e: packets(e, "UDP", 5060,
        (False, 0, F.concat(CALL("INVITE sip:b@x SIP/2.0", ("From: <sip:u", E % 30, "@x>"), "To: <sip:b@x>", ("Call-ID: call", E)), TEXT("v=0\r\nc=IN IP4 10.9.0.", E % 250, "\r\nm=audio ", F.lit(30000) + 2 * (E % 1000), " RTP/AVP 0\r\n")), None),
        (True, 300, CALL(F.when(E % 3 == 0, "SIP/2.0 486 Busy Here").otherwise("SIP/2.0 200 OK"), ("Call-ID: call", E)), None),
        (False, 900, F.concat(CALL("INVITE sip:b@x SIP/2.0", ("i: call", E)), TEXT("a=sendonly\r\n")), E % 2 == 0)),
        d.sip, "flow_id", "method", "response", "setup_latency_ms", "media_ip", "media_port", detail("from"), detail("hold_count"), detail("direction"))

    # Handshakes: a hello either way, a certificate, and records after the change to encryption that look like a hello.
    SNI = bytes_of(F.concat(F.lit("www"), (E % 40).cast("string"), F.lit(".example.org")))
    EXTENSION = F.concat(raw("0000"), counted(counted(F.concat(raw("00"), counted(SNI, 2)), 2), 2), raw("0010 0005 0003 02 6832"))
    HELLO = lambda kind, rest: F.concat(raw("160303"), counted(F.concat(raw(kind), counted(F.concat(raw("0303" + "11" * 32 + "00"), rest), 3)), 2))
    CLIENT = HELLO("01", F.concat(raw("0004 c02f 1301 0100"), counted(EXTENSION, 2)))
    SERVER = HELLO("02", F.concat(F.when(E % 3 == 0, raw("c02f")).when(E % 3 == 1, raw("002f")).otherwise(raw("0005")), raw("00")))
    COMMON = lambda text: F.concat(raw("550403 0c"), counted(bytes_of(text), 1))
    CERTIFICATE = F.concat(raw("160303"), counted(F.concat(raw("0b"), counted(F.concat(COMMON(F.concat(F.lit("ca"), (E % 4).cast("string"))), COMMON(F.concat(F.lit("ca"), (E % 2).cast("string")))), 3)), 2))
    decoded("tls", lambda e: packets(e, "TCP", 443, (False, 0, CLIENT, None), (True, 5, F.concat(SERVER, CERTIFICATE), None), (False, 9, raw("140303 0001 01"), None), (False, 12, HELLO("01", F.concat(raw("0002 0005 0100"), counted(EXTENSION, 2))), None)),
        d.tls, "flow_id", "src_ip", "dst_port", "sni", "tls_version", "cipher_suite", "cert_self_signed", detail("cipher_strength"), detail("alpn"), "ja3_hash")

    # Mobile core.
    PADDED = lambda v: F.concat(v, F.when(F.length(v) % 4 == 0, raw("")).otherwise(F.unhex(F.repeat(F.lit("00"), (4 - F.length(v) % 4).cast("int")))))
    AVP = lambda code, value: PADDED(F.concat(number(code, 4), raw("40"), number(F.length(value) + 8, 3), value))
    IMSI = F.concat(F.lit("00101"), F.lpad((E % 1000).cast("string"), 10, "0"))
    MESSAGE = lambda flags, avps: F.concat(raw("01"), number(F.length(avps) + 20, 3), raw(flags), raw("00013c 01000023 00000001 00000002"), avps)
    decoded("diameter", lambda e: packets(e, "TCP", 3868, (False, 0, MESSAGE("c0", F.concat(AVP(264, bytes_of("mme.example")), AVP(1, bytes_of(IMSI)))), None), (True, 8, MESSAGE("40", AVP(268, number(F.when(E % 5 == 0, 5001).otherwise(2001), 4))), None)),
        d.diameter, "flow_id", "command", "result_code", "is_error", "imsi", detail("app_name"), detail("origin_host"))
    SWAPPED = lambda digits: F.unhex(F.concat(*[F.concat(F.substring(digits, 2 * i + 2, 1), F.substring(digits, 2 * i + 1, 1)) for i in range(8)]))  # noqa: E731  half bytes, low first
    decoded("gtp", lambda e: packets(e, "UDP", 2123,
        (False, 0, F.concat(raw("48 20 0000"), number(E % 1000, 4), raw("00000100"), ie(1, SWAPPED(F.concat(IMSI, F.lit("f")))), ie(71, raw("03 696d73 03 6e6574")), ie(82, raw("06")), ie(83, raw("00f110")), ie(86, raw("08 00f110 0102"))), None),
        (True, 20, F.concat(raw("48 21 0000"), number(E % 1000, 4), raw("00000100"), ie(2, F.concat(F.when(E % 6 == 0, raw("48")).otherwise(raw("10")), raw("00"))), ie(79, F.concat(raw("01 ac1400"), number(E % 250, 1))), ie(93, F.concat(ie(73, raw("05")), ie(80, raw("00 09")), ie(87, raw("81 00000abc 0a040001"))))), None)),
        d.gtp, "flow_id", "type", "message_type", "teid", "cause_code", "is_error", "imsi", "apn", "ue_ip", detail("rat_type"), detail("serving_network"), detail("tai"), detail("bearers"))
    decoded("gtpu", lambda e: packets(e, "UDP", 2152, (False, 0, F.concat(raw("30 ff 0020"), number(E % 1000, 4), raw("45000020 00000000 40110000 0a0500"), number(E % 250, 1), raw("08080808"), number(F.lit(1000) + E % 100, 2), raw("0035 000c 0000 01020304")), None)),
        d.gtp, "flow_id", "type", "message_type", detail("inner_src_ip"), detail("inner_protocol"), detail("inner_src_port"))
    decoded("pfcp", lambda e: packets(e, "UDP", 8805,
        (False, 0, F.concat(raw("21 32 0000"), number(F.lit(7) + E % 100, 8), raw("00000100"), ie2(60, raw("00 0a040009")), ie2(1, ie2(2, ie2(93, F.concat(raw("02 0a0600"), number(E % 250, 1))))), ie2(3, ie2(44, F.when(E % 3 == 0, raw("01")).otherwise(raw("0a"))))), None),
        (True, 4, F.concat(raw("21 33 0000"), number(F.lit(7) + E % 100, 8), raw("00000100"), ie2(19, F.when(E % 4 == 0, raw("40")).otherwise(raw("01")))), None)),
        d.pfcp, "flow_id", "message_type", "cause_code", "is_error", "apply_action", "ue_ip", detail("node_id"), detail("far_count"), detail("seid"))
    SUCI = F.concat(raw("7e 00 41 79"), counted(F.concat(raw("01 00f110 f0ff 00 00"), SWAPPED(F.concat(F.lpad((E % 1000).cast("string"), 10, "0"), F.lit("ffffff")))), 2))
    decoded("ngap", lambda e: packets(e, "SCTP", 38412, (False, 0, F.concat(raw("00 03 0100 00000001 0001 0000 0000003c"), F.when(E % 2 == 0, F.concat(raw("000f 40 30"), SUCI)).otherwise(raw("002e 40 10 00000000"))), None)),
        d.ngap, "flow_id", "message_type", "imsi")
    decoded("s1ap", lambda e: packets(e, "SCTP", 36412, (False, 0, F.when(E % 2 == 0, raw("000c4001")).otherwise(raw("00114001")), None)), d.s1ap, "flow_id", "message_type")
    decoded("nas5g", lambda e: packets(e, "SCTP", 38412, (False, 0, F.concat(raw("0004 4001"), F.when(E % 4 == 0, raw("7e 00 5a 15")).when(E % 4 == 1, raw("2e 05 01 c1 ffff")).when(E % 4 == 2, raw("7e 00 41 79 0001")).otherwise(raw("7e 02 01020304 05 5f"))), None)),
        d.nas5g, "flow_id", "message_type", "is_error", "cause_code", detail("pdu_session_id"), detail("security_header"))
    FRAME = lambda kind, body: F.concat(number(F.length(body), 3), raw(kind), raw("04 00000001"), body)
    LITERAL = lambda index, value: F.concat(number(index, 1), counted(bytes_of(value), 1))
    decoded("http2", lambda e: packets(e, "TCP", 7777,
        (False, 0, F.concat(raw("505249202a20485454502f322e300d0a0d0a534d0d0a0d0a"), FRAME("01", F.concat(LITERAL(0x42, "PUT"), LITERAL(0x44, F.when(E % 2 == 0, F.concat(F.lit("/nnrf-nfm/v1/nf/"), E.cast("string"))).otherwise("/other"))))), None),
        (True, 6, F.concat(FRAME("01", LITERAL(0x48, F.when(E % 5 == 0, "503").otherwise("201"))), FRAME("00", raw("616263"))), None)),
        d.http2, "flow_id", "type", "method", "status_code", "nf_type", "service_name", "error_count", detail("api_version"), detail("data_bytes"))

    # Others.
    TLV = lambda tag, value: F.concat(raw(tag), counted(value, 1))
    decoded("snmp", lambda e: packets(e, "UDP", 161, (True, 0, TLV("30", F.concat(raw("020101 0406 7075626c6963"), TLV("a2", F.concat(TLV("02", number(E % 30000, 2)), TLV("02", F.when(E % 4 == 0, raw("02")).otherwise(raw("00"))), raw("020100"), TLV("30", TLV("30", F.concat(raw("0607 2b060102010105"), TLV("04", bytes_of(F.concat(F.lit("sw"), (E % 50).cast("string")))))))))))
        , None)), d.snmp, "flow_id", "message_type", "is_error", detail("version"), detail("community"), detail("request_id"), F.col("answers").alias("oids"), F.try_element_at("details", F.lit("1.3.6.1.2.1.1.5")).alias("name"))
    STRING = lambda v: F.concat(counted(bytes_of(v), 2), raw("00"))
    AJP = lambda magic, body: F.concat(raw(magic), counted(body, 2))
    decoded("ajp", lambda e: packets(e, "TCP", 8009,
        (False, 0, AJP("1234", F.concat(raw("02 02"), STRING("HTTP/1.1"), STRING(F.concat(F.lit("/app/"), E.cast("string"))), STRING("1.2.3.4"), STRING("client"), STRING("shop"), raw("1f90 00 0000 ff"))), None),
        (True, 20, AJP("4142", F.concat(raw("04"), number(F.when(E % 3 == 0, 503).otherwise(200), 2), STRING("OK"), raw("0000"))), None), (True, 30, AJP("4142", raw("05 01")), None)),
        d.ajp, "flow_id", "method", "status_code", "is_error", detail("req_uri"), detail("server_name"), detail("server_port"), "latency_ms")
    decoded("websocket", lambda e: packets(e, "TCP", 8080, (False, 0, TEXT("GET /ws HTTP/1.1\r\nUpgrade: websocket\r\n\r\n"), None), (True, 2, TEXT("HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\n\r\n"), None), (False, 5, raw("8185 00000000 68656c6c6f"), None), (True, 8, raw("8203 010203"), None)),
        d.websocket, "flow_id", "packets", detail("text_bytes"), detail("bin_bytes"))
    decoded("rtcp", lambda e: packets(e, "UDP", 40001, (False, 0, F.concat(raw("81c9 0007 00000011"), number(E % 1000, 4), number(E % 256, 1), raw("000001 00000100"), number(E % 500, 4), raw("00000000 00000000")), None)),
            d.rtcp_reports, "frame_number", "ip", "reporter", "source", F.col("fraction_lost").cast("double").alias("fraction_lost"), "jitter")
    decoded("rtp", lambda e: packets(e, "UDP", 40000, *[(False, 20 * i, F.concat(raw("8000"), number(s, 2), number(160 * i, 4), number(E, 4)), None) for i, s in enumerate((1, 2, 7))]), d.rtp, "src_ip", "src_port", "packets", "max_seq_gap", "packet_loss_pct", "bytes")

    SUFFIX = lambda label: F.concat(counted(bytes_of(label), 1), raw("c00c"))
    SOA = counted(F.concat(SUFFIX("ns"), SUFFIX("admin"), number(E, 4), raw("00001c20 00000258 00015180 0000003c")), 2)
    NAPTR = counted(F.concat(raw("0064"), number(E % 50, 2), raw("01 53 07"), bytes_of("SIP+D2U"), raw("00"), SUFFIX("_sip")), 2)
    RECORD = F.concat(raw("c00c"), F.when(E % 2 == 0, raw("0006 0001 0000003c")).otherwise(raw("0023 0001 0000003c")), F.when(E % 2 == 0, SOA).otherwise(NAPTR))
    KIND = F.when(E % 2 == 0, raw("0006 0001")).otherwise(raw("0023 0001"))
    decoded("dns_records", lambda e: packets(e, "UDP", 53,
        (False, 0, F.concat(number(E % 65536, 2), raw("0100 0001 0000 0000 0000"), QUESTION, KIND), None), (True, 40, F.concat(number(E % 65536, 2), raw("8180 0001 0001 0000 0000"), QUESTION, KIND, RECORD), None)),
        d.dns, "flow_id", "query_type", "answers")
    # Three messages in one segment, in two jobs with the same packets.
    USER = lambda k: MESSAGE("c0", AVP(1, bytes_of(F.concat(F.lit("00101"), F.lpad((E % 1000 + k).cast("string"), 10, "0")))))
    decoded("diameter_pairs", lambda e: in_five_jobs(packets(e, "TCP", 3868, (False, 0, F.concat(USER(0), USER(1), USER(2)), None))).withColumn("job_id", F.explode(F.array(F.col("job_id"), F.col("job_id") + 5))),
        lambda p: d.decode(p, ["diameter"]), "job_id", "flow_id", "imsi")
    # A connection caught in the middle of two bodies, with an answer in chunks and another one behind it.
    decoded("midway", lambda e: packets(e, "TCP", 80,
        (False, 0, TEXT("rest of a body ", E, "GET /m/", E, " HTTP/1.1\r\n\r\n"), None),
        (True, 30, TEXT("tail of a page\r\nHTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\nHTTP/1.1 404 Not Found\r\n\r\n"), None)),
        lambda p: d.decode(p, ["http"]), "flow_id", "status_code", detail("uri"), "latency_ms", F.nullif(F.regexp_extract(F.try_element_at("details", F.lit("body_preview")), "(hello)", 1), F.lit("")).alias("body"))
    decoded("gtp_off_port", lambda e: packets(e, "UDP", 7000, (False, 0, F.when(E % 2 == 0, raw("40 01 0004 00000100")).otherwise(raw("40 01 0009 00000100")), None)), d.gtp, "flow_id", "message_type")

    # A message in three segments, the last one before the second, and the first sent twice with more: trimmed, ordered and cut.
    WHOLE = TEXT("POST /f/", E, " HTTP/1.1\r\nContent-Length: 20\r\n\r\nabcdefghijklmnopqrst", "GET /g/", E, " HTTP/1.1\r\n\r\n")
    PART = lambda a, n: F.substring(WHOLE, a, n)


    def split(events: DataFrame) -> DataFrame:
        sent = packets(events, "TCP", 80, (False, 0, PART(1, 10), None), (False, 2, PART(41, 10_000), None), (False, 4, PART(1, 25), None), (False, 6, PART(26, 15), None))
        places = F.create_map(*[F.lit(x) for kv in {0: 0, 1: 40, 2: 0, 3: 25}.items() for x in kv])
        return sent.withColumn("seq", (F.lit(4294967290) + places[F.col("frame_number") % 8]) % F.lit(1 << 32))


    decoded("segments", split, lambda p: reassembly.with_messages(p), "frame_number", F.col("payload").cast("string").alias("message"))

    return out


def decode_query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        make, decode, columns = exchanges()[name]
        return decode(make(spark.read.parquet(f"{sf_dir}/events.parquet"))).select(*columns)

    return query


for _name, _sql in SQL.items():
    QUERIES[f"decode_{_name}"] = decode_query(_name)
    ORACLES[f"decode_{_name}"] = _sql.format(e="events", host=HOST, peer=PEER)
