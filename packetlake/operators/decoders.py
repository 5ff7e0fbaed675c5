"""Flows of application protocols from packets.

Text protocols and fixed headers are read by column functions. Messages with nested lengths go through a
small parser in an Arrow batch; what relates messages to each other (transactions, sessions, streams) is
grouping, windows and joins. Each decoder returns rows of the flow schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import rtp_score, verdict
from ..schemas import conform
from ..session import stored
from ..sources import messages, names, wire
from . import reassembly, tracker

# Fixed values.
SIP_METHODS = ["INVITE", "ACK", "BYE", "CANCEL", "OPTIONS", "REGISTER", "PRACK", "SUBSCRIBE", "NOTIFY", "PUBLISH", "INFO", "REFER", "MESSAGE", "UPDATE"]
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT"]
HTTP_PORTS, TLS_PORTS = [80, 8080, 8000, 8888, 3000], [443, 8443, 993, 995, 465, 636, 5061]
DIAMETER_COMMANDS = {257: "Capabilities-Exchange", 258: "Re-Auth", 265: "AA", 271: "Accounting", 272: "Credit-Control", 274: "Abort-Session", 275: "Session-Termination", 280: "Device-Watchdog", 282: "Disconnect-Peer", 316: "Update-Location", 317: "Cancel-Location", 318: "Authentication-Information", 319: "Insert-Subscriber-Data", 320: "Delete-Subscriber-Data", 321: "Purge-UE", 323: "Notify"}
GTP_MESSAGES = {1: "Echo Request", 2: "Echo Response", 32: "Create Session Request", 33: "Create Session Response", 34: "Modify Bearer Request", 35: "Modify Bearer Response", 36: "Delete Session Request", 37: "Delete Session Response", 95: "Create Bearer Request", 96: "Create Bearer Response", 255: "G-PDU"}
PFCP_MESSAGES = {1: "Heartbeat Request", 2: "Heartbeat Response", 5: "Association Setup Request", 6: "Association Setup Response", 50: "Session Establishment Request", 51: "Session Establishment Response", 52: "Session Modification Request", 53: "Session Modification Response", 54: "Session Deletion Request", 55: "Session Deletion Response", 56: "Session Report Request", 57: "Session Report Response"}
S1AP_PROCEDURES = {0: "HandoverPreparation", 1: "HandoverResourceAllocation", 5: "E-RABSetup", 9: "InitialContextSetup", 10: "Paging", 11: "DownlinkNASTransport", 12: "InitialUEMessage", 13: "UplinkNASTransport", 17: "S1Setup", 23: "UEContextRelease"}
NGAP_PROCEDURES = {4: "DownlinkNASTransport", 14: "InitialContextSetup", 15: "InitialUEMessage", 21: "NGSetup", 24: "Paging", 29: "PDUSessionResourceSetup", 41: "UEContextRelease", 46: "UplinkNASTransport"}


def message_id(frame: str, part: str) -> Column:
    """The frame's number, and after a dot the message's place in it where it isn't the first."""
    return F.concat_ws(".", F.col(frame).cast("string"), F.when(F.col(part) > 0, F.col(part).cast("string")))


def placed(decoder: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The decoder over packets with ``part`` (0 where they have none) and ``place``, the order of messages in a job."""

    @wraps(decoder)
    def over(packets: DataFrame) -> DataFrame:
        out = packets if "part" in packets.columns else packets.withColumn("part", F.lit(0))
        return decoder(out.withColumn("place", F.shiftleft("frame_number", 20) + F.col("part")))

    return over


def text(payload: str = "payload") -> Column:
    return F.decode(F.col(payload), "ISO-8859-1")


def near(*ports: int) -> Column:
    return F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)


def byte(i: int) -> Column:
    """The payload's byte at ``i`` as a number."""
    return F.conv(F.hex(F.expr(f"substring(payload, {i + 1}, 1)")), 16, 10).cast("int")


def number(i: int, n: int) -> Column:
    return F.conv(F.hex(F.expr(f"substring(payload, {i + 1}, {n})")), 16, 10).cast("long")


def named(table: dict, key: Column, kind: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.format_string(f"{kind} %d", key))


def detailed(values: dict[str, Column]) -> Column:
    """A map of texts by name, without nulls and empty texts."""
    every = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(every, lambda k, v: v.isNotNull() & (v != ""))


def parsed(packets: DataFrame, parse: Callable[[bytes], tuple | None], fields: str) -> DataFrame:
    """Packets with a struct ``m`` of what ``parse`` makes of the payload; those of which it makes nothing go."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "double": pa.float64(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    of = [pa.field(n, kinds[t]) for n, t in (f.split() for f in fields.split(", "))]
    kept = [c for c in packets.columns if c not in ("payload", "raw_packet")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for data in reassembly.listed(b.column("payload")):
                try:
                    found.append(parse(data))
                except (IndexError, ValueError, UnicodeError, wire.struct.error):  # cut-off or foreign bytes
                    found.append(None)
            rows = [i for i, x in enumerate(found) if x is not None]
            if rows:
                read = zip(*(found[i] for i in rows), strict=True)
                values = pa.StructArray.from_arrays([pa.array([v and list(v.items()) for v in column] if pa.types.is_map(f.type) else column, f.type) for f, column in zip(of, read, strict=True)], fields=of)
                own = b.select(kept) if len(rows) == len(b) else b.select(kept).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, values], [*kept, "m"])

    types = dict(packets.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", m struct<" + ", ".join(f"{n}: {t}" for n, t in (f.split() for f in fields.split(", "))) + ">"
    return packets.select(*kept, "payload").mapInArrow(run, schema)


@placed
def sip(packets: DataFrame) -> DataFrame:
    """A flow per Call-ID: first request, last status line, media endpoint, setup time. Its ports are zero."""
    t = text()
    start = rf"^(?:SIP/2\.0 |(?:{'|'.join(SIP_METHODS)}) )"
    upper = byte(0).between(65, 90)  # a letter: the payload becomes a text for few packets only
    own = packets.where((F.length("payload") > 12) & upper).withColumn("t", t).where(F.col("t").rlike(start))
    header = lambda name: F.trim(F.regexp_extract("t", rf"(?im)^(?:{name})\s*:\s*([^\r\n]*)", 1))
    some = lambda c: F.when(c != "", c)
    each = own.select("job_id", "place", "timestamp", "src_ip", "dst_ip", header("call-id|i").alias("call_id"), some(F.regexp_extract("t", rf"^({'|'.join(SIP_METHODS)}) ", 1)).alias("method"), some(F.regexp_extract("t", r"^(SIP/2\.0 [^\r\n]*)", 1)).alias("response"),
                      some(F.regexp_extract("t", r"(?m)^c=IN IP[46] ([^\r\n ]+)", 1)).alias("media_ip"), some(F.regexp_extract("t", r"(?m)^m=audio (\d+)", 1)).cast("int").alias("media_port"),
                      some(header("from|f")).alias("from_uri"), some(header("to|t")).alias("to_uri"), some(F.regexp_extract("t", r"(?m)^a=(sendrecv|sendonly|recvonly|inactive)", 1)).alias("direction"), F.octet_length("payload").alias("n")).where("call_id <> ''")
    # On hold: the media's direction goes from both ways to fewer.
    told = Window.partitionBy("job_id", "call_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last("direction", ignorenulls=True).over(told), F.lit("sendrecv"))
    each = each.withColumn("held", F.coalesce((F.col("direction") != "sendrecv") & (before == "sendrecv"), F.lit(False)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    invite = F.min(F.when(F.col("method") == "INVITE", F.col("timestamp")))
    answer = F.min(F.when(F.col("response").startswith("SIP/2.0 200"), F.col("timestamp")))
    ended = F.max_by("method", F.when(F.col("method").isin("BYE", "CANCEL"), F.col("place")))
    out = each.groupBy("job_id", "call_id").agg(
        F.min_by("src_ip", "place").alias("src_ip"), F.min_by("dst_ip", "place").alias("dst_ip"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("packets"), F.sum("n").alias("bytes"), F.max("n").alias("max_packet_size"),
        first("method").alias("method"), F.max_by("response", F.when(F.col("response").isNotNull(), F.col("place"))).alias("response"), first("media_ip").alias("media_ip"), first("media_port").alias("media_port"), invite.alias("invite"), answer.alias("answer"), ended.alias("end_type"),
        first("from_uri").alias("from_uri"), first("to_uri").alias("to_uri"), last("direction").alias("direction"), F.sum(F.col("held").cast("int")).alias("holds"),
    )
    setup = F.when(F.col("answer") > F.col("invite"), (tracker.micros("answer") - tracker.micros("invite")) / 1000)
    return conform(out.withColumns({"flow_id": F.col("call_id"), "type": F.lit("SIP"), "src_port": F.lit(0), "dst_port": F.lit(0), "setup_latency_ms": setup, "details": detailed({"from": F.col("from_uri"), "to": F.col("to_uri"), "direction": F.col("direction"), "hold_count": F.col("holds")})}))


def rtp(packets: DataFrame) -> DataFrame:
    """A flow per source, destination and SSRC of UDP payloads of version 2 that aren't control packets."""
    own = packets.where("protocol = 'UDP' and length(payload) >= 12").where((byte(0).bitwiseAND(F.lit(0xC0)) == 0x80) & ~byte(1).between(192, 223) & ~near(53, 5353, 5060, 5061, 2123, 2152, 8805, 161, 162))
    own = own.select("job_id", "frame_number", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", number(8, 4).alias("ssrc"), number(2, 2).alias("rtp_seq"), number(4, 4).alias("rtp_time"), F.octet_length("payload").alias("n"))
    base = own.groupBy(*tracker.STREAM).agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.sum("n").alias("bytes"), F.max("n").alias("max_packet_size"))
    out = base.join(tracker.rtp_gaps(own), tracker.STREAM).join(tracker.rtp_jitter(own), tracker.STREAM)
    names = {"jitter": "jitter_ms", "jitter_min": "jitter_min_ms", "jitter_max": "jitter_max_ms", "jitter_avg": "jitter_avg_ms", "loss_pct": "packet_loss_pct"}
    score = rtp_score(F.col("jitter"), F.col("loss_pct"))
    details = detailed({"sla_score": score, "sla_verdict": verdict(score), "lost_packets": F.col("lost"), "jitter_trend": F.when(F.size("jitter_trend") > 0, F.to_json("jitter_trend"))})
    return conform(out.withColumn("details", details).withColumnsRenamed(names).withColumns({"type": F.lit("RTP"), "flow_id": F.lit("")}))


@placed
def dns(packets: DataFrame) -> DataFrame:
    """A flow per query: with the next response of the same id between the same ends, or TIMEOUT.

    A later query of the same id between the same ends takes the place of an unanswered one; a response
    without a query is a flow with latency 0.
    """
    question = (number(4, 2) == 1) & (byte(2).bitwiseAND(F.lit(0x78)) == 0) & (number(6, 2) < 64) & (number(8, 2) < 64)
    own = parsed(packets.where(near(53, 5353) | ((F.col("protocol") == "UDP") & (F.length("payload") >= 17) & question)), wire.dns, "id int, response boolean, name string, kind string, code string, answers array<string>").where(near(53, 5353) | (F.col("m.name") != ""))
    ends = own.withColumns({"client": F.when(F.col("m.response"), F.col("dst_ip")).otherwise(F.col("src_ip")), "client_port": F.when(F.col("m.response"), F.col("dst_port")).otherwise(F.col("src_port")), "server": F.when(F.col("m.response"), F.col("src_ip")).otherwise(F.col("dst_ip")), "server_port": F.when(F.col("m.response"), F.col("src_port")).otherwise(F.col("dst_port"))})
    key = ["job_id", "m.id", "client", "client_port", "server", "server_port"]
    order = Window.partitionBy(*key).orderBy("place")
    step = ends.withColumns({"next": F.lead(F.struct("m", "timestamp")).over(order), "before": F.lag("m.response").over(order)})
    query, answered = ~F.col("m.response"), F.coalesce(F.col("next.m.response"), F.lit(False))
    lone = F.col("m.response") & F.coalesce(F.col("before"), F.lit(True))
    kept = step.where((query & (answered | F.col("next").isNull())) | lone)
    code = F.when(lone, F.col("m.code")).when(answered, F.col("next.m.code")).otherwise("")
    error = F.when(~lone & ~answered, "TIMEOUT").when(code != "NOERROR", code)
    return conform(kept.select(
        "job_id", F.format_string("dns-%d-%s:%d", "m.id", "client", "client_port").alias("flow_id"), F.lit("DNS").alias("type"), F.col("client").alias("src_ip"), F.col("client_port").alias("src_port"), F.col("server").alias("dst_ip"), F.col("server_port").alias("dst_port"), F.col("timestamp").alias("start_time"),
        F.when(answered, F.col("next.timestamp")).when(lone, F.col("timestamp")).alias("end_time"), F.when(answered, 2).otherwise(1).alias("packets"), F.col("m.name").alias("query_name"), F.col("m.kind").alias("query_type"), code.alias("reply_code"), F.when(lone, F.col("m.answers")).otherwise(F.col("next.m.answers")).alias("answers"),
        F.when(answered, (tracker.micros("next.timestamp") - tracker.micros("timestamp")) / 1000).when(lone, 0.0).alias("latency_ms"), error.isNotNull().alias("is_error"), error.alias("error_type"), "payload_len",
    ).withColumn("max_packet_size", F.col("payload_len")))


@placed
def http(packets: DataFrame) -> DataFrame:
    """A flow per answered request of a connection, and per response without one. A SOAP fault is an error under any status."""
    start = rf"^(?:HTTP/1\.[01] \d{{3}}|(?:{'|'.join(HTTP_METHODS)}) \S+ HTTP/1\.[01])"
    own = packets.where((F.col("protocol") == "TCP") & (F.length("payload") >= 10) & byte(0).between(65, 90)).withColumn("t", text()).where(F.col("t").rlike(start))
    own = own.withColumns({"response": F.col("t").startswith("HTTP/"), "a": F.least(F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")), "b": F.greatest(F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port"))})
    order = Window.partitionBy("job_id", "a", "b").orderBy("place")
    request = F.lag(F.struct("t", "timestamp", "frame_number", "part", "response")).over(order)
    answers = own.withColumn("q", request).where("response").withColumn("asked", F.coalesce(~F.col("q.response"), F.lit(False)))
    status = F.regexp_extract("t", r"^HTTP/1\.[01] (\d{3})", 1).cast("int")
    fault = F.col("t").rlike(r"(?i)<(?:[a-z0-9-]+:)?fault[ >]") & F.col("t").rlike("(?i)envelope")
    asked = F.when(F.col("asked"), F.col("q.t"))
    field = lambda t, name: F.trim(F.regexp_extract(t, rf"(?im)^{name}\s*:\s*([^\r\n]*)", 1))
    either = lambda name: F.coalesce(F.when(field(F.col("t"), name) != "", field(F.col("t"), name)), field(asked, name))  # noqa: E731  the response's goes first
    soap = F.coalesce(F.concat("t", asked), F.col("t")).rlike(r"(?i)(?:content-type:[^\r\n]*(?:soap\+xml|text/xml))|\nsoapaction:|<(?:[a-z0-9-]+:)?envelope")
    details = detailed({
        "uri": F.regexp_extract(asked, r"^\S+ (\S+)", 1), "host": field(asked, "host"), "user_agent": field(asked, "user-agent"), "server": field(F.col("t"), "server"), "content_type": either("content-type"), "content_length": either("content-length"),
        "has_auth": F.when(asked.rlike(r"(?im)^authorization:"), "true"), "has_cookie": F.when(asked.rlike(r"(?im)^cookie:"), "true"), "is_soap": F.when(soap, "true"),
        "soap_action": F.regexp_replace(field(asked, "soapaction"), '"', ""), "soap_operation": F.when(soap, F.regexp_extract(F.coalesce(asked, F.col("t")), r"(?is)<(?:[a-z0-9-]+:)?body[^>]*>\s*<(?:[a-z0-9-]+:)?([a-z0-9_-]+)", 1)),
        "soap_fault_code": F.when(fault, F.regexp_extract("t", r"(?is)<(?:[a-z0-9-]+:)?(?:faultcode|code|value)>\s*(?:<[^>]*>)?\s*([^<\s]+)", 1)), "soap_fault_string": F.when(fault, F.regexp_extract("t", r"(?is)<(?:[a-z0-9-]+:)?(?:faultstring|text)[^>]*>\s*([^<]*)", 1)),
        "body_preview": F.substring(F.regexp_extract("t", r"(?s)\r\n\r\n(.*)$", 1), 1, 200),
    })
    return conform(answers.withColumn("details", details).select(
        "job_id", F.concat(F.when(F.col("asked"), "http-").otherwise("http-resp-"), F.when(F.col("asked"), message_id("q.frame_number", "q.part")).otherwise(message_id("frame_number", "part"))).alias("flow_id"), F.lit("HTTP").alias("type"), F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"), F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"),
        F.when(F.col("asked"), F.col("q.timestamp")).otherwise(F.col("timestamp")).alias("start_time"), F.col("timestamp").alias("end_time"), F.when(F.col("asked"), 2).otherwise(1).alias("packets"), F.when(F.col("asked"), F.regexp_extract("q.t", r"^(\S+)", 1)).alias("method"), status.alias("status_code"),
        ((status >= 400) | fault).alias("is_error"), F.when(fault, "SOAP_FAULT").when(status >= 400, status.cast("string")).alias("error_type"), F.when(F.col("asked"), (tracker.micros("timestamp") - tracker.micros("q.timestamp")) / 1000).alias("latency_ms"), "details",
    ))


def cipher_grade(cipher: Column) -> Column:
    """F broken, D single or triple DES, C without forward secrecy, B in block chaining, A otherwise."""
    some = lambda *parts: F.upper(cipher).rlike("|".join(parts))
    return F.when(cipher.isNull(), None).when(some("NULL", "EXPORT", "ANON", "RC4"), "F").when(some("_DES_", "3DES"), "D").when(~some("DHE"), "C").when(some("_CBC_"), "B").otherwise("A")


@placed
def tls(packets: DataFrame) -> DataFrame:
    """A flow per connection: names, version, cipher, certificate and JA3 of its handshake.

    Its ends are those of its first record. What a direction sends after it changed to encryption is no
    handshake. The version is the last one told, of records too; a cipher without a name is shown as a number.
    """
    record = byte(0).between(20, 23) & (byte(1) == 3) & (byte(2) <= 4)
    own = parsed(packets.where((F.col("protocol") == "TCP") & (F.length("payload") >= 5) & record), messages.tls_records,
                 "version string, record string, sni string, cipher int, ja3 string, alpn string, issuer string, subject string, sealed boolean, handshake array<int>")
    before = Window.partitionBy("job_id", "src_ip", "src_port", "dst_ip", "dst_port").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    opaque = F.coalesce(F.max("m.sealed").over(before), F.lit(False))
    own = own.withColumn("opaque", opaque)
    plain = lambda c: F.when(~F.col("opaque"), F.col(c))
    own = own.withColumns({"version": F.when(F.col("opaque"), F.col("m.record")).otherwise(F.col("m.version")), **{c: plain(f"m.{c}") for c in ("sni", "cipher", "ja3", "alpn", "issuer", "subject", "handshake")}})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    out = tracker.canonical(own).groupBy(*tracker.KEY).agg(
        F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port"), "place").alias("e"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("packets"), F.max("payload_len").alias("max_packet_size"),
        first("sni").alias("sni"), last("version").alias("tls_version"), last("cipher").alias("cipher"), first("ja3").alias("ja3_hash"), last("alpn").alias("alpn"), first("issuer").alias("issuer"), first("subject").alias("subject"), F.sum(F.size(F.coalesce("handshake", F.array().cast("array<int>")))).alias("messages"),
    ).select("*", "e.*")
    table = F.create_map(*[F.lit(x) for kv in names.TLS_CIPHERS.items() for x in kv])
    name = F.when(F.col("cipher").isNotNull(), F.coalesce(F.try_element_at(table, F.col("cipher")), F.format_string("0x%04x", "cipher")))
    details = detailed({"alpn": F.col("alpn"), "cert_issuer": F.col("issuer"), "cert_subject": F.col("subject"), "cipher_strength": cipher_grade(name), "has_forward_secrecy": F.when(name.isNotNull(), name.contains("DHE")), "message_count": F.col("messages")})
    return conform(out.withColumns({
        "type": F.lit("TLS"), "flow_id": F.concat_ws("-", F.lit("tls"), F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")), "cipher_suite": name,
        "cert_self_signed": F.when(F.col("subject").isNotNull(), (F.col("subject") == F.col("issuer")) & (F.col("subject") != "")), "details": details,
    }))


def message_flow(own: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """A flow per message, with its own ends."""
    return conform(own.withColumns({"type": F.lit(kind), "flow_id": F.concat(F.lit(f"{kind.lower()}-"), message_id("frame_number", "part")), "start_time": F.col("timestamp"), "end_time": F.col("timestamp"), "packets": F.lit(1), "bytes": F.col("payload_len"), **columns}))


@placed
def diameter(packets: DataFrame) -> DataFrame:
    header = (byte(0) == 1) & (F.length("payload") >= 20) & (number(1, 3) % 4 == 0) & (number(1, 3) >= 20) & (byte(4).bitwiseAND(F.lit(15)) == 0)
    own = parsed(packets.where(near(3868) | ((F.col("protocol") == "TCP") & header)), wire.diameter, "command int, request boolean, application long, session string, result long, origin string, user string")
    error = ~F.col("m.request") & F.coalesce(~F.col("m.result").isin(0, 2001, 2002), F.lit(False))
    return message_flow(own, "Diameter", command=named(DIAMETER_COMMANDS, F.col("m.command"), "Command"), result_code=F.col("m.result"), is_error=error, error_type=F.when(error, F.col("m.result").cast("string")), imsi=F.when(F.col("m.user").rlike(r"^\d{10,15}$"), F.col("m.user")),
                        details=detailed({"app_id": F.col("m.application"), "app_name": named(names.DIAMETER_APPLICATIONS, F.col("m.application"), "App"), "session_id": F.col("m.session"), "origin_host": F.col("m.origin"), "command_code": F.col("m.command"), "is_request": F.col("m.request")}))


@placed
def gtp(packets: DataFrame) -> DataFrame:
    """A flow per message: GTP on the control port, GTPU on the user port, with the packet inside."""
    # Off its ports, control messages are known by their version, kind and length.
    shaped = (byte(0).bitwiseAND(F.lit(0xE0)) == 0x40) & byte(1).isin(*[k for k in GTP_MESSAGES if k < 255]) & (number(2, 2) + 4 == F.length("payload")) & (F.length("payload") >= 8)
    own = parsed(packets.where("protocol = 'UDP'").where(near(2123, 2152) | (shaped & ~near(53, 5353, 5060, 5061, 8805, 161, 162))), messages.gtp, "version int, message int, teid long, cause int, imsi string, msisdn string, apn string, address string, details map<string,string>")
    error = F.coalesce(~F.col("m.cause").isin(0, 16), F.lit(False))
    out = message_flow(own, "GTP", message_type=named(GTP_MESSAGES, F.col("m.message"), "Message"), cause_code=F.col("m.cause"), is_error=error, error_type=F.when(error, F.col("m.cause").cast("string")), imsi=F.col("m.imsi"), msisdn=F.col("m.msisdn"), apn=F.col("m.apn"), ue_ip=F.col("m.address"), teid=F.format_string("0x%08x", "m.teid"), details=F.col("m.details"))
    return out.withColumn("type", F.when(F.col("src_port").isin(2152) | F.col("dst_port").isin(2152), "GTPU").otherwise("GTP"))


@placed
def pfcp(packets: DataFrame) -> DataFrame:
    """A flow per message of the session protocol, with what its elements and rules say."""
    own = parsed(packets.where("protocol = 'UDP' and length(payload) >= 8").where(near(8805)), messages.pfcp, "message int, session long, cause int, address string, action string, details map<string,string>")
    error = F.coalesce(~F.col("m.cause").isin(0, 1), F.lit(False))
    return message_flow(own, "PFCP", message_type=named(PFCP_MESSAGES, F.col("m.message"), "Message"), cause_code=F.col("m.cause"), is_error=error, error_type=F.when(error, F.col("m.cause").cast("string")), ue_ip=F.col("m.address"), apply_action=F.col("m.action"), details=F.map_concat("m.details", detailed({"seid": F.col("m.session")})))


@placed
def s1ap(packets: DataFrame) -> DataFrame:
    own = packets.where("protocol = 'SCTP' and length(payload) >= 3").where(near(36412))
    code = F.when(byte(1) > 50, byte(2)).otherwise(byte(1))
    return message_flow(own, "S1AP", message_type=named(S1AP_PROCEDURES, code, "Procedure"))


@placed
def ngap(packets: DataFrame) -> DataFrame:
    """The procedure of the message in the first SCTP data chunk, and the subscriber of a registration that isn't concealed."""
    own = packets.where("protocol = 'SCTP' and length(payload) >= 3").where(near(38412))
    own = own.withColumn("payload", F.when((byte(0) == 0) & (F.length("payload") > 19), F.expr("substring(payload, 17)")).otherwise(F.col("payload")))
    code = F.when(byte(1) > 50, byte(2)).otherwise(byte(1))
    kind = F.when(byte(0).bitwiseAND(F.lit(0x60)) == 0, "Initiating").when(byte(0).bitwiseAND(F.lit(0x60)) == 0x20, "Successful").otherwise("Unsuccessful")
    own = parsed(own.withColumns({"code": code, "pdu": kind}), lambda data: (messages.concealed_imsi(data),), "imsi string")
    return message_flow(own, "NGAP", message_type=named(NGAP_PROCEDURES, F.col("code"), "Procedure"), imsi=F.col("m.imsi"), details=detailed({"pdu_type": F.col("pdu"), "procedure_code": F.col("code")}))


@placed
def nas5g(packets: DataFrame) -> DataFrame:
    """A flow per packet with a mobile-core message; ``auth_failures`` is the count of its source end on every row."""
    own = parsed(packets.where("length(payload) >= 3").where((F.col("protocol") == "SCTP") | near(38412)), messages.nas5g, "message string, header int, session int, cause int, error boolean")
    failed = F.col("m.message").isin("Authentication Failure", "Authentication Reject").cast("long")
    source = Window.partitionBy("job_id", "src_ip", "src_port")
    out = own.withColumn("failures", F.sum(failed).over(source))
    return message_flow(out, "NAS5G", message_type=F.col("m.message"), is_error=F.col("m.error"), error_type=F.when(F.col("m.error"), F.col("m.message")), cause_code=F.col("m.cause"), auth_failures=F.col("failures"), details=detailed({"security_header": F.col("m.header"), "pdu_session_id": F.col("m.session")}))


@placed
def http2(packets: DataFrame) -> DataFrame:
    """A flow per packet with frames: SBI where a path names a core network's service, else HTTP2."""
    frame = (number(0, 3) < 65536) & (byte(3) <= 9) & (byte(5) < 128) & ((number(0, 3) + 9 <= F.length("payload")) | (byte(3) <= 1))
    preface = F.col("payload").startswith(F.lit(messages.PREFACE))
    own = parsed(packets.where("protocol = 'TCP' and length(payload) >= 9").where(preface | (near(80, 8080, 443, 8443, 7777, 29510, 29518) & frame)), messages.http2, "method string, path string, status int, kind string, service string, streams int, errors long, data long, details map<string,string>")
    error = F.col("m.errors") > 0
    out = message_flow(own, "HTTP2", method=F.col("m.method"), status_code=F.col("m.status"), nf_type=F.col("m.kind"), service_name=F.col("m.service"), error_count=F.col("m.errors"), is_error=error, error_type=F.when(error, F.col("m.status").cast("string")),
                       details=F.map_concat("m.details", detailed({"path": F.col("m.path"), "stream_count": F.col("m.streams"), "data_bytes": F.col("m.data")})))
    return out.withColumn("type", F.when(F.col("service_name").isNotNull(), "SBI").otherwise("HTTP2"))


@placed
def snmp(packets: DataFrame) -> DataFrame:
    """A flow per management message."""
    own = parsed(packets.where("protocol = 'UDP' and length(payload) >= 10").where(near(161, 162)), messages.snmp, "version string, community string, pdu string, request long, status int, oids array<string>, details map<string,string>")
    error = F.coalesce(F.col("m.status") != 0, F.lit(False))
    return message_flow(own, "SNMP", message_type=F.col("m.pdu"), is_error=error, error_type=F.when(error, F.col("m.status").cast("string")), answers=F.col("m.oids"),
                        details=F.map_concat(F.map_filter("m.details", lambda k, v: v.isNotNull()), detailed({"version": F.col("m.version"), "community": F.col("m.community"), "request_id": F.col("m.request"), "varbind_count": F.size("m.oids")})))


@placed
def ajp(packets: DataFrame) -> DataFrame:
    """A flow per ended response of a connection: the request before it and the status that its headers gave."""
    own = parsed(packets.where("protocol = 'TCP' and length(payload) >= 5").where(near(8009)), messages.ajp, "kind string, method string, uri string, status int, details map<string,string>")
    order = Window.partitionBy(*tracker.KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda kind, *columns: F.last(F.when(F.col("m.kind") == kind, F.struct(*columns)), ignorenulls=True).over(order)
    ended = tracker.canonical(own).withColumns({"q": seen("request", "m", "timestamp", "frame_number", "part", "place", "src_ip", "src_port", "dst_ip", "dst_port"), "r": seen("headers", "m", "place")}).where("m.kind = 'end' and q is not null")
    status = F.when(F.col("r.place") > F.col("q.place"), F.col("r.m.status"))
    return conform(ended.select(
        "job_id", F.concat(F.lit("ajp-"), message_id("q.frame_number", "q.part")).alias("flow_id"), F.lit("AJP13").alias("type"), "q.src_ip", "q.src_port", "q.dst_ip", "q.dst_port", F.col("q.timestamp").alias("start_time"), F.col("timestamp").alias("end_time"), F.col("q.m.method").alias("method"), status.alias("status_code"),
        F.coalesce(status >= 400, F.lit(False)).alias("is_error"), F.when(status >= 400, status.cast("string")).alias("error_type"), ((tracker.micros("timestamp") - tracker.micros("q.timestamp")) / 1000).alias("latency_ms"), F.map_concat("q.m.details", detailed({"req_uri": F.col("q.m.uri")})).alias("details"),
    ))


@placed
def websocket(packets: DataFrame) -> DataFrame:
    """A flow per connection that was upgraded: frames and bytes since. It has no times."""
    own = parsed(packets.where("protocol = 'TCP' and length(payload) >= 2").where(near(*HTTP_PORTS)), messages.websocket, "upgrade boolean, frames int, text long, binary long")
    order = Window.partitionBy(*tracker.KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seen = tracker.canonical(own).withColumn("after", F.coalesce(F.max("m.upgrade").over(order), F.lit(False)))
    n = lambda c: F.sum(F.when(F.col("after"), F.col(c)).otherwise(0))
    out = seen.groupBy(*tracker.KEY).agg(F.max("m.upgrade").alias("upgraded"), n("m.frames").alias("packets"), n("m.text").alias("text"), n("m.binary").alias("binary"), F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port"), "place").alias("e")).where("upgraded").select("*", "e.*")
    return conform(out.withColumns({"type": F.lit("WebSocket"), "flow_id": F.concat_ws("-", F.lit("ws"), F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")), "bytes": F.col("text") + F.col("binary"), "details": detailed({"text_bytes": F.col("text"), "bin_bytes": F.col("binary"), "upgraded": F.col("upgraded")})}))


def rtcp_reports(packets: DataFrame) -> DataFrame:
    """(job_id, frame_number, timestamp, ip, port, reporter, source, fraction_lost, jitter) of receiver reports."""
    own = parsed(packets.where("protocol = 'UDP' and length(payload) >= 32").where((byte(0).bitwiseAND(F.lit(0xC0)) == 0x80) & (byte(1) == 201)), messages.rtcp, "reporter long, source long, fraction_lost double, jitter long")
    return own.select("job_id", "frame_number", "timestamp", F.col("src_ip").alias("ip"), F.col("src_port").alias("port"), "m.*")


#: Parsers by the ports on which a payload must be theirs.
CHECKED: dict[str, tuple[list[int], Callable[[bytes], tuple | None]]] = {
    "DNS": ([53, 5353], wire.dns), "Diameter": ([3868], wire.diameter), "GTP": ([2123], messages.gtp), "PFCP": ([8805], messages.pfcp), "SNMP": ([161, 162], messages.snmp),
}


def with_errors(packets: DataFrame) -> DataFrame:
    """Adds ``errors`` (array of texts, as ``live.packet_events`` takes them): what can't be decoded on a protocol's own port.

    Datagrams and whole messages of streams are looked at; ``packets`` may be those of ``reassembly.with_messages``.
    """
    kinds = dict(packets.dtypes)
    names_ = packets.columns
    by_port = {p: (name, parse) for name, (ports, parse) in CHECKED.items() for p in ports}

    def judged(source: int, target: int, data: bytes | None) -> list[str]:
        name, parse = by_port.get(target) or by_port.get(source) or (None, None)
        if not data or parse is None:
            return []
        try:
            return [] if parse(data) is not None else [f"{name} message can't be decoded"]
        except (IndexError, ValueError, UnicodeError, wire.struct.error) as e:
            return [f"{name} message can't be decoded: {e}" if str(e) else f"{name} message can't be decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judged(*x) for x in zip(*(b.column(c).to_pylist() for c in ("src_port", "dst_port", "payload")), strict=True)]
            yield b.append_column("errors", pa.array(found, pa.list_(pa.string())))

    return packets.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names_) + ", errors array<string>")


def dns_errors(flows: DataFrame, slow_ms: float = 500.0) -> DataFrame:
    """(flow_id, code, severity, title) of what went wrong with DNS flows: no answer, a bad code, a slow one."""
    table = {"NXDOMAIN": ("warning", "Domain Not Found"), "SERVFAIL": ("error", "DNS Server Failure"), "REFUSED": ("error", "DNS Query Refused"), "FORMERR": ("error", "DNS Format Error")}
    entry = lambda code, severity, title: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(title).alias("title"))
    by_code = F.lit(None)
    for code, (severity, title) in table.items():
        by_code = F.when(F.col("reply_code") == code, entry(f"DNS_{code}", severity, title)).otherwise(by_code)
    lost = F.col("error_type") == "TIMEOUT"
    found = F.array(F.when(lost, entry("DNS_TIMEOUT", "warning", "DNS Query Timeout")).otherwise(by_code), F.when(~F.coalesce(lost, F.lit(False)) & (F.col("latency_ms") > slow_ms), entry("DNS_SLOW", "warning", "Slow DNS Resolution")))
    return flows.where("type = 'DNS'").select("flow_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select("flow_id", "e.*")


def transport(packets: DataFrame) -> DataFrame:
    """The tracked flow of every pair of ends."""
    tracked = tracker.track(packets)
    sizes = tracker.canonical(packets).groupBy(*tracker.KEY).agg(F.max("payload_len").alias("max_packet_size"))
    out = tracked.join(sizes, tracker.KEY).withColumns({"type": F.col("protocol"), "packets": F.col("fwd_packets") + F.col("rev_packets"), "bytes": F.col("fwd_bytes") + F.col("rev_bytes"), "packet_loss_pct": F.col("loss_pct")})
    told = {"close_reason": F.col("close_reason"), "sla_score": F.col("sla_score"), "sla_verdict": F.col("sla_verdict"), "handshake_ms": F.col("handshake_ms"), "rst_delta": F.col("rst_delta"), "rst_reason": F.col("rst_reason")}
    out = out.withColumn("details", detailed(told))
    return conform(out.withColumnsRenamed({"ip_a": "src_ip", "port_a": "src_port", "ip_b": "dst_ip", "port_b": "dst_port"}))


DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {"sip": sip, "rtp": rtp, "dns": dns, "http": http, "tls": tls, "diameter": diameter, "gtp": gtp, "pfcp": pfcp, "s1ap": s1ap, "ngap": ngap, "nas5g": nas5g, "http2": http2, "snmp": snmp, "ajp": ajp, "websocket": websocket, "transport": transport}

#: The decoders above but ``transport``, and columns that neither they nor reassembly read; decoders that are added get them.
OWN = frozenset(d for n, d in DECODERS.items() if n != "transport")
UNREAD = ["length", "ack", "flags", "ttl", "ip_id"]


def decode(packets: DataFrame, names: list[str] | None = None, reassemble: bool = True) -> DataFrame:
    """The flows of all decoders, or of the named ones; more may be added to DECODERS.

    Streams of framed ports are reassembled first, so that messages over several segments are seen whole;
    they are written to the shared folder once, and each decoder reads from there what its ports and
    columns need. ``transport`` always reads the packets themselves.
    """
    of_messages = {DECODERS[n] for n in names or DECODERS if n != "transport"}
    whole = packets.drop("raw_packet", *(UNREAD if of_messages <= OWN else ()))
    if reassemble and of_messages:
        whole = stored(reassembly.with_messages(whole))
    found = [DECODERS[n](packets if n == "transport" else whole) for n in names or DECODERS]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
