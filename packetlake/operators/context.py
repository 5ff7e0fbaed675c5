"""What a job holds as text lines, for a reader or a prompt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FLOW, columns, conform

# Sections in order, and the fields of a flow's line as "label: column or detail".
SECTIONS = {
    "SIP": "SIP Flows", "RTP": "RTP Flows", "DNS": "DNS Flows", "HTTP": "HTTP Flows", "TLS": "TLS/HTTPS Flows", "Diameter": "Diameter Flows", "GTP": "GTP Flows", "PFCP": "PFCP Flows",
    "AJP": "AJP Flows", "SNMP": "SNMP Flows", "S1AP": "S1AP Flows", "NGAP": "NGAP Flows", "SCTP": "SCTP Flows",
}
FIELDS = {
    "SIP": "Method: method, Response: response, From: from, To: to, MediaIP: media_ip, MediaPort: media_port, Direction: direction, HoldCount: hold_count, HoldEvents: hold_events",
    "RTP": "SSRC: ssrc, PacketCount: packets, Jitter: jitter_ms ms, MaxSeqGap: max_seq_gap",
    "DNS": "Query: query_name, Type: query_type, ReplyCode: reply_code, Answers: answers, Latency: latency_ms ms, ERROR: error_type",
    "HTTP": "Method: method, URI: uri, Host: host, Status: status_code, ContentType: content_type, ContentLength: content_length, UserAgent: user_agent, Server: server, Body: body_preview",
    "TLS": "SNI: sni, Version: tls_version, Cipher: cipher_suite, CertSubject: cert_subject, CertIssuer: cert_issuer, ALPN: alpn, Messages: message_count",
    "Diameter": "Command: command, App: app_name, SessionID: session_id, ResultCode: result_code, OriginHost: origin_host, IMSI: imsi, MSISDN: msisdn",
    "GTP": "MessageType: message_type, TEID: teid, CauseCode: cause_code, IMSI: imsi, MSISDN: msisdn, MEI/IMEI: mei, APN: apn, PDNType: pdn_type, PDNAddr: pdn_address, ServingNetwork: serving_network, RAT: rat_type, TAI: tai, ECGI: ecgi, Bearers: bearer_count",
    "PFCP": "MessageType: message_type, SEID: seid, CauseCode: cause_code",
    "AJP": "Method: method, URI: req_uri, ServerName: server_name, RemoteAddr: remote_addr, SOAPAction: soap_action, ContentType: content_type, Status: status_code",
    "SNMP": "Version: version, PDU: pdu_type, Community: community, OIDs: oids, Trap: generic_trap, ERROR: error_status",
    "S1AP": "PDUType: pdu_type, Procedure: procedure_name, ProcedureCode: procedure_code",
    "NGAP": "PDUType: pdu_type, Procedure: message_type, ProcedureCode: procedure_code, IMSI: imsi",
    "SCTP": "",
}
MARKED = ["HTTP", "Diameter", "GTP", "PFCP", "AJP"]  # a failed one ends in ERROR
EVENTS, PACKETS = 200, 500


def _field(spec: str) -> Column:
    """``label: value``, null where the flow has no value."""
    label, source, *unit = spec.replace(": ", " ").split(" ")
    own = dict(columns(FLOW)).get(source)
    value = F.try_element_at("details", F.lit(source)) if own is None else F.array_join(source, " ") if own.startswith("array") else F.col(source).cast("string")
    if own == "double":
        value = F.regexp_replace(value, r"\.0$", "")
    shown = F.concat(F.lit(f"{label}: "), value, F.lit("".join(unit)))
    return F.when((value != "") & (F.coalesce("is_error", F.lit(False)) if label == "ERROR" else F.lit(True)), shown)


def _flow_line() -> Column:
    head = [F.concat(F.lit("- Flow "), F.col("flow_id")), F.concat(F.col("src_ip"), F.lit(" -> "), F.col("dst_ip"))]
    out = F
    for kind, fields in FIELDS.items():
        shown = [_field(x) for x in fields.split(", ") if x] + ([F.when(F.col("is_error"), "ERROR")] if kind in MARKED else [])
        out = out.when(F.col("type") == kind, F.concat_ws(" | ", *head, *shown))
    return out


def _first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each job: tasks keep their own first ones before the exchange."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def job_lines(flows: DataFrame, calls: DataFrame, events: DataFrame, packets: DataFrame, n_events: int = EVENTS, n_packets: int = PACKETS) -> DataFrame:
    """(job_id, place, section, line): a line for each flow, call and event of a job and for its packets, and a summary.

    Sections stand in order of ``place``. Of events the last ``n_events`` and of packets the first ``n_packets`` of a job
    are shown, and the summary counts what is shown. Flows of types without a section are counted only.
    """
    place = F.create_map(*[F.lit(x) for i, k in enumerate(SECTIONS) for x in (k, i)])
    title = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    last = len(SECTIONS)
    line = lambda df, i, section, text: df.select("job_id", F.lit(i).alias("place"), F.lit(section).alias("section"), text.alias("line"))
    text = lambda c: F.coalesce(c, F.lit(""))
    flows = conform(flows)
    of_flows = flows.where(F.col("type").isin(*SECTIONS)).select("job_id", F.try_element_at(place, F.col("type")).alias("place"), F.try_element_at(title, F.col("type")).alias("section"), _flow_line().alias("line"))
    mos = F.format_string("%.3f", F.round(F.coalesce("mos", F.lit(0.0)) * 1000) / 1000)
    of_calls = line(calls, last, "Calls", F.concat(
        F.lit("- Call "), F.col("call_id"), F.lit(" | From: "), text("from_uri"), F.lit(" | To: "), text("to_uri"), F.lit(" | MOS: "), mos,
        F.lit(" | Quality: "), text("quality"), F.lit(" | EndType: "), text("end_type"), F.lit(" | RootCause: "), text("root_cause"),
    ))
    shown_events = _first(events, n_events, F.desc("timestamp"), F.desc("event_id"))
    of_events = line(shown_events, last + 1, "Events/Alerts", F.concat(F.lit("- ["), text("severity"), F.lit("] "), text("protocol"), F.lit(": "), text("title"), F.lit(" - "), text("description")))
    shown_packets = _first(packets, n_packets, F.col("frame_number"))
    kind = F.when(F.col("app_protocol") != "", F.col("app_protocol")).otherwise(text("protocol"))
    end = lambda side: F.concat(text(f"{side}_ip"), F.lit(":"), F.coalesce(F.col(f"{side}_port"), F.lit(0)).cast("string"))
    total = F.count("*").over(Window.partitionBy("job_id", kind))
    of_packets = shown_packets.select(
        "job_id", F.lit(last + 2).alias("place"), F.concat(kind, F.lit(" Packets ("), total.cast("string"), F.lit(" total)")).alias("section"),
        F.concat(F.lit("- Frame #"), F.col("frame_number").cast("string"), F.lit(" ["), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), end("src"), F.lit(" -> "), end("dst"), F.lit(" | "), kind).alias("line"),
    )
    sides = {"Flows": flows, "Calls": calls, "Events": shown_events, "Packets": shown_packets}
    counts = reduce(DataFrame.unionByName, [df.groupBy("job_id").agg(F.count("*").alias("n")).withColumn("k", F.lit(k)) for k, df in sides.items()])
    by_job = counts.groupBy("job_id").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(k) for k in sides])
    of_all = by_job.select("job_id", F.explode(F.array(*[F.concat(F.lit(f"- Total {k}: "), F.col(k).cast("string")) for k in sides])).alias("line"))
    return reduce(DataFrame.unionByName, [of_flows, of_calls, of_events, of_packets, line(of_all, last + 3, "Summary", F.col("line"))])
