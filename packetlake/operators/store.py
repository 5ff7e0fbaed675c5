"""Queries over stored tables: filters, pages, counts, summaries and lookups.

All are lazy plans of one or two shuffles. Lists end in orderBy and limit together, which Spark runs as one
top-k per partition; ties are broken by a key so that pages don't overlap.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_to(df: DataFrame, **wanted: Any) -> DataFrame:
    """Rows whose columns equal the given values; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, *order: Column, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``limit`` rows after the first ``offset`` in order."""
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def query_packets(packets: DataFrame, job_id: int | None = None, src_ip: str | None = None, dst_ip: str | None = None, protocol: str | None = None, app_protocol: str | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    found = equal_to(packets, job_id=job_id, src_ip=src_ip, dst_ip=dst_ip, protocol=protocol, app_protocol=app_protocol)
    return page(found, F.col("frame_number"), limit=limit, offset=offset)


def packet_count(packets: DataFrame, job_id: int | None = None, protocol: str | None = None) -> DataFrame:
    return equal_to(packets, job_id=job_id, protocol=protocol).agg(F.count("*").alias("packets"))


def protocol_counts(packets: DataFrame) -> DataFrame:
    return packets.where("app_protocol <> ''").groupBy("app_protocol").agg(F.count("*").alias("packets")).orderBy(F.desc("packets"), "app_protocol")


def top_talkers(packets: DataFrame, k: int = 10, job_id: int | None = None) -> DataFrame:
    """The addresses with the most bytes, sent and received together.

    Each side is summed before the union, so that what is shuffled is a row for each address and task.
    """
    found = equal_to(packets, job_id=job_id)
    side = lambda ip: found.groupBy(F.col(ip).alias("ip")).agg(F.sum("length").alias("bytes"), F.count("*").alias("packets"))
    both = side("src_ip").unionByName(side("dst_ip")).groupBy("ip").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    return page(both, F.desc("bytes"), F.col("ip"), limit=k)


def query_events(events: DataFrame, severity: str | None = None, protocol: str | None = None, job_id: int | None = None, limit: int = 100) -> DataFrame:
    return page(equal_to(events, severity=severity, protocol=protocol, job_id=job_id), F.desc("timestamp"), F.desc("event_id"), limit=limit)


def stats_summary(events: DataFrame) -> DataFrame:
    """Counts of all events, by protocol and by severity: one scan, three grouping sets."""
    sets = events.groupingSets([[], [F.col("protocol")], [F.col("severity")]], F.col("protocol"), F.col("severity"))
    return sets.agg(F.grouping("protocol").alias("p"), F.grouping("severity").alias("s"), F.count("*").alias("n")).select(
        F.when(F.col("p") == 0, "protocol").when(F.col("s") == 0, "severity").otherwise("total").alias("by"), F.coalesce("protocol", "severity", F.lit("")).alias("value"), "n"
    )


def traffic_stats(packets: DataFrame, width: str = "1 second") -> DataFrame:
    """Packets, bytes and bits per second of each tumbling window that has packets."""
    out = packets.groupBy(F.window("timestamp", width).alias("w")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    seconds = F.unix_micros(F.col("w.end").cast("timestamp")) / 1_000_000.0 - F.unix_micros(F.col("w.start").cast("timestamp")) / 1_000_000.0
    return out.select(F.col("w.start").alias("timestamp"), "packets", "bytes", (F.col("bytes") * 8 / seconds).alias("bps"))


def last_stats(stats: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows, in order of time."""
    return page(stats, F.desc("timestamp"), limit=n).orderBy("timestamp")


def list_calls(calls: DataFrame, job_id: int | None = None, quality: str | None = None, root_cause: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of calls, latest first, each row with the number of all that match."""
    found = equal_to(calls, job_id=job_id, quality=quality, root_cause=root_cause)
    total = found.agg(F.count("*").alias("total"))
    return page(found, F.desc("start_time"), F.col("call_id"), limit=limit, offset=offset).crossJoin(F.broadcast(total))  # one row


def calls_of_job(calls: DataFrame, job_id: int) -> DataFrame:
    return equal_to(calls, job_id=job_id).orderBy("start_time", "call_id")


def call_by_id(calls: DataFrame, call_id: str) -> DataFrame:
    """One call; ids repeat between jobs, the first job's counts."""
    return page(calls.where(F.col("call_id") == call_id), F.col("job_id"), limit=1)


def legs_of_call(legs: DataFrame, call_id: str) -> DataFrame:
    """The media streams of a call, of any job, by job and place."""
    return page(legs.where(F.col("call_id") == call_id).select("job_id", "leg", "src_ip", "src_port", "dst_ip", "dst_port", "ssrc", "packet_count", "jitter_ms", "max_seq_gap", "start_time", "end_time"), F.col("job_id"), F.col("leg"))


def sip_flow_of_call(flows: DataFrame, call_id: str) -> DataFrame:
    """The call's flow with all its figures; of several jobs' the first job's."""
    return page(flows.where((F.col("flow_id") == call_id) & (F.col("type") == "SIP")), F.col("job_id"), F.col("start_time"), limit=1)


#: How the small tables are listed.
ORDERS = {"capture_sessions": ["-started_at", "id"], "rules": ["id"], "targets": ["id"], "chats": ["-updated_at", "id"], "messages": ["created_at", "id"]}


def listed(df: DataFrame, kind: str, limit: int | None = None, **wanted: Any) -> DataFrame:
    """Rows of a small table that equal the given values, in its order."""
    return page(equal_to(df, **wanted), *[F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in ORDERS[kind]], limit=limit)


def metrics_of_calls(calls: DataFrame, legs: DataFrame) -> DataFrame:
    """A long table of points: each leg's jitter and packets at its start, each call's MOS at its end."""
    points = legs.select("call_id", F.col("start_time").alias("timestamp"), F.stack(F.lit(2), F.lit("jitter_ms"), F.col("jitter_ms"), F.lit("packets"), F.col("packet_count").cast("double")).alias("metric", "value"))
    return points.unionByName(calls.where("mos > 0").select("call_id", F.col("end_time").alias("timestamp"), F.lit("mos").alias("metric"), F.col("mos").alias("value")))


def events_of_call(events: DataFrame, call_id: str, protocol: str = "SIP") -> DataFrame:
    """Events of a protocol, whatever the case, whose description names the call."""
    return events.where((F.upper("protocol") == protocol.upper()) & F.col("description").contains(call_id)).orderBy("timestamp", "event_id")


def call_flow(flows: DataFrame, events: DataFrame, call_id: str) -> DataFrame:
    """A call's steps: its flows by time (id equal or prefixed), then the events that name it by time."""
    own = flows.where((F.col("flow_id") == call_id) | F.col("flow_id").startswith(f"{call_id}-"))
    steps = own.select(F.lit(0).alias("part"), F.col("start_time").alias("timestamp"), F.col("flow_id").alias("id"), "type", F.concat_ws(" -> ", "src_ip", "dst_ip").alias("detail"))
    notes = events.where(F.col("description").contains(call_id)).select(F.lit(1).alias("part"), "timestamp", F.col("event_id").cast("string").alias("id"), F.col("protocol").alias("type"), F.col("description").alias("detail"))
    return steps.unionByName(notes).withColumn("step", F.row_number().over(Window.orderBy("part", "timestamp", "id")).cast("long")).drop("part")


def participants(flows: DataFrame, call_id: str) -> DataFrame:
    own = flows.where((F.col("flow_id") == call_id) | F.col("flow_id").startswith(f"{call_id}-"))
    return own.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()


def flows_of_job(flows: DataFrame, job_id: int, type: str | None = None) -> DataFrame:  # noqa: A002
    return equal_to(flows, job_id=job_id, type=type).orderBy("start_time", "flow_id")


def job_summary(flows: DataFrame, calls: DataFrame, events: DataFrame) -> DataFrame:
    """(job_id, part, key, n): each job's flows by type, calls by quality and events by severity."""
    count = lambda df, part, key: df.groupBy("job_id", F.col(key).alias("key")).agg(F.count("*").alias("n")).select("job_id", F.lit(part).alias("part"), "key", "n")
    return count(flows, "protocol", "type").unionByName(count(calls, "quality", "quality")).unionByName(count(events, "severity", "severity"))


def geo_summary(enrichment: DataFrame, k: int = 20) -> DataFrame:
    return page(enrichment.groupBy("country", "region").agg(F.count("*").alias("ips")), F.desc("ips"), F.col("country"), limit=k)


def flagged_ips(enrichment: DataFrame, least: int = 50, k: int = 100) -> DataFrame:
    bad = enrichment.where(F.col("is_tor") | F.col("is_abusive") | (F.col("abuse_score") >= least))
    return page(bad.select("ip", "source_id", "country", "abuse_score", "is_tor", "is_abusive"), F.desc("abuse_score"), F.desc("is_tor"), F.col("source_id"), limit=k)


def fresh_enrichment(enrichment: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Rows checked within the last ``days``; a date in the condition, so that files are skipped by their statistics."""
    return enrichment.where(F.col("last_checked") >= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL '{days}' DAY"))


def latest_enrichment(enrichment: DataFrame) -> DataFrame:
    """One row for each address, the one checked last."""
    columns = [c for c in enrichment.columns if c != "ip"]
    latest = enrichment.groupBy("ip").agg(F.max_by(F.struct(*columns), F.struct("last_checked", "source_id")).alias("r"))
    return latest.select("ip", *[f"r.{c}" for c in columns])


def to_enrich(flows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Distinct public addresses without a fresh row."""
    # The condition takes the count in, so that each address is judged once and not each flow's.
    ips = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))
    public = ips.where(F.when(F.col("n") > 0, ~is_private(F.col("ip")))).select("ip")
    return public.join(fresh.select("ip").distinct(), "ip", "left_anti")


def enrich(flows: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Flows with the country and score of their source; an equi-join whose small side Spark may broadcast by its size."""
    small = latest_enrichment(enrichment).select(F.col("ip").alias("src_ip"), F.col("country").alias("src_country"), "abuse_score")
    return flows.join(small, "src_ip", "left")


def is_private(ip: Column) -> Column:
    """Loopback, private, link-local (also multicast) and carrier-grade ranges of IPv4 and IPv6; what is no address counts as private."""
    ip = F.regexp_replace(ip, r"^([^:]*):[^:]*$", "$1")  # a port behind an IPv4 address
    part = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("int")
    a, b = part(1), part(2)
    v4 = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(a, b, part(3), part(4)) <= 255)
    local = ((a == 169) & (b == 254)) | ((a == 224) & (b == 0) & (part(3) == 0))
    inside = local | (a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    v6 = ip.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$")
    low = F.lower(ip)
    inside6 = (low == "::1") | low.rlike(r"^f[cd][0-9a-f]{2}:") | low.rlike(r"^fe[89ab][0-9a-f]:") | low.rlike(r"^ff[0-9a-f]2:")
    return F.when(v4, inside).when(v6, inside6).otherwise(F.lit(True))


def ranked_per(df: DataFrame, key: str, *order: Column, n: int = 3) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def conversation_matrix(packets: DataFrame) -> DataFrame:
    """Each pair of addresses and protocol: packets and bytes either way, first and last time."""
    forward = F.col("src_ip") <= F.col("dst_ip")
    one = lambda c, way: F.sum(F.when(way, c).otherwise(0))
    return packets.groupBy(F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b"), "app_protocol").agg(
        one(F.lit(1), forward).alias("fwd_packets"), one(F.lit(1), ~forward).alias("rev_packets"), one(F.col("length"), forward).alias("fwd_bytes"), one(F.col("length"), ~forward).alias("rev_bytes"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.sum("length").alias("bytes"),
    )


def hex_rows(packets: DataFrame, column: str = "raw_packet", width: int = 16) -> DataFrame:
    """(frame_number, offset, hex, ascii): the bytes of a binary column in rows of ``width``."""
    rows = packets.where(F.length(column) > 0).select("frame_number", column, F.explode(F.sequence(F.lit(0), F.floor((F.length(column) - 1) / width).cast("int"))).alias("row"))
    part = F.expr(f"substring({column}, row * {width} + 1, {width})")
    return rows.select("frame_number", (F.col("row") * width).cast("long").alias("offset"), F.trim(F.regexp_replace(F.hex(part), "(..)", "$1 ")).alias("hex"), F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7e]", ".").alias("ascii"))


def event_groups(events: DataFrame, k: int = 20) -> DataFrame:
    groups = events.groupBy("title", "severity").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return page(groups, F.desc("n"), F.col("title"), F.col("severity"), limit=k)


def any_of(column: str, values: Sequence[Any]) -> Column:
    return F.col(column).isin(list(values))


def port_filter(packets: DataFrame, ports: str) -> DataFrame:
    """Packets to or from one of the ports in a list such as ``5060,5061``; an empty list keeps all."""
    wanted = [int(p) for p in ports.replace(" ", "").split(",") if p]
    return packets.where(any_of("src_port", wanted) | any_of("dst_port", wanted)) if wanted else packets


# Names of layers by protocol, their colours, and which fields come first.
TRANSPORTS = {"UDP": "User Datagram Protocol", "SCTP": "Stream Control Transmission Protocol"}
FULL_NAMES = {
    "SIP": "Session Initiation Protocol", "RTP": "Real-time Transport Protocol", "HTTP": "Hypertext Transfer Protocol", "DNS": "Domain Name System",
    "TLS": "Transport Layer Security", "Diameter": "Diameter Protocol", "GTP": "GPRS Tunnelling Protocol", "GTP-C": "GTP Control Plane", "GTP-U": "GTP User Plane",
    "PFCP": "Packet Forwarding Control Protocol", "S1AP": "S1 Application Protocol (LTE)", "NGAP": "NG Application Protocol (5G)", "WebSocket": "WebSocket Protocol",
}
COLOURS = {
    "SIP": "#34d399", "RTP": "#22d3ee", "HTTP": "#f59e0b", "DNS": "#818cf8", "TLS": "#84cc16", "Diameter": "#f472b6", "GTP": "#fb923c", "GTP-C": "#fb923c", "GTP-U": "#fbbf24",
    "PFCP": "#a78bfa", "S1AP": "#38bdf8", "NGAP": "#4ade80", "WebSocket": "#a3e635",
}
FIRST_FIELDS = {
    "SIP": ["method", "uri", "status_code", "status_text", "from", "to", "call_id", "via", "contact", "content_type", "content_length"],
    "DNS": ["query_name", "query_type", "reply_code", "answers"],
    "HTTP": ["method", "uri", "status_code", "host", "user_agent", "content_type", "content_length"],
    "Diameter": ["command_code", "command", "app_id", "is_request", "origin_host", "result_code"],
    "GTP": ["message_type", "teid", "imsi", "apn", "rat_type"],
    "NGAP": ["procedure_name", "pdu_type", "cause"],
}
GREY, INDIGO, SKY = "#94a3b8", "#818cf8", "#38bdf8"


def layer_tree(packets: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(frame_number, job_id, layers): what a viewer shows of each packet, from the frame to the application.

    A layer has a name, a colour and fields of a name and a value. The application's fields are the entries of
    the map ``metadata``: those that its protocol puts first, then the others by name, cut after 200 characters.
    Packets without an application protocol of their own have no such layer.
    """
    table = lambda rows, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in rows.items() for x in kv]), key)
    field = lambda name, value: F.struct(F.lit(name).alias("name"), F.coalesce(value.cast("string"), F.lit("")).alias("value"))
    layer = lambda name, colour, fields: F.struct(name.alias("name"), colour.alias("color"), fields.alias("fields"))
    protocol, app, meta = F.col("protocol"), F.col("app_protocol"), F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    chain = F.concat_ws(":", F.lit("eth:ip"), F.when(protocol.isin("TCP", "UDP", "SCTP"), F.lower(protocol)), F.when(app != "", app))
    frame = [field("Arrival Time", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")), field("Frame Number", F.col("frame_number")), field("Frame Length", F.concat(F.col("length").cast("string"), F.lit(" bytes"))), field("Protocols in Frame", chain)]
    ip = F.array(field("Source Address", F.col("src_ip")), field("Destination Address", F.col("dst_ip")), field("Protocol", F.when(protocol != "", protocol).otherwise("Unknown")))
    ttl = F.when(F.try_element_at(meta, F.lit("ttl")).isNotNull(), F.array(field("Time to Live", F.try_element_at(meta, F.lit("ttl"))))).otherwise(F.filter(ip, lambda x: F.lit(False)))
    ports = F.array(field("Source Port", F.col("src_port")), field("Destination Port", F.col("dst_port")))
    title = lambda k: F.array_join(F.transform(F.split(k, "[_-]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")
    first = F.coalesce(table({k: ",".join(v) for k, v in FIRST_FIELDS.items()}, app), F.lit(""))
    ahead = F.filter(F.split(first, ","), lambda k: F.map_contains_key(meta, k))
    rest = F.array_sort(F.filter(F.map_keys(meta), lambda k: ~F.array_contains(ahead, k)))
    short = lambda v: F.when(F.length(v) > 200, F.concat(F.substring(v, 1, 200), F.lit("…"))).otherwise(v)
    shown = lambda keys, cut: F.transform(keys, lambda k: F.struct(title(k).alias("name"), F.coalesce(cut(F.element_at(meta, k)), F.lit("")).alias("value")))
    fields = F.concat(shown(ahead, lambda v: v), shown(rest, short))
    layers = F.array(
        layer(F.format_string("Frame %d", "frame_number"), F.lit(GREY), F.array(*frame)),
        layer(F.lit("Internet Protocol Version 4"), F.lit(INDIGO), F.concat(ip, ttl)),
        layer(F.coalesce(table(TRANSPORTS, protocol), F.lit("Transmission Control Protocol")), F.lit(SKY), ports),
        F.when((app != "") & (app != protocol), layer(F.coalesce(table(FULL_NAMES, app), app), F.coalesce(table(COLOURS, app), F.lit(GREY)), fields)),
    )
    return packets.select("job_id", "frame_number", F.array_compact(layers).alias("layers"))


def telecom_list(sessions: DataFrame, job_id: int | None = None, limit: int = 500) -> DataFrame:
    """The first sessions of a job by start, or of all jobs, the latest job first; without their steps."""
    own = sessions if job_id is None else sessions.where(F.col("job_id") == job_id)
    return page(own, F.desc("job_id"), F.col("start_time"), F.col("session_id"), limit=limit)


def telecom_session(sessions: DataFrame, job_id: int, session_id: str) -> DataFrame:
    return sessions.where((F.col("job_id") == job_id) & (F.col("session_id") == session_id)).limit(1)
