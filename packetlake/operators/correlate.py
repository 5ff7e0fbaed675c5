"""Correlation of signalling, media and mobile-core flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import clamp, rounded
from ..session import stored
from .joins import interval_join

# The step that a message stands for, by the type of its flow; other messages are the prefix and their name.
STEPS = {
    "NGAP": {
        "InitialUEMessage": "UE_Registration", "InitialContextSetup": "Context_Setup", "PDUSessionResourceSetup": "PDU_Session_Setup",
        "PDUSessionResourceRelease": "PDU_Session_Release", "UEContextRelease": "UE_Context_Release", "DownlinkNASTransport": "NAS_Downlink",
        "UplinkNASTransport": "NAS_Uplink", "NGSetup": "NG_Setup", "HandoverPreparation": "Handover_Prep", "HandoverNotification": "Handover_Complete",
    },
    "GTP": {
        "Create Session Request": "PDU_Session_Establish_Req", "Create Session Response": "PDU_Session_Establish_Resp",
        "Delete Session Request": "PDU_Session_Release_Req", "Delete Session Response": "PDU_Session_Release_Resp",
        "Modify Bearer Request": "Bearer_Modify_Req", "Modify Bearer Response": "Bearer_Modify_Resp",
    },
    "PFCP": {
        "Session Establishment Request": "PFCP_Establish_Req", "Session Establishment Response": "PFCP_Establish_Resp",
        "Session Modification Request": "PFCP_Modify_Req", "Session Modification Response": "PFCP_Modify_Resp",
        "Session Deletion Request": "PFCP_Delete_Req", "Session Deletion Response": "PFCP_Delete_Resp",
    },
    "SIP": {"REGISTER": "IMS_Register", "INVITE": "IMS_Call_Setup", "200": "IMS_Call_Connected", "BYE": "IMS_Call_Teardown", "CANCEL": "IMS_Call_Cancel", "": "IMS_Signal"},
    "Diameter": {
        "Update-Location": "HSS_Location_Update", "Authentication": "HSS_Authenticate", "Authentication-Information": "HSS_Authenticate",
        "Cancel-Location": "HSS_Cancel_Location", "Insert-Subscriber": "HSS_Subscribe", "Credit-Control": "PCRF_Credit_Control",
    },
}
PREFIXES = {"NGAP": "NGAP_", "GTP": "GTP-C_", "PFCP": "PFCP_", "SIP": "IMS_", "Diameter": "Diameter_"}
SINGLE = {"GTPU": "Data_Tunnel", "RTP": "RTP_Media"}
# The milestones of a session's life, and the state each leads to.
MILESTONES = {
    "UE_Registration": "attaching", "NAS_Uplink": "attaching", "Context_Setup": "registered", "HSS_Authenticate": "registered",
    "HSS_Location_Update": "registered", "PDU_Session_Setup": "pdu_establishing", "PDU_Session_Establish_Req": "pdu_establishing",
    "PDU_Session_Establish_Resp": "active", "PFCP_Establish_Req": "pdu_establishing", "PFCP_Establish_Resp": "active", "Data_Tunnel": "active",
    "IMS_Register": "active", "IMS_Call_Setup": "active", "IMS_Call_Connected": "active", "RTP_Media": "active",
    "IMS_Call_Teardown": "releasing", "PDU_Session_Release_Req": "releasing", "UE_Context_Release": "releasing",
}


#: Flows to a partition of the members of sessions.
ROWS = 400_000


def first_of(value: str | Column, *order: str | Column) -> Column:
    """The first value that isn't null or empty, in order."""
    v = F.col(value) if isinstance(value, str) else value
    there = v.isNotNull() & (v.cast("string") != "")
    return F.min_by(F.when(there, v), F.when(there, F.struct(*order)))


def calls_from_flows(flows: DataFrame) -> DataFrame:
    """A row per call with media: its SIP flow (the first of its id) and the RTP flows of its job at its media endpoint.

    An RTP flow belongs to a call if one of its addresses is the call's media address and one of its
    ports the media port, also of different ends. Each flow is exploded to its four candidates, so that
    the join is an equi-join; a flow counts once per call. Calls without media flows stay.
    """
    told = F.struct("start_time", "end_time", "src_ip", "dst_ip", "media_ip", "media_port")
    sip = flows.where("type = 'SIP' and media_ip is not null and media_port is not null").groupBy("job_id", "flow_id")
    sip = sip.agg(F.min_by(told, F.struct("start_time", "src_ip", "media_ip")).alias("s")).select("job_id", "flow_id", "s.*")
    end = lambda i, p: F.struct(i.alias("media_ip"), p.alias("media_port"))
    ends = F.flatten(F.transform(F.array("src_ip", "dst_ip"), lambda i: F.transform(F.array("src_port", "dst_port"), lambda p: end(i, p))))
    columns = ["job_id", "packets", "jitter_ms", "max_seq_gap"]
    rtp = flows.where("type = 'RTP'").select(*columns, F.explode(F.array_distinct(ends)).alias("e")).select(*columns, "e.*")
    each = sip.join(rtp, ["job_id", "media_ip", "media_port"]).groupBy("job_id", "flow_id").agg(
        F.count("*").alias("legs"), F.sum("packets").alias("packets"), F.max("jitter_ms").alias("jitter_ms"), F.max("max_seq_gap").alias("max_seq_gap")
    )
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = sip.join(each, ["job_id", "flow_id"], "left")
    return out.select("job_id", F.col("flow_id").alias("call_id"), "start_time", "end_time", "media_ip", "media_port", count("legs"), count("packets"), "jitter_ms", "max_seq_gap")


def subscribers(flows: DataFrame) -> DataFrame:
    """A profile per job and IMSI: first number, access point and address by protocol order, then time; times and tunnels seen."""
    rank = F.when(F.col("type") == "NGAP", 0).when(F.col("type") == "GTP", 1).otherwise(2)
    own = flows.where("imsi is not null").withColumn("rank", rank)
    order = ("rank", "start_time", "flow_id")
    return own.groupBy("job_id", "imsi").agg(
        first_of("msisdn", *order).alias("msisdn"), first_of("apn", *order).alias("apn"), first_of("ue_ip", *order).alias("ue_ip"),
        F.min("start_time").alias("first_seen"), F.max("end_time").alias("last_seen"), F.array_sort(F.collect_set("teid")).alias("teids"), F.count("*").alias("flows"),
    )


def lookup_index(profiles: DataFrame) -> DataFrame:
    """(job_id, kind, id, imsi): every id a subscriber may be looked up by."""
    ids = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in ("imsi", "msisdn", "ue_ip")])
    teids = F.transform(F.coalesce("teids", F.array().cast("array<string>")), lambda t: F.struct(F.lit("teid").alias("kind"), t.alias("id")))
    return profiles.select("job_id", "imsi", F.explode(F.concat(ids, teids)).alias("e")).where("e.id is not null").select("job_id", "e.kind", "e.id", "imsi")


def media_members(claimed: DataFrame, flows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(job_id, key, flow_id, type, ...): RTP flows with a media endpoint of the SIP flows of (job_id, key, media_ip, media_port) at either end."""
    end = lambda side: F.struct(F.col(f"{side}_ip").alias("media_ip"), F.col(f"{side}_port").alias("media_port"))
    kept = ["job_id", "flow_id", "type", *columns]
    rtp = flows.where("type = 'RTP'").select(*kept, F.explode(F.array_distinct(F.array(end("src"), end("dst")))).alias("e")).select(*kept, "e.*")
    wanted = claimed.where("media_ip <> '' and media_port is not null").select("job_id", key, "media_ip", "media_port").distinct()
    return wanted.join(rtp, ["job_id", "media_ip", "media_port"]).select("job_id", key, "flow_id", "type", *columns).distinct()


def sessions(flows: DataFrame, pad_seconds: float = 30.0, near_types: tuple[str, ...] = ()) -> DataFrame:
    """(job_id, imsi, flow_id, type, via): the flows of each subscriber's session, within a job.

    A session's bounds are those of the flows that carry its IMSI; other flows join it within
    ``pad_seconds`` of them: GTP-U by tunnel, user-plane flows by the subscriber's address, SIP by that
    address at either end, and RTP by a media endpoint of its SIP flows, at any time. All ids a flow may be known by are
    exploded, so that the rules are one equi-join, and a flow that several rules give counts once. Being
    near in time alone counts for ``near_types`` only (such as NGAP, Diameter and RTP): it gives a flow to all
    subscribers of its half minute.

    Flows are written once, as each rule reads them. Members are dealt by their flow to partitions whose
    number grows with the flows, so that a task's memory doesn't; what joins the flows again keeps them so.
    """
    flows = stored(flows.select("job_id", "flow_id", "type", "start_time", "end_time", "imsi", "msisdn", "apn", "ue_ip", "teid", "src_ip", "src_port", "dst_ip", "dst_port", "media_ip", "media_port"))
    parts = max(int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-flows.count() // ROWS))
    profile = subscribers(flows)
    own = flows.where("imsi is not null").select("job_id", "imsi", "flow_id", "type", F.lit("imsi").alias("via"))
    rest = flows.where("imsi is null").drop("imsi")
    known = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("id"))
    address = F.when(F.col("ue_ip").isNotNull(), F.array(known("ue_ip", F.col("ue_ip")), known("end", F.col("ue_ip")))).otherwise(F.array().cast("array<struct<kind: string, id: string>>"))
    ids = profile.select("job_id", "imsi", "first_seen", "last_seen", F.explode(F.concat(F.transform("teids", lambda t: known("teid", t)), address)).alias("e"))
    ids = ids.select("job_id", "imsi", "first_seen", "last_seen", "e.*")
    carried = (
        F.when(F.col("type") == "GTPU", F.array(known("teid", F.col("teid"))))
        .when(F.col("type").isin("PFCP", "GTP"), F.array(known("ue_ip", F.col("ue_ip"))))
        .when(F.col("type") == "SIP", F.transform(F.array_distinct(F.array("src_ip", "dst_ip")), lambda i: known("end", i)))
    )
    shown = rest.select("job_id", "flow_id", "type", "start_time", "end_time", "media_ip", "media_port", F.explode(carried).alias("e")).select("*", "e.*").drop("e")
    pad = F.expr(f"INTERVAL '{pad_seconds}' SECOND")
    near = (F.col("start_time") < F.col("last_seen") + pad) & (F.col("end_time") > F.col("first_seen") - pad)
    met = shown.join(ids, ["job_id", "kind", "id"]).where(near)
    members = ["job_id", "imsi", "flow_id", "type", "via"]
    every = own.unionByName(met.withColumn("via", F.col("kind")).select(*members))
    every = every.unionByName(media_members(met.where("kind = 'end'"), rest, "imsi").withColumn("via", F.lit("media")).select(*members))
    if near_types:
        spans = profile.select("job_id", "imsi", F.col("first_seen").alias("start_time"), F.col("last_seen").alias("end_time"))
        others = rest.where(F.col("type").isin(*near_types)).select("job_id", "flow_id", "type", "start_time", "end_time")
        by_time = interval_join(spans, others, 2 * pad_seconds, 60, ["job_id"])
        every = every.unionByName(by_time.select(F.col("l_job_id").alias("job_id"), F.col("l_imsi").alias("imsi"), F.col("r_flow_id").alias("flow_id"), F.col("r_type").alias("type"), F.lit("time").alias("via")))
    return every.repartition(parts, "job_id", "flow_id", "type").groupBy("job_id", "imsi", "flow_id", "type").agg(F.min("via").alias("via"))


def stream_mos() -> Column:
    """The opinion score of an RTP flow by its losses and jitter; null for others."""
    return F.when(F.col("type") == "RTP", F.greatest(4.5 - 0.05 * clamp(F.col("packet_loss_pct"), 0, 100) - 0.01 * F.col("jitter_ms"), F.lit(1.0)))


def stream_quality(mos: str = "mos") -> Column:
    return F.when(F.col(mos).isNull(), None).when(F.col(mos) >= 4, "good").when(F.col(mos) >= 3, "fair").otherwise("poor")


def session_summary(flows: DataFrame, members: DataFrame) -> DataFrame:
    """A row per session: bounds, layers, worst MOS, quality, and whether all layers are there."""
    joined = members.join(flows.select("job_id", "flow_id", "type", "start_time", "end_time", "packet_loss_pct", "jitter_ms"), ["job_id", "flow_id", "type"])
    each = joined.groupBy("job_id", "imsi").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.array_sort(F.collect_set("type")).alias("layers"), F.count("*").alias("flows"), rounded(F.min(stream_mos())).alias("mos"))
    there = lambda t: F.array_contains("layers", t)
    return each.select("job_id", "imsi", "start_time", "end_time", "layers", "flows", "mos", stream_quality().alias("quality"), (there("NGAP") & there("GTP") & there("SIP") & there("RTP")).alias("complete"))


def media_totals(calls: DataFrame, flows: DataFrame) -> DataFrame:
    """(job_id, call_id, streams, start_time, end_time, mos): what the RTP flows at either end of a call's media endpoints sum up to.

    ``calls`` has (job_id, call_id, media_ip, media_port), a row per endpoint. RTP flows that are equal but for their ends
    count once. No call meets its flows one by one: flows are summed by the endpoints that they have, calls are
    put together by theirs, and the two meet by endpoint. A flow at several endpoints of a call is counted at
    each of them and taken off again by pairs of endpoints.
    """
    end = lambda ip, port: F.struct(F.col(ip).alias("media_ip"), F.col(port).alias("media_port"))
    wanted = calls.where("media_ip <> '' and media_port is not null").select("job_id", "call_id", end("media_ip", "media_port").alias("at"))
    of_call = wanted.groupBy("job_id", "call_id").agg(F.array_sort(F.collect_set("at")).alias("ends"))
    sets = of_call.select("job_id", "ends").distinct()
    rtp = flows.where("type = 'RTP'").withColumn("at", F.explode(F.array_distinct(F.array(end("src_ip", "src_port"), end("dst_ip", "dst_port")))))
    rtp = rtp.join(wanted.select("job_id", "at").distinct(), ["job_id", "at"], "left_semi")
    same = ["flow_id", "start_time", "end_time", "packet_loss_pct", "jitter_ms"]
    each = rtp.groupBy("job_id", *same).agg(F.array_sort(F.collect_set("at")).alias("places"))
    figures = [F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")]
    by_places = each.withColumn("type", F.lit("RTP")).groupBy("job_id", "places").agg(F.count("*").alias("n"), *figures, F.min(stream_mos()).alias("mos"))
    by_end = by_places.withColumn("at", F.explode("places")).groupBy("job_id", "at").agg(F.sum("n").alias("n"), *figures, F.min("mos").alias("mos"))
    met = sets.withColumn("at", F.explode("ends")).join(by_end, ["job_id", "at"]).groupBy("job_id", "ends").agg(F.sum("n").alias("n"), *figures, F.min("mos").alias("mos"))
    pairs = lambda c: F.explode(F.flatten(F.transform(c, lambda x: F.transform(F.filter(c, lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    both = sets.where(F.size("ends") > 1).withColumn("pair", pairs("ends")).join(by_places.where(F.size("places") > 1).select("job_id", "places", "n", pairs("places").alias("pair")), ["job_id", "pair"])
    again = both.select("job_id", "ends", "places", "n").distinct().groupBy("job_id", "ends").agg(F.sum(F.col("n") * (F.size(F.array_intersect("ends", "places")) - 1)).alias("again"))
    totals = met.join(again, ["job_id", "ends"], "left").withColumn("streams", F.col("n") - F.coalesce("again", F.lit(0)))
    return of_call.join(totals, ["job_id", "ends"]).select("job_id", "call_id", "streams", "start_time", "end_time", "mos")


def ims_sessions(flows: DataFrame, members: DataFrame) -> DataFrame:
    """A row per SIP flow that no subscriber's session has: bounds, its RTP flows by media endpoint, worst MOS, quality."""
    lone = flows.where("type = 'SIP'").join(members.where("type = 'SIP'").select("job_id", "flow_id").distinct(), ["job_id", "flow_id"], "left_anti")
    lone = lone.select("job_id", F.col("flow_id").alias("call_id"), "start_time", "end_time", "media_ip", "media_port")
    own = lone.select("job_id", "call_id", "start_time", "end_time", F.lit(0).cast("long").alias("streams"), F.lit(None).cast("double").alias("mos"))
    each = own.unionByName(media_totals(lone, flows)).groupBy("job_id", "call_id")
    out = each.agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("streams").alias("streams"), rounded(F.min("mos")).alias("mos"))
    return out.select("job_id", F.concat(F.lit("ims-"), "call_id").alias("session_id"), "call_id", "start_time", "end_time", "streams", "mos", stream_quality().alias("quality"))


def step() -> Column:
    """The step that a flow's message stands for; null for types without steps."""
    name = F.coalesce(F.when(F.col("type") == "SIP", F.col("method")).when(F.col("type") == "Diameter", F.col("command")).otherwise(F.col("message_type")), F.lit(""))
    table = lambda rows: F.create_map(*[F.lit(x) for kv in rows.items() for x in kv])
    known = table({f"{kind}|{k}": v for kind, steps in STEPS.items() for k, v in steps.items()})
    other = F.concat(F.try_element_at(table(PREFIXES), F.col("type")), name)
    return F.coalesce(F.try_element_at(table(SINGLE), F.col("type")), F.try_element_at(known, F.concat(F.col("type"), F.lit("|"), name)), other)


def session_steps(flows: DataFrame, members: DataFrame) -> DataFrame:
    """(job_id, imsi, flow_id, step, at): what happens in each session."""
    steps = flows.select("job_id", "flow_id", "type", F.col("start_time").alias("at"), step().alias("step")).where("step is not null")
    return members.join(steps, ["job_id", "flow_id", "type"]).select("job_id", "imsi", "flow_id", "step", "at")


def lifecycle(flows: DataFrame, members: DataFrame) -> DataFrame:
    """(job_id, imsi, step, at, delta_ms, state): the first time of each milestone of a session, from its first step of any kind."""
    steps = session_steps(flows, members)
    state = F.create_map(*[F.lit(x) for kv in MILESTONES.items() for x in kv])
    start = steps.groupBy("job_id", "imsi").agg(F.min("at").alias("start"))
    first = steps.withColumn("state", F.try_element_at(state, F.col("step"))).where("state is not null").groupBy("job_id", "imsi", "step", "state").agg(F.min("at").alias("at"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return first.join(start, ["job_id", "imsi"]).select("job_id", "imsi", "step", "at", ((micros("at") - micros("start")) / 1000).alias("delta_ms"), "state")


def final_state(steps: DataFrame) -> DataFrame:
    return steps.groupBy("job_id", "imsi").agg(F.max_by("state", F.struct("at", "step")).alias("state"))


#: The types that may join a session around a call, in the order in which they are looked through; those that need a common address.
AROUND, BY_ADDRESS = ("Diameter", "GTP", "PFCP", "RTP", "S1AP", "NGAP"), ("Diameter", "RTP")
_SPAN = ["job_id", "flow_id", "type", "src_ip", "dst_ip", "start_time", "end_time"]


def _around_calls(flows: DataFrame, pad_seconds: float, *more: str) -> DataFrame:
    common = F.lit(False)
    for a in ("l_src_ip", "l_dst_ip"):
        for b in ("r_src_ip", "r_dst_ip"):
            common = common | (F.col(a) == F.col(b))
    sip, others = flows.where("type = 'SIP'").select(*_SPAN), flows.where(F.col("type").isin(*AROUND)).select(*_SPAN, *more)
    return interval_join(sip, others, pad_seconds, int(2 * pad_seconds) or 1, ["job_id"]).where(~F.col("r_type").isin(*BY_ADDRESS) | common)


def cross_protocol(flows: DataFrame, pad_seconds: float = 5.0) -> DataFrame:
    """(anchor, flow_id, type): flows near each SIP flow in time, Diameter and RTP only with a common address."""
    own = stored(flows.where(F.col("type").isin("SIP", *AROUND)).select(*_SPAN))  # the join reads its sides twice
    return _around_calls(own, pad_seconds).select(F.col("l_flow_id").alias("anchor"), F.col("r_flow_id").alias("flow_id"), F.col("r_type").alias("type"))


def _gtp_with_pfcp(flows: DataFrame, pad_seconds: float, *more: str) -> DataFrame:
    gtp, pfcp = flows.where("type = 'GTP'").select(*_SPAN), flows.where("type = 'PFCP'").select(*_SPAN, *more)
    return interval_join(gtp, pfcp, pad_seconds, int(2 * pad_seconds) or 1, ["job_id"])


def gtp_pfcp(flows: DataFrame, pad_seconds: float = 5.0) -> DataFrame:
    """Pairs of GTP and PFCP flows near each other in time."""
    return _gtp_with_pfcp(flows, pad_seconds).select(F.col("l_flow_id").alias("gtp"), F.col("r_flow_id").alias("pfcp"))


def cross_sessions(flows: DataFrame, pad_seconds: float = 5.0) -> DataFrame:
    """A row per session around a SIP flow, and around a GTP flow with PFCP flows near it.

    ``protocols`` are those of its flows, the anchor's first. The end is the latest of the flows around a
    call, that of the flow itself around GTP. diameter_session, teid and seid are those of the last such flow; IMSI and number
    are the first that is told, by the order of protocols, then time. A flow without times is near to none.
    """
    there = "details" in flows.columns
    detail = lambda k: F.try_element_at("details", F.lit(k)) if there else F.lit(None).cast("string")
    names = ["imsi", "msisdn", "teid", "diameter_session", "seid"]
    # Written once: the joins read their sides twice, to count them first.
    own = flows.withColumns({"diameter_session": detail("session_id"), "seid": detail("seid")}).where(F.col("type").isin("SIP", *AROUND))
    own = stored(own.select(*_SPAN, *names))
    ends, fields = ["flow_id", "type", "start_time", "end_time"], ["flow_id", "type", "start_time", "end_time", *names]
    pick = lambda prefix, some: F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in some])
    pairs = _around_calls(own, pad_seconds, *names).unionByName(_gtp_with_pfcp(own, pad_seconds, *names))
    met = pairs.select(F.col("l_job_id").alias("job_id"), pick("l_", ends).alias("anchor"), pick("r_", fields).alias("f"))
    alone = own.where("type in ('SIP', 'GTP')").select("job_id", pick("", ends).alias("anchor"), pick("", fields).alias("f"))
    every = met.unionByName(alone).select("job_id", "anchor", "f.*")
    rank = F.when(F.col("type") == F.col("anchor.type"), -1).otherwise(F.array_position(F.array(*map(F.lit, AROUND)), F.col("type"))).cast("int")
    last = lambda kind, c: F.max_by(c, F.when(F.col("type") == kind, F.struct("start_time", "flow_id"))).alias(c)
    order = ("rank", "start_time", "flow_id")
    out = every.withColumn("rank", rank).groupBy("job_id", "anchor").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("rank", "type"))), lambda x: x["type"]).alias("protocols"), F.count("*").alias("flows"), F.max("end_time").alias("latest"),
        last("Diameter", "diameter_session"), last("GTP", "teid"), last("PFCP", "seid"), first_of("imsi", *order).alias("imsi"), first_of("msisdn", *order).alias("msisdn"),
    )
    call = F.col("anchor.type") == "SIP"
    return out.where(call | (F.size("protocols") > 1)).select(
        "job_id", F.concat(F.when(call, "session-").otherwise("session-gtp-"), "anchor.flow_id").alias("session_id"), F.when(call, F.col("anchor.flow_id")).alias("call_id"), "anchor.start_time",
        F.when(call, F.greatest("latest", "anchor.end_time")).otherwise(F.col("anchor.end_time")).alias("end_time"), "protocols", "flows", *names,
    )


def normal_teid(teid: Column) -> Column:
    """0x and eight lower-case digits, of a number in hexadecimal with or without 0x."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.regexp_replace(teid, "^0[xX]", "")), 8, "0"))


def media_lookup(reports: DataFrame, legs: DataFrame) -> DataFrame:
    """Receiver reports (job_id, ip, port, ...) with the call of their job's leg that has the endpoint at either end."""
    end = lambda side: F.struct(F.col(f"{side}_ip").alias("ip"), F.col(f"{side}_port").alias("port"))
    ends = legs.select("job_id", "call_id", F.explode(F.array(end("src"), end("dst"))).alias("e")).select("job_id", "call_id", "e.*")
    return reports.join(ends.groupBy("job_id", "ip", "port").agg(F.min("call_id").alias("call_id")), ["job_id", "ip", "port"], "left")


def telecom_sessions(flows: DataFrame, members: DataFrame) -> DataFrame:
    """A row per subscriber's session, as it is stored: its ids, bounds, quality, and which layers it has."""
    profile = subscribers(flows).select("job_id", "imsi", "msisdn", "apn", "ue_ip", "teids")
    own = session_summary(flows, members).join(profile, ["job_id", "imsi"])
    there = {"NGAP": "has_ngap", "GTP": "has_gtpc", "PFCP": "has_pfcp", "GTPU": "has_gtpu", "SIP": "has_sip", "RTP": "has_rtp", "Diameter": "has_diameter"}
    has = [F.array_contains("layers", t).alias(c) for t, c in there.items()]
    return own.select("job_id", F.concat(F.lit("imsi-"), "imsi").alias("session_id"), "imsi", "msisdn", "apn", "ue_ip", "start_time", "end_time", "mos", "quality", *has, F.col("complete").alias("is_complete"), "layers", "teids")
