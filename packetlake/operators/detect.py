"""Detection rules over flows.

A rule is a function that returns columns: alerts of a flow, of a group of flows, or of a flow that meets its
group. Alerts have rule, severity, protocol, title, description, flow_id, subject (an address, domain or key), value
(what was measured) and metadata (a map of texts). ``run`` writes the flows and the counts of their groups once to the
shared folder, as several passes read them: each kind of groups is counted from the few columns that it needs, one pass
looks at each flow, and one joins flows to groups. Each rule also runs by itself, from ``RULES``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import clamp, entropy, mos_of_r
from ..schemas import FLOW, columns
from ..session import stored
from .alert_texts import with_texts
from .reports import sip_status

# Fixed values.
STANDARD_PORTS = {"SIP": [5060, 5061], "DNS": [53], "Diameter": [3868], "GTP": [2123, 2152], "PFCP": [8805]}
LARGEST_PACKET = {"RTP": 400, "DNS": 512, "SIP": 4000}
LONGEST_SECONDS = {"DNS": 30, "Diameter": 300, "PFCP": 300, "GTP": 600, "RTP": 7200, "SIP": 7200}
DROP_REASONS = {480: "Temporarily Unavailable", 486: "Busy Here", 487: "Request Cancelled", 503: "Service Unavailable", 504: "Server Timeout"}
WEAK_TLS = {"SSLv3": "POODLE", "TLSv1.0": "BEAST/POODLE", "TLSv1.1": "deprecated — IETF RFC 8996"}
SUSPICIOUS_TLDS = ["xyz", "top", "club", "gq", "cf", "ga", "ml", "tk", "pw", "work", "click", "download", "stream", "zip", "mov"]
BROKEN_CIPHERS = ["NULL", "EXPORT", "ANON", "RC4", "_DES_", "3DES", "RC2", "IDEA", "KRB5"]
MALICIOUS_JA3 = {
    "e7d705a3286e19ea42f587b344ee6865": "Mirai botnet C2",
    "6734f37431670b3ab4292b8f60f29984": "Trickbot malware",
    "a0e9f5d64349fb13191bc781f81f42e1": "CobaltStrike Beacon (default)",
    "72a589da586844d7f0818ce684948eea": "CobaltStrike Beacon (variant)",
    "b386946a5a44d1ddcc843bc75336dfce": "Metasploit Framework",
    "de350869b8c85de67a350c8d186f11e6": "Dridex banking trojan",
    "6bea65232d2734571b057466a576d801": "Agent Tesla",
}

RULES: dict[str, Callable[..., DataFrame]] = {}
CORE: list[str] = []
#: An alert's condition and its fields.
Alert = tuple[Column, dict[str, Column]]
#: By rule: what it looks at ("flow", "group" or "met"), and its alerts.
COLUMNS: dict[str, tuple[str, Callable[..., list[Alert]]]] = {}


def rule(name: str, over: str = "flow", core: bool = True) -> Callable:
    """Registers a rule over flows, over groups, or over flows that meet groups; ``core`` ones run by default."""

    def add(f: Callable[..., list[Alert]]) -> Callable[..., DataFrame]:
        COLUMNS[name] = over, f
        RULES[name] = lambda flows, **settings: run(flows, [name], **{name: settings})
        if core:
            CORE.append(name)
        return RULES[name]

    return add


def alert(name: str, where: Column, protocol: str | Column, severity: str | Column, title: Column, subject: Column | None = None, value: Column | None = None, flow: bool | Column = True, said: str | Column | None = None, **facts: str | Column) -> Alert:
    """An alert where a condition holds and the severity isn't null.

    ``facts`` (names of columns, or columns) are what its texts tell; ``said`` names the texts, those of the rule by default.
    """
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None)
    fields = {
        "rule": F.lit(name), "severity": text(severity), "protocol": text(protocol), "title": title, "flow_id": (F.col("flow_id") if flow is True else none if flow is False else flow).cast("string"),
        "subject": (none if subject is None else subject).cast("string"), "value": (none if value is None else value).cast("double"), "said": text(name if said is None else said),
        "facts": F.create_map(*[c for k, v in facts.items() for c in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("string"))]).cast("map<string,string>"),
    }
    return where & text(severity).isNotNull(), fields


def fmt(pattern: str, *columns: str | Column) -> Column:
    return F.format_string(pattern, *columns)


def tenth(x: Column) -> Column:
    """For a title with one decimal."""
    return F.round(x * 10) / 10


def digits(n: int, x: Column | str) -> Column:
    """A number with n decimals, halves away from zero."""
    return F.format_string(f"%.{n}f", (F.round((F.col(x) if isinstance(x, str) else x) * 10**n) / 10**n).cast("double"))


def told(*names: str) -> dict[str, Column]:
    """Facts that are columns of the flow."""
    return {n: F.col(n) for n in names}


def reasons(*given: tuple[Column, Column]) -> Column:
    """What holds of (condition, text), parted by semicolons."""
    return F.array_join(F.array_compact(F.array(*[F.when(where, text) for where, text in given])), "; ")


def percent(part: str | Column, whole: str) -> Column:
    return digits(0, 100 * (F.col(part) if isinstance(part, str) else part) / F.col(whole))


def bands(value: Column, *least: tuple[float, str], strict: bool = True) -> Column:
    """The severity of the highest bound passed, null below the lowest."""
    out = F
    for bound, severity in sorted(least, reverse=True):
        out = out.when(value > bound if strict else value >= bound, severity)
    return out.otherwise(F.lit(None))


def levels(value: str, warning: int, error: int, critical: int | None = None) -> Column:
    return bands(F.col(value), (warning, "warning"), (error, "error"), *([] if critical is None else [(critical, "critical")]), strict=False)


def of(*types: str) -> Column:
    return F.col("type").isin(*types)


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def seconds() -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros("end_time") - micros("start_time")) / 1e6


def detail(name: str) -> Column:
    return F.try_element_at("details", F.lit(name))


def base_domain(name: Column) -> Column:
    """The last two labels; null with fewer."""
    return F.when(name.contains("."), F.substring_index(name, ".", -2))


def usual(ports: dict[str, list[int]]) -> Column:
    return reduce(lambda a, b: a | b, [of(t) & (F.col("src_port").isin(p) | F.col("dst_port").isin(p)) for t, p in ports.items()])


#: Packets above which a stream counts as an answer to one the other way.
HEARD = 10

# Groups.


def _groups(width: str = "second") -> dict[str, tuple[Column, Column, Column | None]]:
    """By kind: which flows count to a group, its key, and their sub, if distinct ones of a group are counted."""
    name, base = F.col("query_name"), base_domain(F.col("query_name"))
    every, pair = F.lit(True), F.concat_ws
    port = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("type", "src_ip", "src_port", "dst_ip", "dst_port")])
    established = (F.col("method") == "INVITE") & ((sip_status(F.col("response")) == 200) | (F.coalesce("response", F.lit("")) == ""))
    return {
        "all": (every, F.lit(""), None), "type": (every, F.col("type"), None), "source": (F.col("src_ip").isNotNull(), F.col("src_ip"), F.col("dst_ip")), "destination": (F.col("dst_ip").isNotNull(), F.col("dst_ip"), None),
        "failure": (F.col("is_error"), pair(":", "type", F.coalesce("error_type", F.lit(""))), None), "sip_method": (of("SIP") & F.col("method").isNotNull(), F.col("method"), None),
        "sip_response": (of("SIP") & F.col("response").isNotNull(), sip_status(F.col("response")), None), "diameter_command": (of("Diameter") & F.col("command").isNotNull(), F.col("command"), None),
        "query": (of("DNS") & name.isNotNull(), name, None), "domain": (of("DNS") & base.isNotNull(), base, F.substring_index(name, ".", 1)), "flux": (of("DNS") & base.isNotNull(), base, F.explode("answers")),
        "second": (F.col("start_time").isNotNull(), F.date_trunc(width, "start_time"), None), "port": (of(*STANDARD_PORTS) & ~usual(STANDARD_PORTS), port, F.col("flow_id")),
        "nas": (of("NAS5G"), F.col("src_ip"), None), "tunnel": (of("GTPU") & F.col("teid").isNotNull(), F.lit(""), F.col("teid")),
        "media": (of("RTP"), pair("|", "dst_ip", "src_ip"), None), "call": (of("SIP") & established, F.col("flow_id"), pair("\x01", "src_ip", "dst_ip")),
    }


#: Kinds of groups whose first and last subs by time are told.
TIMED = ("port", "call", "flux")


def _sums() -> dict[str, Column]:
    """What is summed over the flows of a group, by name; each flow gives a whole number."""
    sip, name = of("SIP"), F.col("query_name")
    one = lambda where: F.when(where, 1).otherwise(0)
    icmp = F.col("flow_id").endswith("-ICMP") | F.col("flow_id").endswith("-ICMPv6")
    storm = of("SBI") & (F.col("nf_type") == "NRF") & (F.col("service_name") == "nnrf-nfm") & F.col("method").isin("PUT", "POST")
    refused = one(F.col("message_type").isin("Authentication Failure", "Authentication Reject"))
    return {
        "packets": F.coalesce("packets", F.lit(0)), "syn": one(F.col("tcp_flags").contains("SYN") & ~F.col("tcp_flags").contains("ACK")), "icmp": one(icmp), "refused": one(sip & (sip_status(F.col("response")) == 401)),
        "registers": one(sip & (F.col("method") == "REGISTER")), "invites": one(sip & (F.col("method") == "INVITE")), "options": one(sip & (F.col("method") == "OPTIONS")),
        "long": one(F.length(name) > 52), "txt": one(F.col("query_type").isin("TXT", "NULL")), "nx": one(F.col("reply_code") == "NXDOMAIN"), "heard": one(F.col("packets") > HEARD),
        "auth": F.coalesce("auth_failures", F.lit(0)) + refused, "establish": one(of("NAS5G") & (F.col("message_type") == "PDU Session Establishment Request")),
        "dropped": one(F.col("apply_action").contains("DROP")), "failed": one(F.col("status_code") >= 500) + F.coalesce("error_count", F.lit(0)), "registrations": one(storm),
    }


#: The kinds of groups that each rule reads; "all" and "second" for the totals.
READS = {
    "volume_spike": ["all"], "packet_flood": ["all", "source"], "syn_flood": ["source"], "icmp_flood": ["source"], "unusual_port": ["port"], "source_fan_out": ["source"], "traffic_concentration": ["all", "source", "destination"],
    "repeated_failures": ["failure"], "register_flood": ["type"], "dns_query_flood": ["query"], "traffic_burst": ["second"], "sip_brute_force": ["source"], "dns_tunneling": ["domain"], "sip_options_scan": ["source"], "sip_invite_flood": ["source"],
    "dns_fast_flux": ["flux"], "nas_auth_failures": ["nas"], "pdu_session_flood": ["type"], "pfcp_drop_rate": ["type"], "sbi_error_rate": ["type"], "gtpu_tunnel_flood": ["tunnel"], "nf_registration_storm": ["type"],
    "one_way_audio": ["media"], "sip_hijack": ["call"], "dns_dga": ["query"],
}


#: The sums that rules over groups read; no others are made for them.
USES = {
    "volume_spike": ["packets"], "packet_flood": ["packets"], "traffic_concentration": ["packets"], "syn_flood": ["syn"], "icmp_flood": ["icmp"], "register_flood": ["registers"], "sip_brute_force": ["refused", "registers"],
    "dns_tunneling": ["long", "txt", "nx"], "sip_options_scan": ["options"], "sip_invite_flood": ["invites"], "nas_auth_failures": ["auth"], "pdu_session_flood": ["establish"], "pfcp_drop_rate": ["dropped"],
    "sbi_error_rate": ["failed"], "nf_registration_storm": ["registrations"], "one_way_audio": ["heard"], "traffic_burst": ["packets"],
}


def _complete(flows: DataFrame) -> DataFrame:
    """``flows`` with nulls for the columns of the flow schema that they haven't, so that rules can name them."""
    have = set(flows.columns)
    return flows.withColumns({n: F.lit(None).cast(t) for n, t in columns(FLOW) if n not in have})


def counted(flows: DataFrame, kinds: list[str] | None = None, width: str = "second", only: dict[str, list[str]] | None = None) -> DataFrame:
    """A row per kind and key of group: n flows, distinct subs, sums, and the first and last sub by time of ``TIMED`` kinds.

    ``only`` names the sums of each kind; the others are null. A kind is counted from the columns it reads, of the flows
    that count to it, and groups are summed in the tasks before they are exchanged, first by (key, sub) where there
    are subs, in whole numbers, then by key. A hot group is one row a task.
    """
    groups, sums, flows = _groups(width), _sums(), _complete(flows)
    none, at = F.lit(None), F.unix_micros(F.col("start_time").cast("timestamp")).alias("at")

    def of_kind(kind: str) -> DataFrame:
        where, key, sub = groups[kind]
        own = {k: c.cast("long").alias(k) for k, c in sums.items() if only is None or k in only.get(kind, [])}
        keyed = [key.cast("string").alias("key"), *([] if sub is None else [sub.cast("string").alias("sub") if kind != "flux" else sub.alias("sub")])]
        each = flows.where(where).select(*keyed, *([at] if kind in TIMED else []), *own.values())
        total = [F.sum(k).alias(k) for k in own]
        n, subs, first, last = F.count("*"), F.lit(0), none, none
        if sub is not None:
            times = [F.min("at").alias("low"), F.max("at").alias("high")] if kind in TIMED else []
            each = each.groupBy("key", "sub").agg(F.count("*").alias("n"), *times, *total)
            n, subs = F.sum("n"), F.count("sub")
            if kind in TIMED:
                there = F.col("sub").isNotNull()
                first, last = F.min_by("sub", F.when(there, F.struct("low", "sub"))), F.max_by("sub", F.when(there, F.struct("high", "sub")))
        found = each.groupBy("key").agg(n.alias("n"), subs.cast("long").alias("subs"), *total, first.cast("string").alias("first_sub"), last.cast("string").alias("last_sub"))
        return found.select(F.lit(kind).alias("kind"), "key", "n", "subs", *[F.col(k) if k in own else none.cast("long").alias(k) for k in sums], "first_sub", "last_sub")

    return reduce(DataFrame.unionByName, map(of_kind, kinds or groups))


def _totals(groups: DataFrame) -> DataFrame:
    """One row: flows and packets of all (rules that read them use packets), seconds with flows and their flows."""
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    of_seconds = F.when(F.col("kind") == "second", F.col("n"))
    return groups.agg(F.coalesce(pick("all", "n"), F.lit(0)).alias("all_n"), F.coalesce(pick("all", "packets"), F.lit(0)).alias("all_packets"), F.avg(of_seconds).alias("mean_second"), F.coalesce(F.sum(of_seconds), F.lit(0)).alias("all_seconds"))


def figures_by_key(flows: DataFrame) -> DataFrame:
    """(kind, key, n, packets): flows and packets by type, SIP method, SIP status, Diameter command and failure."""
    kinds = ["type", "sip_method", "sip_response", "diameter_command", "failure"]
    read = stored(_complete(flows).select("type", "method", "response", "command", "is_error", "error_type", "packets"))
    return counted(read, kinds, only=dict.fromkeys(kinds, ["packets"])).select("kind", "key", "n", "packets")


def run(flows: DataFrame, names: list[str] | None = None, texts: bool = True, **settings: dict) -> DataFrame:
    """The alerts of all core rules, or of the named ones; ``settings`` by rule. Without ``texts`` descriptions and metadata aren't made."""
    names = list(names or CORE)
    made = {over: [a for n in names if COLUMNS[n][0] == over for a in COLUMNS[n][1](**settings.get(n, {}))] for over in ("flow", "group", "met")}

    def shown(df: DataFrame, alerts: list[Alert]) -> DataFrame:
        # The array is a column before it is exploded: within explode or array_compact it isn't compiled, and its type is made anew for each row.
        each = [F.when(where, F.struct(*[c.alias(k) for k, c in fields.items() if texts or k not in ("said", "facts")])) for where, fields in alerts]
        return df.select(F.array(*each).alias("alerts")).select(F.explode("alerts").alias("a")).where("a is not null").select("a.*")

    kinds = sorted({k for n in names for k in READS.get(n, [])})
    only = {k: sorted({s for n in names if k in READS.get(n, []) for s in USES.get(n, [])}) for k in kinds}
    if len(names) > 1:
        flows = stored(flows)
    elif "port" in kinds:  # its condition names columns so often that what they are made of would be too long to compile
        flows = stored(_complete(flows).select("flow_id", "type", "src_ip", "src_port", "dst_ip", "dst_port", "start_time"))
    flows = _complete(flows)
    out = []
    groups = counted(flows, kinds, settings.get("traffic_burst", {}).get("width", "second"), only) if kinds else None
    if len(names) > 1 and groups is not None:
        groups = stored(groups)
    totals = F.broadcast(_totals(groups)) if groups is not None and any(k in kinds for k in ("all", "second")) else None  # one row
    if made["flow"]:
        out.append(shown(flows.crossJoin(totals) if totals is not None and "volume_spike" in names else flows, made["flow"]))
    if made["group"]:
        out.append(shown(groups.crossJoin(totals) if totals is not None else groups, made["group"]))
    if made["met"]:
        kind = F.when(of("DNS") & F.lit("dns_dga" in names), "query").when(of("RTP") & F.lit("one_way_audio" in names), "media").when(of("SIP") & F.col("method").isin("BYE", "CANCEL") & F.lit("sip_hijack" in names), "call")
        key = F.when(of("DNS"), F.col("query_name")).when(of("RTP"), F.concat_ws("|", "src_ip", "dst_ip")).otherwise(F.col("flow_id"))
        own = flows.withColumns({"kind": kind, "key": key}).where("kind is not null")
        sides = groups.where(F.col("kind").isin("query", "media", "call")).select("kind", "key", F.col("n").alias("group_n"), F.col("heard").alias("group_heard"), F.col("last_sub").alias("group_sub"))
        if "dns_dga" in names:  # dear, so made once a name
            sides = sides.withColumn("entropy", F.when((F.col("kind") == "query") & (F.length("key") >= 8), entropy(F.substring_index("key", ".", 1))))
        out.append(shown(own.join(sides, ["kind", "key"], "left"), made["met"]))
    found = reduce(DataFrame.unionByName, out)
    if not texts:
        return found
    return with_texts(found).select("rule", "severity", "protocol", "title", "description", "flow_id", "subject", "value", "metadata")


# Rules over flows.


@rule("sip_errors")
def sip_errors() -> list[Alert]:
    code = sip_status(F.col("response"))
    return [alert("sip_errors", of("SIP") & code.between(400, 699), "SIP", F.when(code >= 500, "error").otherwise("warning"), fmt("SIP Error: %s", "response"), F.col("src_ip"), code, response="response")]


@rule("rtp_loss")
def rtp_loss(warning: float = 5, error: float = 15) -> list[Alert]:
    loss = F.when(F.col("packets") > 0, 100.0 * F.col("max_seq_gap") / F.col("packets"))
    return [alert("rtp_loss", of("RTP"), "RTP", bands(loss, (warning, "warning"), (error, "error")), fmt("High Packet Loss (%.1f%%)", tenth(loss)), F.col("src_ip"), loss, loss=digits(1, loss), gap="max_seq_gap", packets="packets")]


@rule("rtp_jitter")
def rtp_jitter(warning: float = 30, error: float = 100) -> list[Alert]:
    v = F.col("jitter_ms")
    return [alert("rtp_jitter", of("RTP"), "RTP", bands(v, (warning, "warning"), (error, "error")), fmt("High Jitter (%.1fms)", tenth(v)), F.col("src_ip"), v, jitter=digits(1, v))]


@rule("dns_errors")
def dns_errors() -> list[Alert]:
    severity = F.when(F.col("error_type") == "SERVFAIL", "error").otherwise("warning")
    return [alert("dns_errors", of("DNS") & F.col("is_error"), "DNS", severity, fmt("DNS %s: %s", "error_type", "query_name"), F.col("query_name"), error="error_type")]


def failing(name: str, type_: str, what: str, code: str, label: str) -> list[Alert]:
    return [alert(name, of(type_) & F.col("is_error"), type_, "error", fmt(f"{type_} %s Failed ({label}=%d)", what, code), F.col("src_ip"), what=what, code=code)]


@rule("diameter_failures")
def diameter_failures() -> list[Alert]:
    return failing("diameter_failures", "Diameter", "command", "result_code", "RC")


@rule("gtp_failures")
def gtp_failures() -> list[Alert]:
    return failing("gtp_failures", "GTP", "message_type", "cause_code", "Cause")


@rule("pfcp_failures")
def pfcp_failures() -> list[Alert]:
    return failing("pfcp_failures", "PFCP", "message_type", "cause_code", "Cause")


@rule("volume_spike")
def volume_spike(least: int = 500, times: float = 10) -> list[Alert]:
    mean = F.col("all_packets") / F.col("all_n")
    where = (F.col("packets") >= least) & (mean > 0) & (F.col("packets") > mean * times)
    return [alert("volume_spike", where, F.col("type"), "warning", fmt("Packet Volume Spike (%d pkts)", "packets"), F.col("src_ip"), F.col("packets"), packets="packets", mean=digits(0, mean), times=F.lit(f"{times:g}"))]


@rule("oversized_packets")
def oversized_packets(limits: dict[str, int] = LARGEST_PACKET) -> list[Alert]:
    size = F.col("max_packet_size")
    return [alert("oversized_packets", size > lookup(limits, F.col("type")), F.col("type"), "warning", fmt("Oversized %s Packet (%d bytes)", "type", size), F.col("src_ip"), size, size=size, limit=lookup(limits, F.col("type")))]


@rule("protocol_mismatch")
def protocol_mismatch(ports: dict[str, list[int]] = STANDARD_PORTS) -> list[Alert]:
    """Each side whose port belongs to another type."""
    owner = {p: t for t, ps in ports.items() for p in ps}
    side = lambda c: alert("protocol_mismatch", lookup(owner, F.col(c)) != F.col("type"), F.col("type"), "error", fmt("Protocol Mismatch (port %d)", c), F.col("src_ip"), F.col(c), port=c, expected=lookup(owner, F.col(c)))
    return [side("src_port"), side("dst_port")]


@rule("long_duration")
def long_duration(limits: dict[str, int] = LONGEST_SECONDS) -> list[Alert]:
    v = seconds()
    return [alert("long_duration", v > lookup(limits, F.col("type")), F.col("type"), "warning", fmt("Long Duration %s Flow (%.0fs)", "type", F.round(v)), F.col("src_ip"), v, seconds=digits(0, v), limit=lookup(limits, F.col("type")))]


@rule("jitter_variance")
def jitter_variance(warning: float = 50, error: float = 200) -> list[Alert]:
    v = F.col("jitter_max_ms") - F.col("jitter_min_ms")
    where = of("RTP") & (F.col("jitter_avg_ms") > 0) & (v > F.col("jitter_avg_ms") * 3)
    return [alert("jitter_variance", where, "RTP", bands(v, (warning, "warning"), (error, "error")), fmt("High Jitter Variance (%.1fms spread)", tenth(v)), F.col("src_ip"), v, spread=digits(1, v), **{k: digits(1, f"jitter_{k}_ms") for k in ("min", "max", "avg")})]


@rule("dns_slow")
def dns_slow(warning: float = 500, error: float = 2000) -> list[Alert]:
    v = F.col("latency_ms")
    return [alert("dns_slow", of("DNS"), "DNS", bands(v, (warning, "warning"), (error, "error")), fmt("Slow DNS Response (%.0fms)", F.round(v)), F.col("query_name"), v, latency=digits(0, v))]


@rule("sip_slow_setup")
def sip_slow_setup(warning: float = 3000, error: float = 10000) -> list[Alert]:
    v = F.col("setup_latency_ms")
    return [alert("sip_slow_setup", of("SIP"), "SIP", bands(v, (warning, "warning"), (error, "error")), fmt("Slow SIP Setup (%.1fs)", tenth(v / 1000)), F.col("src_ip"), v, seconds=digits(1, v / 1000))]


@rule("qos_degradation")
def qos_degradation(warning: float = 3.6, error: float = 2.6) -> list[Alert]:
    loss = 100.0 * F.col("max_seq_gap") / F.when(F.col("packets") > 0, F.col("packets"))
    r = clamp(94.2 - 2.5 * loss - 0.1 * F.col("jitter_ms"), 0, 100)
    v = clamp(mos_of_r(r), 1, 4.5)
    where = of("RTP") & (F.col("packets") > 0) & (v < warning)
    return [alert("qos_degradation", where, "RTP", F.when(v < error, "error").otherwise("warning"), fmt("QoS Degradation (est. MOS %.1f)", tenth(v)), F.col("src_ip"), v, mos=digits(2, v), loss=digits(1, loss), jitter=digits(1, "jitter_ms"))]


@rule("call_drop")
def call_drop(short: float = 30) -> list[Alert]:
    v, code = seconds(), sip_status(F.col("response"))
    reason = lookup(DROP_REASONS, code)
    ended = of("SIP") & F.col("end_type").isin("BYE", "CANCEL") & (v > 0) & (v < short)
    return [
        alert("call_drop", ended, "SIP", "warning", fmt("VoIP Call Drop (%.1fs)", tenth(v)), F.col("src_ip"), v, end_type="end_type", seconds=digits(1, v), millis=F.floor(v * 1000)),
        alert("call_drop", of("SIP") & reason.isNotNull(), "SIP", "warning", fmt("VoIP Call Drop: %s (%d)", reason, code), F.col("src_ip"), code, said="call_refused", response="response", reason=reason),
    ]


@rule("tls_downgrade")
def tls_downgrade() -> list[Alert]:
    version = F.replace(F.replace(F.col("tls_version"), F.lit("SSL 3.0"), F.lit("SSLv3")), F.lit("TLS 1."), F.lit("TLSv1."))
    why = lookup(WEAK_TLS, version)
    severity = F.when(version == "SSLv3", "critical").when(version == "TLSv1.0", "error").otherwise("warning")
    return [alert("tls_downgrade", of("TLS") & why.isNotNull(), "TLS", severity, fmt("TLS Downgrade: %s (%s)", version, why), F.col("sni"), version=version, attack=why, **told("src_ip", "src_port", "dst_ip", "dst_port"))]


@rule("tls_weak_cipher")
def tls_weak_cipher() -> list[Alert]:
    upper = F.upper("cipher_suite")
    found = F.filter(F.array(*[F.lit(x) for x in BROKEN_CIPHERS]), lambda x: F.contains(upper, x))
    broken = F.size(found)
    where = of("TLS") & (F.col("cipher_suite") != "") & ((broken > 0) | ~upper.contains("DHE"))
    title = F.when(broken > 0, fmt("Broken Cipher: %s", "cipher_suite")).otherwise(fmt("No Forward Secrecy: %s", "cipher_suite"))
    return [alert("tls_weak_cipher", where, "TLS", F.when(broken > 0, "critical").otherwise("warning"), title, F.col("sni"), broken, said=F.when(broken > 0, "broken_cipher").otherwise("tls_weak_cipher"), cipher="cipher_suite", broken=F.array_join(found, ", "), forward=upper.contains("DHE"), **told("src_ip", "src_port", "dst_ip", "dst_port"))]


@rule("tls_ja3")
def tls_ja3(malicious: dict[str, str] = MALICIOUS_JA3) -> list[Alert]:
    name = lookup(malicious, F.col("ja3_hash"))
    return [alert("tls_ja3", of("TLS") & name.isNotNull(), "TLS", "critical", fmt("Malicious JA3: %s (%s)", F.substring("ja3_hash", 1, 8), name), F.col("ja3_hash"), malware=name, sni="sni", ja3_string=detail("ja3_string"), **told("src_ip", "dst_ip"))]


@rule("tls_self_signed")
def tls_self_signed() -> list[Alert]:
    where = of("TLS") & F.col("cert_self_signed") & ~F.coalesce(F.col("sni").rlike(r"\.(local|internal|lan)$"), F.lit(False))
    return [alert("tls_self_signed", where, "TLS", F.when(F.col("dst_port").isin(443, 8443), "error").otherwise("warning"), fmt("Self-Signed Cert: %s (%s)", "sni", "dst_ip"), F.col("sni"), cert_subject=detail("cert_subject"), cert_issuer=detail("cert_issuer"), **told("dst_ip", "dst_port"))]


@rule("suspicious_rst")
def suspicious_rst() -> list[Alert]:
    return [alert("suspicious_rst", F.col("rst_authenticity") == "suspicious", "TCP", "warning", fmt("Suspicious RST: %s:%d -> %s:%d", "src_ip", "src_port", "dst_ip", "dst_port"), F.col("src_ip"), reason=detail("rst_reason"), ttl=detail("rst_ttl"), baseline=detail("rst_ttl_baseline"), delta=detail("rst_delta"), **told("src_ip", "src_port", "dst_ip", "dst_port"))]


# Rules over groups.


def grouped(name: str, kind: str, protocol: str, severity: str | Column, title: Column, n: str | Column = "n", subject: bool = True, where: Column | None = None, **facts: str | Column) -> list[Alert]:
    """Alerts of groups of a kind; n of their texts is what was measured."""
    own = F.col("kind") == kind if where is None else (F.col("kind") == kind) & where
    return [alert(name, own, protocol, severity, title, F.col("key") if subject else None, F.col(n) if isinstance(n, str) else n, False, **{"n": n, **facts})]


@rule("packet_flood", "group")
def packet_flood(least: int = 1000, share: float = 0.8) -> list[Alert]:
    where = (F.col("all_packets") >= least) & (F.col("packets") >= least) & (F.col("packets") > F.col("all_packets") * share)
    return grouped("packet_flood", "source", "*", "error", fmt("Packet Flood from %s", "key"), "packets", where=where, packets="packets", total="all_packets", share=percent("packets", "all_packets"))


@rule("syn_flood", "group")
def syn_flood(warning: int = 20, error: int = 50, critical: int = 100) -> list[Alert]:
    return grouped("syn_flood", "source", "TCP", levels("syn", warning, error, critical), fmt("TCP SYN Flood: %s (%d half-open connections)", "key", "syn"), "syn")


@rule("icmp_flood", "group")
def icmp_flood(warning: int = 50, error: int = 200, critical: int = 500) -> list[Alert]:
    return grouped("icmp_flood", "source", "ICMP", levels("icmp", warning, error, critical), fmt("ICMP Flood: %s (%d ICMP flows)", "key", "icmp"), "icmp")


@rule("unusual_port", "group")
def unusual_port() -> list[Alert]:
    """One alert for each type and pair of endpoints, with the number of flows and the first one's id."""
    part = lambda i: F.split("key", r"\|")[i]
    title = fmt("Unusual %s Port (%s -> %s)", part(0), part(2), part(4))
    return [alert("unusual_port", F.col("kind") == "port", part(0), "warning", title, F.when(part(1) != "null", part(1)), F.col("n"), F.col("first_sub"),
                  n="n", src_port=part(2), dst_ip=part(3), dst_port=part(4), seen=F.when(F.col("n") > 1, fmt(" — seen across %d messages/flows in this capture", "n")),
                  ports=lookup({k: " ".join(map(str, v)) for k, v in STANDARD_PORTS.items()}, part(0)))]


@rule("source_fan_out", "group")
def source_fan_out(warning: int = 20, error: int = 50) -> list[Alert]:
    return grouped("source_fan_out", "source", "*", levels("subs", warning, error), fmt("Source Fan-Out: %s (%d destinations)", "key", "subs"), "subs")


@rule("traffic_concentration", "group")
def traffic_concentration(least: int = 10, share: float = 0.5) -> list[Alert]:
    where = (F.col("all_n") >= least) & (F.col("n") > F.col("all_n") * share)
    return [c for side in ("source", "destination") for c in grouped("traffic_concentration", side, "*", "warning", fmt(f"Traffic Concentration: %s ({side})", "key"), where=where, side=F.lit(side.capitalize()), total="all_n", share=percent("n", "all_n"))]


@rule("repeated_failures", "group")
def repeated_failures(warning: int = 5, error: int = 20) -> list[Alert]:
    return grouped("repeated_failures", "failure", F.split("key", ":")[0], levels("n", warning, error), fmt("Repeated Failures: %s (%d times)", "key", "n"))


@rule("register_flood", "group")
def register_flood(warning: int = 20, error: int = 50) -> list[Alert]:
    return grouped("register_flood", "type", "SIP", levels("registers", warning, error), fmt("SIP REGISTER Flood (%d requests)", "registers"), "registers", False, F.col("key") == "SIP")


@rule("dns_query_flood", "group")
def dns_query_flood(warning: int = 20, error: int = 50) -> list[Alert]:
    return grouped("dns_query_flood", "query", "DNS", levels("n", warning, error), fmt("DNS Query Flood: %s (%d queries)", "key", "n"))


@rule("traffic_burst", "group")
def traffic_burst(least: int = 10, times: float = 5, width: str = "second") -> list[Alert]:
    """Seconds, or what else ``width`` names, with far more new flows than the mean of those that have any."""
    return grouped("traffic_burst", "second", "*", "warning", fmt("Traffic Burst (%d flows/sec)", "n"), where=(F.col("all_seconds") >= least) & (F.col("n") > F.col("mean_second") * times), at=F.concat(F.replace("key", F.lit(" "), F.lit("T")), F.lit("Z")), mean=digits(1, "mean_second"), times=F.lit(f"{times:g}"))


@rule("sip_brute_force", "group")
def sip_brute_force(warning: int = 5, error: int = 10, critical: int = 20) -> list[Alert]:
    return grouped("sip_brute_force", "source", "SIP", levels("refused", warning, error, critical), fmt("SIP Brute Force: %s (%d × 401)", "key", "refused"), "refused", registers="registers")


@rule("dns_tunneling", "group")
def dns_tunneling(least: int = 5) -> list[Alert]:
    part = lambda c, x: F.when(c, x).otherwise(0)
    score = part(F.col("long") > 3, 3) + part(F.col("txt") > 2, 2) + part((F.col("subs") / F.col("n") > 0.8) & (F.col("n") >= 10), 3) + part(F.col("nx") > 5, 2)
    severity = bands(score, (3, "warning"), (4, "error"), (6, "critical"), strict=False)
    why = reasons((F.col("long") > 3, fmt("%d long subdomains (>52 chars)", "long")), (F.col("txt") > 2, fmt("%d TXT/NULL queries", "txt")), ((F.col("subs") / F.col("n") > 0.8) & (F.col("n") >= 10), F.concat(percent("subs", "n"), F.lit("% unique subdomains (high entropy)"))), (F.col("nx") > 5, fmt("%d NXDOMAIN responses", "nx")))
    return grouped("dns_tunneling", "domain", "DNS", severity, fmt("DNS Tunneling: %s (score=%d)", "key", score), score, where=F.col("n") >= least, total="n", long="long", txt="txt", nx="nx", subs="subs", score=score, reasons=why)


@rule("sip_options_scan", "group")
def sip_options_scan(least: int = 10, destinations: int = 5, error: int = 50, error_destinations: int = 20) -> list[Alert]:
    severity = F.when((F.col("options") >= error) | (F.col("subs") >= error_destinations), "error").otherwise("warning")
    where = (F.col("options") > 0) & (F.col("options") >= least) & (F.col("subs") >= destinations)
    return grouped("sip_options_scan", "source", "SIP", severity, fmt("SIP Endpoint Scanning: %s (%d OPTIONS)", "key", "options"), "options", where=where, subs="subs")


@rule("sip_invite_flood", "group")
def sip_invite_flood(least: int = 15, destinations: int = 10, error: int = 50) -> list[Alert]:
    many = F.col("subs") >= destinations
    severity = F.when(many, "critical").when(F.col("invites") >= error, "error").otherwise("warning")
    more = F.when(many, " — suspected toll fraud (mass outbound calling)").when(F.col("invites") >= error, " — possible SIP DoS / call flood")
    return grouped("sip_invite_flood", "source", "SIP", severity, fmt("SIP INVITE Flood: %s (%d INVITEs)", "key", "invites"), "invites", where=(F.col("invites") > 0) & (F.col("invites") >= least), subs="subs", attack=F.when(many, "toll_fraud").otherwise("sip_invite_flood"), suspicion=more)


@rule("dns_fast_flux", "group")
def dns_fast_flux(warning: int = 5, error: int = 8, critical: int = 15) -> list[Alert]:
    """The sample in the texts is the first and the last address by time."""
    return grouped("dns_fast_flux", "flux", "DNS", levels("subs", warning, error, critical), fmt("DNS Fast-Flux: %s (%d IPs)", "key", "subs"), "subs", sample=F.array_join(F.array_distinct(F.array("first_sub", "last_sub")), ", "))


@rule("nas_auth_failures", "group", core=False)
def nas_auth_failures(most: int = 10) -> list[Alert]:
    return grouped("nas_auth_failures", "nas", "NAS5G", "critical", F.lit("NAS Authentication Failure Storm"), "auth", where=F.col("auth") > most, threshold=F.lit(most))


@rule("pdu_session_flood", "group", core=False)
def pdu_session_flood(most: int = 100) -> list[Alert]:
    where = (F.col("key") == "NAS5G") & (F.col("establish") > most)
    return grouped("pdu_session_flood", "type", "NAS5G", "warning", F.lit("PDU Session Establishment Flood"), "establish", False, where, threshold=F.lit(most))


@rule("pfcp_drop_rate", "group", core=False)
def pfcp_drop_rate() -> list[Alert]:
    where = (F.col("key") == "PFCP") & (F.col("dropped") * 2 > F.col("n"))
    return grouped("pfcp_drop_rate", "type", "PFCP", "warning", F.lit("PFCP High DROP Action Rate"), F.floor(F.col("dropped") * 100 / F.col("n")), False, where, dropped="dropped", total="n", share=F.floor(F.col("dropped") * 100 / F.col("n")))


@rule("sbi_error_rate", "group", core=False)
def sbi_error_rate() -> list[Alert]:
    where = (F.col("key") == "SBI") & (F.col("failed") * 5 > F.col("n"))
    return grouped("sbi_error_rate", "type", "SBI", "error", F.lit("SBI High 5xx Error Rate"), "failed", False, where, total="n", share=F.floor(F.col("failed") * 100 / F.col("n")))


@rule("gtpu_tunnel_flood", "group", core=False)
def gtpu_tunnel_flood(most: int = 10_000) -> list[Alert]:
    return grouped("gtpu_tunnel_flood", "tunnel", "GTPU", "warning", F.lit("GTP-U Tunnel Flood"), "subs", False, F.col("subs") > most, threshold=F.lit(most))


@rule("nf_registration_storm", "group", core=False)
def nf_registration_storm(most: int = 50) -> list[Alert]:
    where = (F.col("key") == "SBI") & (F.col("registrations") > most)
    return grouped("nf_registration_storm", "type", "SBI", "warning", F.lit("NF Registration Storm"), "registrations", False, where, threshold=F.lit(most))


# Rules over flows that meet a group.


@rule("one_way_audio", "met")
def one_way_audio(least: int = 50) -> list[Alert]:
    """Streams without another one of more than 10 packets the other way; between equal addresses that is any other."""
    own = F.when((F.col("src_ip") == F.col("dst_ip")) & (F.col("packets") > HEARD), 1).otherwise(0)
    where = (F.col("kind") == "media") & (F.col("packets") > least) & (F.coalesce("group_heard", F.lit(0)) <= own)
    return [alert("one_way_audio", where, "RTP", "warning", F.lit("Possible One-Way Audio"), F.col("src_ip"), F.col("packets"), dst_ip="dst_ip", packets="packets")]


@rule("sip_hijack", "met")
def sip_hijack() -> list[Alert]:
    """An end of call from neither party of the last established INVITE of the same id."""
    party = lambda i: F.split("group_sub", "\x01")[i]
    where = (F.col("kind") == "call") & (F.col("src_ip") != party(0)) & (F.col("src_ip") != party(1))
    return [alert("sip_hijack", where, "SIP", "critical", fmt("SIP Call Hijack: %s from unexpected IP %s", "method", "src_ip"), F.col("src_ip"), method="method", src=party(0), dst=party(1))]


@rule("dns_dga", "met")
def dns_dga() -> list[Alert]:
    name = F.col("query_name")
    label = F.substring_index(name, ".", 1)
    part = lambda c, x: F.when(c, x).otherwise(0)
    score = part(F.col("entropy") >= 3.5, 3) + part(F.lower(F.substring_index(name, ".", -1)).isin(SUSPICIOUS_TLDS), 2) + part(F.length(label) >= 16, 1) + part(F.col("group_n") <= 2, 1)
    where = (F.col("kind") == "query") & (F.length(name) >= 8) & name.contains(".")
    tld = F.substring_index(name, ".", -1)
    why = reasons((F.col("entropy") >= 3.5, F.concat(F.lit("high entropy label ("), digits(2, "entropy"), F.lit(" bits)"))), (F.lower(tld).isin(SUSPICIOUS_TLDS), fmt("suspicious TLD (.%s)", tld)), (F.length(label) >= 16, fmt("long label (%d chars)", F.length(label))), (F.col("group_n") <= 2, F.lit("queried only once (DGA pattern)")))
    return [alert("dns_dga", where, "DNS", bands(score, (3, "warning"), (4, "error"), (5, "critical"), strict=False), fmt("Suspected DGA/C2 Domain: %s", name), name, score, score=score, reasons=why, label=label, tld=tld, entropy="entropy", n="group_n")]


def dispatch(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Alerts by target (name, min_severity): each that is as severe; unknown severities and ``error`` count as info."""
    rank = lambda c: F.when(F.col(c) == "critical", 3).when(F.col(c) == "warning", 2).otherwise(1)
    levels = F.broadcast(targets.select(F.col("name").alias("target"), F.explode(F.sequence(rank("min_severity"), F.lit(3))).alias("level")))  # targets are configuration
    return found.withColumn("level", rank("severity")).join(levels, "level").drop("level")
