"""Flows from packets: volumes, trends, timing, losses, resets; RTP streams.

Packets need job_id, frame_number, timestamp, src_ip, dst_ip, src_port, dst_port, protocol, payload_len, and for TCP
seq, ack, flags, ttl and ip_id. Sums and extremes combine in the tasks before the shuffle, so a flow of any
size is one row per task. What needs order (retransmissions, round trips) runs in windows that spill, over
the packets that matter only. Flags: FIN 1, SYN 2, RST 4, PSH 8, ACK 16, URG 32.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import rounded, tcp_score, verdict

KEY = ["job_id", "protocol", "ip_a", "port_a", "ip_b", "port_b"]
WRAP = 1 << 32


def with_job(packets: DataFrame) -> DataFrame:
    """``packets``, of job 0 where they are of none."""
    return packets if "job_id" in packets.columns else packets.withColumn("job_id", F.lit(0).cast("long"))


def canonical(packets: DataFrame) -> DataFrame:
    """Adds both ends in order of address, as text, then port, and whether the packet runs from the second to the first."""
    icmp = F.col("protocol").isin("ICMP", "ICMPv6")
    swap = F.when(icmp, F.col("src_ip") > F.col("dst_ip")).otherwise((F.col("src_ip") > F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") > F.col("dst_port"))))
    port = lambda p: F.when(icmp, 0).otherwise(p)
    pick = lambda a, b: F.when(swap, a).otherwise(b)
    return with_job(packets).withColumns({"ip_a": pick(F.col("dst_ip"), F.col("src_ip")), "port_a": port(pick(F.col("dst_port"), F.col("src_port"))), "ip_b": pick(F.col("src_ip"), F.col("dst_ip")), "port_b": port(pick(F.col("src_port"), F.col("dst_port"))), "reversed": swap})


def flow_id() -> Column:
    return F.format_string("flow-%s:%d-%s:%d-%s", "ip_a", "port_a", "ip_b", "port_b", "protocol")


def has(bit: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(bit)) != 0


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def flag_names(flags: Column) -> Column:
    names = [(2, "SYN"), (16, "ACK"), (8, "PSH"), (1, "FIN"), (4, "RST"), (32, "URG")]
    out = F.concat_ws(" ", *[F.when(flags.bitwiseAND(F.lit(b)) != 0, n) for b, n in names])
    return F.when(out == "", "none").otherwise(out)


def volumes(packets: DataFrame) -> DataFrame:
    """A row per flow: packets and payload bytes either way, first and last time, flags, how it closed, rates."""
    n = lambda c, x=1: F.sum(F.when(c, x).otherwise(0))
    rev = F.col("reversed")
    flags = F.when(F.col("protocol") == "TCP", F.col("flags")).otherwise(0)
    each = canonical(packets).groupBy(*KEY).agg(
        n(~rev).alias("fwd_packets"), n(rev).alias("rev_packets"), n(~rev, F.col("payload_len")).alias("fwd_bytes"), n(rev, F.col("payload_len")).alias("rev_bytes"),
        F.min_by("timestamp", "frame_number").alias("start_time"), F.max("timestamp").alias("end_time"), F.bit_or(flags.cast("int")).alias("flags"),
    )
    return described(each)


def described(each: DataFrame) -> DataFrame:
    """Flows from their sums (packets and bytes either way, start_time, end_time, flags): id, names of flags, how it closed, rates."""
    seconds = (micros("end_time") - micros("start_time")) / 1e6
    rate = lambda b: F.when(seconds > 0, F.round(b * 8 / seconds)).otherwise(0.0)
    close = F.when(F.col("protocol") != "TCP", None).when(has(4), "RST").when(has(1), "FIN").otherwise("timeout")
    return each.select(
        flow_id().alias("flow_id"), *KEY, "fwd_packets", "rev_packets", "fwd_bytes", "rev_bytes", "start_time", "end_time", F.when(F.col("protocol") == "TCP", flag_names(F.col("flags"))).alias("tcp_flags"), close.alias("close_reason"),
        rate(F.col("fwd_bytes") + F.col("rev_bytes")).alias("throughput_bps"), rate(F.col("fwd_bytes")).alias("fwd_bps"), rate(F.col("rev_bytes")).alias("rev_bps"),
        *[c for c in each.columns if c not in (*KEY, "fwd_packets", "rev_packets", "fwd_bytes", "rev_bytes", "start_time", "end_time", "flags")],
    )


def trend(packets: DataFrame, points: int = 60, seconds: int = 3600) -> DataFrame:
    """(flow key, trend): bits per second in at most ``points`` equal steps from the first packet with payload."""
    own = canonical(packets).where("payload_len > 0")
    start = own.groupBy(*KEY).agg(F.min(micros("timestamp")).alias("t0"))
    return _steps(own.join(start, KEY).withColumn("s", F.floor((micros("timestamp") - F.col("t0")) / 1_000_000).cast("long")), points, seconds)


def _steps(timed: DataFrame, points: int = 60, seconds: int = 3600) -> DataFrame:
    """(flow key, trend) of packets with payload and ``s``, the seconds since the flow's first."""
    buckets = timed.where(F.col("s") < seconds).groupBy(*KEY, "s").agg(F.sum("payload_len").alias("bytes"))
    sized = buckets.withColumn("n", F.max("s").over(Window.partitionBy(*KEY)) + 1)
    sized = sized.withColumn("step", F.greatest(F.lit(1), F.ceil(F.col("n") / points)).cast("long")).withColumn("i", F.expr("s div step"))
    steps = sized.groupBy(*KEY, "i").agg(F.sum("bytes").alias("bytes"), F.max("n").alias("n"), F.max("step").alias("step"))
    value = F.struct("i", F.round(F.col("bytes") * 8 / F.col("step")).alias("bps"))
    found = steps.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(value)).alias("by"), F.max(F.ceil(F.col("n") / F.col("step"))).cast("int").alias("count"))  # at most ``points`` entries
    dense = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.coalesce(F.try_element_at("by", i.cast("long")), F.lit(0.0)))
    return found.select(*KEY, dense.alias("trend"))


def handshakes(packets: DataFrame) -> DataFrame:
    """(flow key, handshake_ms): from the first SYN of the first end to the first SYN+ACK back after it, doubled."""
    syn = canonical(packets).where((F.col("protocol") == "TCP") & has(2))
    order = Window.partitionBy(*KEY).orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(~F.col("reversed") & ~has(16), F.col("timestamp"))).over(order)
    both = syn.withColumn("syn", first).where(F.col("reversed") & has(16) & F.col("syn").isNotNull()).groupBy(*KEY).agg(F.min_by(F.struct("timestamp", "syn"), "frame_number").alias("m"))
    return both.select(*KEY, rounded((micros(F.col("m.timestamp")) - micros(F.col("m.syn"))) / 1000 * 2).alias("handshake_ms"))


def unwrapped(value: Column, first: Column) -> Column:
    """Distance of a 32-bit number from the first one, signed: numbers that wrap stay in order."""
    d = F.pmod(value - first, F.lit(WRAP))
    return F.when(d >= WRAP // 2, d - WRAP).otherwise(d)


def data_segments(packets: DataFrame) -> DataFrame:
    """TCP packets with payload, numbered from their direction's first."""
    own = canonical(packets).where("protocol = 'TCP' and payload_len > 0")
    first = own.groupBy(*KEY, "reversed").agg(F.min_by("seq", "frame_number").alias("first_seq"))
    return own.join(first, [*KEY, "reversed"]).withColumn("pos", unwrapped(F.col("seq"), F.col("first_seq")))


def retransmissions(packets: DataFrame) -> DataFrame:
    """(flow key, retransmissions, loss_pct): segments that start before the end of what was sent before them."""
    own = data_segments(packets)
    before = Window.partitionBy(*KEY, "reversed").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, -1)
    again = own.withColumn("again", F.col("pos") < F.max(F.col("pos") + F.col("payload_len")).over(before)).groupBy(*KEY).agg(F.sum(F.when(F.col("again"), 1).otherwise(0)).alias("retransmissions"))
    total = canonical(packets).where("protocol = 'TCP'").groupBy(*KEY).agg(F.count("*").alias("packets"))
    n = F.coalesce("retransmissions", F.lit(0))
    return total.join(again, KEY, "left").select(*KEY, n.alias("retransmissions"), rounded(100.0 * n / F.col("packets")).alias("loss_pct"))


def round_trips(packets: DataFrame) -> DataFrame:
    """(flow key, samples, data_rtt_ms): from pushed data to the first acknowledgement that covers it.

    Acknowledgements that raise the highest so far come in order of time and number alike, so the first to
    cover a byte is the next one in order of number: one window over data and such acknowledgements, no
    pairs. Data sent after it was covered (a retransmission) gives no sample.
    """
    own = canonical(packets).where("protocol = 'TCP'")
    first = own.where("payload_len > 0").groupBy(*KEY, "reversed").agg(F.min_by("seq", "frame_number").alias("first_seq"))
    data = own.where((F.col("payload_len") > 0) & has(8)).join(first, [*KEY, "reversed"]).select(*KEY, F.col("reversed").alias("way"), (unwrapped(F.col("seq"), F.col("first_seq")) + F.col("payload_len")).alias("pos"), F.lit(1).alias("kind"), "timestamp")
    acks = own.where(has(16)).select(*KEY, (~F.col("reversed")).alias("reversed"), "frame_number", "timestamp", "ack").join(first, [*KEY, "reversed"]).withColumn("pos", unwrapped(F.col("ack"), F.col("first_seq")))
    highest = F.max("pos").over(Window.partitionBy(*KEY, "reversed").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, -1))
    raising = acks.withColumn("highest", highest).where("highest is null or pos > highest").select(*KEY, F.col("reversed").alias("way"), "pos", F.lit(0).alias("kind"), "timestamp")
    down = Window.partitionBy(*KEY, "way").orderBy(F.desc("pos"), F.asc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    met = data.unionByName(raising).withColumn("covered", F.last(F.when(F.col("kind") == 0, F.col("timestamp")), ignorenulls=True).over(down)).where("kind = 1 and covered > timestamp")
    return met.groupBy(*KEY).agg(F.count("*").alias("samples"), rounded(F.avg((micros("covered") - micros("timestamp")) / 1000)).alias("data_rtt_ms"))


def reset_verdict(rst: str, fwd: str, rev: str, delta: int) -> tuple[Column, Column, Column]:
    """(rst_authenticity, rst_delta, rst_reason) of the first reset (ttl, ip_id, reversed) and the first hop limits of both directions."""
    base = F.when(F.col(f"{rst}.reversed"), F.col(rev)).otherwise(F.col(fwd))
    away = F.abs(F.col(f"{rst}.ttl") - base)
    verdict_ = F.when(base.isNull(), "unknown").when(away >= delta, "suspicious").otherwise("genuine")
    told = F.format_string("hop limit %d of the reset is %d away from %d, which its direction began with", F.col(f"{rst}.ttl"), away, base)
    weak = F.when(F.col(f"{rst}.ip_id") == 0, F.lit("; its IP-ID is 0, as of packets made by simple tools")).otherwise(F.lit(""))
    return verdict_, away, F.when(verdict_ == "suspicious", F.concat(told, weak))


def resets(packets: DataFrame, delta: int = 5) -> DataFrame:
    """(flow key, rst_authenticity, rst_delta, rst_reason): whether the first reset's hop limit fits the packets of its direction before any reset.

    An identification of zero is told as a weak sign besides; it never changes the verdict.
    """
    own = canonical(packets).where("protocol = 'TCP'")
    pick = lambda way: F.min_by(F.when(~has(4) & (F.col("ttl") > 0) & (F.col("reversed") == way), F.col("ttl")), F.when(~has(4) & (F.col("ttl") > 0) & (F.col("reversed") == way), F.col("frame_number")))
    first = F.min_by(F.when(has(4), F.struct("ttl", "ip_id", "reversed")), F.when(has(4), F.col("frame_number")))
    each = own.groupBy(*KEY).agg(first.alias("rst"), pick(False).alias("fwd"), pick(True).alias("rev"))
    found = reset_verdict("rst", "fwd", "rev", delta)
    return each.where("rst is not null and rst.ttl > 0").select(*KEY, *[c.alias(n) for c, n in zip(found, ("rst_authenticity", "rst_delta", "rst_reason"), strict=True)])


def track(packets: DataFrame) -> DataFrame:
    """Flows with all measures.

    The headers of packets are exchanged once, by flow; all windows and sums then run on that exchange: the
    first numbers of both directions, what was sent and acknowledged before each packet, the acknowledgement
    that covers each pushed segment, and the seconds of the trend. Payloads don't travel.
    """
    needed = [c for c in ("job_id", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "frame_number", "timestamp", "payload_len", "seq", "ack", "flags", "ttl", "ip_id") if c in packets.columns or c == "job_id"]
    own = canonical(with_job(packets).select(*needed)).select(*KEY, "reversed", *[c for c in needed if c not in KEY and not c.startswith(("src_", "dst_"))]).repartition(*KEY)
    tcp, rev, frame = F.col("protocol") == "TCP", F.col("reversed"), F.col("frame_number")
    data, acks = tcp & (F.col("payload_len") > 0), tcp & has(16)
    flow, order = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy("frame_number")
    way = Window.partitionBy(*KEY, "reversed").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, -1)
    first = lambda back: F.min_by(F.when(data & (rev == back), F.col("seq")), F.when(data & (rev == back), frame)).over(flow)
    t = F.when(F.col("payload_len") > 0, micros("timestamp"))
    seen = own.withColumns({"first_fwd": first(False), "first_rev": first(True), "t0": F.min(t).over(flow), "syn": F.min(F.when(tcp & has(2) & ~rev & ~has(16), F.col("timestamp"))).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    at = F.when(data, unwrapped(F.col("seq"), F.when(rev, F.col("first_rev")).otherwise(F.col("first_fwd"))))
    upto = F.when(acks, unwrapped(F.col("ack"), F.when(rev, F.col("first_fwd")).otherwise(F.col("first_rev"))))
    placed = seen.withColumns({"at": at, "upto": upto})
    met = placed.withColumns({"again": F.coalesce(F.col("at") < F.max(F.col("at") + F.col("payload_len")).over(way), F.lit(False)), "highest": F.max("upto").over(way)})
    raises = F.col("upto").isNotNull() & (F.col("highest").isNull() | (F.col("upto") > F.col("highest")))
    # A packet itself (2), the pushed segment that it is (1), the acknowledgement that it is to the other direction (0).
    roles = F.array_compact(F.array(
        F.struct(F.lit(2).alias("kind"), rev.alias("way"), F.lit(None).cast("long").alias("pos")),
        F.when(data & has(8), F.struct(F.lit(1).alias("kind"), rev.alias("way"), (F.col("at") + F.col("payload_len")).alias("pos"))),
        F.when(raises, F.struct(F.lit(0).alias("kind"), (~rev).alias("way"), F.col("upto").alias("pos"))),
    ))
    every = met.withColumn("role", F.explode(roles)).select("*", "role.*")
    down = Window.partitionBy(*KEY, "way").orderBy(F.desc_nulls_last("pos"), F.asc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    covered = every.withColumn("covered", F.last(F.when(F.col("kind") == 0, F.col("timestamp")), ignorenulls=True).over(down))
    one, sampled = F.col("kind") == 2, (F.col("kind") == 1) & (F.col("covered") > F.col("timestamp"))
    n = lambda where, x=1: F.sum(F.when(one & where, x).otherwise(0))
    back = one & tcp & rev & has(2) & has(16) & F.col("syn").isNotNull()
    reset, base = one & tcp & has(4), lambda r: one & tcp & ~has(4) & (F.col("ttl") > 0) & (rev == r)
    hop = lambda r: F.min_by(F.when(base(r), F.col("ttl")), F.when(base(r), frame))
    each = covered.groupBy(*KEY).agg(
        n(~rev).alias("fwd_packets"), n(rev).alias("rev_packets"), n(~rev, F.col("payload_len")).alias("fwd_bytes"), n(rev, F.col("payload_len")).alias("rev_bytes"),
        F.min_by("timestamp", "frame_number").alias("start_time"), F.max("timestamp").alias("end_time"), F.bit_or(F.when(tcp, F.col("flags")).otherwise(0).cast("int")).alias("flags"),
        F.min_by(F.struct("timestamp", "syn"), F.when(back, frame)).alias("shake"), n(F.col("again")).alias("again"),
        F.count(F.when(sampled, 1)).alias("samples"), F.avg(F.when(sampled, (micros("covered") - micros("timestamp")) / 1000)).alias("rtt"),
        F.min_by(F.when(reset, F.struct("ttl", "ip_id", "reversed")), F.when(reset, frame)).alias("rst"), hop(False).alias("fwd_ttl"), hop(True).alias("rev_ttl"),
    )
    total = F.col("fwd_packets") + F.col("rev_packets")
    told = F.col("rst").isNotNull() & (F.col("rst.ttl") > 0)
    judged = {k: F.when(told, c) for k, c in zip(("rst_authenticity", "rst_delta", "rst_reason"), reset_verdict("rst", "fwd_ttl", "rev_ttl", 5), strict=True)}
    measures = {
        "handshake_ms": rounded((micros(F.col("shake.timestamp")) - micros(F.col("shake.syn"))) / 1000 * 2), "retransmissions": F.when(tcp, F.col("again")), "loss_pct": F.when(tcp, rounded(100.0 * F.col("again") / total)),
        "samples": F.when(F.col("samples") > 0, F.col("samples")), "data_rtt_ms": rounded(F.col("rtt")), **judged,
    }
    out = described(each.withColumns(measures).drop("shake", "again", "rtt", "rst", "fwd_ttl", "rev_ttl"))
    return scored(out.join(_steps(seen.where(t.isNotNull()).withColumn("s", F.floor((t - F.col("t0")) / 1_000_000).cast("long"))), KEY, "left"))


def scored(out: DataFrame) -> DataFrame:
    """Adds the round-trip time that counts, and the score and verdict of the service level."""
    rtt = F.coalesce(F.when(F.col("data_rtt_ms") > 0, F.col("data_rtt_ms")), "handshake_ms", F.lit(0.0))
    score = F.when(F.col("protocol") == "TCP", tcp_score(rtt, F.coalesce("loss_pct", F.lit(0.0)))).otherwise(100)
    return out.withColumns({"rtt_ms": rtt, "sla_score": score}).withColumn("sla_verdict", verdict(F.col("sla_score")))


STREAM = ["job_id", "src_ip", "src_port", "dst_ip", "dst_port", "ssrc"]


def rtp_gaps(packets: DataFrame) -> DataFrame:
    """A row per RTP stream: packets, the largest step of the sequence number (1 for a perfect stream), lost ones."""
    last = F.lag("rtp_seq").over(Window.partitionBy(*STREAM).orderBy("frame_number"))
    each = with_job(packets).withColumn("gap", F.pmod(F.col("rtp_seq") - last, F.lit(65536))).groupBy(*STREAM).agg(F.count("*").alias("packets"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_seq_gap"), F.sum(F.when(F.col("gap") > 1, F.col("gap") - 1).otherwise(0)).alias("lost"))
    return each.withColumn("loss_pct", F.round(F.col("lost") / (F.col("packets") + F.col("lost")) * 10000) / 100)


#: Steps that are folded together: (15/16)**4096 is below 1e-114, so of what came before a run's predecessor nothing is left in a double.
RUN = 4096


#: Samples of the jitter that a trend is made of, and points that it has at most.
SAMPLES, POINTS = 300, 60


def rtp_jitter(packets: DataFrame, run: int = RUN) -> DataFrame:
    """A row per RTP stream: the running interarrival jitter at its end, its extremes, its mean and its trend.

    J += (|arrival step in whole ms - timestamp step in ticks| - J) / 16, in order: a fold over the stream's
    steps, without Python. The first packet makes no step; a stream of one packet has zeros. A stream is folded in
    runs of ``run`` steps, each from where the one before it ends, so an array holds one run and never a
    stream; the windows share one exchange and spill. ``run`` should not be below 1024: a run starts from its
    predecessor's own fold.

    ``jitter_trend`` has the values after the first 300 steps at most, thinned to at most 60 of (i, ms).
    """
    order = Window.partitionBy(*STREAM).orderBy("frame_number")
    ticks = F.pmod(F.col("rtp_time") - F.lag("rtp_time").over(order), F.lit(WRAP))
    waited = ((micros("timestamp") - F.lag(micros("timestamp")).over(order)) / 1000.0).cast("long")
    steps = with_job(packets).withColumns({"d": F.abs(waited - ticks).cast("double"), "run": F.floor((F.row_number().over(order) - 1) / run)})
    gathered = F.filter(F.array_sort(F.collect_list(F.struct("frame_number", "d")))["d"], lambda d: d.isNotNull())
    runs = steps.groupBy(*STREAM, "run").agg(gathered.alias("d"))
    end = F.aggregate("d", F.lit(0.0), lambda j, d: j + (d - j) / 16)
    before = F.lag("end", 1, 0.0).over(Window.partitionBy(*STREAM).orderBy("run"))
    runs = runs.withColumn("end", end).withColumn("before", before)
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    start = F.struct(F.col("before").alias("j"), none.alias("low"), zero.alias("high"), zero.alias("sum"))
    add = lambda a, j: F.struct(j.alias("j"), F.least(a["low"], j).alias("low"), F.greatest(a["high"], j).alias("high"), (a["sum"] + j).alias("sum"))
    folded = runs.withColumn("r", F.aggregate("d", start, lambda a, d: add(a, a["j"] + (d - a["j"]) / 16)))
    # The trend is of the first run: it is longer than the samples.
    began = F.struct(zero.alias("j"), F.array().cast("array<double>").alias("all"))
    following = lambda a, j: F.struct(j.alias("j"), F.concat(a["all"], F.array(F.round(j * 100) / 100)).alias("all"))
    samples = F.aggregate(F.slice("d", 1, SAMPLES), began, lambda a, d: following(a, a["j"] + (d - a["j"]) / 16), lambda a: a["all"])
    each = folded.withColumn("samples", F.when(F.col("run") == 0, samples)).groupBy(*STREAM).agg(
        F.max_by("r.j", "run").alias("j"), F.min("r.low").alias("low"), F.max("r.high").alias("high"), F.sum("r.sum").alias("sum"), F.sum(F.size("d")).alias("n"),
        F.max("samples").alias("samples"),
    )
    thin = F.when(F.size("samples") > POINTS, F.ceil(F.size("samples") / POINTS)).otherwise(1).cast("int")
    point = lambda i: F.struct(i.alias("i"), F.get("samples", i).alias("ms"))
    trend = F.when(F.size("samples") > 0, F.transform(F.sequence(F.lit(0), F.size("samples") - 1, thin), point)).otherwise(F.array().cast("array<struct<i: int, ms: double>>"))
    mean = F.when(F.col("n") > 0, F.col("sum") / F.col("n")).otherwise(0.0)
    shown = {"jitter": F.col("j"), "jitter_min": F.coalesce("low", zero), "jitter_max": F.col("high"), "jitter_avg": mean}
    return each.select(*STREAM, *[rounded(c, 3).alias(name) for name, c in shown.items()], trend.alias("jitter_trend"))
