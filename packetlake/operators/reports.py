"""Summaries, RFC 2544 and Y.1564 style reports, call records."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import rounded
from .kpi import all_kpis


def call_summary(calls: DataFrame) -> DataFrame:
    q = F.lower("quality")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    failed = ~q.isin("good", "excellent", "fair", "poor", "bad")
    return calls.agg(
        F.count("*").alias("total"), n(q.isin("good", "excellent")).alias("good"), n(q == "fair").alias("fair"), n(q.isin("poor", "bad")).alias("poor"), n(failed).alias("failed"), n(~failed).alias("successful"),
        n(F.col("end_type").isin("dropped", "abnormal")).alias("dropped"), rounded(F.avg(F.when(F.col("mos") > 0, F.col("mos")))).alias("avg_mos"), rounded(F.avg(F.when(F.col("duration_sec") > 0, F.col("duration_sec")))).alias("avg_duration"),
    )


def sip_status(response: Column) -> Column:
    """The code of a status line or of a bare code; null without one."""
    return F.regexp_extract(response, r"^(?:SIP/2\.0 )?(\d{3})", 1).try_cast("int")


def has_error(flows: DataFrame) -> Column:
    return F.coalesce((F.col("status_code") >= 400) | (sip_status(F.col("response")) >= 400), F.lit(False)) | F.coalesce("is_error", F.lit(False)) | F.coalesce(~F.col("result_code").between(2001, 2002), F.lit(False)) | F.coalesce(~F.col("reply_code").isin("NOERROR", ""), F.lit(False))


def protocol_stats(flows: DataFrame) -> DataFrame:
    return flows.groupBy("type").agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.sum(F.when(has_error(flows), 1).otherwise(0)).alias("errors"))


def root_causes(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.when(F.col("root_cause") == "", "unknown").otherwise(F.col("root_cause")).alias("root_cause")).agg(F.count("*").alias("calls"))


def report_span(flows: DataFrame) -> DataFrame:
    return flows.agg(F.min("start_time").alias("first"), F.max("end_time").alias("last"), F.count("*").alias("flows")).select("first", "last", "flows", F.timestamp_diff("SECOND", F.col("first"), F.col("last")).alias("seconds"))


def report(flows: DataFrame, calls: DataFrame) -> DataFrame:
    """(section, name, value, note): the whole report as rows.

    "totals" are flows, calls and the seconds from the first start to the last end; "kpi" are the indicators with
    their status as a note; "calls" the call figures and the share without failed ones; "protocol" flows, errors and
    success by type (the type is the name, the figure the note); "cause" calls by root cause.
    """
    row = lambda section, name, value, note=F.lit(""): F.struct(F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("double").alias("value"), note.alias("note"))
    each = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = flows.agg(F.count("*").alias("flows"), ((micros(F.max("end_time")) - micros(F.min("start_time"))) / 1e6).alias("seconds"))
    summary = call_summary(calls).withColumn("success", F.coalesce(rounded(100.0 * F.col("successful") / F.when(F.col("total") > 0, F.col("total"))), F.lit(0.0)))
    names = ["success", "avg_mos", "avg_duration", "dropped", "good", "fair", "poor", "failed"]
    success = rounded(100.0 * (F.col("flows") - F.col("errors")) / F.col("flows"))
    parts = [
        each(span, row("totals", "flows", F.col("flows")), row("totals", "seconds", F.coalesce("seconds", F.lit(0.0)))),
        each(summary, row("totals", "calls", F.col("total")), *[row("calls", n, F.coalesce(F.col(n), F.lit(0))) for n in names]),
        each(all_kpis(flows, calls), row("kpi", F.col("name"), F.col("value"), F.col("status"))),
        each(protocol_stats(flows), *[row("protocol", F.col("type"), v, F.lit(n)) for n, v in (("flows", F.col("flows")), ("errors", F.col("errors")), ("success", success))]),
        each(root_causes(calls), row("cause", F.col("root_cause"), F.col("calls"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0.0))


def throughput(flows: DataFrame) -> DataFrame:
    """Over all flows: those without the figure count as zero."""
    return flows.agg(F.max(_zero("throughput_bps")).alias("max_bps"), rounded(F.avg(_zero("throughput_bps"))).alias("avg_bps"), F.sum("bytes").alias("bytes"))


def ranked(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """(value, rank from 0, n): exact ranks without sorting all rows in one task.

    Equal values are counted first. Approximate quantiles cut the distinct values into ranges that are
    numbered apart, and each range starts where the counts before it end. A row per distinct value, with
    the ranks its copies take: [rank, rank + copies).
    """
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("copies"))
    edges = F.array_distinct(F.percentile_approx("value", [i / parts for i in range(1, parts)], 10_000))
    cut = counts.crossJoin(F.broadcast(counts.agg(edges.alias("edges"))))  # one row of `parts` numbers
    placed = cut.withColumn("part", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    sums = placed.groupBy("part").agg(F.sum("copies").alias("inside"))
    before = sums.select("part", (F.sum("inside").over(Window.orderBy("part")) - F.col("inside")).alias("before"), F.sum("inside").over(Window.partitionBy()).alias("n"))
    inner = F.sum("copies").over(Window.partitionBy("part").orderBy("value")) - F.col("copies")
    return placed.withColumn("inner", inner).join(F.broadcast(before), "part").select("value", "copies", (F.col("before") + F.col("inner")).alias("rank"), "n")  # at most `parts` rows


def nearest_rank(df: DataFrame, value: str, shares: Mapping[str, float]) -> DataFrame:
    """One row of the values at rank min(floor(share * n), n - 1), by name."""
    at = ranked(df, value)
    pick = [F.max(F.when((F.col("rank") <= F.least(F.floor(F.col("n") * p), F.col("n") - 1)) & (F.least(F.floor(F.col("n") * p), F.col("n") - 1) < F.col("rank") + F.col("copies")), F.col("value"))).alias(name) for name, p in shares.items()]
    return at.agg(*pick)


def latency(flows: DataFrame) -> DataFrame:
    own = flows.where("rtt_ms > 0")
    basics = own.agg(F.min("rtt_ms").alias("min_ms"), rounded(F.avg("rtt_ms")).alias("avg_ms"), F.max("rtt_ms").alias("max_ms"))
    return basics.crossJoin(F.broadcast(nearest_rank(own, "rtt_ms", {"p95_ms": 0.95, "p99_ms": 0.99})))  # one row each


def frame_loss(flows: DataFrame) -> DataFrame:
    lost = F.round(_zero("packet_loss_pct") / 100 * F.col("packets")).cast("long")
    return flows.agg(F.sum("packets").alias("frames"), F.sum(lost).alias("lost"), rounded(F.avg(_zero("packet_loss_pct")), 4).alias("avg_loss_pct"), F.sum(F.coalesce("retransmissions", F.lit(0))).alias("retransmissions"))


def back_to_back(flows: DataFrame) -> DataFrame:
    own = F.when(F.col("packets") > 0, F.col("packets"))
    return flows.agg(F.max(own).alias("max_burst"), rounded(F.avg(own)).alias("avg_burst"))


def by_protocol(flows: DataFrame, verdict_of: Column) -> DataFrame:
    """A row per type with averages (round-trip times over those there are) and how many flows have which verdict."""
    verdicts = [F.sum(F.when(verdict_of == v, 1).otherwise(0)).alias(v) for v in ("good", "acceptable", "poor", "critical")]
    return flows.groupBy("type").agg(F.count("*").alias("flows"), rounded(F.avg(_zero("throughput_bps"))).alias("avg_bps"), rounded(F.avg(F.when(F.col("rtt_ms") > 0, F.col("rtt_ms")))).alias("avg_rtt_ms"), rounded(F.avg(_zero("packet_loss_pct")), 4).alias("avg_loss_pct"), *verdicts)


def load_sweep(flows: DataFrame, bands: int = 5) -> DataFrame:
    """Equal bands of flows by the rank of their throughput (zero is left out): [floor(i*n/5), floor((i+1)*n/5)).

    Ranks come by distinct value, so flows of the same throughput share a band's border by their count.
    """
    own = flows.where("throughput_bps > 0")
    at = ranked(own, "throughput_bps")
    lo = lambda i: F.floor(F.col("n") * i / bands)
    rows = at.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    share = F.least(F.col("rank") + F.col("copies"), lo(F.col("band") + 1)) - F.greatest(F.col("rank"), lo(F.col("band")))
    own = rows.withColumn("share", share).where("share > 0")
    return own.groupBy(F.col("band").cast("long").alias("band")).agg(F.sum("share").alias("flows"), F.min("value").alias("min_bps"), F.max("value").alias("max_bps"), rounded(F.sum(F.col("value") * F.col("share")) / F.sum("share")).alias("avg_bps"))


#: Service, protocol, frame delay and delay variation in ms, loss in percent.
SERVICES = [("Voice (RTP)", "RTP", 150.0, 30.0, 1.0), ("SIP Signaling", "SIP", 500.0, 0.0, 0.1), ("Data (TCP)", "TCP", 500.0, 0.0, 0.5), ("DNS", "DNS", 100.0, 0.0, 0.0)]


def service_report(flows: DataFrame, services: list[tuple] = SERVICES) -> DataFrame:
    """Per service and direction (ALL, and UL or DL as seen from the protocol's most frequent source): means and a verdict.

    PASS within all limits, WARN within 1.2 times of each, FAIL beyond; a limit of zero isn't tested
    except for loss.
    """
    spark = flows.sparkSession
    limits = F.broadcast(spark.createDataFrame(services, "service string, type string, max_delay double, max_jitter double, max_loss double"))  # a row per service
    own = flows.join(limits, "type")
    sources = own.groupBy("type", "src_ip").agg(F.count("*").alias("n"))
    reference = sources.groupBy("type").agg(F.min_by("src_ip", F.struct(-F.col("n"), F.col("src_ip"))).alias("reference"))
    seen = own.join(F.broadcast(reference), "type").withColumn("direction", F.explode(F.array(F.lit("ALL"), F.when(F.col("src_ip") == F.col("reference"), "DL").otherwise("UL"))))  # a row per service
    means = seen.groupBy("service", "type", "direction", "max_delay", "max_jitter", "max_loss").agg(
        F.count("*").alias("flows"), rounded(F.avg(F.when(F.col("rtt_ms") > 0, F.col("rtt_ms")))).alias("delay"), rounded(F.avg(F.when(F.col("jitter_ms") > 0, F.col("jitter_ms")))).alias("jitter"), rounded(F.avg(_zero("packet_loss_pct")), 4).alias("loss"),
    )
    tested = [("delay", (F.col("max_delay") > 0) & F.col("delay").isNotNull()), ("jitter", (F.col("max_jitter") > 0) & F.col("jitter").isNotNull()), ("loss", F.lit(True))]
    beyond = lambda factor: [F.when(test & (F.col(k) > F.col(f"max_{k}") * factor), k) for k, test in tested]
    over, far = F.array_compact(F.array(*beyond(1.0))), F.array_compact(F.array(*beyond(1.2)))
    return means.select("service", "direction", "flows", "delay", "jitter", "loss", F.array_join(over, ",").alias("violations"), F.when(F.size(far) > 0, "FAIL").when(F.size(over) > 0, "WARN").otherwise("PASS").alias("verdict"))


def overall_verdict(report: DataFrame) -> DataFrame:
    """One row: FAIL if any service fails over both directions together, else PASS; without a service PASS."""
    failed = F.count_if((F.col("direction") == "ALL") & (F.col("verdict") == "FAIL"))
    return report.agg(F.count_if(F.col("direction") == "ALL").alias("services"), F.when(failed > 0, "FAIL").otherwise("PASS").alias("overall"))


def call_table(calls: DataFrame, legs: DataFrame) -> DataFrame:
    """The 14 columns of the call export, as text in the formats of the export. Losses and confidences that calls haven't are zero."""
    have = set(calls.columns)
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double") if c in have else F.lit(0.0)
    jitter = F.avg(F.when(F.col("jitter_ms") > 0, F.col("jitter_ms")))
    each = legs.groupBy("job_id", "call_id").agg(jitter.alias("jitter"), F.max("max_seq_gap").alias("gap"))
    own = calls.join(each, ["job_id", "call_id"], "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    digits = lambda n, v, name: F.format_string(f"%.{n}f", v).alias(name)
    return own.select(
        "job_id", "call_id", "from_uri", "to_uri", time("start_time"), time("end_time"), digits(2, F.greatest(F.lit(0.0), (micros("end_time") - micros("start_time")) / 1e6), "duration_sec"), digits(3, number("mos"), "mos"), "quality",
        digits(2, F.round(F.coalesce("jitter", F.lit(0.0)), 2), "jitter_ms"), F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0)).cast("string").alias("max_seq_gap"), digits(2, number("packet_loss_pct"), "packet_loss_pct"), "end_type", "root_cause", digits(4, number("confidence"), "confidence"),
    )


def write_calls_csv(calls: DataFrame, legs: DataFrame, path: str) -> None:
    """The call export: a folder of CSV files with a header for each job."""
    call_table(calls, legs).write.mode("overwrite").partitionBy("job_id").csv(path, header=True)


def call_records(calls: DataFrame, legs: DataFrame) -> DataFrame:
    """A record per call for export: durations, mean jitter over legs that have some, largest gap, packets."""
    each = legs.groupBy("job_id", "call_id").agg(F.count("*").alias("legs"), F.sum("packet_count").alias("packets"), rounded(F.avg(F.when(F.col("jitter_ms") > 0, F.col("jitter_ms")))).alias("jitter_ms"), F.max("max_seq_gap").alias("max_gap"))
    own = calls.join(each, ["job_id", "call_id"], "left")
    return own.select("job_id", "call_id", "from_uri", "to_uri", "start_time", "end_time", F.greatest(F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")), F.lit(0)).alias("seconds"), "mos", "quality", "end_type", "root_cause", F.coalesce("legs", F.lit(0)).alias("legs"), F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("jitter_ms", F.lit(0.0)).alias("jitter_ms"), F.coalesce("max_gap", F.lit(0)).alias("max_gap"))


def job_context(flows: DataFrame, calls: DataFrame, events: DataFrame) -> DataFrame:
    """(job_id, section, line): text lines that describe a job, for a reader or a prompt."""
    per = flows.groupBy("job_id", "type").agg(F.count("*").alias("n"), F.sum("packets").alias("p"), F.sum(F.when(has_error(flows), 1).otherwise(0)).alias("e"))
    lines = per.select("job_id", F.lit("protocols").alias("section"), F.format_string("%s: %d flows, %d packets, %d errors", "type", "n", "p", "e").alias("line"))
    quality = calls.groupBy("job_id", F.when(F.col("quality") == "", "unknown").otherwise(F.lower("quality")).alias("q")).agg(F.count("*").alias("n"))
    notes = events.where("severity in ('error', 'critical')").groupBy("job_id", "severity", "title").agg(F.count("*").alias("n"))
    return lines.unionByName(quality.select("job_id", F.lit("calls").alias("section"), F.format_string("%s: %d calls", "q", "n").alias("line"))).unionByName(notes.select("job_id", F.lit("events").alias("section"), F.format_string("%s: %s (%d times)", "severity", "title", "n").alias("line")))
