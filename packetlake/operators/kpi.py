"""Service indicators and call analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import mos, rounded


def _status(value: Column, warning: Column, critical: Column) -> Column:
    return F.when(critical, "critical").when(warning, "warning").otherwise("good")


def share(condition: Column, of: Column | None = None) -> Column:
    """Percent of rows, or of those ``of`` holds for; null where there is none."""
    own, n = (condition, F.count("*")) if of is None else (of & condition, F.count_if(of))
    return 100.0 * F.sum(F.when(own, 1).otherwise(0)) / F.when(n > 0, n)


#: Name, unit, aggregate, value and status where it is null, tests for a warning and for a critical status.
Indicator = tuple[str, str, Column, float, str, Callable, Callable]


def rows(df: DataFrame, *indicators: Indicator) -> DataFrame:
    """(name, value, unit, status): a row per indicator, all of one aggregate over ``df``."""
    found = df.agg(*[i[2].cast("double").alias(f"v{k}") for k, i in enumerate(indicators)])
    shown = []
    for k, (name, unit, _, empty, empty_status, warning, critical) in enumerate(indicators):
        v = F.col(f"v{k}")
        status = F.when(v.isNull(), empty_status).otherwise(_status(v, warning(v), critical(v)))
        value = rounded(F.coalesce(v, F.lit(float(empty))))
        shown.append(F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(unit).alias("unit"), status.alias("status")))
    return found.select(F.inline(F.array(*shown)))


def low(warning: float, critical: float) -> tuple:
    return (lambda v: v < warning), (lambda v: v < critical)


def high(warning: float, critical: float) -> tuple:
    return (lambda v: v > warning), (lambda v: v > critical)


def of_calls() -> dict[str, Indicator]:
    score = F.avg(F.when(F.col("mos") > 0, F.col("mos")))
    return {
        "setup": ("Call Setup Success Rate", "%", share(~F.col("quality").isin("", "Failed")), 0, "warning", *low(95, 90)),
        "drop": ("Call Drop Rate", "%", share(F.col("end_type").isin("abnormal", "dropped")), 0, "good", *high(2, 5)),
        "mos": ("Average MOS", "score", score, 0, "warning", *low(3.5, 3.0)),
    }


def accepted_share(type_: str, accepted: int) -> Indicator:
    cause = F.coalesce(F.col("cause_code"), F.lit(accepted)).isin(0, accepted)
    return f"{type_} Success Rate", "%", share(cause, F.col("type") == type_), 100, "good", *low(98, 95)


def of_flows() -> dict[str, Indicator]:
    kind = F.col("type")
    setup = F.avg(F.when((kind == "SIP") & (F.col("setup_latency_ms") > 0), F.col("setup_latency_ms") / 1000))
    latency = F.avg(F.when((kind == "DNS") & (F.col("latency_ms") > 0), F.col("latency_ms")))
    judged = (kind == "Diameter") & F.col("result_code").isNotNull()
    return {
        "setup_time": ("Average Setup Time", "s", setup, 0, "good", *high(3, 6)),
        "dns": ("DNS Success Rate", "%", share(F.col("reply_code").isin("NOERROR", ""), kind == "DNS"), 100, "good", *low(98, 95)),
        "dns_latency": ("DNS Average Latency", "ms", latency, 0, "good", *high(100, 500)),
        "diameter": ("Diameter Success Rate", "%", share(F.col("result_code").between(2001, 2002), judged), 100, "good", *low(98, 95)),
        "gtp": accepted_share("GTP", 16),
        "pfcp": accepted_share("PFCP", 1),
        "protocols": ("Active Protocols", "count", F.count_distinct("type"), 0, "good", *low(-1, -1)),
    }


def call_setup_success(calls: DataFrame) -> DataFrame:
    return rows(calls, of_calls()["setup"])


def call_drop_rate(calls: DataFrame) -> DataFrame:
    return rows(calls, of_calls()["drop"])


def average_mos(calls: DataFrame) -> DataFrame:
    return rows(calls, of_calls()["mos"])


def setup_time(flows: DataFrame) -> DataFrame:
    return rows(flows, of_flows()["setup_time"])


def dns_success(flows: DataFrame) -> DataFrame:
    return rows(flows.where("type = 'DNS'"), of_flows()["dns"])


def dns_latency(flows: DataFrame) -> DataFrame:
    return rows(flows.where("type = 'DNS'"), of_flows()["dns_latency"])


def diameter_success(flows: DataFrame) -> DataFrame:
    return rows(flows.where("type = 'Diameter'"), of_flows()["diameter"])


def cause_success(flows: DataFrame, type_: str, accepted: int) -> DataFrame:
    return rows(flows.where(F.col("type") == type_), accepted_share(type_, accepted))


def active_protocols(flows: DataFrame) -> DataFrame:
    return rows(flows, of_flows()["protocols"])


def all_kpis(flows: DataFrame, calls: DataFrame) -> DataFrame:
    """The ten indicators, a row each: one pass over the calls and one over the flows."""
    return rows(calls, *of_calls().values()).unionByName(rows(flows, *of_flows().values()))


def analyse_calls(calls: DataFrame, legs: DataFrame) -> DataFrame:
    """Calls with the MOS of their worst leg, how they ended, the likeliest cause and its confidence.

    The first leg is the one of the smallest number, of equal ones of the smallest source id; a leg without packets has no quality.
    """
    counted = legs.withColumn("loss", F.when(F.col("packet_count") > 0, 100.0 * F.col("max_seq_gap") / F.col("packet_count")))
    each = counted.groupBy("job_id", "call_id").agg(
        F.count("*").alias("legs"), F.min(F.when(F.col("packet_count") > 0, mos(F.col("loss"), F.col("jitter_ms"), F.lit(0.0)))).alias("worst"),
        F.min_by(F.coalesce("loss", F.lit(0.0)), F.struct("leg", "ssrc")).alias("loss"), F.min_by("jitter_ms", F.struct("leg", "ssrc")).alias("jitter"),
    )
    joined = calls.select("job_id", "call_id", "is_on_hold").join(each, ["job_id", "call_id"], "left")
    score = F.coalesce("worst", F.lit(0.0))
    cases = [(F.col("is_on_hold"), "user_hold", 0.95), (F.col("legs").isNull(), "no_media", 0.8), ((score > 0) & (score < 2.6) & (F.col("loss") > 10), "high_packet_loss", 0.9), ((score > 0) & (score < 2.6) & (F.col("jitter") > 100), "excessive_jitter", 0.9), ((score > 0) & (score < 2.6), "media_quality", 0.85)]
    cause, sure = F, F
    for condition, name, confidence in cases:
        cause, sure = cause.when(condition, name), sure.when(condition, confidence)
    return joined.select("job_id", "call_id", score.alias("mos"), F.when(F.col("legs").isNull(), "abnormal").otherwise("normal").alias("end_type"), cause.otherwise("normal_release").alias("root_cause"), sure.otherwise(0.9).alias("confidence"))
