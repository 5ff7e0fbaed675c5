"""User rules: JSON conditions on figures of all flows, compiled to columns."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import sip_status

COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
FIELDS = ("total_flows", "total_packets", "capture_window_secs", "sip_401_max", "sip_register_max", "sip_invite_max", "sip_options_max", "source_fan_out_max", "dns_query_max")


def figures(flows: DataFrame) -> DataFrame:
    """One row of the figures that conditions may name, and counts by type and by ``TYPE:error_type`` as maps."""
    sip = F.col("type") == "SIP"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sources = flows.groupBy("src_ip").agg(n(sip & (sip_status(F.col("response")) == 401)).alias("a"), n(sip & (F.col("method") == "REGISTER")).alias("r"), n(sip & (F.col("method") == "INVITE")).alias("i"), n(sip & (F.col("method") == "OPTIONS")).alias("o"), F.count_distinct("dst_ip").alias("d"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    whole = flows.agg(F.count("*").alias("total_flows"), F.coalesce(F.sum("packets"), F.lit(0)).alias("total_packets"), F.coalesce((micros(F.max("end_time")) - micros(F.min("start_time"))) / 1e6, F.lit(0.0)).alias("capture_window_secs"))
    per_source = sources.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(f) for c, f in (("a", "sip_401_max"), ("r", "sip_register_max"), ("i", "sip_invite_max"), ("o", "sip_options_max"), ("d", "source_fan_out_max"))])
    names = flows.where("type = 'DNS'").groupBy("query_name").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("dns_query_max"))
    table = lambda df, name: df.groupBy("key").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias(name))
    types = table(flows.select(F.col("type").alias("key")), "flow_count")
    errors = table(flows.where("is_error").select(F.concat_ws(":", "type", F.coalesce("error_type", F.lit(""))).alias("key")), "error_count")
    out = whole
    for part in (per_source, names, types, errors):  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out


def field(name: str) -> Column | None:
    """The figure a condition names; null where there is no such field."""
    if name in FIELDS:
        return F.col(name).cast("double")
    for prefix in ("flow_count", "error_count"):
        if name.startswith(f"{prefix}."):
            return F.coalesce(F.try_element_at(prefix, F.lit(name[len(prefix) + 1 :])), F.lit(0)).cast("double")
    return None


def compile_rule(condition_json: str) -> Column:
    """A rule's condition as a column over ``figures``.

    Conditions on unknown fields or with unknown operators are skipped: with none left ``all`` holds and
    ``any`` doesn't. Any other ``match`` never holds. Bad JSON and an empty list are refused.
    """
    try:
        parsed = json.loads(condition_json)
        conditions, match = parsed["conditions"], parsed.get("match", "")
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"not a rule: {condition_json!r}") from e
    if not conditions:
        raise ValueError("a rule without conditions")
    known = [COMPARE[c["operator"]](f, F.lit(float(c["value"]))) for c in conditions if (f := field(c.get("field", ""))) is not None and c.get("operator") in COMPARE]
    if match == "all":
        out = F.lit(True)
        for k in known:
            out = out & k
    elif match == "any":
        out = F.lit(False)
        for k in known:
            out = out | k
    else:
        out = F.lit(False)
    return out


def run_user_rules(flows: DataFrame, rules: Iterable[dict]) -> DataFrame:
    """Alerts of the enabled rules (name, protocol, severity, description, condition_json, enabled): all in one pass."""
    built = [F.when(compile_rule(r["condition_json"]), F.struct(F.lit(r["name"]).alias("rule"), F.lit(r.get("severity", "warning")).alias("severity"), F.lit(r.get("protocol", "*")).alias("protocol"), F.lit(r.get("description") or describe(r["condition_json"])).alias("description"))) for r in rules if r.get("enabled", True)]
    return figures(flows).select(F.explode(F.array_compact(F.array(*built))).alias("a")).select("a.*")


def describe(condition_json: str) -> str:
    parsed = json.loads(condition_json)
    return f" {'AND' if parsed.get('match') == 'all' else 'OR'} ".join(f"{c['field']} {c['operator']} {c['value']}" for c in parsed["conditions"])
