"""The streaming measures by name, over the stored packets as a finished stream gives them, and changes to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle
from ..streaming import live
from .catalog import named

named("stream_rates_minute", "SELECT job_id, date_trunc('minute', timestamp) AS timestamp, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, CAST(sum(length) * 8 AS BIGINT) AS bits FROM v_packets GROUP BY 1, 2", lambda p: live.rates(p, "1 minute").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), "packets")
named("stream_protocol_totals", "SELECT app_protocol, count(*) AS packets FROM v_packets WHERE app_protocol <> '' GROUP BY 1", live.protocol_totals, "packets")
named("stream_displayed", "SELECT job_id, frame_number, app_protocol FROM v_packets WHERE app_protocol <> '' OR frame_number % 10 = 0", lambda p: live.displayed(p).select("job_id", "frame_number", "app_protocol"), "packets")
named(
    "upsert_calls", "SELECT frame_number, job_id, length FROM (SELECT frame_number, job_id, CASE WHEN frame_number % 7 = 0 THEN length + 1 ELSE length END AS length FROM v_packets)",
    lambda p: lifecycle.upserted(p.select("frame_number", "job_id", "length"), p.where("frame_number % 7 = 0").select("frame_number", "job_id", (F.col("length") + 1).alias("length")), "frame_number", order="length"), "packets",
)
named("insert_ignore", "SELECT frame_number, job_id FROM v_packets WHERE frame_number % 3 <> 0", lambda p: lifecycle.new_rows(p.where("frame_number % 3 = 0"), p.select("frame_number", "job_id"), "frame_number"), "packets")
named("delete_jobs", "SELECT frame_number, job_id FROM v_packets WHERE job_id NOT IN (1, 3)", lambda p: lifecycle.without_jobs(p, 1, 3).select("frame_number", "job_id"), "packets")
