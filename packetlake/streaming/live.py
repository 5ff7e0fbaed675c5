"""Live traffic as Structured Streaming: rates, counts, agents, insight features and sinks.

Every function takes a DataFrame of packets, streaming or not: a batch gives what a finished stream would.
State is a row for each open window and key; watermarks close windows, so that it doesn't grow with the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late a packet may come.
LATENESS = "10 seconds"
#: An agent that sent nothing for so long is stale.
STALE_SECONDS = 30
#: Of packets without an application protocol one in so many is kept, by frame number.
UNDECODED = 10


def timed(packets: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Packets with a zoned timestamp, which watermarks need, and the watermark where they stream."""
    out = packets.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return out.withWatermark("timestamp", lateness) if out.isStreaming else out


def rates(packets: DataFrame, width: str = "1 second", lateness: str = LATENESS) -> DataFrame:
    """Packets and bytes of each event-time window that has packets, by job: (job_id, timestamp, packets, bytes, bits)."""
    out = timed(packets, lateness).groupBy("job_id", F.window("timestamp", width).alias("w")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    return out.select("job_id", F.col("w.start").alias("timestamp"), "packets", "bytes", (F.col("bytes") * 8).alias("bits"))


def protocol_totals(packets: DataFrame) -> DataFrame:
    """Packets of each application protocol since the start; for output mode complete or update."""
    return packets.where("app_protocol <> ''").groupBy("app_protocol").agg(F.count("*").alias("packets"))


def displayed(packets: DataFrame, one_in: int = UNDECODED) -> DataFrame:
    """Decoded packets, and of the others those whose frame number ``one_in`` divides."""
    return packets.where((F.col("app_protocol") != "") | (F.col("frame_number") % one_in == 0))


def packet_events(packets: DataFrame) -> DataFrame:
    """A warning for each entry of the packets' array ``errors``; packets without one give none."""
    return packets.select("job_id", "timestamp", F.lit("warning").alias("severity"), F.col("app_protocol").alias("protocol"), "frame_number", F.explode("errors").alias("title"))


def agent_totals(batches: DataFrame) -> DataFrame:
    """(agent_id, packets, bytes, dropped, last_seen) of agents' batches; for output mode complete or update."""
    return batches.groupBy("agent_id").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.sum("dropped").alias("dropped"), F.max("timestamp").alias("last_seen"))


def drop_rates(batches: DataFrame, width: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """(agent_id, timestamp, packets, dropped, drop_pct) of each window: the share of what agents saw that they dropped."""
    out = timed(batches.where("timestamp is not null"), lateness).groupBy("agent_id", F.window("timestamp", width).alias("w")).agg(F.sum("packets").alias("packets"), F.sum("dropped").alias("dropped"))
    seen = F.col("packets") + F.col("dropped")
    return out.select("agent_id", F.col("w.start").alias("timestamp"), "packets", "dropped", F.when(seen > 0, F.round(100.0 * F.col("dropped") / seen * 100) / 100).otherwise(0.0).alias("drop_pct"))


def with_staleness(agents: DataFrame, now: str, seconds: int = STALE_SECONDS) -> DataFrame:
    """Adds ``is_stale``: nothing was seen in the ``seconds`` before ``now``."""
    return agents.withColumn("is_stale", F.col("last_seen").cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def insight_features(packets: DataFrame, width: str = "30 seconds", lateness: str = LATENESS) -> DataFrame:
    """What a periodic summary reads of each window: volumes, sources and destinations (estimated), resets."""
    out = timed(packets, lateness).groupBy("job_id", F.window("timestamp", width).alias("w")).agg(
        F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.approx_count_distinct("src_ip").alias("sources"), F.approx_count_distinct("dst_ip").alias("destinations"), F.count_if(F.col("app_protocol") == "").alias("undecoded")
    )
    return out.select("job_id", F.col("w.start").alias("timestamp"), F.col("w.end").alias("until"), "packets", "bytes", "sources", "destinations", "undecoded")


def batch_writer(path: str, *partitions: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is a folder of its own, so that a batch written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        out = batch.write.mode("overwrite")
        (out.partitionBy(*partitions) if partitions else out).parquet(f"{path}/batch={number}")

    return write
