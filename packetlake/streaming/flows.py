"""Flows of a stream of packets: each is given once, when it has ended, and then forgotten.

State is kept by flow: sums, what the measures in order need, and the packets that are newer than the
watermark. So it is bounded by the flows that are open, the bytes that are in flight and the lateness that is
allowed, not by the length of the stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import ceil, floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.quality import rounded
from ..operators import tracker
from .live import LATENESS, timed

#: Seconds without a packet after which a flow has ended, and after which it has once it was closed or reset.
IDLE, LINGER = 60.0, 2.0
POINTS, SECONDS = 60, 3600
_PACKET = ["t", "frame_number", "reversed", "payload_len", "seq", "ack", "flags", "ttl", "ip_id"]
_OUT = """job_id long, protocol string, ip_a string, port_a int, ip_b string, port_b int, fwd_packets long, rev_packets long, fwd_bytes long, rev_bytes long, first long, last long, flags int,
handshake_us long, retransmissions long, samples long, rtt_us double, rst_ttl int, rst_ip_id int, rst_reversed boolean, fwd_ttl int, rev_ttl int, trend array<double>"""


def _unwrapped(value: int, first: int) -> int:
    d = (value - first) % tracker.WRAP
    return d - tracker.WRAP if d >= tracker.WRAP // 2 else d


class OpenFlow:
    """What is known of a flow. Its packets are added in order of time; ``data`` is all of it, as JSON keeps it."""

    def __init__(self, data: dict | None = None) -> None:
        way = lambda: {"n": 0, "bytes": 0, "first": None, "end": None, "again": 0, "wait": [], "ack": None, "ttl": None}
        self.data = data or {"first": None, "last": None, "flags": 0, "ways": [way(), way()], "syn": None, "back": None, "samples": 0, "rtt": 0, "rst": None, "t0": None, "trend": {}}

    def starts_anew(self, tcp: bool, flags: int) -> bool:
        """Whether a packet opens a new connection between the ends of one that was closed or reset."""
        return tcp and self.data["flags"] & 5 != 0 and flags & 2 != 0 and flags & 16 == 0

    def deadline(self, idle: int, linger: int) -> int:
        return self.data["last"] + (linger if self.data["flags"] & 5 else idle)

    def add(self, tcp: bool, t: int, _number: int, back: bool, size: int, seq: int, ack: int, flags: int, ttl: int, ip_id: int) -> None:
        d = self.data
        own, other = d["ways"][back], d["ways"][not back]
        d["first"] = t if d["first"] is None else d["first"]
        d["last"] = t if d["last"] is None else max(d["last"], t)
        own["n"] += 1
        own["bytes"] += size
        if size > 0:
            d["t0"] = t if d["t0"] is None else d["t0"]
            second = str((t - d["t0"]) // 1_000_000)
            if int(second) < SECONDS:
                d["trend"][second] = d["trend"].get(second, 0) + size
        if not tcp:
            return
        d["flags"] |= flags
        if flags & 2 and not back and not flags & 16 and d["syn"] is None:
            d["syn"] = t
        if flags & 2 and back and flags & 16 and d["syn"] is not None and d["back"] is None:
            d["back"] = t - d["syn"]
        if size > 0:
            own["first"] = seq if own["first"] is None else own["first"]
            at = _unwrapped(seq, own["first"])
            own["again"] += own["end"] is not None and at < own["end"]
            own["end"] = at + size if own["end"] is None else max(own["end"], at + size)
            if flags & 8 and (own["ack"] is None or at + size > own["ack"]):
                own["wait"].append([at + size, t])
        if flags & 16 and other["first"] is not None:
            at = _unwrapped(ack, other["first"])
            if other["ack"] is None or at > other["ack"]:
                other["ack"] = at
                for _, sent in (x for x in other["wait"] if x[0] <= at):
                    if t > sent:
                        d["samples"] += 1
                        d["rtt"] += t - sent
                other["wait"] = [x for x in other["wait"] if x[0] > at]
        if flags & 4:
            d["rst"] = d["rst"] or [ttl, ip_id, back]
        elif ttl > 0 and own["ttl"] is None:
            own["ttl"] = ttl

    def row(self, key: tuple) -> tuple:
        d = self.data
        (a, b), tcp = d["ways"], key[1] == "TCP"
        n = max(map(int, d["trend"]), default=-1) + 1
        step = max(1, ceil(n / POINTS))
        sums = [0] * ceil(n / step)
        for second, size in d["trend"].items():
            sums[int(second) // step] += size
        trend = [float(floor(x * 8 / step + 0.5)) for x in sums] if n else None
        rst = d["rst"] or [None, None, None]
        return (
            *key, a["n"], b["n"], a["bytes"], b["bytes"], d["first"], d["last"], d["flags"], d["back"], a["again"] + b["again"] if tcp else None,
            d["samples"] or None, d["rtt"] / d["samples"] if d["samples"] else None, *rst, a["ttl"], b["ttl"], trend,
        )


def _fold(key: tuple, flow: OpenFlow | None, packets: list[list], idle: int, linger: int, upto: int | None) -> tuple[OpenFlow | None, list[tuple]]:
    """The flow that is open after ``packets``, and the rows of those that ended; ``upto`` is the time that has come, None at the end of all."""
    rows = []
    for p in sorted(packets, key=lambda p: (p[0], p[1])):
        if flow and (p[0] > flow.deadline(idle, linger) or flow.starts_anew(key[1] == "TCP", p[6])):
            rows.append(flow.row(key))
            flow = None
        flow = flow or OpenFlow()
        flow.add(key[1] == "TCP", *p)
    if flow and (upto is None or flow.deadline(idle, linger) < upto):
        rows.append(flow.row(key))
        flow = None
    return flow, rows


def ended_flows(packets: DataFrame, idle: float = IDLE, linger: float = LINGER, lateness: str = LATENESS, delta: int = 5) -> DataFrame:
    """Flows with the measures of ``tracker.track``, each once: ``idle`` seconds after its last packet, or ``linger`` after it was closed or reset.

    Packets are taken in order of time: those newer than the watermark wait in the state, so that packets that
    come late by up to ``lateness`` change nothing. One that is later still counts to its flow as long as that is open,
    and else makes a flow of its own. A new SYN after a close starts a new flow. Restarted from
    its checkpoint, a stream goes on with the flows that were open; append mode gives each row to the sink once for each micro-batch
    number. Over a batch all flows end. Acknowledgements before a direction's first data don't count.
    """
    names = [n.strip() for n in _OUT.replace("\n", " ").split(",")]
    names = [n.split()[0] for n in names]
    idle_us, linger_us = int(idle * 1e6), int(linger * 1e6)
    have = set(packets.columns)
    number = lambda c: (F.col(c) if c in have else F.lit(0)).cast("long").alias(c)
    own = timed(tracker.canonical(packets), lateness)
    own = own.select(*tracker.KEY, "timestamp", F.unix_micros("timestamp").alias("t"), "frame_number", "reversed", F.coalesce("payload_len", F.lit(0)).cast("long").alias("payload_len"), *[number(c) for c in _PACKET[4:]])

    def rows_of(pdf: pd.DataFrame) -> list[list]:
        return [[int(t), int(n), bool(r), *map(int, rest)] for t, n, r, *rest in pdf[_PACKET].fillna(0).itertuples(index=False, name=None)]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"flow": None, "wait": []}
        waiting = kept["wait"] + [r for pdf in pdfs for r in rows_of(pdf)]
        now = state.getCurrentWatermarkMs() * 1000
        flow, rows = _fold(key, OpenFlow(kept["flow"]) if kept["flow"] else None, [p for p in waiting if p[0] <= now], idle_us, linger_us, now)
        waiting = [p for p in waiting if p[0] > now]
        if flow or waiting:
            state.update((json.dumps({"flow": flow.data if flow else None, "wait": waiting}),))
            due = min([p[0] for p in waiting] + ([flow.deadline(idle_us, linger_us)] if flow else []))
            state.setTimeoutTimestamp(max(due, now) // 1000 + 1)
        else:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(key, None, rows_of(pdf), idle_us, linger_us, None)[1], columns=names)

    if packets.isStreaming:
        raw = own.groupBy(*tracker.KEY).applyInPandasWithState(step, _OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)
    else:
        raw = own.groupBy(*tracker.KEY).applyInPandas(whole, _OUT)
    tcp = F.col("protocol") == "TCP"
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    total = F.col("fwd_packets") + F.col("rev_packets")
    raw = raw.withColumns({
        "start_time": at(F.col("first")), "end_time": at(F.col("last")), "handshake_ms": rounded(F.col("handshake_us") / 1000 * 2), "loss_pct": F.when(tcp, rounded(100.0 * F.col("retransmissions") / total)),
        "data_rtt_ms": rounded(F.col("rtt_us") / 1000), "rst": F.when(F.col("rst_ttl") > 0, F.struct(F.col("rst_ttl").alias("ttl"), F.col("rst_ip_id").alias("ip_id"), F.col("rst_reversed").alias("reversed"))),
    })
    found = tracker.reset_verdict("rst", "fwd_ttl", "rev_ttl", delta)
    told = {n: F.when(F.col("rst").isNotNull(), c) for n, c in zip(("rst_authenticity", "rst_delta", "rst_reason"), found, strict=True)}
    out = tracker.scored(tracker.described(raw.withColumns(told)))
    return out.drop("first", "last", "handshake_us", "rtt_us", "rst", "rst_ttl", "rst_ip_id", "rst_reversed", "fwd_ttl", "rev_ttl")
