"""Flow tracking and RTP streams by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracker as t
from .catalog import STATEMENTS, named

KEY = "job_id, protocol, ip_a, port_a, ip_b, port_b"
CANONICAL = """c AS (SELECT *, CASE WHEN rev THEN dst_ip ELSE src_ip END AS ip_a, CASE WHEN rev THEN src_ip ELSE dst_ip END AS ip_b, CAST(CASE WHEN protocol = 'ICMP' THEN 0 WHEN rev THEN dst_port ELSE src_port END AS INT) AS port_a,
  CAST(CASE WHEN protocol = 'ICMP' THEN 0 WHEN rev THEN src_port ELSE dst_port END AS INT) AS port_b FROM (SELECT *, src_ip > dst_ip OR (src_ip = dst_ip AND protocol <> 'ICMP' AND src_port > dst_port) AS rev FROM v_segments))"""
NAMES = "concat_ws(' ', CASE WHEN f & 2 <> 0 THEN 'SYN' END, CASE WHEN f & 16 <> 0 THEN 'ACK' END, CASE WHEN f & 8 <> 0 THEN 'PSH' END, CASE WHEN f & 1 <> 0 THEN 'FIN' END, CASE WHEN f & 4 <> 0 THEN 'RST' END, CASE WHEN f & 32 <> 0 THEN 'URG' END)"


def rate(b: str) -> str:
    return f"CASE WHEN sec > 0 THEN round(({b}) * 8 / sec) ELSE 0.0 END"


named("flow_volume", f"""
WITH {CANONICAL}, v AS (SELECT {KEY}, count(*) FILTER (NOT rev) AS fwd_packets, count(*) FILTER (rev) AS rev_packets, CAST(coalesce(sum(payload_len) FILTER (NOT rev), 0) AS BIGINT) AS fwd_bytes, CAST(coalesce(sum(payload_len) FILTER (rev), 0) AS BIGINT) AS rev_bytes,
  arg_min(timestamp, frame_number) AS start_time, max(timestamp) AS end_time, CAST(bit_or(CASE WHEN protocol = 'TCP' THEN flags ELSE 0 END) AS INT) AS f, (epoch_us(max(timestamp)) - epoch_us(arg_min(timestamp, frame_number))) / 1000000.0 AS sec FROM c GROUP BY ALL)
SELECT 'flow-' || ip_a || ':' || port_a || '-' || ip_b || ':' || port_b || '-' || protocol AS flow_id, {KEY}, fwd_packets, rev_packets, fwd_bytes, rev_bytes, start_time, end_time, CASE WHEN protocol = 'TCP' THEN CASE WHEN {NAMES} = '' THEN 'none' ELSE {NAMES} END END AS tcp_flags,
  CASE WHEN protocol <> 'TCP' THEN NULL WHEN f & 4 <> 0 THEN 'RST' WHEN f & 1 <> 0 THEN 'FIN' ELSE 'timeout' END AS close_reason, {rate('fwd_bytes + rev_bytes')} AS throughput_bps, {rate('fwd_bytes')} AS fwd_bps, {rate('rev_bytes')} AS rev_bps FROM v
""", t.volumes, "segments")
named("flow_trend", f"""
WITH {CANONICAL}, s AS (SELECT *, (epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY {KEY})) // 1000000 AS s FROM c WHERE payload_len > 0),
b AS (SELECT {KEY}, s, sum(payload_len) AS bytes FROM s WHERE s < 2592000 GROUP BY ALL), n AS (SELECT {KEY}, max(s) + 1 AS n, greatest(1, CAST(ceil((max(s) + 1) / 60) AS BIGINT)) AS step FROM b GROUP BY ALL),
d AS (SELECT *, unnest(generate_series(0, CAST(ceil(n / step) AS BIGINT) - 1)) AS i FROM n)
SELECT d.job_id, d.protocol, d.ip_a, d.port_a, d.ip_b, d.port_b, list(coalesce(x.bps, 0.0) ORDER BY d.i) AS trend FROM d LEFT JOIN (SELECT {KEY}, s // step AS i, round(sum(bytes) * 8 / any_value(step)) AS bps FROM b JOIN n USING ({KEY}) GROUP BY ALL) x
  ON d.job_id = x.job_id AND d.protocol = x.protocol AND d.ip_a = x.ip_a AND d.port_a = x.port_a AND d.ip_b = x.ip_b AND d.port_b = x.port_b AND d.i = x.i GROUP BY 1, 2, 3, 4, 5, 6
""", lambda p: t.trend(p, seconds=2_592_000), "segments")
named("flow_handshake", f"""
WITH {CANONICAL}, s AS (SELECT *, min(CASE WHEN NOT rev AND flags & 16 = 0 THEN timestamp END) OVER (PARTITION BY {KEY} ORDER BY frame_number ROWS UNBOUNDED PRECEDING) AS syn FROM c WHERE protocol = 'TCP' AND flags & 2 <> 0)
SELECT {KEY}, round((epoch_us(arg_min(timestamp, frame_number)) - epoch_us(arg_min(syn, frame_number))) / 1000 * 2 * 100) / 100 AS handshake_ms FROM s WHERE rev AND flags & 16 <> 0 AND syn IS NOT NULL GROUP BY ALL
""", t.handshakes, "segments")
UNWRAP = "CASE WHEN {d} >= 2147483648 THEN {d} - 4294967296 ELSE {d} END"
POS = UNWRAP.format(d="((({v} - first_seq) % 4294967296 + 4294967296) % 4294967296)")
named("flow_retrans", f"""
WITH {CANONICAL}, f AS (SELECT {KEY}, rev, arg_min(seq, frame_number) AS first_seq FROM c WHERE protocol = 'TCP' AND payload_len > 0 GROUP BY ALL),
p AS (SELECT c.*, {POS.format(v='seq')} AS pos FROM c JOIN f USING ({KEY}, rev) WHERE payload_len > 0),
r AS (SELECT *, pos < max(pos + payload_len) OVER (PARTITION BY {KEY}, rev ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS again FROM p),
t AS (SELECT {KEY}, count(*) AS packets FROM c WHERE protocol = 'TCP' GROUP BY ALL), k AS (SELECT {KEY}, count(*) FILTER (again) AS n FROM r GROUP BY ALL)
SELECT {KEY}, coalesce(n, 0) AS retransmissions, round(100.0 * coalesce(n, 0) / packets * 100) / 100 AS loss_pct FROM t LEFT JOIN k USING ({KEY})
""", t.retransmissions, "segments")
named("flow_rtt", f"""
WITH {CANONICAL}, f AS (SELECT {KEY}, rev, arg_min(seq, frame_number) AS first_seq FROM c WHERE protocol = 'TCP' AND payload_len > 0 GROUP BY ALL),
d AS (SELECT {KEY}, rev AS way, {POS.format(v='seq')} + payload_len AS pos, timestamp FROM c JOIN f USING ({KEY}, rev) WHERE payload_len > 0 AND flags & 8 <> 0),
a AS (SELECT x.*, {POS.format(v='ack')} AS pos FROM (SELECT {KEY}, NOT rev AS rev, frame_number, timestamp, ack FROM c WHERE protocol = 'TCP' AND flags & 16 <> 0) x JOIN f USING ({KEY}, rev)),
r AS (SELECT * FROM (SELECT *, max(pos) OVER (PARTITION BY {KEY}, rev ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM a) WHERE highest IS NULL OR pos > highest),
m AS (SELECT d.*, (SELECT arg_min(r.timestamp, r.pos) FROM r WHERE r.job_id = d.job_id AND r.protocol = d.protocol AND r.ip_a = d.ip_a AND r.port_a = d.port_a AND r.ip_b = d.ip_b AND r.port_b = d.port_b AND r.rev = d.way AND r.pos >= d.pos) AS covered FROM d)
SELECT {KEY}, count(*) AS samples, round(avg((epoch_us(covered) - epoch_us(timestamp)) / 1000) * 100) / 100 AS data_rtt_ms FROM m WHERE covered > timestamp GROUP BY ALL
""", t.round_trips, "segments")
named("flow_rst", f"""
WITH {CANONICAL}, e AS (SELECT {KEY}, arg_min(ttl, frame_number) FILTER (flags & 4 <> 0) AS rst, arg_min(ip_id, frame_number) FILTER (flags & 4 <> 0) AS ip_id, arg_min(rev, frame_number) FILTER (flags & 4 <> 0) AS way,
  arg_min(ttl, frame_number) FILTER (flags & 4 = 0 AND ttl > 0 AND NOT rev) AS fwd, arg_min(ttl, frame_number) FILTER (flags & 4 = 0 AND ttl > 0 AND rev) AS bwd FROM c WHERE protocol = 'TCP' GROUP BY ALL),
b AS (SELECT *, CASE WHEN way THEN bwd ELSE fwd END AS base FROM e WHERE rst > 0), k AS (SELECT *, CAST(abs(rst - base) AS INT) AS rst_delta FROM b)
SELECT {KEY}, CASE WHEN base IS NULL THEN 'unknown' WHEN rst_delta >= 5 THEN 'suspicious' ELSE 'genuine' END AS rst_authenticity, rst_delta,
  CASE WHEN rst_delta >= 5 THEN 'hop limit ' || rst || ' of the reset is ' || rst_delta || ' away from ' || base || ', which its direction began with' || CASE WHEN ip_id = 0 THEN '; its IP-ID is 0, as of packets made by simple tools' ELSE '' END END AS rst_reason FROM k
""", t.resets, "segments")
PARTS = [STATEMENTS[f"flow_{n}"] for n in ("volume", "handshake", "retrans", "rtt", "rst")] + [STATEMENTS["flow_trend"].replace("2592000", "3600")]
RTT = "CASE WHEN data_rtt_ms > 0 THEN data_rtt_ms ELSE coalesce(handshake_ms, 0.0) END"
LOST = "CASE WHEN p <= 0 THEN 0 WHEN p <= 3 THEN CAST(trunc(p / 3 * 30) AS INT) ELSE least(30 + CAST(trunc((p - 3) / 3 * 20) AS INT), 90) END"
SCORE = f"CAST(CASE WHEN protocol = 'TCP' THEN greatest(0, 100 - CASE WHEN rtt_ms > 0 THEN least(CAST(trunc(rtt_ms / 500 * 40) AS INT), 40) ELSE 0 END - {LOST}) ELSE 100 END AS INT)"
named("flow_tracker", f"""
WITH t AS (SELECT *, {RTT} AS rtt_ms, coalesce(loss_pct, 0.0) AS p FROM ({PARTS[0]}) """ + " ".join(f"LEFT JOIN ({x}) USING ({KEY})" for x in PARTS[1:]) + f"""),
s AS (SELECT * EXCLUDE (p), {SCORE} AS sla_score FROM t)
SELECT *, CASE WHEN sla_score >= 80 THEN 'good' WHEN sla_score >= 60 THEN 'acceptable' WHEN sla_score >= 40 THEN 'poor' ELSE 'critical' END AS sla_verdict FROM s
""", t.track, "segments")
STREAM = "job_id, src_ip, src_port, dst_ip, dst_port, ssrc"
named("rtp_gap", f"""
SELECT *, round(lost / (packets + lost) * 10000) / 100 AS loss_pct FROM (SELECT {STREAM}, count(*) AS packets, coalesce(max(gap), 0) AS max_seq_gap, CAST(coalesce(sum(gap - 1) FILTER (gap > 1), 0) AS BIGINT) AS lost
FROM (SELECT *, (rtp_seq - lag(rtp_seq) OVER (PARTITION BY {STREAM} ORDER BY frame_number) + 65536) % 65536 AS gap FROM v_segments) GROUP BY ALL)
""", t.rtp_gaps, "segments")
STEPS = f"""
s AS (SELECT {STREAM}, frame_number, abs(CAST(trunc((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1000.0) AS BIGINT) - (rtp_time - lag(rtp_time) OVER w + 4294967296) % 4294967296) AS d
  FROM v_segments WINDOW w AS (PARTITION BY {STREAM} ORDER BY frame_number)),
n AS (SELECT *, row_number() OVER (PARTITION BY {STREAM} ORDER BY frame_number) - 1 AS i FROM s WHERE d IS NOT NULL),
j AS (SELECT a.*, (SELECT sum(b.d / 16 * pow(15.0 / 16, a.i - b.i)) FROM n b
  WHERE b.job_id = a.job_id AND b.src_ip = a.src_ip AND b.src_port = a.src_port AND b.dst_ip = a.dst_ip AND b.dst_port = a.dst_port AND b.ssrc = a.ssrc AND b.i <= a.i) AS j FROM n a)"""
named("rtp_jitter", f"""
WITH {STEPS}, k AS (SELECT DISTINCT {STREAM} FROM v_segments), m AS (SELECT {STREAM}, arg_max(j, i) AS e, min(j) AS low, max(j) AS high, avg(j) AS mean FROM j GROUP BY ALL)
SELECT {STREAM}, round(coalesce(e, 0.0) * 1000) / 1000 AS jitter, round(coalesce(low, 0.0) * 1000) / 1000 AS jitter_min, round(coalesce(high, 0.0) * 1000) / 1000 AS jitter_max,
  round(coalesce(mean, 0.0) * 1000) / 1000 AS jitter_avg FROM k LEFT JOIN m USING ({STREAM})
""", lambda p: t.rtp_jitter(p).drop("jitter_trend"), "segments")
# Streams by job and media port alone, so that they have more steps than a trend has points.
named("rtp_jitter_trend", """
WITH s AS (SELECT job_id, frame_number, abs(CAST(trunc((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1000.0) AS BIGINT) - (rtp_time - lag(rtp_time) OVER w + 4294967296) % 4294967296) AS d
  FROM v_segments WINDOW w AS (PARTITION BY job_id ORDER BY frame_number)),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY frame_number) - 1 AS i FROM s WHERE d IS NOT NULL) WHERE i < 300),
j AS (SELECT a.job_id, a.i, (SELECT sum(b.d / 16 * pow(15.0 / 16, a.i - b.i)) FROM n b WHERE b.job_id = a.job_id AND b.i <= a.i) AS j FROM n a),
c AS (SELECT job_id, CASE WHEN count(*) > 60 THEN CAST(ceil(count(*) / 60) AS BIGINT) ELSE 1 END AS step FROM j GROUP BY ALL)
SELECT job_id, CAST(i AS INT) AS i, round(j * 100) / 100 AS ms FROM j JOIN c USING (job_id) WHERE i % step = 0
""", lambda p: t.rtp_jitter(p.withColumns({"src_ip": F.lit("a"), "dst_ip": F.lit("b"), "src_port": F.lit(1), "dst_port": F.lit(2), "ssrc": F.lit(3)})).select("job_id", F.explode("jitter_trend").alias("p")).select("job_id", "p.*"), "segments")
