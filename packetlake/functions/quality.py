"""Voice and transport quality as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 2) -> Column:
    """Half away from zero at the digits of the scaled double, as DuckDB does: not ``round(x, digits)``."""
    return F.round(x * 10**digits) / 10**digits


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def mos_of_r(r: Column) -> Column:
    return 1 + 0.035 * r + r * (r - 60) * (100 - r) * 7e-6


def mos(loss_pct: Column, jitter_ms: Column, latency_ms: Column) -> Column:
    """Mean opinion score of a simplified E-model, 1 to 4.5, three decimals."""
    delay = F.when(latency_ms > 177.3, 0.024 * latency_ms + 0.11 * (latency_ms - 177.3)).otherwise(F.lit(0.0))
    return rounded(clamp(mos_of_r(clamp(94.2 - 2.5 * loss_pct - 0.1 * jitter_ms - delay, 0, 100)), 1, 4.5), 3)


def quality_of_mos(score: Column) -> Column:
    return F.when(score >= 4, "excellent").when(score >= 3.6, "good").when(score >= 3.1, "fair").when(score >= 2.6, "poor").otherwise("bad")


def verdict(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "acceptable").when(score >= 40, "poor").otherwise("critical")


def tcp_score(rtt_ms: Column, retrans_pct: Column) -> Column:
    """100 less penalties for round-trip time (40 at most) and retransmissions (90 at most), 0 at least."""
    rtt = F.when(rtt_ms > 0, F.least((rtt_ms / 500 * 40).cast("int"), F.lit(40))).otherwise(0)
    retrans = F.when(retrans_pct <= 0, 0).when(retrans_pct <= 3, (retrans_pct / 3 * 30).cast("int")).otherwise(F.least(30 + ((retrans_pct - 3) / 3 * 20).cast("int"), F.lit(90)))
    return F.greatest(F.lit(0), 100 - rtt - retrans)


def rtp_score(jitter_ms: Column, loss_pct: Column) -> Column:
    """100 less penalties for jitter (40 at most) and loss (60 at most)."""
    return F.greatest(F.lit(0), 100 - F.least((jitter_ms / 100 * 40).cast("int"), F.lit(40)) - F.least((loss_pct / 5 * 60).cast("int"), F.lit(60)))


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters in bits; zero for the empty one."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    size = F.size(letters).cast("double")
    bits = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda sum_, c: sum_ + (lambda p: -p * F.log2(p))(F.size(F.filter(letters, lambda x: x == c)) / size))
    return F.when(size > 0, bits).otherwise(F.lit(0.0))
