"""Counters of runs: what passes a place of a plan is counted as it passes, in batch and stream alike.

``observe`` counts in the tasks that do the work, without another pass. A retried task counts once where its rows
go straight to a sink or an action; put observations behind the last shuffle, as a stage that is run again counts again.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counters(df: DataFrame) -> dict[str, Column]:
    """What can be counted of a table by its columns: rows, bytes, errors, and rows by protocol or type."""
    have, out = set(df.columns), {"rows": F.count(F.lit(1))}
    size = next((c for c in ("length", "bytes") if c in have), None)
    if size:
        out["bytes"] = F.coalesce(F.sum(size), F.lit(0))
    if "is_error" in have:
        out["errors"] = F.count_if(F.coalesce("is_error", F.lit(False)))
    if "dropped" in have:
        out["dropped"] = F.coalesce(F.sum("dropped"), F.lit(0))
    return out


class RunMetrics(StreamingQueryListener):
    """Counters by name: ``watch`` places them in a plan, ``totals`` gives what was counted so far."""

    def __init__(self, spark: SparkSession, by: tuple[str, ...] = ()) -> None:
        self.spark, self.by = spark, by
        self._lock = threading.Lock()
        self._batches: list[tuple[str, Observation]] = []
        self._seen: dict[tuple[str, int, str], dict[str, int]] = {}
        self._rates: dict[str, float] = {}
        spark.streams.addListener(self)

    def watch(self, df: DataFrame, name: str, **more: Column) -> DataFrame:
        """``df``, counted as it passes; ``by`` names values whose rows are counted apart, such as type=SIP."""
        parts = {f"{c}={v}": F.count_if(F.col(c) == v) for c, v in (b.split("=", 1) for b in self.by) if c in df.columns}
        every = [c.alias(k) for k, c in (counters(df) | parts | more).items()]
        if df.isStreaming:
            return df.observe(f"metrics_{name}", *every)
        seen = Observation(f"metrics_{name}")
        self._batches.append((name, seen))
        return df.observe(seen, *every)

    def totals(self) -> dict[str, dict[str, int]]:
        """{name: {counter: total}} over all actions that have ended and all micro-batches; an action that ran again replaces nothing."""
        out: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        with self._lock:
            seen = list(self._seen.items())
        for (_, _, name), values in seen:
            for k, v in values.items():
                out[name][k] += v
        for name, observation in self._batches:
            for k, v in observation.get.items():
                out[name][k] += v
        return {k: dict(v) for k, v in out.items()}

    def rates(self) -> dict[str, float]:
        """Rows a second of each query's last micro-batch."""
        return dict(self._rates)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            self._rates[str(progress.name or progress.id)] = progress.processedRowsPerSecond
            for name, row in progress.observedMetrics.items():
                if name.startswith("metrics_"):  # a micro-batch that runs again after a failure has the same number
                    self._seen[str(progress.id), progress.batchId, name.removeprefix("metrics_")] = {k: v or 0 for k, v in row.asDict().items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def exposition(totals: dict[str, dict[str, int]], prefix: str = "packetlake") -> str:
    """The totals as text lines for a metrics server."""
    return "".join(f'{prefix}_{name}_total{{counter="{k}"}} {v}\n' for name, values in sorted(totals.items()) for k, v in sorted(values.items()))
